"""Secret scan with structural confirmation.

Three base patterns find assignments of credentials, access keys and long hex strings.
Beyond them, runs that look like base64, hex, PEM blocks or signed tokens are decoded and
parsed, and are reported only if the structure holds: DER private keys by their nested
lengths and leading fields, OpenSSH keys by their length-prefixed strings, signed tokens
by a JSON header that names an algorithm and a JSON object as payload, PEM blocks that are
encrypted under a header by their cipher's block length. Line breaks may be real or
escaped, and base64 lines of equal width are joined before they are decoded.

Every document is one row of work in the task that read it, so no shuffle is needed.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import free_name, text_or_empty
from noticelake.llm.worker import lean

#: Kinds in the order in which spans with equal starts are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "openssh")

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----"
    r"((?:(?:\s|\\+[rnt])*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+(?=[\r\n]|\\+[rn]))*+)"  # header lines
    r"((?:[A-Za-z0-9+/=\s]|\\+[rnt/])++)-----END \1-----",
    re.ASCII,
)
ENCRYPTED = re.compile(r"Proc-Type: ?4, ?ENCRYPTED(?:\s|\\+[rnt])+DEK-Info: ?[A-Z0-9-]+, ?([0-9A-Fa-f]+)", re.ASCII)
ESCAPED = re.compile(r"\s|\\+[rnt]|\\+(?=/)", re.ASCII)
JWT = re.compile(r"(?<![\w.-])eyJ[\w-]+\.[\w-]+\.[\w-]*", re.ASCII)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Base64 lines, one below the other.
WRAPPED = re.compile(
    r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\[nrt]))[A-Za-z0-9+/_-]++={0,2}+(?:[ \t]*+(?:\r?\n|(?:\\+r)?\\+n)[ \t]*+[A-Za-z0-9+/_-]++={0,2}+)*+"
)
LINE = re.compile(r"(?<!\\)[A-Za-z0-9+/_-]++={0,2}+|(?<=\\[nrt])[A-Za-z0-9+/_-]++={0,2}+")
MIN_LINE = 16
HEX_KEY = re.compile(r"[0-9A-Fa-f]{64,}")

_HEX_BYTE = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_BASE64_BYTE = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8))


def _has_run(raw: np.ndarray, kind: np.ndarray, length: int) -> bool:
    """Whether ``length`` bytes of a kind stand in a row somewhere."""
    breaks = np.flatnonzero(~kind[raw])
    if not len(breaks):
        return len(raw) >= length
    return bool(breaks[0] >= length or len(raw) - 1 - breaks[-1] >= length or (np.diff(breaks) > length).any())


def _der_fields(raw: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The (tag, content) pairs that fill ``raw`` exactly; None if lengths do not fit. Sequences are checked all the way down."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw) or depth > 16:
            return None
        tag, size = raw[at], raw[at + 1]
        at += 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(raw):
                return None
            size = int.from_bytes(raw[at : at + n], "big")
            at += n
        if at + size > len(raw):
            return None
        content = raw[at : at + size]
        if tag & 0x20 and _der_fields(content, depth + 1) is None:
            return None
        out.append((tag, content))
        at += size
    return out


def is_der_key(raw: bytes) -> bool:
    """PKCS#1, PKCS#8, SEC 1 or encrypted PKCS#8 private keys."""
    top = _der_fields(raw) if raw[:1] == b"\x30" and len(raw) >= 32 else None
    fields = _der_fields(top[0][1]) if top and len(top) == 1 else None
    if not fields:
        return False
    tags = [tag for tag, _ in fields]
    if tags[0] == 0x02 and fields[0][1] in (b"\x00", b"\x01"):
        rsa = len(fields) >= 9 and all(tag == 0x02 for tag in tags[:9])
        dsa = len(fields) == 6 and all(tag == 0x02 for tag in tags)
        wrapped = tags[1:3] == [0x30, 0x04] and fields[1][1][:1] == b"\x06"
        curve = tags[1:2] == [0x04] and fields[0][1] == b"\x01" and len(fields[1][1]) >= 16
        return rsa or dsa or wrapped or curve
    return tags == [0x30, 0x04] and fields[0][1][:1] == b"\x06" and len(fields[1][1]) >= 32


def is_openssh_key(raw: bytes) -> bool:
    magic = b"openssh-key-v1\x00"
    if not raw.startswith(magic):
        return False
    at, strings = len(magic), 0
    while strings < 3:
        if at + 4 > len(raw):
            return False
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
        strings += 1
    return at + 4 <= len(raw) and int.from_bytes(raw[at : at + 4], "big") >= 1


def decode_base64(run: str) -> bytes | None:
    """Standard or URL alphabet, with or without padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(run: str) -> bool:
    parts = run.split(".")
    raw = [decode_base64(x) if x else b"" for x in parts]
    if len(parts) != 3 or any(x is None for x in raw):
        return False
    try:
        header, payload = json.loads(raw[0]), json.loads(raw[1])
    except ValueError:
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or len(raw[2]) >= 16


def _pem_key(headers: str, raw: bytes) -> bool:
    """A key in the clear, or one of whole blocks of the cipher that the headers name."""
    cipher = ENCRYPTED.search(headers)
    block = len(cipher[1]) // 2 if cipher else 0
    return is_der_key(raw) or is_openssh_key(raw) or (block in (8, 16) and len(raw) >= 32 and len(raw) % block == 0)


def _wrapped(text: str) -> Iterator[tuple[str, int, int]]:
    """(joined run, start, end) of base64 lines of equal width and at most one shorter line after them; runs that cannot begin a key are left out."""
    for chain in WRAPPED.finditer(text):
        lines = list(LINE.finditer(text, *chain.span()))
        i = 0
        while i < len(lines):
            width, j = len(lines[i][0]), i + 1
            while j < len(lines) and len(lines[j][0]) == width and not lines[j - 1][0].endswith("="):
                j += 1
            if width >= MIN_LINE and lines[i][0].startswith(("M", "b3Blb")):
                run = "".join(m[0] for m in lines[i:j])
                if j < len(lines) and len(lines[j][0]) < width and not run.endswith("="):
                    yield run + lines[j][0], lines[i].start(), lines[j].end()
                if len(run) >= 40:
                    yield run, lines[i].start(), lines[j - 1].end()
            i = j


def _structured(text: str, hex_run: bool) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            raw = decode_base64(ESCAPED.sub("", m[3]))
            if raw and _pem_key(m[2], raw):
                found.append(("pem", *m.span()))
    inside = lambda m: any(a <= m.start() and m.end() <= b for _, a, b in found)
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    for run, start, end in _wrapped(text):
        raw = None if any(a < end and start < b for _, a, b in found) else decode_base64(run)
        if raw and (is_openssh_key(raw) or is_der_key(raw)):
            found.append(("openssh" if is_openssh_key(raw) else "der", start, end))
    for m in BASE64.finditer(text):
        raw = None if inside(m) else decode_base64(m[0])
        if raw and is_openssh_key(raw):
            found.append(("openssh", *m.span()))
        elif raw and is_der_key(raw):
            found.append(("der", *m.span()))
    if hex_run:
        for m in HEX_KEY.finditer(text):
            if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0])):
                found.append(("der", *m.span()))
    return found


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        lower = text.lower()
        if any(word in lower for word in ASSIGN_WORDS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    raw = np.frombuffer(text.encode(), np.uint8)
    if _has_run(raw, _HEX_BYTE, MIN_HEX):
        found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    if _has_run(raw, _BASE64_BYTE, MIN_LINE) or "-----BEGIN " in text or "eyJ" in text:
        found += _structured(text, True)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each span, or run of overlapping ones, replaced by ``<secret>``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], "<secret>"]
        at = max(at, end)
    return "".join(out) + text[at:]


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(redacted: bool):
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                spans = [find_secrets(x) for x in texts]
                masked = [redact(t, s) if s and redacted else None for t, s in zip(texts, spans, strict=True)]
                listed = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], _FOUND)
                yield pa.RecordBatch.from_arrays([part.column("id"), listed, pa.array(masked, pa.string())], ["id", "spans", "redacted"])

    return scan


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """One row per row of ``docs``: (id_col long, spans array<struct<kind, start, end>>, redacted string).

    ``redacted`` is the text with its spans masked, and null where there is nothing to mask
    or where ``redacted`` is off.
    A null or empty text has no spans; null and repeated ids keep their rows; other columns
    are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(_scan(redacted), "id long, spans array<struct<kind:string,start:int,end:int>>, redacted string")
    return found.withColumnRenamed("id", id_col)


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with its secrets masked, and the length of changed texts brought up to date. Rows, order of columns and other values stay."""

    @F.arrow_udf("string")
    @lean
    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = (texts.slice(at, 256).to_pylist() for at in range(0, len(texts), 256))
            yield pa.concat_arrays([pa.array([redact(x, find_secrets(x)) for x in part], pa.string()) for part in parts] or [texts])

    name = free_name(docs, "_masked")
    new = docs.withColumn(name, masked(F.col(f"`{text_col}`")))
    changed = ~F.col(name).eqNullSafe(F.col(f"`{text_col}`"))
    values = {text_col: F.col(name), length_col: F.when(changed, F.char_length(name).cast("long")).otherwise(F.col(f"`{length_col}`"))}
    return new.select(*(values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns))


def secret_digests(docs: DataFrame) -> DataFrame:
    """Query columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return scan_secrets(docs, redacted=False).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
