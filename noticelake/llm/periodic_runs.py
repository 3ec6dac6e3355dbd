"""Periodic runs of words, found by masking with repeated k-grams and Main-Lorentz on what is left.

A run of period q and length L has its words q apart equal over L - q words, the overlap of
the run with itself. With L of at least ``least`` and ``power`` periods, that overlap has no
fewer than k = min over q of (max(least, power * q) - q) words, and each word of the run lies
in a k-gram that comes again q words away in the same document. So words outside of every
repeated k-gram are in no run, and runs never cross them: the document falls into segments,
and most documents into none.

On the segments, Main-Lorentz: a segment is halved again and again; a run across a middle m
with period p shows in how far the words before and behind m agree with those p further on,
or p further back. All halvings of a depth and all their periods are one set of arrays, and
"how far" is read off a table of the segment's repeated factors of 1, 2, 4, ... words.
Numbers stand for words exactly, so nothing rests on hashes; the masking alone uses hashes,
and there a collision only masks less.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import text_or_empty

#: Words that a run has at least, and periods.
LEAST, POWER = 24, 3


def shortest_overlap(least: int = LEAST, power: int = POWER) -> int:
    """Words over which any run overlaps itself, at least: the k of the masking."""
    return min(max(least, power * q) - q for q in range(1, least + 1))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


def _gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each stretch of k words, put together from stretches of 1, 2, 4, ... words."""
    mixed = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    power, size = mixed((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), 1
    whole, done = None, 0
    while True:
        if k & size:
            whole = power if whole is None else mixed(whole[: len(power) - done] * np.uint64(0x94D049BB133111EB) + power[done:])
            done += size
        if done == k:
            return whole
        power = mixed(power[:-size] * np.uint64(0x94D049BB133111EB) + power[size:])
        size *= 2


def segments(codes: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int]]:
    """Stretches [start, end) of at least ``least`` words that repeated k-grams cover."""
    k = shortest_overlap(least, power)
    if len(codes) < max(least, k + 1):
        return []
    grams = _gram_hashes(codes, k)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    steps = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(steps[:-1]) > 0, [0]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= least]


class _Factors:
    """Numbers of all factors of 1, 2, 4, ... words: equal factors have equal numbers."""

    def __init__(self, codes: np.ndarray):
        self.n, self.levels = len(codes), [np.unique(codes, return_inverse=True)[1].astype(np.int32)]
        while 1 << len(self.levels) <= self.n:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1].astype(np.int64)
            self.levels.append(np.unique(last[:-half] * (self.n + 1) + last[half:], return_inverse=True)[1].astype(np.int32))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal from i and from j on; i < j."""
        far = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            numbers = self.levels[level]
            fits = np.flatnonzero(j + far < len(numbers))
            fits = fits[numbers[i[fits] + far[fits]] == numbers[j[fits] + far[fits]]]
            far[fits] += 1 << level
        return far

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal back from i and from j, themselves included; i < j, and i may be -1."""
        far = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            numbers, size = self.levels[level], 1 << level
            fits = np.flatnonzero(i - far + 1 >= size)
            fits = fits[numbers[i[fits] - far[fits] - size + 1] == numbers[j[fits] - far[fits] - size + 1]]
            far[fits] += size
        return far


def _main_lorentz(codes: np.ndarray, spans: list[tuple[int, int]], least: int, power: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of the runs within the spans; a run that has several periods comes with each of them."""
    factors, found = _Factors(codes), set()
    parts = np.array(spans, np.int64).reshape(-1, 2)
    while len(parts):
        low, high = parts.T
        middle = (low + high) // 2
        periods = (high - low) // power
        each = np.repeat(np.arange(len(parts)), periods)
        p = np.arange(len(each)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        m = middle[each]
        # the run goes on for a period or more behind the middle, or before it
        for first, second in ((m, m + p), (m - p, m)):
            inside = np.flatnonzero((first >= 0) & (second <= len(codes)))
            i, j, q = first[inside], second[inside], p[inside]
            behind, before = factors.ahead(i, j), factors.back(i - 1, j - 1)
            length = behind + before + q
            good = np.flatnonzero((length >= least) & (length >= power * q))
            start = i[good] - before[good]
            found.update(zip(start.tolist(), (start + length[good]).tolist(), q[good].tolist(), strict=True))
        parts = np.concatenate([np.stack([low, middle], 1), np.stack([middle, high], 1)])
        parts = parts[parts[:, 1] - parts[:, 0] >= least]
    return found


def runs(codes: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    spans = segments(codes, least, power)
    if not spans:
        return []
    # the segments behind each other, with a number of its own between two
    sizes = [b - a for a, b in spans]
    starts = np.cumsum([0, *(s + 1 for s in sizes[:-1])])
    joined = np.concatenate([x for k, (a, b) in enumerate(spans) for x in (codes[a:b], [-1 - k])])[:-1]
    best: dict[tuple[int, int], int] = {}
    for start, end, period in _main_lorentz(joined, [(int(s), int(s) + n) for s, n in zip(starts, sizes, strict=True)], least, power):
        best[start, end] = min(period, best.get((start, end), period))
    moved = np.array([a - s for (a, _), s in zip(spans, starts, strict=True)])
    of = lambda at: int(moved[np.searchsorted(starts, at, "right") - 1])
    return sorted(((start + of(start), end - start, period) for (start, end), period in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]


def steepest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; the first start, then the smaller period among equals."""
    best = None
    for run in found:  # by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, with the end of every tenth document made periodic as the query asks for; a null id has none."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_FOUND = pa.schema(
    [("id", pa.int64()), ("n_runs", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("collapsed", pa.string())]
)


def _describe(least: int, power: int, loop: bool, texts: bool):
    def row(row_id: int | None, text: bytes) -> tuple:
        words = text.split()  # bytes split at x20 and x09-x0D
        if loop:
            words = looped(row_id, words)
        found = runs(numbered(words), least, power) if len(words) >= least else []
        best = steepest(found)
        left = b" ".join(collapsed(words, found))
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in found).encode()
        most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return row_id, len(found), *most, sha256(listed).hexdigest(), sha256(left).hexdigest(), left.decode() if texts else None

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [row(i, t) for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return describe


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER, loop: bool = False, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed).

    start, length, period and exponent_milli are those of the run with the greatest length
    per period, null where there is no run; ``collapsed`` is the text's words without those
    that a run repeats, one space between two, or null unless ``texts``. ``loop`` makes the
    ends of some documents periodic first, as the registered query asks for. A null or empty
    text has no words and no runs. Null and repeated ids keep their rows; a null id is never
    made periodic. Other columns are not read. A very long text costs n (log n)^2 steps
    where it repeats itself, and n log n else. An empty table gives an empty result.
    """
    if not 1 < power <= least:
        raise ValueError("a run needs two periods at least, and no fewer words than periods")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.encode(text_or_empty(text_col), "UTF-8").alias("text"))
    kinds = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"
    return rows.mapInArrow(_describe(least, power, loop, texts), kinds).withColumnRenamed("id", id_col)


def run_digests(docs: DataFrame) -> DataFrame:
    """Query columns: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    return find_runs(docs, loop=True, texts=False).drop("collapsed")
