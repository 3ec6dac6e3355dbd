"""Token counts of whole texts, with huge documents encoded in overlapping chunks.

A document longer than ``chunk_chars`` becomes rows of overlapping chunks that are dealt
out over the cluster and encoded apart, each with the offsets of its pre-tokens. Where two
neighbours overlap, a pre-token boundary that both have is stable: the splitting pattern
looks at most one character past a match, so from a common boundary on both read the same
text in the same way, and the left chunk's boundaries before its end hold for the whole
text. The counts are spliced at the first such boundary. A document with a pair of
neighbours that share none is encoded again with an overlap eight times as wide (and
chunks of at least four times the overlap), until it is one chunk.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticelake.llm.common import text_or_empty, written
from noticelake.llm.pretokens import settled, words_and_odd

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 512

_CHUNKS = "id long, key string, n_bytes long, n_chars long, n_chunks int, chunk int, total long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def special_token(path: str) -> str:
    """The one added token of the vocabulary, which the library also finds inside texts."""
    with open(path, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f)["added_tokens"]]
    if len(added) != 1:
        raise ValueError(f"expected one added token, found {added}")
    return added[0]


@lru_cache(maxsize=1)
def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def word_counts(words: list[str], path: str) -> np.ndarray:
    """Tokens of each pre-token."""
    model, special, letters = tokenizer(path).model, special_token(path), _byte_characters()
    return np.fromiter((1 if w == special else len(model.tokenize(w.encode().decode("latin-1").translate(letters))) for w in words), np.int64, len(words))


def _occurrence_counts(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each pre-token occurrence of a column of lists, and the lists' lengths. Each distinct one is encoded once."""
    flat = words.flatten().dictionary_encode()
    counts = word_counts(flat.dictionary.to_pylist(), path)
    return counts[np.asarray(flat.indices)] if len(flat) else np.zeros(0, np.int64), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _count_whole(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, lengths = _occurrence_counts(settled(batch, special_token(path)), path)
            upto = np.concatenate([[0], np.cumsum(tokens)])
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(upto[ends] - upto[ends - lengths], pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    return count


def _count_chunks(path: str, step: int, overlap: int):
    guard = len(special_token(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = settled(batch, special_token(path))
            tokens, lengths = _occurrence_counts(words, path)
            chars = pc.utf8_length(words.flatten()).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, at = [], 0
            for row, n in zip(batch.drop_columns(["words", "odd"]).to_pylist(), lengths.tolist(), strict=True):
                start = row["chunk"] * step
                edges = start + np.concatenate([[0], np.cumsum(chars[at : at + n])])
                upto = np.concatenate([[0], np.cumsum(tokens[at : at + n])])
                at += n
                end = int(edges[-1])
                follows = start + step
                left = (edges > start) & (edges <= start + overlap) & (row["chunk"] > 0)
                # a special string may be cut at the chunk's end; what stands well before it is not touched
                sure = edges <= (end if end == row["n_chars"] else end - guard)
                right = (edges > follows) & (edges <= follows + overlap) & sure & (row["chunk"] + 1 < row["n_chunks"])
                rows.append(row | {"total": int(upto[-1]), "left_at": edges[left].tolist(), "left_n": upto[left].tolist(), "right_at": edges[right].tolist(), "right_n": upto[right].tolist()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_chunk_schema())

    return count


def _chunk_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in _CHUNKS.split(","))])


def _chunk_rows(huge: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """Overlapping chunks of (id, key, n_bytes, n_chars, text), encoded."""
    n_chunks = F.ceil(F.col("n_chars") / step).cast("int")
    pieces = (
        huge.withColumn("n_chunks", n_chunks)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .select("id", "key", "n_bytes", "n_chars", "n_chunks", "chunk", F.substring("text", F.col("chunk") * step + 1, F.lit(step + overlap + 64)).alias("piece"))
        .repartition("key", "chunk")
    )
    return pieces.select("id", "key", "n_bytes", "n_chars", "n_chunks", "chunk", *words_and_odd(F.col("piece"), special_token(path))).mapInArrow(_count_chunks(path, step, overlap), _CHUNKS)


def _spliced(chunks: DataFrame) -> DataFrame:
    """(id, key, n_bytes, n_tokens, copies, aligned) for each text; the same row of the input twice counts as two copies."""
    each = chunks.groupBy("id", "key", "n_bytes", "n_chunks", "chunk").agg(
        F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("total", "left_at", "left_n", "right_at", "right_n"))
    )
    left = each.where("chunk + 1 < n_chunks").select("id", "key", (F.col("chunk") + 1).alias("chunk"), "total", "right_at", "right_n")
    right = each.where("chunk > 0").select("id", "key", "chunk", "left_at", "left_n")
    same = [left["id"].eqNullSafe(right["id"]), left["key"] == right["key"], left["chunk"] == right["chunk"]]
    meet = F.array_min(F.array_intersect("right_at", "left_at"))
    upto = lambda at, n: F.element_at(n, F.array_position(at, F.col("meet")).cast("int"))
    links = (
        left.join(right, same)
        .select(left["id"], left["key"], "total", "right_at", "right_n", "left_at", "left_n", meet.alias("meet"))
        .select("id", "key", F.when(F.col("meet").isNotNull(), F.col("total") - upto("right_at", "right_n") + upto("left_at", "left_n")).alias("twice"))
    )
    nothing = F.lit(0).cast("long")
    both = each.select("id", "key", "n_bytes", "total", nothing.alias("twice"), F.when(F.col("chunk") == 0, F.col("copies")).alias("copies"), F.lit(True).alias("ok")).unionByName(
        links.select("id", "key", F.lit(None).cast("long").alias("n_bytes"), nothing.alias("total"), F.coalesce("twice", nothing).alias("twice"), F.lit(None).cast("long").alias("copies"), F.col("twice").isNotNull().alias("ok"))
    )
    return both.groupBy("id", "key").agg(F.max("n_bytes").alias("n_bytes"), (F.sum("total") - F.sum("twice")).alias("n_tokens"), F.max("copies").alias("copies"), F.min("ok").alias("aligned"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of ``docs``: (id_col long, n_bytes long, n_tokens long).

    A null text counts as empty: no bytes, no tokens. The added token's string inside a
    text is one token, as is the library's default. Null and repeated ids keep their rows;
    other columns are not read. An empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    text: Column = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.char_length(text).cast("long").alias("n_chars"), text.alias("text"))
    short = rows.where(F.col("n_chars") <= chunk_chars).select("id", "n_bytes", *words_and_odd(F.col("text"), special_token(path)))
    out = [short.mapInArrow(_count_whole(path), "id long, n_bytes long, n_tokens long")]
    huge = rows.where(F.col("n_chars") > chunk_chars).withColumn("key", F.sha2("text", 256))
    step, overlap = chunk_chars, min(overlap_chars, chunk_chars // 4)
    while True:
        spliced = written(_spliced(_chunk_rows(huge, path, step, overlap)), "spliced")
        out.append(spliced.where("aligned").select("id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy"))
        failed = spliced.where("not aligned").select("key").distinct()
        if failed.isEmpty():
            break
        huge = huge.join(failed, "key", "left_semi")
        overlap *= 8
        step = max(step, 4 * overlap)
    counted = out[0]
    for more in out[1:]:
        counted = counted.unionByName(more)
    return counted.withColumnRenamed("id", id_col)


def token_limits(docs: DataFrame, limit: int = 512) -> DataFrame:
    """Query columns: doc_id, n_bytes, n_tokens, over_limit."""
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > limit)
