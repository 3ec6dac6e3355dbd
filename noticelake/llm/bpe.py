"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are cut into pre-tokens. Each task packs its documents into blocks of
bounded size: a dictionary of the block's distinct words, dealt by the word's hash
into buckets, and each document's word numbers in order of position. The buckets
are shuffled and sorted, so that all copies of a word meet in one task, one after the
other, and are encoded there once; the ids travel back to their block, where documents are put together by
position. Packing keeps a shuffle row for each (block, bucket) rather than one for
each word occurrence, so a word that is in every block costs one entry a block and
no key is hot.

Words and positions are packed by two passes over the documents, so that positions are
shuffled once, straight to their block. Both passes must see the same rows in the same
order, as a scan of files gives them; a block whose two halves differ raises an error.

Decoding joins ids with the vocabulary's (token, bytes) table: ``decode_ids`` does it
for any frame of id arrays; ``encode_documents`` looks the ids of whole documents, once
these are put together, up in the same table, so the bytes check the ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.common import free_name, text_or_empty
from noticelake.llm.pretokens import settled, words_and_odd
from noticelake.llm.worker import give_back, lean

RANKS = "byte_bpe_50k.tiktoken"
#: Tokens of a vocabulary, at most: its table is broadcast.
TOKENS = 2_000_000

#: Bytes of text in a block; a longer document is a block by itself.
BLOCK_BYTES = 12 << 20

_WORDS = "block long, bucket int, digest long, payload binary"
_PLACES = "block long, digest long, payload binary"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: its size is the file's, fixed and small (about 50,000 entries)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


@lru_cache(maxsize=4)
def codec(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.BinaryArray:
    """The bytes of each token, by its number."""
    found = ranks(path)
    out = [b""] * (max(found.values()) + 1)
    for token, rank in found.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The vocabulary as a table (token int, bytes binary)."""
    rows = [(rank, token) for token, rank in ranks(path or public_tokenizers.path(RANKS)).items()]
    return spark.createDataFrame(rows, "token int, bytes binary")


def decode_ids(encoded: DataFrame, tokens: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of each row's id array, by a join with the token table.

    Rows keep their other columns and repeated rows stay. A null array decodes to null, an
    empty one to no bytes; an id outside the table makes the row null. The token table is
    a vocabulary, so it is broadcast; rows are put together by position.
    """
    row, all_ids, pos, tok, data, found, lost, out = (free_name(encoded, x) for x in ("_row", "_ids", "_pos", "_tok", "_bytes", "_parts", "_lost", "_out"))
    keyed = encoded.withColumn(row, F.xxhash64(F.col(f"`{ids_col}`")))
    distinct = keyed.select(row, F.col(f"`{ids_col}`").alias(all_ids)).where(F.col(all_ids).isNotNull()).dropDuplicates([row, all_ids])
    table = tokens.limit(TOKENS + 1).select(F.col("token").alias(tok), F.col("bytes").alias(data))
    if table.count() > TOKENS:
        raise ValueError(f"a vocabulary of more than {TOKENS} tokens")
    parts = (
        distinct.select(row, all_ids, F.posexplode(all_ids).alias(pos, tok))
        .join(F.broadcast(table), tok, "left")
        .groupBy(row, all_ids)
        .agg(F.sort_array(F.collect_list(F.struct(pos, data))).alias(found), F.count(F.when(F.col(data).isNull(), 1)).alias(lost))
        .select(row, all_ids, F.when(F.col(lost) == 0, F.unhex(F.array_join(F.transform(found, lambda p: F.hex(p[data])), ""))).alias(out))
    )
    joined = keyed.join(parts, (keyed[row] == parts[row]) & (keyed[ids_col] == parts[all_ids]), "left")
    value = F.when(F.size(F.col(f"`{ids_col}`")) == 0, F.lit(b"")).otherwise(F.col(out))
    return joined.select(*(keyed[c] for c in encoded.columns), value.alias(out_col))


def _bucket_of(words: pa.Array, buckets: int) -> np.ndarray:
    """The same bucket for the same word everywhere."""
    return np.fromiter((zlib.crc32(w) % buckets for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))


def _pack_strings(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zlib.compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words), 1)


def _unpack_strings(payload: bytes) -> list[bytes]:
    raw = zlib.decompress(payload)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)).tolist()
    starts = [4 + 4 * n, *ends[:-1]] if n else []
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def _pack_ids(ids: list[list[int]]) -> bytes:
    lengths = np.fromiter(map(len, ids), np.uint32, len(ids))
    flat = np.fromiter((i for word in ids for i in word), np.uint32, int(lengths.sum()))
    return zlib.compress(np.uint32(len(ids)).tobytes() + lengths.tobytes() + flat.tobytes(), 1)


def _unpack_ids(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(payload)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    return np.frombuffer(raw, np.uint32, n, 4), np.frombuffer(raw, np.uint32, -1, 4 + 4 * n)


def _slices(batch: pa.RecordBatch, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``block_bytes`` of words; a larger row stands alone."""
    ends = np.concatenate([[0], np.cumsum(batch.column("bytes").to_numpy(), dtype=np.int64)])
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + block_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def _dictionary(part: pa.RecordBatch, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """Distinct words in order of bucket, each one's bucket, the number of each word occurrence, and a digest of the words."""
    encoded = part.column("words").flatten().dictionary_encode()
    bucket = _bucket_of(encoded.dictionary, buckets)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    words = encoded.dictionary.take(pa.array(order)).cast(pa.binary()).to_pylist()
    return words, bucket[order], number[np.asarray(encoded.indices)], zlib.crc32(b"\0".join(words))


def _word_rows(block: int, part: pa.RecordBatch, buckets: int) -> list[tuple]:
    words, bucket, _, digest = _dictionary(part, buckets)
    if not words:
        return []
    used, first = np.unique(bucket, return_index=True)
    last = [*first[1:].tolist(), len(words)]
    return [(block, int(b), digest, _pack_strings(words[i:j])) for b, i, j in zip(used.tolist(), first.tolist(), last, strict=True)]


def _place_rows(block: int, part: pa.RecordBatch, buckets: int) -> list[tuple]:
    words, _, sequence, digest = _dictionary(part, buckets)
    lengths = pc.list_value_length(part.column("words")).to_numpy(zero_copy_only=False).astype(np.uint32)
    sequence = sequence.astype(np.uint32 if len(words) > 65535 else np.uint16)
    # planes of bytes compress better than whole numbers
    planes = sequence.view(np.uint8).reshape(-1, sequence.itemsize).T.tobytes()
    ids = part.column("id")
    known = np.asarray(ids.is_valid())
    values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    head = np.array([part.num_rows, sequence.itemsize], np.uint32).tobytes()
    body = head + values.tobytes() + known.astype(np.uint8).tobytes() + lengths.tobytes() + planes
    return [(block, digest, zlib.compress(body, 1))]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


_WORD_FIELDS = [("block", pa.int64()), ("bucket", pa.int32()), ("digest", pa.int64()), ("payload", pa.binary())]
_PLACE_FIELDS = [("block", pa.int64()), ("digest", pa.int64()), ("payload", pa.binary())]


def _blocks(pack_rows, fields, buckets: int, block_bytes: int):
    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 0
        for batch in batches:
            batch = batch.set_column(batch.schema.get_field_index("words"), "words", settled(batch))
            for part in _slices(batch, block_bytes):
                # the partition's number and the block's within it: the same again if the task is run again
                if rows := pack_rows((part.column("partition")[0].as_py() << 32) + block, part, buckets):
                    yield _batch(rows, fields)
                block += 1

    return pack


def _encode_words(path: str):
    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, known, current = codec(path), {}, None
        for batch in batches:
            rows = []
            for block, bucket, digest, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "digest", "payload")), strict=True):
                if bucket != current:  # a word is in one bucket alone
                    current, known = bucket, {}
                words = _unpack_strings(payload)
                for word in words:
                    if word not in known:
                        known[word] = merges.encode_ordinary(word.decode())
                rows.append((block, bucket, digest, _pack_ids([known[word] for word in words])))
            if rows:
                yield _batch(rows, _WORD_FIELDS)

    return encode


def _assemble(path: str, slice_ids: int = 1 << 18):
    def assemble(places: pa.Table, words: pa.Table) -> pa.Table:
        table, schema = token_bytes(path), pa.schema([("id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
        parts = dict(zip(words.column("bucket").to_pylist(), words.column("payload").to_pylist(), strict=True))
        body = zlib.decompress(places.column("payload")[0].as_py())
        n, width = np.frombuffer(body, np.uint32, 2).tolist()
        at = 8
        values = np.frombuffer(body, np.int64, n, at)
        known = np.frombuffer(body, np.uint8, n, at := at + 8 * n).astype(bool)
        lengths = np.frombuffer(body, np.uint32, n, at := at + n).astype(np.int64)
        planes = np.frombuffer(body, np.uint8, -1, at + 4 * n).reshape(width, -1)
        sequence = np.ascontiguousarray(planes.T).view(np.uint16 if width == 2 else np.uint32).ravel()
        unpacked = [_unpack_ids(parts[b]) for b in sorted(parts)]
        sizes = np.concatenate([x[0] for x in unpacked]).astype(np.int64) if unpacked else np.zeros(0, np.int64)
        flat = np.concatenate([x[1] for x in unpacked]).astype(np.int32) if unpacked else np.zeros(0, np.int32)
        word_ends = np.cumsum(sizes)
        if set(words.column("digest").to_pylist()) - {places.column("digest")[0].as_py()}:
            raise ValueError("the documents' rows changed between two passes over them; write them to a table first")
        word_starts = word_ends - sizes
        out, row, ends = [], 0, np.cumsum(lengths)
        while row < n:
            begin = int(ends[row] - lengths[row])
            stop = max(row + 1, int(np.searchsorted(ends, begin + slice_ids, side="right")))
            used = sequence[begin : int(ends[stop - 1])].astype(np.int64)
            count = sizes[used]
            upto = np.concatenate([[0], np.cumsum(count)])
            # the ids of each word in turn: where the word's ids start, plus 0, 1, 2, ...
            ids = flat[np.repeat(word_starts[used] - upto[:-1], count) + np.arange(upto[-1])]
            cuts = np.concatenate([[0], ends[row:stop] - begin]).astype(np.int64)
            starts = upto[cuts].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(ids))
            # the ids' bytes lie one after the other: a document's are those from its first id to its last
            found = table.take(pa.array(ids))
            byte_ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, found.offset * 4)
            decoded = pa.BinaryArray.from_buffers(pa.binary(), stop - row, [None, pa.py_buffer(np.ascontiguousarray(byte_ends[starts])), found.buffers()[2]])
            out.append(pa.Table.from_arrays([pa.array(values[row:stop], mask=~known[row:stop]), lists, decoded], schema=schema))
            row = stop
        give_back()
        return pa.concat_tables(out) if out else schema.empty_table()

    return assemble


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: (id_col long, token_ids array<int>, decoded binary).

    ``token_ids`` are what tiktoken's ``encode_ordinary`` gives for the whole text and
    ``decoded`` the bytes that these ids stand for. A null or empty text has no ids and
    no bytes; null and repeated ids keep their rows; other columns of ``docs`` are not
    read. An empty table gives an empty result.
    """
    path = path or public_tokenizers.path(RANKS)
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.spark_partition_id().cast("long").alias("partition"),
        F.octet_length(text_or_empty(text_col)).alias("bytes"),
        *words_and_odd(text_or_empty(text_col)),
    )
    words = rows.mapInArrow(_blocks(_word_rows, _WORD_FIELDS, buckets, block_bytes), _WORDS)
    places = rows.mapInArrow(_blocks(_place_rows, _PLACE_FIELDS, buckets, block_bytes), _PLACES)
    coded = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(path), _WORDS)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return places.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_assemble(path), schema).withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame) -> DataFrame:
    """Query columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode_documents(docs)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
