"""Near-duplicates by circulant MinHash, banding and exact verification.

A signature needs two permutations: the first scatters the shingles, and coordinate k is
the smallest value that the second gives to the scattered positions shifted by k. Documents
with the same shingle set are one node from the start, so a set costs the same whether one
document or a third of the corpus has it. Bands of the signature put nodes into buckets; a
bucket's nodes gather round its smallest one. A gathering is dealt into blocks of bounded
size, each with the smallest node as a guest, and verified on full sets. Nodes that hang
together with the smallest need no other comparison, for they are in its component; the
rest alone is then held against the other blocks, pair of blocks by pair of blocks. So no
group is collected whole, and what moves grows with the group's size.

A node's label is a string of bytes: the smallest id that has the set, then the set's
digest. Labels are unique whatever ids are repeated or null, and in the order of ids.

Two nodes of similarity s share no band with probability (1 - s^ROWS)^BANDS: below 1e-5 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import few_files, free_name, row_key, text_or_empty, written
from noticelake.llm.components import connected_components
from noticelake.llm.worker import give_back, lean

BANDS, ROWS = 30, 5
#: Documents and shingles in a block of a gathering, at most about; a longer document is a block by itself.
BLOCK, BLOCK_SHINGLES = 256, 300_000
#: Words whose hashes a task remembers.
KNOWN_WORDS = 200_000

#: Stands in labels for an id that is null.
NO_ID = 2**63 - 1

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def shingle_set(text: str | None, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles; fewer words are one shingle, none give an empty set."""
    words = (text or "").encode().translate(_LOWER).split()
    for w in words:
        if w not in hashes:
            hashes[w] = xxhash.xxh3_64_intdigest(w)
    coded = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(coded) > size:
        total = np.zeros(len(coded) - size + 1, np.uint64)
        for i in range(size):
            total = (total ^ coded[i : len(coded) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return np.unique(total)
    total = np.zeros(min(1, len(coded)), np.uint64)
    for c in coded:
        total = (total ^ c) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total


def _sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    hashes: dict[bytes, int] = {}
    for text in texts:
        if len(hashes) > KNOWN_WORDS:
            hashes.clear()
        yield shingle_set(text, size, hashes)


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one row each."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    joined = np.concatenate(sets)
    positions = _scrambled((joined >> np.uint64(32)).astype(np.uint32) ^ _scrambled(joined.astype(np.uint32)))
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_scrambled((positions - np.uint32(k)) ^ np.uint32(0x5BD1E995)), starts)
    return out


def _describe(size: int, bands: int, rows: int):
    @lean
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(_sets(part.column("text").to_pylist(), size))
                filled = [s for s in sets if len(s)]
                keys: list[list[int] | None] = [None] * len(sets)
                if filled:
                    found = signatures(filled, bands * rows)
                    banded = np.zeros((len(filled), bands), np.uint64)
                    for r in range(rows):
                        banded = (banded ^ found[:, r::rows]) * np.uint64(0x9E3779B97F4A7C15)
                        banded ^= banded >> np.uint64(31)
                    banded = (banded + np.arange(bands, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                    rest = iter(banded.astype(np.int64).tolist())
                    keys = [next(rest) if len(s) else None for s in sets]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "key", "n_shingles", "digest", "bands"],
                )

    return describe


def _full_sets(size: int):
    @lean
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [s.astype(np.int64) for s in _sets(part.column("text").to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    return full


def linked_pairs(sets: list[np.ndarray], percent: int, width: int = 8192) -> np.ndarray:
    """Pairs (i, j), i < j, with 100 * intersection >= percent * union, by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets], np.int64)
    vocabulary, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[number] > 1
    order = np.cumsum(times > 1) - 1
    column, row = order[number[shared]], row[shared]
    by_column = np.argsort(column, kind="stable")
    column, row = column[by_column], row[by_column]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        block = np.zeros((len(sets), width), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        common += block @ block.T
    both = common.astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    return np.argwhere(np.triu(linked, 1))


def _forest(labels: list[bytes], sets: list[np.ndarray], percent: int) -> list[bytes]:
    """For each node the smallest label that it hangs together with."""
    root = list(range(len(labels)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in linked_pairs(sets, percent) if len(labels) > 1 else ():
        a, b = top(int(i)), top(int(j))
        if a != b:
            a, b = (a, b) if labels[a] < labels[b] else (b, a)
            root[b] = a
    return [labels[top(i)] for i in range(len(labels))]


def _verify(percent: int):
    def verify(group: pa.Table) -> pa.Table:
        """Links of each node to the smallest that it hangs together with; where there are more blocks, also (node, centre, true) for those that hang apart from the centre."""
        found = dict(zip(group.column("label").to_pylist(), (np.asarray(x.values) for x in group.column("shingles")), strict=True))
        labels = list(found)
        least = _forest(labels, list(found.values()), percent)
        rows = [(a, b, False) for a, b in zip(labels, least, strict=True) if a != b]
        if group.column("blocks")[0].as_py() > 1:
            centre = group.column("centre")[0].as_py()
            rows += [(a, centre, True) for a, b in zip(labels, least, strict=True) if b != centre]
        give_back()
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.bool_()))], ["a", "b", "apart"])

    return verify


def _label(least: Column, digest: Column) -> Column:
    """Bytes in the order of ids and then digests."""
    return F.concat(F.unhex(F.lpad(F.hex(least.bitwiseXOR(F.lit(-(2**63)))), 16, "0")), digest)


def _id_of(label: Column) -> Column:
    least = F.conv(F.hex(F.substring(label, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(least != NO_ID, least)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, text); rows have the same key if they have the same id and text."""
    row_id, text = F.col(f"`{id_col}`").cast("long"), text_or_empty(text_col)
    return docs.select(row_id.alias("id"), row_key(row_id, text).alias("key"), text.alias("text"))


def _blocks_of(n: Column, shingles: Column) -> Column:
    """Blocks for ``n`` nodes with so many shingles in all."""
    return F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))).cast("int")


def _compared(placed: DataFrame, by: list[str], sets: DataFrame, percent: int) -> DataFrame:
    joined = placed.join(sets, placed["rep"] == sets["key"]).select(*by, "label", "blocks", "shingles")
    return joined.groupBy(*by).applyInArrow(_verify(percent), "a binary, b binary, apart boolean")


def _verified(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the nodes of each gathering, enough to keep together what hangs together."""
    sizes = members.groupBy("centre").agg(_blocks_of(F.count("*"), F.sum("size")).alias("blocks"))
    dealt = members.join(sizes, "centre")
    own = F.pmod(F.xxhash64("label"), F.col("blocks")).cast("int")
    # the centre is a guest in every block
    blocks_of = F.when(F.col("label") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    checked = written(few_files(_compared(dealt.select("centre", "label", "rep", "blocks", F.explode(blocks_of).alias("x")), ["centre", "x"], sets, percent)), "checked")
    links = checked.where("not apart").select("a", "b")
    apart = checked.where("apart").select(F.col("b").alias("centre"), F.col("a").alias("label")).distinct().withColumn("apart", F.lit(True))
    if apart.isEmpty():
        return links
    # nodes that hang apart are held against each other, a pair of blocks once, and against the settled ones
    marked = dealt.where("blocks > 1").join(apart, ["centre", "label"], "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    of = lambda c, kept: F.when(F.col("apart") == kept, c)
    counts = marked.groupBy("centre").agg(
        _blocks_of(F.count(of(F.lit(1), True)), F.sum(of(F.col("size"), True))).alias("rests"), _blocks_of(F.count(of(F.lit(1), False)), F.sum(of(F.col("size"), False))).alias("settled")
    )
    both = marked.join(counts.where("rests > 0"), "centre").withColumn("own", F.pmod(F.xxhash64("label", F.lit(1)), F.when(F.col("apart"), F.col("rests")).otherwise(F.greatest("settled", F.lit(1)))).cast("int"))
    numbers = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    among = F.transform(numbers("rests"), lambda i: at("among", F.least("own", i), F.greatest("own", i)))
    against = F.transform(numbers("settled"), lambda i: at("against", F.col("own"), i))
    places = F.when(F.col("apart"), F.concat(among, against)).otherwise(F.transform(numbers("rests"), lambda i: at("against", i, F.col("own"))))
    placed = both.select("centre", "label", "rep", F.lit(1).alias("blocks"), F.explode(places).alias("place")).select("centre", "label", "rep", "blocks", "place.*")
    return links.unionByName(_compared(placed, ["centre", "kind", "x", "y"], sets, percent).select("a", "b"))


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The described rows (id, key, n_shingles, digest), and for each set (digest, label, rep, component): rep is the key of its first row, component the smallest label reachable."""
    rows_in = _keyed(docs, id_col, text_col)
    described = written(rows_in.mapInArrow(_describe(size, bands, rows), "id long, key binary, n_shingles long, digest binary, bands array<long>"), "described")
    first = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "key"))
    nodes = described.where("digest is not null").groupBy("digest").agg(first.alias("first"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    nodes = nodes.select("digest", _label(F.col("first.id"), F.col("digest")).alias("label"), F.col("first.key").alias("rep"), "size", "bands")
    banded = nodes.select("label", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("label").alias("centre"), F.count("*").alias("n")).where("n > 1").select("band", "centre")
    gathered = banded.join(buckets, "band").select("centre", "label").distinct()
    members = written(few_files(gathered.join(nodes.select("label", "rep", "size"), "label")), "members")
    # the hint keeps the plan the same at every size: the members grow with the input
    wanted = members.select(F.col("rep").alias("key")).distinct().hint("merge")
    texts = rows_in.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(_full_sets(size), "key binary, shingles array<long>"), "sets")
    found = connected_components(_verified(members, sets, percent))
    classes = nodes.select("digest", "label", "rep").join(found, F.col("label") == F.col("node"), "left")
    return described, classes.select("digest", "label", "rep", F.coalesce("component", "label").alias("component"))


def link_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles, component_id, kept).

    ``component_id`` is the smallest id reachable over links of at least ``percent``
    similarity between shingle sets; ``kept`` marks that row. A text that is null, empty
    or without words has an empty set, links with nothing and is kept. Rows with a null id
    take part: their component is the smallest id of their group, or null where it has none,
    and then they are kept. Texts under a repeated id are judged apart. Other columns are not
    read. An empty table gives an empty result.
    """
    described, classes = _classes(docs, id_col, text_col, size, percent, bands, rows)
    least = F.coalesce(_id_of(F.col("component")), F.when(F.col("component").isNull(), F.col("id")))
    joined = described.join(classes.select("digest", "component"), "digest", "left").select("id", "n_shingles", least.alias("least"))
    return joined.select(F.col("id").alias(id_col), "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("id") == F.col("least"), F.col("least").isNull()).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id, null ones last.

    Rows are told apart by id and text, so other texts under a repeated id and texts without
    an id are judged like all others; rows alike in both are one document, of which the
    smallest row stays. Texts without words stay. Columns keep their names and order.
    """
    described, classes = _classes(docs, id_col, text_col, size, percent, BANDS, ROWS)
    stays = classes.where("component = label").select("rep").unionByName(described.where("digest is null").select(F.col("key").alias("rep"))).distinct()
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, row_key(F.col(f"`{id_col}`").cast("long"), text_or_empty(text_col)))
    kept = keyed.join(stays.withColumnRenamed("rep", key).hint("merge"), key, "left_semi")
    row = kept.groupBy(key).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return row.select("row.*")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Query columns: doc_id, n_shingles, component_id, kept, over two-word shingles."""
    return link_near_duplicates(docs, size=2)
