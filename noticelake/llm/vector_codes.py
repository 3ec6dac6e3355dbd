"""Codes of vectors by parts: a codebook for each part position, searched by a ball tree.

A vector becomes integers, is cut into equal parts, and each part is coded as the nearest
entry of its position's codebook. A codebook starts as the parts of the vectors with the
smallest ids and moves to its parts' means for some rounds; a round is one pass over the
vectors, whose tasks each send sums of a bounded size. The codebooks are small by
construction (entries x vector length) and travel with the tasks.

The tree over a codebook's entries is built anew each round. A ball has an entry as its
centre and a radius rounded up; the distance of a part to a centre is rounded down. So a
ball that is left out has no entry as near as the best so far, not even one equally near:
balls that may tie are visited, and among equals the lower index wins. Distances of entries
are compared as integers. A batch of parts goes down the tree together, each part to its
nearer ball first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticelake.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries in a leaf of a tree, at most.
LEAF = 8
#: Pieces that the rows of one label are dealt into.
SALTS = 64
#: Integer components up to this size have exact sums of squares.
LARGEST = 2**27


def _distances(parts: np.ndarray, entry: np.ndarray) -> np.ndarray:
    gap = parts - entry
    return np.einsum("ij,ij->i", gap, gap)


def _rounded_up_root(square: int) -> int:
    root = int(np.sqrt(float(square)))
    while root * root < square:
        root += 1
    return root


def _rounded_down_roots(squares: np.ndarray) -> np.ndarray:
    roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return np.maximum(roots - (roots * roots > squares) - 1, 0)


@dataclass
class Ball:
    """Entries (by index) within ``radius`` of ``centre``; two balls inside, or none in a leaf."""

    centre: np.ndarray
    radius: int
    entries: list[int]
    inside: tuple[Ball, Ball] | None = None


def ball_tree(book: np.ndarray, entries: list[int] | None = None) -> Ball:
    """Balls halved along the line between two entries that lie far apart; equal entries stay together in leaves of any size."""
    entries = list(range(len(book))) if entries is None else entries
    middle = book[entries].mean(0)
    centre = book[min(entries, key=lambda e: (float(((book[e] - middle) ** 2).sum()), e))]
    squares = _distances(book[entries], centre)
    ball = Ball(centre, _rounded_up_root(int(squares.max())), entries)
    if len(entries) > LEAF and ball.radius:
        first = entries[int(squares.argmax())]
        other = entries[int(_distances(book[entries], book[first]).argmax())]
        lean = _distances(book[entries], book[first]) - _distances(book[entries], book[other])
        order = np.argsort(lean, kind="stable")
        half = len(entries) // 2
        ball.inside = (ball_tree(book, [entries[i] for i in order[:half]]), ball_tree(book, [entries[i] for i in order[half:]]))
    return ball


def nearest(tree: Ball, book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry; the lower index among equals."""
    best, at = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)

    def visit(ball: Ball, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if ball.inside is None:
            for e in ball.entries:
                d = _distances(parts[rows], book[e])
                won = (d < best[rows]) | ((d == best[rows]) & (e < at[rows]))
                best[rows[won]], at[rows[won]] = d[won], e
            return
        # a part's distance to anything in a ball is this at least
        gaps = [_rounded_down_roots(_distances(parts[rows], b.centre)) - b.radius for b in ball.inside]
        left = gaps[0] <= gaps[1]
        for b, gap, first in ((0, gaps[0], left), (1, gaps[1], ~left)):
            visit(ball.inside[b], rows[first & _may_hold(gap, best[rows])])
        for b, gap, first in ((0, gaps[0], left), (1, gaps[1], ~left)):
            visit(ball.inside[b], rows[~first & _may_hold(gap, best[rows])])

    visit(tree, np.arange(len(parts)))
    return at, best


def _may_hold(gap: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Not strict: what is only as near as the best is visited."""
    return (gap <= 0) | (gap * gap <= best)


class Codebooks:
    """``books[p][e]``: the integers of entry e for part position p, with a tree over each."""

    def __init__(self, books: np.ndarray):
        self.books, self._trees = books, None

    def __getstate__(self):
        return self.books

    def __setstate__(self, books):
        self.books, self._trees = books, None

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each vector and part."""
        if self._trees is None:
            self._trees = [ball_tree(b) for b in self.books]
        n, width = len(self.books), self.books.shape[2]
        found = [nearest(t, b, np.ascontiguousarray(vectors[:, p * width : (p + 1) * width])) for p, (t, b) in enumerate(zip(self._trees, self.books, strict=True))]
        return np.stack([f[0] for f in found], 1).reshape(-1, n), np.stack([f[1] for f in found], 1).reshape(-1, n)

    def digest(self) -> str:
        return sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def moved(self, sums: DataFrame) -> Codebooks:
        """Entries at the means, rounded down, of the parts that ``sums`` has for them; the others stay."""
        books = self.books.copy()
        for r in sums.collect():  # one row for each part position and entry at most
            books[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        return Codebooks(books)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            yield part, np.asarray(part.column("v").flatten()).reshape(part.num_rows, -1)


def _sums(books: Codebooks):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, entries, width = books.books.shape
        total, count = np.zeros((n * entries, width), np.int64), np.zeros(n * entries, np.int64)
        for _, vectors in _blocks(batches):
            place = books.assign(vectors)[0] + np.arange(n) * entries
            np.add.at(total, place.ravel(), vectors.reshape(-1, width))
            count += np.bincount(place.ravel(), minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(list(total[used]), pa.list_(pa.int64())), pa.array(count[used], pa.int64())], ["part", "entry", "sums", "n"]
        )

    return sums


def _codes(books: Codebooks):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in _blocks(batches):
            index, squares = books.assign(vectors)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array([r.tobytes() for r in index.astype(np.uint8)], pa.binary()), pa.array(squares.sum(1), pa.int64())], ["id", "label", "code", "error"]
            )

    return codes


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or has a component that is null or not finite."""
    x = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda c: F.floor(x(c) * scale)))


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """(id, label, v): the rows whose vector can be coded. Components beyond ``LARGEST`` raise an error, as their squares would not be exact."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), integers(F.col(f"`{vector_col}`")).alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.size("v") % parts == 0)
    huge = F.exists("v", lambda c: F.abs(c) > LARGEST)
    return rows.withColumn("v", F.when(huge, F.raise_error(F.lit("a component is too large to be coded exactly"))).otherwise(F.col("v")))


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from (id, label, v) rows; None without rows. One row for each entry, and one for each part and entry a round, come to the driver."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return None
    first = [r["v"] for r in first if len(r["v"]) == len(first[0]["v"])]
    books = Codebooks(np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy())
    rows = kept.where(F.size("v") == len(first[0])).select("v")
    for _ in range(rounds):
        found, width = rows.mapInArrow(_sums(books), "part int, entry int, sums array<long>, n long"), books.books.shape[2]
        # decimals, as the sum of many large components may not fit a long
        sums = F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")).cast("decimal(38,0)") for i in range(width)))
        books = books.moved(found.groupBy("part", "entry").agg(sums.alias("sums"), F.sum("n").alias("n")))
    return books


def compress_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks | None]:
    """(id_col, label_col, code binary, error) for each vector that can be coded, and the codebooks.

    ``code`` has one byte for each part, the index of its entry; ``error`` is the sum of the
    parts' squared distances to their entries, in squared units of 1 / 256. At most 256
    entries. Vectors that are null, empty, or hold null or non-finite components are left
    out, and so are those whose length is not a multiple of ``parts`` or not that of the
    vector with the smallest id. Repeated ids and vectors keep their rows; a null id comes
    last in the choice of the first entries, equal ids by their vectors. With fewer vectors
    than ``entries`` there are fewer entries. Other columns are not read. An empty table
    gives an empty result and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index must fit in a byte")
    kept = kept_vectors(vectors, id_col, vector_col, label_col, parts)
    books = train(kept, parts, entries, rounds)
    kinds = T.StructType([T.StructField("id", kept.schema["id"].dataType), T.StructField("label", kept.schema["label"].dataType), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if books is None:
        coded = vectors.sparkSession.createDataFrame([], kinds)
    else:
        coded = kept.where(F.size("v") == books.books.shape[0] * books.books.shape[2]).mapInArrow(_codes(books), kinds)
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Query columns: vec_id, code, error, label_error, codebooks_sha256.

    The errors of a label are added up in its tasks first; the sums, one row for each
    label, meet the rows of a label in many pieces.
    """
    coded, books = compress_vectors(vectors)
    coded = written(coded, "codes")
    hexed = F.lower(F.hex("code"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    rows = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    both = rows.join(sums, rows["label"].eqNullSafe(sums["of"]) & (F.col("salt") == F.col("s")))
    return both.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL for ``vector_codes``: every part against every entry, in each round."""
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS rn
    FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS (SELECT rn, vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) AS t(p))",
        "places AS (SELECT rn, p, i, x[i] AS c FROM (SELECT rn, p, x, unnest(range(1, len(x) + 1)) AS i FROM parts))",
        "book0 AS (SELECT p, rn - 1 AS e, x FROM parts WHERE rn <= 64)",
    ]
    near = """near{k} AS (SELECT q.rn, q.p, min(list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.e) AS best
    FROM parts q JOIN book{k} b ON q.p = b.p GROUP BY ALL)"""
    move = """sums{k} AS (SELECT n.p, n.best % 64 AS e, c.i, sum(c.c)::BIGINT AS s, count(*) AS n FROM near{k} n JOIN places c ON n.rn = c.rn AND n.p = c.p GROUP BY ALL),
means{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM sums{k} GROUP BY ALL),
book{next} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)"""
    for k in range(ROUNDS):
        steps += [near.format(k=k), move.format(k=k, next=k + 1)]
    steps += [
        near.format(k=ROUNDS),
        f"coded AS (SELECT rn, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM near{ROUNDS} GROUP BY rn)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})",
    ]
    return f"""WITH {", ".join(steps)}
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, d.codebooks_sha256 FROM coded c JOIN kept k ON c.rn = k.rn CROSS JOIN digest d"""
