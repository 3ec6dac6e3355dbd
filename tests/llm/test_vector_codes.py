"""Vector codes against the comparison of every part with every entry."""

import math
import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticelake.llm import vector_codes


@given(st.integers(0, 10**9), st.sampled_from((2, 5, 300)), st.integers(1, 90), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_the_tree_finds_the_nearest_entry_and_the_lower_of_equals(seed, size, entries, width):
    rng = np.random.default_rng(seed)
    book, parts = rng.integers(-size, size + 1, (entries, width)), rng.integers(-size, size + 1, (200, width))
    at, squares = vector_codes.nearest(vector_codes.ball_tree(book), book, parts)
    every = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (at == every.argmin(1)).all() and (squares == every.min(1)).all()


def test_large_components_are_compared_exactly():
    far = vector_codes.LARGEST
    book = np.array([[far, far - 1], [far - 1, far], *([i, -far] for i in range(30))])
    parts = np.array([[-far, -far], [far, far], [far - 1, far - 1]])
    at, squares = vector_codes.nearest(vector_codes.ball_tree(book), book, parts)
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in book] for p in parts]
    assert at.tolist() == [e.index(min(e)) for e in every] and squares.tolist() == [min(e) for e in every]


def brute(rows, n=16, entries=64):
    kept = sorted(((i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // n
    parts = [[v[p * w : (p + 1) * w] for p in range(n)] for _, v, _ in kept]
    books = [[parts[e][p] for e in range(min(entries, len(kept)))] for p in range(n)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(n):
            groups = {}
            for x in parts:
                groups.setdefault(near(x[p], books[p])[1], []).append(x[p])
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[near(x[p], books[p]) for p in range(n)] for x in parts]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors, strict=True)]


def vectors(n, seed=1, length=32):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(length)], rng.choice((0, 1, None))) for i in range(n)]
    return rows + [(i, rows[3][1], 0) for i in range(n, n + 9)] + rows[:2]


SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, n long, salt int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


ODD = [(None, [0.5] * 32, 1), (-5, None, 0), (-6, [None] + [0.1] * 31, 0), (-7, [float("nan")] * 32, 0), (-8, [float("inf")] + [0.0] * 31, 1), (-9, [], 1)]


@pytest.mark.parametrize("rows", [vectors(150) + ODD, vectors(5), [(1, [0.25] * 16, None)] * 3, ODD[1:], []])
def test_query_equals_brute_force(spark, rows):
    got = vector_codes.vector_codes(frame(spark, rows))
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_sql_equals_brute_force(spark, tmp_path):
    rows = vectors(90) + ODD[1:]
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.sql(vector_codes.oracle_sql()).fetchall(), key=str) == sorted(brute(rows), key=str)


def test_components_too_large_for_exact_sums_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(frame(spark, [(1, [1e9] * 16, 0)])).collect()
