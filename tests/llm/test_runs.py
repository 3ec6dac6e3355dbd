"""Periodic runs against a search of every stretch, and against every period of whole texts."""

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from noticelake.llm import periodic_runs


def by_period(words, least=24, power=3):
    """Maximal stretches of each period from the comparison of the text with itself; the smallest period of a stretch counts."""
    best = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            best.setdefault((i, end + q), q)
            i = end
    return sorted(((s, e - s, q) for (s, e), q in best.items() if e - s >= max(least, power * q)), key=lambda r: (r[0], r[2]))


def by_stretch(words, least, power):
    found = []
    for s in range(len(words)):
        for e in range(s + least, len(words) + 1):
            part = words[s:e]
            q = next(q for q in range(1, len(part) + 1) if part[q:] == part[:-q] or q == len(part))
            if len(part) < power * q:
                continue
            if (s and words[s - 1] == words[s - 1 + q]) or (e < len(words) and words[e] == words[e - q]):
                continue
            found.append((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 2), max_size=26), st.integers(2, 6), st.integers(2, 3))
@settings(max_examples=150, deadline=None)
def test_runs_equal_all_stretches(words, least, power):
    least = max(least, power)
    assert periodic_runs.runs(np.array(words, np.int64), least, power) == by_stretch(words, least, power)


@given(st.integers(0, 10**9))
@settings(max_examples=60, deadline=None)
def test_runs_of_long_texts_equal_all_periods(seed):
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randrange(1, 8)):
        base = [rng.randrange(rng.choice((2, 5, 1000))) for _ in range(rng.randrange(1, 60))]
        words += (base * rng.randrange(1, 8))[: rng.randrange(1, 300)]
    assert periodic_runs.runs(np.array(words, np.int64)) == by_period(words)


def test_the_overlap_is_the_shortest_of_all_periods():
    assert periodic_runs.shortest_overlap() == 16
    assert periodic_runs.segments(np.arange(10_000)) == []


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = by_period(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in found)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha256(listed.encode()).hexdigest(), sha256(left.encode()).hexdigest())


def test_query_equals_brute_force(documents):
    rng = random.Random(3)
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "x y " * 30), (4, "x y " * 30), (5, "a " * 23), (6, "a " * 24), (7, "é " * 500 + "b " * 30)]
    for i in range(10, 90):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 400))]
        rows.append((i, " ".join(words + words[-9:] * rng.randrange(5))))
    got = periodic_runs.run_digests(documents(rows)).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *(brute(i, t) if i is not None else brute("no", t))) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r.n_runs for r in got) > 20
    assert periodic_runs.run_digests(documents([])).collect() == []


def test_a_very_long_text_and_the_text_that_is_left(documents):
    line = " ".join(f"w{i}" for i in range(997))
    text = " ".join(["start", *[line] * 60, "end"])
    [r] = periodic_runs.find_runs(documents([(1, text)])).collect()
    assert (r.n_runs, r.start, r.length, r.period) == (1, 1, 60 * 997, 997)
    assert r.collapsed == f"start {line} end"
