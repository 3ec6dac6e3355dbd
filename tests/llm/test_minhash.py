"""Near-duplicates against all pairs, components against a union of sets."""

import random
import re

from noticelake.llm import minhash
from noticelake.llm.components import connected_components


def brute(rows, size):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        shingles = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets.setdefault(i, []).append(shingles)
    root = {i: i for i in sets if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in root:
        for b in root:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in root}, sets


def near_copies():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        for copy in range(rng.randrange(1, 12)):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 12))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((group * 100 + copy, " ".join(text)))
    return rows


def test_links_equal_all_pairs(documents):
    rows = [*near_copies(), (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "É é"), (906, "é é"), (907, "two words"), (907, "two words")]
    for size in (2, 5):
        want, sets = brute(rows, size)
        got = minhash.link_near_duplicates(documents(rows), size=size).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.component_id == want[r.doc_id]
            assert r.kept == (r.doc_id == want[r.doc_id])
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_a_group_of_many_blocks(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = near_copies()
    want, _ = brute(rows, 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(rows)).collect()} == want


def test_null_and_repeated_ids_are_judged_by_their_texts(documents):
    one, two = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(5, one), (5, two), (3, two + " y"), (None, one), (None, "alone in the world with words"), (None, None), (7, one), (7, one)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(documents(rows)).collect()), key=str)
    want = [(5, 5, True), (5, 3, False), (3, 3, True), (None, 5, False), (None, None, True), (None, None, True), (7, 5, False), (7, 5, False)]
    assert got == sorted(want, key=str)
    left = minhash.without_near_duplicates(documents(rows), size=2)
    assert left.columns == documents(rows).columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(5, one), (3, two + " y"), (None, "alone in the world with words"), (None, None)], key=str)


def test_what_hangs_apart_from_the_centre_is_held_against_all_blocks(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    # a chain: neighbours are similar, the ends are not; one band of one row brings all into few buckets
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 30])) for i in range(25)]
    want, _ = brute(rows, 2)
    got = minhash.link_near_duplicates(documents(rows), size=2, bands=60, rows=1).collect()
    assert {r.doc_id: r.component_id for r in got} == want and set(want.values()) == {0}


def test_empty_table(documents):
    assert minhash.without_near_duplicates(documents([])).collect() == []
    assert minhash.near_duplicates(documents([])).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (300, 200), (300, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[i] == 100 for i in range(100, 140)) and found[300] == found[200] == 200
