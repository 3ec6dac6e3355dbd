"""Versions of several tables, two writers, three-way differences, and the archive in its order."""

import threading

import pytest

from noticelake.operators import merge, store


@pytest.fixture
def box(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "store"))


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v string")


def of(frame):
    return sorted((r.k, r.v) for r in frame.collect())


def test_tables_of_one_version(spark, box):
    assert box.read() == store.Version(0, {})
    assert box.replace(0, {"a": rows(spark, ("1", "x")), "b": rows(spark, ("1", "y"))}) == 1
    first = box.read()
    assert box.replace(1, {"b": rows(spark, ("1", "z"))}) == 2
    assert (of(first.tables["a"]), of(first.tables["b"])) == ([("1", "x")], [("1", "y")])
    second = box.read()
    assert (second.number, of(second.tables["a"]), of(second.tables["b"])) == (2, [("1", "x")], [("1", "z")])
    assert of(box.read(1).tables["b"]) == [("1", "y")]
    with pytest.raises(store.Conflict):
        box.replace(1, {"a": rows(spark, ("1", "late"))})
    assert box.read().number == 2


def test_of_many_writers_one_wins_each_version(spark, box):
    box.replace(0, {"a": rows(spark, ("0", "start"))})
    won, lost = [], []

    def write(i):
        try:
            box._publish(2, {"a": f"writer-{i}"})
            won.append(i)
        except store.Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 11 and box._manifest(2) == {"a": f"writer-{won[0]}"}


def test_an_update_is_made_again_from_the_newest(spark, box):
    box.replace(0, {"a": rows(spark, ("1", "x"))})
    seen = []

    def change(version):
        if not seen:  # another writer comes first
            box.replace(version.number, {"a": version.tables["a"].unionByName(rows(spark, ("2", "other")))})
        seen.append(version.number)
        return {"a": version.tables["a"].unionByName(rows(spark, ("3", "own")))}

    assert box.update(change) == 3 and seen == [1, 2]
    assert of(box.read().tables["a"]) == [("1", "x"), ("2", "other"), ("3", "own")]


def test_differences_of_a_workspace(spark, box):
    start = rows(spark, ("kept", "1"), ("mine", "1"), ("theirs", "1"), ("gone", "1"), ("both", "1"))
    box.replace(0, {"w": start})
    seen = box.read()
    box.replace(1, {"w": rows(spark, ("kept", "1"), ("mine", "1"), ("theirs", "2"), ("gone", "1"), ("both", "same"), ("new", "n"))})
    mine = rows(spark, ("kept", "1"), ("mine", "2"), ("theirs", "1"), ("both", "same"), ("added", "a"))
    assert store.write_differences(box, seen, {"w": mine}, {"w": ["k"]}) == 3
    assert of(box.read().tables["w"]) == sorted([("kept", "1"), ("mine", "2"), ("theirs", "2"), ("both", "same"), ("new", "n"), ("added", "a")])
    for clash in (rows(spark, ("kept", "1"), ("mine", "1"), ("theirs", "3"), ("gone", "1"), ("both", "1")), start.where("k <> 'theirs'"), start.union(rows(spark, ("new", "other")))):
        with pytest.raises(store.Conflict):
            store.write_differences(box, seen, {"w": clash}, {"w": ["k"]})
    assert box.read().number == 3
    assert of(store.three_way(start.limit(0), start, start.limit(0), ["k"])[0]) == of(start)


def test_archive_in_its_order_and_twice_the_same(spark, box):
    schema = "key string, NOTAM string, Payload string, `Trägersystem` string, position long"
    old = spark.createDataFrame([("k2", "first", "sat", "CZ", 0), ("k1", "one", "", "", 1), ("k2", "double", "", "", 2)], schema)
    marks = spark.createDataFrame([("k1", "NOTAM")], "key string, column string")
    box.replace(0, {"archive": old, "marks": marks})
    new = spark.createDataFrame([("k9", "nine", "", "", 0), ("k1", "changed", "probe", "", 1), ("k2", "second", "", "", 2), ("k9", "nine again", "", "", 3), ("k0", "zero", "", "", 4), ("bad", "x", "", "", 5)], schema)
    removed = spark.createDataFrame([("bad",)], "key string")
    assert store.update_archive(box, new, removed=removed) == 2
    got = [tuple(r)[:4] for r in box.read().tables["archive"].orderBy("position").collect()]
    assert got == [("k2", "second", "sat", "CZ"), ("k1", "one", "probe", ""), ("k9", "nine again", "", ""), ("k0", "zero", "", "")]
    assert store.update_archive(box, new, removed=removed) == 2
    assert merge.content_version(box.read().tables["marks"]) == merge.content_version(marks)


def test_export_of_one_version(spark, box, tmp_path):
    box.replace(0, {"a": rows(spark, ("1", "ä")), "b": rows(spark)})
    assert box.export(str(tmp_path / "out")).number == 1
    assert of(spark.read.option("header", True).csv(str(tmp_path / "out/a"))) == [("1", "ä")]
