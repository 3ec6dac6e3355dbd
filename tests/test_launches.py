"""Time clusters and tracks of launches against a plain fold and cases written by hand."""

import datetime as dt
import random

import pytest

from noticelake.plans import launches

BASE = dt.datetime(2026, 7, 22)


def folded(rows):
    """Cluster of each row by the rules read one after the other, without cuts and ranges."""
    found, first, last = {}, None, None
    for row, start, end, nations in sorted(rows, key=lambda r: (r[1] is None, r[1] or BASE, r[0])):
        fits = first is not None and start is not None and last is not None and set(nations) & set(first[3])
        if fits:
            length = lambda a, b: max((b - a).total_seconds(), 0) if b else 0
            one, two = length(first[1], first[2]), length(start, end)
            if one < 43200 and two < 43200:
                fits = (start - last).total_seconds() <= 1800 and (start - first[1]).total_seconds() <= 5400
            else:
                shared = (min(first[2], end) - max(first[1], start)).total_seconds() if first[2] and end else 0
                fits = shared > 0 and shared / max(one, two) >= 0.8
        if not fits:
            first = (row, start, end, nations)
        found[row], last = first[0], start
    return found


@pytest.mark.parametrize("density", [5, 40, 600])
def test_time_clusters(spark, density):
    pick = random.Random(density)
    rows = []
    for row in range(400):
        start = BASE + dt.timedelta(minutes=pick.randrange(density * 40)) if pick.random() > 0.03 else None
        hours = pick.choice([1, 2, 9, 11, 12, 13, 24, 200])
        end = start + dt.timedelta(hours=hours) if start and pick.random() > 0.05 else None
        rows.append((row, start, end, pick.sample(["A", "B", "C"], pick.choice([1, 1, 2, 3]))))
    frame = spark.createDataFrame(rows, "row_index long, valid_from timestamp, valid_to timestamp, nations array<string>")
    assert {r.row_index: r.cluster for r in launches.time_clusters(frame.repartition(7)).collect()} == folded(rows)
    assert launches.time_clusters(frame.limit(0)).collect() == []


def test_time_clusters_of_each_day(spark):
    pick = random.Random(8)
    rows = []
    for row in range(300):
        start = BASE + dt.timedelta(minutes=pick.randrange(5000)) if pick.random() > 0.03 else None
        rows.append((row, start, start + dt.timedelta(hours=pick.choice([1, 2, 13])) if start else None, pick.sample(["A", "B"], pick.choice([1, 2])), BASE.date() + dt.timedelta(days=pick.randrange(4))))
    frame = spark.createDataFrame(rows, "row_index long, valid_from timestamp, valid_to timestamp, nations array<string>, day date")
    want = {}
    for day in {r[4] for r in rows}:
        want |= folded([r[:4] for r in rows if r[4] == day])
    assert {r.row_index: r.cluster for r in launches.time_clusters(frame.repartition(5), by="day").collect()} == want


def test_tracks(spark):
    """Two zones on one track stay together, one across goes; sites of other nations do not count."""
    rows = [(1, 1, BASE, 5.0, 0.0, ["A"]), (2, 1, BASE, 10.0, 0.1, ["A", "B"]), (3, 1, BASE, 0.0, 20.0, ["A"]), (4, 4, BASE, 1.0, 1.0, ["A"])]
    rows = [(*r, [(r[3], r[4])], None, None, None) for r in rows]
    clustered = spark.createDataFrame(rows, "row_index long, cluster long, valid_from timestamp, lat double, lon double, nations array<string>, points array<struct<lat double, lon double>>, radius_km double, fir_country string, nation string")
    sites = spark.createDataFrame([("S1", 0.0, 0.0, 1, "A"), ("S2", 4.0, 0.0, 2, "B")], "code string, place_lat double, place_lon double, ord long, nation string")
    found = {r.row_index: (r.part, r.code) for r in launches.tracks(clustered, sites).collect()}
    assert found == {1: (0, "S1"), 2: (0, "S1"), 3: (1, None), 4: (0, None)}
