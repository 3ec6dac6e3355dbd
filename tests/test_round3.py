"""Tables made for a query against its SQL: what the smallest tables do not hold."""

import duckdb
import pytest

from noticelake import registry


def against_sql(spark, folder, name, **tables):
    """The query's rows and its SQL's over tables that are given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    frame = registry.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in frame.columns)
    return sorted(map(tuple, frame.collect()), key=repr), sorted(con.sql(f"select {columns} from ({registry.oracle_sql()[name]})").fetchall(), key=repr)


def test_windows_keep_fractions_of_a_second(spark, tmp_path):
    """The window of an hour and its slack end half a second after the whole one, the purchase a quarter before that."""
    events = """select * from (values (6, timestamp '2024-01-01 00:00:00.5', 1, 'error'), (7, timestamp '2024-01-01 01:30:00.25', 1, 'purchase'), (8, timestamp '2024-01-01 01:30:00.75', 1, 'purchase'))
t(event_id, ts, user_id, event_type)"""
    rows, truth = against_sql(spark, tmp_path, "catalogue_interval_match", events=events.replace("(6,", "(12,"))
    assert rows == truth == [(12, 7)]


def test_angles_that_cancel_out(spark, tmp_path):
    lineitem = "select p.range as l_orderkey, (p.range + t.range * 1800 * 973) as l_partkey from range(400) p, range(2) t"
    rows, truth = against_sql(spark, tmp_path, "circular_mean", lineitem=lineitem)
    assert rows == truth and {mean for _, mean in rows} == {0.0, 180.0}


@pytest.mark.parametrize("name", ["time_cluster", "stream_session_cap"])
def test_clusters_round_to_the_nearest_second(spark, tmp_path, name):
    """1800.7 seconds apart round to 1801, 1801.4 to 1800 where the first one is rounded up."""
    events = """select * from (values (1, timestamp '2024-01-01 00:00:00.1', 1), (2, timestamp '2024-01-01 00:30:00.8', 1), (3, timestamp '2024-01-01 00:00:00.6', 2), (4, timestamp '2024-01-01 00:30:01.4', 2),
(5, timestamp '2024-01-01 00:00:00.5', 3), (6, timestamp '2024-01-01 00:30:01.5', 3)) t(event_id, ts, user_id)"""
    rows, truth = against_sql(spark, tmp_path, name, events=f"select event_id::bigint as event_id, ts, user_id::bigint as user_id from ({events})")
    assert sorted(map(repr, rows)) == sorted(map(repr, truth))


def test_equal_sets_meet_on_their_days_alone(spark):
    """Against brute force, with unknown days and nations; the join takes the day as a key and rows that are equal once."""
    import random
    from datetime import date, timedelta

    from noticelake.operators import joins

    rnd = random.Random(3)
    rows = [(i, rnd.sample("abcdef", rnd.randrange(4)), rnd.choice([None, *(date(2024, 1, 1) + timedelta(d) for d in range(9))]), rnd.choice([None, "X", "Y"])) for i in range(150)]
    rows += [(1000 + i, ids, day, nation) for i, ids, day, nation in rows[:40]]
    same = lambda a, b: (a[2] is None or b[2] is None or abs((a[2] - b[2]).days) <= 1) and (a[3] is None or b[3] is None or a[3] == b[3])
    truth = {a[0] for a in rows if not any(a[1] and set(a[1]) < set(b[1]) and same(a, b) for b in rows)}
    kept = joins.without_subsumed(spark.createDataFrame(rows, "id long, ids array<string>, day date, nation string"))
    assert {r.id for r in kept.collect()} == truth and len(truth) < len(rows)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "near#" in plan


def test_staged_tables_are_not_broadcast(spark):
    """Their files are far smaller than their rows, so their size says nothing about what a broadcast takes."""
    from pyspark.sql import functions as F

    from noticelake.operators.staging import written

    table = written(spark.range(1000).withColumn("x", F.lit("the same text in all rows")))
    plan = table.join(spark.range(1000).groupBy("id").count(), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("name", ["nearest_with_cap", "nearest_with_direction"])
def test_the_nearest_place_needs_no_sort(spark, name):
    """Pairs of rows and places are neither sorted nor dealt out."""
    from noticelake.operators import joins

    rows = spark.createDataFrame([(i, 10.0 + i, 20.0) for i in range(1, 6)], "id long, lat double, lon double")
    places = spark.createDataFrame([("A", 12.0, 20.0, 2), ("B", 12.0, 20.0, 1), ("C", 15.0, 20.0, 3)], "code string, place_lat double, place_lon double, ord long")
    found = joins.nearest_within(rows, "id", places, 200.0) if name == "nearest_with_cap" else joins.nearest_by_direction(rows, "id", places)
    got = {r.id: r.code for r in found.collect()}
    assert got == ({1: "B", 2: "B", 3: "B", 4: "C", 5: "C"} if name == "nearest_with_cap" else got) and len(got) == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning" not in plan
