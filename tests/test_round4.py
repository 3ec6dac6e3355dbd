"""Cases of round 4: dense runs of events, angles that nearly cancel out, dates beyond the year 9999, sets that meet rarely."""

import random

import pytest
from pyspark.sql import functions as F
from test_round3 import against_sql


def test_runs_without_a_gap_are_not_gathered(spark):
    """Against a plain fold; rows of equal time and id stay rows of their own, rows without a time or a part are left out."""
    from noticelake.operators import cluster

    rnd = random.Random(4)
    rows = [(p, rnd.randrange(200_000), i) for p, size in (("a", 20_000), ("b", 50), ("c", 1)) for i in range(size)]
    rows += [("a", 100, 0), ("a", 100, 0), ("b", 7, 1), ("b", 7, 1)]
    truth, last, first, n, of = [], 0, 0, 0, None
    for p, t, i in sorted(rows):
        if p != of:
            of, first, n = p, t, 1
        elif t - last > 1800 or t - first > 5400:
            first, n = t, n + 1
        last = t
        truth.append((p, t, i, n))
    frame = spark.createDataFrame([*rows, ("a", None, 1), (None, 5, 1)], "part string, t long, id long")
    found = cluster.gap_and_span(frame, "part", "t", "id", gap=1800, span=5400)
    assert sorted(tuple(r) for r in found.select("part", "t", "id", "cluster").collect()) == truth
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_angles_that_cancel_out_at_any_angle(spark, tmp_path):
    """All pairs of opposite angles that the query can meet; at 43.7 and 223.7 degrees the JVM's cosines differ from the C library's."""
    lineitem = "select p.range as l_orderkey, (p.range + t.range * 1800 * 973) as l_partkey from range(1800) p, range(2) t"
    rows, truth = against_sql(spark, tmp_path, "circular_mean", lineitem=lineitem)
    assert rows == truth and len(rows) == 1800


@pytest.mark.parametrize(
    "name",
    ["days_reevaluated", "import_candidates", "launch_report", "event_report", "day_review", "day_candidates", "past_rows_hidden", "launches_settled", "launches_past", "archive_from_launches", "sea_launches"],
)
def test_launches_beyond_the_year_9999(spark, tmp_path, name):
    """A launch every other day: of five million customers the last ones launch after the year 31000, which is no year in Python."""
    customer = "select (k + far * 5399900)::bigint as c_custkey, (k % 25)::int as c_nationkey from range(40) t(k), range(2) f(far)"
    nation = "select k::int as n_nationkey, 'NATION_' || k as n_name, 0 as n_regionkey from range(25) t(k)"
    rows, truth = against_sql(spark, tmp_path, name, customer=customer, nation=nation)
    assert rows == truth and len(rows) > 20


def test_sets_meet_on_three_ids_together(spark):
    """Against brute force, with sets of up to 40 ids, unknown days and nations and unknown ids."""
    from datetime import date, timedelta

    from noticelake.operators import joins

    rnd = random.Random(8)
    pick = lambda: rnd.sample([*range(6), None], rnd.randrange(7)) if rnd.random() < 0.9 else rnd.sample(range(45), rnd.choice([23, 24, 25, 40]))
    rows = [(i, pick(), rnd.choice([None, *(date(2024, 1, 1) + timedelta(d) for d in range(12))]), rnd.choice([None, "X", "Y"])) for i in range(250)]
    same = lambda a, b: (a[2] is None or b[2] is None or abs((a[2] - b[2]).days) <= 1) and (a[3] is None or b[3] is None or a[3] == b[3])
    for some in (rows, [r for r in rows if r[2] and len(r[1]) < 24]):
        truth = {a[0] for a in some if not any(set(a[1]) - {None} and set(a[1]) < set(b[1]) and same(a, b) for b in some)}
        kept = joins.without_subsumed(spark.createDataFrame(some, "id long, ids array<int>, day date, nation string"))
        assert {r.id for r in kept.collect()} == truth and len(truth) < len(some)
    # all share two ids on one day, and none is part of another
    day = date(2024, 1, 1)
    dense = spark.createDataFrame([(i, [0, 1, 10 + i, 5000 + i], day, "X") for i in range(300)], "id long, ids array<int>, day date, nation string")
    assert joins.without_subsumed(dense).count() == 300
    keys = lambda n: len(spark.range(1).select(F.sequence(F.lit(1), F.lit(n)).alias("s")).select(F.explode(joins._keys(F.col("s"), True)).alias("k")).collect())
    assert [keys(n) for n in (1, 2, 3, 4, 24, 25)] == [1, 2, 4, 8, 24 + 2024, 50]


def test_geometry_is_worked_out_once_a_notice(spark, tmp_path):
    """A notice's row for each of its days brings its points and the shapes of its zones along: days cost no centroid more."""
    from noticelake.plans import launch_queries, launches

    spark.range(0, 8, 1, 1).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 25, 1, 1).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(f"{tmp_path}/nation.parquet")
    plain = launch_queries._sea_events(spark, str(tmp_path))
    events, sites = launches.with_geometry(plain), launch_queries._sea_sites(spark, str(tmp_path))
    found, theirs = launches.grouped(events, sites), launches.grouped(plain, sites)
    advance = launches.advance_notices(events.drop("zones").withColumn("zones", F.array(F.array(F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))))), found)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(found.launches) == rows(theirs.launches)
    assert rows(advance) == rows(launches.advance_notices(plain, theirs)) != []
