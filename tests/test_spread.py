"""Work that costs much a row is dealt over the cores, however few tasks read the table."""

import pytest
from pyspark.sql import functions as F


def tasks(rows):
    """How many tasks give the rows, and the plan."""
    return rows.select(F.spark_partition_id().alias("t")).distinct().count(), rows._jdf.queryExecution().optimizedPlan().toString()


def below_deal(plan):
    """What is worked out before rows are dealt out."""
    return plan[plan.index("Repartition ") :] if "Repartition " in plan else plan


def test_notices_are_parsed_by_several_tasks(spark):
    """Nothing of a text is read before rows are dealt out, the filter on triggers included."""
    from noticelake.plans import analysis

    none = F.lit(None).cast("string")
    full = F.format_string("A%04d/25 A) ZAQA B) 2509210130 C) 2509210430 E) ROCKET LAUNCH F) SFC G) UNL", "id")
    notices = spark.range(0, 400, 1, 1).select(F.col("id").alias("row_index"), none.alias("id"), full.alias("text"), *(none.alias(c) for c in ("fir", "valid_from", "valid_to", "qline")))
    rows = analysis.parsed(notices)
    n, plan = tasks(rows)
    assert n > 1 and rows.count() == 400
    assert "regexp" not in below_deal(plan).lower()


def test_pasted_texts_are_cut_by_several_tasks(spark):
    """Texts are cut after they are dealt out, and a choice among the notices works nothing out again."""
    from noticelake.sources import tables

    posts = spark.range(0, 400, 1, 1).select("id", F.format_string("Hello\nA%04d/25 NOTAMN B) 2509210130 E) ROCKET\nA0001/25 B) WIE E) NO TIME", "id").alias("post"))
    rows = tables.corpus_rows(tables.pasted_notices(posts, "id", "post"), "id")
    n, plan = tasks(rows)
    assert n > 1 and rows.count() == 400
    assert "regexp" not in below_deal(plan).lower()
    assert plan.count("aggregate(") == 1, "items are worked out once"


def test_pairs_of_launches_are_given_once(spark):
    """Against brute force, with unknown days and nations, repeated ids and nulls among them; no table of all pairs is kept."""
    import random
    from datetime import date, timedelta

    from noticelake.operators import joins

    rnd = random.Random(5)
    row = lambda i: (i, [rnd.choice([*"abcdef", "a", None]) for _ in range(rnd.randrange(5))], rnd.choice([None, *(date(2024, 1, 1) + timedelta(d) for d in range(6))]), rnd.choice([None, "X", "Y"]))
    sides = [[row(rnd.randrange(60)) for _ in range(90)] for _ in range(2)]
    sides = [s + s[:9] for s in sides]
    same = lambda a, b: set(a[1]) & set(b[1]) - {None} and (a[2] is None or b[2] is None or abs((a[2] - b[2]).days) <= 1) and (a[3] is None or b[3] is None or a[3] == b[3])
    truth = {(a[0], b[0]) for a in sides[0] for b in sides[1] if same(a, b)}
    pairs = joins.same_launch(*(spark.createDataFrame(s, "id long, ids array<string>, day date, nation string") for s in sides))
    found = [tuple(r) for r in pairs.collect()]
    assert len(found) == len(truth) > 500 and set(found) == truth
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [left_id" not in plan


@pytest.mark.parametrize("name", ["coord_compact_prefix", "coord_compact_suffix"])
def test_coordinates_are_read_by_several_tasks(spark, tmp_path, name):
    from noticelake import registry

    spark.range(0, 400, 1, 1).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    rows = registry.queries()[name](spark, str(tmp_path))
    n, plan = tasks(rows)
    assert n > 1 and rows.count() == 400
    assert "regexp" not in below_deal(plan).lower()


def test_pairs_of_points_and_sites_stay_in_their_task(spark):
    """Points alone are dealt out, by their group."""
    from noticelake.operators import joins

    points = spark.range(0, 400, 1, 1).select(F.floor(F.col("id") / 4).alias("g"), (F.col("id") % 50).cast("double").alias("lat"), F.lit(20.0).alias("lon"))
    sites = spark.createDataFrame([("A", 0.0, 20.0, 1), ("B", 1.0, 150.0, 2)], "code string, place_lat double, place_lon double, ord long")
    best = joins.common_site(points, "g", sites)
    assert best.count() == 100
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "hashpartitioning(g" in plan


def test_events_of_launches_are_built_by_several_tasks(spark, tmp_path):
    from noticelake.plans import launch_queries

    spark.range(0, 100, 1, 1).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    for events, rows in ((launch_queries._sea_events, 400), (launch_queries._events, 225)):
        found = events(spark, str(tmp_path))
        assert tasks(found)[0] > 1 and found.count() == rows
