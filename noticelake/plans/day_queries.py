"""Queries over the day-by-day import, on the launches of ``launch_queries``, whose truth is known from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticelake.functions import timeparse
from noticelake.operators import merge
from noticelake.operators.staging import written
from noticelake.plans import days, launch_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _events(spark, sf_dir):
    return written(launch_queries._sea_events(spark, sf_dir).withColumn("key", F.concat(F.lit("E"), F.col("row_index").cast("string"))))


def _bundles(events):
    return merge.day_bundles(events.select("row_index", "valid_from", "valid_to"), "valid_from", "valid_to").select("row_index", "day")


def _results(spark, sf_dir):
    events = _events(spark, sf_dir)
    return days.day_results(events, _bundles(events), launch_queries._sea_sites(spark, sf_dir), excluded="N3")


def day_candidates(spark, sf_dir):
    out, _, _ = _results(spark, sf_dir)
    return out.select("key", timeparse.stamped(F.col("day"), "yyyy-MM-dd").alias("day"), "nation", F.col("row.Weltraumbahnhof").alias("site"), F.array_join("ids", ",").alias("ids"))


def day_review(spark, sf_dir):
    _, review, counts = _results(spark, sf_dir)
    listed = review.groupBy("day").agg(F.count("*").alias("n"), F.min("row_index").alias("first"))
    both = listed.join(counts, "day", "full_outer")
    return both.select(timeparse.stamped(F.col("day"), "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), "first", F.coalesce("excluded", F.lit(0)).alias("excluded"))


def days_reevaluated(spark, sf_dir):
    """The days that are judged in a second run, before which the plain announcements came in."""
    events, sites = _events(spark, sf_dir), launch_queries._sea_sites(spark, sf_dir)
    bundles = written(_bundles(events))
    late = (F.col("row_index") % 10 == 3) & (F.floor(F.col("row_index") / 10) % 6 == 5)
    state, _ = days.reevaluate(events.where(~late), bundles.where(~late), sites)
    state, again = days.reevaluate(events, bundles, sites, state)
    per_day = state.candidates.groupBy("day").agg(F.count("*").alias("n"))
    return again.join(per_day, "day", "left").select(timeparse.stamped(F.col("day"), "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def import_candidates(spark, sf_dir):
    """Every third launch is decided, every third replaces a launch confirmed under another key, and every fifth stands in the archive."""
    events, sites = _events(spark, sf_dir), launch_queries._sea_sites(spark, sf_dir)
    state, _ = days.reevaluate(events, _bundles(events), sites)
    k = F.split("row.NOTAM", "-")[0].cast("long")
    each = written(state.candidates.select(k.alias("k"), "key", "day", "nation"))
    text = F.col("k").cast("string")
    member = lambda i: F.array(F.concat(text, F.lit(f"-{i}")))
    status = F.when(F.col("k") % 3 == 0, F.when(F.col("k") % 2 == 0, "discarded").otherwise("removed")).otherwise("confirmed")
    decisions = each.where(F.col("k") % 3 < 2).select(F.when(F.col("k") % 3 == 0, F.col("key")).otherwise(F.concat(F.lit("old|"), text)).alias("key"), status.alias("status"), member(0).alias("ids"), "day", "nation")
    archive = each.where(F.col("k") % 5 == 0).select(F.concat(F.lit("row|"), text).alias("key"), member(1).alias("ids"), "day", "nation")
    out = days.candidates(state, decisions, archive)
    return out.select("key", "decision", F.array_join("replaces", ",").alias("replaces"), F.array_join("in_archive", ",").alias("in_archive"))


_DAY = "(date '1970-01-01' + (k * 2)::integer)"
_KEY = "strftime({d}, '%d.%m.%Y') || '|' || k || '-0,' || k || '-1,' || k || '-2'".format(d=_DAY)
QUERIES |= {"day_candidates": day_candidates, "day_review": day_review, "days_reevaluated": days_reevaluated, "import_candidates": import_candidates}
ORACLES["day_candidates"] = f"""{launch_queries._SEA} select {_KEY} as key, strftime({_DAY}, '%Y-%m-%d') as day, nation, site,
k || '-0,' || k || '-1,' || k || '-2' || case when k % 6 in (3, 5) then ',' || k || '-3' else '' end as ids from l where n <> 3"""
# announcements begin before their launch's bundles do; other notices are reviewed where there is no launch
ORACLES["day_review"] = f"""{launch_queries._SEA}, r as (select k * 10 + 3 as i, {_DAY} - case when k % 6 = 1 then 1 else 2 end as day from c
union all select c.k * 10 + t.i, (date '1970-01-01' + (c.k * 2)::integer) from c, range(3) t(i) where c.k not in (select k from l)),
p as (select day, count(*) as n, min(i) as first from r group by day), x as (select {_DAY} as day, count(*) as excluded from l where n = 3 group by 1)
select strftime(coalesce(p.day, x.day), '%Y-%m-%d') as day, coalesce(n, 0) as n, first, coalesce(excluded, 0) as excluded from p full join x on p.day = x.day"""
ORACLES["days_reevaluated"] = f"""{launch_queries._SEA}, d as (select distinct {_DAY} + t.i::integer as day from c, range(-2, 2) t(i) where k % 6 = 5)
select strftime(d.day, '%Y-%m-%d') as day, count(l.k) as n from d left join (select *, {_DAY} as of_day from l) l on d.day = l.of_day group by d.day"""
ORACLES["import_candidates"] = f"""{launch_queries._SEA} select {_KEY} as key, case when k % 6 = 0 then 'discarded' end as decision, case when k % 3 = 1 then 'old|' || k else '' end as replaces,
case when k % 5 = 0 and k % 6 <> 0 then 'row|' || k else '' end as in_archive from l"""
