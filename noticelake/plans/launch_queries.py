"""Queries over launches that are built from the test tables, with SQL that knows the truth from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticelake.operators.staging import spread, written
from noticelake.plans import launches
from noticelake.plans.scalar_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_NORTH = "degrees(atan2(sin(radians(dx)) * cos(radians(10.0)), sin(radians(10.0))))"
_KM = "2 * 6371.0088 * asin(sqrt(pow(sin(radians({y} / 2)), 2) + cos(radians({y})) * pow(sin(radians({x} / 2)), 2)))"


def _events(spark, sf_dir):
    """For each customer two zones north of the site of its nation, for some a third one in the east.

    The second is published ten minutes after the first; 45 minutes for every fifth customer,
    where it is a launch of its own; an hour for every seventh, where both run for twenty
    hours. Every eleventh customer's notices all wait for a group and give no launch, and
    those of every thirteenth are only together sure of their nation.
    """
    k = F.col("c_custkey")
    i = F.col("i")
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).withColumn("i", F.explode(F.when(k % 4 == 0, F.array(*map(F.lit, (0, 1, 2)))).otherwise(F.array(F.lit(0), F.lit(1)))))
    long = k % 7 == 3
    step = F.when(long, 60).when(k % 5 == 0, 45).otherwise(10)
    start = F.timestamp_seconds(k * 86400 * 2 + i * step * 60)
    open_ = (k % 11 == 0) | ((k % 13 == 0) & (i == 1))
    home = (F.col("c_nationkey") * 10 - 120).cast("double")
    y = F.when(i == 0, 5.0).when(i == 1, 10.0).otherwise(0.0)
    x = home + F.when(i == 0, 0.0).when(i == 1, (k % 3) * 0.1).otherwise(20.0)
    nation = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    none = F.lit(None)
    return rows.select(
        (k * 10 + i).cast("long").alias("row_index"), F.concat_ws("-", k, i).alias("id"), F.lit("Launch").alias("kind"), F.lit("HIGH").alias("level"),
        start.alias("valid_from"), (start + F.when(long, F.expr("interval 20 hours")).otherwise(F.expr("interval 2 hours"))).alias("valid_to"),
        y.alias("lat"), x.alias("lon"), F.lit("F").alias("fir"), nation.alias("nation"), F.array(nation).alias("nations"), F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("site"),
        F.lit(100.0).alias("distance_km"), F.lit(7.0).alias("azimuth"), F.lit(50.0).alias("inclination"), F.lit("LEO/MEO").alias("orbit"), F.lit("high").alias("reliability"),
        F.when(open_, 9).otherwise(17).alias("branch"), F.when(open_, "REVIEW").otherwise("OK").alias("status"), open_.alias("requires_group"), F.lit(False).alias("override"),
        F.array(F.array(F.struct(y.alias("lat"), x.alias("lon")))).alias("zones"), F.lit(None).cast("double").alias("radius_km"), F.lit(None).cast("string").alias("fir_country"), F.lit("").alias("daily"),
    )


def _sites(spark, sf_dir):
    n = F.col("n_nationkey")
    of = lambda letter: F.concat(F.lit(letter), n.cast("string"))
    return table(spark, sf_dir, "nation").select(of("S").alias("code"), F.lit(0.0).alias("place_lat"), (n * 10 - 120).cast("double").alias("place_lon"), n.cast("long").alias("ord"), of("N").alias("nation"))


def launches_grouped(spark, sf_dir):
    out = launches.launches(_events(spark, sf_dir), _sites(spark, sf_dir))
    return out.select("label", "n", "site", "nation", F.array_join("ids", ",").alias("ids"), F.round("spread", 4).alias("spread"), F.round("max_range_km", 3).alias("max_range_km"), F.unix_seconds("window_from").alias("window_from"), F.unix_seconds("window_to").alias("window_to"))


QUERIES["launches_grouped"] = launches_grouped
ORACLES["launches_grouped"] = f"""with c as (select c_custkey as k, 'S' || c_nationkey as site, 'N' || c_nationkey as nation, (c_custkey % 3) * 0.1 as dx, c_custkey % 7 = 3 as long,
case when c_custkey % 7 = 3 then 3600 when c_custkey % 5 = 0 then 2700 else 600 end as step, c_custkey * 172800 as t, c_custkey % 4 = 0 as third from customer),
p as (select *, case when long then 72000 else 7200 end as run, step = 2700 as apart, k % 13 = 0 as half from c where k % 11 <> 0),
g as (select k, 0 as part, 2 as n, k || '-0,' || k || '-1' as ids, {_NORTH} as spread, {_KM.format(y="10.0", x="dx")} as km, t as f, t + step + run as u, site, nation from p where not apart
union all select k, 0, 1, k || '-0', 0, 100, t, t + run, site, nation from p where apart
union all select k, 1, 1, k || '-1', 0, 100, t + step, t + step + run, site, nation from p where apart and not half
union all select k, 2, 1, k || '-2', 0, 100, t + 2 * step, t + 2 * step + run, site, nation from p where third)
select 'START-' || case when r < 10 then '0' else '' end || r as label, n, site, nation, ids, round(spread, 4) as spread, round(km, 3) as max_range_km, f as window_from, u as window_to from (select *, row_number() over (order by k, part) as r from g)"""


#: Geometry of a start at sea: the platform at the equator, two drop zones south of it, the second a little to the east.
_Z1, _Z2, _DX = -5.0, -5.6, 0.6


def _sea_events(spark, sf_dir):
    """For each customer a platform's circle, two drop zones of its launch ten and twenty minutes later, and a notice that may announce them.

    The platform's airspace is the nation's own, but for customers of k % 4 < 2, whose platforms lie in another's; there
    the nation follows only where no other is in question (k % 4 = 0). The announcement begins 30 hours earlier; by
    k % 6 it is shifted (0), short (1), valid at other hours (2), over midnight (3), of another nation (4) or plain (5).
    """
    k, i = F.col("c_custkey"), F.col("i")
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")).withColumn("i", F.explode(F.array(*map(F.lit, range(4)))))
    home = (F.col("c_nationkey") * 10 - 120).cast("double")
    start = F.timestamp_seconds(k * 172800 + i * 600)
    case = k % 6
    early = F.when(case == 1, F.timestamp_seconds(k * 172800 - 21600)).otherwise(F.timestamp_seconds(k * 172800 - 108000))
    late = F.when(case == 1, F.timestamp_seconds(k * 172800 + 10800)).otherwise(F.timestamp_seconds(k * 172800 + 144000))
    shift = F.when(case == 0, 1.0).otherwise(0.02)
    y = F.when(i == 0, 0.0).when(i == 1, _Z1).when(i == 2, _Z2).otherwise(_Z1 - 0.02)
    x = home + F.when(i.isin(0, 1), 0.0).when(i == 2, _DX).otherwise(shift)
    square = F.array(*(F.struct((y + dy).alias("lat"), (x + dx).alias("lon")) for dy, dx in ((-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5))))
    nation, none = F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.lit(None)
    own = (i == 0) & (k % 4 >= 2)
    nations = F.when((i == 3) & (case == 4), F.array(F.lit("N99"))).when(k % 4 == 0, F.array(nation)).otherwise(F.array(nation, F.lit("N98")))
    announces = i == 3
    return rows.select(
        (k * 10 + i).cast("long").alias("row_index"), F.concat_ws("-", k, i).alias("id"), F.lit("Launch").alias("kind"), F.lit("HIGH").alias("level"),
        F.when(announces, early).otherwise(start).alias("valid_from"), F.when(announces, late).otherwise(start + F.expr("interval 2 hours")).alias("valid_to"),
        y.alias("lat"), x.alias("lon"), F.lit("F").alias("fir"), none.cast("string").alias("nation"), nations.alias("nations"), none.cast("string").alias("site"),
        none.cast("double").alias("distance_km"), none.cast("double").alias("azimuth"), none.cast("double").alias("inclination"), none.cast("string").alias("orbit"), none.cast("string").alias("reliability"),
        F.when(announces, 6).when(i == 0, 13).otherwise(9).alias("branch"), F.lit("REVIEW").alias("status"), i.isin(1, 2).alias("requires_group"), F.lit(False).alias("override"),
        F.array(F.when(i == 0, F.array(F.struct(y.alias("lat"), x.alias("lon")))).otherwise(square)).alias("zones"), F.when(i == 0, F.when(k % 5 == 0, 80.0).otherwise(30.0)).alias("radius_km"),
        F.when(own, nation).otherwise("N97").alias("fir_country"), F.when(announces & (case == 2), "DLY 0600-0900").when(announces & (case == 3), "DLY 2300/0300").otherwise("").alias("daily"),
    )


def _sea_sites(spark, sf_dir):
    """Of an even nation a site from which the zones lie in the west; of an odd one a site near the platform."""
    n = F.col("n_nationkey")
    odd = n % 2 == 1
    home = (n * 10 - 120).cast("double")
    of = lambda letter: F.concat(F.lit(letter), n.cast("string"))
    return table(spark, sf_dir, "nation").select(of("S").alias("code"), F.when(odd, 1.0).otherwise(0.0).alias("place_lat"), F.when(odd, home).otherwise(home + 10).alias("place_lon"), n.cast("long").alias("ord"), of("N").alias("nation"))


def _found(spark, sf_dir):
    events = written(_sea_events(spark, sf_dir))
    return events, launches.grouped(events, _sea_sites(spark, sf_dir))



def sea_launches(spark, sf_dir):
    _, found = _found(spark, sf_dir)
    out = found.launches
    return out.select("label", "n", "site", "nation", "at_sea", F.array_join("ids", ",").alias("ids"), F.round("azimuth", 6).alias("azimuth"), F.round("spread", 6).alias("spread"), F.round("max_range_km", 4).alias("max_range_km"))


def advance_paired(spark, sf_dir):
    events, found = _found(spark, sf_dir)
    return launches.advance_notices(events, found).select("row_index", "label", F.round("lead_hours", 6).alias("lead_hours"))


def launches_settled(spark, sf_dir):
    events, found = _found(spark, sf_dir)
    advance = written(launches.advance_notices(events, found))
    out = launches.settled_events(events, found, advance)
    return out.select("row_index", "label", "nation", "site", "kind", "status", "requires_group", F.round("distance_km", 4).alias("distance_km"))


def archive_from_launches(spark, sf_dir):
    _, found = _found(spark, sf_dir)
    rows, _ = launches.complete(launches.archive_rows(found))
    return rows.select("key", "NOTAM", "Startdatum", "Startzeit", "Nation", "Weltraumbahnhof", "Orbit", "Dropzones")


def _degrees(x: str, y: str, f: str) -> str:
    """SQL for the course from (f, 0) to (y, x), 0 to 360."""
    return f"((degrees(atan2(sin(radians({x})) * cos(radians({y})), cos(radians({f})) * sin(radians({y})) - sin(radians({f})) * cos(radians({y})) * cos(radians({x})))) + 360) % 360)"


def _km(y: str, x: str, f: str) -> str:
    return f"(2 * 6371.0088 * asin(sqrt(pow(sin(radians(({y} - {f}) / 2)), 2) + cos(radians({y})) * cos(radians({f})) * pow(sin(radians({x} / 2)), 2))))"


_SEA = f"""with c as (select c_custkey as k, c_nationkey % 2 = 1 as near, c_nationkey * 10 - 120 as home, c_nationkey as n, case when c_nationkey % 2 = 1 then 1.0 else 0.0 end as f from customer),
l as (select *, {_degrees("0.6", "-5.6", "f")} as a, {_km("-5.6", "0.6", "f")} as km,
case when near then 'S' || n else 'SEA-0N' || abs(home) || case when home >= 0 then 'E' else 'W' end end as site, 'N' || n as nation,
'START-' || case when row_number() over (order by k) < 10 then '0' else '' end || row_number() over (order by k) as label from c where near or k % 4 <> 1)"""
#: Launches whose announcement fits.
_ADVANCE = "a as (select k, label, nation, site from l where k % 6 in (3, 5))"

QUERIES |= {"sea_launches": sea_launches, "advance_paired": advance_paired, "launches_settled": launches_settled, "archive_from_launches": archive_from_launches}
ORACLES["sea_launches"] = f"""{_SEA} select label, 3 as n, site, nation, not near as at_sea, k || '-0,' || k || '-1,' || k || '-2' as ids,
round(case when near then degrees(atan2(sin(radians(180)) * 2 + sin(radians(a)), cos(radians(180)) * 2 + cos(radians(a)))) else (180 + a) / 2 end, 6) as azimuth, round(180 - a, 6) as spread, round(km, 4) as max_range_km from l"""
ORACLES["advance_paired"] = f"{_SEA}, {_ADVANCE} select k * 10 + 3 as row_index, label, 30.0::double as lead_hours from a"
ORACLES["launches_settled"] = f"""{_SEA}, {_ADVANCE}, e as (select k, i from c, range(4) t(i))
select e.k * 10 + e.i as row_index, case when i < 3 then l.label else a.label end as label, case when i < 3 then l.nation else a.nation end as nation, case when i < 3 then l.site else a.site end as site,
case when a.k is not null and i = 3 then 'Advance notice' else 'Launch' end as kind, case when i < 3 and l.k is not null or i = 3 and a.k is not null then 'OK' else 'REVIEW' end as status, i in (1, 2) and l.k is null as requires_group,
round(case when l.k is null or i = 3 then null when i = 0 then {_km("0.0", "0.0", "l.f")} when i = 1 then {_km("-5.0", "0.0", "l.f")} else l.km end, 4) as distance_km from e left join l on e.k = l.k left join a on e.k = a.k"""
ORACLES["archive_from_launches"] = f"""{_SEA}, d as (select *, strftime(timestamp '1970-01-01' + to_seconds(k * 172800), '%d.%m.%Y') as day from l)
select day || '|' || k || '-0,' || k || '-1,' || k || '-2' as key, k || '-0, ' || k || '-1, ' || k || '-2' as "NOTAM", day as "Startdatum", '00:00' as "Startzeit", nation as "Nation", site as "Weltraumbahnhof", 'HIGH-INC' as "Orbit",
case when near then printf('%.4f %.4f; ', 0.0, home::double) else '' end || printf('%.4f %.4f; ', -5.0, home::double) || printf('%.4f %.4f', -5.6, home + 0.6) as "Dropzones" from d"""
