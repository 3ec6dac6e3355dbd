"""Queries of past launches and result tables over launches from the test tables, with SQL that knows the truth from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticelake.operators.staging import written
from noticelake.plans import launch_queries, launches, past, reports
from noticelake.plans.scalar_queries import lat_of, lon_of, sql_lat, sql_lon, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Customers up to about this number have had their launches.
_NOW = 100 * 172800


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def _past(spark, sf_dir):
    """Launches and announcements from the sea, the archive without every fourth launch, rows taken out of it for every tenth customer, and what is past."""
    events, found = launch_queries._found(spark, sf_dir)
    advance = written(launches.advance_notices(events, found))
    keys = written(launches.archive_rows(found).select("key", F.split("NOTAM", "-")[0].cast("long").alias("k")))
    removed = keys.where("k % 10 = 0").select("key")
    over = written(past.past_launches(found, events, advance, keys.where("k % 4 <> 3").select("key"), F.timestamp_seconds(F.lit(_NOW)), removed))
    return events, found, advance, removed, over


_SEA, _ADVANCE = launch_queries._SEA, launch_queries._ADVANCE
_OVER = f"""{_SEA}, {_ADVANCE}, e as (select *, k * 172800 + case when k % 6 in (3, 5) then 144000 else 8400 end as last_end from l),
o as (select * from e where k % 4 <> 3 and k % 10 <> 0 and last_end + 86400 < {_NOW})"""


@query("launches_past", f"{_OVER} select label, last_end::bigint as last_end from o")
def launches_past(spark, sf_dir):
    return _past(spark, sf_dir)[4].select("label", F.unix_seconds("last_end").alias("last_end"))


@query("past_rows_hidden", f"{_OVER} select k * 10 + i as row_index from o, range(4) t(i) where i < 3 or k % 6 in (3, 5)")
def past_rows_hidden(spark, sf_dir):
    _, found, advance, _, over = _past(spark, sf_dir)
    return past.past_rows(found, advance, over)


@query("past_launches_hidden", f"{_OVER} select count(*) as n from o where k % 5 <> 2")
def past_launches_hidden(spark, sf_dir):
    events, found, _, _, over = _past(spark, sf_dir)
    visible = events.where("floor(row_index / 10) % 5 <> 2").select("row_index")
    return past.hidden_launches(found, over, visible)


@query(
    "launch_report",
    f"""{_OVER}, w as (select *, timestamp '1970-01-01' + to_seconds(k * 172800) as begun from l)
select label as "Start", w.nation as "Startnation", coalesce(n_name || ' (' || site || ')', site) as "Weltraumbahnhof", strftime(begun, '%d.%m.%Y %H:%MZ') || ' - ' || strftime(begun + interval 8400 seconds, '%d.%m.%Y %H:%MZ') as "Startfenster (UTC)",
3 as "Sperrzonen", k || '-0, ' || k || '-1, ' || k || '-2' as "NOTAMs", case when k % 6 in (3, 5) then k || '-3 (30 h)' else '-' end as "Vorankündigung", 'High inclination / near-polar' as "Orbit-Typ",
case when k % 10 = 0 then 'removed from archive' when k in (select k from o) then 'past' else '-' end as "Archiv" from w left join nation on site = 'S' || n_nationkey""",
)
def launch_report(spark, sf_dir):
    events, found, advance, removed, over = _past(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"))
    out = reports.launch_report(launches.with_advance(found, events, advance), names, past.archive_notes(found, over, removed))
    return out.select("Start", "Startnation", "Weltraumbahnhof", "Startfenster (UTC)", "Sperrzonen", "NOTAMs", "Vorankündigung", "Orbit-Typ", "Archiv")


@query(
    "event_report",
    f"""{_SEA}, {_ADVANCE}, e as (select k, i from c, range(4) t(i))
select e.k * 10 + e.i as row_index, e.k || '-' || e.i as "NOTAM ID", case when a.k is not null and i = 3 then 'Advance notice' else 'Launch' end as "Art", coalesce(case when i < 3 then l.label else a.label end, '-') as "Start",
coalesce(case when i < 3 then l.nation else a.nation end, '-') as "Startnation", coalesce(case when i < 3 then l.site else a.site end, '-') as "Weltraumbahnhof", case when i = 0 then 1 else 4 end as "Punkte",
case when i < 3 and l.k is not null or i = 3 and a.k is not null then 'OK' else 'REVIEW' end as "Status" from e left join l on e.k = l.k left join a on e.k = a.k""",
)
def event_report(spark, sf_dir):
    events, found = launch_queries._found(spark, sf_dir)
    settled = launches.settled_events(events, found, written(launches.advance_notices(events, found)))
    return reports.event_report(settled).select("row_index", "NOTAM ID", "Art", "Start", "Startnation", "Weltraumbahnhof", "Punkte", "Status")


@query(
    "hide_reasons",
    """select o_orderkey, case when o_orderkey % 3 = 0 and o_orderkey % 4 = 0 then 'Low confidence with exclusion term(s): BALLOON, CRANE, LASER.'
when o_orderkey % 3 = 0 and o_orderkey % 4 = 2 then 'Low confidence with exclusion term(s): GUN FIRING, FIRING, OBST.' else '' end as reason from orders""",
)
def hide_reasons(spark, sf_dir):
    k = F.col("o_orderkey")
    body = F.when(k % 4 == 0, "LASER, CRANE AND\nBALLOON").when(k % 4 == 1, "ROCKET LAUNCH").when(k % 4 == 2, "GUN FIRING NEAR OBST")
    level = F.when(k % 3 == 0, "LOW").when(k % 3 == 1, "MEDIUM").otherwise("HIGH")
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.hide_reason(level, body).alias("reason"))


_COURSE = "radians((degrees(atan2(sin(radians({x})) * cos(radians(y + {y})), cos(radians(y)) * sin(radians(y + {y})) - sin(radians(y)) * cos(radians(y + {y})) * cos(radians({x})))) + 360) % 360)"


@query(
    "tracks_from_sites",
    f"""select k as s_suppkey, case when k % 3 = 2 then printf('%.1f', (degrees(atan2(sin(p) + sin(q), cos(p) + cos(q))) + 360) % 360) else '' end as azimuth,
case k % 3 when 0 then 'no drop zones to compute the orbit from' when 1 then 'zone on the launch site' else '' end as note
from (select k, {_COURSE.format(x="1.0", y="1.0")} as p, {_COURSE.format(x="-0.5", y="2.0")} as q from (select s_suppkey as k, {sql_lat("s_suppkey")} as y from supplier))""",
)
def tracks_from_sites(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", lat_of(k).alias("y"), lon_of(k).alias("x"))
    here, there = F.format_string("%.4f %.4f", "y", "x"), F.format_string("%.4f %.4f; broken; %.4f %.4f", F.col("y") + 1, F.col("x") + 1, F.col("y") + 2, F.col("x") - 0.5)
    zones = F.when(k % 3 == 1, F.concat(there, F.lit("; "), here)).when(k % 3 == 2, there)
    track = reports.track_from_site(F.col("y"), F.col("x"), zones)
    return rows.select("s_suppkey", track.alias("t")).select("s_suppkey", "t.azimuth", "t.note")
