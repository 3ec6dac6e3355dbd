"""Queries that run the frame operators over the test tables, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.operators import aggregates, cluster, joins, merge
from noticelake.plans import attribution
from noticelake.plans.scalar_queries import lat_of, lon_of, sql_lat, sql_lon, table
from noticelake.sources import tables as sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _places(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("code"), lat_of(k + 7).alias("place_lat"), lon_of(k + 7).alias("place_lon"), k.cast("long").alias("ord"), F.col("n_regionkey").alias("country"))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", lat_of(F.col("c_custkey")).alias("lat"), lon_of(F.col("c_custkey")).alias("lon"))


_GRID = f"""(select c_custkey, n_name as code, n_nationkey as ord, {sql_lat("(n_nationkey + 7)")} as a, {sql_lon("(n_nationkey + 7)")} as b,
{sql_lat("c_custkey")} as c, {sql_lon("c_custkey")} as d from customer, nation)"""
_HAV = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))"
_BEARING = "((degrees(atan2(sin(radians(d - b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b)))) + 360) % 360)"


@query(
    "nearest_with_cap",
    f"""select c_custkey, case when km <= 1500 then code end as code, case when km <= 1500 then round(km, 6) end as km from
(select *, row_number() over (partition by c_custkey order by km, ord) as r from (select *, {_HAV} as km from {_GRID})) where r = 1""",
)
def nearest_with_cap(spark, sf_dir):
    out = joins.nearest_within(_points(spark, sf_dir), "c_custkey", _places(spark, sf_dir), 1500.0)
    return out.select("c_custkey", "code", F.round("distance_km", 6).alias("km"))


@query(
    "nearest_with_direction",
    f"""select c_custkey, code, round(km, 6) as km, round(az, 6) as azimuth, km > nearest as passed_over from
(select *, min(km) over (partition by c_custkey) as nearest, row_number() over (partition by c_custkey order by odd, km, az, ord) as r from
(select *, km <= 8000 and az between 225 and 325 as odd from (select *, {_HAV} as km, {_BEARING} as az from {_GRID}))) where r = 1""",
)
def nearest_with_direction(spark, sf_dir):
    out = joins.nearest_by_direction(_points(spark, sf_dir), "c_custkey", _places(spark, sf_dir))
    return out.select("c_custkey", "code", F.round("distance_km", 6).alias("km"), F.round("azimuth", 6).alias("azimuth"), "passed_over")


@query(
    "best_common_site",
    f"""with g as (select c_custkey // 3 as grp, code, ord, km, az from (select *, {_HAV} as km, {_BEARING} as az from {_GRID})),
ok as (select grp, code, ord, avg(km) as mean_km from g group by all having not bool_or(km <= 8000 and az between 225 and 325)),
spread as (select p.grp, p.code, max(least(abs(p.az - q.az), 360 - abs(p.az - q.az))) as spread from g p join g q on p.grp = q.grp and p.code = q.code where p.km <= 8000 and q.km <= 8000 group by all),
scored as (select grp, code, ord, mean_km, coalesce(spread, 0.0) as spread, 100 * coalesce(spread, 0.0) + mean_km as score from ok left join spread using (grp, code))
select grp, code, round(score, 5) as score from (select *, row_number() over (partition by grp order by score, ord) as r from scored) where r = 1""",
)
def best_common_site(spark, sf_dir):
    zones = _points(spark, sf_dir).withColumn("grp", F.floor(F.col("c_custkey") / 3))
    return joins.common_site(zones, "grp", _places(spark, sf_dir)).select("grp", "code", F.round("score", 5).alias("score"))


@query(
    "fir_lookup_first_known",
    """select s_suppkey, case when s_suppkey % 4 = 0 then n1.n_name when s_suppkey % 4 = 1 then n1.n_name end as code,
case when s_suppkey % 4 < 2 then 'icao' when s_suppkey % 4 = 2 then 'outside:NOWHERE' else '-' end as method
from supplier left join nation n1 on s_nationkey = n1.n_nationkey""",
)
def fir_lookup_first_known(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey") % 4
    listed = F.when(k == 0, F.array("n_name", F.lit("NOWHERE"))).when(k == 1, F.array(F.lit("NOWHERE"), F.col("n_name"))).when(k == 2, F.array(F.lit("NOWHERE"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", listed.alias("candidates"))
    return joins.first_known(rows, "s_suppkey", "candidates", names.select(F.col("n_name").alias("code")))


@query(
    "colocated_sites",
    f"""with s as (select s_suppkey, s_nationkey, {sql_lat("(s_suppkey // 3)")} as lat, {sql_lon("(s_suppkey // 3)")} as lon from supplier)
select a.s_suppkey::varchar as code, min(b.s_suppkey)::varchar as first_code from s a join s b on a.s_nationkey % 5 = b.s_nationkey % 5 and a.lat = b.lat and a.lon = b.lon and b.s_suppkey <= a.s_suppkey group by a.s_suppkey""",
)
def colocated_sites(spark, sf_dir):
    k = F.floor(F.col("s_suppkey") / 3)
    sites = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_suppkey").alias("ord"), (F.col("s_nationkey") % 5).alias("country"), lat_of(k).alias("place_lat"), lon_of(k).alias("place_lon"))
    return joins.co_located(sites)


def _windows(spark, sf_dir, name, hours):
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    length = (F.col("event_id") % hours + 1).cast("int")
    return e.select("event_id", (F.col("user_id") % 50).alias("part"), "at", F.timestamp_micros(F.unix_micros("at") + length * 3_600_000_000).alias("until"))


@query(
    "advance_range_join",
    """with w as (select event_id, user_id % 50 as part, ts as a, ts + to_hours((event_id % 96 + 1)::int) as b from events where event_type = 'signup'),
n as (select event_id, user_id % 50 as part, ts as a, ts + to_hours((event_id % 6 + 1)::int) as b from events where event_type = 'error'),
p as (select w.event_id as wide_id, n.event_id as narrow_id from w join n on w.part = n.part and w.a <= n.a and n.b <= w.b
  and epoch(w.b) - epoch(w.a) >= 24 * 3600 and epoch(w.b) - epoch(w.a) >= 4 * (epoch(n.b) - epoch(n.a)))
select wide_id, min(narrow_id) as narrow_id from p group by 1 having count(*) = 1""",
)
def advance_range_join(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select("event_id", "event_type")
    wide = _windows(spark, sf_dir, "events", 96).join(kinds.where("event_type = 'signup'"), "event_id")
    narrow = _windows(spark, sf_dir, "events", 6).join(kinds.where("event_type = 'error'"), "event_id")
    return joins.contains_interval(
        wide.select(F.col("event_id").alias("wide_id"), "part", F.col("at").alias("w_from"), F.col("until").alias("w_to")),
        narrow.select(F.col("event_id").alias("narrow_id"), "part", F.col("at").alias("n_from"), F.col("until").alias("n_to")),
    )


@query(
    "catalogue_interval_match",
    """with w as (select event_id, user_id % 50 as part, ts as a, ts + to_hours((event_id % 6 + 1)::int) as b from events where event_type = 'error'),
i as (select event_id, user_id % 50 as part, ts as at from events where event_type = 'purchase')
select w.event_id as window_id, i.event_id as instant_id from w join i on w.part = i.part and i.at between w.a - interval 30 minutes and w.b + interval 30 minutes""",
)
def catalogue_interval_match(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select("event_id", "event_type")
    windows = _windows(spark, sf_dir, "events", 6).join(kinds.where("event_type = 'error'"), "event_id")
    instants = _windows(spark, sf_dir, "events", 6).join(kinds.where("event_type = 'purchase'"), "event_id")
    return joins.matches_in_window(
        windows.select(F.col("event_id").alias("window_id"), "part", F.col("at").alias("w_from"), F.col("until").alias("w_to")), instants.select(F.col("event_id").alias("instant_id"), "part", "at")
    )


def _order_parts(spark, sf_dir, modulus=1):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 500).alias("ids"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("nation"))
    return lines.join(orders, "l_orderkey").withColumnRenamed("l_orderkey", "id")


_PARTS = "(select distinct l_orderkey as id, l_partkey % 500 as e, o_orderdate::date as day, o_orderstatus as nation from lineitem join orders on l_orderkey = o_orderkey)"


@query(
    "same_launch_fuzzy",
    f"""select distinct a.id as left_id, b.id as right_id from {_PARTS} a join {_PARTS} b on a.e = b.e where a.id % 2 = 0 and b.id % 2 = 1 and abs(date_diff('day', a.day, b.day)) <= 1 and a.nation = b.nation""",
)
def same_launch_fuzzy(spark, sf_dir):
    rows = _order_parts(spark, sf_dir)
    return joins.same_launch(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


@query(
    "subset_antijoin",
    """with e as (select distinct l_orderkey as id, l_partkey % 40 as e from lineitem),
n as (select l_orderkey as id, count(distinct l_partkey % 40) as n, min(l_shipdate)::date as day, case when l_orderkey % 5 < 2 then l_orderkey % 5 end as nation from lineitem group by l_orderkey),
sub as (select a.id, b.id as id2 from e a join e b on a.e = b.e join n na on na.id = a.id join n nb on nb.id = b.id
  where na.n < nb.n and abs(date_diff('day', na.day, nb.day)) <= 1 and coalesce(na.nation = nb.nation, true) group by a.id, b.id, na.n having count(*) = na.n)
select id, n from n where id not in (select id from sub)""",
)
def subset_antijoin(spark, sf_dir):
    key = F.col("l_orderkey") % 5
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.when(key < 2, key).alias("nation"))
    rows = rows.agg(F.collect_set(F.col("l_partkey") % 40).alias("ids"), F.min("l_shipdate").cast("date").alias("day"))
    return joins.without_subsumed(rows).select("id", F.size("ids").cast("long").alias("n"))


@query("id_overlap", f"select distinct a.id from {_PARTS} a join (select day, e from {_PARTS} group by all having count(*) > 1) b on a.day = b.day and a.e = b.e")
def id_overlap(spark, sf_dir):
    return joins.sharing_ids(_order_parts(spark, sf_dir))


@query("semi_anti_archive", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def semi_anti_archive(spark, sf_dir):
    kept = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    hidden = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(kept, "o_custkey", "left_semi").join(hidden, "o_orderkey", "left_anti").select("o_orderkey")


@query("label_lookup", "select s_suppkey, coalesce(n_name || ' (' || s_nationkey || ')', s_nationkey || ' (no longer in the reference)') as label from supplier left join (select * from nation where n_regionkey <> 0) on s_nationkey = n_nationkey")
def label_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    code = F.col("s_nationkey").cast("string")
    label = F.coalesce(F.concat("n_name", F.lit(" ("), code, F.lit(")")), F.concat(code, F.lit(" (no longer in the reference)")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(names, "s_nationkey", "left").select("s_suppkey", label.alias("label"))


_LEVELS = "case when l_quantity > 40 then 'HIGH' when l_quantity > 20 then 'MEDIUM' else 'LOW' end"


def _events(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("level", F.when(q > 40, "HIGH").when(q > 20, "MEDIUM").otherwise("LOW"))


@query("confidence_filter", f"select l_orderkey, l_linenumber from lineitem where {_LEVELS} in ('HIGH', 'MEDIUM')")
def confidence_filter(spark, sf_dir):
    return _events(spark, sf_dir).where(aggregates.at_least(F.col("level"))).select("l_orderkey", "l_linenumber")


@query(
    "run_statistics",
    f"""select count(*) as rows, count(*) filter (l_tax <= 0.02) as no_trigger, count(*) filter (l_tax > 0.02) as events, count(*) filter (l_linestatus = 'F') as ok, count(*) filter (l_linestatus <> 'F') as review,
count(*) filter ({_LEVELS} = 'HIGH') as high_confidence, count(*) filter (l_returnflag = 'A') as confirmed, count(distinct l_orderkey) as launches from lineitem""",
)
def run_statistics(spark, sf_dir):
    rows = _events(spark, sf_dir).select(
        F.when(F.col("l_linestatus") == "F", "OK").otherwise("REVIEW").alias("status"), "level", (F.col("l_tax") > 0.02).alias("has_trigger"), F.col("l_orderkey").alias("launch"), (F.col("l_returnflag") == "A").alias("override")
    )
    return aggregates.run_statistics(rows)


@query(
    "group_summary",
    f"""select l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') as valid_from, strftime(max(l_shipdate), '%Y-%m-%d') as valid_to,
case min(case {_LEVELS} when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end) when 1 then 'HIGH' when 2 then 'MEDIUM' else 'LOW' end as level,
bool_or(l_returnflag = 'A') as override, string_agg(distinct l_linestatus, ',' order by l_linestatus) as sources, count(*) as n from lineitem group by 1""",
)
def group_summary(spark, sf_dir):
    rows = _events(spark, sf_dir).select("l_orderkey", F.col("l_shipdate").alias("valid_from"), F.col("l_shipdate").alias("valid_to"), "level", (F.col("l_returnflag") == "A").alias("override"), F.col("l_linestatus").alias("source"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return aggregates.group_summary(rows, "l_orderkey").select("l_orderkey", day("valid_from"), day("valid_to"), "level", "override", "sources", "n")


@query(
    "nations_common_or_all",
    """with v as (select distinct l_orderkey, l_linestatus as m, l_returnflag as v from lineitem), n as (select l_orderkey, count(distinct m) as m from v group by 1),
c as (select l_orderkey, v, count(*) as k from v group by all)
select l_orderkey, coalesce(string_agg(v, ',' order by v) filter (k = m), string_agg(v, ',' order by v)) as nations from c join n using (l_orderkey) group by 1""",
)
def nations_common_or_all(spark, sf_dir):
    out = aggregates.common_or_all(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", "l_returnflag")
    return out.select("l_orderkey", F.array_join("values", ",").alias("nations"))


@query(
    "propagate_or_mixed",
    """select l_orderkey, l_linenumber, case when mn <> mx then v else coalesce(mn, '') end as shared, coalesce(mn <> mx, false) as mixed from
(select *, min(nullif(v, '')) over w as mn, max(nullif(v, '')) over w as mx from (select l_orderkey, l_linenumber, case when l_returnflag = 'N' then '' else l_returnflag end as v from lineitem) window w as (partition by l_orderkey))""",
)
def propagate_or_mixed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("v"))
    return aggregates.one_or_mixed(rows, "l_orderkey", "v").select("l_orderkey", "l_linenumber", "shared", "mixed")


@query("site_history", "select o_orderpriority, o_orderstatus, count(*) as n, row_number() over (partition by o_orderpriority order by count(*) desc, o_orderstatus)::int as rank from orders group by 1, 2")
def site_history(spark, sf_dir):
    return aggregates.site_history(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("launch_numbering", "select o_orderkey, 'START-' || case when n < 10 then '0' else '' end || n as label from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as n from orders)")
def launch_numbering(spark, sf_dir):
    return aggregates.numbered_launches(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "label")


@query("dedup_keep_first", "select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey, round_even(l_discount, 2), round_even(l_tax, 2) order by l_orderkey, l_linenumber) as r from lineitem) where r = 1")
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return aggregates.first_of_each(rows, [F.col("l_suppkey"), F.bround("l_discount", 2), F.bround("l_tax", 2)], [F.col("l_orderkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber")


@query("override_keep_last", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def override_keep_last(spark, sf_dir):
    return aggregates.first_of_each(table(spark, sf_dir, "orders"), [F.col("o_custkey")], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("archive_page", "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 50 offset 50")
def archive_page(spark, sf_dir):
    """The second page of the archive; the page size is the feature."""
    return aggregates.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 2).select("o_orderkey")


@query("archive_keys", "select l_orderkey, strftime(min(l_shipdate), '%d.%m.%Y') || '|' || array_to_string(list_sort(list_distinct(list(upper(l_returnflag || l_partkey)))), ',') as key from lineitem group by 1")
def archive_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.date_format(F.min("l_shipdate"), "dd.MM.yyyy").alias("d"), F.collect_list(F.concat("l_returnflag", F.col("l_partkey").cast("string"))).alias("ids"))
    return rows.select("l_orderkey", merge.archive_key(F.col("d"), F.col("ids")).alias("key"))


@query(
    "archive_merge",
    """with o as (select s_suppkey as k, s_name as name, case when s_suppkey % 3 = 0 then 'old' else '' end as payload from supplier where s_suppkey % 4 <> 0),
n as (select s_suppkey as k, 'new ' || s_name as name, case when s_suppkey % 2 = 0 then 'fresh' else '' end as payload from supplier where s_suppkey % 5 <> 0 and s_suppkey % 7 <> 0)
select k, case when n.k is null or (o.k is not null and k % 11 = 0) then o.name else n.name end as name, case when n.k is null or (o.k is not null and n.payload = '') then o.payload else n.payload end as payload from o full join n using (k)""",
)
def archive_merge(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    old = s.where(k % 4 != 0).select(k.alias("k"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "old").otherwise("").alias("payload"))
    new = s.where(k % 5 != 0).select(k.alias("k"), F.concat(F.lit("new "), "s_name").alias("name"), F.when(k % 2 == 0, "fresh").otherwise("").alias("payload"))
    marks = s.where(k % 11 == 0).select(k.alias("k"), F.lit("name").alias("column"))
    return merge.upsert(old, new, "k", ("payload",), marks, s.where(k % 7 == 0).select(k.alias("k")))


@query("corpus_dedup_sources", "select l_partkey as key, arg_min(l_comment, ord) as text, string_agg(distinct l_returnflag, ',' order by l_returnflag) as sources from (select l_partkey, l_returnflag, l_orderkey * 10 + l_linenumber as ord, 'row ' || l_orderkey || '/' || l_linenumber as l_comment from lineitem) group by 1")
def corpus_dedup_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(F.lit("row "), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("text"), F.col("l_returnflag").alias("source")
    )
    return merge.merged_corpus(rows)


@query(
    "day_bundles",
    """select event_id, strftime(d, '%Y-%m-%d') as day from (select event_id, unnest(generate_series(
(case when hour(ts) < 6 then ts::date - 1 else ts::date end)::timestamp, least((ts + to_hours((event_id % 500)::int))::date, ts::date + 13)::timestamp, interval 1 day)) as d from events)""",
)
def day_bundles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("a"))
    ended = rows.withColumn("b", F.timestamp_seconds(F.unix_timestamp("a") + F.col("event_id") % 500 * 3600))
    return merge.day_bundles(ended, "a", "b").select("event_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("incremental_antijoin", "select strftime(d, '%Y-%m-%d') as day from (select ts::date as d, max(event_id % 97 = 0 and event_id > 5000) as changed from events group by 1) where changed")
def incremental_antijoin(spark, sf_dir):
    """Days with a changed row since the fingerprints were taken."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), F.col("event_id").cast("string").alias("key"), "event_id")
    now = rows.withColumn("key", F.when((F.col("event_id") % 97 == 0) & (F.col("event_id") > 5000), F.concat("key", F.lit("!"))).otherwise(F.col("key")))
    fresh = merge.to_evaluate(merge.day_fingerprints(now, "d", "key"), merge.day_fingerprints(rows, "d", "key"), "d")
    return fresh.select(F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("edit_marks", "select p_partkey as k, p_brand as original from part where p_partkey % 13 = 0 and p_brand <> 'edited'")
def edit_marks(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand")
    edits = parts.where("k % 13 = 0").select("k", F.lit("edited").alias("value"))
    return merge.edited(parts, edits, "k", "p_brand")[1].select("k", "original")


@query("union_by_name", "select n_nationkey as k, n_name as name, null as extra from nation union all select r_regionkey, r_name, 'region' from region")
def union_by_name(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.lit("region").alias("extra"))
    return n.unionByName(r, allowMissingColumns=True)


@query("set_intersect", "select n_regionkey as k from nation intersect select r_regionkey from region where r_regionkey > 1")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).intersect(table(spark, sf_dir, "region").where("r_regionkey > 1").select("r_regionkey"))


@query("set_difference", "select c_custkey as k from customer except select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("o_custkey"))


@query("ordered_unique", "select l_orderkey, string_agg(l_returnflag, ',' order by f, l_returnflag) as flags from (select l_orderkey, l_returnflag, min(l_linenumber) as f from lineitem group by 1, 2) group by 1")
def ordered_unique(spark, sf_dir):
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(ordered), ",").alias("flags"))


@query(
    "null_tolerant_filter",
    "select doc_id from documents left join labels using (doc_id) where (lang in ('de', 'fr') or lang is null) and (quality >= 1 or quality is null)",
)
def null_tolerant_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return rows.where((F.col("lang").isin("de", "fr") | F.col("lang").isNull()) & ((F.col("quality") >= 1) | F.col("quality").isNull())).select("doc_id")


@query("row_text_concat", "select p_partkey, p_name || case when p_brand <> '' then ' | p_brand: ' || p_brand else '' end || ' | p_size: ' || p_size as row_text from part")
def row_text_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return rows.select("p_partkey", sources.row_text(rows, "p_name", ("p_partkey",)).alias("row_text"))


@query(
    "attribution_decisions",
    """select l_orderkey, l_linenumber, case when l_returnflag = 'R' and l_linestatus = 'F' then 1 when l_quantity < 3 then 2 when l_linenumber = 7 then 5 when l_linenumber = 6 then 6 when l_tax >= 0.07 then 10
when l_quantity < 21 then 12 when l_discount >= 0.1 then 13 when l_partkey % 50 = 0 then 14 else 17 end as branch,
case when l_returnflag = 'R' and l_linestatus = 'F' or l_quantity < 3 or l_linenumber >= 6 or l_tax >= 0.07 or l_quantity < 21 or l_discount >= 0.1 or l_partkey % 50 = 0 then 'REVIEW' else 'OK' end as status from lineitem""",
)
def attribution_decisions(spark, sf_dir):
    c = F.col
    no = F.lit(False)
    rows = _events(spark, sf_dir)
    inputs = attribution.Inputs(
        foreign=(c("l_returnflag") == "R") & (c("l_linestatus") == "F"),
        hint=F.lit(None).cast("string"),
        hint_is_target=no,
        confirmed=no,
        rejected=no,
        has_centroid=c("l_quantity") >= 3,
        fir_method=F.when(c("l_linenumber") == 7, "outside:XXXX").otherwise("icao"),
        fir_nations=F.when(c("l_linenumber") == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("CN"))),
        fir_country_is_target=c("l_tax") < 0.07,
        fir_distance_km=F.lit(0.0),
        level=c("level"),
        has_site=c("l_discount") < 0.1,
        distance_km=F.when(c("l_partkey") % 50 == 0, 0.5).otherwise(900.0),
        implausible=no,
    )
    return rows.select("l_orderkey", "l_linenumber", attribution.decided(inputs).alias("d")).select("l_orderkey", "l_linenumber", "d.branch", "d.status")


def nearest_second(time: Column) -> Column:
    """Whole seconds since 1970, halves to the even one; ``unix_timestamp`` would cut the fraction off."""
    return F.rint(F.unix_micros(time) / 1e6).cast("long")


@query(
    "time_cluster",
    """with recursive e as (select event_id, user_id % 20 as part, epoch(ts)::bigint as t, row_number() over (partition by user_id % 20 order by ts, event_id) as r from events),
c as (select part, r, event_id, t, t as first, t as last, 1 as n from e where r = 1
 union all select e.part, e.r, e.event_id, e.t, case when e.t - c.last <= 1800 and e.t - c.first <= 5400 then c.first else e.t end, e.t, c.n + case when e.t - c.last <= 1800 and e.t - c.first <= 5400 then 0 else 1 end
 from c join e on e.part = c.part and e.r = c.r + 1)
select event_id, part, n as cluster from c""",
)
def time_cluster(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("part"), nearest_second(F.col("ts").cast("timestamp")).alias("t"))
    return cluster.gap_and_span(rows, "part", "t", "event_id", gap=1800, span=5400).select("event_id", "part", "cluster")


@query("html_posts")
def html_posts(spark, sf_dir):
    """Text blocks of saved pages; a state machine reads the markup, so SQL has no counterpart."""
    return sources.html_texts(table(spark, sf_dir, "pages"), "page_id", "html")
