"""Queries over whole notices that are built from the test tables, with SQL that knows the truth from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticelake.functions import coords, geo
from noticelake.operators.joins import reference_rows
from noticelake.plans import analysis
from noticelake.plans.scalar_queries import lat_of, lon_of, sql_lat, sql_lon, table
from noticelake.sources import exports
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


def _notices(spark, sf_dir):
    """A notice for each customer, about the customer's point, in the airspace of the customer's nation; some lack a trigger, a point or a known airspace."""
    k = F.col("c_custkey")
    at = F.format_string("%05.2f%s %06.2f%s", F.abs("y"), F.when(F.col("y") < 0, "S").otherwise("N"), F.abs("x"), F.when(F.col("x") < 0, "W").otherwise("E"))
    code = F.when(k % 10 == 6, "XXXX").otherwise(F.concat(F.lit("Z"), F.char(65 + F.col("c_nationkey")), F.lit("QA")))
    body = F.when(k % 10 == 9, "CRANE WORK IN PROGRESS").when(k % 10 == 7, "ROCKET LAUNCH AREA TO BE ANNOUNCED").otherwise(F.concat(F.lit("ROCKET LAUNCH WITHIN A RADIUS OF 50 NM CENTRED ON "), at))
    heights = F.when(k % 10 == 9, " F) SFC G) 300FT").otherwise(" F) SFC G) UNL")
    full = F.concat(F.format_string("A%04d/25 A) ", k % 10000), code, F.lit(" B) 2509210130 C) 2509210430 E) "), body, heights)
    rows = table(spark, sf_dir, "customer").withColumn("y", lat_of(k)).withColumn("x", lon_of(k))
    none = F.lit(None).cast("string")
    return rows.select(k.alias("row_index"), none.alias("id"), full.alias("text"), none.alias("fir"), none.alias("valid_from"), none.alias("valid_to"), none.alias("qline"))


def _references(spark, sf_dir):
    k = F.col("n_nationkey")
    nation = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    rows = table(spark, sf_dir, "nation")
    place = (lat_of(k + 7).alias("place_lat"), lon_of(k + 7).alias("place_lon"), k.cast("long").alias("ord"))
    return rows.select(F.col("n_name").alias("code"), *place, nation.alias("nation")), rows.select(F.concat(F.lit("Z"), F.char(65 + k), F.lit("QA")).alias("code"), *place, F.array(nation).alias("nations"), nation.alias("country"))


_OWN = f"""(select c_custkey, n.n_name as code, n.n_nationkey as ord, {sql_lat("(n.n_nationkey + 7)")} as a, {sql_lon("(n.n_nationkey + 7)")} as b, {sql_lat("c_custkey")} as c, {sql_lon("c_custkey")} as d
from customer join nation own on c_nationkey = own.n_nationkey join nation n on n.n_regionkey = own.n_regionkey where c_custkey % 10 not in (6, 7, 9))"""
_HAV = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))"
_BEARING = "((degrees(atan2(sin(radians(d - b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b)))) + 360) % 360)"


@query(
    "notices_analysed",
    f"""with best as (select * from (select *, row_number() over (partition by c_custkey order by odd, km, az, ord) as r from
(select *, km <= 8000 and az between 225 and 325 as odd from (select *, {_HAV} as km, {_BEARING} as az from {_OWN}))) where r = 1)
select c_custkey as row_index, 'A' || lpad((c_custkey % 10000)::varchar, 4, '0') || '/25' as id, code as site, round(km, 4) as km, 'HIGH' as level,
case when km < 1 then 14 when odd then 15 else 17 end as branch, case when km < 1 or odd then 'REVIEW' else 'OK' end as status from best
union all select c_custkey, 'A' || lpad((c_custkey % 10000)::varchar, 4, '0') || '/25', null, null, 'HIGH', case when c_custkey % 10 = 7 then 2 else 5 end, 'REVIEW' from customer where c_custkey % 10 in (6, 7)""",
)
def notices_analysed(spark, sf_dir):
    sites, firs = _references(spark, sf_dir)
    out = analysis.analysed(_notices(spark, sf_dir), sites, firs, ("R0", "R1", "R2", "R3", "R4"))
    named = F.when(F.col("branch") > 5, F.col("site"))
    return out.select("row_index", "id", named.alias("site"), F.when(F.col("branch") > 5, F.round("distance_km", 4)).alias("km"), "level", "branch", "status")


_NAMED = f"""(select c_custkey, n.n_name as code, n.n_nationkey as ord, c_custkey % 3 = 0 and n.n_nationkey in (c_custkey % 25, (c_custkey % 25 + 7) % 25) as named, n.n_regionkey = own.n_regionkey as ours,
{sql_lat("(n.n_nationkey + 7)")} as a, {sql_lon("(n.n_nationkey + 7)")} as b, {sql_lat("c_custkey")} as c, {sql_lon("c_custkey")} as d
from customer join nation own on c_nationkey = own.n_nationkey cross join nation n where c_custkey % 10 not in (6, 7, 9))"""


@query(
    "sites_named",
    f"""with ranked as (select *, case when named and ours then 0 when named then 1 when ours then 2 end as rank from {_NAMED}),
judged as (select *, min(rank) over (partition by c_custkey) as lowest, km <= 8000 and az between 225 and 325 as odd from (select *, {_HAV} as km, {_BEARING} as az from ranked)),
best as (select *, row_number() over (partition by c_custkey order by odd, km, az, ord) as r from judged where rank = lowest)
select c_custkey as row_index, code as site, round(km, 4) as km, case when c_custkey % 3 = 0 then 'BOOSTER X' || lpad((c_custkey % 25)::varchar, 2, '0') else '' end as evidence,
case when km < 1 then 14 when odd then 15 else 17 end as branch from best where r = 1""",
)
def sites_named(spark, sf_dir):
    """Notices that name a vehicle which flies from two sites: one of their own nations counts before one of others."""
    sites, firs = _references(spark, sf_dir)
    names = [r["code"] for r in sorted(reference_rows(sites), key=lambda r: r["ord"])]
    words = {f"BOOSTER X{i:02d}": (names[i], names[(i + 7) % len(names)]) for i in range(len(names))}
    vehicle = F.format_string(" BOOSTER X%02d", F.col("row_index") % len(names))
    rows = _notices(spark, sf_dir).withColumn("text", F.when(F.col("row_index") % 3 == 0, F.regexp_replace("text", F.lit(" F\\) SFC"), F.concat(vehicle, F.lit(" F) SFC")))).otherwise(F.col("text")))
    out = analysis.analysed(rows, sites, firs, ("R0", "R1", "R2", "R3", "R4"), site_words=words).where("branch > 5")
    return out.select("row_index", "site", F.round("distance_km", 4).alias("km"), F.array_join("site_evidence", ",").alias("evidence"), "branch")


@query(
    "catalogue_parsed",
    """select o_orderkey::varchar as payload, strftime(o_orderdate, '%Y') || '-' || lpad((o_orderkey % 1000)::varchar, 3, '0') as tag, strftime(o_orderdate, '%Y-%m-%d %H:%M') as at, o_orderkey % 3 = 0 as date_only,
'V' || o_orderstatus as vehicle, 'S' || o_custkey % 20 as site, (o_orderkey % 90)::double as inclination from (select * replace (case when o_orderkey % 3 = 0 then date_trunc('day', o_orderdate) else o_orderdate end as o_orderdate) from orders) where o_orderkey % 7 <> 0""",
)
def catalogue_parsed(spark, sf_dir):
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    date = F.when(k % 3 == 0, F.date_format(d, "yyyy MMM d")).otherwise(F.date_format(d, "yyyy MMM d HHmm"))
    tag = F.when(k % 7 == 0, "S-1").otherwise(F.format_string("%s-%03d", F.date_format(d, "yyyy"), k % 1000))
    dash = F.lit("-")
    line = F.concat_ws("\t", tag, F.lit("x"), date, F.concat(F.lit("V"), "o_orderstatus", F.lit("?")), *[dash] * 4, k.cast("string"), *[dash] * 2, F.concat(F.lit("S"), (F.col("o_custkey") % 20).cast("string"), F.lit("?")), *[dash] * 6, (k % 90).cast("string"), dash)
    found = sources.launch_catalogue(table(spark, sf_dir, "orders").select(line.alias("value")), 1900, 2100)
    return found.select("payload", "tag", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), "date_only", "vehicle", "site", "inclination")


@query("zones_written", f"""select s_suppkey, printf('%.4f %.4f; %.4f %.4f', {sql_lat("s_suppkey")}, {sql_lon("s_suppkey")}, {sql_lat("s_suppkey")} + 1, {sql_lon("s_suppkey")}) as zones, 2 as n from supplier""")
def zones_written(spark, sf_dir):
    """Zones as the archive keeps them, and how many points come back from the text with a broken part in it."""
    k = F.col("s_suppkey")
    points = F.array(F.struct(lat_of(k).alias("lat"), lon_of(k).alias("lon")), F.struct((lat_of(k) + 1).alias("lat"), lon_of(k).alias("lon")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", coords.written_points(points).alias("zones"))
    return rows.select("s_suppkey", "zones", F.size(coords.read_points(F.concat("zones", F.lit("; broken; 1 x")))).alias("n"))


@query("zones_congruent", "select s_suppkey, least(s_suppkey % 50 + 10, s_suppkey % 70 + 10) / greatest(s_suppkey % 50 + 10, s_suppkey % 70 + 10)::double >= 0.6 as congruent from supplier")
def zones_congruent(spark, sf_dir):
    k = F.col("s_suppkey")
    shape = lambda n: geo.zone_shape(F.array(F.struct(lat_of(k).alias("lat"), lon_of(k).alias("lon"))), (k % n + 10).cast("double"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", shape(50).alias("a"), shape(70).alias("b")).select("s_suppkey", geo.zones_congruent(F.col("a"), F.col("b")).alias("congruent"))


@query("json_export", """select p_partkey, to_json({'name': p_name, 'size': p_size, 'brand': nullif(p_brand, '')}) as record from part""")
def json_export(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.nullif(F.col("p_brand"), F.lit("")).alias("brand"))
    return rows.select("p_partkey", exports.record(["name", "size", "brand"]).alias("record"))


@query(
    "aliases_resolved",
    """with ref as (select n_name as code, lower(n_name) as name, n_nationkey as ord from nation where n_nationkey <> 3), al as (select 'old' || n_nationkey as spelling, n_name as code from nation where n_nationkey < 6)
select s_suppkey, coalesce(ref2.code, ref.code) as code from (select s_suppkey, case when s_suppkey % 2 = 0 then 'Old ' || s_nationkey else n_name || '/Block 2' end as raw, s_nationkey, n_name from supplier join nation on s_nationkey = n_nationkey) s
left join al on s_suppkey % 2 = 0 and al.spelling = 'old' || s_nationkey left join ref ref2 on ref2.code = al.code left join ref on s_suppkey % 2 = 1 and ref.code = s.n_name""",
)
def aliases_resolved(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    reference = nations.where("n_nationkey <> 3").select(F.col("n_name").alias("code"), F.lower("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    aliases = nations.where("n_nationkey < 6").select(F.concat(F.lit("old-"), F.col("n_nationkey").cast("string")).alias("spelling"), F.col("n_name").alias("code"))
    k = F.col("s_suppkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit("Old "), F.col("s_nationkey").cast("string"))).otherwise(F.concat("n_name", F.lit("/Block 2")))
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", raw.alias("raw"))
    return sources.resolved_codes(rows, "s_suppkey", "raw", reference, aliases)
