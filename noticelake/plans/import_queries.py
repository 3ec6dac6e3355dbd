"""Queries over pasted texts and over sites that zones cannot tell apart, built from the test tables, with SQL that knows the truth from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticelake.operators import merge
from noticelake.operators import sites as places
from noticelake.plans.scalar_queries import table
from noticelake.sources import tables as sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def _posts(spark, sf_dir):
    """A post for each customer: talk, a labelled notice with a remark below it, for some an unreadable, a domestic and a maritime one, and one that three customers quote."""
    k = F.col("c_custkey")
    own = F.format_string("NOTAM: A%04d/25 NOTAMN\r\nQ) ZJSA/QRDCA\r\nA) ZJSA B) 2509210130 C) 2509210430\r\nE) SPACE  LAUNCH – no %d\r\nF) SFC G) UNL\r\nprobably E) a big one", k % 10000, k)
    bad = F.when(k % 3 == 0, "B0001/25 NOTAMN B) WIE E) NO TIME")
    domestic = F.when(k % 4 == 0, "!FDC 6/1234 ZKC AIRSPACE ROCKET LAUNCH")
    sea = F.when(k % 5 == 0, "NAVAREA XI 123/25 ROCKET DEBRIS")
    shared = F.format_string("(c%04d/25 NOTAMN A) X B) 2510010100 E) shared %d\n \nthank you", F.floor(k / 3) % 10000, F.floor(k / 3) % 10000)
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("\n", F.lit("Hello all,\n\n\n\nsomeone wrote:"), own, bad, domestic, sea, shared).alias("post"))


_OWN = "select c_custkey, 'A' || lpad((c_custkey % 10000)::varchar, 4, '0') || '/25' as notice_id, '2509210130' as start, 'A' || lpad((c_custkey % 10000)::varchar, 4, '0') || '/25 NOTAMN\nQ) ZJSA/QRDCA\nA) ZJSA B) 2509210130 C) 2509210430\nE) SPACE LAUNCH - no ' || c_custkey || '\nF) SFC G) UNL' as text from customer"
_SHARED = "select c_custkey, 'C' || n || '/25' as notice_id, '2510010100' as start, '(c' || n || '/25 NOTAMN A) X B) 2510010100 E) shared ' || n::int as text from (select c_custkey, lpad(((c_custkey // 3) % 10000)::varchar, 4, '0') as n from customer)"


@query(
    "pasted_notices",
    f"select *, true as usable from ({_OWN}) union all select *, true from ({_SHARED})\n"
    "union all select c_custkey, null, null, null, false from customer, (select unnest([3, 4, 5]) as m) where c_custkey % m = 0",
)
def pasted_notices(spark, sf_dir):
    found = sources.pasted_notices(_posts(spark, sf_dir), "c_custkey", "post")
    return found.select("c_custkey", "notice_id", "start", "text", "usable")


@query(
    "pasted_corpus",
    f"""select key, first(text order by c_custkey) as text, string_agg(c_custkey::varchar, ',' order by c_custkey::varchar) as sources
from (select *, notice_id || '|' || start as key from (select * from ({_OWN}) union all select * from ({_SHARED}))) group by key""",
)
def pasted_corpus(spark, sf_dir):
    """The notices of all posts, each once, with the posts that have it."""
    found = sources.pasted_notices(_posts(spark, sf_dir), "c_custkey", "post")
    return merge.merged_corpus(sources.corpus_rows(found, "c_custkey"))


def _sites(spark, sf_dir):
    """Four sites for each nation along a meridian, at 0, 4, 8 and 14 km; two nations share each place.

    Of an even nation they are listed in this order, so the first three are a chain; of an odd
    one the third comes before the second, which then joins the first alone.
    """
    n, i = F.col("n_nationkey"), F.col("i")
    rows = table(spark, sf_dir, "nation").withColumn("i", F.explode(F.array(*map(F.lit, range(4)))))
    north = F.when(i == 3, 14.0).otherwise(i * 4.0) / 110.6
    order = F.when((n % 2 == 1) & i.isin(1, 2), 3 - i).otherwise(i)
    return rows.select(F.concat_ws("-", n, i).alias("code"), (F.floor(n / 2) + north).cast("double").alias("place_lat"), F.lit(10.0).alias("place_lon"), (n * 10 + order).cast("long").alias("ord"), F.concat(F.lit("N"), n.cast("string")).alias("nation"))


@query(
    "site_alternatives",
    """select c_custkey, case when i < 5 then n || '-' || i end as site,
case when i > 2 or (i = 2 and n % 2 = 1) then '' else array_to_string([n || '-' || x for x in case when n % 2 = 0 then [0, 1, 2] else [0, 1] end if x <> i], ',') end as others
from (select c_custkey, c_nationkey as n, c_custkey % 6 as i from customer)""",
)
def site_alternatives(spark, sf_dir):
    """Each customer's site with those that cannot be told from it; some sites are unknown or missing."""
    i = F.col("c_custkey") % 6
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(i < 5, F.concat_ws("-", "c_nationkey", i)).alias("site"))
    return places.with_alternatives(rows, _sites(spark, sf_dir)).select("c_custkey", "site", F.array_join("site_alternatives", ",").alias("others"))


@query(
    "sites_assigned",
    """select 'L' || k as label, n || '-' || s as site, round(n // 2 + s * 4.0 / 110.6, 6) as lat, case k % 4 when 1 then n || '-1' when 2 then 'mixed' when 3 then 'nowhere' end as choice,
case when n % 2 = 0 then case s when 0 then n || '-1,' || n || '-2' else n || '-0,' || n || '-2' end else case s when 0 then n || '-1' else n || '-0' end end as others, 2 as n_members
from (select c_custkey as k, c_nationkey as n, case when c_custkey % 4 = 1 then 1 else 0 end as s from customer)""",
)
def sites_assigned(spark, sf_dir):
    """For each customer a launch of two notices from its nation's first site; of four customers one has no choice, one the second site, one two choices, one an unknown site."""
    k, i = F.col("c_custkey"), F.col("i")
    rows = table(spark, sf_dir, "customer").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    site = F.concat_ws("-", "c_nationkey", F.lit(0))
    at = (F.floor(F.col("c_nationkey") / 2).cast("double").alias("site_lat"), F.lit(10.0).alias("site_lon"))
    members = rows.select((k * 2 + i).alias("row_index"), F.concat(F.lit("L"), k.cast("string")).alias("label"), site.alias("site"), *at)
    launches = members.where("row_index % 2 = 0").drop("row_index")
    choice = F.when(k % 4 == 1, F.concat_ws("-", "c_nationkey", F.lit(1))).when(k % 4 == 2, F.concat_ws("-", "c_nationkey", i + 1)).when((k % 4 == 3) & (i == 0), "nowhere")
    settled, theirs = places.with_assigned_sites(launches, members, _sites(spark, sf_dir), rows.select((k * 2 + i).alias("row_index"), choice.alias("site")))
    of = theirs.groupBy("label", "site").agg(F.count("*").cast("int").alias("n_members"))
    joined = settled.join(of, ["label", "site"])
    return joined.select("label", "site", F.round("site_lat", 6).alias("lat"), F.col("launch_site").alias("choice"), F.array_join("site_alternatives", ",").alias("others"), "n_members")
