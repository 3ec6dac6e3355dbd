"""Launch sites that stand too near each other to be told apart by the zones of their launches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions.geo import surface_km
from noticelake.operators.joins import checked_reference

#: Kilometres up to which two sites of a nation count as one place. Fixed value.
CO_LOCATED_KM = 5.0

#: What a launch shows whose notices differ. Fixed value.
MIXED = "mixed"


def _placed(rows: pd.DataFrame) -> pd.DataFrame:
    """The group of each site of a nation, in their order: the first group that has a site near it, else one of its own."""
    number: dict[str, int] = {}
    groups: list[list[str]] = []
    ordered = rows.sort_values(["ord", "code"])
    for code, near in zip(ordered["code"], ordered["near"], strict=True):
        known = [number[c] for c in near if c in number]
        number[code] = min(known, default=len(groups))
        if not known:
            groups.append([])
        groups[number[code]].append(code)
    return pd.DataFrame([(c, g) for g in groups if len(g) > 1 for c in g], columns=["code", "members"])


def site_groups(sites: DataFrame, within_km: float = CO_LOCATED_KM) -> DataFrame:
    """(code, members): for each site that has a neighbour its group's codes in order, the first of which geometry may choose.

    sites: (code, place_lat, place_lon, ord, nation), a reference of checked size, a row for
    each code; a null nation counts as one. In the order of ord, a site joins the first group
    of its nation in which any member is within ``within_km``, so chains of sites are one
    group, and two groups that a later site touches stay two. Sites without a position have
    no neighbours.
    """
    # the check bounds what one task of a nation gets; a strip of latitude is at least as high as the distance (a degree has over 110 km)
    checked = checked_reference(sites).select("code", "place_lat", "place_lon", "ord", F.coalesce(F.col("nation"), F.lit("")).alias("nation"))
    strip = F.floor(F.col("place_lat") * 110 / within_km).cast("long")
    celled = checked.withColumn("strip", strip)
    other = celled.select("nation", F.explode(F.array("strip", F.col("strip") - 1, F.col("strip") + 1)).alias("strip"), *(F.col(c).alias(f"other_{c}") for c in ("code", "ord", "place_lat", "place_lon")))
    earlier = F.struct("other_ord", "other_code") < F.struct("ord", "code")
    near = surface_km(F.col("place_lat"), F.col("place_lon"), F.col("other_place_lat"), F.col("other_place_lon")) <= within_km
    met = celled.join(other, ["nation", "strip"]).where(earlier & near).groupBy("code").agg(F.collect_set("other_code").alias("near"))
    listed = checked.join(met, "code", "left").select("code", "ord", "nation", F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    return listed.groupBy("nation").applyInPandas(lambda rows: _placed(rows), "code string, members array<string>")


def choosable(sites: DataFrame, within_km: float = CO_LOCATED_KM) -> DataFrame:
    """The sites among which geometry may choose: of a group the first alone. The others are chosen by hand."""
    later = site_groups(sites, within_km).where(F.col("members")[0] != F.col("code")).select("code")
    return sites.join(F.broadcast(later), "code", "left_anti").select(*sites.columns)


def with_choice(sites: DataFrame, within_km: float = CO_LOCATED_KM) -> DataFrame:
    """``sites`` with auto: whether geometry may choose a site; the others take a person's choice or their name in a text."""
    later = site_groups(sites, within_km).where(F.col("members")[0] != F.col("code")).select("code", F.lit(False).alias("auto"))
    plain = sites.drop("auto")
    return plain.join(F.broadcast(later), "code", "left").select(*plain.columns, F.coalesce("auto", F.lit(True)).alias("auto"))


def with_alternatives(rows: DataFrame, sites: DataFrame, site: str = "site", within_km: float = CO_LOCATED_KM) -> DataFrame:
    """``rows`` with site_alternatives: the other codes of the group of a row's site, in order; empty for a site that stands alone, an unknown one or none."""
    groups = site_groups(sites, within_km).select(F.col("code").alias(site), F.filter("members", lambda m: m != F.col("code")).alias("site_alternatives"))
    joined = rows.drop("site_alternatives").join(F.broadcast(groups), site, "left")
    others = [c for c in rows.columns if c != "site_alternatives"]
    return joined.select(*others, F.coalesce("site_alternatives", F.array().cast("array<string>")).alias("site_alternatives"))


def separation_km(sites: DataFrame, within_km: float = CO_LOCATED_KM) -> DataFrame:
    """(first_code, n, km): the greatest distance within each group of co-located sites."""
    groups = site_groups(sites, within_km).select(F.col("members")[0].alias("first_code"), "code")
    placed = groups.join(sites.select("code", "place_lat", "place_lon"), "code")
    other = placed.select("first_code", F.col("code").alias("code2"), F.col("place_lat").alias("lat2"), F.col("place_lon").alias("lon2"))
    km = surface_km(F.col("place_lat"), F.col("place_lon"), F.col("lat2"), F.col("lon2"))
    far = placed.join(other, "first_code").where(F.col("code") < F.col("code2"))
    return far.groupBy("first_code").agg(F.count_distinct("code").alias("n0"), F.max(km).alias("km")).select("first_code", (F.col("n0") + 1).alias("n"), "km")


def with_assigned_sites(launches: DataFrame, members: DataFrame, sites: DataFrame, choices: DataFrame, within_km: float = CO_LOCATED_KM) -> tuple[DataFrame, DataFrame]:
    """Launches and members with the sites that a person has chosen: site, its position, auto_site (what geometry gave) and site_alternatives.

    launches: (label, site, site_lat, site_lon, ...); members: (row_index, label, site,
    site_lat, site_lon, ...), announcements included; choices: (row_index, site), a row for
    each notice, empty or null for none. A launch takes the one choice that its notices
    have; where they differ its site stays and launch_site is ``MIXED``; a choice that the
    reference lacks changes nothing. Without a choice the launch returns to auto_site. The
    course and orbit are not worked out again: such sites differ by less than the estimate's
    own error.
    """
    chosen = choices.where(F.trim("site") != "").dropDuplicates(["row_index"]).select("row_index", F.col("site").alias("choice"))
    wishes = members.select("row_index", "label").join(chosen, "row_index").groupBy("label").agg(F.min("choice").alias("lo"), F.max("choice").alias("hi"))
    wishes = wishes.select("label", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(MIXED).alias("launch_site"))
    places = checked_reference(sites.select(F.col("code").alias("target"), F.col("place_lat").alias("new_lat"), F.col("place_lon").alias("new_lon")))
    auto = F.coalesce("auto_site", "site") if "auto_site" in launches.columns else F.col("site")
    wished = launches.drop("launch_site").join(wishes, "label", "left").withColumn("auto_site", auto)
    wished = wished.withColumn("target", F.when(F.coalesce(F.col("launch_site") != MIXED, F.lit(True)), F.coalesce("launch_site", "auto_site")))
    found = wished.join(places, "target", "left")
    moved = F.col("new_lat").isNotNull() & (F.col("target") != F.coalesce("site", F.lit("")))
    new = {"site": F.col("target"), "site_lat": F.col("new_lat"), "site_lon": F.col("new_lon")}
    kept = [c for c in launches.columns if c not in (*new, "auto_site", "launch_site", "site_alternatives")]
    settled = found.select(*kept, *(F.when(moved, v).otherwise(F.col(c)).alias(c) for c, v in new.items()), "auto_site", "launch_site", moved.alias("moved"))
    of = settled.where("moved").select("label", *(F.col(c).alias(f"l_{c}") for c in new))
    rows = members.join(of, "label", "left").select(*(F.coalesce(f"l_{c}", c).alias(c) if c in new else F.col(c) for c in members.columns))
    return with_alternatives(settled.drop("moved"), sites, within_km=within_km), with_alternatives(rows, sites, within_km=within_km)
