"""From attributed notices to launches and back: who can be grouped, what belongs together in time and on one track, the launches
built from it, what they give to their notices, the notices that announced them, and their rows in the archive.

Only the clusters of more than one notice are gathered, and only to be split: a cluster is
what was published for one launch window. Everything else is joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions import geo, timeparse
from noticelake.operators import aggregates, merge
from noticelake.operators.sites import with_choice
from noticelake.operators.staging import written as staged
from noticelake.plans.tracks import TARGET_KM, tracks

#: Fixed values of the launch window: seconds, share of the longer validity.
GAP_S = 1800
SPAN_S = 5400
LONG_S = 12 * 3600
OVERLAP = 0.8

#: Fixed values of an advance notice: hours that it runs at least, and times the launch window.
ADVANCE_HOURS = 24.0
ADVANCE_TIMES = 4.0
ADVANCE_KIND = "Advance notice"

#: Columns of the launch archive, fixed values.
ARCHIVE_COLUMNS = ("NOTAM", "Startdatum", "Startzeit", "Nation", "Weltraumbahnhof", "Trägersystem", "Payload", "Orbit", "Inklination", "Azimuth", "Dropzones")
#: Those that a row must have, and those that an empty new value does not replace.
ARCHIVE_NEEDS, ARCHIVE_KEEPS = ("NOTAM", "Startdatum", "Nation"), ("Payload", "Trägersystem")

#: The decision "no site found", which a group of notices may still resolve.
NO_SITE = 13


def groupable() -> Column:
    """Events with a centre and nations in question that are attributed, confirmed, or left open for a group."""
    open_ = F.col("requires_group") & aggregates.at_least(F.col("level"))
    fits = (F.col("status") == "OK") | F.col("override") | open_ | (F.col("branch") == NO_SITE)
    return F.col("lat").isNotNull() & (F.size("nations") > 0) & F.coalesce(fits, F.lit(False))


def _joins(first: tuple, last_from: float, event: tuple) -> bool:
    """Whether an event (row, from, to, nations) belongs to the cluster of ``first`` whose last member starts at ``last_from``."""
    _, f_from, f_to, f_nations = first
    _, e_from, e_to, e_nations = event
    if not set(f_nations) & set(e_nations):
        return False
    f_long, e_long = f_to - f_from, e_to - e_from  # NaN without an end, which is no long validity
    if not (f_long >= LONG_S or e_long >= LONG_S):
        return e_from - last_from <= GAP_S and e_from - f_from <= SPAN_S
    if f_long != f_long or e_long != e_long:  # one has no end
        return False
    shared = min(f_to, e_to) - max(f_from, e_from)
    return shared > 0 and shared >= OVERLAP * max(f_long, e_long)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    run = first = last_from = None
    for batch in batches:
        firsts = []
        for start, *event in zip(batch["start_row"], batch["row_index"], batch["t"], batch["e"], batch["nations"], strict=True):
            if start != run or not _joins(first, last_from, event):
                first = event
            run, last_from = start, event[1]
            firsts.append(first[0])
        yield pd.DataFrame({"row_index": batch["row_index"], "cluster": firsts})


def time_clusters(events: DataFrame, by: str | None = None) -> DataFrame:
    """(row_index, cluster): the cluster is named by its first row; a row that does not fit closes the cluster before it.

    Rows are taken by start and row_index, those of each day by themselves if ``by`` names a
    date column. A short row more than the gap after the row before it starts a cluster
    whatever came before, so the order is cut there into runs. A run is folded in one task as
    a stream that keeps two rows; runs are spread over the tasks by ranges. Rows without a
    start are clusters of their own.
    """
    t = F.unix_micros("valid_from") / 1e6
    day = F.unix_date(by) if by else F.lit(0)
    rows = events.select("row_index", F.coalesce(day, F.lit(0)).alias("d"), t.alias("t"), F.coalesce(F.unix_micros("valid_to") / 1e6, F.lit(float("nan"))).alias("e"), "nations")
    alone = rows.where("t is null").select("row_index", F.col("row_index").alias("cluster"))
    ranged = staged(rows.where("t is not null").repartitionByRange("d", "t", "row_index").withColumn("part", F.spark_partition_id()))
    parts = Window.orderBy("part")  # a row for each range
    lasts = ranged.groupBy("part").agg(F.max(F.struct("d", "t")).alias("last"))
    lasts = lasts.select("part", F.lag("last").over(parts).alias("last"))
    within = Window.partitionBy("part").orderBy("d", "t", "row_index")
    marked = ranged.join(F.broadcast(lasts), "part").withColumn("before", F.coalesce(F.lag(F.struct("d", "t")).over(within), F.col("last")))
    short = F.isnan("e") | (F.col("e") - F.col("t") < OVERLAP * LONG_S)
    cut = F.col("before").isNull() | (F.col("before.d") != F.col("d")) | ((F.col("t") - F.col("before.t") > GAP_S) & short)
    marked = marked.withColumn("start", F.when(cut, F.struct("d", "t", "row_index")))
    carried = marked.groupBy("part").agg(F.max("start").alias("start"))
    carried = carried.select("part", F.last("start", True).over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    run = F.coalesce(F.last("start", True).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    runs = marked.join(F.broadcast(carried), "part").withColumn("run", run)
    runs = runs.select(F.col("run.d").alias("start_d"), F.col("run.t").alias("start_t"), F.col("run.row_index").alias("start_row"), "t", "row_index", "e", "nations")
    order = ("start_d", "start_t", "start_row")
    sorted_ = runs.repartitionByRange(*order).sortWithinPartitions(*order, "t", "row_index")
    return sorted_.mapInPandas(_fold, "row_index long, cluster long").unionByName(alone)


class Grouped(NamedTuple):
    """``launches``: a row for each; ``members``: the notices of launches with what these give them."""

    launches: DataFrame
    members: DataFrame


def zone_points() -> Column:
    """The centre of each zone of a notice, of its own centre where it has no zone."""
    zones = F.filter("zones", lambda z: F.size(z) > 0)
    whole = F.array(F.struct("lat", "lon"))
    return F.when(F.coalesce(F.size(zones), F.lit(0)) > 0, F.transform(zones, geo.centroid)).otherwise(whole)


def with_geometry(events: DataFrame) -> DataFrame:
    """``events`` with the points of what can be grouped and the shapes of zones, for rows that are repeated later: what ``grouped`` and ``advance_notices`` find here they do not work out again."""
    return events.withColumn("points", F.when(groupable(), zone_points())).withColumn("shapes", _shapes(F.col("zones")))


def grouped(events: DataFrame, sites: DataFrame, targets: tuple[str, ...] | None = None, by: str | None = None) -> Grouped:
    """Launches, numbered in time, with their window, site, course, orbit, range and best level, and their notices.

    events: the columns of ``analysis.analysed``; ``site_hints`` may lack. Several notices are a launch if one of them is sure enough and one
    secures the nation without the group; one notice is a launch if it stands by itself. A launch from a point at sea has
    ``at_sea`` and a site code that holds the position; its nation is one of ``targets``. The notices of a launch of
    several get its nation and site, and distance, course, orbit and reliability from there. With ``by``, a date column, each
    day's notices are grouped by themselves; row_index must then tell a notice's days apart. Without events there are none.
    """
    rows = staged(events.where(groupable()).withColumn("points", F.col("points") if "points" in events.columns else zone_points()))
    clustered = staged(rows.join(time_clusters(rows, by), "row_index").select("row_index", "cluster", "valid_from", "lat", "lon", "nations", "points", "radius_km", "fir_country", "nation", *(c for c in ("site_hints",) if c in rows.columns)))
    chosen = staged(tracks(clustered, with_choice(sites), targets)).withColumnRenamed("code", "group_site")
    places = sites.select(F.col("code").alias("group_site"), "place_lat", "place_lon", F.col("nation").alias("site_nation"))
    known = rows.join(chosen, "row_index").join(places, "group_site", "left")
    at_sea = F.col("sea_lat").isNotNull()
    in_group = F.col("group_site").isNotNull() | at_sea
    y, x = F.coalesce("sea_lat", "place_lat"), F.coalesce("sea_lon", "place_lon")
    # a column each, so that what stands in several others is worked out once
    known = known.withColumn("new_km", geo.haversine_km(y, x, F.col("lat"), F.col("lon"))).withColumn("new_course", geo.bearing_deg(y, x, F.col("lat"), F.col("lon")))
    # the notice of the platform itself has no course of its own
    known = known.withColumn("new_course", F.when(at_sea & (F.col("new_km") < TARGET_KM), F.col("sea_azimuth")).otherwise(F.col("new_course")))
    known = known.withColumn("new_slope", geo.inclination_deg(y, F.col("new_course")))
    km, course, slope = F.col("new_km"), F.col("new_course"), F.col("new_slope")
    given = lambda new, own: F.when(in_group, new).otherwise(F.col(own))
    members = known.select(
        *(c for c in rows.columns if c not in ("nation", "site", "distance_km", "azimuth", "inclination", "orbit", "reliability")),
        "cluster",
        "part",
        at_sea.alias("at_sea"),
        given(y, "lat").alias("site_lat"),
        given(x, "lon").alias("site_lon"),
        given(F.coalesce("sea_nation", "site_nation"), "nation").alias("nation"),
        given(F.coalesce("group_site", geo.derived_code(F.col("sea_lat"), F.col("sea_lon"))), "site").alias("site"),
        given(km, "distance_km").alias("distance_km"),
        given(course, "azimuth").alias("azimuth"),
        given(slope, "inclination").alias("inclination"),
        given(geo.orbit_class(slope), "orbit").alias("orbit"),
        given(geo.reliability(F.col("kind") == "Re-entry", F.lit(0.0), km), "reliability").alias("reliability"),
    )
    members = staged(members)
    best = F.element_at(F.array(*map(F.lit, aggregates.LEVELS)), F.min(aggregates.level_rank(F.col("level"))).cast("int"))
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct("valid_from", "row_index", *c)))
    built = members.groupBy("cluster", "part").agg(
        F.count("*").alias("n"),
        F.min("valid_from").alias("window_from"),
        F.max("valid_to").alias("window_to"),
        F.min("site").alias("site"),
        F.min("nation").alias("nation"),
        F.bool_or("at_sea").alias("at_sea"),
        F.min("site_lat").alias("site_lat"),
        F.min("site_lon").alias("site_lon"),
        F.min("inclination").alias("own_inclination"),
        F.min("orbit").alias("own_orbit"),
        F.min("reliability").alias("own_reliability"),
        geo.circular_mean(F.avg(F.sin(F.radians("azimuth"))), F.avg(F.cos(F.radians("azimuth")))).alias("course"),
        geo.angular_spread(F.collect_set("azimuth")).alias("spread"),
        F.min("distance_km").alias("nearest_km"),
        F.max("distance_km").alias("max_range_km"),
        best.alias("level"),
        F.bool_or(F.col("kind") == "Re-entry").alias("reentry"),
        F.bool_or("override").alias("override"),
        F.bool_or(aggregates.at_least(F.col("level")) | F.col("override")).alias("sure"),
        F.bool_or(~F.col("requires_group") | F.col("override")).alias("secured"),
        F.bool_or(F.col("status") == "OK").alias("ok"),
        F.array_distinct(F.transform(in_order("id"), lambda m: m["id"])).alias("ids"),
        F.sort_array(F.collect_set("fir")).alias("firs"),
    )
    one = F.col("n") == 1
    stands = F.when(one, F.col("ok") & F.col("secured")).otherwise(F.col("site").isNotNull() & F.col("sure") & F.col("secured"))
    slope = F.when(one, F.col("own_inclination")).otherwise(geo.inclination_deg(F.col("site_lat"), F.col("course")))
    # the cluster's first start orders its parts one after the other
    begun = clustered.groupBy("cluster").agg(F.min(F.unix_micros("valid_from")).alias("begun"))
    kept = built.where(stands).join(begun, "cluster").select(
        F.coalesce("begun", F.lit(2**62)).alias("begun"),
        "cluster",
        "part",
        "n",
        "window_from",
        "window_to",
        "site",
        "nation",
        "at_sea",
        F.when(~one, F.col("site_lat")).alias("site_lat"),
        F.when(~one, F.col("site_lon")).alias("site_lon"),
        F.col("course").alias("azimuth"),
        "spread",
        slope.alias("inclination"),
        F.when(one, F.col("own_orbit")).otherwise(geo.orbit_class(slope)).alias("orbit"),
        "max_range_km",
        F.when(one, F.col("own_reliability")).otherwise(geo.reliability(F.col("reentry"), F.col("spread"), F.col("nearest_km"))).alias("reliability"),
        "level",
        F.when(F.col("reentry"), "Re-entry").otherwise("Launch").alias("kind"),
        "override",
        "ids",
        "firs",
    )
    numbered = staged(aggregates.numbered_launches(staged(kept), ["begun", "cluster", "part"]).drop("begun"))
    of = numbered.select("cluster", "part", "label", "n")
    # a launch of several notices settles all of them
    settled = F.col("n") > 1
    joined = members.join(of, ["cluster", "part"]).withColumn("status", F.when(settled, "OK").otherwise(F.col("status")))
    return Grouped(numbered, joined.withColumn("requires_group", F.col("requires_group") & ~settled).drop("n"))


def launches(events: DataFrame, sites: DataFrame, targets: tuple[str, ...] | None = None) -> DataFrame:
    """The launches of ``grouped``."""
    return grouped(events, sites, targets).launches


def _shapes(points: Column) -> Column:
    """Centre and size of each zone that has a point; a zone of one point has the notice's radius."""
    return F.transform(F.filter(points, lambda z: F.size(z) > 0), lambda z: geo.zone_shape(z, F.col("radius_km")))


def advance_notices(events: DataFrame, found: Grouped, by: str | None = None) -> DataFrame:
    """(row_index, label, lead_hours): notices in review that announce exactly one launch, with the hours before its window.

    A notice announces a launch if the launch's nation is among its own, it runs a day and four
    times the window at least, holds the window, also within its daily hours where it has any,
    and one of its zones is congruent with one of the launch's. A boolean column ``hidden`` of
    events, if there is one, marks notices that stay as they are. The nations and weeks of a
    notice meet those of launches; in a week a nation has few. With ``by``, a date column, notices
    meet the launches of their day alone.
    """
    hidden = F.coalesce("hidden", F.lit(False)) if "hidden" in events.columns else F.lit(False)
    taken = found.members.select("row_index")
    open_ = events.where((F.col("status") == "REVIEW") & ~hidden & F.col("valid_from").isNotNull() & F.col("valid_to").isNotNull() & (F.size("zones") > 0))
    hours = timeparse.hours_between(F.col("valid_from"), F.col("valid_to"))
    open_ = open_.where(hours >= ADVANCE_HOURS).join(taken, "row_index", "left_anti")
    week = lambda t: F.floor(F.unix_seconds(t) / (7 * 86400))
    day = F.unix_date(by) if by else F.lit(0)
    zone_shapes = lambda rows: F.col("shapes") if "shapes" in rows.columns else _shapes(F.col("zones"))
    notices = open_.select(
        "row_index", day.alias("d"), "valid_from", "valid_to", hours.alias("hours"), timeparse.daily_windows(F.coalesce("daily", F.lit(""))).alias("daily"), zone_shapes(open_).alias("shapes"), "nations",
        F.explode(F.sequence(week(F.col("valid_from")), week(F.col("valid_to")))).alias("week"),
    )
    notices = notices.select("*", F.explode(F.concat("nations", F.array(F.lit(None).cast("string")))).alias("of")).drop("nations")
    shapes = found.members.select("label", F.explode(zone_shapes(found.members)).alias("shape")).groupBy("label").agg(F.collect_set("shape").alias("theirs"))
    starts = found.launches.where(F.col("site").isNotNull() & F.col("window_from").isNotNull())
    days = found.members.select("label", day.alias("d")).distinct()
    starts = starts.join(days, "label").select("label", "d", "nation", "window_from", F.coalesce("window_to", "window_from").alias("until"), week(F.col("window_from")).alias("week")).join(shapes, "label")
    fits = (F.col("valid_from") <= F.col("window_from")) & (F.col("until") <= F.col("valid_to"))
    fits &= F.col("hours") >= ADVANCE_TIMES * F.greatest(timeparse.hours_between(F.col("window_from"), F.col("until")), F.lit(0.0))
    # a launch without a nation is open to all notices
    met = notices.join(starts, (notices["d"] == starts["d"]) & (notices["week"] == starts["week"]) & notices["of"].eqNullSafe(starts["nation"])).where(fits)
    met = met.where(timeparse.within_daily(F.col("window_from"), F.col("until"), F.col("daily")))
    met = met.where(F.exists("shapes", lambda a: F.exists("theirs", lambda b: geo.zones_congruent(a, b))))
    lead = timeparse.hours_between(F.col("valid_from"), F.col("window_from"))
    only = met.groupBy("row_index").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label"), F.min(lead).alias("lead_hours")).where("n = 1")
    return only.select("row_index", "label", "lead_hours")


def with_advance(found: Grouped, events: DataFrame, advance: DataFrame) -> DataFrame:
    """The launches with advance_ids, advance_from and advance_hours, null where nothing announced them; nothing else changes."""
    noted = advance.select("row_index", "label").join(events.select("row_index", "id", "valid_from"), "row_index")
    first = F.array_sort(F.collect_list(F.struct("row_index", "id")))
    of = noted.groupBy("label").agg(F.transform(first, lambda m: m["id"]).alias("advance_ids"), F.min("valid_from").alias("advance_from"))
    joined = found.launches.join(of, "label", "left")
    return joined.withColumn("advance_hours", timeparse.hours_between(F.col("advance_from"), F.col("window_from")))


def settled_events(events: DataFrame, found: Grouped, advance: DataFrame) -> DataFrame:
    """``events`` with label, and with what launches give: members have their launch's nation, site and track; announcements
    have its nation, where they have none, and its site, are settled and of kind ``ADVANCE_KIND``. Other rows have no label."""
    given = ("nation", "site", "distance_km", "azimuth", "inclination", "orbit", "reliability", "status", "requires_group")
    theirs = found.members.select("row_index", F.struct("label", *given).alias("m"))
    starts = found.launches.select("label", F.col("nation").alias("l_nation"), F.col("site").alias("l_site"))
    early = advance.join(starts, "label").select("row_index", F.struct("label", F.col("l_nation").alias("nation"), F.col("l_site").alias("site")).alias("a"))
    rows = events.join(theirs, "row_index", "left").join(early, "row_index", "left")
    a, m = F.col("a").isNotNull(), F.col("m").isNotNull()
    new = {c: F.when(m, F.col(f"m.{c}")).otherwise(F.col(c)) for c in given}
    new |= {"nation": F.when(m, F.col("m.nation")).when(a, F.coalesce("nation", "a.nation")).otherwise(F.col("nation")), "site": F.when(m, F.col("m.site")).when(a, F.col("a.site")).otherwise(F.col("site"))}
    new |= {"status": F.when(a, "OK").otherwise(new["status"]), "requires_group": new["requires_group"] & ~a, "kind": F.when(a, ADVANCE_KIND).otherwise(F.col("kind"))}
    return rows.select(*((new.get(c, F.col(c))).alias(c) for c in events.columns), F.coalesce("m.label", "a.label").alias("label"))


def archive_rows(found: Grouped) -> DataFrame:
    """``ARCHIVE_COLUMNS`` as text, and key, for each launch with a site: one row a launch, its zones' centres as drop zones but for the platform's own."""
    number = lambda c, form: F.coalesce(F.format_string(form, c), F.lit(""))
    blank = F.lit("")
    away = lambda p: ~F.coalesce(F.col("at_sea") & (geo.haversine_km(p["lat"], p["lon"], F.col("site_lat"), F.col("site_lon")) < TARGET_KM), F.lit(False))
    zones = F.transform(F.filter("points", away), lambda p: F.format_string("%.4f %.4f", p["lat"], p["lon"]))
    in_order = F.array_sort(F.collect_list(F.struct("valid_from", "row_index", "id", zones.alias("zones"))))
    listed = found.members.groupBy("label").agg(in_order.alias("m"))
    rows = found.launches.where(F.col("site").isNotNull()).join(listed, "label")
    values = {
        "NOTAM": F.array_join(F.transform("m", lambda m: m["id"]), ", "),
        "Startdatum": F.coalesce(timeparse.stamped(F.col("window_from"), "dd.MM.yyyy"), blank),
        "Startzeit": F.coalesce(F.date_format("window_from", "HH:mm"), blank),
        "Nation": F.coalesce("nation", blank),
        "Weltraumbahnhof": F.col("site"),
        "Trägersystem": blank,
        "Payload": blank,
        "Orbit": F.when(F.col("orbit").isNull() | (F.col("orbit") == "Undetermined"), "-").otherwise(F.col("orbit")),
        "Inklination": F.when(F.col("inclination").isNotNull(), number(F.col("inclination"), "%.1f")).otherwise(blank),
        "Azimuth": F.when(F.col("azimuth").isNotNull(), number(F.col("azimuth"), "%.1f")).otherwise(blank),
        "Dropzones": F.array_join(F.array_distinct(F.flatten(F.transform("m", lambda m: m["zones"]))), "; "),
    }
    key = merge.archive_key(timeparse.stamped(F.col("window_from"), "dd.MM.yyyy"), F.transform("m", lambda m: m["id"]))
    return rows.select(key.alias("key"), F.col("label"), *(values[c].alias(c) for c in ARCHIVE_COLUMNS))


def complete(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archive rows that have all that ``ARCHIVE_NEEDS`` names, and the others, which are reported and not written."""
    full = F.lit(True)
    for c in ARCHIVE_NEEDS:
        full &= F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    return rows.where(full), rows.where(~full)
