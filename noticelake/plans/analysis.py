"""From a table of notices to attributed events: parse, score, find the airspace and the site, decide.

Every step is a column expression or a join with a small checked reference. Parsed notices are
written once, as several joins read them; only keys and choices move, a row for each notice
after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions import coords, geo, text, timeparse
from noticelake.operators import joins
from noticelake.operators.sites import with_choice
from noticelake.operators.staging import spread, worked_out
from noticelake.operators.staging import written as staged
from noticelake.plans import attribution

#: Columns that a notice table must have; all but row_index are text and may be null.
NOTICE_COLUMNS = ("row_index", "id", "text", "fir", "valid_from", "valid_to", "qline")

#: Distance up to which the nearest airspace counts where a notice names none.
AIRSPACE_CAP_KM = 1500.0

_CODES = (r"\b([A-Z]{4})\b", r"\b(Z[A-Z]{2})\b")


def airspace_codes(*texts: Column) -> Column:
    """Array of the codes in the order of the texts; in each, four letters before three that start with Z."""
    found = [F.regexp_extract_all(F.coalesce(F.upper(t), F.lit("")), F.lit(pattern), F.lit(1)) for t in texts for pattern in _CODES]
    return F.array_distinct(F.flatten(F.array(*found)))


def parsed(notices: DataFrame) -> DataFrame:
    """Notices that have a trigger, with what their text says: items, times, zones, kind, score and level."""
    c = F.col
    rows = worked_out(spread(notices.select(*NOTICE_COLUMNS)), "plain", text.normalised(F.coalesce("text", F.lit(""))))
    rows = worked_out(rows, "items", text.items(c("plain")))
    item = lambda k: F.get(F.map_values(F.map_filter("items", lambda key, _: key == k)), F.lit(0))
    q, low, high = F.coalesce("qline", item("Q")), item("F"), item("G")
    rows = worked_out(rows, "triggers", text.triggers(c("plain"), low, high, F.coalesce(q, F.lit("")))).where(F.size("triggers") > 0)
    sea = timeparse.navarea_period(c("plain"))
    start = F.coalesce(timeparse.notice_time(c("valid_from")), timeparse.notice_time(item("B")), sea["valid_from"])
    end = F.coalesce(timeparse.notice_time(c("valid_to")), timeparse.notice_time(item("C")), sea["valid_to"])
    body = F.coalesce(item("E"), c("plain"))
    in_body = coords.zones(body)
    rows = rows.select(
        "row_index",
        text.notice_id(c("id"), c("plain"), c("row_index")).alias("id"),
        text.event_key(c("plain")).alias("key"),
        "plain",
        "triggers",
        q.alias("q"),
        low.alias("low"),
        high.alias("high"),
        start.alias("valid_from"),
        end.alias("valid_to"),
        airspace_codes(c("fir"), item("A"), F.split(F.coalesce(q, F.lit("")), "/")[0]).alias("codes"),
        F.when(F.size(in_body) > 0, in_body).otherwise(coords.zones(c("plain"))).alias("zones"),
        F.coalesce(coords.radius_km(body), coords.radius_km(c("plain"))).alias("text_radius"),
        coords.qline_point(F.coalesce(q, c("plain"))).alias("spot"),
        F.coalesce(item("D"), F.lit("")).alias("daily"),
    )
    spot = F.array(F.array(F.struct("spot.lat", "spot.lon")))
    rows = rows.withColumn("zones", F.when((F.size("zones") == 0) & c("spot").isNotNull(), spot).otherwise(c("zones")))
    rows = rows.withColumn("radius_km", F.coalesce("text_radius", "spot.radius_km")).withColumn("centre", geo.centroid(F.flatten("zones")))
    hours = timeparse.hours_between(c("valid_from"), c("valid_to"))
    daily = timeparse.daily_hours(c("plain"))
    full = F.coalesce(F.upper("high").rlike("^(?:UNL|FL999)"), F.lit(False)) | (F.size(text.contained(c("plain"), text.UNLIMITED_WORDS)) > 0)
    band = F.coalesce(c("q").rlike("/000/999/"), F.lit(False))
    strong = F.size(text.contained(c("plain"), text.STRONG_WORDS))
    generic = F.size(text.whole_words(c("plain"), text.SPACE_WORDS)) > 0
    signature = text.launch_signature(text.qcode(c("q"), c("plain")), full | band, hours, c("plain"))
    excluded = F.size(text.contained(c("plain"), text.EXCLUSION_WORDS))
    scored = rows.withColumn("points", text.score(strong, generic, full, band, signature, excluded).cast("int"))
    return scored.select(
        "row_index",
        "id",
        "key",
        "plain",
        "codes",
        "triggers",
        "valid_from",
        "valid_to",
        "zones",
        "radius_km",
        c("centre.lat").alias("lat"),
        c("centre.lon").alias("lon"),
        "points",
        text.level(c("points"), hours, daily.isNotNull()).alias("level"),
        text.kind(c("plain")).alias("kind"),
        text.altitude_profile(c("plain"), c("low"), c("high")).alias("altitude"),
        "daily",
    )


def located(rows: DataFrame, firs: DataFrame) -> DataFrame:
    """``rows`` with fir, fir_method, fir_km, fir_nations and fir_country.

    A code that the notice names decides, even one outside the reference; without any the whole
    text is searched; then the nearest airspace counts, up to ``AIRSPACE_CAP_KM``.
    firs: (code, place_lat, place_lon, ord, nations array, country).
    """
    named = joins.first_known(rows, "row_index", "codes", firs).select("row_index", F.col("code").alias("named"), F.col("method").alias("named_method"))
    spoken = rows.where(F.size("codes") == 0).select("row_index", airspace_codes(F.col("plain")).alias("spoken_codes"))
    spoken = joins.first_known(spoken, "row_index", "spoken_codes", firs).select("row_index", F.col("code").alias("spoken"))
    near = joins.nearest_any(rows.where(F.col("lat").isNotNull()), "row_index", firs).select("row_index", F.col("code").alias("near"), F.col("distance_km").alias("near_km"))
    joined = rows.join(named, "row_index").join(spoken, "row_index", "left").join(near, "row_index", "left")
    open_ = F.col("named_method") == "-"
    close = F.col("near_km") <= AIRSPACE_CAP_KM
    code = F.coalesce("named", F.when(open_, F.coalesce("spoken", F.when(close, F.col("near")))))
    method = (
        F.when(~open_, F.col("named_method"))
        .when(F.col("spoken").isNotNull(), "text")
        .when(close, "geo")
        .when(F.col("near_km").isNotNull(), F.concat(F.lit("too_far:"), F.round("near_km").cast("long").cast("string"), F.lit(" km")))
        .otherwise("-")
    )
    known = firs.select(F.col("code").alias("fir"), F.col("nations").alias("fir_nations"), F.col("country").alias("fir_country")).dropDuplicates(["fir"])
    found = joined.withColumn("fir", code).withColumn("fir_method", method).withColumn("fir_km", F.when(method == "geo", F.col("near_km")))
    return found.join(F.broadcast(known), "fir", "left").drop("named", "named_method", "spoken", "near", "near_km")


def named_nation(plain: Column, hints: dict[str, tuple[str, ...]]) -> Column:
    """The nation that the text names strictly most often by the words of ``hints``, null without one."""
    if not hints:
        return F.lit(None).cast("string")
    return text.most_named(F.create_map(*(x for nation, words in hints.items() for x in (F.lit(nation), F.size(text.whole_words(plain, words))))))


def analysed(
    notices: DataFrame,
    sites: DataFrame,
    firs: DataFrame,
    targets: tuple[str, ...],
    hints: dict[str, tuple[str, ...]] | None = None,
    foreign: tuple[str, ...] = (),
    confirmed: DataFrame | None = None,
    rejected: DataFrame | None = None,
    site_words: dict[str, tuple[str, ...]] = text.SITE_WORDS,
) -> DataFrame:
    """One row for each notice with a trigger, attributed by the decision list; ``status`` is OK or REVIEW.

    notices: ``NOTICE_COLUMNS`` with a unique row_index; sites: (code, place_lat, place_lon, ord,
    nation); firs: as for ``located``. ``confirmed`` and ``rejected`` hold the event keys (key)
    that a person has decided. A site is sought among those of the nations in question, or
    among all where these have none; of sites that zones cannot tell apart the first alone counts
    (``operators.sites``). Where words of ``site_words`` name sites of the reference, the choice is
    among those: the ones in question, or else all that are named, since the text is the stronger
    source. Without notices the result is empty.
    """
    rows = staged(located(staged(parsed(notices)), firs)).withColumn("hint", named_nation(F.col("plain"), hints or {}))
    for name, keys in (("confirmed", confirmed), ("rejected", rejected)):
        if keys is None:
            rows = rows.withColumn(name, F.lit(False))
        else:
            rows = rows.join(keys.select("key").distinct().withColumn(name, F.lit(True)), "key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    every = F.array(*map(F.lit, targets))
    ours = F.array_intersect(F.coalesce("fir_nations", F.array().cast("array<string>")), every)
    hinted = F.col("hint").isin(*targets)
    nations = F.when(hinted, F.array("hint")).when(F.col("confirmed") & (F.size(ours) == 0), every).otherwise(ours)
    rows = rows.withColumn("nations", nations).withColumn("said", text.named_sites(F.col("plain"), site_words))
    choice = staged(with_choice(sites.select("code", "place_lat", "place_lon", "ord", "nation")))
    # nations without a site of their own leave all sites in question
    have_sites = choice.where("auto").agg(F.collect_set("nation").alias("n")).scalar()
    where = rows.where(F.col("lat").isNotNull()).select("row_index", "lat", "lon", "nations", F.col("said.codes").alias("said"))
    where = where.withColumn("bound", F.coalesce(F.arrays_overlap("nations", have_sites), F.lit(False)))

    def rank(site: Column) -> Column:
        fits = site["auto"] & (~F.col("bound") | F.coalesce(F.array_contains("nations", site["nation"]), F.lit(False)))
        named = F.array_contains("said", site["code"])
        return F.when(named & fits, 0).when(named, 1).when(fits, 2)

    chosen = joins.nearest_by_direction(where, "row_index", choice, rank=rank, carried=("nation", "place_lat"), ranked=("auto",))
    chosen = chosen.select("row_index", F.col("code").alias("site"), F.col("nation").alias("site_nation"), "place_lat", "distance_km", "azimuth", "odd")
    placed = rows.join(chosen, "row_index", "left")
    inputs = attribution.Inputs(
        foreign=F.size(text.whole_words(F.col("plain"), foreign)) > 0 if foreign else F.lit(False),
        hint=F.col("hint"),
        hint_is_target=hinted,
        confirmed=F.col("confirmed"),
        rejected=F.col("rejected"),
        has_centroid=F.col("lat").isNotNull(),
        fir_method=F.col("fir_method"),
        fir_nations=ours,
        fir_country_is_target=F.col("fir_country").isin(*targets),
        fir_distance_km=F.col("fir_km"),
        level=F.col("level"),
        has_site=F.col("site").isNotNull(),
        distance_km=F.col("distance_km"),
        implausible=F.col("odd"),
    )
    decided = placed.withColumn("decision", attribution.decided(inputs))
    tracked = F.col("distance_km") >= 1
    slope = F.when(tracked, geo.inclination_deg(F.col("place_lat"), F.col("azimuth")))
    return decided.select(
        "row_index",
        "id",
        "key",
        "kind",
        "triggers",
        "points",
        "level",
        "altitude",
        "daily",
        "valid_from",
        "valid_to",
        "zones",
        "radius_km",
        "lat",
        "lon",
        "fir",
        "fir_method",
        "fir_country",
        F.when(F.col("decision.status") == "OK", F.col("site_nation")).alias("nation"),
        "nations",
        "site",
        "distance_km",
        F.when(tracked, F.col("azimuth")).alias("azimuth"),
        slope.alias("inclination"),
        geo.orbit_class(slope).alias("orbit"),
        geo.reliability(F.col("kind") == "Re-entry", F.lit(0.0), F.col("distance_km")).alias("reliability"),
        "decision.branch",
        "decision.status",
        "decision.requires_group",
        F.col("confirmed").alias("override"),
        F.col("said.codes").alias("site_hints"),
        F.col("said.evidence").alias("site_evidence"),
    )
