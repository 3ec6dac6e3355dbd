"""Result tables for readers: a row for each notice and each launch, with names in place of codes, and the reasons behind decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions import coords, geo, text, timeparse

NONE = "-"
BY_HAND = "by hand"

#: Names that readers see for nations and orbits; what is not here stays as it is. Fixed values.
NATION_NAMES = {"Russland": "Russia", "Indien": "India", "Nordkorea": "North Korea"}
ORBIT_NAMES = {
    "RETRO": "Retrograde",
    "SSO": "Sun-synchronous (SSO / polar)",
    "HIGH-INC": "High inclination / near-polar",
    "LEO/MEO": "Standard LEO / MEO (station corridor)",
    "GTO": "Equatorial / low inclination (GTO transit)",
}
#: The sign of notices that a person has confirmed. Fixed value.
MARK = "⬢"
#: Kilometres within which a zone lies on the site. Fixed value.
ON_SITE_KM = 1.0
NO_ZONES, ZONE_ON_SITE = "no drop zones to compute the orbit from", "zone on the launch site"


def named(value: Column, names: dict[str, str]) -> Column:
    """The name of a value, ``-`` for null or nothing."""
    found = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[value]
    return F.coalesce(found, F.nullif(value, F.lit("")), F.lit(NONE))


def marked_id(name: Column, by_hand: Column) -> Column:
    return F.when(F.coalesce(by_hand, F.lit(False)), F.concat(F.lit(MARK + " "), name)).otherwise(name)


def window_text(start: Column, end: Column) -> Column:
    """``from - to``, one side alone with its word, ``-`` without both. Fixed form."""
    stamp = lambda t: timeparse.stamped(t, "dd.MM.yyyy HH:mm'Z'")
    return F.coalesce(F.concat(stamp(start), F.lit(" - "), stamp(end)), F.concat(F.lit("ab "), stamp(start)), F.concat(F.lit("bis "), stamp(end)), F.lit(NONE))


def hours_text(hours: Column) -> Column:
    """Minutes below two hours, hours below two days, else days; unknown for null."""
    even = lambda value, digits, unit: F.format_string(f"%.{digits}f {unit}", F.bround(value, digits))
    return F.when(hours.isNull(), "unknown").when(hours < 2, even(hours * 60, 0, "minutes")).when(hours < 48, even(hours, 1, "hours")).otherwise(even(hours / 24, 0, "days"))


def hide_reason(level: Column, body: Column) -> Column:
    """Why a notice leaves the review by itself: its level is LOW and its text has exclusion words, of which four are named; empty if it stays."""
    return text.once(text.contained(body, text.EXCLUSION_WORDS), lambda hits: F.when((level == "LOW") & (F.size(hits) > 0), F.concat(F.lit("Low confidence with exclusion term(s): "), F.array_join(F.slice(hits, 1, 4), ", "), F.lit("."))).otherwise(""))


def track_from_site(lat: Column, lon: Column, zones: Column) -> Column:
    """struct(inclination, azimuth, orbit, note) of an archived launch as seen from a site; zones as the archive writes them.

    The course is the circular mean of the zones' courses. Without zones, or with one on the
    site, there is no track: two empty texts, ``-`` and the reason.
    """
    points = coords.read_points(F.coalesce(zones, F.lit("")))

    def of(found: Column) -> Column:
        on_site = F.exists(found, lambda p: geo.surface_km(lat, lon, p["lat"], p["lon"]) < ON_SITE_KM)
        note = F.when(F.size(found) == 0, NO_ZONES).when(on_site, ZONE_ON_SITE).otherwise("")
        total = lambda f: F.aggregate(F.transform(found, lambda p: f(F.radians(geo.bearing_deg(lat, lon, p["lat"], p["lon"])))), F.lit(0.0), lambda a, b: a + b)
        return F.struct(note.alias("note"), geo.circular_mean(total(F.sin), total(F.cos)).alias("course"))

    def written(track: Column) -> Column:
        slope = geo.inclination_deg(lat, track["course"])
        good = track["note"] == ""
        number = lambda value: F.when(good, F.format_string("%.1f", value)).otherwise("")
        short = F.when(good & (geo.orbit_class(slope) != "Undetermined"), geo.orbit_class(slope)).otherwise(NONE)
        return F.struct(number(slope).alias("inclination"), number(track["course"]).alias("azimuth"), short.alias("orbit"), track["note"].alias("note"))

    return text.once(text.once(points, of), written)


def _with_names(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """``rows`` with site_label: name and code of its site, the code alone where it has no name, ``-`` without a site."""
    if names is None:
        return rows.withColumn("site_label", F.coalesce("site", F.lit(NONE)))
    known = names.select(F.col("code").alias("site"), F.col("name").alias("site_name")).dropDuplicates(["site"])
    label = F.coalesce(F.concat("site_name", F.lit(" ("), "site", F.lit(")")), "site", F.lit(NONE))
    return rows.join(known, "site", "left").withColumn("site_label", label)


def _column(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def event_report(events: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row for each notice of ``launches.settled_events``; names: (code, name) of sites.

    Columns that events lack (source, vehicle, payload) show ``-``; numbers are rounded to a
    tenth and null where they are unknown. Null and empty texts show ``-``.
    """
    rows = _with_names(events, names)
    c, shown = lambda name, kind="string": _column(rows, name, kind), lambda value: F.coalesce(F.nullif(value, F.lit("")), F.lit(NONE))
    by_hand = F.coalesce("override", F.lit(False))
    return rows.select(
        "row_index",
        marked_id(F.col("id"), by_hand).alias("NOTAM ID"),
        F.when(by_hand, BY_HAND).otherwise(NONE).alias("Geprüft"),
        F.col("kind").alias("Art"),
        shown(c("label")).alias("Start"),
        shown(c("source")).alias("Quelle"),
        named(F.col("nation"), NATION_NAMES).alias("Startnation"),
        F.col("site_label").alias("Weltraumbahnhof"),
        window_text(F.col("valid_from"), F.col("valid_to")).alias("Startfenster (UTC)"),
        shown(c("fir")).alias("FIR Code"),
        shown(c("fir_country")).alias("FIR liegt in"),
        shown(c("altitude")).alias("Höhenprofil"),
        F.bround("azimuth", 1).alias("Launch Azimut (°)"),
        F.bround("inclination", 1).alias("Est. Inklination (°)"),
        F.coalesce(F.nullif(named(c("orbit"), ORBIT_NAMES), F.lit(NONE)), F.lit("Undetermined")).alias("Orbit-Typ"),
        shown(c("vehicle")).alias("Trägersystem"),
        shown(c("payload")).alias("Payload"),
        F.col("level").alias("Konfidenz"),
        c("reliability").alias("Zuverlässigkeit"),
        F.bround("distance_km", 1).alias("Distanz (km)"),
        F.coalesce(F.aggregate("zones", F.lit(0), lambda n, z: n + F.size(z)), F.lit(0)).alias("Punkte"),
        F.col("status").alias("Status"),
        F.array_join(c("triggers", "array<string>"), "; ").alias("Trigger"),
    )


def launch_report(launches: DataFrame, names: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """One row for each launch of ``launches.grouped``, with its announcements after ``with_advance``, its pads after
    ``sites.with_alternatives`` and its place in the archive by ``past.archive_notes``. What is unknown shows ``-``, numbers are null."""
    rows = _with_names(launches, names)
    if notes is not None:
        rows = rows.join(notes.select("label", "archive"), "label", "left")
    c, shown = lambda name, kind="string": _column(rows, name, kind), lambda value: F.coalesce(F.nullif(value, F.lit("")), F.lit(NONE))
    joined = lambda name: F.array_join(c(name, "array<string>"), ", ")
    early = F.concat(joined("advance_ids"), F.format_string(" (%.0f h)", F.bround(F.coalesce(c("advance_hours", "double"), F.lit(0.0)), 0)))
    pads = F.coalesce(F.size(c("site_alternatives", "array<string>")), F.lit(0)) > 0
    return rows.select(
        F.col("label").alias("Start"),
        F.col("kind").alias("Art"),
        named(F.col("nation"), NATION_NAMES).alias("Startnation"),
        F.col("site_label").alias("Weltraumbahnhof"),
        F.when(F.col("window_from").isNull(), NONE).otherwise(window_text(F.col("window_from"), F.col("window_to"))).alias("Startfenster (UTC)"),
        F.col("n").alias("Sperrzonen"),
        F.when(~pads, NONE).when(c("launch_site").isNotNull(), BY_HAND).otherwise("not determined").alias("Pad"),
        joined("ids").alias("NOTAMs"),
        F.when(F.size(c("advance_ids", "array<string>")) > 0, early).otherwise(NONE).alias("Vorankündigung"),
        F.when(F.coalesce("override", F.lit(False)), BY_HAND).otherwise(NONE).alias("Geprüft"),
        shown(joined("firs")).alias("FIR"),
        F.bround("azimuth", 1).alias("Launch Azimut (°)"),
        F.bround("inclination", 1).alias("Est. Inklination (°)"),
        F.coalesce(F.nullif(named(c("orbit"), ORBIT_NAMES), F.lit(NONE)), F.lit("Undetermined")).alias("Orbit-Typ"),
        shown(c("vehicle")).alias("Trägersystem"),
        shown(c("payload")).alias("Payload"),
        F.bround("max_range_km", 1).alias("Reichweite (km)"),
        F.bround("spread", 1).alias("Azimut-Streuung (°)"),
        F.col("level").alias("Konfidenz"),
        c("reliability").alias("Zuverlässigkeit"),
        shown(c("archive")).alias("Archiv"),
    )
