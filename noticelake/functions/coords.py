"""Coordinates in notice texts, in seven notations, as Column expressions.

Each notation's pattern rewrites what it recognises into a token, in a fixed order, so
that a later pattern cannot read a part of what an earlier one took. One pass then reads
the tokens in the order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.geo import centroid, zone_shape

_GAP = r"[\s,/-]*"
_NUMBER = r"\d{1,2}(?:\.\d+)?"

#: (name, pattern, token); a token is ``form|latitude parts|N or S|longitude parts|E or W``.
NOTATIONS = (
    ("compact_suffix", rf"(?<![A-Z0-9.])(\d{{6}}|\d{{4}})(\.\d+)?\s*([NS]){_GAP}(\d{{7}}|\d{{5}})(\.\d+)?\s*([EW])(?![A-Z0-9])", "run|$1|$2||$3|$4|$5||$6"),
    ("compact_prefix", rf"(?<![A-Z0-9])([NS])\s*(\d{{6}}|\d{{4}})(\.\d+)?{_GAP}([EW])\s*(\d{{7}}|\d{{5}})(\.\d+)?(?![\d.]*\d)", "run|$2|$3||$1|$5|$6||$4"),
    ("dms_spaced", rf"(?<![\d.])(\d{{1,2}})\s+({_NUMBER})(?:\s+({_NUMBER}))?\s*([NS]){_GAP}(\d{{1,3}})\s+({_NUMBER})(?:\s+({_NUMBER}))?\s*([EW])(?![A-Z])", "dms|$1|$2|$3|$4|$5|$6|$7|$8"),
    ("dm_dash", rf"(?<![\d.])(\d{{1,2}})-({_NUMBER})(?:-({_NUMBER}))?\s*([NS]){_GAP}(\d{{1,3}})-({_NUMBER})(?:-({_NUMBER}))?\s*([EW])(?![A-Z])", "dms|$1|$2|$3|$4|$5|$6|$7|$8"),
    (
        "symbol_suffix",
        rf"(?<![\d.])(\d{{1,2}})°\s*(?:({_NUMBER})['′]\s*)?(?:({_NUMBER})[\"″]\s*)?([NS]){_GAP}(\d{{1,3}})°\s*(?:({_NUMBER})['′]\s*)?(?:({_NUMBER})[\"″]\s*)?([EW])(?![A-Z])",
        "dms|$1|$2|$3|$4|$5|$6|$7|$8",
    ),
    (
        "symbol_prefix",
        rf"(?<![A-Z0-9])([NS])\s*(\d{{1,2}})°\s*(?:({_NUMBER})['′]\s*)?(?:({_NUMBER})[\"″]?\s*)?{_GAP}([EW])\s*(\d{{1,3}})°\s*(?:({_NUMBER})['′]\s*)?(?:({_NUMBER})[\"″])?",
        "dms|$2|$3|$4|$1|$6|$7|$8|$5",
    ),
    ("decimal", rf"(?<![\d.])(\d{{1,2}}\.\d+)\s*°?\s*([NS]){_GAP}(\d{{1,3}}\.\d+)\s*°?\s*([EW])(?![A-Z])", "dms|$1|||$2|$3|||$4"),
)

_OPEN, _CLOSE = "\ue000", "\ue001"

#: Words that part the zones of one notice. A fixed pattern.
ZONE_BREAK = r"(?i)\bSIMILAR ACTIVITIES\b|\bAREA\s*(?:\d+|[A-Z])\b\s*:?|(?<![A-Z0-9])\(?[A-H1-9]\)(?=\s)|(?<![A-Z0-9.])\d\.(?=\s)|\bAND\s+(?=\d{6}(?:\.\d+)?\s*[NS])"


def tokenised(text: Column) -> Column:
    out = F.upper(text)
    for _, pattern, token in NOTATIONS:
        out = F.regexp_replace(out, pattern, f"{_OPEN}{token}{_CLOSE}")
    return out


def _angle(form: Column, a: Column, b: Column, c: Column, side: Column, limit: int, width: int) -> Column:
    """Degrees from the parts of a token; null for minutes or seconds of 60 and more, or beyond the limit. A fraction belongs to the smallest unit."""
    number = lambda x: F.coalesce(F.when(x != "", x).try_cast("double"), F.lit(0.0))
    run_degrees, run_minutes, run_seconds = F.substring(a, 1, width), F.substring(a, width + 1, 2), F.substring(a, width + 3, 2)
    has_seconds = run_seconds != ""
    degrees = F.when(form == "run", number(run_degrees)).otherwise(number(a))
    minutes = F.when(form == "run", number(run_minutes) + F.when(has_seconds, 0.0).otherwise(number(b))).otherwise(number(b))
    seconds = F.when(form == "run", number(run_seconds) + F.when(has_seconds, number(b)).otherwise(0.0)).otherwise(number(c))
    value = degrees + minutes / 60 + seconds / 3600
    signed = F.when(side.isin("S", "W"), -value).otherwise(value)
    return F.when((minutes < 60) & (seconds < 60) & (value <= limit), signed)


def _point(token: Column) -> Column:
    part = lambda i: F.element_at(F.split(token, r"\|"), i)
    lat = _angle(part(1), part(2), part(3), part(4), part(5), 90, 2)
    lon = _angle(part(1), part(6), part(7), part(8), part(9), 180, 3)
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def coordinates(text: Column) -> Column:
    """Array of struct(lat, lon) in the order of the text; invalid ones, (0, 0) and repeats within 0.001° of an earlier one are left out."""
    tokens = F.regexp_extract_all(tokenised(text), F.lit(f"{_OPEN}([^{_CLOSE}]*){_CLOSE}"), F.lit(1))
    points = F.filter(F.transform(tokens, _point), lambda p: p["lat"].isNotNull() & p["lon"].isNotNull() & ~((p["lat"] == 0) & (p["lon"] == 0)))

    def add(done: Column, p: Column) -> Column:
        near = F.exists(done, lambda q: (F.abs(q["lat"] - p["lat"]) < 1e-3) & (F.abs(q["lon"] - p["lon"]) < 1e-3))
        return F.when(near, done).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(points, F.array().cast("array<struct<lat:double,lon:double>>"), add)


def zones(text: Column) -> Column:
    """Array of zones, each an array of points; a part with fewer than three points belongs to the zone before it."""
    parts = F.filter(F.transform(F.split(text, ZONE_BREAK), coordinates), lambda z: F.size(z) > 0)

    def add(done: Column, zone: Column) -> Column:
        last = F.element_at(done, -1)
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, zone)))
        return F.when((F.size(done) > 0) & (F.size(zone) < 3), merged).otherwise(F.concat(done, F.array(zone)))

    return F.aggregate(parts, F.array().cast("array<array<struct<lat:double,lon:double>>>"), add)


def radius_km(text: Column) -> Column:
    """'RADIUS OF n NM' before 'n NM RADIUS'; more than 0 and at most 5000 km."""
    out = []
    for pattern in (r"(?i)RADIUS\s+(?:OF\s+)?(\d+(?:\.\d+)?)\s*(NM|KM)\b", r"(?i)(\d+(?:\.\d+)?)\s*(NM|KM)\s+RADIUS\b"):
        value = F.regexp_extract(text, pattern, 1)
        km = F.when(value != "", value).try_cast("double") * F.when(F.upper(F.regexp_extract(text, pattern, 2)) == "NM", 1.852).otherwise(1.0)
        out.append(F.when((km > 0) & (km <= 5000), km))
    return F.coalesce(*out)


def qline_point(text: Column) -> Column:
    """struct(lat, lon, radius_km) of 'ddmmNdddmmErrr' in a qualifier line, null without one."""
    pattern = r"(?i)(?<!\d)(\d{2})(\d{2})([NS])(\d{3})(\d{2})([EW])(\d{3})(?!\d)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = lambda i: F.when(part(i) != "", part(i)).try_cast("double")
    lat = (number(1) + number(2) / 60) * F.when(F.upper(part(3)) == "S", -1).otherwise(1)
    lon = (number(4) + number(5) / 60) * F.when(F.upper(part(6)) == "W", -1).otherwise(1)
    good = (number(2) < 60) & (number(5) < 60) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(good, F.struct(lat.alias("lat"), lon.alias("lon"), (number(7) * 1.852).alias("radius_km")))


def written_points(points: Column) -> Column:
    """Points as the archive keeps them: ``lat lon; lat lon`` with four decimals, each once."""
    return F.array_join(F.array_distinct(F.transform(points, lambda p: F.format_string("%.4f %.4f", p["lat"], p["lon"]))), "; ")


def read_points(text: Column) -> Column:
    """Array of struct(lat, lon) of such a text; parts that are not two numbers are left out."""
    part = lambda p, i: F.get(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double")
    points = F.transform(F.split(text, ";"), lambda p: F.struct(part(p, 0).alias("lat"), part(p, 1).alias("lon")))
    return F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


__all__ = ["NOTATIONS", "centroid", "coordinates", "qline_point", "radius_km", "read_points", "tokenised", "written_points", "zone_shape", "zones"]
