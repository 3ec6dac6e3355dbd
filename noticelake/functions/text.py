"""Parsing and scoring of notice texts as Column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.timeparse import daily_hours

#: Typographic characters by the plain one that stands for them; those under "" are dropped. Fixed values.
TYPOGRAPHY = {
    " ": "\u00a0\u2007\u202f\u2009",
    "'": "\u2018\u2019\u201a\u2032\u02b9",
    '"': "\u201c\u201d\u201e\u2033\u02ba",
    "-": "\u2010\u2011\u2013\u2014\u2212",
    "\u00b0": "\u00ba\u02da\u2218\u030a",
    "/": "\u2044\u2215",
    "": "\u200b\ufeff",
}

#: Characters of named entities with their semicolon, by the standard's table; names that it lacks stay as they are.
ENTITIES = {name[:-1]: character for name, character in html5.items() if name.endswith(";")}

#: Identifiers of notices: series, number and year; domestic ones; maritime warnings.
NOTICE_ID = r"\b(?:[A-Z]?\d{3,4}/\d{2}|!FDC \d+/\d+|NAVAREA [IVX]+ (?:WARNING )?\d+/\d{2})\b"

#: Where a notice begins in pasted text: an identifier, a domestic marker or a maritime warning at the start of a line. Fixed value.
BOUNDARY = r"(?im)^(?=[ \t]*(?:\(?[A-Z]?\d{3,4}/\d{2}\b|![A-Z]{3}\b|NAVAREA\s+[IVXLC]+\b))"

#: Labels that portals and mails put before a notice. Fixed value.
LABEL = r"(?im)^\s*(?:notam(?:\s*(?:text|nr\.?|number|id))?|message|meldung|quelle|source)\s*[:\-]\s*"

#: Words that announce activity in space. They match from the start of a word. Fixed values.
SPACE_WORDS = (
    "ROCKET", "SPACE LAUNCH", "LAUNCH", "DEBRIS", "FALLING DEBRIS", "DANGER AREA", "TEMPORARY RESTRICTED AREA", "RESTRICTED AREA",
    "AIRSPACE CLSD", "AIRSPACE CLOSED", "HAZARDOUS OPERATIONS", "ALTITUDE RESERVATION",
)
#: Ways to write that an area reaches from the ground without limit. Fixed values.
UNLIMITED_WORDS = (
    "SFC/UNL", "SFC TO UNL", "SFC-UNL", "SFC - UNL", "GND/UNL", "GND TO UNL", "GND-UNL", "GND - UNL",
    "SFC/UNLIMITED", "GND/UNLIMITED", "SFC-UNLIMITED", "GND-UNLIMITED", "SURFACE TO UNLIMITED",
)
#: Words that only space flight has. Fixed values.
STRONG_WORDS = (
    "ROCKET", "SPACE LAUNCH", "LAUNCH VEHICLE", "CARRIER ROCKET", "SPACE DEBRIS", "FALLING DEBRIS", "SATELLITE LAUNCH", "SPACECRAFT",
    "STAGE IMPACT", "BOOSTER", "REENTRY", "RE-ENTRY", "LAUNCH ACTIVITY", "LAUNCH OPERATION", "LAUNCH WINDOW", "SPACE ACTIVITY",
    "LAUNCH AREA", "JETTISON", "MISSILE LAUNCH", "LAUNCH MISSILE", "MISSILE MISSION", "RUSSIAN MISSILES", "SPACE LAUNCH AREA",
    "IMPACT AREA", "FALL AREA", "UNBURNED DEBRIS", "DEBRIS RETURN", "AEROSPACE FLT", "AEROSPACE FLIGHT", "SPACE FLT ACT",
)
#: Words of what is not space flight, whatever else the notice says. Fixed values.
EXCLUSION_WORDS = (
    "BALLOON", "SEARCHLIGHT", "GUN FRNG", "GUN FIRING", "AIR EXER", "PARACHUT", "SKYDIV", "GLIDER", "KITE", "FIREWORK", "PYROTECHNIC",
    "CRANE", "LASER", "UNMANNED ACFT", "UAS ", "UAV ", "DRONE", "MODEL ACFT", "AIRSHOW", "AIR SHOW", "ARTILLERY", "FIRING PRACTICE",
    "NAVAL SHIP", "FRNG", "FIRING", "ADS-B", "TIS-B", "FIS-B", "SURVEILLANCE REBROADCAST", "ALT RESERVATION", "AEROPAC",
    "EXPERIMENTAL ROCKETRY", "AMATEUR ROCKET", "HIGH POWER ROCKETRY", "MODEL ROCKET", "AIRSPACE USE PLAN", "AMC-MANAGEABLE", "TSA/TRA",
    "AUP", "AERIAL WORK", "WINDMILL", "OBST",
)
#: What items F and G start with for an area without limit, and the qualifier's band of all heights. Fixed values.
LOWEST, HIGHEST, ALL_HEIGHTS = ("SFC", "GND", "SURFACE", "GROUND"), ("UNL", "UNLIMITED", "UNLTD"), "000/999"
#: Sites that a vehicle, a programme or a place in the text stands for. Fixed values.
SITE_WORDS = {
    "STARSHIP": ("KBRO",), "STARBASE": ("KBRO",), "BOCA CHICA": ("KBRO",), "SUPER HEAVY": ("KBRO",),
    "FALCON 9": ("KXMR", "KTTS", "KVBG", "KCOI"), "FALCON HEAVY": ("KTTS", "KXMR"), "STARLINK": ("KXMR", "KTTS", "KVBG", "KCOI"),
    "CREW DRAGON": ("KTTS",), "NEW SHEPARD": ("K33",), "CORN RANCH": ("K33",), "NEW GLENN": ("KXMR", "KCOI"), "ATLAS V": ("KXMR", "KVBG", "KCOI"),
    "VULCAN": ("KXMR", "KCOI"), "DELTA IV": ("KXMR", "KVBG"), "ANTARES": ("KLFI",), "MINOTAUR": ("KLFI", "KVBG"), "CYGNUS": ("KLFI",),
    "WALLOPS": ("KLFI",), "ARTEMIS": ("KTTS",), "SPACE LAUNCH SYSTEM": ("KTTS",), "KENNEDY SPACE CENTER": ("KTTS",),
    "CAPE CANAVERAL": ("KXMR", "KCOI"), "VANDENBERG": ("KVBG",), "SPACEPORT AMERICA": ("9S2",), "VIRGIN GALACTIC": ("9S2",),
    "SPACESHIPTWO": ("9S2",), "MOJAVE AIR": ("KMHV",), "KODIAK": ("PACD",), "PACIFIC SPACEPORT": ("PACD",), "POKER FLAT": ("PABR",),
    "KWAJALEIN": ("PKWA",), "REAGAN TEST SITE": ("PKWA",),
    "JIUQUAN": ("JSLC",), "TAIYUAN": ("TSLC",), "XICHANG": ("XSLC",), "WENCHANG": ("WSLC",), "HAIYANG": ("HIIS", "HYOS"),
    "PLESETSK": ("GIK-1",), "VOSTOCHNY": ("VOSC", "SVOB"), "BAIKONUR": ("BAIK",), "KAPUSTIN": ("KAP-Y",),
    "SRIHARIKOTA": ("SDSC",), "SDSC": ("SDSC",), "THUMBA": ("TERLS",), "KULASEKARAPATTINAM": ("KSSL",),
    "SEMNAN": ("SSSC",), "SHAHROUD": ("SCSL",), "CHABAHAR": ("CSSC",),
    "SOHAE": ("KSS",), "TONGHAE": ("THSL",),
}
REENTRY_WORDS = ("RE-ENTRY", "REENTRY", "RE ENTRY", "DEORBIT", "SPLASHDOWN", "RECOVERY OF SPACECRAFT")
FULL_HEIGHT_CODES = r"(?:QR|QWM)"


def unescaped(text: Column) -> Column:
    """Named and numeric character entities as their characters, each once; unknown ones and those without a semicolon stay."""
    pattern = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")

    def character(entity: Column) -> Column:
        code = F.when(entity.rlike("^&#[xX]"), F.conv(F.regexp_extract(entity, "([0-9a-fA-F]+);$", 1), 16, 10)).when(entity.startswith("&#"), F.regexp_extract(entity, r"(\d+);$", 1))
        number = code.cast("int")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.coalesce(numbered, names[F.regexp_extract(entity, "^&([A-Za-z0-9]+);$", 1)], entity)

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), character)
    whole = F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def normalised(text: Column) -> Column:
    """Plain ASCII punctuation, entities resolved, zero-width characters dropped."""
    kept = {plain: signs for plain, signs in TYPOGRAPHY.items() if plain}
    return F.translate(unescaped(text), "".join(kept.values()) + TYPOGRAPHY[""], "".join(plain * len(signs) for plain, signs in kept.items()))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def pasted(text: Column) -> Column:
    """Text as it comes from mails and portals: ``normalised``, without labels, blanks and tabs as one blank, at most one empty line in a row."""
    lines = F.regexp_replace(F.regexp_replace(normalised(text), r"\r\n?", "\n"), LABEL, "")
    return stripped(F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def event_key(text: Column) -> Column:
    """Twelve hex digits that stay the same under case and white space."""
    return F.substring(F.md5(F.upper(collapsed(text))), 1, 12)


def at_boundaries(text: Column) -> Column:
    """Array of the parts of a pasted text: each starts at a line that begins like a notice, but for what stands before the first."""
    return F.filter(F.transform(F.split(pasted(text), BOUNDARY), stripped), lambda p: p != "")


def notice_blocks(text: Column) -> Column:
    """Array of the notices of a pasted text, cut at boundaries; blank lines part a text without a boundary or an identifier. A text of blanks has none."""
    by_lines = lambda p: F.filter(F.transform(F.split(p, r"\n\s*\n"), stripped), lambda x: x != "")
    one = lambda p: F.when(F.upper(p).rlike(NOTICE_ID), F.array(p)).otherwise(by_lines(p))
    return once(at_boundaries(text), lambda parts: F.when(F.size(parts) == 1, one(F.get(parts, F.lit(0)))).otherwise(parts))


def cut_block(block: Column) -> Column:
    """A notice without what follows it: it ends with the line of its last item G, else of F, else at the first empty line after E."""
    whole = stripped(block)
    line = lambda item: F.regexp_extract(whole, rf"(?s)^.*\b{item}\)[^\n]*", 0)
    text = F.regexp_extract(whole, r"(?s)^.*\bE\).*?(?=\n\s*\n|\z)", 0)
    ends = [F.nullif(x, F.lit("")) for x in (line("G"), line("F"), text)]
    return stripped(F.coalesce(*ends, whole))


def items(text: Column) -> Column:
    """Map of the items Q and A to G of a notice; the first occurrence that is not empty counts, and an item ends at `` | ``."""
    flat = collapsed(text)
    pattern = F.lit(r"\b([QABCDEFG])\)\s*(.*?)(?=\s*\b[QABCDEFG]\)|\s\|\s|$)")
    pairs = F.arrays_zip(F.regexp_extract_all(flat, pattern, F.lit(1)).alias("k"), F.regexp_extract_all(flat, pattern, F.lit(2)).alias("v"))
    filled = F.filter(pairs, lambda p: F.trim(p["v"]) != "")

    def add(done: Column, p: Column) -> Column:
        return F.when(F.exists(done, lambda q: q["k"] == p["k"]), done).otherwise(F.concat(done, F.array(F.struct(p["k"].alias("k"), F.trim(p["v"]).alias("v")))))

    return F.map_from_entries(F.aggregate(filled, F.array().cast("array<struct<k:string,v:string>>"), add))


def contained(text: Column, words: tuple[str, ...]) -> Column:
    """Array of the words that the text contains anywhere."""
    return once(F.upper(collapsed(text)), lambda flat: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(flat, w)))


def named_sites(text: Column, words: dict[str, tuple[str, ...]] = SITE_WORDS) -> Column:
    """struct(codes, evidence): the sites that the text's words stand for, each once in the order of the words, and these words; both empty without any."""
    none = F.array().cast("array<string>")
    if not words:
        return F.struct(none.alias("codes"), none.alias("evidence"))
    meant = F.create_map(*(x for word, codes in words.items() for x in (F.lit(word), F.array(*map(F.lit, codes)))))
    named = lambda found: F.struct(F.array_distinct(F.flatten(F.transform(found, lambda w: meant[w]))).alias("codes"), found.alias("evidence"))
    return once(F.coalesce(contained(text, tuple(words)), none), named)


def whole_words(text: Column, words: tuple[str, ...]) -> Column:
    """Array of the words that stand alone; a word that ends in a sign needs no boundary after it."""
    pattern = lambda w: rf"(?<![A-Z0-9])\Q{w}\E" + (r"(?![A-Z0-9])" if w[-1].isalnum() else "")
    found = lambda flat: F.array_compact(F.array(*(F.when(flat.rlike(pattern(w)), F.lit(w)) for w in map(str.strip, words))))
    return once(F.upper(collapsed(text)), found)


def triggers(text: Column, lower: Column, upper: Column, qualifier: Column) -> Column:
    """Array of what makes a notice worth a look: space words at word starts, unlimited heights, items F and G, the qualifier's 000/999."""
    starts = lambda c, words: F.upper(F.trim(c)).rlike("^(?:" + "|".join(words) + ")")
    heights = F.when(starts(upper, HIGHEST) & starts(lower, LOWEST), F.lit("SFC-UNL (F/G)"))

    def found(flat: Column) -> Column:
        spoken = [F.when(flat.rlike(rf"\b\Q{w}\E"), F.lit(w)) for w in SPACE_WORDS]
        high = [F.when(F.contains(flat, F.lit(w)), F.lit(w)) for w in UNLIMITED_WORDS]
        band = F.when(F.contains(qualifier, F.lit(ALL_HEIGHTS)) | F.contains(flat, F.lit(ALL_HEIGHTS)), F.lit("000/999 (Q)"))
        return F.array_distinct(F.array_compact(F.array(*spoken, *high, heights, band)))

    return once(F.upper(collapsed(text)), found)


def qcode(qualifier: Column, text: Column) -> Column:
    """Five letters from Q: of the Q item, else between slashes in the text; null without one."""
    first, second = F.regexp_extract(F.upper(qualifier), r"\b(Q[A-Z]{4})\b", 1), F.regexp_extract(F.upper(text), r"/(Q[A-Z]{4})/", 1)
    return F.coalesce(F.when(first != "", first), F.when(second != "", second))


def kind(text: Column) -> Column:
    """Re-entry if any of its words is there, even beside a launch."""
    return F.when(F.size(contained(text, REENTRY_WORDS)) > 0, "Re-entry").otherwise("Launch")


def altitude_profile(text: Column, lower: Column, upper: Column) -> Column:
    """Items F and G; else words for an unlimited height; else all heights of the qualifier; else flight levels; else ``-``."""
    both = F.when(lower.isNotNull() & upper.isNotNull(), F.concat_ws(" - ", lower, upper))
    words = F.get(contained(text, UNLIMITED_WORDS), F.lit(0))
    band = F.when(F.contains(collapsed(text), F.lit(ALL_HEIGHTS)), F.lit("FL000 - FL999"))
    level = lambda i: F.regexp_extract(F.upper(text), r"\b(FL\d{3})\s*[-/]\s*(FL\d{3})\b", i)
    return F.coalesce(both, words, band, F.when(level(1) != "", F.concat_ws(" - ", level(1), level(2))), F.lit("-"))


def launch_signature(code: Column, full_height: Column, hours: Column, text: Column) -> Column:
    """A code of danger areas or missiles, full height, both times and at most a day, or daily hours within it."""
    effective = F.least(hours, F.coalesce(daily_hours(text), hours))
    return F.coalesce(code.rlike("^" + FULL_HEIGHT_CODES) & full_height & (hours > 0) & (effective <= 24), F.lit(False))


def score(n_strong: Column, generic: Column, full_height: Column, band: Column, signature: Column, n_excluded: Column) -> Column:
    yes = lambda c, points: F.when(c, points).otherwise(0)
    return 3 * F.least(n_strong, F.lit(2)) + yes(generic, 1) + yes(full_height, 1) + yes(band, 1) + yes(signature, 3) - 4 * F.least(n_excluded, F.lit(2))


def level(points: Column, hours: Column, has_daily: Column) -> Column:
    """HIGH from 5, MEDIUM from 3, else LOW; never above LOW for over 720 hours without daily windows."""
    long = F.coalesce((hours > 720) & ~has_daily, F.lit(False))
    return F.when(long, "LOW").when(points >= 5, "HIGH").when(points >= 3, "MEDIUM").otherwise("LOW")


def notice_id(given: Column, text: Column, row: Column) -> Column:
    """The id column, else an identifier in the text, else ROW-n."""
    found = F.regexp_extract(F.upper(text), NOTICE_ID, 0)
    return F.coalesce(F.when(F.trim(given) != "", F.trim(given)), F.when(found != "", found), F.concat(F.lit("ROW-"), row.cast("string")))


def clean_payload(text: Column) -> Column:
    """One line of at most 200 characters; null where it would start a spreadsheet formula."""
    flat = F.substring(collapsed(text), 1, 200)
    return F.when(~flat.rlike(r"^[=+\-@]"), flat)


def most_named(hits: Column) -> Column:
    """The key of a map key -> count with strictly the most hits, null on a tie or without any."""
    ranked = F.sort_array(F.transform(F.map_entries(hits), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))), asc=False)
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when((best["n"] > 0) & (F.coalesce(second["n"], F.lit(0)) < best["n"]), best["k"])


def normalised_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")
