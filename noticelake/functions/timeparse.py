"""Validity times of notices as Column expressions; all times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for an open time. Fixed values.
OPEN_ENDED = ("PERM", "PERMANENT", "UFN", "TBD", "WIE", "NAN", "NONE", "-", "")

#: Formats tried in this order after the digit forms.
FORMATS = ("d.M.yyyy H:mm", "yyyy-M-d H:mm[:ss]", "M/d/yyyy HHmm", "M/d/yyyy H:mm", "d MMM yyyy HHmm")
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS][XXX]", "yyyy-MM-dd", "d.M.yyyy")

MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def stamped(t: Column, form: str) -> Column:
    """``date_format`` with the year's digits alone: Java writes a sign before years beyond 9999."""
    return F.translate(F.date_format(t, form), "+", "")


def notice_time(value: Column) -> Column:
    """Timestamp of a validity field; null for an open or unreadable one.

    Ten digits are yyMMddHHmm of this century, twelve yyyyMMddHHmm. Marks of an estimated
    time are ignored.
    """
    text = F.trim(F.regexp_replace(F.trim(F.upper(value)), r"\s*(?:EST|APRX|APPROX|ESTIMATED)$", ""))
    digits = F.regexp_extract(text, r"^(\d{10}|\d{12})$", 1)
    numeric = F.when(F.length(digits) == 10, F.try_to_timestamp(F.concat(F.lit("20"), digits), F.lit("yyyyMMddHHmm"))).when(F.length(digits) == 12, F.try_to_timestamp(digits, F.lit("yyyyMMddHHmm")))
    titled = F.initcap(text)
    tried = [F.try_to_timestamp(titled, F.lit(f)) for f in FORMATS] + [F.try_to_timestamp(text, F.lit(f)) for f in ISO_FORMATS]
    return F.when(text.isin(*OPEN_ENDED), F.lit(None).cast("timestamp")).when(digits != "", numeric).otherwise(F.coalesce(*tried))


def navarea_period(text: Column) -> Column:
    """struct(valid_from, valid_to) of 'FROM ddHHmm UTC TO ddHHmm UTC MON yyyy', with Z or nothing for UTC; an end before the start is in the next month."""
    pattern = r"(?i)\bFROM\s+(\d{2})(\d{2})(\d{2})\s*(?:UTC|Z)?\s+TO\s+(\d{2})(\d{2})(\d{2})\s*(?:UTC|Z)?\s+([A-Z]{3})\s*(\d{4})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(part(7))).cast("string"), 2, "0")
    at = lambda i: F.try_to_timestamp(F.concat(part(8), month, part(i), part(i + 1), part(i + 2)), F.lit("yyyyMMddHHmm"))
    start, end = at(1), at(4)
    later = F.when(end < start, (end + F.expr("INTERVAL 1 MONTH"))).otherwise(end)
    return F.struct(start.alias("valid_from"), later.alias("valid_to"))


def daily_windows(text: Column) -> Column:
    """Array of struct(start, stop) in minutes of the day, for each HHMM-HHMM or HHMM/HHMM, with or without blanks; stop goes past 1440 over midnight."""
    pattern = F.lit(r"\b(\d{4})\s*[-/]\s*(\d{4})\b")
    minutes = lambda x: F.substring(x, 1, 2).cast("int") * 60 + F.substring(x, 3, 2).cast("int")
    valid = lambda x: (F.substring(x, 1, 2).cast("int") <= 24) & (F.substring(x, 3, 2).cast("int") < 60)
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("b"))
    kept = F.filter(pairs, lambda p: valid(p["a"]) & valid(p["b"]))
    return F.transform(kept, lambda p: F.struct(minutes(p["a"]).alias("start"), (minutes(p["b"]) + F.when(minutes(p["b"]) <= minutes(p["a"]), 1440).otherwise(0)).alias("stop")))


def daily_hours(text: Column) -> Column:
    """Hours of the longest daily window, null without one."""
    return F.array_max(F.transform(daily_windows(text), lambda w: (w["stop"] - w["start"]) / 60.0))


def within_daily(start: Column, end: Column, windows: Column) -> Column:
    """Whether [start, end] lies in one of the daily windows; true where there are none."""
    a = F.hour(start) * 60 + F.minute(start)
    b = a + F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60)
    inside = lambda w: F.exists(F.array(F.lit(0), F.lit(1440)), lambda o: (a + o >= w["start"]) & (b + o <= w["stop"]))
    return (F.size(windows) == 0) | F.exists(windows, inside)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9


def overlap_ratio(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Common time over the longer of two windows; 0 if they do not meet or both are empty."""
    common = hours_between(F.greatest(start1, start2), F.least(end1, end2))
    longer = F.greatest(hours_between(start1, end1), hours_between(start2, end2))
    return F.when((common > 0) & (longer > 0), common / longer).otherwise(0.0)


def expired(end: Column, now: Column, grace_hours: int = 24) -> Column:
    return end + F.expr(f"INTERVAL {grace_hours} HOURS") < now
