"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

Candidates are found by one pattern and validated: payment cards by their check digit,
phone numbers and network addresses by their form and ranges, dates by the calendar. Phone
numbers are permuted behind their calling code or trunk zero, so that the international and
the national notation of a number have the same digits. A validated value is permuted within its format under a key, so
equal values have equal pseudonyms in every document and different ones stay different.
Phone and national numbers walk along the permutation's cycle to the next number that is
valid as they are, so that their pseudonyms pass the same validation.
Digits run through a Feistel network over the digit halves; dates through one over the
days of four hundred years. Letters of mail addresses are replaced by a keyed digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "noticelake"
ROUNDS = 8

#: Kinds in the order in which they are tried at a position. Fixed patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
_APART, _ENDS = r"(?<![\d+])(?<!\d[./-])", r"(?!\d)(?![./-]\d)"
AMERICAN = r"(?:1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
TRUNK = r"(?:0[1-9](?:[ .-]\d{2}){4}|\(?0[1-9]\d{1,4}\)?(?: ?[/-] ?| )(?:\d{5,8}|\d{3,4}[ -]\d{3,4}))"
HOME = f"{_APART}(?:{AMERICAN}|{TRUNK}){_ENDS}"
#: Calling codes of one and two digits; all others have three. A fixed list.
CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)"
DATE = r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d-])"
NATIONAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)"
CARD_IN_THREE = r"(?<!\d)\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)"
#: Digits of valid numbers: ten of American ones, nine of national ones, and what follows a calling code or trunk zero.
AMERICAN_DIGITS, NATIONAL_DIGITS, TRUNK_DIGITS = r"[2-9](?!11|9)\d{2}[2-9](?!11)\d{6}", r"(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}", r"[1-9]\d*"
CANDIDATE = "|".join((EMAIL, PHONE, ADDRESS, DATE, NATIONAL, HOME, CARD, CARD_IN_THREE))

_A, _B = 189, 773  # the 146,097 days of four hundred years, as a product
_FIRST_DAY = "1801-01-01"
#: Steps along a cycle; each ends the walk of more than half of all numbers, so a longer one has a chance below 2^-64.
_WALK = 80


def permuted_digits(digits: Column, key: str = KEY) -> Column:
    """A digit string of 2 to 36 digits under a keyed permutation of the strings of its length."""
    n = F.length(digits)
    low = (n / 2).cast("int")
    high = n - low
    start = F.struct(F.substring(digits, F.lit(1), high).cast("long").alias("a"), F.substring(digits, high + 1, low).cast("long").alias("b"))
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")

    def step(state: Column, i: Column) -> Column:
        # the halves keep their lengths: each round adds a digest of one half to the other
        odd = i % 2 == 1
        mix = lambda half: F.pmod(F.xxhash64(F.lit(key), F.lit("digits"), i, n, half), F.lit(2**62))
        a = F.when(odd, F.pmod(state["a"] + F.pmod(mix(state["b"]), ten(high)), ten(high))).otherwise(state["a"])
        b = F.when(odd, state["b"]).otherwise(F.pmod(state["b"] + F.pmod(mix(state["a"]), ten(low)), ten(low)))
        return F.struct(a.alias("a"), b.alias("b"))

    mixed = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.aggregate(F.array(mixed), F.lit(""), lambda _, s: F.concat(F.lpad(s["a"].cast("string"), high, "0"), F.lpad(s["b"].cast("string"), low, "0")))


def walked_digits(digits: Column, valid: Callable[[Column], Column], key: str = KEY) -> Column:
    """The next digit string on the cycle of ``permuted_digits`` that is ``valid`` if and only if this one is: a permutation of the valid and of the other ones."""
    start = F.struct(digits.alias("start"), digits.alias("x"), F.lit(True).alias("on"))

    def step(state: Column, _: Column) -> Column:
        moved = F.transform(F.array(permuted_digits(state["x"], key)), lambda y: F.struct(state["start"].alias("start"), y.alias("x"), (valid(y) != valid(state["start"])).alias("on")))
        return F.when(state["on"], F.get(moved, F.lit(0))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, step, lambda s: s["x"])


def permuted_day(day: Column, key: str = KEY) -> Column:
    """A date of 1801 to 2200 under a keyed permutation of those days."""
    at = F.datediff(day, F.lit(_FIRST_DAY).cast("date"))
    start = F.struct((at / _B).cast("int").alias("a"), (at % _B).cast("int").alias("b"))

    def step(state: Column, i: Column) -> Column:
        odd = i % 2 == 1
        mix = lambda half, m: F.pmod(F.xxhash64(F.lit(key), F.lit("day"), i, half), F.lit(m)).cast("int")
        a = F.when(odd, F.pmod(state["a"] + mix(state["b"], _A), F.lit(_A))).otherwise(state["a"])
        b = F.when(odd, state["b"]).otherwise(F.pmod(state["b"] + mix(state["a"], _B), F.lit(_B)))
        return F.struct(a.alias("a"), b.alias("b"))

    mixed = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.aggregate(F.array(mixed), F.lit(_FIRST_DAY).cast("date"), lambda _, s: F.date_add(F.lit(_FIRST_DAY).cast("date"), s["a"] * _B + s["b"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def check_digit(payload: Column) -> Column:
    """The digit that makes ``payload`` followed by it pass the mod-10 check of payment cards."""
    reversed_ = F.split(F.reverse(payload), "")
    doubled = F.transform(F.filter(reversed_, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return ((10 - F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10) % 10).cast("string")


def passes_check(digits: Column) -> Column:
    n = F.length(digits)
    return check_digit(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1))


def _day(value: Column) -> Column:
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "dd.MM.yyyy"), F.try_to_date(value, "MM/dd/yyyy"), F.try_to_date(value, "dd/MM/yyyy"))


def kind_of(value: Column) -> Column:
    """email, phone, address, date, national or card; null if a candidate is not valid."""
    day = _day(value)
    octets = F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    digits = _digits(value)
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(value.startswith("+"), F.when(F.length(digits).between(8, 15), F.lit("phone")))
        .when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.when(octets, F.lit("address")))
        .when(value.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})$"), F.when(F.year(day).between(1801, 2200), F.lit("date")))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(digits.rlike(f"^{NATIONAL_DIGITS}$"), F.lit("national")))
        .when(value.rlike(f"^{AMERICAN}$"), F.when(digits.rlike(f"^1?{AMERICAN_DIGITS}$"), F.lit("phone")))
        .when(value.rlike(f"^{TRUNK}$"), F.when(F.length(digits).between(9, 12), F.lit("phone")))
        .when(F.length(digits).between(13, 19), F.when(passes_check(digits), F.lit("card")))
    )


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, c: Column) -> Column:
        digit = c.rlike(r"^\d$")
        return F.struct(
            F.concat(state["out"], F.when(digit, F.substring(digits, state["at"], F.lit(1))).otherwise(c)).alias("out"),
            (state["at"] + F.when(digit, 1).otherwise(0)).alias("at"),
        )

    return F.aggregate(letters, start, step, lambda s: s["out"])


def pseudonym(kind: Column, value: Column, key: str = KEY) -> Column:
    """The value's stand-in of the same form; an invalid candidate stays."""
    digits = _digits(value)
    n = F.length(digits)
    # what stays: the calling code and a trunk zero in brackets, the one of American numbers, or the trunk zero
    abroad = F.length(F.regexp_extract(digits, CALLING, 0)) + value.rlike(r"^\+\d{1,3}[ .-]?\(0\)").cast("int")
    whole = F.when(value.startswith("+"), abroad).when(value.rlike(f"^{TRUNK}$"), F.lit(1)).otherwise(n - 10)
    # American numbers are all of ten digits behind a one; others are told by their first digit
    american = F.substring(digits, F.lit(1), whole).isin("", "1")
    fits = lambda x: F.when(american, x.rlike(f"^{AMERICAN_DIGITS}$")).otherwise(x.rlike(f"^{TRUNK_DIGITS}$"))
    phone = F.concat(F.substring(digits, F.lit(1), whole), walked_digits(F.substring(digits, whole + 1, n), fits, key))
    payload = permuted_digits(F.substring(digits, F.lit(1), n - 1), key)
    card = F.concat(payload, check_digit(payload))
    # 2^32 addresses as two halves of sixteen bits
    parts = F.split(value, r"\.")
    part = lambda i: F.element_at(parts, i).cast("int")
    halves = F.struct((part(1) * 256 + part(2)).alias("a"), (part(3) * 256 + part(4)).alias("b"))

    def swap(state: Column, i: Column) -> Column:
        mix = F.pmod(F.xxhash64(F.lit(key), F.lit("address"), i, state["b"]), F.lit(65536)).cast("int")
        return F.struct(state["b"].alias("a"), F.pmod(state["a"] + mix, F.lit(65536)).alias("b"))

    dotted = lambda s: F.concat_ws(".", (s["a"] / 256).cast("int"), s["a"] % 256, (s["b"] / 256).cast("int"), s["b"] % 256)
    address = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, swap, dotted)
    day = permuted_day(_day(value), key)
    date = F.when(value.contains("."), F.date_format(day, "dd.MM.yyyy")).when(value.contains("/"), F.when(F.try_to_date(value, "MM/dd/yyyy").isNull(), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key), F.lit(":"), F.lower(value)), 256), 1, 16), F.lit("@example.invalid"))
    return (
        F.when(kind == "email", email)
        .when(kind == "phone", _refilled(value, phone))
        .when(kind == "address", address)
        .when(kind == "date", date)
        .when(kind == "national", _refilled(value, walked_digits(digits, lambda x: x.rlike(f"^{NATIONAL_DIGITS}$"), key)))
        .when(kind == "card", _refilled(value, card))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """One row per row of ``docs``: (id_col, found array<struct<kind, value, pseudonym>>, clean_text).

    A null text stays null and has nothing found; an empty one stays empty. Null and
    repeated ids keep their rows; other columns are not read. An empty table gives an
    empty result.
    """
    text = F.col(f"`{text_col}`")
    pattern = F.lit(CANDIDATE)
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias("text"), F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(0)).alias("values"))
    kinds = F.transform("values", lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value")))
    judged = rows.withColumn("judged", F.when(F.size("values") > 0, kinds).otherwise(F.array().cast("array<struct<kind:string,value:string>>")))
    named = F.transform("judged", lambda j: F.struct(j["kind"].alias("kind"), j["value"].alias("value"), pseudonym(j["kind"], j["value"], key).alias("pseudonym")))
    coded = judged.withColumn("coded", F.when(F.size("judged") > 0, named).otherwise(F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")))
    gaps = F.split("text", CANDIDATE, -1)
    filled = F.array_join(F.zip_with(gaps, F.transform("coded", lambda c: c["pseudonym"]), lambda gap, name: F.concat(gap, F.coalesce(name, F.lit("")))), "")
    return coded.select(id_col, F.filter("coded", lambda c: c["kind"].isNotNull()).alias("found"), F.when(F.size("coded") > 0, filled).otherwise(F.col("text")).alias("clean_text"))


def pii_report(docs: DataFrame) -> DataFrame:
    """Query columns: doc_id, n_found, kinds, pseudonyms, clean_text."""
    return pseudonymise(docs).select(
        "doc_id",
        F.size("found").cast("long").alias("n_found"),
        F.array_join(F.transform("found", lambda f: f["kind"]), ",").alias("kinds"),
        F.array_join(F.transform("found", lambda f: f["pseudonym"]), ",").alias("pseudonyms"),
        "clean_text",
    )
