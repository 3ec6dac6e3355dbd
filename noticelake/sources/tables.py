"""Reading of notice tables, pasted texts, catalogues and saved pages."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.functions import text
from noticelake.functions.text import normalised_name
from noticelake.functions.timeparse import notice_time
from noticelake.operators.staging import spread, worked_out

#: Normalised header names by role. Fixed values.
ROLE_HINTS = {
    "id": ("notamid", "id", "notamnumber", "number", "notam", "seriesnumber", "ref"),
    "text": ("text", "notamtext", "message", "rawtext", "body", "eitem", "full"),
    "fir": ("fir", "ficir", "firicao", "icao", "location", "loc", "aerodrome", "icaocode"),
    "start": ("validfrom", "startvalidity", "start", "from", "begin", "bitem", "effective"),
    "end": ("validto", "endvalidity", "end", "to", "until", "citem", "expiry"),
    "qline": ("qline", "qcode", "q", "qitem"),
}

#: First bytes of the two kinds of spreadsheet files. Fixed values.
SPREADSHEETS = ("\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "PK\x03\x04")

#: Lines in which a header is sought, cells that it has at least, characters of a cell at most. Fixed values.
HEADER_ROWS, HEADER_CELLS, HEADER_CHARS = 25, 3, 60


def read_text_table(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, every column as text."""
    return spark.read.csv(path, sep=sep, encoding=encoding, header=True, inferSchema=False, multiLine=True, escape='"')


def plain_name(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum() and c.isascii())


def _delimiter(lines: list[str]) -> str:
    """The sign of ``,;|`` and tab that the head of a file points to, a comma if none does."""
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=",;\t|").delimiter
    except csv.Error:
        counts = {d: sum(line.count(d) for line in lines) for d in ",;\t|"}
        return max(counts, key=counts.get)


def _is_header(cells: list[str]) -> bool:
    filled = [c.strip() for c in cells if c.strip()]
    return len(filled) >= HEADER_CELLS and all(len(c) <= HEADER_CHARS for c in filled)


def _column_names(cells: list[str], width: int) -> list[str]:
    """Trimmed names, numbered where they are empty or repeat, also in another case."""
    names: list[str] = []
    for i in range(width):
        name = plain = (cells[i].strip() if i < len(cells) else "") or f"column_{i + 1}"
        k = 1
        while name.lower() in (n.lower() for n in names):
            k += 1
            name = f"{plain}_{k}"
        names.append(name)
    return names


def read_notice_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file as text columns, whatever its delimiter, its encoding (UTF-8, else Latin-1) and the lines above its header.

    The first row is the header, unless half of its cells or more are empty: then the first of
    the first 25 rows that has three cells or more, none over 60 characters, is. Only these
    lines come to the driver. Rows above the header, and rows without any value, are left out.
    The path is one file; cells may hold line breaks, so a file is one task: split large
    exports into files. A spreadsheet, told by its first bytes, raises ValueError, and so does
    a file without a row.
    """
    raw = spark.read.text(path, lineSep="\n")
    head = [bytes(r.line) for r in raw.select(F.col("value").cast("binary").alias("line")).take(4 * HEADER_ROWS)]
    if head and head[0].startswith(tuple(s.encode("latin-1") for s in SPREADSHEETS)):
        raise ValueError(f"{path}: a spreadsheet; export it as delimited text")
    # a byte sequence that is no UTF-8 anywhere in the file makes all of it Latin-1
    broken = raw.where(~F.is_valid_utf8("value")).limit(1).count() > 0
    encoding = "ISO-8859-1" if broken else "UTF-8"
    lines = [b.decode("latin-1" if broken else "utf-8-sig", errors="replace").rstrip("\r") for b in head]
    if not any(line.strip() for line in lines):
        raise ValueError(f"{path}: no rows")
    sep = _delimiter([line for line in lines if line.strip()])
    rows = [r for r in csv.reader((line + "\n" for line in lines), delimiter=sep) if r]
    width = max(map(len, rows))
    sparse = width > 1 and sum(1 for c in rows[0] + [""] * (width - len(rows[0])) if not c.strip()) >= width / 2
    at = next((i for i, r in enumerate(rows[:HEADER_ROWS]) if _is_header(r)), 0) if sparse else 0
    names = _column_names(rows[at], width)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    read = spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, header=False, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=True)
    filled = F.lit(False)
    for n in names:
        filled |= F.trim(F.col(f"`{n.replace('`', '``')}`")) != ""
    # a file of several lines a cell is read by one task from its start, so its rows are numbered in order
    return read.withColumn("_row", F.monotonically_increasing_id()).where(F.col("_row") > at).where(F.coalesce(filled, F.lit(False))).drop("_row")


def column_roles(df: DataFrame, hints: dict[str, tuple[str, ...]] = ROLE_HINTS, left_out: tuple[str, ...] = ()) -> dict[str, str]:
    """role -> column. The text column comes first and has no other role: by exact name, then by part of a name, else the one with the longest values on average.

    The other roles take the first column of an exact name, else the first without a role whose name holds a hint.
    """
    names = {c: plain_name(c) for c in df.columns if c not in left_out}
    if not names:
        return {}
    exact = lambda role, of: next((c for c in of if names[c] in hints[role]), None)
    partial = lambda role, of: next((c for c in of if any(h in names[c] for h in hints[role])), None)
    longest = exact("text", names) or partial("text", names)
    if longest is None:
        means = df.agg(*(F.avg(F.length(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(names))).first()
        longest = max(enumerate(names), key=lambda c: (means[c[0]] or 0.0, -c[0]))[1]
    roles = {"text": longest}
    rest = [c for c in names if c != longest]
    for role in hints:
        if role != "text":
            found = exact(role, rest) or partial(role, [c for c in rest if c not in roles.values()])
            if found:
                roles[role] = found
    return roles


def notices_of_table(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """The columns that ``analysis.analysed`` takes but row_index, from a table of any columns: roles found by name, the text with the other columns' values behind it."""
    found = roles or column_roles(df)
    role = lambda r: F.col(f"`{found[r]}`").cast("string") if r in found else F.lit(None).cast("string")
    return df.select(role("id").alias("id"), row_text(df, found["text"]).alias("text"), role("fir").alias("fir"), role("start").alias("valid_from"), role("end").alias("valid_to"), role("qline").alias("qline"))


def pasted_notices(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, pos, notice_id, start, text, usable): the notices of pasted texts and saved posts, one row for each part that begins like a notice.

    A notice is usable if it has an identifier, an item E or Q and a readable first time in B;
    its text ends with its last item, so remarks below it are left out. The others are counted
    by ``usable``: false, with nulls. What stands before the first notice is talk and gives no row;
    nor does a null or empty text.
    """
    parts = spread(texts.select(id_col, text_col)).select(id_col, F.posexplode(text.at_boundaries(F.col(text_col))).alias("pos", "part"))
    begins = parts.select(id_col, "pos", "part", F.upper(F.regexp_extract("part", r"(?i)^\(?([A-Z]?\d{3,4}/\d{2})\b", 1)).alias("head"))
    begins = begins.where((F.col("head") != "") | F.upper("part").rlike("^(?:!|NAVAREA)"))
    cut = worked_out(begins, "block", text.cut_block(F.col("part")))
    cut = worked_out(cut, "items", text.items(F.col("block")))
    start = F.split(F.col("items")["B"], " ")[0]
    body = F.coalesce(F.col("items")["E"], F.col("items")["Q"]).isNotNull()
    usable = (F.col("head") != "") & body & text.once(start, notice_time).isNotNull()
    judged = worked_out(cut, "usable", usable)
    shown = lambda c: F.when(F.col("usable"), c)
    return judged.select(id_col, "pos", shown(F.col("head")).alias("notice_id"), shown(start).alias("start"), shown(F.col("block")).alias("text"), "usable")


def corpus_rows(notices: DataFrame, id_col: str) -> DataFrame:
    """(key, ord, text, source) of usable notices, for ``operators.merge.merged_corpus``: a notice is known by its identifier and start."""
    key = F.concat_ws("|", "notice_id", "start")
    return notices.where("usable").select(key.alias("key"), F.struct(F.col(id_col), F.col("pos")).alias("ord"), "text", F.col(id_col).cast("string").alias("source"))


def row_text(df: DataFrame, text_col: str, left_out: tuple[str, ...] = ()) -> Column:
    """The text followed by `` | column: value`` for every other column that has a value."""
    others = [c for c in df.columns if c != text_col and c not in left_out]
    value = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    return F.concat_ws(" | ", F.col(f"`{text_col}`"), *(F.concat(F.lit(f"{c}: "), value(c)) for c in others))


def reference_table(df: DataFrame, required: tuple[str, ...], key: str, lat: str, lon: str) -> DataFrame:
    """Rows with a key and coordinates, the key in capitals, decimal commas read as points; raises if a column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = lambda c: F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    out = df.withColumn(key, F.upper(F.trim(key))).withColumn(lat, number(F.col(lat))).withColumn(lon, number(F.col(lon)))
    return out.where((F.col(key) != "") & F.col(lat).isNotNull() & F.col(lon).isNotNull())


def launch_catalogue(lines: DataFrame, first_year: int = 2020, last_year: int = 2026) -> DataFrame:
    """Orbital launches of a tab-separated catalogue (value string): tag, at, date_only, vehicle, payload, site, inclination, azimuth.

    Lines that begin with ``#``, have too few fields, another kind of tag, an impossible date
    or another year are left out.
    """
    f = F.split("value", "\t")
    field = lambda i: F.nullif(F.trim(F.get(f, F.lit(i))), F.lit("-"))
    date = F.regexp_extract(F.get(f, F.lit(2)), r"^(\d{4} [A-Z][a-z]{2} +\d{1,2})", 1)
    clock = F.regexp_extract(F.get(f, F.lit(2)), r"^\d{4} [A-Z][a-z]{2} +\d{1,2} (\d{4})", 1)
    day = F.try_to_timestamp(F.regexp_replace(date, " +", " "), F.lit("yyyy MMM d"))
    minutes = F.coalesce(F.when(clock != "", F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 3, 2).cast("int")), F.lit(0))
    bare = lambda c: F.regexp_replace(c, r"\?+$", "")
    number = lambda i: F.nullif(bare(field(i)), F.lit("")).try_cast("double")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 20)).select(
        field(0).alias("tag"),
        F.timestamp_seconds(F.unix_timestamp(day) + minutes * 60).alias("at"),
        (clock == "").alias("date_only"),
        bare(field(3)).alias("vehicle"),
        F.coalesce(field(8), field(7)).alias("payload"),
        bare(field(11)).alias("site"),
        number(18).alias("inclination"),
        number(19).alias("azimuth"),
    )
    return rows.where(F.col("tag").rlike(r"^\d{4}-(?:\d{3}|[EF]\d{2})$") & F.year("at").between(first_year, last_year))


def resolved_codes(rows: DataFrame, key: str, name_col: str, reference: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, code): the code that a name stands for, null for an unknown one.

    Names are compared by their letters and digits up to a slash. An alias (spelling, code)
    counts before the names of the reference (code, name, ord), if the reference has its
    code; of several references with one name the first by ord counts.
    """
    plain = normalised_name(F.substring_index(F.col(name_col), "/", 1))
    spelled = aliases.select(normalised_name(F.col("spelling")).alias("_n"), "code").join(reference.select("code").distinct(), "code", "left_semi").groupBy("_n").agg(F.min("code").alias("_alias"))
    both = reference.select(normalised_name(F.col("name")).alias("_n"), "ord", "code").unionByName(reference.select(normalised_name(F.col("code")).alias("_n"), "ord", "code"))
    named = both.groupBy("_n").agg(F.min(F.struct("ord", "code")).alias("_hit")).select("_n", F.col("_hit.code").alias("_named"))
    return rows.select(key, plain.alias("_n")).join(spelled, "_n", "left").join(named, "_n", "left").select(key, F.coalesce("_alias", "_named").alias("code"))


#: Elements that break a line, and those that are left out. Fixed values.
_BLOCKS = {"p", "div", "br", "li", "tr", "pre", "code", "blockquote", "h1", "h2", "h3", "h4", "td"}
_SKIPPED = {"script", "style", "blockquote"}


class _Posts(HTMLParser):
    """Texts of a saved page: one for each post element, or one for the whole page without any."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.posts: list[list[str]] = []
        self.page: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self.handle_data("\n")
        if tag in ("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "wbr", "source"):
            return
        found = dict(attrs)
        post = tag == "div" and ("inner" in (found.get("class") or "").split() or (found.get("id") or "").startswith("msg_"))
        if post and not any(p for _, p in self.stack):
            self.posts.append([])
        self.stack.append((tag, post))
        self.skipped += tag in _SKIPPED

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return  # a stray end tag
        while self.stack:
            top, _ = self.stack.pop()
            self.skipped -= top in _SKIPPED
            if top == tag:
                break
        if tag in _BLOCKS:
            self.handle_data("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.page.append(data)
            if any(p for _, p in self.stack):
                self.posts[-1].append(data)


def _texts(html: str | None) -> list[str]:
    parser = _Posts()
    parser.feed(html or "")
    parser.close()
    tidy = lambda parts: "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)
    return [t for t in map(tidy, parser.posts or [parser.page]) if t]


def html_texts(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, pos, text): the posts of each saved page; quotes, scripts and styles are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, t) for i, h in zip(batch["id"], batch["html"], strict=True) for n, t in enumerate(_texts(h))]
            yield pd.DataFrame(rows, columns=["id", "pos", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(read, "id long, pos int, text string").withColumnRenamed("id", id_col)
