"""Benchmark decontamination by canonical templates, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other
parameters has the same template. Windows of ``WINDOW`` template words, and of the plain
lower-case words with their numbers and names, are hashed and hash-joined with those of the
benchmark; a template window that is mostly slots is lengthened until it has enough words of
its own. A window with slots counts only if the slots are consistent: over all such windows
of one alignment of a document with an item, each value of the item stands for one value of
the document and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import few_files, free_name, row_key, text_or_empty, written

WINDOW = 8
#: Words of a template window that are not placeholders, unless it is an item's whole template. An item of fewer words is looked for as an entire text.
LITERALS = 5
#: Benchmark windows up to which their table is broadcast (16 bytes each); beyond, the join is shuffled.
BROADCAST_WINDOWS = 500_000

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = (
    "km m cm mm mi mile miles ft feet foot in inch inches yd yard yards nm kg g mg lb lbs pound pounds oz ton tons "
    "l ml litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees mph kph kmh hz khz mhz ghz w kw v volt volts kb mb gb tb"
).split()


def canonical(text: Column) -> Column:
    """Lower-case template text; blank-separated words stand in the order of the text's own words that have a letter or digit."""
    out = F.regexp_replace(text, f"[{NAME}-{UNIT}]", "")
    out = F.regexp_replace(out, r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", NAME)
    out = F.regexp_replace(out, r"(?<![\p{L}\p{N}])[+-]?\p{Nd}(?:[\p{Nd}.,:/]*\p{Nd})?", NUMBER)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    out = F.regexp_replace(F.lower(out), rf"(?<={NUMBER} ?)(?:{units})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}{NAME}-{UNIT}\s]+", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """The same words in lower case, with letters and digits alone."""
    return words(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}\s]+", ""))


def raw_words(text: Column) -> Column:
    """The words that ``canonical`` keeps, as they stand but for case and outer punctuation."""
    out = F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}\s.,:/+-]+", "")
    return words(F.regexp_replace(out, r"[.,:/+-]+(?=\s|$)|(?<!\S)[.,:/+-]+(?!\p{Nd})", ""))


def window_hashes(template: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, put together from runs of half the length."""

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(template, lambda w: F.xxhash64(w))
        low = n // 2
        return joined(runs(n - low), runs(low), n - low)

    def joined(left: Column, right: Column, shift: int) -> Column:
        later = F.slice(right, F.lit(shift + 1), F.greatest(F.size(template), F.lit(1)))
        return F.zip_with(left, later, lambda a, b: F.xxhash64(a, b))

    return F.slice(runs(length), F.lit(1), F.greatest(F.size(template) - (length - 1), F.lit(0)))


def _is_literal(word: Column) -> Column:
    return ~word.rlike(f"[{NAME}{NUMBER}{UNIT}]")


def _literals(window: Column) -> Column:
    return F.size(F.filter(window, _is_literal))


def _run_hash(template: Column, at: Column, length: Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(template, at + 1, length), " "))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, item_at, hash, slots, whole, whole_hash) for the windows of all items.

    Every run of ``length`` plain words is a window without slots. A run of template words is
    one if it has ``LITERALS`` words that are not placeholders; if it has fewer and starts with
    one, it goes on for ``whole`` words until it has, and an item that has fewer altogether is
    one window of all its words. ``hash`` is of the first ``length`` words, ``whole_hash`` of all.

    An item shorter than ``WINDOW`` is one run. With fewer than ``LITERALS`` words it is one of plain words; one without words has none.
    """
    text = text_or_empty(text_col)
    items = benchmark.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("item_id"), words(canonical(text)).alias("template"), plain_words(text).alias("plain"))
    length = F.least(F.size("template"), F.lit(WINDOW))
    items = items.where(F.size("template") >= 1).withColumn("length", length)

    def hashes(column: str) -> Column:
        out = F.lit(None).cast("array<bigint>")
        for n in range(1, WINDOW + 1):
            out = F.when(F.col("length") == n, window_hashes(F.col(column), n)).otherwise(out)
        return out

    columns = ["item_id", "length", "item_at", "hash", "slots", "whole", "whole_hash"]
    plain = items.select("item_id", "length", F.posexplode(hashes("plain")).alias("item_at", "hash"))
    plain = plain.withColumns({"slots": F.lit(0), "whole": F.col("length"), "whole_hash": F.lit(None).cast("long")})
    at = F.filter(F.transform("template", lambda w, i: F.when(_is_literal(w), i)), lambda i: i.isNotNull())
    rows = items.where(F.size("template") >= LITERALS).withColumn("literal_at", at).select("item_id", "length", "template", "literal_at", F.posexplode(hashes("template")).alias("item_at", "hash"))
    enough = _literals(F.slice("template", F.col("item_at") + 1, F.col("length"))) >= LITERALS
    k = F.array_position("literal_at", F.col("item_at"))
    longer = F.when(k > 0, F.get("literal_at", (k + (LITERALS - 2)).cast("int")) - F.col("item_at") + 1)
    all_words = F.when((F.size("literal_at").between(1, LITERALS - 1)) & (F.col("item_at") == 0), F.size("template"))
    rows = rows.withColumn("whole", F.when(enough, F.col("length")).otherwise(F.coalesce(longer, all_words))).where("whole is not null")
    window = F.slice("template", F.col("item_at") + 1, F.col("whole"))
    rows = rows.withColumn("slots", F.col("whole") - _literals(window))
    rows = rows.withColumn("whole_hash", F.when(F.col("whole") > F.col("length"), _run_hash(F.col("template"), F.col("item_at"), F.col("whole"))))
    return plain.select(*columns).unionByName(rows.select(*columns))


def _of_matched(rows: DataFrame, matches: DataFrame, *columns: Column) -> DataFrame:
    """(key, columns) of the documents that have a match, once each."""
    return rows.join(matches.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("key", *columns)


def _lengthened(matches: DataFrame, rows: DataFrame) -> DataFrame:
    """Matches whose windows are longer than the run that was joined, if the document goes on like the window."""
    ours = _of_matched(rows, matches, words(canonical(F.col("text"))).alias("template"))
    return matches.join(ours, "key").where(_run_hash(F.col("template"), F.col("doc_at"), F.col("whole")) == F.col("whole_hash")).select(*matches.columns).distinct()


def _slot_pairs(matches: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, shift, consistent) for matches whose windows have slots; windows of equal shift (doc_at - item_at) are one alignment, so two copies with other parameters are judged apart."""
    ours = _of_matched(rows, matches, words(canonical(F.col("text"))).alias("template"), raw_words(F.col("text")).alias("raw"))
    theirs = items.select("item_id", raw_words(F.col("text")).alias("item_raw"))
    cut = lambda c, at: F.slice(c, F.col(at) + 1, F.col("whole"))
    # the window's words alone go on from a match, not the document's
    spots = matches.join(ours, "key").select("key", "item_id", "shift", "item_at", "whole", cut("template", "doc_at").alias("template"), cut("raw", "doc_at").alias("raw"))
    spots = spots.join(theirs, "item_id").select("key", "item_id", "shift", F.explode(F.arrays_zip("template", "raw", cut("item_raw", "item_at").alias("item_raw"))).alias("w"))
    values = spots.where(F.col("w.template").rlike(f"[{NAME}{NUMBER}{UNIT}]")).select("key", "item_id", "shift", F.col("w.raw").alias("value"), F.col("w.item_raw").alias("item_value")).distinct()
    at = ["key", "item_id", "shift"]
    by_item = values.groupBy(*at, "item_value").agg(F.count("*").alias("n")).groupBy(*at).agg(F.max("n").alias("n"))
    by_doc = values.groupBy(*at, "value").agg(F.count("*").alias("n")).groupBy(*at).agg(F.max("n").alias("n"))
    return by_item.unionByName(by_doc).groupBy(*at).agg((F.max("n") <= 1).alias("consistent"))


def _contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As ``contaminated``, with the rows' keys in front."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text_or_empty("text").alias("text"))
    bench = written(benchmark_windows(items), "benchmark-windows")
    shape = {r["length"]: r["n"] for r in bench.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most a row for each length up to WINDOW
    doc_id, text = F.col(f"`{id_col}`").cast("long"), text_or_empty(text_col)
    rows = docs.select(row_key(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text"))
    templates = rows.select("key", "doc_id", words(canonical(F.col("text"))).alias("template"), plain_words(F.col("text")).alias("plain"))
    small = sum(shape.values()) <= BROADCAST_WINDOWS
    found = None
    for length in sorted(shape):
        # template windows come first, so that doc_at holds for all windows with slots; of the plain ones, where doc_at counts for nothing, only those that are no template window follow
        of = templates.withColumns(
            {"ours": window_hashes(F.col("template"), length), "bare": F.when(F.col("template") != F.col("plain"), window_hashes(F.col("plain"), length)).otherwise(F.array().cast("array<bigint>"))}
        )
        both = F.concat("ours", F.array_except("bare", "ours"))
        if length < LITERALS:  # so short an item is looked for as an entire text
            of, both = templates.where(F.size("plain") == length), window_hashes(F.col("plain"), length)
        windows = of.select("key", "doc_id", F.posexplode(both).alias("doc_at", "hash"))
        known = bench.where(F.col("length") == length)
        hits = windows.join(F.broadcast(known) if small else known.hint("merge"), "hash").select("key", "doc_id", "item_id", "length", "doc_at", "item_at", "slots", "whole", "whole_hash")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        nothing = {"item_id": "long", "n_matched": "long", "n_windows": "long", "coverage": "double"}
        return rows.where("false").select("key", "doc_id", *(F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()))
    matches = written(found, "template-matches")
    plain = matches.where("slots = 0").select("key", "doc_id", "item_id", "item_at")
    slotted = matches.where("slots > 0").withColumn("shift", F.col("doc_at") - F.col("item_at"))
    longer = slotted.where("whole > length")
    if not longer.isEmpty():
        slotted = written(slotted.where("whole = length").unionByName(_lengthened(longer, rows)), "slotted-matches")
    if not slotted.isEmpty():
        judged = _slot_pairs(slotted, rows, items).where("consistent").select("key", "item_id", "shift")
        plain = plain.unionByName(slotted.join(judged, ["key", "item_id", "shift"], "left_semi").select("key", "doc_id", "item_id", "item_at"))
    n_windows = bench.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"))
    counted = plain.distinct().groupBy("key", "item_id").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_matched")).join(n_windows, "item_id")
    return counted.select("key", "doc_id", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage) for each document that holds a window of an item.

    ``n_matched`` counts the item's words at which a window starts that the document has, of
    ``n_windows`` at which one starts; ``coverage`` is their share. Copies are found in any
    case, and with other parameters if names stay capitalised. An item of fewer than
    ``LITERALS`` words is found where it is the entire text.
    Null and empty texts and null item ids match nothing. Rows with equal doc_id and text are
    one document; texts without a doc_id are judged too, and so are other texts under the
    same doc_id. Other columns are not read. Without matches, or for empty tables, the result
    is empty.
    """
    return _contaminated(docs, benchmark, id_col, text_col).drop("key")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and text) without the rows that hold a window of a benchmark item."""
    key = free_name(docs, "_key")
    # written first, so that the join is planned by the true size of the keys and texts move only where these are many
    hit = written(few_files(_contaminated(docs, benchmark, "doc_id", "text").select(F.col("key").alias(key)).distinct()), "benchmark-hits")
    return docs.withColumn(key, row_key(F.col("doc_id").cast("long"), text_or_empty())).join(hit, key, "left_anti").select(*docs.columns)
