"""SimHash fingerprints and their search, in DataFrame functions only.

Each word and pair of neighbouring words of a text has a 64-bit hash that votes on the
bits of the fingerprint: for a bit that is set in the hash, against it otherwise, with the
term's weight times its occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import text_or_empty, written

BITS = 64
WORD_WEIGHT, PAIR_WEIGHT = 1, 2
#: Consecutive ids in a window when the next document is looked up.
RUN = 1024

_LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    """Array of struct(hash, weight): the words, and the pairs of neighbouring words."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    later = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    # the last word has no pair: its second hash is null and has no weight
    return F.flatten(
        F.zip_with(words, later, lambda a, b: F.array(F.struct(a.alias("hash"), F.lit(WORD_WEIGHT).alias("weight")), F.struct(F.xxhash64(a, b).alias("hash"), F.when(b.isNull(), 0).otherwise(PAIR_WEIGHT).alias("weight"))))
    )


def voted(rows: DataFrame, keys: list[str], terms_col: str = "terms", out_col: str = "fingerprint") -> DataFrame:
    """(keys, copies, fingerprint): the fingerprint of each group of rows with equal keys, which must have equal terms.

    Terms are exploded and their votes added up before the shuffle, so that a row for each
    text and task moves. Votes of bits j and j + 32 are counted in the two halves of one long.
    Equal rows add up their votes alike, which leaves every majority as it is.
    """
    none = F.array(F.struct(F.lit(None).cast("long").alias("hash"), F.lit(None).cast("int").alias("weight")))
    each = rows.select(*keys, F.explode(F.concat(none, F.col(terms_col))).alias("t")).select(*keys, "t.hash", "t.weight")
    vote = lambda j: F.sum(F.col("weight") * F.shiftrightunsigned(F.col("hash"), j).bitwiseAND(F.lit(_LANES)))
    counted = each.groupBy(*keys).agg(F.count_if(F.col("hash").isNull()).alias("copies"), F.sum("weight").alias("total"), *(vote(j).alias(f"v{j}") for j in range(BITS // 2)))
    out = F.lit(0).cast("long")
    for j in range(BITS // 2):
        low, high = 2 * F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("total"), 2 * F.shiftrightunsigned(f"v{j}", 32) > F.col("total")
        upper = 1 << (j + 32)
        for won, bit in ((low, 1 << j), (high, upper - (1 << 64) if upper >= 1 << 63 else upper)):
            out = out.bitwiseOR(F.when(won, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, "copies", out.alias(out_col))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def _next_lower(keys: DataFrame, levels: int) -> DataFrame:
    """(k, lower): for each distinct k the next lower one, null for the lowest. Windows hold at most ``RUN`` keys but for the topmost, which has one for each RUN^levels numbers."""
    if not levels:
        return keys.select("k", F.lead("k").over(Window.orderBy(F.desc("k"))).alias("lower"))
    run = F.floor(F.col("k") / RUN)
    tops = keys.groupBy(run.alias("run")).agg(F.max("k").alias("top"))
    after = _next_lower(tops.select(F.col("run").alias("k")), levels - 1).select(F.col("k").alias("run"), F.col("lower").alias("next_run"))
    reached = after.join(tops.select(F.col("run").alias("next_run"), "top"), "next_run", "left").select("run", "top")
    inside = keys.select("k", run.alias("run")).withColumn("inside", F.lead("k").over(Window.partitionBy("run").orderBy(F.desc("k"))))
    return inside.join(reached, "run", "left").select("k", F.coalesce("inside", "top").alias("lower"))


def with_next(rows: DataFrame, levels: int = 2) -> DataFrame:
    """Rows (doc_id, text) with next_text of the next document in descending order of doc_id; after the last comes the first.

    Documents move once, to the window of their run of ``RUN`` ids; for the last of a run, the
    first document of the next run that has any is joined. Null ids come last, in a run of
    their own; equal ids stand in the order of their texts.
    """
    placed = rows.withColumn("run", F.coalesce(F.floor(F.col("doc_id") / RUN), F.lit(-(2**60)).cast("long")))
    window = Window.partitionBy("run").orderBy(F.desc_nulls_last("doc_id"), "text")
    inside = placed.withColumn("inside", F.lead("text").over(window))
    first_of_run = F.min_by("text", F.struct((-F.col("doc_id").cast("decimal(20,0)")).alias("id"), "text"))
    tops = placed.groupBy("run").agg(first_of_run.alias("top"))
    runs = placed.select("run").distinct()
    highest = runs.agg(F.max("run")).first()[0]
    after = _next_lower(runs.select(F.col("run").alias("k")), levels).select(F.col("k").alias("run"), F.coalesce("lower", F.lit(highest)).alias("next_run"))
    reached = after.join(tops.withColumnRenamed("run", "next_run"), "next_run").select("run", "top")
    return inside.join(reached, "run").select("doc_id", "text", F.coalesce("inside", "top").alias("next_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint long). A null, empty or blank text has 0; an empty table gives an empty result."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.sha2(text, 256).alias("_text"), terms(text).alias("terms"))
    found = voted(rows, ["_id", "_text"])
    return found.select(F.col("_id").alias(id_col), "fingerprint", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("col")


def near_fingerprints(prints: DataFrame, radius: int = 3, print_col: str = "fingerprint") -> DataFrame:
    """(a, b, distance), a < b, for all pairs of distinct fingerprints at most ``radius`` bits apart; null ones are left out.

    The bits are cut into radius + 2 blocks and a table is permuted for each pair of blocks,
    its key the two blocks: fingerprints in the radius differ in at most radius blocks, so
    they agree on two. Equal fingerprints are one before the join, however many texts have them.
    """
    blocks = radius + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    value = F.col("p")
    part = lambda i: F.shiftrightunsigned(value, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
    keys = [F.struct(F.lit(i * blocks + j).alias("t"), part(i).alias("x"), part(j).alias("y")) for i in range(blocks) for j in range(i + 1, blocks)]
    table = prints.select(F.col(print_col).alias("p")).where("p is not null").distinct().select("p", F.explode(F.array(*keys)).alias("key"))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = table.withColumnRenamed("p", "a").join(table.withColumnRenamed("p", "b"), "key").where("a < b")
    return pairs.select("a", "b", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Query columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    paired = with_next(docs.select("doc_id", text_or_empty().alias("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), edited.alias("t")))
    keys = ["doc_id", "n_chars", "text_key", "next_key", "edited_sha256"]
    named = paired.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_key"), F.sha2("next_text", 256).alias("next_key"), F.sha2(edited, 256).alias("edited_sha256"), F.explode(both).alias("one"))
    each = voted(named.select(*keys, "one.which", terms(F.col("one.t")).alias("terms")), [*keys, "which"])
    pick = lambda which: F.max(F.when(F.col("which") == which, F.col("fingerprint")))
    rows = written(each.groupBy(*keys).agg(pick(0).alias("print"), pick(1).alias("edited_print"), F.max("copies").alias("copies")), "fingerprints")
    by_text = rows.groupBy(F.col("text_key").alias("next_key")).agg(F.first("print").alias("next_print"))
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    joined = rows.join(by_text, "next_key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed("print").alias("fingerprint"),
        hexed("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
