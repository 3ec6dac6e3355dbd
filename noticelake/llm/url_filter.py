"""URL filter: rules first, then gradient-boosted trees on lexical features.

Rules name a host with its subdomains and a start of the path; the longest that fits
decides. Other URLs go to boosted trees fitted with ``pyspark.ml`` on labelled URLs: by
length, depth, digits, entropy, parameters and the record of the host's suffix. At most
about ``TRAIN_ROWS`` labelled URLs are fitted on, picked by a hash; suffix records count all.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import written

#: (verdict, host/path) of the query. Fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

TRAIN_ROWS = 20_000
FEATURES = ("length", "host_length", "labels", "depth", "digit_share", "digits_in_host", "hyphens", "entropy", "parameters", "query_length", "has_fragment", "secure", "suffix_share", "suffix_weight")


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end after the first ``://``, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. The rules are a list of the caller's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def _entropy(text: Column) -> Column:
    """Bits a character."""
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.char_length(text)
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def lexical(rows: DataFrame, url_col: str, records: DataFrame, own: str | None = None) -> DataFrame:
    """``rows`` (with host and path) with an array of ``FEATURES``; records: (suffix, bad, weight).

    ``own`` names the label of rows that the records count: each is taken out of its suffix's record, so that no row sees its answer.
    """
    weight = F.col("weight") - (1 if own else 0)
    share = (F.col("bad") - (F.col(own) if own else F.lit(0)) + 2.0) / (weight + 4.0)
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = lambda c: F.char_length(F.regexp_replace(c, r"[^0-9]", ""))
    values = {
        "length": F.char_length(url),
        "host_length": F.char_length(host),
        "labels": F.size(F.split(host, r"\.")),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_share": digits(url) / F.greatest(F.char_length(url), F.lit(1)),
        "digits_in_host": digits(host),
        "hyphens": F.char_length(host) - F.char_length(F.replace(host, F.lit("-"), F.lit(""))),
        "entropy": F.when(url != "", _entropy(url)).otherwise(0.0),
        "parameters": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0),
        "query_length": F.char_length(query),
        "has_fragment": url.contains("#").cast("int"),
        "secure": url.startswith("https").cast("int"),
        "suffix_share": F.coalesce(share, F.lit(0.5)),
        "suffix_weight": F.coalesce(F.log1p(weight), F.lit(0.0)),
    }
    joined = rows.withColumn("suffix", suffix_of(host)).join(records, "suffix", "left")
    return joined.withColumn("features", F.array(*(values[name].cast("double") for name in FEATURES))).drop("suffix", "bad", "weight")


def suffix_records(labelled: DataFrame) -> DataFrame:
    """(suffix, bad, weight) from (host, blocked): the number of blocked URLs and of all."""
    return labelled.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.sum("blocked").alias("bad"), F.count("*").alias("weight"))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[GBTClassificationModel | str, DataFrame]:
    """From (url, host, path, blocked int): boosted trees, or the only verdict there is (allow if none), and the suffix records."""
    records = written(suffix_records(labelled), "suffix-records")
    seen = {r["blocked"]: r["n"] for r in labelled.groupBy("blocked").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(seen) < 2:
        return ("block" if 1 in seen else "allow"), records
    rate = int(1_000_000 * min(1.0, train_rows / sum(seen.values())))
    picked = labelled.where(F.pmod(F.xxhash64("url", F.lit("url-filter")), F.lit(1_000_000)) < rate)
    rows = written(lexical(picked, "url", records, own="blocked").select("blocked", "features"), "url-sample")
    if rows.select("blocked").distinct().count() < 2:
        return ("block" if seen[1] > seen[0] else "allow"), records
    trees = GBTClassifier(maxIter=12, maxDepth=4, seed=7, featuresCol="vector", labelCol="blocked")
    return trees.fit(rows.select(F.col("blocked").cast("double").alias("blocked"), array_to_vector("features").alias("vector"))), records


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: (id_col, host, path, rule, verdict, score).

    ``labelled`` (url, blocked) trains the trees; without it the pages on which a rule
    decides do. ``score`` is the trees' chance of block and null where a rule decides. A null
    URL, or one without ``://``, has an empty host and path and goes to the trees. Null and
    repeated ids keep their rows; other columns are not read; an empty table gives an empty
    result.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias(id_col), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = rows.withColumn("by_rule", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = ruled.where("by_rule is not null").select("url", "host", "path", (F.col("by_rule.verdict") == "block").cast("int").alias("blocked"))
    else:
        known = labelled.where("blocked is not null").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("int").alias("blocked"))
    model, records = fit(known)
    decided = F.coalesce(F.col("by_rule.verdict"), F.col("own"))
    if isinstance(model, str):
        judged = ruled.withColumn("own", F.lit(model)).withColumn("score", F.lit(float(model == "block")))
    else:
        scored = model.transform(lexical(ruled, "url", records).withColumn("vector", array_to_vector("features")))
        judged = scored.withColumn("score", F.element_at(vector_to_array("probability"), 2)).withColumn("own", F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    score = F.when(F.col("by_rule").isNull(), F.col("score"))
    return judged.select(id_col, "host", "path", F.col("by_rule.rule").alias("rule"), decided.alias("verdict"), score.alias("score"))
