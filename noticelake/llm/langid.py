"""Language identification in two levels: family first, then languages within it.

Texts become hashed counts of letter pairs and triples. A linear support vector machine
for each pair of families votes for the family; within it, one for each pair of its
languages votes for the language. A bounded sample is turned into features once, and one
job fits the machines of all pairs, a pair a group. Prediction reads every document, whole,
and scores some dozens of texts by one matrix product.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm import language_model
from noticelake.llm.common import free_name, text_or_empty, written
from noticelake.llm.language_model import UNKNOWN, LanguageModel

#: Families of languages by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}

#: Documents of each language, and of each family, that a machine is fitted on, at most about.
PER_LANGUAGE = 1500

#: Languages that are learned, at most: those with the most labelled documents.
LANGUAGES = 64


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from fitting; a null id is not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most_languages: int = LANGUAGES) -> LanguageModel:
    """Fits on rows with a known language, at most ``per_language`` of each of the ``most_languages`` most frequent ones, picked by a hash of the id; without any, every text is ``und``."""
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), text_or_empty(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return LanguageModel({}, [], {})
    named = lambda values: F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, v)))[F.col("lang")]
    pick = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000))
    # a language's own share of the hashes is stretched over the whole range, so that a part of the picks is a part of each language
    rates = named({lang: max(1, int(1_000_000 * min(1.0, per_language / n))) for lang, n in counts.items()})
    picked = rows.select("lang", (pick * 1_000_000 / rates).cast("long").alias("pick"), "text").where("pick < 1000000")
    sample = written(picked.mapInArrow(language_model.vectors, "lang string, pick long, x binary"), "langid-sample")
    seen = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # one row for each language learned
    languages: dict[str, list[str]] = {}
    for lang in seen:
        languages.setdefault(family_of(lang), []).append(lang)
    pairs = [("families", a, b, languages[a], languages[b]) for a, b in combinations(languages, 2)]
    pairs += [(family, a, b, [a], [b]) for family, members in languages.items() for a, b in combinations(members, 2)]
    if not pairs:
        return LanguageModel(languages, [], {family: [] for family in languages})
    of: dict[str, list[Column]] = {lang: [] for lang in seen}
    for level, a, b, *sides in pairs:
        for yes, side in zip((True, False), sides, strict=True):
            for lang in side:
                # a family's languages share its number of documents
                of[lang].append(F.struct(F.lit(level).alias("level"), F.lit(a).alias("first"), F.lit(b).alias("second"), F.lit(yes).alias("yes"), F.lit(1_000_000 // len(side)).alias("below")))
    met = F.coalesce(*(F.when(F.col("lang") == lang, F.array(*found)) for lang, found in of.items() if found))
    met = sample.select("pick", "x", F.explode(met).alias("m")).where("pick < m.below").select("m.level", "m.first", "m.second", "m.yes", "pick", "x")
    fitted = met.groupBy("level", "first", "second").applyInArrow(language_model.fitted, "level string, first string, second string, weights binary, intercept double").collect()  # one row for each pair
    machines: dict[str, list] = {"families": [], **{family: [] for family in languages}}
    by_pair = {(r["level"], r["first"], r["second"]): (np.frombuffer(r["weights"], np.float32), r["intercept"]) for r in fitted}
    for level, a, b, *_ in pairs:
        machines[level].append((a, b, *by_pair[level, a, b]))
    return LanguageModel(languages, machines.pop("families"), machines)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0. Rows and other columns
    stay as they are. The model is a few vectors of fixed length for each pair of languages.
    """
    kept = docs.drop("lang_pred", "score")
    judge = F.arrow_udf(language_model.scorer(docs.sparkSession.sparkContext.broadcast(model)), "lang_pred string, score double")
    name = free_name(kept, "_judged")
    return kept.withColumn(name, judge(F.col(f"`{text_col}`"))).select(*(F.col(f"`{c}`") for c in kept.columns), f"{name}.lang_pred", f"{name}.score")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` with held_out, lang_pred and score, by a model fitted on the rows that are not held out; columns of these names are replaced."""
    model = fit(docs.where(~held_out()), per_language=per_language)
    return predict(docs.withColumn("held_out", held_out()), model)


def language_labels(docs: DataFrame) -> DataFrame:
    """Query columns: doc_id, held_out, lang_pred, score."""
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
