"""Pre-tokens of byte-level BPE as a Spark SQL expression.

The pattern of the byte-level vocabularies is run by the JVM's regex engine.
Spaces are spelled out, since ``\\s`` is ASCII there; the alternatives for letters
and numbers stand before the contractions, which start with an apostrophe and so
never compete with them; quantifiers are possessive, as nothing follows them.

The tokenizer libraries know newer versions of Unicode than the JVM. Where they differ, the
JVM takes a letter, mark or number for unassigned; texts with an unassigned code point are
handed to Python as they are, and split there by the library (``settled``).
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

#: Characters of Unicode's White_Space property.
SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

PRETOKEN = (
    r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)"
    rf"| ?[^{SPACES}\p{{L}}\p{{N}}]++|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]++"
)


def pretokens(text: Column) -> Column:
    """Array of the pre-tokens of ``text``, which concatenate to it; empty for an empty text."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def pretokens_around(text: Column, special: str) -> Column:
    """As ``pretokens``, with each occurrence of the string ``special`` an element of its own."""
    quoted = "\\Q" + special + "\\E"
    parts = F.transform(
        F.split(text, quoted, -1),
        lambda part, i: F.when(i == 0, pretokens(part)).otherwise(F.concat(F.array(F.lit(special)), pretokens(part))),
    )
    return F.when(F.contains(text, F.lit(special)), F.flatten(parts)).otherwise(pretokens(text))


def words_and_odd(text: Column, special: str | None = None) -> list[Column]:
    """``words``, the pre-tokens, and ``odd``, the text itself where the JVM cannot tell them; one of the two is empty."""
    unsure = text.rlike(r"\p{Cn}")
    cut = pretokens_around(text, special) if special else pretokens(text)
    return [F.when(unsure, F.array().cast("array<string>")).otherwise(cut).alias("words"), F.when(unsure, text).alias("odd")]


@lru_cache(maxsize=1)
def _splitter() -> ByteLevel:
    return ByteLevel(add_prefix_space=False)


def split_words(text: str, special: str | None = None) -> list[str]:
    """The pre-tokens of ``text`` as the library cuts them."""
    out: list[str] = []
    for i, part in enumerate(text.split(special) if special else [text]):
        out += [special] if i else []
        out += [part[a:b] for _, (a, b) in _splitter().pre_tokenize_str(part)] if part else []
    return out


def settled(batch: pa.RecordBatch, special: str | None = None) -> pa.ListArray:
    """The ``words`` of a batch, with those of its ``odd`` texts."""
    words, odd = batch.column("words"), batch.column("odd")
    if odd.null_count == len(odd):
        return words
    parts, done = [], 0
    for i in odd.is_valid().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
        parts += [words.slice(done, i - done), pa.array([split_words(odd[i].as_py(), special)], words.type)]
        done = i + 1
    return pa.concat_arrays([*parts, words.slice(done)])
