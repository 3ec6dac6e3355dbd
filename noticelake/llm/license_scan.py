"""Licence scan by canonical digests, in DataFrame functions only.

A licence text or notice is brought to a canonical form: case, punctuation and white space
are levelled, copyright claims and title lines go, and equivalent spellings become one. The
digest of an entire document, of each of its entire lines, and of each entire paragraph of
several lines, in which a wrapped notice is whole, is joined with the digests of the known
texts. The table of known digests has a row for each known text.

Each known text names an anchor: a word that every spelling of it has. What has no anchor
of any known text cannot have a known digest and is left out before anything is levelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.llm.common import text_or_empty

#: Known licence texts and notices by SPDX id. Fixed values.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS '
        'IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE "
        'IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)

#: Equivalent spellings, replaced in this order in lower-case text of single spaces. Fixed values.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("fulfil ", "fulfill "),
    ("per cent", "percent"),
    ("and or ", "or "),
    (" v 2", " version 2"),
    (" v2", " version 2"),
    (" v 3", " version 3"),
    (" v3", " version 3"),
)

#: Lines that carry a copyright claim: the word with a sign, a year or a holder, but not one that a clause is wrapped to. A fixed pattern.
CLAIM_LINE = (
    r"(?md)^[^\p{L}\n]*(?:(?i:copyright)[^\p{L}\n]*(?:\([cC]\)|©|\d{4})|\([cC]\)[^\p{L}\n]*(?:\d{4}|(?i:copyright))|©"
    r"|Copyright[^\p{L}\n]+(?:by )?(?!(?:Holder|Owner|Notice|Licen[sc]e|Law)s?\b)\p{Lu}|(?i:all rights reserved)[^\p{L}\n]*$).*$"
)
#: Lines that carry a licence's name alone. A fixed pattern.
TITLE_LINE = r"(?imd)^[^\p{L}\n]*(?:the )?(?:mit|isc|(?:new |simplified )?bsd(?: [23].clause)?) licen[sc]e(?: \((?:mit|isc)\))?[^\p{L}\n]*$"
NOT_WORD = r"[^\p{L}\p{N}\p{M}]+"
#: Rows of a table of known texts, at most: it is broadcast.
KNOWN_ROWS = 100_000


def canonical(text: Column) -> Column:
    """Single-spaced lower-case words without copyright claims and titles, in one spelling."""
    lower = F.lower(text)
    out = F.when(lower.rlike("copyright|rights reserved|\\(c\\)|©"), F.regexp_replace(text, CLAIM_LINE, "")).otherwise(text)
    out = F.lower(F.when(lower.rlike("(?:mit|isc|bsd|clause) licen[sc]e"), F.regexp_replace(out, TITLE_LINE, "")).otherwise(out))
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def anchor(form: Column) -> Column:
    """What every text with the canonical ``form`` has in lower case: the stem of licence, else the longest word that no spelling makes; empty if there is none."""
    made = "|".join(new.strip() for _, new in SPELLINGS)
    own = F.filter(F.split(form, " "), lambda w: w.rlike("^[a-z0-9]+$") & ~w.rlike(made))
    longest = F.array_max(F.transform(own, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return F.when(form.contains("licen"), F.lit("licen")).otherwise(F.coalesce(longest["w"], F.lit("")))


def known_digests(texts: DataFrame) -> DataFrame:
    """(license, digest, anchor) of each known text of ``texts`` (license, text); null ones and those without words are left out."""
    forms = texts.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return forms.select("license", F.sha2("form", 256).alias("digest"), anchor(F.col("form")).alias("anchor")).distinct()


def known_texts(spark: SparkSession) -> DataFrame:
    """The built-in list as a table (license, text); a larger one can be read from anywhere."""
    return spark.createDataFrame(list(KNOWN), "license string, text string")


def _any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, scope, license, n_found): entire texts (scope ``text``), lines (``line``) and paragraphs of several lines (``paragraph``) that are known.

    ``known`` is a table (license, digest, anchor) of at most ``KNOWN_ROWS`` rows. Null, empty
    and blank texts match nothing; equal rows add up in n_found; a null id is kept as one
    group. Other columns are not read. An empty table gives an empty result.
    """
    listed = known.limit(KNOWN_ROWS + 1).agg(F.count("*").alias("n"), F.collect_set("anchor").alias("anchors")).first()
    if listed["n"] > KNOWN_ROWS:
        raise ValueError(f"more than {KNOWN_ROWS} known texts")
    has_anchor = lambda t: _any_of(F.lower(t), sorted(listed["anchors"]))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text_or_empty(text_col).alias("text")).where(has_anchor(F.col("text")))
    part = lambda scope, t: F.struct(F.lit(scope).alias("scope"), t.alias("text"))
    paragraphs = F.filter(F.split("text", r"\n[ \t\r]*\n", -1), lambda p: p.rlike(r"\S[ \t\r]*\n[ \t\r]*\S"))
    parts = F.concat(F.array(part("text", F.col("text"))), F.transform(F.split("text", r"\n", -1), lambda t: part("line", t)), F.transform(paragraphs, lambda t: part("paragraph", t)))
    each = rows.select(id_col, F.explode(parts).alias("part")).select(id_col, "part.scope", "part.text").where(has_anchor(F.col("text")))
    # neither a filter on the form nor one on a null digest, for which each form would be made twice
    found = each.select(id_col, "scope", F.coalesce(digest(F.col("text")), F.lit("")).alias("digest"))
    return found.join(F.broadcast(known.select("license", "digest")), "digest").groupBy(id_col, "scope", "license").agg(F.count("*").alias("n_found"))


def oracle_sql() -> str:
    """The same over every text, line and paragraph, without anchors; lines are judged one by one."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    form = """trim(regexp_replace(lower(array_to_string(list_filter(string_split(t, chr(10)), lambda l:
      not regexp_matches(l, '^[^\\p{L}]*((?i:copyright)[^\\p{L}]*(\\([cC]\\)|©|[0-9]{4})|\\([cC]\\)[^\\p{L}]*([0-9]{4}|(?i:copyright))|©|(?i:all rights reserved)[^\\p{L}]*$)')
      and not (regexp_matches(l, '^[^\\p{L}]*Copyright[^\\p{L}]+(by )?\\p{Lu}') and not regexp_matches(l, '^[^\\p{L}]*Copyright[^\\p{L}]+(by )?(Holder|Owner|Notice|License|Licence|Law)s?\\b'))
      and not regexp_matches(l, '(?i)^[^\\p{L}]*(the )?(mit|isc|(new |simplified )?bsd( [23].clause)?) licen[cs]e( \\((mit|isc)\\))?[^\\p{L}]*$')), chr(10))),
      '[^\\p{L}\\p{N}\\p{M}]+', ' ', 'g'))"""
    for old, new in (
        ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("favour", "favor"), ("organisation", "organization"),
        ("fulfil ", "fulfill "), ("per cent", "percent"), ("and or ", "or "), (" v 2", " version 2"), (" v2", " version 2"), (" v 3", " version 3"), (" v3", " version 3"),
    ):
        form = f"replace({form}, '{old}', '{new}')"
    return f"""
with parts as (
  select doc_id, 'text' as scope, coalesce(text, '') as t from documents
  union all
  select doc_id, 'line', unnest(string_split(coalesce(text, ''), chr(10))) from documents
  union all
  select doc_id, 'paragraph', p from (select doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n')) as p from documents) where regexp_matches(p, '\\S[ \\t\\r]*\\n[ \\t\\r]*\\S')),
known as (select distinct license, {form} as canonical from (values {quoted}) v(license, t)),
forms as (select doc_id, scope, {form} as canonical from parts)
select doc_id, scope, license, count(*) as n_found
from forms join known using (canonical) where canonical <> '' group by all"""
