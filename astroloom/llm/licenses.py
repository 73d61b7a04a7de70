"""Operator 2, license scans: an exact set-similarity join, natively.

Templates are license notices, whole ones and one-line ones, as multisets of
words (a word's k-th occurrence is a token of its own). A template of n words has
the smallest stride of ``STRIDES`` that is n at least. Its blocks in a text are
the windows of two strides that begin at every stride, so any notice of up to a
stride's words stands whole in a block. A block meets a template where it holds
at least ``THRESHOLD`` of the template's tokens, at least ``ORDER`` of its pairs
of consecutive words (so that the same words strewn over a text are no notice)
and the words that tell the template from its like.

The join: tokens are ordered by the number of documents that hold their word,
rarest first, over the whole corpus. A block that meets template T in o =
ceil(0.8 |T|) tokens holds one of T's |T| - o + 1 rarest (prefix filter), so
blocks meet templates by an equi-join on those tokens. The length filter drops
texts, then blocks, with too few of the template's words, the positional filter
blocks whose tokens from the matching position on cannot reach o. What is left is
verified exactly. A text is split into words once; only texts that pass the
length filter of some template make blocks. Only DataFrame functions are used.

Base labels are places where fixed phrases stand word by word.

Results in unusual cases: null and empty texts have no words (counts 0, words
null, labels empty, score 0); texts of one block and very long texts are
scanned whole; repeated rows each get their labels; a null ``doc_id`` is kept;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_key, settle, table, text_key

#: phrase -> label
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy "
    "of the GNU {} along with this program. If not, see https://www.gnu.org/licenses/."
)

#: Public notices: label, the words a block has to hold beside, text.
TEMPLATES = (
    ("mit", "", _MIT_GRANT),
    (
        "mit",
        "",
        _MIT_GRANT + " The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    ("bsd", "", _BSD_GRANT),
    (
        "bsd",
        "",
        _BSD_GRANT + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY "
        "THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "apache",
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("gpl", "general", _GNU_HEADER.format(*["General Public License"] * 3)),
    ("lgpl", "lesser", _GNU_HEADER.format(*["Lesser General Public License"] * 3)),
    ("agpl", "affero", _GNU_HEADER.format(*["Affero General Public License"] * 3)),
    (
        "isc",
        "",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        "mozilla",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "unencumbered",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
    (
        "cc0",
        "waived",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    ("cc-by", "commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("apache", "apache", "Licensed under the Apache License"),
    ("mit", "mit", "Released under the MIT License"),
    ("mit", "mit", "Licensed under the MIT License"),
    ("bsd", "bsd", "Licensed under the BSD License"),
    ("gpl", "general", "Licensed under the GNU General Public License"),
    ("lgpl", "lesser", "Licensed under the GNU Lesser General Public License"),
    ("mpl", "mozilla", "Licensed under the Mozilla Public License"),
    ("cc0", "cc0", "Dedicated to the public domain under CC0"),
)
THRESHOLD = 0.8
ORDER = 0.6
#: Steps between the blocks' starts; blocks have twice as many words.
STRIDES = (8, 16, 32, 64, 128, 256, 512)

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if w]


def needed(n: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


@dataclass(frozen=True)
class Template:
    label: str
    must: tuple[str, ...]
    words: tuple[str, ...]

    @property
    def tokens(self) -> list[str]:
        """``the 1``, ``the 2``, ...: each occurrence of a word is a token."""
        seen: Counter = Counter()
        out = []
        for w in self.words:
            seen[w] += 1
            out.append(f"{w} {seen[w]}")
        return out

    @property
    def pairs(self) -> list[str]:
        return sorted({f"{a} {b}" for a, b in zip(self.words, self.words[1:])})

    @property
    def least(self) -> int:
        return needed(len(self.words))

    @property
    def least_pairs(self) -> int:
        return needed(len(self.pairs), ORDER) if self.pairs else 0

    @property
    def stride(self) -> int:
        return min(s for s in STRIDES if s >= len(self.words))


def prepared(templates=TEMPLATES) -> list[Template]:
    return [Template(label, tuple(must.split()), tuple(plain_words(text))) for label, must, text in templates]


def word_array(text: Column) -> Column:
    """The words of a text. ``lower`` differs from lower-casing A-Z on ASCII
    only for two letters (the Kelvin sign, a dotted I), put aside first."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("ß")), F.lit("\u0130"), F.lit("ß"))
    return F.array_remove(F.split(F.lower(plain), _SPLIT), "")


def _list(items) -> Column:
    """A constant array of words or tokens; none holds a tab."""
    return F.split(F.lit("\t".join(items)), "\t")


def _places(words: Column, phrase: str) -> Column:
    """The starts of a phrase; worked out only where its rarest test holds."""
    parts = phrase.split()
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    last = F.size(words) - len(parts)
    starts = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: reduce(and_, [F.get(words, i + k) == p for k, p in enumerate(parts)]),
    )
    return F.when(joined.contains(f" {phrase} "), starts).otherwise(F.array().cast("array<int>"))


def _likely(held: Column, t: Template) -> Column:
    """The length filter of a whole text, by the distinct words it holds."""
    own = sorted(set(t.words))
    missing = len(t.words) - t.least
    test = F.size(F.array_intersect(held, _list(own))) >= len(own) - missing
    return reduce(and_, [F.array_contains(held, w) for w in t.must], test)


def read_texts(docs: DataFrame, known: list[Template]) -> DataFrame:
    """One row for each of ``docs``: its key, doc_id, n_words, places (of base
    phrases), base_labels, held (template words in it), strides (of templates
    that it may meet) and, where there are any, its words."""
    words = F.col("words")
    places = F.concat(*[_places(words, p) for p in PHRASES])
    base = F.filter(
        F.array(
            *[
                F.when(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(f" {p} "), F.lit(label))
                for p, label in PHRASES.items()
            ]
        ),
        lambda x: x.isNotNull(),
    )
    k1, k2 = text_key(F.col("text"))
    vocabulary = sorted({w for t in known for w in t.words})
    strides = [
        F.when(reduce(or_, [_likely(F.col("held"), t) for t in known if t.stride == s]), F.lit(s))
        for s in sorted({t.stride for t in known})
    ]
    own = ["doc_id", "id", "k1", "k2"]
    return settle(
        docs.select("doc_id", id_key(F.col("doc_id")).alias("id"), k1.alias("k1"), k2.alias("k2"), word_array(F.col("text")).alias("words"))
        .select(
            *own,
            F.size(words).cast("long").alias("n_words"),
            places.alias("places"),
            base.alias("base_labels"),
            F.array_intersect(_list(vocabulary), words).alias("held"),
            "words",
        )
        .withColumn("strides", F.filter(F.array(*strides), lambda x: x.isNotNull()))
        .withColumn("words", F.when(F.size("strides") > 0, words))
    )


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row for each of ``docs``: doc_id, n_words, places (of base phrases),
    base_labels, hits (label and containment of each template met)."""
    spark = docs.sparkSession
    known = prepared(templates)
    texts = read_texts(docs, known)
    counted = texts.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.word: r.n for r in counted.collect()}  # the templates' words at most

    def rank(token: str) -> tuple:
        word, k = token.split(" ")
        return counts.get(word, 0), word, int(k)

    order = sorted({x for t in known for x in t.tokens}, key=rank)
    most = Counter({x.split(" ")[0]: 0 for x in order})
    for x in order:
        most[x.split(" ")[0]] = max(most[x.split(" ")[0]], int(x.split(" ")[1]))
    rows = []
    for t in known:
        ordered = sorted(t.tokens, key=rank)
        rows += [
            (t.stride, x, t.label, i, t.least, ordered, t.least_pairs, t.pairs, list(t.must))
            for i, x in enumerate(ordered[: len(ordered) - t.least + 1])
        ]
    prefixes = spark.createDataFrame(
        rows,
        "stride int, token string, label string, i int, least int, tokens array<string>, least_pairs int,"
        " pairs array<string>, must array<string>",
    )
    rare = {s: sorted({r[1].split(" ")[0] for r in rows if r[0] == s}) for s in sorted({t.stride for t in known})}
    block, stride = F.col("block"), F.col("stride")
    has_rare = reduce(or_, [(stride == s) & F.arrays_overlap(block, _list(ws)) for s, ws in rare.items()])
    capped = F.str_to_map(F.lit(",".join(f"{w}:{n}" for w, n in sorted(most.items()))), F.lit(","), F.lit(":"))
    tokens = F.flatten(
        F.transform(
            F.array_intersect(block, _list(sorted(most))),
            lambda w: F.transform(
                F.sequence(F.lit(1), F.least(F.size(F.filter(block, lambda x: x == w)), capped[w].cast("int"))),
                lambda k: F.concat_ws(" ", w, k.cast("string")),
            ),
        )
    )
    block_pairs = F.transform(F.slice(block, F.lit(1), F.size(block) - 1), lambda w, i: F.concat_ws(" ", w, F.get(block, i + 1)))
    common = F.size(F.array_intersect("tokens", "held"))
    key = ["id", "k1", "k2"]
    some = texts.where(F.size("strides") > 0)
    met = (
        some.dropDuplicates(key)
        .select(*key, "words", F.explode("strides").alias("stride"))
        .select(
            *key,
            "stride",
            F.explode(
                F.transform(
                    F.sequence(F.lit(0), F.floor((F.size("words") - 1) / F.col("stride")).cast("int")),
                    lambda j: F.slice("words", j * F.col("stride") + 1, F.col("stride") * 2),
                )
            ).alias("block"),
        )
        .where(has_rare)
        .withColumn("held", F.array_intersect(_list(order), tokens))
        .select(*key, "stride", "block", "held", F.posexplode("held").alias("k", "token"))
        .join(F.broadcast(prefixes), ["stride", "token"])  # a row for each prefix token of the fixed templates
        .where(F.size("held") >= F.col("least"))
        .where(1 + F.least(F.size("tokens") - 1 - F.col("i"), F.size("held") - 1 - F.col("k")) + F.least("i", "k") >= F.col("least"))
        .where(common >= F.col("least"))
        .where(F.size(F.array_except("must", "block")) == 0)
        .where(F.size(F.array_intersect("pairs", block_pairs)) >= F.col("least_pairs"))
        .withColumn("share", common / F.size("tokens"))
        .groupBy(*key)
        .agg(F.collect_set(F.struct("label", "share")).alias("hits"))  # a few for each template
    )
    empty = F.array().cast("array<struct<label:string,share:double>>")
    shown = ["doc_id", "n_words", "places", "base_labels"]
    joined = some.select(*key, *shown).join(met, key, "left").select(*shown, F.coalesce("hits", empty).alias("hits"))
    return joined.unionByName(texts.where(F.size("strides") == 0).select(*shown, empty.alias("hits")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct("base_labels"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("hits", lambda h: h["label"]))))
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def _sql() -> str:
    known = prepared()
    values = ", ".join(
        f"({k}, '{t.label}', {t.stride}, {len(t.words)}, {t.least}, {t.least_pairs}, {len(t.must)})" for k, t in enumerate(known)
    )
    tokens = ", ".join(f"({k}, '{w}', {n}, {w in t.must})" for k, t in enumerate(known) for w, n in sorted(Counter(t.words).items()))
    pairs = ", ".join(f"({k}, '{p}')" for k, t in enumerate(known) for p in t.pairs)
    tests = []
    for p, label in PHRASES.items():
        spots = " AND ".join(f"w{k} = '{x}'" for k, x in enumerate(p.split()))
        tests.append(f"SELECT doc_id, p AS place, '{label}' AS label FROM spots WHERE {spots}")
    return rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word_at AS (SELECT doc_id, unnest(w) AS w0, unnest(range(0, len(w))) AS p FROM doc),
spots AS (
  SELECT doc_id, p, w0, lead(w0, 1) OVER one AS w1, lead(w0, 2) OVER one AS w2 FROM word_at
  WINDOW one AS (PARTITION BY doc_id ORDER BY p)),
base AS ({" UNION ALL ".join(tests)}),
found AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM base GROUP BY doc_id),
templates(t, label, stride, n, least, least_pairs, n_must) AS (VALUES {values}),
tokens(t, word, most, must) AS (VALUES {tokens}),
pairs(t, pair) AS (VALUES {pairs}),
steps(d) AS (VALUES (0), (1)),
held AS (
  SELECT doc_id, t, p // stride - d AS block, word, most, must, count(*) AS n
  FROM spots JOIN tokens ON w0 = word JOIN templates USING (t), steps
  WHERE p // stride - d >= 0 GROUP BY ALL),
shares AS (
  SELECT doc_id, t, block, sum(least(held.n, most)) AS common, count(*) FILTER (must) AS musts
  FROM held GROUP BY doc_id, t, block),
ordered AS (
  SELECT doc_id, t, p // stride - d AS block, count(DISTINCT pair) AS n_pairs
  FROM spots JOIN pairs ON w0 || ' ' || w1 = pair JOIN templates USING (t), steps
  WHERE p // stride - d >= 0 AND p + 1 < (p // stride - d + 2) * stride GROUP BY ALL),
met AS (
  SELECT doc_id, label, common / CAST(n AS DOUBLE) AS share
  FROM shares JOIN templates USING (t) LEFT JOIN ordered USING (doc_id, t, block)
  WHERE common >= least AND musts = n_must AND coalesce(n_pairs, 0) >= least_pairs),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id),
base_names AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS names
  FROM (SELECT DISTINCT doc_id, label FROM base) x GROUP BY doc_id),
all_names AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS names
  FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM met) x GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_names.names, '') AS base_labels, coalesce(all_names.names, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0.0::DOUBLE) END AS score
FROM doc LEFT JOIN found ON doc.doc_id = found.doc_id LEFT JOIN best ON doc.doc_id = best.doc_id
LEFT JOIN base_names ON doc.doc_id = base_names.doc_id LEFT JOIN all_names ON doc.doc_id = all_names.doc_id
"""


QUERIES = {"op2_licenses": op2_licenses}
SQL = {"op2_licenses": _sql()}
