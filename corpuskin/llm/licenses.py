"""License scanning: an exact set-similarity (containment) join of license templates with the blocks of texts.

DataFrame functions only. A block is a run of as many consecutive words as the template has, wherever lines end. A
template's tokens are ordered by the number of texts that contain them, rarest first; a block that contains the required
share of them must contain one of the first few (the prefix). Texts with enough of a template's tokens (length) are joined
with the prefixes; of their blocks those around a prefix token (position) are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskin.llm.textcols import LOWER, UPPER, let, text_id
from corpuskin.plans.shared import materialize

#: What separates words, in texts that are not lower-cased yet.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Consecutive words and their labels: fixed by the contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """A license's label and notice; words that a block must have, and words that it must not have, to be told from other licenses."""

    label: str
    notice: str
    required: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


#: The notices that licenses ask projects to carry, and usual short forms: fixed values.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit", "license")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("associated",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("fee",)),
    Template("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("organization", "accompanying")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    Template("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse", "promote")),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache",)),
    Template(
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache",),
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public"), ("lesser", "affero")),
    Template("gpl", "under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu", "general", "public"), ("lesser", "affero")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu", "lesser", "general", "public")),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu", "affero", "general", "public")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", ("mozilla",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc")),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc", "by", "sa")),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative", "commons", "attribution"), ("noncommercial", "sharealike", "noderivatives")),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative", "commons", "sharealike"), ("noncommercial",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative", "commons", "noncommercial")),
    Template("cc0", "the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("dedicated", "domain")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered",)),
)

_PHRASE_HEAD = "license"


def _fold(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def _words(text: Column) -> Column:
    """The words; only the first and last items of a split can be empty."""
    return F.filter(F.split(text, SEPARATORS, -1), lambda w: w != "")


def template_words(notice: str) -> list[str]:
    """All words of a template (ASCII), in order."""
    return "".join(c if c.isalnum() else " " for c in notice.lower()).split()


def template_tokens(notice: str) -> list[str]:
    """Distinct words of a template."""
    return sorted(set(template_words(notice)))


def needed(tokens: list[str], threshold: float) -> int:
    return max(1, math.ceil(threshold * len(tokens) - 1e-9))


def _places(words: Column, phrase: str) -> Column:
    """array<long>: word numbers at which the phrase's words stand one after another."""
    want = phrase.split(" ")

    def at(w: Column, i: Column) -> Column:
        same = w == want[0]
        for k, x in enumerate(want[1:], 1):
            same = same & (F.coalesce(F.try_element_at(words, i + k + 1), F.lit("")) == x)
        return F.when(same, i.cast("long"))

    return F.array_compact(F.transform(words, at))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _best_block(placed: Column) -> Column:
    """struct<n, word, blocks>: of the blocks that match the row's template the first with the most of its tokens, and how many match; null if none.

    ``placed`` is array<struct<at, w>>: the template words of a text. A block begins with a token of the template.
    """

    def judged(x: Column, words: Column) -> Column:
        n = F.size(F.array_intersect(words, "tokens"))
        ok = F.arrays_overlap(words, F.col("prefix")) & (n >= F.col("need")) & (F.size(F.array_except("required", words)) == 0) & ~F.arrays_overlap(words, F.col("never"))
        return F.when(ok, F.struct(n.alias("n"), (-x["at"]).alias("back")))

    def blocks(mine: Column) -> Column:
        def block(x: Column, i: Column) -> Column:
            inside = F.filter(F.slice(mine, i + 1, F.col("length")), lambda y: y["at"] < x["at"] + F.col("length"))
            words = F.array_distinct(F.transform(inside, lambda y: y["w"]))
            return F.when(F.array_contains("tokens", x["w"]), let(words, lambda w: judged(x, w)))

        return F.array_compact(F.transform(mine, block))

    mine = F.filter(placed, lambda y: F.array_contains("tokens", y["w"]) | F.array_contains("never", y["w"]))
    best = lambda found: let(F.array_max(found), lambda m: F.struct(m["n"].alias("n"), (-m["back"]).alias("word"), F.size(found).alias("blocks")))
    return let(let(mine, blocks), lambda found: F.when(F.size(found) > 0, best(found)))


def find_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    threshold: float = 0.8,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    A block, which is a run of as many words as a template has, matches it if it contains at least ``threshold`` of its
    distinct words, with all that it requires and none that it excludes. A null text is empty: no words, no places.
    ``score`` is 1 with a base phrase, else the best containment found (0 if none). ``matches`` lists (word, label, share,
    blocks) for each template that matches: where the best block begins, its containment, and how many blocks match.
    Rows are judged by their texts alone, one row each; keys may repeat or be null.
    """
    spark = docs.sparkSession
    tokens = [template_tokens(t.notice) for t in templates]
    least = [needed(t, threshold) for t in tokens]
    vocabulary = sorted({w for t, own in zip(templates, tokens, strict=True) for w in (*own, *t.never)})
    known = _strings(vocabulary)

    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(key).alias("_key"), text_id(body).alias("_t"), body.alias("_text"))
    # in projections of their own, which aren't merged into those that use them often
    split = split.withColumn("_seen", F.array_intersect(F.split(F.lower("_text"), SEPARATORS, -1), known))
    enough = F.lit(False)
    for t, need in zip(tokens, least, strict=True):
        enough = enough | ((F.size("_seen") >= need) & (F.size(F.array_intersect("_seen", _strings(t))) >= need))
    split = split.withColumn("_enough", F.when(F.size("_seen") >= min(least), enough).otherwise(False))
    mentions = F.contains(F.lower("_text"), F.lit(_PHRASE_HEAD))
    split = split.withColumn("_folded", F.when(mentions | F.col("_enough"), _words(_fold(F.col("_text")))))
    none = F.array().cast("array<bigint>")
    placed = F.filter(F.transform("_folded", lambda w, at: F.struct(at.alias("at"), w.alias("w"))), lambda x: F.array_contains(known, x["w"]))
    rows = split.select(
        "_key",
        "_t",
        F.size(_words(F.col("_text"))).cast("long").alias("n_words"),
        *[F.when(mentions, _places(F.col("_folded"), p)).otherwise(none).alias(f"_p{i}") for i, (p, _) in enumerate(PHRASES)],
        "_seen",
        F.when(F.col("_enough"), placed).alias("_placed"),
    )
    rows = materialize(rows, "licenses")  # no texts: counts, places, and the template words

    often = {r["w"]: r["count"] for r in rows.select(F.explode("_seen").alias("w")).groupBy("w").count().collect()}  # a row per template word at most
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    ordered = [sorted(t, key=rank.__getitem__) for t in tokens]
    prefixes = [t[: len(t) - need + 1] for t, need in zip(ordered, least, strict=True)]
    made = [(n, t.label, own, len(own), need, list(t.required), list(t.never), len(template_words(t.notice)), p) for n, (t, own, need, p) in enumerate(zip(templates, tokens, least, prefixes, strict=True))]
    table = spark.createDataFrame(made, "template int, label string, tokens array<string>, size int, need int, required array<string>, never array<string>, length int, prefix array<string>")

    texts = rows.where("_placed IS NOT NULL").select("_t", "_placed").dropDuplicates(["_t"])
    first = F.array_distinct(F.transform("_placed", lambda x: x["w"]))
    met = texts.select("_t", "_placed", first.alias("_words")).select("_t", "_placed", "_words", F.explode("_words").alias("w"))
    # the templates' text bounds what is broadcast
    met = met.join(F.broadcast(table.select("*", F.explode("prefix").alias("w"))), "w").where(F.size(F.array_intersect("_words", "tokens")) >= F.col("need"))
    # a text meets a template at the first of its prefix tokens only
    met = met.where(F.array_intersect("prefix", "_words")[0] == F.col("w"))
    found = met.select("_t", "label", "template", "size", _best_block(F.col("_placed")).alias("b")).where("b IS NOT NULL")
    match = F.struct(F.col("b.word").alias("word"), "label", (F.col("b.n") / F.col("size")).alias("share"), F.col("b.blocks").alias("blocks"))
    found = found.groupBy("_t").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    found = materialize(found, "found")  # a text with many copies can be split in the join only if no aggregate stands right below

    joined = rows.join(found, "_t", "left")
    places = F.concat(*[F.col(f"_p{i}") for i in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    matches = F.coalesce(F.col("matches"), F.array().cast(found.schema["matches"].dataType))
    return joined.select(
        F.col("_key").alias(key),
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.array_distinct(base))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, F.transform(matches, lambda m: m["label"]))))).alias("labels"),
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(matches, lambda m: m["share"])), F.lit(0.0))).alias("score"),
        matches.alias("matches"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_licenses(docs).drop("matches")


def _sql_template(t: Template, threshold: float = 0.8) -> str:
    own = template_tokens(t.notice)
    lists = [f"{list(x)!r}::VARCHAR[]" for x in (own, t.required, t.never)]
    return f"({t.label!r}, {', '.join(lists)}, {len(own)}, {needed(own, threshold)}, {len(template_words(t.notice))})"


_SEP_SQL = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BASE_SQL = "list_filter([CASE WHEN len(m) > 0 THEN 'mit' END, CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END], lambda x: x IS NOT NULL)"
#: Every run of as many words as a template has that begins with one of its words is compared with it.
ORACLE_OP5 = rf"""
WITH t(label, tokens, required, never, size, need, length) AS (VALUES {", ".join(map(_sql_template, TEMPLATES))}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_SEP_SQL}'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT r, doc_id, w,
  list_filter(range(len(w)), lambda i: w[i+1] = 'mit' AND w[i+2] = 'license') AS m,
  list_filter(range(len(w)), lambda i: w[i+1] = 'apache' AND w[i+2] = 'license') AS a,
  list_filter(range(len(w)), lambda i: w[i+1] = 'general' AND w[i+2] = 'public' AND w[i+3] = 'license') AS g FROM d),
c AS (SELECT r, w, t.*, unnest(list_filter(range(len(w)), lambda i: list_contains(tokens, w[i+1]))) AS i FROM d, t WHERE len(list_intersect(w, tokens)) >= need),
b AS (SELECT r, label, tokens, required, never, size, need, list_distinct(w[i+1:i+length]) AS x FROM c),
h AS (SELECT r, label, max(len(list_intersect(x, tokens))::DOUBLE / size) AS share FROM b WHERE len(list_intersect(x, tokens)) >= need AND len(list_intersect(x, required)) = len(required) AND NOT list_has_any(x, never) GROUP BY ALL),
f AS (SELECT r, list(label) AS labels, max(share) AS share FROM h GROUP BY r)
SELECT p.doc_id, len(w)::BIGINT AS n_words, (len(m) + len(a) + len(g))::BIGINT AS n_base,
  list_min(m || a || g)::BIGINT AS first_word, list_max(m || a || g)::BIGINT AS last_word,
  array_to_string(list_sort({_BASE_SQL}), ',') AS base_labels,
  array_to_string(list_sort(list_distinct({_BASE_SQL} || coalesce(f.labels, []))), ',') AS labels,
  CASE WHEN len(m) + len(a) + len(g) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM p LEFT JOIN f ON p.r = f.r
"""
