"""License scans: an exact set-similarity join of text blocks with license templates.

A block is any run of half as many words again as the template has. Template words are ordered by document
frequency over all documents, rarest first. A block holds at least a share THRESHOLD of a template's words only if it holds one of its |T| - ceil(THRESHOLD |T|) + 1 rarest, so only those
prefix words are looked up, in an inverted list of template numbers. A template of which the whole text holds too few words drops out (length filter).
A place of a prefix word fixes the blocks that could match: those within the template's reach of it (positional filter); where all of them together hold too few of
the words they drop out too, and the rest are verified one by one by intersection. The templates are a fixed short list,
so the inverted list is a literal and the join needs no shuffle: a hot source or phrase costs only its rows.

Templates that share the threshold of words are told apart: a block must hold a word of the template that the other lacks, and where a found
template holds all words of another found one (three clauses and two), only the larger is labelled. The score is the greatest containment of a labelled
template, and BASE_SCORE where only a phrase is found.

A null text has no words. An empty table gives an empty result. Repeated rows each get a row. Templates that match equally well are all labelled. Very long
texts are worked on whole, in time linear in their words but for verified blocks. Extra columns are ignored, whatever their names.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Score of a text in which only a phrase is found.
BASE_SCORE = 0.5
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license texts and the notices by which the longer licenses are applied.
_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software")
_MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
    "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
    "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary "
    "form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution ")
_BSD_THIRD = (
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission ")
_BSD_TAIL = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for "
    "any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss "
    "of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
    "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage")
_ISC = _GRANT + (
    " provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
    "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any "
    "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
    "negligence or other tortious action arising out of or in connection with the use or performance of this software")
_ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use "
    "of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute "
    "it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original "
    "software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source "
    "versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any "
    "source distribution")
_UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
    "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means")
_APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the "
    "license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
    "permissions and limitations under the license")
_GNU = (
    "this {it} is free software you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free "
    "software foundation either version {v} of the license or at your option any later version this {it} is distributed in the hope that it will be useful "
    "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {kind}general public "
    "license for more details")
_MPL = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain "
    "one at http mozilla org mpl 2 0")

#: Words of each template, and its label.
TEMPLATES = {
    "released under the mit license": "mit-notice",
    _MIT: "mit-text",
    _BSD_HEAD + _BSD_TAIL: "bsd-2-clause",
    _BSD_HEAD + _BSD_THIRD + _BSD_TAIL: "bsd-3-clause",
    _BSD_HEAD.split(" provided that")[0]: "bsd-grant",
    _ISC: "isc",
    _ZLIB: "zlib",
    _UNLICENSE: "unlicense",
    _APACHE: "apache-2.0",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    _GNU.format(it="program", kind="", v="2"): "gpl-2.0-or-later",
    _GNU.format(it="program", kind="", v="3"): "gpl-3.0-or-later",
    _GNU.format(it="library", kind="lesser ", v="2 1"): "lgpl-2.1-or-later",
    _GNU.format(it="program", kind="affero ", v="3"): "agpl-3.0-or-later",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    _MPL: "mpl-2.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-notice",
    "all rights reserved": "all-rights-reserved",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _need(tokens: list[str]) -> int:
    return math.ceil(THRESHOLD * len(tokens) - 1e-9)


def normal(text: Column) -> Column:
    """Words joined by single spaces, A-Z in lower case."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " "))


def template_tokens(templates: dict[str, str]) -> list[list[str]]:
    return [sorted(set(t.split())) for t in templates]


def told_apart(tokens: list[list[str]]) -> tuple[list[list[list[str]]], list[list[int]]]:
    """For each template: the words that tell it from each one that shares the threshold of its words, and the templates that hold all of its words."""
    telling, larger = [], []
    for i, a in enumerate(map(set, tokens)):
        others = [(j, set(b)) for j, b in enumerate(tokens) if j != i]
        telling.append(sorted({tuple(sorted(a - b)) for _, b in others if len(a & b) >= _need(tokens[i]) and a - b}))
        larger.append([j for j, b in others if a < b])
    return telling, larger


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each template word, over all documents."""
    held = F.array_intersect(F.split(normal(F.col("text")), " "), F.array(*map(F.lit, vocabulary)))
    return dict(map(tuple, docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()))


def _texts(xs) -> str:
    return "cast(array(" + ", ".join(f"'{x}'" for x in xs) + ") as array<string>)"


def _numbers(xs) -> str:
    return "cast(array(" + ", ".join(map(str, xs)) + ") as array<int>)"


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    tokens = template_tokens(templates)
    names = list(templates.values())
    df = document_frequency(docs, sorted({t for ts in tokens for t in ts}))
    index: dict[str, list[int]] = {}
    for i, ts in enumerate(tokens):
        ordered = sorted(ts, key=lambda t: (df.get(t, 0), t))
        for t in ordered[: len(ts) - _need(ts) + 1]:
            index.setdefault(t, []).append(i)
    prefix = sorted(index)
    lists = "map(" + ", ".join(f"'{t}', {_numbers(index[t])}" for t in prefix) + ")"
    sets = "array(" + ", ".join(map(_texts, tokens)) + ")"
    reach = _numbers(len(t.split()) + len(t.split()) // 2 for t in templates)
    need = _numbers(map(_need, tokens))
    telling, larger = told_apart(tokens)
    telling = "array(" + ", ".join("cast(array(" + ", ".join(map(_texts, x)) + ") as array<array<string>>)" for x in telling) + ")"
    larger = "array(" + ", ".join(map(_numbers, larger)) + ")"

    d = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    d = d.select("doc_id", F.expr("CASE WHEN norm = '' THEN cast(array() as array<string>) ELSE split(norm, ' ') END").alias("w"))
    d = d.select("doc_id", "w", F.size("w").cast("bigint").alias("n_words"), F.expr(f"array_intersect({_texts(prefix)}, w)").alias("rare"),
                 F.expr(f"array_intersect({_texts(sorted({p.split()[-1] for p in phrases}))}, w)").alias("ends"))
    places = []
    for i, phrase in enumerate(phrases):
        test = " AND ".join(f"try_element_at(w, i + {j + 1}) <=> '{x}'" for j, x in enumerate(phrase.split()))
        d = d.withColumn(f"b{i}", F.expr(f"CASE WHEN array_contains(ends, '{phrase.split()[-1]}') THEN filter(sequence(0, size(w) - 1), i -> {test}) ELSE {_numbers([])} END"))
        places.append(f"b{i}")
    d = d.withColumn("base", F.concat(*places))
    d = d.withColumn("ts", F.expr(f"""filter(array_distinct(flatten(transform(rare, x -> element_at({lists}, x)))),
        t -> size(array_intersect({sets}[t], w)) >= {need}[t])"""))
    d = d.withColumn("hits", F.expr(f"""CASE WHEN size(ts) = 0 THEN cast(array() as array<struct<t: int, i: int>>) ELSE
        flatten(transform(filter(transform(w, (x, i) -> struct(x as x, i as i)), s -> array_contains(rare, s.x)),
        s -> transform(array_intersect(element_at({lists}, s.x), ts), t -> struct(t as t, s.i as i)))) END"""))
    d = d.withColumn("near", F.expr(f"""filter(hits, c -> size(array_intersect(
        slice(w, greatest(c.i - {reach}[c.t], 0) + 1, least(c.i, {reach}[c.t]) + {reach}[c.t]), {sets}[c.t])) >= {need}[c.t])"""))
    block = f"slice(w, b + 1, {reach}[c.t])"
    d = d.withColumn("exact", F.expr(f"""transform(near, c -> struct(c.t as t, coalesce(array_max(transform(filter(
        sequence(greatest(c.i - {reach}[c.t] + 1, 0), c.i), b -> forall({telling}[c.t], x -> arrays_overlap(x, {block}))),
        b -> size(array_intersect({block}, {sets}[c.t])))), 0) as n))"""))
    d = d.withColumn("all_found", F.expr(f"filter(exact, c -> c.n >= {need}[c.t])"))
    d = d.withColumn("found", F.expr(f"filter(all_found, c -> NOT arrays_overlap(all_found.t, {larger}[c.t]))"))
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"b{i}") > 0, label) for i, label in enumerate(phrases.values())]))
    d = d.withColumn("base_list", base_labels)
    own = F.expr(f"transform(found, c -> {_texts(names)}[c.t])")
    best = F.expr(f"array_max(transform(found, c -> c.n / size({sets}[c.t])))")
    return d.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min("base").cast("bigint").alias("first_word"),
        F.array_max("base").cast("bigint").alias("last_word"), F.array_join(F.array_sort("base_list"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_list", own)), ",").alias("labels"),
        F.coalesce(best, F.when(F.size("base") > 0, BASE_SCORE), F.lit(0.0)).cast("double").alias("score"))
