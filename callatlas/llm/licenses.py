"""License scans by diagonal voting, with DataFrame functions only.

Every run of three words of a document meets, by its hash, the places where the license templates have it. A meeting votes for
a diagonal, the document's place less the template's; votes of one license line up on one diagonal, or on neighbouring ones
where words were put in or left out. Diagonals that are near each other are merged, and what they cover of the template is
verified.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import durable, let

#: Words of three or more templates' runs; a template has that many words at least.
GRAM = 3
#: Least share of a template's words that a span covers.
SHARE = 0.8

#: Runs of the templates are broadcast up to so many (some 20 MB), else both sides are shuffled by hash.
FEW_RUNS = 200_000

#: Words, once A-Z are lower-case; and what stands between the words of a text as it is.
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Names of licenses as notices write them, by label.
NAMES = {
    "mit": ("the MIT License",),
    "apache-2.0": ("the Apache License, Version 2.0",),
    "bsd-2-clause": ("the BSD 2-Clause License",),
    "bsd-3-clause": ("the BSD 3-Clause License",),
    "isc": ("the ISC License",),
    "mpl-2.0": ("the Mozilla Public License, version 2.0",),
    "gpl-2.0": ("the GNU General Public License, version 2",),
    "gpl-3.0": ("the GNU General Public License, version 3",),
    "lgpl-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "lgpl-3.0": ("the GNU Lesser General Public License, version 3",),
    "agpl-3.0": ("the GNU Affero General Public License, version 3",),
    "cc-by-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nd-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nc-sa-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd-4.0": ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
NOTICES = ("Licensed under {}", "Released under {}", "This work is licensed under {}")

#: License texts and headers, by label.
TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def words_of(text: str) -> list[str]:
    """The words of a template, as those of a document are taken."""
    return re.findall(LOWER_WORD, text.translate(str.maketrans(UPPER, LOWER)))


def default_templates() -> list[tuple[str, str]]:
    """(label, text): notices with every name, and the texts."""
    notices = [(label, n.format(name)) for label, names in NAMES.items() for name in names for n in NOTICES]
    return notices + list(TEXTS.items())


def _template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """hash, gram, template, label, length, at: one row for each run of GRAM words of a template."""
    rows = []
    for k, (label, text) in enumerate(templates):
        words = words_of(text)
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words or more: {text!r}")
        rows += [(" ".join(words[i : i + GRAM]), k, label, len(words), i) for i in range(len(words) - GRAM + 1)]
    grams = spark.createDataFrame(rows, "gram string, template int, label string, length int, at int").withColumn("hash", F.xxhash64("gram"))
    return F.broadcast(grams) if len(rows) <= FEW_RUNS else grams


def _words(text: Column) -> Column:
    """Words as they are written; to split takes half the time of to extract."""
    return F.array_remove(F.split(text, BETWEEN), "")


def _lower_words(text: Column) -> Column:
    return _words(F.translate(text, UPPER, LOWER))


def _places(text: Column, phrases: dict[str, str]) -> Column:
    """array<struct<at, label>>: where the words of a phrase stand one after the other. A text that no phrase fits, nearly all,
    is looked at once by a pattern."""
    empty = F.expr("cast(array() as array<struct<at:int,label:string>>)")

    def places(words: Column, phrase: list[str], label: str) -> Column:
        stands = lambda i: _all([F.get(words, i + j).eqNullSafe(w) for j, w in enumerate(phrase)])
        found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)
        return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    def starts(words: Column) -> Column:
        return F.concat(*(places(words, phrase.split(" "), label) for phrase, label in phrases.items()))

    likely = "(?i)" + "|".join(BETWEEN.join(p.split(" ")) for p in phrases)
    return F.when(text.rlike(likely), let(_lower_words(text), starts)).otherwise(empty)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """key, template, label, length, diagonal, at: template places where documents have the same GRAM words, by diagonal.

    docs: key, text. Every run of words joins the templates' by hash, and its words are compared where hashes meet. A diagonal holds
    each template place once at most, so what is collected is no longer than a template, and copies add nothing.
    """
    words = docs.select("key", _lower_words(F.col("text")).alias("words"))
    gram = lambda w, i: F.concat_ws(" ", w, *(F.get("words", i + k) for k in range(1, GRAM)))
    runs = words.where(F.size("words") >= GRAM).select("key", F.posexplode(F.transform("words", gram)).alias("place", "words_here")).withColumn("hash", F.xxhash64("words_here"))
    met = runs.join(grams, "hash").where(F.col("words_here") == F.col("gram"))
    return met.groupBy("key", "template", "label", "length", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"))


def _span(diagonals: Column) -> Column:
    """start, end (words of the document) and covered (words of the template) of an array of struct<diagonal, at>."""
    ends = lambda pick, of: pick(F.transform(diagonals, lambda d: d["diagonal"] + of(d["at"])))
    covered = F.array_distinct(F.flatten(F.flatten(F.transform(diagonals, lambda d: F.transform(d["at"], lambda t: F.sequence(t, t + GRAM - 1))))))
    return F.struct(ends(F.array_min, F.array_min).alias("start"), (ends(F.array_max, F.array_max) + GRAM).alias("end"), F.size(covered).alias("covered"))


def spans(found: DataFrame, share: float = SHARE) -> DataFrame:
    """key, label, start, end, covered, share: verified spans of votes, the best of those that overlap.

    Diagonals of one template merge while neighbours differ by at most `slack` = the words that may be missing, and one at
    least. A merged span is verified if it covers `share` of the template's words and is at most `slack` words longer than it;
    if it is not, each of its diagonals is tried by itself. Of spans that overlap, through others too, the one with the
    greatest share stays, then the one that covers more, then the last label.
    """
    slack = F.greatest(F.floor(F.col("length") * (1 - share) + 1e-9).cast("int"), F.lit(1))
    by_place = Window.partitionBy("key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_place) > slack, F.lit(True)).cast("int")
    grouped = found.withColumn("far", far).withColumn("group", F.sum("far").over(by_place))
    merged = grouped.groupBy("key", "template", "label", "length", "group").agg(F.collect_list(F.struct("diagonal", "at")).alias("diagonals"))
    holds = lambda s: (s["covered"] >= share * F.col("length") - 1e-9) & (s["end"] - s["start"] <= F.col("length") + slack)
    single = F.filter(F.transform("diagonals", lambda d: _span(F.array(d))), holds)
    each = merged.withColumn("whole", _span(F.col("diagonals"))).select("key", "label", "length", F.explode(F.when(holds(F.col("whole")), F.array("whole")).otherwise(single)).alias("s")).select("key", "label", "s.*", (F.col("s.covered") / F.col("length")).alias("share"))
    in_order = Window.partitionBy("key").orderBy("start", F.desc("end"), "label", "covered")
    apart = F.coalesce(F.col("start") >= F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    placed = each.withColumn("apart", apart).withColumn("place", F.sum("apart").over(in_order))
    best = placed.groupBy("key", "place").agg(F.max(F.struct("share", "covered", "label", "start", "end")).alias("best"))
    return best.select("key", "best.*")


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] = PHRASES, share: float = SHARE) -> DataFrame:
    """Licenses in each text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    docs: doc_id, text; other columns are ignored. templates: (label, text), each of GRAM words or more; words are taken as the
    contract says. n_base counts all places of the phrases, first_word and last_word are the least and the greatest of their
    starts (null without any); base_labels and labels (with those of verified spans) are distinct, sorted and joined by commas;
    score is the greatest share of a template that a span covers, else 0; spans: array<struct<start, end, label, share>>
    in words, end exclusive, by start.

    Null texts are empty; empty texts have no words; equal texts, repeated rows and copies among them, have equal results, found once
    by their SHA-256; a very long text is a row for each of its words where it is read; ties between labels as `spans` states; an
    empty table gives none. Without templates only phrases are found. Only what meets a template leaves the scan; the rows of
    documents, without their texts, join what was found.
    """
    spark = docs.sparkSession
    templates = default_templates() if templates is None else templates
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))
    rows = keyed.select("doc_id", "key", F.size(_words(F.col("text"))).cast("bigint").alias("n_words"), _places(F.col("text"), phrases).alias("places"))
    best = spans(votes(keyed, _template_grams(spark, templates)), share)
    span = F.struct("start", "end", "label", "share")
    found = best.groupBy("key").agg(F.collect_set("label").alias("added"), F.max("share").alias("score"), F.sort_array(F.collect_list(span)).alias("spans"))
    both = rows.join(durable(found), "key", "left")  # a table, so that the copies of one text can be split among tasks
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    added = F.coalesce("added", F.expr("cast(array() as array<string>)"))
    starts = F.transform("places", lambda p: p["at"])
    labels = lambda a: F.array_join(F.sort_array(a), ",")
    return both.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.array_union(base, added)).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int,label:string,share:double>>)")).alias("spans"))
