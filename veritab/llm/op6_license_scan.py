"""Operator 6: licence texts and notices in documents, by the Dice coefficient over word bigrams.

Units of a document are its lines, its paragraphs of more than one line, and its whole text if it
has more than one paragraph. A unit is normalised to lower-case
words, its bigrams are compared with those of every template, and matches of at least `min_dice`
are reported with the best unit. Dice is at most 2 min(a, b) / (a + b), so a template is a
candidate only for units between d / (2 - d) and (2 - d) / d of its size: units outside all
bounds are never exploded, and the join on bigrams checks the bound of the pair.

The template table is fixed text in this file, which bounds what is broadcast. Everything is column
expressions: units are hashed into bigrams inside a row, and only bigrams that a candidate
template has are shuffled.

Defined results: null or wordless text matches nothing; a unit of one word has no bigrams; equal best
scores take the first unit in the order line, paragraph, text; rows that repeat a doc_id with the
same text are reported once, with other texts each on its own (texts are told apart by 64-bit hashes), null ids alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table

MIN_DICE = 0.8
NOT_WORD = r"[^\p{L}\p{N}\n]+"

# Public licence notices and texts, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
)


def normalised(text: Column) -> Column:
    """Lower case, everything but letters, digits and line ends one space."""
    return F.regexp_replace(F.lower(text), NOT_WORD, " ")


def with_bigrams(rows: DataFrame, body: str, name: str) -> DataFrame:
    """`rows` with the distinct word bigrams of a normalised text, hashed, in place of the text.

    The words are a column of their own, so that they are cut once and not for every bigram.
    """
    cut = rows.withColumn("__words", F.filter(F.split(F.replace(F.col(body), F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")).drop(body)
    words, count = F.col("__words"), F.greatest(F.size("__words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), count), F.slice(words, F.lit(2), count), lambda a, b: F.xxhash64(a, b))
    return cut.withColumn(name, F.array_distinct(pairs)).drop("__words")


def template_bigrams(spark, templates) -> DataFrame:
    """(template, licence, t_size, bigram); one row per bigram of the fixed templates."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, licence string, body string")
    cut = with_bigrams(rows.withColumn("body", normalised(F.col("body"))), "body", "all")
    return cut.select("template", "licence", F.size("all").alias("t_size"), F.explode("all").alias("bigram"))


def template_sizes(spark, templates) -> list[int]:
    return sorted({r.t_size for r in template_bigrams(spark, templates).select("t_size").distinct().collect()})


def scan(docs: DataFrame, min_dice: float = MIN_DICE, templates=TEMPLATES) -> DataFrame:
    """(doc_id, licence, dice, unit, place, n_units): the best unit of every licence found in a document.

    unit is line, paragraph or text, place its number from 0, n_units the number of units that match.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), normalised(F.col("text").cast("string")).alias("text"))
    rows = rows.select("doc_id", "row", "text", F.split("text", "\n *\n", -1).alias("parts"))
    unit = lambda kind: lambda body, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), body.alias("body"))
    lines, paragraphs = F.transform(F.split("text", "\n", -1), unit(0)), F.transform(F.filter("parts", lambda p: p.contains("\n")), unit(1))
    whole = F.transform(F.when(F.size("parts") > 1, F.array("text")).otherwise(F.array().cast("array<string>")), unit(2))
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    sizes = template_sizes(spark, templates)
    units = rows.select("doc_id", "row", F.explode(F.concat(lines, paragraphs, whole)).alias("unit")).select("doc_id", "row", "unit.*")
    units = with_bigrams(units, "body", "all")
    # not a filter: that would be moved below the column and cut every text twice
    fits = F.size("all").between(min(sizes, default=0) * low, max(sizes, default=0) * high)
    probes = units.select("doc_id", "row", "kind", "place", F.coalesce(F.size("all"), F.lit(0)).alias("u_size"), F.explode(F.when(fits, F.col("all"))).alias("bigram"))
    index = F.broadcast(template_bigrams(spark, templates))
    bound = (F.col("u_size") >= F.col("t_size") * low) & (F.col("u_size") <= F.col("t_size") * high)
    met = probes.join(index, (probes["bigram"] == index["bigram"]) & bound)
    shared = met.groupBy("doc_id", "row", "kind", "place", "u_size", "template", "licence", "t_size").agg(F.count_distinct(probes["bigram"]).alias("shared"))
    scored = shared.withColumn("dice", F.lit(2.0) * F.col("shared") / (F.col("u_size") + F.col("t_size"))).filter(F.col("dice") >= min_dice)
    best = scored.groupBy("doc_id", "row", "licence").agg(
        F.max("dice").alias("dice"),
        F.max_by(F.struct("kind", "place"), F.struct("dice", -F.col("kind"), -F.col("place"))).alias("at"),
        F.count_distinct("kind", "place").alias("n_units"),
    )
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("line", "paragraph", "text")]), F.col("at.kind") + 1)
    return best.select("doc_id", "licence", "dice", kinds.alias("unit"), F.col("at.place").cast("long").alias("place"), "n_units")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALUES = ", ".join(f"({k}, {_quoted(name)}, {_quoted(text)})" for k, (name, text) in enumerate(TEMPLATES))
_NORMAL = rf"regexp_replace(lower(%s), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


_WORDS = "list_filter(regexp_split_to_array(%s, '[ \\n]+'), lambda x: x <> '')"
_BIGRAMS = "list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))"


ORACLE = f"""
    WITH t AS (
        SELECT template, licence, {_BIGRAMS} AS b
        FROM (SELECT template, licence, {_WORDS % (_NORMAL % 'body')} AS w FROM (VALUES {_VALUES}) v(template, licence, body))
    ), d AS (
        SELECT DISTINCT doc_id, md5(text) AS src, {_NORMAL % 'text'} AS body FROM documents WHERE text IS NOT NULL
    ), parts AS (
        SELECT doc_id, src, body, string_split(body, chr(10)) AS ls, regexp_split_to_array(body, '\\n *\\n') AS ps FROM d
    ), units AS (
        SELECT doc_id, src, 0 AS kind, unnest(range(len(ls))) AS place, unnest(ls) AS body FROM parts
        UNION ALL SELECT doc_id, src, 1, unnest(range(len(ls))) AS place, unnest(ls) FROM (SELECT doc_id, src, list_filter(ps, lambda p: contains(p, chr(10))) AS ls FROM parts)
        UNION ALL SELECT doc_id, src, 2, 0, body FROM parts WHERE len(ps) > 1
    ), u AS (
        SELECT doc_id, src, kind, place, {_BIGRAMS} AS b FROM (SELECT doc_id, src, kind, place, {_WORDS % 'body'} AS w FROM units)
    ), scored AS (
        SELECT doc_id, src, kind, place, licence, 2.0::DOUBLE * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) AS dice
        FROM u, t WHERE len(u.b) BETWEEN len(t.b) * {MIN_DICE / (2 - MIN_DICE)} AND len(t.b) * {(2 - MIN_DICE) / MIN_DICE}
    ), kept AS (SELECT * FROM scored WHERE dice >= {MIN_DICE}),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id, src, licence ORDER BY dice DESC, kind, place) AS r FROM kept
    )
    SELECT doc_id, licence, dice, ['line', 'paragraph', 'text'][kind + 1] AS unit, place::BIGINT AS place,
           (SELECT count(DISTINCT kind * 1000000 + place) FROM kept k WHERE k.doc_id IS NOT DISTINCT FROM ranked.doc_id AND k.src = ranked.src AND k.licence = ranked.licence) AS n_units
    FROM ranked WHERE r = 1
"""


@query("op6_license_scan", ORACLE)
def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
