"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import sized, whole
from tapeloom.session import materialize

LEAST = 0.75

# Well-known licence notices, by their usual short names.
TEMPLATES = (
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT-line", "Released under the MIT License."),
    ("BSD-3-Clause-line", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0-line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
)
#: Whole texts, one file each, by the file's name.
TEMPLATES += tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
NOT_WORD = r"[^\p{L}\p{N}]+"
PARAGRAPH = r"\n[\x20\x09\x0B-\x0D]*\n"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def with_bigrams(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``grams``, the distinct word bigrams of ``text``; fewer than two words have none."""
    df = df.withColumn("_w", words(text))
    heads = F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0)))
    df = df.withColumn("_a", heads).withColumn("_b", F.slice("_w", F.lit(2), F.lit(1 << 30)))
    return df.withColumn("grams", F.array_distinct(F.zip_with("_a", "_b", lambda a, b: F.concat(a, F.lit(" "), b)))).drop("_w", "_a", "_b")


def with_all_bigrams(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``every``, the word bigrams of ``text`` in order, repeats included."""
    df = df.withColumn("_w", words(text))
    heads = F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0)))
    df = df.withColumn("_a", heads).withColumn("_b", F.slice("_w", F.lit(2), F.lit(1 << 30)))
    return df.withColumn("every", F.zip_with("_a", "_b", lambda a, b: F.concat(a, F.lit(" "), b))).drop("_w", "_a", "_b")


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, template string")


def units(text: Column) -> Column:
    """What is compared: every line, every paragraph of several lines, and the text if it has several paragraphs."""
    piece = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("place"), x.alias("body"))
    lines, paragraphs = F.split(text, "\n"), F.split(text, PARAGRAPH)
    several = F.filter(F.transform(paragraphs, piece("paragraph")), lambda p: p["body"].contains("\n"))
    all_ = F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("place"), text.alias("body"))))
    none = F.array().cast("array<struct<unit:string,place:int,body:string>>")
    return F.concat(F.transform(lines, piece("line")), several, F.coalesce(all_, none))


def near_texts(own: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """The rows of ``own`` (doc_id, _row, text) that can hold a match, written.

    Any unit or passage that reaches ``least`` with a template has a share of least / (2 - least) of its distinct
    bigrams, and all of them are neighbours in the whole text. So one pass looks up the texts' bigrams: per text and
    template hits with repeats are counted, and the template's bigrams, in 64 slots, marked as seen. Both only
    overcount, and both combine map-side: a row per text and template is shuffled, never a hit.
    """
    share = F.col("m") * F.lit(least / (2 - least)) - 1e-6
    index = marks.select("_t", "m", F.posexplode("grams").alias("_i", "_g")).withColumn("_g", F.split("_g", " "))
    index = F.broadcast(index.select("_t", "m", F.expr("shiftleft(1L, _i % 64)").alias("_bit"), F.xxhash64(F.get("_g", F.lit(0)), F.get("_g", F.lit(1))).alias("h")))
    pairs = own.select("_row", words(F.col("text")).alias("_w"))
    pairs = pairs.withColumn("_next", F.slice("_w", F.lit(2), F.lit(1 << 30)))
    # the last word meets a null; outer, so that no filter evaluates the words once more
    pairs = pairs.select("_row", F.explode_outer(F.zip_with("_w", "_next", lambda a, b: F.xxhash64(a, b))).alias("h"))
    seen = pairs.join(index, "h").groupBy("_row", "_t", "m").agg(F.count(F.lit(1)).alias("_hits"), F.bit_or("_bit").alias("_bits"))
    seen = seen.where((F.col("_hits") >= share) & (F.bit_count("_bits") * F.ceil(F.col("m") / 64) >= share))
    ids = materialize(seen.select("_row").distinct(), "license-near")
    return materialize(own.join(sized(ids, ids.count()), "_row", "left_semi"), "license-near-texts")


def passages(rows: DataFrame, marks: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Runs of words inside a text that reach ``least`` with a template: _row, place (first word, from 0), license, n_bigrams, common, dice.

    The best window may be taken to begin and end at runs of template bigrams: one more common bigram beside
    it never lowers Dice. A document must hold a share of least / (2 - least) of a template's distinct bigrams somewhere;
    for those pairs alone all windows from run to run are scored, up to a template's length (repeats
    counted) divided by that share. Of windows of a license that overlap the highest Dice stays, then the shorter,
    the earlier; so it is for two licenses if half of the longer window is shared (a short notice inside a long one is
    a row of its own). Windows that meet a unit in ``found`` in this way are left out.
    Hits are looked up by 64-bit hashes, counts come from the words.
    """
    ratio = least / (2 - least)
    index = F.broadcast(marks.select("license", "m", "long", F.explode("grams").alias("_g")).select("license", "m", "long", F.xxhash64("_g").alias("h")))
    pairs = rows.select("_row", words(F.col("text")).alias("_w"))
    pairs = pairs.select("_row", F.posexplode(F.zip_with(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", F.lit(2), F.lit(1 << 30)), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))).alias("pos", "h"))
    hits = pairs.join(index, "h")
    own = ["_row", "license", "m", "long"]
    seen = hits.groupBy(*own, "h").agg(F.collect_list("pos").alias("at"))
    seen = seen.groupBy(*own).agg(F.count(F.lit(1)).alias("_c"), F.sort_array(F.flatten(F.collect_list("at"))).alias("at"))
    seen = materialize(seen.where(F.col("_c") >= F.col("m") * F.lit(ratio)).drop("_c"), "license-places")
    # runs of neighbours: first and last place, and hits up to and before them
    seen = seen.withColumn("_n", F.size("at"))
    heads = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: (i == 0) | (F.get("at", i - 1) < F.get("at", i) - 1))
    tails = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: (i == F.col("_n") - 1) | (F.get("at", i + 1) > F.get("at", i) + 1))
    seen = materialize(seen.withColumn("_heads", heads).withColumn("_tails", tails), "license-runs")
    # a window is no longer than its reach: a start meets the ends of its own stretch of that length and of the next, never all of them
    seen = seen.withColumn("reach", F.ceil(F.col("long") / F.lit(ratio)).cast("int"))
    starts = seen.select(*own, "reach", "at", F.explode("_heads").alias("_i")).withColumn("a", F.get("at", F.col("_i"))).drop("at")
    starts = starts.withColumn("stretch", F.explode(F.array(F.floor(F.col("a") / F.col("reach")), F.floor(F.col("a") / F.col("reach")) + 1)))
    ends = seen.select("_row", "license", "reach", "at", F.explode("_tails").alias("_j")).withColumn("b", F.get("at", F.col("_j")))
    ends = ends.select("_row", "license", F.floor(F.col("b") / F.col("reach")).alias("stretch"), "_j", "b")
    one = starts.join(ends, ["_row", "license", "stretch"])
    one = one.where((F.col("_j") >= F.col("_i")) & (F.col("_j") - F.col("_i") + 1 >= F.col("m") * F.lit(ratio)) & ((F.col("b") - F.col("a") + 1) * F.lit(ratio) <= F.col("long")))
    texts = rows.join(seen.select("_row").distinct(), "_row", "left_semi")
    texts = materialize(with_all_bigrams(texts, F.col("text")), "license-texts")
    one = one.select(*own, "a", "b").join(texts.select("_row", "every"), "_row").join(F.broadcast(marks.select("license", "grams")), "license")
    one = one.withColumn("_x", F.array_distinct(F.slice("every", F.col("a") + 1, F.col("b") - F.col("a") + 1)))
    one = one.select("_row", "license", "m", "a", "b", F.size("_x").alias("n_bigrams"), F.size(F.array_intersect("_x", "grams")).cast("long").alias("common"))
    one = one.withColumn("dice", 2 * F.col("common") / (F.col("n_bigrams") + F.col("m"))).where(F.col("dice") >= least)
    # units are found by line and paragraph; their first word is counted here, in texts with a match only
    units_at = found.groupBy("_row").agg(F.collect_list(F.struct("unit", "place", "license", "dice")).alias("_units"))
    first = lambda u, body, n: F.size(words(F.array_join(F.slice(F.split(body, n), F.lit(1), u["place"]), "\n")))
    length = lambda u, body, n: F.size(words(F.get(F.split(body, n), u["place"])))
    body = F.col("text")
    kind = lambda u, f, rest: F.when(u["unit"] == "line", f(u, body, "\n")).when(u["unit"] == "paragraph", f(u, body, PARAGRAPH)).otherwise(rest)
    ranged = F.transform("_units", lambda u: F.struct(kind(u, first, F.lit(0)).alias("a"), kind(u, length, F.size(words(body))).alias("n"), u["license"].alias("license"), u["dice"].alias("dice")))
    ranged = F.transform(ranged, lambda u: F.struct(u["a"].alias("a"), (u["a"] + u["n"] - 2).alias("b"), u["license"].alias("license"), u["dice"].alias("dice")))  # b: last bigram
    known = texts.select("_row", "text").join(units_at, "_row").select("_row", ranged.alias("_known"))
    item = F.struct((-F.col("dice")).alias("d"), (F.col("b") - F.col("a")).alias("len"), "a", "license", "b", "n_bigrams", "common", "dice")
    taken = one.groupBy("_row").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    common = lambda x, c: F.least(x["b"], c["b"]) - F.greatest(x["a"], c["a"]) + 1
    longer = lambda x, c: F.greatest(x["b"] - x["a"], c["b"] - c["a"]) + 1
    meets = lambda x, c: (common(x, c) > 0) & ((x["license"] == c["license"]) | ((common(x, c) * 2 >= longer(x, c)) & (c["dice"] >= x["dice"])))
    pick = F.aggregate("_all", F.filter("_all", lambda x: F.lit(False)), lambda got, x: F.when(F.exists(got, lambda c: meets(x, c)), got).otherwise(F.concat(got, F.array(x))))
    taken = taken.select("_row", pick.alias("_all")).join(known, "_row", "left")
    new = F.filter("_all", lambda x: ~F.coalesce(F.exists("_known", lambda u: meets(x, u)), F.lit(False)))
    taken = taken.select("_row", F.explode(new).alias("_x"))
    return taken.select("_row", F.col("_x.a").alias("place"), "_x.license", "_x.n_bigrams", "_x.common", "_x.dice")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """Matches: doc_id, unit, place (from 0), license, n_bigrams, common, dice - the best template of every unit that reaches ``least``.

    Units are lines, paragraphs of several lines and the text; a notice that is none of these (inside a longer line, over
    several paragraphs of a longer text) is a unit ``passage`` whose place is its first word, see ``passages``.

    Dice is 2 common / (n + m) over distinct bigrams of normalised words; ties go to the first license by
    name. Null and empty texts, units of one word and documents without a match give no rows; rows that
    repeat give their matches again. Templates are a small table, checked to be under a thousand rows.

    Texts that hold too few bigrams of every template are left out first, see ``near_texts``; only the others are cut into units.
    A unit with n bigrams can only reach ``least`` with a template of n * least / (2 - least) to its inverse;
    units outside the range of all templates are dropped before their bigrams are made into rows, and
    each template outside it is left out of the match. The bigrams then meet an index of the templates' bigrams
    by broadcast; counts per unit and template combine map-side, so only candidates are shuffled.
    """
    spark = docs.sparkSession
    table = default_templates(spark) if templates is None else templates
    if table.limit(1000).count() >= 1000:
        raise ValueError("too many templates to broadcast")
    ratio = least / (2 - least)
    marks = with_bigrams(table, F.col("template")).withColumn("m", F.size("grams")).where("m > 0")
    span = marks.agg(F.struct(F.min("m").alias("lo"), F.max("m").alias("hi")).alias("s")).scalar()
    index = marks.select("license", "m", F.explode_outer("grams").alias("gram"))
    marks = materialize(marks.withColumn("long", F.size(words(F.col("template"))) - 1).withColumn("_t", F.monotonically_increasing_id()).drop("template"), "license-templates")
    own = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), whole(text).alias("text")), "license-rows")
    own = near_texts(own, marks, least)
    rows = own.select("doc_id", "_row", F.explode_outer(units(F.col("text"))).alias("_u"))
    rows = rows.select("doc_id", "_row", "_u.unit", "_u.place", "_u.body")
    rows = with_bigrams(rows, F.col("body")).withColumn("n_bigrams", F.size("grams"))
    near = (F.col("n_bigrams") >= span["lo"] * F.lit(ratio)) & (F.col("n_bigrams") * F.lit(ratio) <= span["hi"])
    grams = rows.select("doc_id", "_row", "unit", "place", "n_bigrams", F.explode_outer(F.when(near, F.col("grams"))).alias("gram"))
    fits = (F.col("n_bigrams") >= F.col("m") * F.lit(ratio)) & (F.col("n_bigrams") * F.lit(ratio) <= F.col("m"))
    hits = grams.join(F.broadcast(index), "gram").where(fits)
    key = ["doc_id", "_row", "unit", "place", "n_bigrams"]
    scored = hits.groupBy(*key, "license", "m").agg(F.count(F.lit(1)).alias("common"))
    scored = scored.withColumn("dice", 2 * F.col("common") / (F.col("n_bigrams") + F.col("m"))).where(F.col("dice") >= least)
    best = Window.partitionBy(*key).orderBy(F.desc("dice"), "license")
    scored = materialize(scored.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k"), "license-units")
    more = passages(own.select("_row", "text"), marks, scored, least)
    more = more.join(own.select("_row", "doc_id"), "_row").withColumn("unit", F.lit("passage"))
    out = ["doc_id", "unit", "place", "license", F.col("n_bigrams").cast("long").alias("n_bigrams"), "common", "dice"]
    return scored.select(*out).unionByName(more.select(*out))
