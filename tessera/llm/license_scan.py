"""License scan by diagonal voting over rolling word k-grams, in DataFrame functions only.

Every rolling k-gram hash of a text is joined to the positions of the same k-gram in license templates (a fixed table,
a thousand rows): whole texts of short licenses, the notices of longer ones, and single lines. Hits vote for their diagonal (text position minus template position); neighbouring diagonals of a
template are merged, and a merged span is kept when enough of the template's k-grams lie in it. A phrase of the base
list is the case in which one diagonal holds all its k-grams.

Defined results: null text counts as empty; texts shorter than k words have no hits; base_labels and labels are empty
strings when nothing is found, first_word and last_word null, score 0; very long texts are read whole; an empty table gives
an empty result. Rows that repeat an id and a text each get the
same result; null ids are allowed; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 3

# Base phrases and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Usual license lines and opening sentences of public licenses, as words.
LINES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
]


# Whole texts of short public licenses, and the notices that longer ones ask for.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE
IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means."""
APACHE_2 = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with
this program."""
MPL_2 = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
WHOLE = [(MIT, "mit"), (BSD_3, "bsd"), (ISC, "isc"), (ZLIB, "zlib"), (UNLICENSE, "unlicense"), (APACHE_2, "apache-2"), (GPL, "gpl"), (MPL_2, "mpl")]
TEMPLATES = LINES + [(" ".join(re.findall("[a-z0-9]+", text.lower())), label) for text, label in WHOLE]


def words(text: Column) -> Column:
    """A-Z lower-cased, runs outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. The Kelvin sign must not become an ASCII k."""
    kept = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    return F.regexp_extract_all(kept, F.lit("[a-z0-9\\x{80}-\\x{10FFFF}]++"), F.lit(0))


def _template_grams(spark, base, templates) -> DataFrame:
    rows = []
    for kind, listed in (("base", base), ("method", templates)):
        for phrase, label in listed:
            w = phrase.split()
            rows += [(f"{kind}:{phrase}", kind, label, len(w) - K + 1, i, w[i], w[i + 1], w[i + 2]) for i in range(len(w) - K + 1)]
    t = spark.createDataFrame(rows, "template string, kind string, label string, grams int, tpos int, t0 string, t1 string, t2 string")
    return t.withColumn("gram", F.xxhash64("t0", "t1", "t2"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, base=BASE, templates=TEMPLATES,
         gap: int = 3, coverage: float = 0.6) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    read = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__h"),
                       words(F.col(text_col)).alias("__w"))
    grams = read.where(F.size("__w") >= K).select(
        "__id", "__h", "__w", F.explode(F.sequence(F.lit(0), F.size("__w") - K)).alias("pos"))
    at = [F.get("__w", F.col("pos") + i) for i in range(K)]
    grams = grams.select("__id", "__h", "pos", F.xxhash64(*at).alias("gram"), *[a.alias(f"w{i}") for i, a in enumerate(at)])
    t = F.broadcast(_template_grams(docs.sparkSession, base, templates))
    hits = (
        grams.join(t, "gram").where("w0 = t0 and w1 = t1 and w2 = t2")
        .select("__id", "__h", "template", "kind", "label", "grams", "tpos", "pos")
        .dropDuplicates(["__id", "__h", "template", "tpos", "pos"])  # repeated rows vote once
    )
    from pyspark.sql import Window

    diagonals = hits.groupBy("__id", "__h", "template", "kind", "label", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    by = Window.partitionBy("__id", "__h", "template").orderBy("diagonal")
    merged = (
        diagonals.withColumn("fresh", F.when((F.col("kind") == "base") | ((F.col("diagonal") - F.lag("diagonal").over(by)) > gap), 1).otherwise(
            F.when(F.lag("diagonal").over(by).isNull(), 1).otherwise(0)))
        .withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("__id", "__h", "template", "kind", "label", "grams", "island")
        .agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("covered", F.size("seen") / F.col("grams"))
    )
    is_base = F.col("kind") == "base"
    verified = merged.where(
        F.when(is_base, F.col("covered") == 1).otherwise(
            (F.col("covered") >= coverage) & (F.col("last") - F.col("first") + 1 <= 2 * (F.col("grams") + K))))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = verified.groupBy("__id", "__h").agg(
        F.sum(is_base.cast("long")).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).alias("first_word"), F.max(F.when(is_base, F.col("first"))).alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.max("covered").alias("score"))
    slim = read.select("__id", "__h", F.size("__w").cast("long").alias("n_words"))
    f = found.withColumnsRenamed({"__id": "__fid", "__h": "__fh"})
    return slim.join(f, (slim["__h"] == f["__fh"]) & slim["__id"].eqNullSafe(f["__fid"]), "left").select(
        F.col("__id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
