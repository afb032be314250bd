"""License scan, with DataFrame functions only.

Words are runs of a-z and 0-9 of the lower-cased text, so comment marks and
punctuation don't matter.  Templates are parted by length; for each class a document is
read in overlapping windows: one at every multiple of the class's reach, two reaches long,
so whatever is no longer than a reach lies whole in one of them.  Every word run of a text
is hashed once a shingle size, and windows are slices of those hashes.  (Anchors are words
chosen so that they stand in more of each template's shingles than a match may lack: a
window without any can't match, and is passed over without loss.)

Windows and templates have `PERMUTATIONS` MinHash values in bands of one.  A window that
holds enough of a template has a least Jaccard similarity to it, by the window's and the
template's numbers of shingles; where all bands miss that with a probability above `MISS`
(short templates: few shingles in a window of their class), the template is retrieved by
all its shingles instead, without loss.  Retrieved pairs are then verified: the share of the
template's five-word shingles that the window holds, exactly.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitstrata.llm.names import col

SIZE, THRESHOLD, PERMUTATIONS = 5, 0.8, 64
#: The most that the bands may miss of a match.
MISS = 1.4e-6
#: Templates of more characters in all are joined as Spark sees fit, not broadcast.
BROADCAST_CHARS = 1 << 22

# Texts of public licenses and of the lines that refer to them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "gpl-3-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if w]


def anchors(templates: dict[str, str], threshold: float = THRESHOLD) -> list[str]:
    """Words without one of which no text can hold `threshold` of any template: they stand in
    more of each template's shingles than may be missing.  Long words go first."""
    runs = [{tuple(w[i : i + min(SIZE, len(w))]) for i in range(max(1, len(w) - SIZE + 1))} for w in map(_template_words, templates.values()) if w]
    may_miss = [len(r) - int(-(-threshold * len(r) // 1)) for r in runs]
    out: list[str] = []
    while open_runs := [[s for s in r if not s & set(out)] for r in ([frozenset(s) for s in r] for r in runs)]:
        need = [r for r, all_r, m in zip(open_runs, runs, may_miss, strict=True) if len(all_r) - len(r) <= m]
        if not need:
            break
        served: dict[str, int] = {}
        for r in need:
            for w in {w for s in r for w in s}:
                served[w] = served.get(w, 0) + 1
        out.append(max(served, key=lambda w: (min(len(w), 7), served[w], w)))
    return out


def size_class(n: int) -> tuple[int, int]:
    """(longest template of the class, shingle size): lengths double from class to class; short ones stand alone."""
    return (n, n) if n < SIZE else (max(8, 1 << (n - 1).bit_length()), SIZE)


def miss_probability(n: int, reach: int, size: int, threshold: float = THRESHOLD) -> float:
    """Of all bands, for a full window that holds just enough of a template of n distinct shingles."""
    window = max(1, 2 * reach + 1 - size)
    need = max(1, math.ceil(threshold * n - 1e-9))
    return (1 - min(1.0, need / max(n, window + n - need))) ** PERMUTATIONS


def run_hashes(w: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, in order; none in a shorter text."""
    last = F.size(w) - size + 1
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(size)), " ")))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<bigint>"))


def signature(shingles: Column, n: int = PERMUTATIONS) -> Column:
    """MinHash values, one band each: the least hash under each permutation."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.xxhash64(k, F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k)))))


def template_table(spark, templates: dict[str, str], threshold: float = THRESHOLD) -> DataFrame:
    """(license, reach, size, whole, template shingles): one row a template, as many as the code
    lists; `whole` ones are retrieved by all their shingles."""
    rows = []
    for name, text in templates.items():
        if w := _template_words(text):
            reach, size = size_class(len(w))
            n = len({tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
            rows.append((name, reach, size, miss_probability(n, reach, size, threshold) > MISS, " ".join(w)))
    if not rows:
        rows = [("", SIZE, SIZE, False, "")]
    t = spark.createDataFrame(rows, "license string, reach int, size int, whole boolean, text string").filter("text <> ''")
    sizes = sorted({r[2] for r in rows})
    template = F.coalesce(*[F.when(F.col("size") == s, F.array_distinct(run_hashes(words(F.col("text")), s))) for s in sizes])
    return t.withColumn("template", template).drop("text")


def window_starts(places: Column, reach: int) -> Column:
    """Numbers of the windows that hold any of the places (counted from 1): two each."""
    near = F.transform(places, lambda i: F.floor((i - 1) / reach).cast("int"))
    return F.array_distinct(F.flatten(F.transform(near, lambda k: F.array(F.greatest(k - 1, F.lit(0)), k))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, n_shingles, n_common, first_word) for each document and template it holds.

    `n_common` is the most that one window holds of the template's `n_shingles`, and
    `first_word` the first word, counted from 1, of the first window that holds it.  A
    template of fewer than five words is held if its words stand in a row.  Null and empty
    texts hold none; rows that repeat an id are joined to one; rows with a null id are given
    under null.  An empty table, or no templates, gives no rows.  Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    spark, marks = docs.sparkSession, anchors(templates, threshold)
    table = template_table(spark, templates, threshold)
    classes = sorted({size_class(len(w)) for t in templates.values() if (w := _template_words(t))})
    text = col(text_col).cast("string")
    likely = reduce(lambda a, b: a | b, [F.lower(text).contains(m) for m in marks], F.lit(False))
    # inline() of one row: what a lambda reads must be a column that is there, not an expression made anew at each step
    own = docs.filter(likely).select(col(id_col).alias("doc_id"), F.inline(F.array(F.struct(words(text).alias("w"))))).filter(F.size("w") > 0)
    places = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at(F.col("w"), i).isin(marks))
    own = own.select("doc_id", "w", places.alias("places")).filter(F.size("places") > 0)
    kinds = "struct<reach:int,size:int,k:int,shingles:array<bigint>>"

    def windows_of(reach: int, size: int) -> Column:
        """The windows of a class, from the run hashes that all classes of a shingle size share."""
        runs, length = F.col(f"h{size}"), F.lit(2 * reach + 1 - size)
        part = F.transform(window_starts(F.col("places"), reach), lambda k: F.struct(F.lit(reach).alias("reach"), F.lit(size).alias("size"), k.alias("k"), F.array_distinct(F.slice(runs, k * reach + 1, length)).alias("shingles")))
        return F.filter(part, lambda x: F.size(x.shingles) > 0).cast(f"array<{kinds}>")

    cut = [windows_of(reach, size) for reach, size in classes]
    hashed = own.select("doc_id", F.inline(F.array(F.struct("places", *[run_hashes(F.col("w"), s).alias(f"h{s}") for s in sorted({s for _, s in classes})]))))
    windows = hashed.select("doc_id", F.explode(F.concat(*cut) if cut else F.array().cast(f"array<{kinds}>")).alias("x")).select("doc_id", "x.*")
    bands = windows.withColumn("bands", signature(F.col("shingles")))
    wanted = table.withColumn("bands", signature(F.col("template")))
    if sum(map(len, templates.values())) <= BROADCAST_CHARS:
        wanted = F.broadcast(wanted)
    t = wanted.select("license", F.col("reach").alias("r"), F.col("size").alias("s"), "whole", "template", F.col("bands").alias("b"))
    # a band is in common where the values are equal at one place; each value holds its place's number
    retrieved = F.when(F.col("whole"), F.arrays_overlap("shingles", "template")).otherwise(F.arrays_overlap("bands", "b"))
    pairs = bands.join(t, (F.col("reach") == F.col("r")) & (F.col("size") == F.col("s")) & retrieved)
    common = F.size(F.array_intersect("shingles", "template"))
    found = pairs.select("doc_id", "license", (F.col("k") * F.col("reach") + 1).alias("at"), F.size("template").alias("n_shingles"), common.alias("n_common")).filter(F.col("n_common") >= threshold * F.col("n_shingles") - 1e-9)
    return found.groupBy("doc_id", "license").agg(F.max("n_shingles").cast("long").alias("n_shingles"), F.max("n_common").cast("long").alias("n_common"), F.min("at").cast("long").alias("first_word"))
