"""License scans with DataFrame functions only: MinHash bands retrieve templates, shingle containment verifies.

Words are runs of letters and digits, lower-cased; shingles are SHINGLE words. A document is cut into overlapping
windows of WINDOW shingles, STRIDE apart, and each window gets BANDS MinHash values (one row a band), so that two
windows of Jaccard similarity s share a band with a chance of 1 - (1 - s) ** BANDS: 0.9999 at 0.8 and 0.98 at 0.5.
A template has windows at every place; some document window lies whole inside a copy of WINDOW + STRIDE - 1 = 23 shingles or
more wherever it stands, and one of 16 to 22 shares 9 shingles with a document window at least. A
template too short for a window has windows of one shingle, whose MinHash is the shingle's hash (of all its words,
if it has fewer than SHINGLE): for these a band is a lookup. A document that shares no band with any template leaves in the scan; for the others
each shared band gives a place, and there the exact share of the template's distinct shingles is taken.

Scanning is one pass without a shuffle; only verified matches are grouped, by document. Templates are the query
set: their bands ride as one row, in blocks of at most BLOCK_KEYS.
"""
from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import discard, materialize, table

NAME = "op1_license_scan"
SHINGLE, WINDOW, STRIDE, BANDS, LEAST, BLOCK_KEYS = 5, 16, 8, 6, 0.8, 4000
_rng = random.Random(17)
SEEDS = [_rng.getrandbits(64) - (1 << 63) for _ in range(BANDS)]  # of all 64 bits, so that bands differ in the sign too

#: Fixed values: (template, license, text) of common notices and license texts.
TEMPLATES = (
    ("all-rights-reserved", "proprietary", "All rights reserved."),
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-text", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc-by-line", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-notice", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-text", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("as-is-disclaimer", "disclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def runs(items: Column, k: int, of) -> Column:
    """of(k neighbouring items), at every place; none if there are fewer."""
    n = F.size(items)
    at = lambda i: of([F.get(items, i + j) for j in range(k)])
    first = at(F.lit(0))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), at)).otherwise(F.filter(F.array(first), lambda _: F.lit(False)))


def shingle_hashes(word_hashes: Column, k: int) -> Column:
    return runs(word_hashes, k, lambda w: F.xxhash64(*w))


def window_least(hashes: Column, size: int, step: int, count: Column, seed: int) -> Column:
    """The least of `size` neighbouring hashes under a seed's permutation, at `count` places `step` apart.

    Places are read one by one: slice() copies its whole array each time.
    """
    at = lambda i: F.least(*[F.get(hashes, i * step + j).bitwiseXOR(F.lit(seed)) for j in range(size)])
    return F.transform(F.sequence(F.lit(0), count - 1), at)


def with_bands(docs: DataFrame, hashes: str, out: str) -> DataFrame:
    """docs with the band keys of each document's windows, all of one band after another; none without shingles.

    A window is two neighbouring blocks of STRIDE shingles, so each shingle is hashed once for each band; windows
    of a document are as many as its blocks less one, and one at least.
    """
    blocks = F.greatest(F.ceil(F.size(hashes) / STRIDE).cast("int"), F.lit(1))
    docs = docs.withColumns({f"_least{i}": window_least(F.col(hashes), STRIDE, STRIDE, blocks, s) for i, s in enumerate(SEEDS)})

    def band(i: int) -> Column:
        m = F.col(f"_least{i}")
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(m) - 2, F.lit(0))), lambda j: F.xxhash64(F.lit(i), F.least(F.get(m, j), F.get(m, j + 1))))

    none = F.array().cast("array<bigint>")
    return docs.withColumn(out, F.when(F.size(hashes) > 0, F.concat(*[band(i) for i in range(BANDS)])).otherwise(none)).drop(*[f"_least{i}" for i in range(BANDS)])


def template_keys(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Templates with their words and shingles, and (key, k, template, place): k 0 for bands, else the words of
    the single shingle that a key stands for."""
    own = templates.select("template", "license", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    own = own.withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))
    shingles = reduce(lambda rest, k: F.when(F.col("k") == k, runs(F.col("words"), k, lambda w: F.array_join(F.array(*w), " "))).otherwise(rest), range(1, SHINGLE + 1), F.lit(None).cast("array<string>"))
    own = own.withColumn("each", F.transform("words", lambda w: F.xxhash64(w)))
    hashes = reduce(lambda rest, k: F.when(F.col("k") == k, shingle_hashes(F.col("each"), k)).otherwise(rest), range(1, SHINGLE + 1), F.lit(None).cast("array<bigint>"))
    own = own.withColumn("shingles", F.array_distinct(shingles)).withColumn("hashes", hashes)
    one = own.filter(F.size("hashes") < WINDOW).select("template", "k", F.posexplode("hashes").alias("place", "key"))
    windows = F.size("hashes") - WINDOW + 1
    many = own.filter(F.size("hashes") >= WINDOW)
    bands = [many.select("template", F.lit(0).alias("k"), F.posexplode(window_least(F.col("hashes"), WINDOW, 1, windows, s)).alias("place", "m")).select("template", "k", "place", F.xxhash64(F.lit(i), "m").alias("key")) for i, s in enumerate(SEEDS)]
    keys = reduce(DataFrame.unionByName, [one, *bands]).select("key", "k", "template", "place").distinct()
    return own.select("template", "license", "words", "k", "shingles"), keys


def scan_licenses(documents: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, template, license, containment, start_word): the best place of each template found in a document.

    containment is the share of the template's distinct shingles in the stretch of words where it would stand and
    a fifth of its length more on either side; at least `least`. start_word counts from 0; of equal places, the
    first. Templates whose text has no words match nothing; those with one name count as one per text. Null and
    empty documents match nothing; rows with one doc_id count as one document. Other columns aren't read.
    """
    spark = documents.sparkSession
    own, keys = template_keys(templates)
    own, own_path = materialize(own, "license-templates")
    keys, keys_path = materialize(keys, "license-keys")
    sizes = {r.k: r["count"] for r in keys.groupBy("k").count().collect()}  # at most SHINGLE + 1 rows
    found = [_scan(documents, own, keys.filter((F.col("k") == k) & (F.pmod(F.col("key"), F.lit(blocks)) == b)), k) for k in sorted(sizes) for blocks in [-(-sizes[k] // BLOCK_KEYS)] for b in range(blocks)] if len(sizes) and max(sizes.values()) > BLOCK_KEYS else [_scan(documents, own, keys, *sorted(sizes))]
    places = reduce(DataFrame.unionByName, found)
    best = places.groupBy("doc_id", "template", "license").agg(F.max(F.struct("containment", (-F.col("start_word")).alias("back"))).alias("b"))
    return best.filter(F.col("b.containment") >= least).select("doc_id", "template", "license", F.col("b.containment").alias("containment"), (-F.col("b.back")).alias("start_word"))


def _scan(documents: DataFrame, own: DataFrame, keys: DataFrame, *kinds: int) -> DataFrame:
    """Every place of the given kinds of keys, with its containment."""
    wanted = {k: keys.filter(F.col("k") == k).agg(F.collect_set("key")).scalar() for k in kinds}
    docs = documents.select(F.col("doc_id"), words(F.col("text")).alias("words"))
    docs = docs.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    whole = 0 in kinds or SHINGLE in kinds
    docs = docs.withColumns({f"h{k}": shingle_hashes(F.col("hashes"), k) for k in range(1, SHINGLE + 1) if k in kinds or k == SHINGLE and whole}).drop("hashes")
    if 0 in kinds:
        docs = with_bands(docs, f"h{SHINGLE}", "h0")
    docs = docs.withColumns({f"w{k}": w for k, w in wanted.items()})
    none = F.array().cast("array<struct<k:int,key:bigint,at:int>>")

    def shared(k: int) -> Column:
        """Where a document's keys are in a template; only looked for in documents that share a key."""
        all_keys = F.transform(f"h{k}", lambda h, i: F.struct(F.lit(k).alias("k"), h.alias("key"), i.alias("at")))
        return F.when(F.arrays_overlap(f"h{k}", f"w{k}"), F.filter(all_keys, lambda x: F.array_contains(F.col(f"w{k}"), x["key"]))).otherwise(none)

    # The outer form and a filter above it: a filter below would be pushed down to the scan with copies of all
    # these expressions in it.
    hits = docs.withColumn("windows", F.greatest(F.ceil(F.size(f"h{SHINGLE}") / STRIDE).cast("int") - 1, F.lit(1)) if 0 in kinds else F.lit(1))
    hits = hits.select("doc_id", "words", "windows", F.explode_outer(F.concat(*[shared(k) for k in kinds]) if kinds else none).alias("x"))
    hits = hits.filter("x is not null").select("doc_id", "words", "windows", "x.*")
    at = F.when(F.col("k") == 0, F.pmod("at", F.col("windows")) * STRIDE).otherwise(F.col("at"))
    places = hits.join(keys, ["k", "key"]).select("doc_id", "words", "template", (at - F.col("place")).alias("start"))
    t = own.select("template", "license", F.col("k").alias("size"), F.size("words").alias("n"), "shingles")
    placed = places.join(t, "template")
    slack = F.ceil(F.col("n") / 5).cast("int")
    begin = F.greatest(F.col("start") - slack, F.lit(0))
    end = F.least(F.col("start") + F.col("n") + slack, F.size("words"))
    near = F.when(end > begin, F.transform(F.sequence(begin, end - 1), lambda i: F.get(F.col("words"), i))).otherwise(F.array().cast("array<string>"))
    placed = placed.select("doc_id", "template", "license", "start", "size", "shingles", near.alias("near"))
    there = reduce(lambda rest, k: F.when(F.col("size") == k, runs(F.col("near"), k, lambda w: F.array_join(F.array(*w), " "))).otherwise(rest), range(1, SHINGLE + 1), F.array().cast("array<string>"))
    share = F.size(F.array_intersect("shingles", there)) / F.size("shingles")
    return placed.select("doc_id", "template", "license", share.alias("containment"), F.greatest(F.col("start"), F.lit(0)).alias("start_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(list(TEMPLATES), "template string, license string, text string")
    return scan_licenses(table(spark, sf_dir, "documents"), templates)
