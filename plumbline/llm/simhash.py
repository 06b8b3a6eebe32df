"""SimHash near-dedup with covering locality-sensitive hashing.

Each of the 64 bits has a nonzero vector of radius+1 bits; table v of the 2^(radius+1)-1 tables masks the bits
whose vector has an odd product with v. At most `radius` differing bits span fewer than radius+1 dimensions, so
some v is orthogonal to all of them and its table holds both fingerprints in one bucket: no pair is missed.

Only distinct fingerprints are linked. A bucket of two is a pair; one of up to SMALL is compared in place; in a
larger one, each fingerprint instead goes to the points around it, its 64 one-bit neighbours and itself, which
any two fingerprints within two bits share. Such a meeting holds 65 at most, so no group of any size comes
together in one task, and no pairs are enumerated. That is exact for a radius of up to 2, the contract's.

A radius above 2 has no such meetings: there a large bucket is dealt into blocks of about BLOCK, and each
two blocks are compared by a task of their own. That is exact too, and takes the square of the bucket in comparisons.
Near copies of a five-word similarity, which no radius bounds, are `near_copies`, which takes its first links from here.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import bounded, discard, materialize, table, text_batches
from plumbline.llm.components import components

NAME = "op9_simhash"
WORDS, RADIUS, SEED, SMALL = 3, 2, 42, 8
BLOCK = 512


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash as a signed integer; zero for a text without words."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and [\\x20\\x09-\\x0D] only
    n = len(own)
    if not n:
        return 0
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(own), SEED)]
    else:
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes, as a signed integer; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            fp = [fingerprint(t.as_py(), words) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp, pa.int64())], ["doc_id", "fp"])

    text_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


@lru_cache
def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks, as signed integers; of the ways to deal vectors to bits, one whose least mask is large."""
    full = 2 ** (radius + 1) - 1

    def dealt(step: int) -> list[int]:
        vectors = [i * step % full + 1 for i in range(bits)]
        return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, full + 1)]

    best = max((dealt(step) for step in range(1, min(full, 64) + 1)), key=lambda ms: min(m.bit_count() for m in ms))
    return [m - (1 << 64) if m >= 1 << 63 else m for m in best]


def links(nodes: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """(a, b): links between distinct fingerprints of nodes(fp) that connect all within the radius, and no others; a stored table.

    Pairs may repeat; up to a radius of 2, all around a crowded point are linked to the smallest there, which is
    enough to connect them (each is within two bits of it); above, every pair is linked.
    """
    if not 0 <= radius <= 8:
        raise ValueError("radius 0 to 8")
    spots = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])).alias("s")).select("fp", "s.t", "s.key")
    buckets, path = materialize(spots.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    two = buckets.filter("n = 2").select("a", "b")
    few = spots.join(buckets.filter((F.col("n") > 2) & (F.col("n") <= small)).select("t", "key"), ["t", "key"]).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("all"))
    few = few.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda y: (y > F.col("a")) & near(F.col("a"), y))).alias("b"))
    found = [two, few]
    if radius > 2:
        crowd = spots.join(buckets.filter(F.col("n") > small).select("t", "key", F.ceil(F.col("n") / BLOCK).alias("blocks")), ["t", "key"]).withColumn("i", F.pmod(F.xxhash64("fp"), "blocks"))
        turn = crowd.select("t", "key", F.col("fp").alias("a"), "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
        met = crowd.select("t", "key", F.col("fp").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "i")).alias("i"), F.col("i").alias("j"))
        found.append(turn.join(met, ["t", "key", "i", "j"]).filter(((F.col("a") < F.col("b")) | (F.col("i") < F.col("j"))) & near(F.col("a"), F.col("b"))).select("a", "b"))
    else:
        crowd = spots.join(buckets.filter(F.col("n") > small).select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
        around = [F.lit(0)] + [F.lit(-(1 << 63) if i == 63 else 1 << i) for i in range(64)]
        meet = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x.cast("long")) for x in around])).alias("at"))
        found.append(meet.groupBy("at").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1).select("a", F.explode("all").alias("b")))
    out, _ = materialize(reduce(DataFrame.unionByName, found).filter((F.col("a") != F.col("b")) & near(F.col("a"), F.col("b"))), "fingerprint-links")
    discard(nodes.sparkSession, path)
    return out


def near_duplicates(documents: DataFrame, words: int = WORDS, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """(doc_id, fp, component_id) of each row.

    Null and empty texts have fingerprint zero and link like any other; a text of fewer than `words` words is
    one shingle. component_id is the smallest doc_id of the component, itself included; null doc_ids are passed
    over unless a component has no other. Repeated rows each get their row. Other columns are not read.
    """
    own, _ = materialize(fingerprints(documents, words), "fingerprints")
    nodes, _ = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    found = components(links(nodes.select("fp"), radius, small)).select(F.col("node").alias("fp"), "component")
    of = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
