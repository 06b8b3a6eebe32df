"""SimHash near-dedup to a similarity: groups of texts connected by pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Covering LSH (`simhash.links`) over SimHash fingerprints of the five-word shingles brings together all texts whose
fingerprints differ by at most RADIUS bits. No radius that masks can cover holds every pair of that similarity (at 0.8, 10 of 64 bits
differ on average), so an exact join of shingle prefixes adds the pairs beyond it, and each pair of either way counts
only if the whole sets are as similar: no link is lost, and none is made by chance.

Under any one order of all shingles, two sets of that similarity share one of the first
n - ceil(0.8 n) + 1 shingles of each, so only these prefixes are brought together. What two texts share beyond their
prefixes is at most what one of them has left, so a pair must share a number of prefix shingles (`_enough`); pairs
that do are compared by their whole sets. Frequent shingles come last in the order, which keeps the meetings small: all texts
are counted, as with a sample the shingles too rare for it, and so the meetings, grow with the input. Shingles are dealt
to the counting tasks packed, 4 bytes each. The order decides how many pairs meet but not which are found.

Pairs of a large meeting aren't all enumerated: each text is first paired with the one before it and with the
first of its meeting, then (`_nearer`) with the one before it by fingerprint and with the text that shares most of its
prefix with others, where fingerprints are near, as all copies of one text link to it but few to each other. At last only
texts of groups that are still different are paired, all of them: the steps before decide how many these are, not
which links are found. Texts and shingles are told apart by 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.common import bounded, discard, materialize, text_batches
from plumbline.llm.components import components
from plumbline.llm.simhash import links, majority

WORDS, SEED, RADIUS = 5, 42, 2
OFTEN, LISTED = 5, 4_000_000  # the order lists shingles of so many texts or more, and so many of them at most (12 bytes each in a worker)
RANGE_BITS, DEALT = 10, 1 << 20  # the counting tasks' ranges of hashes are told by so many bits; shingles that a task deals at once
NEAR = 20  # fingerprints of pairs that are tried early differ in at most so many bits
SIMILAR_SIZES = "5 * lo >= 4 * hi"
MAX_IDS = 4_000_000  # ids travel to the texts up to this many; beyond it they meet in a join


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words make one shingle, none make none."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n, digest = len(own), xxhash.xxh64_intdigest
    if n <= words:
        return np.array([digest(b" ".join(own), SEED)] if n else [], np.uint64).view(np.int64)
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64).view(np.int64))


def prefix(own: np.ndarray, listed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a set in the order of (count, hash); `listed` has the sorted keys of frequent ones."""
    n = len(own)
    if not n:
        return own
    often = np.zeros(n, np.int64)
    if len(listed):
        keys = _keys(own)
        at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
        often = np.where(listed[at] == keys, counts[at], 0)
    return own[np.lexsort((own, often))[: n - (4 * n + 4) // 5 + 1]]


def _keys(hashes: np.ndarray) -> np.ndarray:
    """The upper RANGE_BITS + 32 bits, by which shingles are counted; two of one key have one count."""
    return (hashes.view(np.uint64) >> np.uint64(32 - RANGE_BITS)).view(np.int64)


def _batch(ids, own: list[np.ndarray], out: list[np.ndarray]) -> pa.RecordBatch:
    hashes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out)))
    codes = pa.array([majority(x.view(np.uint64)) for x in own], pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in own], pa.int32()), codes, hashes], ["id", "n", "fp", "hashes"])


def _sets(texts: DataFrame, listed: np.ndarray | None = None, counts: np.ndarray | None = None) -> DataFrame:
    """(id, n, fp, hashes) of texts(id, text): whole sets, or prefixes where the order is given; fp is the sets' SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bounded(batches, 256, 2 << 20):
            own = [shingles(t.as_py()) for t in part["text"]]
            yield _batch(part["id"], own, own if listed is None else [prefix(x, listed, counts) for x in own])

    text_batches(texts.sparkSession)
    return texts.select("id", "text").mapInArrow(run, "id long, n int, fp long, hashes array<long>")


def _dealt(texts: DataFrame) -> DataFrame:
    """(part, keys): the shingles of texts(id, text) by ranges of their keys, the lower 32 bits packed; a text repeated in a task counts once."""

    def deal(own: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(_keys(np.concatenate(own)))
        ends = np.searchsorted(keys >> 32, np.arange((1 << RANGE_BITS) + 1))
        low, some = keys.astype("<u4"), np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([low[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary())], ["part", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size, met = [], 0, set()
        for part in bounded(batches, 256, 2 << 20):
            for i, text in zip(part["id"].to_pylist(), part["text"]):
                if i not in met:
                    met.add(i)
                    own.append(shingles(text.as_py()))
                    size += len(own[-1])
            if size >= DEALT:
                yield deal(own)
                own, size, met = [], 0, set()
        if size:
            yield deal(own)

    text_batches(texts.sparkSession)
    return texts.select("id", "text").mapInArrow(run, "part int, keys binary")


def _order(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of the frequent shingles, and how many texts hold each."""
    least = OFTEN

    def count(part: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.frombuffer(b"".join(part["keys"].to_pylist()), "<u4"), return_counts=True)
        often = counts >= least
        return pa.table({"key": (part["part"][0].as_py() << 32) + keys[often].astype(np.int64), "count": counts[often].astype(np.int32)})

    seen = _dealt(texts).groupBy("part").applyInArrow(count, "key long, count int")
    found = seen.orderBy(F.desc("count"), "key").limit(LISTED).toArrow()
    key, c = found["key"].to_numpy(), found["count"].to_numpy()
    order = np.argsort(key)
    return key[order], c[order]


def _covered(firsts: DataFrame) -> DataFrame:
    """(a, b, lo, hi): each text and the first of its fingerprint, and the firsts of fingerprints within RADIUS bits."""
    codes, path = materialize(firsts.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("f"), F.count("*").alias("size")), "copies-codes")
    same = firsts.join(codes.filter("size > 1").select("fp", F.col("f.id").alias("f_id"), F.col("f.n").alias("f_n")), "fp").filter("id <> f_id").select(*_pair("f_id", "id", "f_n", "n"))
    one, two = (codes.select(F.col("fp").alias(x), F.col("f.id").alias(f"id_{x}"), F.col("f.n").alias(f"n_{x}")) for x in "ab")
    near = links(codes.select("fp"), RADIUS).join(one, "a").join(two, "b").select(*_pair("id_a", "id_b", "n_a", "n_b"))
    return same.unionByName(near)


def _enough(pairs: DataFrame) -> DataFrame:
    """The pairs(a, b) of rows (a, b, lo, hi), a row for each prefix shingle they share, that may reach 0.8; lo and hi are their sizes.

    They must share ceil(4 (lo + hi) / 9), of which at most ceil(0.8 hi) - 1 lie outside the prefixes.
    """
    return pairs.groupBy("a", "b", "lo", "hi").agg(F.count("*").alias("k")).filter("k >= (4 * (lo + hi) + 8) div 9 - ((4 * hi + 4) div 5 - 1)").select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The pairs(a, b) whose whole sets have a Jaccard similarity of 0.8 or more (9 shared >= 4 (n + m)), stored; and the path."""
    members, members_path = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "copies-members")
    few = members.count() <= MAX_IDS
    own = texts.join(F.broadcast(members) if few else members, "id", "left_semi")
    sets, sets_path = materialize(_sets(own).groupBy("id").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")), "copies-sets")
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    both = pairs.join(one, "a").join(two, "b")
    found, path = materialize(both.filter(9 * F.size(F.array_intersect("h_a", "h_b")) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"), name)
    discard(texts.sparkSession, members_path, sets_path)
    return found, path


def _pair(x: str, y: str, n: str, m: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.least(n, m).cast("long").alias("lo"), F.greatest(n, m).cast("long").alias("hi")]


def _mixed(met: DataFrame, found: DataFrame) -> tuple[DataFrame, str]:
    """(h, id, n, g) of the meetings that hold texts of different groups by the links found, stored; and the path."""
    group = components(found).select(F.col("node").alias("id"), F.col("component").alias("g"))
    rest = met.select("h", "id", "n").join(group, "id", "left").select("h", "id", "n", F.coalesce("g", "id").alias("g"))
    mixed = rest.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low <> high").select("h")
    return materialize(rest.join(mixed, "h", "left_semi"), "copies-rest")


def _nearer(rest: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b, lo, hi): of each meeting, texts of different groups and near fingerprints: neighbours by fingerprint, from another bit on in
    each meeting, and each text with the one that shares most of its prefix."""
    shared = rest.groupBy("id").agg(F.count("*").alias("shared")).join(firsts.select("id", "fp"), "id")
    turned = F.expr("shiftleft(fp, cast(pmod(h, 64) as int)) | shiftrightunsigned(fp, cast(64 - pmod(h, 64) as int))")
    spots = rest.join(shared, "id").withColumn("turned", turned).withColumn("own", F.struct("id", "n", "g", "fp"))
    spots = spots.withColumn("p", F.lag("own").over(Window.partitionBy("h").orderBy("turned", "id")))
    hubs = spots.groupBy("h").agg(F.max_by("own", F.struct("shared", "id")).alias("p"))
    pairs = spots.select("own", "p").unionByName(spots.select("h", "own").join(hubs, "h").select("own", "p"))
    pairs = pairs.filter((F.col("own.g") != F.col("p.g")) & (F.bit_count(F.col("own.fp").bitwiseXOR(F.col("p.fp"))) <= NEAR))
    return pairs.select(*_pair("own.id", "p.id", "own.n", "p.n")).distinct()


def _apart(rest: DataFrame) -> DataFrame:
    """(a, b, lo, hi): all pairs of texts of different groups and similar sizes, a row for each meeting."""
    x, y = (rest.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "g")]) for side in "xy")
    return x.join(y, "h").filter("id_x < id_y and g_x <> g_y").select(*_pair("id_x", "id_y", "n_x", "n_y")).filter(SIMILAR_SIZES)


def near_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, id, component_id) of each row: id tells texts apart, component_id is the least doc_id of the group.

    Null and empty texts are one text. Null doc_ids are passed over unless a group has no other; they link as others do.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.xxhash64("text"))
    firsts, firsts_path = materialize(_sets(texts, *_order(texts)).groupBy("id").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("hashes").alias("hashes")), "copies-firsts")
    spots = firsts.select("id", "n", F.explode("hashes").alias("h"))
    row = Window.partitionBy("h").orderBy("n", "id")
    spots = spots.select("h", "id", "n", F.lag("id").over(row).alias("p"), F.lag("n").over(row).alias("p_n"), F.lead("id").over(row).alias("q"), F.first("id").over(row).alias("f"), F.first("n").over(row).alias("f_n"))
    met, met_path = materialize(spots.filter("p is not null or q is not null").drop("q"), "copies-met")
    beside = met.filter("p is not null").select(*_pair("p", "id", "p_n", "n")).unionByName(met.filter("f <> id and f <> p").select(*_pair("f", "id", "f_n", "n")))
    tried, tried_path = materialize(_enough(beside.filter(SIMILAR_SIZES)).unionByName(_covered(firsts).filter(SIMILAR_SIZES).select("a", "b")).distinct(), "copies-tried")
    found, found_path = _verified(tried, texts, "copies-links")
    rest, rest_path = _mixed(met, found)
    early, early_path = materialize(_nearer(rest, firsts).filter(SIMILAR_SIZES).select("a", "b").join(tried, ["a", "b"], "left_anti"), "copies-early")
    nearer, nearer_path = _verified(early, texts, "copies-early-links")
    found, tried = found.unionByName(nearer), tried.unionByName(early)
    last, last_path = _mixed(rest, found)
    more, more_path = materialize(_enough(_apart(last)).join(tried, ["a", "b"], "left_anti"), "copies-more")
    others, others_path = _verified(more, texts, "copies-more-links")
    named = components(found.unionByName(others)).select(F.col("node").alias("id"), "component")
    discard(spark, firsts_path, met_path, tried_path, found_path, rest_path, early_path, nearer_path, last_path, more_path, others_path)
    of = texts.select("doc_id", "id").join(named, "id", "left").select("doc_id", "id", F.coalesce("component", "id").alias("component"))
    return of.join(of.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "id", "component_id")
