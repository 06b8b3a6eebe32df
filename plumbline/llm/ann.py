"""Approximate nearest neighbours over balanced posting lists.

A bounded sample of vectors is split in halves along the line between two far centres, again and again, into
lists of equal size; each leaf's mean is a centroid. Centroids are few and live in memory with a neighbour graph,
which a best-first search walks for every vector. A vector joins the list of its nearest centroid and those of
up to REPLICAS in all whose centroid is nearly as near and isn't hidden behind one chosen before. A query reads
the lists whose centroid is within a ratio of its nearest one; the ratio is fitted on the sample so that nearly
all true neighbours' lists are read. Distances to list members are exact, in double precision.

Skew: of equal vectors only the k+1 smallest ids can be in any answer, so the rest leave before the shuffle by
a partial rank; lists are dealt to several groups once they outgrow LIST_ROWS. Queries that meet fewer vectors
than they need are then compared with all rows, in blocks.
"""
from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from plumbline.llm.common import discard, materialize, table

NAME = "op8_ann"
K, EVERY = 10, 100
MAX_FIT, MAX_LISTS, REPLICAS, NEAR, COVER, FIT_QUERIES = 16_384, 4096, 4, 1.1, 0.98, 400
LIST_ROWS, DEGREE, QUERY_BLOCK = 50_000, 16, 2_000


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite, and not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared, approximately: rows of x by rows of q."""
    return np.maximum(0, (x * x).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * x @ q.T)


def nearest_exact(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of x to q but for the id `own`, ties to smaller ids: ids, distances in double precision."""
    rough = (x * x).sum(1) - 2 * (x @ q)
    mine = np.flatnonzero(ids != own)
    if len(mine) > 4 * k:
        cut = np.partition(rough[mine], k - 1)[k - 1]
        mine = mine[rough[mine] <= cut + 1e-9 * (1 + abs(cut))]
    d = np.sqrt(((x[mine] - q) ** 2).sum(1))
    order = np.lexsort((ids[mine], d))[:k]
    return ids[mine][order], d[order]


class Lists:
    """Centroids, their graph, and the ratio within which a query reads lists."""

    def __init__(self, sample: np.ndarray, n_lists: int):
        rng = np.random.default_rng(3)
        leaves = [np.arange(len(sample))]
        while len(leaves) < n_lists:
            leaves.sort(key=len)
            big = leaves.pop()
            if len(big) < 2:
                leaves.append(big)
                break
            x = sample[big]
            a = x[distances(x, x[rng.integers(len(x))][None])[:, 0].argmax()]
            b = x[distances(x, a[None])[:, 0].argmax()]
            for _ in range(3):  # two balanced means
                order = np.argsort(x @ (b - a), kind="stable")
                half = len(order) // 2
                a, b = x[order[:half]].mean(0), x[order[half:]].mean(0)
            leaves += [big[order[:half]], big[order[half:]]]
        self.centroids = np.array([sample[i].mean(0) for i in leaves])
        n = len(self.centroids)
        self.graph = np.empty((n, min(DEGREE, n)), np.int32)
        for i in range(0, n, 512):
            self.graph[i : i + 512] = np.argsort(distances(self.centroids[i : i + 512], self.centroids), axis=1, kind="stable")[:, : self.graph.shape[1]]
        if n > DEGREE:  # a ring through all, so that each can be reached
            self.graph[:, -1] = (np.arange(n) + 1) % n
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        self.ratio, self.beam = self._fit(sample)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """About the `beam` nearest centroids of each row: numbers (-1: none) and distances, nearest first."""
        rows, n = len(x), len(self.centroids)
        beam = min(beam, n)
        at = np.arange(rows)
        seen = np.zeros((rows, n), bool)
        ids = np.repeat(self.entries[None], rows, 0)
        seen[:, self.entries] = True
        d = distances(x, self.centroids[self.entries])
        spent = np.zeros(d.shape, bool)
        while True:
            if d.shape[1] > beam:
                keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                ids, d, spent = (np.take_along_axis(a, keep, 1) for a in (ids, d, spent))
            open_ = np.where(spent, np.inf, d)
            best = open_.argmin(1)
            live = np.isfinite(open_[at, best])
            if not live.any():
                break
            spent[at, best] = True
            near = self.graph[np.maximum(ids[at, best], 0)]
            fresh = ~np.take_along_axis(seen, near, 1) & live[:, None]
            np.put_along_axis(seen, near, np.take_along_axis(seen, near, 1) | live[:, None], 1)
            r, c = np.nonzero(fresh)
            more = np.full(near.shape, np.inf)
            more[r, c] = ((self.centroids[near[r, c]] - x[r]) ** 2).sum(1)
            ids, d = np.concatenate([ids, np.where(fresh, near, -1)], 1), np.concatenate([d, more], 1)
            spent = np.concatenate([spent, ~fresh], 1)
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each row's lists: the nearest, and near ones not hidden behind one chosen before."""
        rows, lists = [], []
        for i in range(0, len(x), 512):
            part = x[i : i + 512]
            ids, d = self.search(part, 32)
            chosen = np.zeros(ids.shape, bool)
            chosen[:, 0] = True
            count = np.ones(len(part), int)
            for j in range(1, min(ids.shape[1], 12)):
                ok = (ids[:, j] >= 0) & (d[:, j] <= NEAR * d[:, 0] + 1e-12) & (count < REPLICAS)
                for m in range(j):
                    apart = np.sqrt(((self.centroids[ids[:, j]] - self.centroids[ids[:, m]]) ** 2).sum(1))
                    ok &= ~chosen[:, m] | (apart >= 0.8 * d[:, j])
                chosen[:, j] = ok
                count += ok
            r, c = np.nonzero(chosen)
            rows.append(r + i)
            lists.append(ids[r, c])
        return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(lists) if lists else np.zeros(0, int)

    def probe(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each query reads."""
        rows, lists = [], []
        for i in range(0, len(q), 512):
            ids, d = self.search(q[i : i + 512], self.beam)
            r, c = np.nonzero((ids >= 0) & (d <= self.ratio * d[:, :1] + 1e-12))
            rows.append(r + i)
            lists.append(ids[r, c])
        return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(lists) if lists else np.zeros(0, int)

    def _fit(self, sample: np.ndarray) -> tuple[float, int]:
        """The ratio that reads the lists of COVER of the sample's true neighbours, and the search width for it."""
        queries = sample[np.linspace(0, len(sample) - 1, min(FIT_QUERIES, len(sample))).astype(int)]
        r, c = self.assign(sample)
        member = np.zeros((len(sample), len(self.centroids)), bool)
        member[r, c] = True
        need, counts = [], []
        for i in range(0, len(queries), 100):
            q = queries[i : i + 100]
            near = np.argsort(distances(q, sample), axis=1)[:, 1 : K + 1]
            to = np.sqrt(distances(q, self.centroids))
            to /= np.maximum(to.min(1, keepdims=True), 1e-12)
            need.append(np.where(member[near], to[:, None, :], np.inf).min(2).ravel())
            counts.append(to)
        need = np.concatenate(need)
        ratio = float(np.quantile(need[np.isfinite(need)], COVER)) if len(need) else 1.0
        width = int((np.concatenate(counts) <= ratio).sum(1).max()) if counts else 1
        return ratio, min(len(self.centroids), max(32, 2 * width))


def _matrix(column) -> np.ndarray:
    """An Arrow or pandas column of equally long lists."""
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.array([np.asarray(x, np.float64) for x in column])


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found, or all if fewer, nearest first.

    vectors and queries(vec_id, embedding). Nearness is Euclidean distance; ties go to the smaller vec_id. Rows
    with a null vec_id, or an embedding that is null, empty, zero or holds null or non-finite components, take no
    part, nor do those of another length than most (of the lengths with most rows, the largest). A query's own
    vec_id is no candidate. Repeated rows count once; a vec_id with several vectors counts by its nearest. An
    empty table gives an empty result.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, asked = clean(vectors), clean(queries).distinct()
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    out = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = F.size("embedding") == sizes.d
    equal = F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))
    kept, kept_path = materialize(rows.filter(same).withColumn("r", equal).filter(F.col("r") <= k + 1).drop("r").distinct(), "vectors")
    asked, asked_path = materialize(asked.filter(same), "queries")
    n = kept.count()
    n_lists = max(1, min(MAX_LISTS, int(0.6 * math.sqrt(n))))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["vec_id"].to_numpy(zero_copy_only=False), _matrix(b["embedding"])) for b in batches if b.num_rows]
        order = np.argsort(np.concatenate([i for i, _ in parts]), kind="stable")
        blob = pickle.dumps(Lists(np.concatenate([x for _, x in parts])[order], n_lists), 5)
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["lists"])

    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_FIT) if n > MAX_FIT else kept
    lists = spark.sparkContext.broadcast(pickle.loads(sample.repartition(1).mapInArrow(fit, "lists binary").first().lists))
    parts = max(1, math.ceil(n * REPLICAS / n_lists / LIST_ROWS))

    def placed(method: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r, c = getattr(lists.value, method)(_matrix(batch["embedding"])) if batch.num_rows else (np.zeros(0, int),) * 2
                took = batch.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), took["vec_id"], took["embedding"]], ["list", "vec_id", "embedding"])

        return run

    schema = "list int, vec_id long, embedding array<double>"
    postings = kept.mapInArrow(placed("assign"), schema).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    probes = asked.mapInArrow(placed("probe"), schema).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(members: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(members) and len(asking):
            ids, x = members.vec_id.to_numpy(), _matrix(members.embedding)
            for q, v in zip(asking.vec_id, _matrix(asking.embedding)):
                near, d = nearest_exact(ids, x, v, q, k)
                found.append(pd.DataFrame({"query_id": q, "vec_id": near, "score": d}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    met = postings.groupBy("list", "part").cogroup(probes.groupBy("list", "part")).applyInPandas(meet, out)
    best, best_path = materialize(_top(met, k), "nearest")
    ids = kept.select("vec_id").distinct().count()
    short = asked.select(F.col("vec_id").alias("query_id")).distinct().join(best.groupBy("query_id").count(), "query_id", "left").filter(F.coalesce("count", F.lit(0)) < min(k, ids)).select("query_id")
    lacking = asked.join(short, asked.vec_id == short.query_id, "left_semi")
    more = []
    for block in _blocks(lacking):
        more.append(_against_all(kept, block, k, out))
    for m in more:
        best = best.unionByName(m)
    if more:
        best = _top(best, k)
    else:
        discard(spark, kept_path, asked_path)
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).select("query_id", "rank", "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, each vec_id once; ranked in part before the shuffle."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def _blocks(queries: DataFrame) -> Iterator[list]:
    block = []
    for row in queries.toLocalIterator():
        block.append((row.vec_id, list(row.embedding)))
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    if block:
        yield block


def _against_all(kept: DataFrame, block: list, k: int, out: str) -> DataFrame:
    """A block of queries against every row: each batch's k nearest."""
    shared = kept.sparkSession.sparkContext.broadcast(([q for q, _ in block], np.array([v for _, v in block])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = batch["vec_id"].to_numpy(zero_copy_only=False), _matrix(batch["embedding"])
                found = [(q, *nearest_exact(ids, x, v, q, k)) for q, v in zip(*shared.value)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found])), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([d for _, _, d in found]))], ["query_id", "vec_id", "score"])

    return kept.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
