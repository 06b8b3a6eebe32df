"""Manifests and lock files as tables (I7, I8): parsed where they lie, one row a file."""
from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

DEPS = "path string, package string, ordinal long, alias string, name string, kind string, target string, optional boolean, default_features boolean, features array<string>"
NODES = "path string, ordinal long, name string, version string, source string, checksum string, dependencies array<string>"


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content) of the files below root of that name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def dependencies(manifests: DataFrame) -> DataFrame:
    """A row for each dependency of each manifest, in the order of its sections."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame.path, frame.content):
                doc = tomllib.loads(bytes(content).decode())
                package = doc.get("package", {}).get("name")
                places = [(None, doc), *sorted(doc.get("target", {}).items())]
                found = [(t, kind, a, d) for t, at in places for key, kind in (("dependencies", "normal"), ("dev-dependencies", "development"), ("build-dependencies", "build")) for a, d in sorted(at.get(key, {}).items())]
                for i, (target, kind, alias, d) in enumerate(found):
                    d = d if isinstance(d, dict) else {"version": d}
                    rows.append((path, package, i, alias, d.get("package", alias), kind, target, bool(d.get("optional", False)), bool(d.get("default-features", True)), sorted(set(d.get("features", [])))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DEPS.split(", ")])

    return manifests.mapInPandas(run, DEPS)


def lock_nodes(locks: DataFrame) -> DataFrame:
    """A row for each package of each lock file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, i, p.get("name"), p.get("version"), p.get("source"), p.get("checksum"), list(p.get("dependencies", []))) for path, content in zip(frame.path, frame.content) for i, p in enumerate(tomllib.loads(bytes(content).decode()).get("package", []))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])

    return locks.mapInPandas(run, NODES)


def lock_edges(nodes: DataFrame) -> DataFrame:
    """(path, src, edge_ord, ref, matches, dst): each textual reference and the nodes it fits, by name, version and
    source as far as it gives them. A lock is sound where matches is 1 everywhere."""
    refs = nodes.select("path", F.col("ordinal").alias("src"), F.posexplode("dependencies").alias("edge_ord", "ref"))
    parts = F.split("ref", " ", 3)
    refs = refs.select("*", F.get(parts, 0).alias("name"), F.get(parts, 1).alias("want_version"), F.regexp_extract(F.coalesce(F.get(parts, 2), F.lit("")), r"^\((.*)\)$", 1).alias("want_source"))
    to = nodes.select("path", "name", "version", "source", F.col("ordinal").alias("dst"))
    fits = (F.col("want_version").isNull() | (F.col("want_version") == F.col("version"))) & ((F.col("want_source") == "") | (F.col("want_source") == F.col("source")))
    met = refs.join(to, ["path", "name"], "left").withColumn("fits", F.coalesce(fits & F.col("dst").isNotNull(), F.lit(False)))
    return met.groupBy("path", "src", "edge_ord", "ref").agg(F.count_if("fits").alias("matches"), F.min(F.when(F.col("fits"), F.col("dst"))).alias("dst"))
