"""Manifest dependencies and selectors against a lock's nodes."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.versions import git_matches_column, version_matches_column

#: Fixed value: the registry of dependencies that name none.
REGISTRY = "registry+https://github.com/rust-lang/crates.io-index"


def lock_mapping(deps: DataFrame, nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(package, ordinal, matches, node): the locked nodes that each manifest dependency may be; node is null unless it is one.

    deps(package, ordinal, name, source_kind, location, requirement, branch, tag, rev): source_kind is path, registry or git, location the
    directory, the index (null: the usual registry) or the repository. nodes(node, name, version, source), edges(src, dst),
    roots(package, node).
    """
    out = deps.join(roots.select("package", F.col("node").alias("src")), "package", "left").join(edges, "src", "left")
    to = nodes.select(F.col("node").alias("dst"), F.col("name").alias("to_name"), "version", "source")
    met = out.join(to, "dst", "left").withColumn("near", F.coalesce(F.col("to_name") == F.col("name"), F.lit(False)))
    location = F.col("location")
    plain = F.when(F.col("source_kind") == "path", F.col("source") == F.concat(F.lit("path+"), location)).when(F.col("source_kind") == "registry", F.col("source") == F.coalesce(F.concat(F.lit("registry+"), location), F.lit(REGISTRY)))
    fit = met.filter("near").withColumn("same", F.when(F.col("source_kind") != "git", plain))
    fit = fit.withColumn("same", F.coalesce("same", git_matches_column("source", "location", "branch", "tag", "rev"))).filter("same")
    fit = fit.filter(version_matches_column("version", "requirement"))
    counts = fit.groupBy("package", "ordinal").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("one"))
    return deps.select("package", "ordinal").join(counts, ["package", "ordinal"], "left").select("package", "ordinal", F.coalesce("n", F.lit(0)).alias("matches"), F.when(F.col("n") == 1, F.col("one")).alias("node"))


def lock_select(selectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """selectors(selector, name, version, source) with matches and node: by name, and by version and source where they are given."""
    fits = (F.col("s.version").isNull() | (F.col("s.version") == F.col("n.version"))) & (F.col("s.source").isNull() | (F.col("s.source") == F.col("n.source")))
    met = selectors.alias("s").join(nodes.alias("n"), (F.col("s.name") == F.col("n.name")) & fits, "left")
    counts = met.groupBy("s.selector").agg(F.count("n.node").alias("matches"), F.min("n.node").alias("one"))
    return counts.select("selector", "matches", F.when(F.col("matches") == 1, F.col("one")).alias("node"))
