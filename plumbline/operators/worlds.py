"""Feature worlds: what each package's features come to when all of a workspace is built together.

selections(world, package, default_features, features); declared(package, feature), activations(package, feature, entry) and
implicit(package, alias) as in `features`; deps(package, ordinal, alias, kind, target, optional, default_features, features,
internal_package).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import graph
from plumbline.operators.features import feature_closure, undeclared
from plumbline.sources.shared import discard, materialize


def split_packages(packages: DataFrame, deps: DataFrame) -> DataFrame:
    """(package, cause, via, depth) of packages that may be built in another context: hosts of procedural macros, what conditional or
    non-normal dependencies lead to, and what these depend on. The first cause counts (G8). packages(name, proc_macro)."""
    inside = deps.filter("internal_package is not null")
    host = packages.filter("proc_macro").select(F.col("name").alias("package"), F.lit(0).alias("rank"), F.lit("proc-macro").alias("cause"), F.lit(None).cast("string").alias("via"))
    direct = inside.filter("kind <> 'normal' or target is not null").select(F.col("internal_package").alias("package"), F.lit(1).alias("rank"), F.lit("direct").alias("cause"), F.col("package").alias("via"))
    seeds = host.unionByName(direct).groupBy("package").agg(F.min(F.struct("rank", "cause", "via")).alias("m"))
    edges = inside.select(F.col("package").alias("src"), F.col("internal_package").alias("dst"), F.col("internal_package").alias("ord")).distinct()
    reached = graph.shortest_paths(edges, seeds.select(F.col("package").alias("node")))
    own = reached.join(seeds, reached.node == seeds.package, "left")
    return own.select(F.col("node").alias("package"), F.coalesce("m.cause", F.lit("transitive")).alias("cause"), F.coalesce("m.via", F.when(F.col("depth") > 0, F.element_at("path", -2))).alias("via"), "depth")


def split_edges(deps: DataFrame, split: DataFrame) -> DataFrame:
    """deps with split: conditional or non-normal, or of a package that is split."""
    marked = deps.join(split.select("package", F.lit(True).alias("_s")), "package", "left")
    return marked.withColumn("split", (F.col("kind") != "normal") | F.col("target").isNotNull() | F.coalesce("_s", F.lit(False))).drop("_s")


def world_features(selections: DataFrame, declared: DataFrame, activations: DataFrame, implicit: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(world, package, kind, name, feature) as `feature_closure` has it, and (world, package, feature) requested, at the fixpoint.

    What a package's enabled dependencies ask of others is asked of these, until no round asks for more. Each round is a
    closure of all worlds at once, written to the shared folder.
    """
    spark = selections.sparkSession
    key = lambda c="package": F.concat_ws("\0", "world", c)
    worlds = selections.select("world").distinct()
    everywhere = lambda df: df.join(F.broadcast(worlds)).withColumn("package", key())  # noqa: E731  a contract has a few worlds
    own = [everywhere(x) for x in (declared, activations, implicit)]
    edges = deps.filter("internal_package is not null").join(F.broadcast(worlds)).withColumns({"package": key(), "to": key("internal_package")})
    requested, path = materialize(selections.select(key().alias("package"), F.explode("features").alias("feature")).distinct(), "requested")
    defaults = selections.filter("default_features").select(key().alias("package"), F.lit("default").alias("feature"))
    while True:
        resolved, resolved_path = materialize(feature_closure(*own, requested.unionByName(defaults.join(own[0], ["package", "feature"], "left_semi")).distinct()), "resolved")
        on = resolved.filter("kind = 'enabled'").select("package", F.col("name").alias("alias")).distinct().withColumn("_on", F.lit(True))
        live = edges.join(on, ["package", "alias"], "left").filter(~F.col("optional") | F.coalesce("_on", F.lit(False)))
        asks = live.filter("default_features").select(F.col("to").alias("package"), F.lit("default").alias("feature")).join(own[0], ["package", "feature"], "left_semi")
        asks = asks.unionByName(live.select(F.col("to").alias("package"), F.explode("features").alias("feature")))
        asks = asks.unionByName(live.select("package", "alias", "to").join(resolved.filter("kind = 'forwarded'").select("package", F.col("name").alias("alias"), "feature"), ["package", "alias"]).select(F.col("to").alias("package"), "feature"))
        more, more_path = materialize(asks.distinct().join(requested, ["package", "feature"], "left_anti"), "requested-more")
        apart = lambda df: df.withColumns({"world": F.substring_index("package", "\0", 1), "package": F.substring_index("package", "\0", -1)})
        if more.isEmpty():
            return apart(resolved).select("world", "package", "kind", "name", "feature"), apart(requested).select("world", "package", "feature")
        requested, new_path = materialize(requested.unionByName(more), "requested")
        discard(spark, path, more_path, resolved_path)
        path = new_path


def inexact_worlds(selections: DataFrame, declared: DataFrame, activations: DataFrame, implicit: DataFrame, packages: DataFrame, deps: DataFrame) -> DataFrame:
    """(world, package, name, problem): why a world isn't exact.

    'differs': a feature that is active only if edges into other contexts count; 'split': one of a package that is built in
    another context; 'undeclared': one that its package doesn't declare. No rows: each world is exact.
    """
    split = split_packages(packages, deps)
    edges = split_edges(deps, split)
    lower, _ = world_features(selections, declared, activations, implicit, edges.filter("not split"))
    upper, requested = world_features(selections, declared, activations, implicit, edges)
    found = ["world", "package", "kind", "name", "feature"]
    differs = upper.select(*found).subtract(lower.select(*found)).unionByName(lower.select(*found).subtract(upper.select(*found)))
    active = upper.filter("kind = 'active'").join(split.select("package"), "package", "left_semi")
    unknown = undeclared(declared, requested)
    told = lambda df, name, problem: df.select("world", "package", F.col(name).alias("name"), F.lit(problem).alias("problem"))
    return told(differs, "name", "differs").unionByName(told(active, "name", "split")).unionByName(told(unknown, "feature", "undeclared")).distinct()


def active_facts(facts: DataFrame, domains: DataFrame, values: DataFrame, exact: bool) -> DataFrame:
    """Facts that some domain of their file may compile (P2): those whose guard isn't false in every one. Without exact worlds all stay.

    facts(path, guard, ...), a null guard always holds; domains(path, domain); values(guard, domain, value), null for unknown.
    """
    if not exact:
        return facts
    held = facts.select("path", "guard").distinct().join(domains.select("path", "domain").distinct(), "path").join(values, ["guard", "domain"], "left")
    held = held.filter(F.coalesce("value", F.lit(True)))
    live = held.select("path", F.coalesce("guard", F.lit("\0")).alias("_g")).distinct()
    return facts.withColumn("_g", F.coalesce("guard", F.lit("\0"))).join(live, ["path", "_g"], "left_semi").drop("_g")
