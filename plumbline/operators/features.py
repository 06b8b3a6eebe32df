"""Feature closures of packages."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.graph import fixpoint


def feature_closure(declared: DataFrame, activations: DataFrame, implicit: DataFrame, requested: DataFrame) -> DataFrame:
    """(package, kind, name, feature): what the requested features switch on.

    declared(package, feature); activations(package, feature, entry); implicit(package, alias): optional
    dependencies that are features themselves; requested(package, feature), where an undeclared `default` is
    passed over. kind 'active' has the feature in name; 'enabled' a dependency's alias; 'forwarded' the alias and
    the dependency's feature. An entry is a declared feature, `dep:alias`, `alias/feature`, or `alias?/feature`,
    which forwards without enabling.
    """
    moves = activations.join(declared.select("package", F.col("feature").alias("entry")), ["package", "entry"]).select("package", "feature", F.col("entry").alias("next"))
    seed = requested.join(declared, ["package", "feature"], "left_semi").select("package", "feature")
    active = fixpoint(seed, lambda new: new.join(moves, ["package", "feature"]).select("package", F.col("next").alias("feature")))
    other = active.join(activations, ["package", "feature"]).join(declared.select("package", F.col("feature").alias("entry")), ["package", "entry"], "left_anti")
    entry, alias = F.col("entry"), F.regexp_extract("entry", r"^([^/?]*)\??/", 1)
    none = F.lit(None).cast("string")
    parts = [
        active.select("package", F.lit("active").alias("kind"), F.col("feature").alias("name"), none.alias("feature")),
        active.join(implicit.select("package", F.col("alias").alias("feature")), ["package", "feature"]).select("package", F.lit("enabled").alias("kind"), F.col("feature").alias("name"), none.alias("feature")),
        other.filter(entry.startswith("dep:")).select("package", F.lit("enabled").alias("kind"), F.substring(entry, 5, 1 << 30).alias("name"), none.alias("feature")),
        other.filter(entry.contains("/") & ~entry.contains("?/") & ~entry.startswith("dep:")).select("package", F.lit("enabled").alias("kind"), alias.alias("name"), none.alias("feature")),
        other.filter(entry.contains("/") & ~entry.startswith("dep:")).select("package", F.lit("forwarded").alias("kind"), alias.alias("name"), F.regexp_extract("entry", "/(.*)$", 1).alias("feature")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def undeclared(declared: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected features that their package doesn't declare: an error for the caller to raise."""
    return selected.join(declared, ["package", "feature"], "left_anti")
