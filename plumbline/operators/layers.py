"""Layer assignment and layer-direction rules."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def denied_layer_edges(edges: DataFrame, assigned: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges from one layer into another that its may_depend_on doesn't name.

    edges(src, dst, ...), assigned(package, layer) with one row for each uniquely assigned package,
    layers(layer, may_depend_on). An edge with an unassigned end (or a null one) is skipped. The two
    policy tables are small by nature, but no broadcast is forced: Spark chooses by their size.
    """
    src = assigned.select(F.col("package").alias("src"), F.col("layer").alias("from_layer"))
    dst = assigned.select(F.col("package").alias("dst"), F.col("layer").alias("to_layer"))
    allow = layers.select(F.col("layer").alias("from_layer"), "may_depend_on")
    kept = edges.join(src, "src").join(dst, "dst").join(allow, "from_layer", "left")
    may = F.coalesce(F.col("may_depend_on"), F.array().cast("array<string>"))
    return kept.filter((F.col("from_layer") != F.col("to_layer")) & ~F.array_contains(may, F.col("to_layer"))).select(
        F.col("src").alias("from_package"), F.col("dst").alias("to_package"), "from_layer", "to_layer",
        *[c for c in edges.columns if c not in ("src", "dst")],
    )
