"""Relations between policy and data, and between two snapshots (J, N and D families)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


#: A policy table up to this many rows travels to the data; a larger one meets it as Spark chooses.
MAX_POLICY = 100_000


def stale(policy: DataFrame, data: DataFrame, on, keys: list[str] | None = None) -> DataFrame:
    """Policy rows that match no data. `on` is a list of keys (equi, distinct keys only travel) or a condition.

    With a condition, `keys` name the policy's rows: the policy travels to the data, one scan finds the rows that match, and
    these leave by equality. The data is never broadcast.
    """
    if isinstance(on, (list, str)):
        keys = [on] if isinstance(on, str) else on
        return policy.join(data.select(*keys).distinct(), keys, "left_anti")
    few = F.broadcast(policy) if policy.count() <= MAX_POLICY else policy
    return policy.join(data.join(few, on).select(*keys).distinct(), keys, "left_anti")


def multiplicity(left: DataFrame, right: DataFrame, keys: list[str], name: str = "matches") -> DataFrame:
    """left with the number of right rows of its key: 0 is missing, 1 exact, more ambiguous.

    right is counted before the join, with partial sums, so a key with many rows is one row in the join.
    """
    counts = right.groupBy(*keys).agg(F.count("*").alias(name))
    return left.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def resolution(matches: Column) -> Column:
    return F.when(matches == 0, "missing").when(matches == 1, "exact").otherwise("ambiguous")


def membership(declared: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Both set differences: rows declared only ('missing') and present only ('undeclared')."""
    a = declared.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = present.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, keys, "full_outer").filter("_a is null or _b is null")
    return both.select(*keys, F.when(F.col("_b").isNull(), "missing").otherwise("undeclared").alias("finding"))


def reconcile(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before, after and class: added, removed, changed or same (nulls equal) of each key in either side."""
    a = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_a"))
    b = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return both.select(*keys, "before", "after", kind.alias("class"))


def directional(changes: DataFrame, up: str, down: str) -> DataFrame:
    """reconcile() rows that changed, with kind: up for more or new, down for less or gone; a null counts as nothing."""
    grew = (F.col("class") == "added") | ((F.col("class") == "changed") & (F.col("before").isNull() | F.coalesce(F.col("after") > F.col("before"), F.lit(False))))
    return changes.filter("class <> 'same'").withColumn("kind", F.when(grew, up).otherwise(down))


def ratchet(measured: DataFrame, targets: DataFrame, locked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, target, locked, finding of each measured or targeted key.

    No target: 'unratcheted' where the value is over 0. A target: 'stale' at 0, 'missing' without a locked value,
    'grew' or 'shrank' against it, else 'held'.
    """
    m = measured.select(*keys, "value")
    rows = m.join(targets.select(*keys, "target"), keys, "full_outer").join(locked.select(*keys, "locked"), keys, "left")
    v = F.coalesce("value", F.lit(0))
    finding = F.when(F.col("target").isNull(), F.when(v > 0, "unratcheted").otherwise("none")).when(v == 0, "stale").when(F.col("locked").isNull(), "missing").when(v > F.col("locked"), "grew").when(v < F.col("locked"), "shrank").otherwise("held")
    return rows.select(*keys, v.alias("value"), "target", "locked", finding.alias("finding"))


def agreement(instances: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """keys, quality: exact if every instance resolves to one identity, unresolved if one has none, else conservative."""
    g = instances.groupBy(*keys).agg(F.count_distinct(identity).alias("n"), F.bool_or(F.col(identity).isNull()).alias("missing"), F.min(identity).alias("identity"))
    quality = F.when(F.col("missing"), "unresolved").when(F.col("n") == 1, "exact").otherwise("conservative")
    return g.select(*keys, quality.alias("quality"), F.when((F.col("n") == 1) & ~F.col("missing"), F.col("identity")).alias("identity"))


def capped_sets(rows: DataFrame, keys: list[str], value: str, cap: int) -> DataFrame:
    """keys, n, values and known: each group's distinct values, sorted, if they are at most `cap`; with more the set is unknown.

    Distinct values meet once each, and a group keeps no more than one over the cap, so no group is gathered whole.
    """
    each = rows.select(*keys, value).filter(F.col(value).isNotNull()).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    least = each.withColumn("_r", rank).filter(F.col("_r") <= cap + 1).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_all"))
    out = rows.select(*keys).distinct().join(least, keys, "left").withColumn("n", F.coalesce(F.size("_all"), F.lit(0)))
    known = F.col("n") <= cap
    return out.select(*keys, F.when(known, F.coalesce("_all", F.array().cast(rows.select(F.array(value).alias("a")).schema["a"].dataType))).alias("values"), known.alias("known"))


def union_rules(rules: list[DataFrame]) -> DataFrame:
    """Findings of rules in their fixed order, with rule_ord."""
    return reduce(DataFrame.unionByName, [r.withColumn("rule_ord", F.lit(i)) for i, r in enumerate(rules)])
