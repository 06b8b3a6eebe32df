"""Findings: their columns, their building, and policy tables as DataFrames."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.predicates import fingerprint, glob_regex, path_bytes
from plumbline.operators.relate import MAX_POLICY

SPAN = "struct<line:bigint,column:bigint,end_line:bigint,end_column:bigint>"
FINDING = ("id", "rule", "category", "severity", "message", "path", "span", "reason", "help", "analysis")


def text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def said(*parts) -> Column:
    """Parts in a row, texts and columns."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _sortable(df: DataFrame, c) -> Column:
    """A text that sorts as the column does: numbers with zeros before them; null first."""
    column = F.col(c) if isinstance(c, str) else c
    kind = df.select(column).schema[0].dataType.typeName()
    if kind in ("integer", "long", "short", "byte", "boolean"):
        column = F.lpad(column.cast("long").cast("string"), 20, "0")
    return F.coalesce(column.cast("string"), F.lit(""))


def finding(df: DataFrame, id_, rule, category: str, message: Column, path=None, span: Column | None = None, reason=None, help_: str | None = None, analysis=None, emit: tuple = (), severity: str = "error") -> DataFrame:
    """A finding for each row. emit: columns that order the findings of a rule as they are found."""
    order = F.concat_ws("\1", *[_sortable(df, c) for c in emit]) if emit else F.lit("")
    return df.select(
        text(id_).alias("id"), text(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), message.alias("message"),
        text(path).alias("path"), (F.lit(None) if span is None else span).cast(SPAN).alias("span"), text(reason).alias("reason"), text(help_).alias("help"),
        text(analysis).alias("analysis"), order.alias("emit"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    """Findings of evaluators in their fixed order: rule_ord."""
    return reduce(DataFrame.unionByName, [p.withColumn("rule_ord", F.lit(i)) for i, p in enumerate(parts)])


def with_fingerprint(findings: DataFrame) -> DataFrame:
    numbers = [F.col(f"span.{x}") for x in ("line", "column", "end_line", "end_column")]
    return findings.withColumn("fingerprint", fingerprint(F.col("id"), F.col("rule"), F.col("path"), F.col("message"), numbers))


def policy(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A policy's rows in their stored order: ord, and the columns of schema, null where a row lacks one."""
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    return spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], f"ord long, {schema}")


def patterns(rows: DataFrame, column: str) -> DataFrame:
    """(ord, at, pattern, regex) of each glob in an array column of a policy; regex is null for one over the limits."""
    spark = rows.sparkSession
    own = [(r.ord, i, p, glob_regex(p)) for r in rows.select("ord", column).collect() for i, p in enumerate(r[column] or [])]  # a policy's rows
    return spark.createDataFrame(own, "ord long, at long, pattern string, regex string")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A policy table of that many rows, sent to the data if it is small."""
    return F.broadcast(df) if rows <= MAX_POLICY else df


def matched(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, ord, at) of the paths(path) that fit a pattern; the patterns travel, the paths stay where they are."""
    live = globs.filter("regex is not null")
    return paths.withColumn("_bytes", path_bytes(F.col("path"))).join(small(live, live.count()), F.expr("_bytes rlike regex")).select("path", "ord", "at")
