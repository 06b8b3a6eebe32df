"""Fact tables over the driver's tables: each is one SQL text that Spark and an independent engine both read.

Customers are source files, their orders' lines are facts and operations in these files, nations are packages whose layers are
their regions. All rows of the tables count.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPAN = "struct(line as line, col as column, line as end_line, col as end_column)"

FILES = """
SELECT 'crates/' || lower(c_mktsegment) || '/src/n' || c_nationkey || '/c' || c_custkey || '.rs' AS path, lower(c_mktsegment) AS package,
  CASE WHEN c_nationkey % 4 = 0 THEN 2 WHEN c_nationkey % 4 = 1 THEN 3 ELSE 1 END AS bits, CAST(floor(abs(c_acctbal)) AS bigint) AS lines, c_custkey AS file,
  CASE WHEN c_nationkey % 4 = 0 THEN 'test' WHEN c_nationkey = 3 THEN 'generated' WHEN c_nationkey % 5 = 2 THEN 'facade' ELSE 'implementation' END AS class
FROM {customer}
"""

_NAME = """CASE l_suppkey % 10 WHEN 0 THEN 'std::fs' WHEN 1 THEN 'std::net' WHEN 2 THEN 'std::process' WHEN 3 THEN 'std::env' WHEN 4 THEN 'crate::store'
  WHEN 5 THEN 'std::thread' WHEN 6 THEN 'rand' WHEN 7 THEN 'tokio::process' WHEN 8 THEN 'serde' ELSE 'std::time::Instant' END"""

_LINES = f"""
SELECT f.path, f.bits, l.l_orderkey AS line, CAST(l.l_linenumber AS bigint) AS col, l.l_orderkey * 1000000 + l.l_partkey * 10 + l.l_linenumber AS ordinal, l.l_returnflag, l.l_linenumber, l.l_quantity,
  CASE WHEN l_linestatus = 'F' AND l_tax <= 0.04 THEN {_NAME} ELSE {_NAME} || '::f' || (l_partkey % 5) END AS name,
  CASE WHEN l_linestatus = 'O' THEN 'exact' WHEN l_tax > 0.04 THEN 'unresolved' ELSE 'conservative' END AS quality,
  CASE WHEN l_tax = 0 THEN false WHEN l_tax = 0.08 THEN NULL ELSE true END AS guard
FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN ({FILES}) f ON o.o_custkey = f.file
"""

#: Tables by name. Names of facts stand for themselves: none has another canonical one.
SQL = {
    "files": FILES,
    "facts": f"SELECT path, bits, CASE l_returnflag WHEN 'A' THEN 'path' WHEN 'N' THEN 'call' ELSE 'macro' END AS kind, ordinal, name, line, col, quality, guard FROM ({_LINES})",
    "operations": f"""SELECT path, bits, CASE l_linenumber % 6 WHEN 0 THEN 'TypeConstruction' WHEN 1 THEN 'MethodCall' WHEN 2 THEN 'FieldRead' WHEN 3 THEN 'FieldWrite' WHEN 4 THEN 'FieldMutableBorrow' ELSE 'FieldReceiverCall' END AS kind,
  ordinal, name, line, col, quality, guard, CASE WHEN l_quantity < 10 THEN 'push' ELSE 'len' END AS method FROM ({_LINES})""",
    "packages": "SELECT lower(n_name) AS name, CASE WHEN n_nationkey = 0 THEN '.' ELSE 'crates/' || lower(n_name) END AS directory, n_nationkey AS id, n_regionkey AS region FROM {nation}",
    "deps": """SELECT lower(a.n_name) AS package, s.s_suppkey AS ordinal, 'dep' || s.s_suppkey AS alias, CASE WHEN s.s_acctbal < 3000 THEN 'ext' || (s.s_suppkey % 5) ELSE lower(b.n_name) END AS name,
  CASE WHEN s.s_acctbal < 1000 THEN 'build' WHEN s.s_acctbal < 5000 THEN 'development' ELSE 'normal' END AS kind, CASE WHEN s.s_acctbal >= 3000 THEN lower(b.n_name) END AS internal_package
FROM {supplier} s JOIN {nation} a ON a.n_nationkey = s.s_nationkey JOIN {nation} b ON b.n_nationkey = (s.s_suppkey * 7) % 25""",
}


def rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A fact table in Spark, with spans as structs and arrays where the operators want them."""
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("customer", "orders", "lineitem", "nation", "supplier") if "{" + t + "}" in SQL[name]}
    out = spark.sql(SQL[name].replace("{text}", "string"), **tables)
    if name in ("facts", "operations", "debts"):
        out = out.selectExpr("*", f"{SPAN} as span").withColumn("canonical", _none()).drop("line", "col", "bits")
    return out


def _none():
    from pyspark.sql import functions as F

    return F.array().cast("array<string>")


def table(name: str) -> str:
    """The same table for the other engine, as a subquery."""
    return "(" + SQL[name].format(customer="customer", orders="orders", lineitem="lineitem", nation="nation", supplier="supplier", text="varchar") + ")"

SQL["debts"] = f"""SELECT path, CASE l_linenumber % 5 WHEN 0 THEN 'method' WHEN 1 THEN 'macro' WHEN 2 THEN 'unsafe' WHEN 3 THEN 'suppression' ELSE 'test' END AS kind, ordinal, line, col, quality,
  CASE l_linenumber % 5 WHEN 0 THEN CASE WHEN l_quantity < 20 THEN 'unwrap' ELSE 'r#expect' END WHEN 1 THEN CASE WHEN l_quantity < 20 THEN 'std::dbg' ELSE 'todo' END WHEN 2 THEN 'unsafe block'
    WHEN 3 THEN CASE WHEN l_quantity < 25 THEN 'unreasoned lint suppression' ELSE 'lint suppression' END ELSE 'it_' || CAST(l_quantity AS int) END AS name FROM ({_LINES})"""


#: Entries of two snapshots (see `operators.diff`): what customers, orders and their lines were up to a day, and after it.
_SIDE = "CASE WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'before' ELSE 'after' END"
SQL["entries"] = f"""
SELECT side, 'lock.package' AS key, 'c' || o_custkey AS subject, CAST(NULL AS {{text}}) AS value, CAST(NULL AS double) AS rank, CAST(NULL AS {{text}}) AS parent FROM (SELECT {_SIDE} AS side, o_custkey FROM {{orders}}) a GROUP BY side, o_custkey
UNION ALL SELECT side, 'lock.edge', 'c' || o_custkey || '->s' || l_suppkey, NULL, NULL, NULL FROM (SELECT {_SIDE} AS side, o_custkey, l_suppkey FROM {{orders}} o JOIN {{lineitem}} l ON l.l_orderkey = o.o_orderkey) b GROUP BY side, o_custkey, l_suppkey
UNION ALL SELECT side, 'lock.ratchet', 'rust.file-size:c' || o_custkey, CAST(count(*) AS {{text}}), CAST(count(*) AS double), NULL FROM (SELECT {_SIDE} AS side, o_custkey FROM {{orders}}) c GROUP BY side, o_custkey
UNION ALL SELECT side, 'lock.gate', 'c' || o_custkey, min(o_orderpriority), NULL, NULL FROM (SELECT {_SIDE} AS side, o_custkey, o_orderpriority FROM {{orders}}) e GROUP BY side, o_custkey
UNION ALL SELECT side, 'lock.gate.input', 'c' || o_custkey || ':' || o_orderpriority, max(o_orderstatus), NULL, 'lock.gate:c' || o_custkey FROM (SELECT {_SIDE} AS side, o_custkey, o_orderpriority, o_orderstatus FROM {{orders}}) g GROUP BY side, o_custkey, o_orderpriority
UNION ALL SELECT side, 'layer.external', 'c' || o_custkey, min(o_orderstatus), min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END), NULL FROM (SELECT {_SIDE} AS side, o_custkey, o_orderstatus FROM {{orders}}) h GROUP BY side, o_custkey
"""
