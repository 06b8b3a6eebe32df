"""Queries of counted debt, roles and evidence over the fact tables of `facts`, with SQL for an independent engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import evidence as E, source_rules as S
from plumbline.plans import facts
from plumbline.plans.driver_queries import register
from plumbline.plans.policy_queries import shown

RUST = {"hygiene": {"deny_methods": ["unwrap", "expect"], "deny_macros": ["dbg"], "lint_suppressions": "reasoned", "unsafe": "deny"}, "module_docs": "required", "tests": "sibling"}
_MEASURED = f"""f AS {facts.table("files")}, x AS {facts.table("debts")}, t AS (SELECT path, class FROM f WHERE bits <> 2),
g AS (SELECT r.rule, r.selector, t.path FROM t, (VALUES ('rust.hygiene.denied-method', 'unwrap'), ('rust.hygiene.denied-method', 'expect'), ('rust.hygiene.denied-macro', 'dbg'), ('rust.hygiene.unsafe', NULL), ('rust.inline-tests', NULL)) r(rule, selector)
  UNION ALL SELECT 'rust.hygiene.lint-suppressions', NULL, path FROM t WHERE class <> 'generated' UNION ALL SELECT 'rust.module-docs', NULL, path FROM f WHERE class <> 'generated'),
o AS (SELECT 'rust.hygiene.denied-method' AS rule, replace(x.name, 'r#', '') AS selector, x.path, x.name, x.line FROM x JOIN t ON t.path = x.path WHERE kind = 'method'
  UNION ALL SELECT 'rust.hygiene.denied-macro', 'dbg', x.path, x.name, x.line FROM x JOIN t ON t.path = x.path WHERE kind = 'macro' AND x.name = 'std::dbg'
  UNION ALL SELECT 'rust.hygiene.unsafe', NULL, x.path, x.name, x.line FROM x JOIN t ON t.path = x.path WHERE kind = 'unsafe' UNION ALL SELECT 'rust.inline-tests', NULL, x.path, x.name, x.line FROM x JOIN t ON t.path = x.path WHERE kind = 'test'
  UNION ALL SELECT 'rust.hygiene.lint-suppressions', NULL, x.path, x.name, x.line FROM x JOIN t ON t.path = x.path WHERE kind = 'suppression' AND t.class <> 'generated' AND x.name = 'unreasoned lint suppression'
  UNION ALL SELECT 'rust.module-docs', NULL, path, '', NULL FROM f WHERE class <> 'generated' AND lines < 2000),
m AS (SELECT g.rule, g.selector, g.path, count(o.path)::BIGINT AS value FROM g LEFT JOIN o ON o.rule = g.rule AND o.selector IS NOT DISTINCT FROM g.selector AND o.path = g.path GROUP BY 1, 2, 3)"""


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = facts.rows(spark, d, "files").withColumn("syntax", F.lit("items")).withColumn("module_docs", F.col("lines") >= 2000)
    return files, facts.rows(spark, d, "debts")


@register("debt_counts", f"WITH {_MEASURED} SELECT * FROM m")
def debt_counts(spark: SparkSession, d: str) -> DataFrame:
    """The measurements of each governed file, zeros included."""
    return S.measurements(*_sources(spark, d), RUST)


@register("debt_rules", f"""
WITH {_MEASURED}, r AS (SELECT 'rust.hygiene.denied-method' AS rule, 'unwrap' AS selector, path FROM f WHERE lines > 3000 UNION ALL SELECT 'rust.hygiene.unsafe', NULL, path FROM f WHERE lines < 5000 UNION ALL SELECT 'rust.inline-tests', NULL, 'crates/gone.rs' UNION ALL SELECT 'rust.module-docs', NULL, path FROM f WHERE lines < 1000),
k AS (SELECT 'rust.hygiene.denied-method' AS rule, 'unwrap' AS selector, path, CAST(file % 5 AS bigint) AS value FROM f WHERE lines > 4000 UNION ALL SELECT 'rust.hygiene.unsafe', NULL, path, 7 FROM f WHERE lines > 1000),
j AS (SELECT coalesce(m.rule, r.rule) AS rule, coalesce(m.selector, r.selector) AS selector, coalesce(m.path, r.path) AS path, m.value, r.rule IS NOT NULL AS declared, k.value AS held
  FROM m FULL JOIN r ON r.rule = m.rule AND r.selector IS NOT DISTINCT FROM m.selector AND r.path = m.path LEFT JOIN k ON k.rule = coalesce(m.rule, r.rule) AND k.selector IS NOT DISTINCT FROM coalesce(m.selector, r.selector) AND k.path = coalesce(m.path, r.path)),
n AS (SELECT *, CASE rule WHEN 'rust.hygiene.denied-method' THEN 'uses of denied method ' || selector || '()' WHEN 'rust.hygiene.unsafe' THEN 'unsafe constructs' WHEN 'rust.inline-tests' THEN 'inline tests' ELSE 'missing module documentation' END AS debt,
  CASE rule WHEN 'rust.hygiene.denied-method' THEN 'RUST-HYG-007' WHEN 'rust.hygiene.unsafe' THEN 'RUST-HYG-005' WHEN 'rust.inline-tests' THEN 'RUST-TEST-005' ELSE 'RUST-DOC-002' END AS id FROM j WHERE declared),
p AS (SELECT o.* FROM o JOIN j ON j.rule = o.rule AND j.selector IS NOT DISTINCT FROM o.selector AND j.path = o.path WHERE NOT j.declared)
SELECT id, path, CASE WHEN value IS NULL THEN debt || ' ratchet names missing governed source "' || path || '"' WHEN value = 0 THEN debt || ' was removed but the source retains a stale ratchet' WHEN held IS NULL THEN 'reviewed ' || debt || ' ratchet is absent from the lock file'
  WHEN value > held THEN debt || ' grew from the ' || held || '-construct ratchet to ' || value ELSE debt || ' shrank to ' || value || ' constructs but the lock still permits ' || held END AS message, NULL AS line
FROM n WHERE (value IS NULL OR value = 0 OR held IS NULL OR value <> held) AND (rule <> 'rust.module-docs' OR value > held)
UNION ALL SELECT CASE rule WHEN 'rust.hygiene.denied-method' THEN 'RUST-HYG-001' WHEN 'rust.hygiene.denied-macro' THEN 'RUST-HYG-002' WHEN 'rust.hygiene.lint-suppressions' THEN 'RUST-HYG-003' WHEN 'rust.hygiene.unsafe' THEN 'RUST-HYG-004' WHEN 'rust.inline-tests' THEN 'RUST-TEST-001' ELSE 'RUST-DOC-001' END, path,
  CASE rule WHEN 'rust.hygiene.denied-method' THEN 'production source uses denied method ' || name || '()' WHEN 'rust.hygiene.denied-macro' THEN 'production source uses denied macro ' || name || '!' WHEN 'rust.hygiene.lint-suppressions' THEN 'production source suppresses a compiler or Clippy lint without a reason'
  WHEN 'rust.hygiene.unsafe' THEN 'production source contains ' || name WHEN 'rust.inline-tests' THEN 'production source contains test construct ' || name ELSE 'Rust source is missing its module contract (`//!`)' END, line FROM p
""")
def debt_rules(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences without a ratchet, and ratchets against the lock."""
    files, debts = _sources(spark, d)
    none = F.lit(None).cast("string")
    row = lambda rule, selector, where: files.filter(where).select(F.lit(rule).alias("rule"), selector.alias("selector"), "path", F.lit("r").alias("reason"))
    gone = spark.createDataFrame([("rust.inline-tests", None, "crates/gone.rs", "r")], "rule string, selector string, path string, reason string")
    ratchets = row("rust.hygiene.denied-method", F.lit("r#unwrap"), "lines > 3000").unionByName(row("rust.hygiene.unsafe", none, "lines < 5000")).unionByName(row("rust.module-docs", none, "lines < 1000")).unionByName(gone)
    held = lambda rule, selector, where, value: files.filter(where).select(F.lit(rule).alias("rule"), selector.alias("selector"), "path", value.cast("long").alias("value"))
    locked = held("rust.hygiene.denied-method", F.lit("unwrap"), "lines > 4000", F.col("file") % 5).unionByName(held("rust.hygiene.unsafe", none, "lines > 1000", F.lit(7)))
    return S.counted_findings(files, debts, RUST, ratchets, locked).select("id", "path", "message", F.col("span.line").alias("line"))


@register("role_rules", f"""
WITH f AS {facts.table("files")}, r(path, role) AS (VALUES ('crates/none.rs', 'facade'), ('crates/machinery/src/n19/c1.rs', 'facade'), ('crates/household/src/n2/c0.rs', 'facade'), ('crates/household/src/n4/c1.rs', 'facade')),
j AS (SELECT r.path, r.role, f.class FROM r LEFT JOIN f ON f.path = r.path)
SELECT 'RUST-ROLE-001' AS id, 'rust.file-role' AS rule, path, 'file-role override names missing reachable Rust source "' || path || '"' AS message FROM j WHERE class IS NULL
UNION ALL SELECT 'RUST-ROLE-002', 'rust.file-role', path, 'inferred ' || class || ' source may not be reclassified as ' || role FROM j WHERE class NOT IN ('facade', 'implementation')
UNION ALL SELECT 'RUST-ROLE-003', 'rust.file-role', path, 'file-role override redundantly declares inferred ' || class || ' role' FROM j WHERE class = role
""")
def role_rules(spark: SparkSession, d: str) -> DataFrame:
    """Overrides of file roles."""
    roles = [{"path": p, "role": "facade", "reason": "r"} for p in ("crates/none.rs", "crates/machinery/src/n19/c1.rs", "crates/household/src/n2/c0.rs", "crates/household/src/n4/c1.rs")]
    return shown(S.role_findings(facts.rows(spark, d, "files"), roles))


@register("evidence_rules", f"""
WITH f AS {facts.table("files")}, x AS {facts.table("debts")}, i AS (SELECT path, 'it_' || q AS test FROM f, (VALUES (3), (17), (48)) v(q) WHERE lines < 4000),
n AS (SELECT path, name, count(*) AS n FROM x WHERE kind = 'test' GROUP BY 1, 2), j AS (SELECT i.path, i.test, f.class, n.n FROM i JOIN f ON f.path = i.path LEFT JOIN n ON n.path = i.path AND n.name = i.test)
SELECT 'EVID-003' AS id, 'invariant.evidence' AS rule, path, 'Rust test evidence ' || path || '::' || test || ' is not in test source' AS message FROM j WHERE class <> 'test'
UNION ALL SELECT 'EVID-003', 'invariant.evidence', path, 'Rust test evidence ' || path || '::' || test || ' is not declared' FROM j WHERE class = 'test' AND n IS NULL
UNION ALL SELECT 'EVID-004', 'invariant.evidence', path, 'Rust test evidence ' || path || '::' || test || ' is ambiguous' FROM j WHERE class = 'test' AND n > 1
""")
def evidence_rules(spark: SparkSession, d: str) -> DataFrame:
    """References to tests that must name one test in test source."""
    files, debts = _sources(spark, d)
    named = files.filter("lines < 4000").select("path")
    refs = named.crossJoin(F.broadcast(spark.createDataFrame([(3,), (17,), (48,)], "q int"))).select(F.lit(0).alias("ord"), F.lit("INV").alias("id"), F.lit(0).alias("at"), "path", F.concat(F.lit("it_"), "q").alias("test"))  # three rows
    return shown(E.reference_findings(refs, files, debts.filter("kind = 'test'")))
