"""Queries of predicates, coverage and report parts over the fact tables of `facts`, with SQL for an independent engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import predicates as P
from plumbline.operators import capability as C, explain as X, relate as R, report as O, repository as RP, worlds as W
from plumbline.plans import driver_queries as D, facts, policy_queries as PQ
from plumbline.plans.driver_queries import register


@register("report_groups", f"SELECT id, rule, 'error' AS severity, count(*)::BIGINT AS count FROM ({D.ORACLE_SQL['scope_rules']}) GROUP BY 1, 2")
def report_groups(spark: SparkSession, d: str) -> DataFrame:
    """A report's groups, sorted (A3), of the scope rule's findings over all facts."""
    return O.groups(C.scope_findings(facts.rows(spark, d, "files"), facts.rows(spark, d, "facts"), PQ.SCOPES))


@register("governed_surface", f"""
WITH x AS {facts.table("facts")} SELECT 'net' AS owner, path, line, name, 'use' AS evidence, quality, path = 'crates/building/src/n2/c1.rs' AS allowed FROM x
WHERE kind = 'path' AND starts_with(path, 'crates/building/') AND (name = 'std::net' OR starts_with(name, 'std::net::') OR (quality <> 'exact' AND starts_with('std::net', name || '::')))
""")
def governed_surface(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence that an owner governs, allowed or not."""
    return X.governed_surface(facts.rows(spark, d, "files"), facts.rows(spark, d, "facts"), facts.rows(spark, d, "operations"), PQ.OWNERS[:1])


@register("file_fact_counts", f"WITH x AS {facts.table('facts')}, o AS {facts.table('operations')} SELECT path, count(*)::BIGINT AS n FROM (SELECT path FROM x UNION ALL SELECT path FROM o) GROUP BY 1")
def file_fact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each file over its tables (A10)."""
    return X.fact_counts([facts.rows(spark, d, "facts"), facts.rows(spark, d, "operations")])


@register("unresolved_counts", f"WITH x AS {facts.table('facts')} SELECT count(*) FILTER (WHERE quality = 'unresolved')::BIGINT AS unresolved, 0::BIGINT AS ambiguous FROM x")
def unresolved_counts(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved and ambiguous facts."""
    return X.unresolved_counts(facts.rows(spark, d, "facts"))


_GUARDS = [("on", 0, True), ("on", 1, True), ("off", 0, False), ("off", 1, False), ("unknown", 0, False), ("unknown", 1, None)]


@register("active_facts", f"""
WITH x AS {facts.table("facts")}, g AS (SELECT *, CASE WHEN starts_with(name, 'std::fs') THEN 'off' WHEN starts_with(name, 'std::net') THEN 'unknown' WHEN starts_with(name, 'serde') THEN NULL ELSE 'on' END AS cfg FROM x)
SELECT path, ordinal, name FROM g WHERE cfg IS NULL OR cfg = 'on' OR (cfg = 'unknown' AND bits <> 1)
""")
def active_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that some compilation of their file holds: production files have the first domain, the others both."""
    name = F.col("name")
    guard = F.when(name.startswith("std::fs"), "off").when(name.startswith("std::net"), "unknown").when(~name.startswith("serde"), "on")
    x = facts.rows(spark, d, "facts").select("path", "ordinal", "name", guard.alias("guard"))
    domains = facts.rows(spark, d, "files").select("path", F.explode(F.when(F.col("bits") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("domain"))
    values = spark.createDataFrame(_GUARDS, "guard string, domain int, value boolean")
    return W.active_facts(x, domains, values, True).select("path", "ordinal", "name")


@register("production_facts", f"WITH x AS {facts.table('facts')} SELECT path, count(*)::BIGINT AS n FROM x WHERE bits IN (1, 3) AND coalesce(guard, true) GROUP BY 1")
def production_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that count for production policy, by file."""
    files = facts.rows(spark, d, "files").select("path", "bits")
    return facts.rows(spark, d, "facts").join(files, "path").filter(P.production_applicable(F.col("bits"), F.col("guard"))).groupBy("path").agg(F.count("*").alias("n"))


@register("file_budgets", f"""
WITH f AS {facts.table("files")}, e AS (SELECT *, CASE WHEN class IN ('facade', 'implementation') AND file % 10 = 3 THEN 'implementation' WHEN class IN ('facade', 'implementation') AND file % 10 = 4 THEN 'facade' ELSE class END AS role FROM f)
SELECT path, role, CASE WHEN role <> 'generated' AND bits = 2 THEN 'test' WHEN role = 'test' THEN 'implementation' ELSE role END AS budget,
  CASE bits WHEN 1 THEN 'production' WHEN 2 THEN 'test-only' ELSE 'both' END AS reach FROM e
""")
def file_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Each file's effective role, the budget that governs it, and its reachability in words."""
    declared = F.when(F.col("file") % 10 == 3, "implementation").when(F.col("file") % 10 == 4, "facade")
    files = facts.rows(spark, d, "files").withColumn("role", P.effective_role(F.col("class"), declared))
    return files.select("path", "role", P.budget_role(F.col("role"), F.col("bits")).alias("budget"), P.reach_name(F.col("bits")).alias("reach"))


def _framed(x: str) -> str:
    return f"encode(octet_length(encode({x}))::VARCHAR) || '\\x00'::BLOB || encode({x}) || '\\xFF'::BLOB"


def _counted(x: str) -> str:
    return f"unhex(lpad(to_hex(octet_length(encode({x}))), 16, '0')) || encode({x})"


@register("digests", f"""
SELECT doc_id, 'kind:sha256:' || sha256(encode('domain') || '\\x00'::BLOB || {_framed('source')} || {_framed('text')}) AS policy,
  sha256(encode('domain') || '\\x00'::BLOB || {_counted('lang')} || {_counted('text')}) AS input FROM documents
""")
def digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of framed fields of whole documents: by lengths in decimal (S23), and by lengths of 8 bytes."""
    docs = D.table(spark, d, "documents")
    fields = F.array(F.col("lang").cast("binary"), F.col("text").cast("binary"))
    return docs.select("doc_id", P.policy_id("kind", "domain", [F.col("source"), F.col("text")]).alias("policy"), P.counted_digest("domain", fields).alias("input"))


@register("selector_names", "SELECT p_partkey, regexp_replace(replace(p_type, ' ', '::r#'), '(^|::)r#', '\\1', 'g') AS selector, CASE WHEN p_size % 2 = 0 THEN [p_name] ELSE [p_type, p_brand] END AS names FROM part")
def selector_names(spark: SparkSession, d: str) -> DataFrame:
    """Selectors without raw marks, and the names that policy compares."""
    part = D.table(spark, d, "part")
    canonical = F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type", "p_brand"))
    return part.select("p_partkey", P.ratchet_selector(F.replace("p_type", F.lit(" "), F.lit("::r#"))).alias("selector"), P.policy_names(canonical, F.col("p_name")).alias("names"))


@register("repository_paths", """
WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), s AS (SELECT page_id, path, [x FOR x IN string_split(path, '/') IF x <> '' AND x <> '.'] AS parts FROM p)
SELECT page_id, CASE WHEN starts_with(path, '/') OR contains(path, '\\') OR list_contains(parts, '..') THEN NULL ELSE array_to_string(parts, '/') END AS path FROM s
""")
def repository_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths in their normal form, null for those that leave their root."""
    return D.table(spark, d, "pages").select("page_id", P.relative_path(F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))


@register("worst_quality", f"WITH x AS {facts.table('facts')} SELECT path, CASE max(CASE quality WHEN 'exact' THEN 0 WHEN 'conservative' THEN 1 ELSE 2 END) WHEN 0 THEN 'exact' WHEN 1 THEN 'conservative' ELSE 'unresolved' END AS quality FROM x GROUP BY 1")
def worst_quality(spark: SparkSession, d: str) -> DataFrame:
    """The worst quality of each file's facts."""
    return facts.rows(spark, d, "facts").groupBy("path").agg(P.worst_quality(F.col("quality")).alias("quality"))


@register("capped_sets", f"""
WITH x AS {facts.table("facts")}, s AS (SELECT path, list_sort(list(DISTINCT name)) AS v FROM x GROUP BY 1) SELECT path, CASE WHEN len(v) <= 30 THEN v END AS values, len(v) <= 30 AS known FROM s
""")
def capped_sets(spark: SparkSession, d: str) -> DataFrame:
    """Names that a file's facts use, unknown where they are too many."""
    return R.capped_sets(facts.rows(spark, d, "facts"), ["path"], "name", 30)


@register("indexed_sources", f"WITH f AS {facts.table('files')} SELECT path FROM f WHERE NOT starts_with(path, 'crates/building/') AND NOT regexp_matches(path, '^crates/[^/]*/src/n1[^/]/')")
def indexed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source files outside the exclusions."""
    path = F.col("path")
    return facts.rows(spark, d, "files").filter(RP.indexed_source(path, []) & ~RP.excluded(path, ["crates/building", "crates/*/src/n1?/**"])).select("path")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Files, the folders above them as directories, and one symlink for each file of the fifth nation."""
    files = facts.rows(spark, d, "files").select("path")
    parts = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    links = files.filter("path like '%/n5/%'").select(F.concat(F.lit("links/"), F.regexp_replace("path", "/", "_")).alias("path"), F.lit("symlink").alias("kind"), F.col("path").like("%crates/building/%").alias("inside"))
    return files.select("path", F.lit("file").alias("kind"), F.lit(None).cast("boolean").alias("inside")).unionByName(above.select("path", F.lit("directory").alias("kind"), F.lit(None).cast("boolean").alias("inside"))).unionByName(links)


@register("repository_rules", f"""
WITH f AS {facts.table("files")}, t AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM f), l AS (SELECT 'links/' || replace(path, '/', '_') AS path, contains(path, 'crates/building/') AS inside FROM f WHERE contains(path, '/n5/'))
SELECT 'REP-001' AS id, 'repository.roots' AS rule, 'tools' AS path, 'declared repository root "tools" does not exist' AS message
UNION ALL SELECT 'REP-006', 'repository.exclude', NULL, 'repository exclusion "gen/**" matches no path'
UNION ALL SELECT 'REP-004', 'repository.symlinks', path, 'symlink escapes or is denied by the repository boundary' FROM l WHERE NOT inside
UNION ALL SELECT 'REP-005', 'repository.symlinks', path, 'symlink aliases architecture input that cannot be indexed exactly' FROM l WHERE inside
UNION ALL SELECT 'OWN-001', 'nation', path, 'directory "' || path || '" is outside its declared owner' FROM t WHERE regexp_matches(path, '/n7$') AND path <> 'crates/building/src/n7'
UNION ALL SELECT 'OWN-002', 'nation', 'gone', 'owner policy names missing directory "gone"'
""")
def repository_rules(spark: SparkSession, d: str) -> DataFrame:
    """Roots, exclusions, symlinks and directory owners."""
    policy = {"roots": ["crates", "tools"], "exclude": ["gen/**", "crates/**"], "symlinks": "inside"}
    owners = [{"name": "nation", "kind": "Directory", "selector": "**/n7", "allow": ["crates/building/src/n7", "gone"]}]
    return PQ.shown(RP.repository_findings(_entries(spark, d), policy, owners))
