"""Queries of the rule evaluators over the fact tables of `facts`, with SQL for an independent engine."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import capability as C, rules as R
from plumbline.plans import facts
from plumbline.plans.driver_queries import register

SHOWN = ("id", "rule", "path", "message")


def shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*SHOWN, *more)


# --- Dependencies ---

LAYERS = [
    {"name": "core", "packages": ["nation_?"], "may_depend_on": ["edge"], "external": "none", "reason": "the core"},
    {"name": "edge", "packages": ["nation_1*"], "may_depend_on": [], "external": "any", "reason": "the edge"},
    {"name": "tools", "packages": ["nation_2[0]", "nation_12", "nation_2?"], "may_depend_on": ["core", "edge"], "external": "none", "reason": "the tools"},
]
_LAYERS = """l(ord, layer, place, pattern, regex, external, reason) AS (VALUES (0, 'core', 0, 'nation_?', '^nation_.$', 'none', 'the core'), (1, 'edge', 0, 'nation_1*', '^nation_1.*$', 'any', 'the edge'),
  (2, 'tools', 0, 'nation_2[0]', '^nation_2\\[0\\]$', 'none', 'the tools'), (2, 'tools', 1, 'nation_12', '^nation_12$', 'none', 'the tools'), (2, 'tools', 2, 'nation_2?', '^nation_2.$', 'none', 'the tools')),
may(layer, dst) AS (VALUES ('core', 'edge'), ('tools', 'core'), ('tools', 'edge')),
m AS (SELECT DISTINCT p.name, p.directory, l.layer FROM p JOIN l ON regexp_matches(p.name, l.regex)), c AS (SELECT name, count(*) AS n FROM m GROUP BY 1),
a AS (SELECT m.* FROM m JOIN c ON c.name = m.name WHERE c.n = 1), w AS (SELECT name, CASE WHEN directory = '.' THEN 'Cargo.toml' ELSE directory || '/Cargo.toml' END AS path FROM p),
x AS (SELECT DISTINCT layer, external, reason FROM l)"""


@register("dependency_rules", f"""
WITH p AS {facts.table("packages")}, d AS {facts.table("deps")}, {_LAYERS}
SELECT 'DEP-010' AS id, 'dependency.package-layer' AS rule, NULL AS path, 'layer "' || layer || '" package selector "' || pattern || '" matches no Cargo package' AS message FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE regexp_matches(p.name, l.regex))
UNION ALL SELECT 'DEP-003', 'dependency.package-layer', w.path, 'package "' || p.name || '" is not assigned to an architecture layer' FROM p JOIN w ON w.name = p.name WHERE p.name NOT IN (SELECT name FROM m)
UNION ALL SELECT 'DEP-004', 'dependency.package-layer', w.path, 'package "' || c.name || '" matches multiple architecture layers' FROM c JOIN w ON w.name = c.name WHERE c.n > 1
UNION ALL SELECT 'DEP-005', 'dependency.layer-edge', w.path, 'package ' || d.package || ' in layer ' || a.layer || ' may not depend on ' || d.internal_package || ' in layer ' || b.layer
  FROM d JOIN a ON a.name = d.package JOIN a b ON b.name = d.internal_package JOIN w ON w.name = d.package WHERE a.layer <> b.layer AND NOT EXISTS (SELECT 1 FROM may WHERE may.layer = a.layer AND may.dst = b.layer)
UNION ALL SELECT 'DEP-006', 'dependency.external', w.path, 'package ' || d.package || ' in layer ' || a.layer || ' has ' || d.kind || ' external dependency ' || d.alias
  FROM d JOIN a ON a.name = d.package JOIN x ON x.layer = a.layer JOIN w ON w.name = d.package WHERE d.internal_package IS NULL AND x.external = 'none'
""")
def dependency_rules(spark: SparkSession, d: str) -> DataFrame:
    """Layers of packages and edges between them: DEP-003 to -006 and -010."""
    return shown(R.dependency_findings(facts.rows(spark, d, "packages"), facts.rows(spark, d, "deps"), LAYERS, cycles="allow"))


@register("dependency_cycles", f"""
WITH RECURSIVE d AS {facts.table("deps")}, e AS (SELECT DISTINCT package AS src, internal_package AS dst FROM d WHERE internal_package IS NOT NULL),
c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src),
k AS (SELECT a.src AS node, min(least(a.src, a.dst)) AS component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
i AS (SELECT k.component, e.src, e.dst FROM e JOIN k ON k.node = e.src JOIN k j ON j.node = e.dst AND j.component = k.component),
f AS (SELECT component, min(dst) AS node FROM i WHERE src = component AND dst <> component GROUP BY 1),
b(component, node, path) AS (SELECT component, node, [node] FROM f UNION ALL SELECT b.component, i.dst, list_append(b.path, i.dst) FROM b JOIN i ON i.component = b.component AND i.src = b.node WHERE NOT list_contains(b.path, i.dst) AND b.node <> b.component AND len(b.path) < 7),
r AS (SELECT component, arg_min(path, (len(path), path)) AS path FROM b WHERE node = component GROUP BY 1)
SELECT 'DEP-009' AS id, 'dependency.cycles' AS rule, 'workspace dependency cycle: ' || component || ' -> ' || array_to_string(path, ' -> ') AS message FROM r
UNION ALL SELECT 'DEP-009', 'dependency.cycles', 'workspace dependency cycle: ' || component || ' -> ' || component FROM (SELECT DISTINCT component FROM k) WHERE component NOT IN (SELECT component FROM f)
""")
def dependency_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected packages with a witness each (G2): from the least package over its least neighbour inside, by a shortest way back."""
    found = R.dependency_findings(facts.rows(spark, d, "packages"), facts.rows(spark, d, "deps"), [], unassigned="allow")
    return found.select("id", "rule", "message")


DENIED = [
    {"name": "no-ext", "from": "nation_3", "deny": ["ext1", "ext2", "ext3"], "reachability": "direct", "kinds": ["build", "development"], "reason": "r"},
    {"name": "no-such", "from": "nation_99", "deny": ["ext1"], "reason": "r"},
    {"name": "any-kind", "from": "nation_20", "deny": ["ext0", "ext4", "nation_10"], "reason": "r"},
    {"name": "deep", "from": "nation_5", "deny": ["ext1"], "reachability": "transitive", "reason": "r"},
]


@register("denied_dependencies", f"""
WITH p AS {facts.table("packages")}, d AS {facts.table("deps")},
r(name, package, dep, build_only) AS (VALUES ('no-ext', 'nation_3', 'ext1', true), ('no-ext', 'nation_3', 'ext2', true), ('no-ext', 'nation_3', 'ext3', true), ('any-kind', 'nation_20', 'ext0', false), ('any-kind', 'nation_20', 'ext4', false), ('any-kind', 'nation_20', 'nation_10', false))
SELECT 'DEP-008' AS id, r.name AS rule, 'crates/' || d.package || '/Cargo.toml' AS path, 'package ' || d.package || ' has explicitly denied ' || d.kind || ' dependency ' || d.name AS message
FROM r JOIN d ON d.package = r.package AND d.name = r.dep WHERE NOT r.build_only OR d.kind <> 'normal'
UNION ALL SELECT 'DEP-007', 'no-such', NULL, 'dependency rule names missing package "nation_99"'
UNION ALL SELECT 'DEP-011', 'deep', 'crates/nation_5/Cargo.toml', 'transitive dependency policy requires Cargo.lock'
""")
def denied_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Denials read from manifests, a rule about a missing package, and one that can't be decided without a lock."""
    return shown(R.denied_findings(facts.rows(spark, d, "packages"), facts.rows(spark, d, "deps"), DENIED))


# --- Sizes ---


@register("size_rules", f"""
WITH f AS {facts.table("files")}, b(role, target, hard) AS (VALUES ('implementation', 3000, 7000), ('facade', 1000, 2000), ('test', 5000, 9000)),
r AS (SELECT path, 'reviewed' AS reason FROM f WHERE lines > 4000 AND class <> 'test' UNION ALL SELECT 'crates/gone.rs', 'reviewed'), k AS (SELECT path, CAST(file AS bigint) * 5 AS value FROM f WHERE lines > 4500),
j AS (SELECT f.path, f.lines, b.target, b.hard, r.reason, k.value FROM f LEFT JOIN b ON b.role = CASE WHEN f.class <> 'generated' AND f.bits = 2 THEN 'test' ELSE f.class END LEFT JOIN r ON r.path = f.path LEFT JOIN k ON k.path = f.path)
SELECT 'RUST-SIZE-001' AS id, 'rust.file-size.hard' AS rule, path, 'source is ' || lines || ' lines, above its absolute ' || hard || '-line ceiling' AS message FROM j WHERE reason IS NULL AND lines > hard
UNION ALL SELECT 'RUST-SIZE-002', 'rust.file-size.target', path, 'source is ' || lines || ' lines, above its ' || target || '-line design target' FROM j WHERE reason IS NULL AND lines > target
UNION ALL SELECT 'RUST-SIZE-003', 'rust.file-size.ratchet', path, 'reviewed ratchet is absent from the lock file' FROM j WHERE reason IS NOT NULL AND lines > target AND value IS NULL
UNION ALL SELECT 'RUST-SIZE-003', 'rust.file-size.ratchet', path, 'source grew from its ' || value || '-line ratchet to ' || lines || ' lines' FROM j WHERE reason IS NOT NULL AND lines > target AND lines > value
UNION ALL SELECT 'RUST-SIZE-004', 'rust.file-size.ratchet', path, 'source shrank to ' || lines || ' lines but lock still permits ' || value FROM j WHERE reason IS NOT NULL AND lines > target AND lines < value
UNION ALL SELECT 'RUST-SIZE-004', 'rust.file-size.ratchet', path, 'file returned below its design target but retains a stale ratchet' FROM j WHERE lines <= target AND (reason IS NOT NULL OR value IS NOT NULL)
UNION ALL SELECT 'RUST-SIZE-005', 'rust.file-size', path, 'file-size ratchet has no active size policy' FROM j WHERE target IS NULL AND (reason IS NOT NULL OR value IS NOT NULL)
UNION ALL SELECT 'RUST-SIZE-005', 'rust.file-size', 'crates/gone.rs', 'file-size ratchet names missing source "crates/gone.rs"'
""")
def size_rules(spark: SparkSession, d: str) -> DataFrame:
    """All five findings on sizes, over every file."""
    from plumbline.functions.predicates import budget_role

    files = facts.rows(spark, d, "files").withColumn("role", budget_role(F.col("class"), F.col("bits")))
    budgets = spark.createDataFrame([("implementation", 3000, 7000), ("facade", 1000, 2000), ("test", 5000, 9000)], "role string, target long, hard long")
    gone = spark.createDataFrame([("crates/gone.rs", "reviewed")], "path string, reason string")
    ratchets = files.filter("lines > 4000 and class <> 'test'").select("path", F.lit("reviewed").alias("reason")).unionByName(gone)
    locked = files.filter("lines > 4500").select("path", (F.col("file") * 5).cast("long").alias("value"))
    return shown(R.size_findings(files, budgets, ratchets, locked))


# --- Scopes, profiles, owners ---

SCOPES = [
    {"name": "no-fs", "include": ["crates/building/**", "crates/machinery/src/**/*.rs"], "exclude": ["crates/*/src/n1?/**"], "deny": ["std::fs", "::tokio"], "reason": "pure"},
    {"name": "stale", "include": ["crates/nowhere/**", "crates/building/**"], "exclude": [], "deny": ["std"], "reason": "old"},
    {"name": "empty", "include": ["crates/furniture/**"], "exclude": ["crates/**"], "deny": ["std"], "reason": "none"},
    {"name": "odd", "include": ["crates/household/**"], "exclude": ["**/*.c"], "deny": ["std"], "reason": "old"},
]


@register("scope_rules", f"""
WITH f AS {facts.table("facts")},
i AS (SELECT * FROM f WHERE kind IN ('path', 'macro') AND (starts_with(path, 'crates/building/') OR regexp_matches(path, '^crates/machinery/src/.*[.]rs$')) AND NOT regexp_matches(path, '^crates/[^/]*/src/n1[^/]/')),
d(denied) AS (VALUES ('std::fs'), ('tokio'))
SELECT 'CAP-001' AS id, 'no-fs' AS rule, path, 'source reaches denied symbol ' || name AS message, line AS line FROM i JOIN d ON name = denied OR starts_with(name, denied || '::') OR (quality <> 'exact' AND starts_with(denied, name || '::'))
UNION ALL SELECT 'CAP-002', 'stale', NULL, 'scope include "crates/nowhere/**" matches no Rust source', NULL
UNION ALL SELECT 'CAP-002', 'empty', NULL, 'capability scope matches no Rust source after exclusions', NULL
UNION ALL SELECT 'CAP-003', 'odd', NULL, 'scope exclusion "**/*.c" matches no Rust source', NULL
""")
def scope_rules(spark: SparkSession, d: str) -> DataFrame:
    """Denied symbols in scopes, stale scopes and empty ones."""
    found = C.scope_findings(facts.rows(spark, d, "files"), facts.rows(spark, d, "facts"), SCOPES)
    return shown(found.withColumn("line", F.col("span.line")), "line")


FILE_PACKAGES = [("building", "crates/building"), ("machinery", "crates/machinery"), ("household", "crates/household"), ("inner", "crates/household/src/n7"), ("root", ".")]
PROFILE_LAYERS = [{"name": "a", "packages": ["building", "inner"], "profiles": ["pure"]}, {"name": "b", "packages": ["m*", "building"], "profiles": ["quiet", "pure"]}, {"name": "c", "packages": ["root"], "profiles": ["quiet"]}]
PROFILES = [{"name": "pure", "reachability": "production", "effects": ["Process", "Filesystem", "WallClock"]}, {"name": "quiet", "reachability": "all", "effects": ["Network", "Randomness"]}]
_PROFILES = f"""f AS {facts.table("files")}, t AS (SELECT path, package, CASE WHEN package IN ('building', 'machinery') THEN package WHEN starts_with(path, 'crates/household/src/n7/') THEN 'inner' WHEN package = 'household' THEN 'household' ELSE 'root' END AS owner FROM f),
g(owner, profile) AS (VALUES ('building', 'pure'), ('building', 'quiet'), ('inner', 'pure'), ('machinery', 'quiet'), ('machinery', 'pure'), ('root', 'quiet')), a AS (SELECT t.path, g.profile FROM t JOIN g ON g.owner = t.owner)"""


def _profiled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Files of which only some name their package; the others go by the longest directory."""
    files = facts.rows(spark, d, "files").withColumn("packages", F.when(F.col("package").isin("building", "machinery"), F.array("package")).otherwise(F.array().cast("array<string>")))
    return files, spark.createDataFrame(FILE_PACKAGES, "name string, directory string")


@register("file_profiles", f"WITH {_PROFILES} SELECT * FROM a")
def file_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of files through packages and layers."""
    files, packages = _profiled(spark, d)
    return C.assigned_profiles(files, packages, PROFILE_LAYERS)


@register("effect_rules", f"""
WITH {_PROFILES}, x AS {facts.table("facts")},
e(profile, scope, effect, token_at, token) AS (VALUES ('pure', 'production', 'Process', 0, 'std::process'), ('pure', 'production', 'Process', 1, 'tokio::process'), ('pure', 'production', 'Filesystem', 0, 'std::fs'),
  ('pure', 'production', 'WallClock', 0, 'std::time::Instant'), ('pure', 'production', 'WallClock', 1, 'std::time::SystemTime'), ('quiet', 'all', 'Network', 0, 'std::net'), ('quiet', 'all', 'Network', 1, 'std::os::unix::net'), ('quiet', 'all', 'Randomness', 0, 'rand'), ('quiet', 'all', 'Randomness', 1, 'getrandom')),
h AS (SELECT x.path, x.line, x.col, a.profile, e.effect, x.name, e.token_at, x.ordinal, x.quality FROM x JOIN a ON a.path = x.path JOIN e ON e.profile = a.profile
  WHERE x.kind = 'path' AND (x.name = token OR starts_with(x.name, token || '::') OR (x.quality <> 'exact' AND starts_with(token, x.name || '::'))) AND (e.scope = 'all' OR (x.bits IN (1, 3) AND coalesce(x.guard, true))))
SELECT 'EFFECT-001' AS id, 'profile.' || profile AS rule, path, 'profile "' || profile || '" denies ' || effect || ', provided here by ' || arg_min(name, (token_at, ordinal, name, quality)) AS message, line FROM h GROUP BY path, line, col, profile, effect
""")
def effect_rules(spark: SparkSession, d: str) -> DataFrame:
    """Effects that a profile denies, once for each place."""
    files, packages = _profiled(spark, d)
    found = C.effect_findings(files, facts.rows(spark, d, "facts"), packages, PROFILE_LAYERS, PROFILES)
    return shown(found.withColumn("line", F.col("span.line")), "line")


OWNERS = [
    {"name": "net", "kind": "Capability", "within": ["crates/building/**", "crates/none/**"], "selector": "std::net", "allow": ["crates/building/src/n2/c1.rs", "crates/gone.rs"], "reason": "r"},
    {"name": "spawn", "kind": "Call", "reachability": "production", "within": ["crates/**"], "selector": "std::process", "allow": [f"crates/machinery/src/n19/c{i}.rs" for i in range(0, 400)], "reason": "r"},
    {"name": "store", "kind": "FieldMutation", "within": ["crates/household/**"], "selector": "store::f1", "mutating_methods": ["push"], "allow": ["crates/household/src/n2/c0.rs"], "reason": "r"},
    {"name": "method", "kind": "MethodName", "within": ["crates/furniture/**"], "selector": "serde::f2", "allow": [], "reason": "r"},
]
_ALLOWED = "', '".join(OWNERS[1]["allow"])


@register("owner_rules", f"""
WITH files AS {facts.table("files")}, x AS {facts.table("facts")}, op AS {facts.table("operations")},
cap AS (SELECT * FROM x WHERE kind = 'path' AND starts_with(path, 'crates/building/') AND (name = 'std::net' OR starts_with(name, 'std::net::') OR (quality <> 'exact' AND starts_with('std::net', name || '::')))),
hit AS (SELECT * FROM x WHERE kind IN ('path', 'call') AND bits IN (1, 3) AND coalesce(guard, true) AND (name = 'std::process' OR starts_with(name, 'std::process::') OR (quality <> 'exact' AND starts_with('std::process', name || '::')))),
calls AS (SELECT * FROM hit WHERE kind = 'call'), refs AS (SELECT h.* FROM hit h WHERE h.kind = 'path' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.path = h.path AND c.line = h.line AND c.col = h.col AND c.name = h.name)),
own(path) AS (SELECT unnest(['{_ALLOWED}'])),
inside AS (SELECT o.path, EXISTS (SELECT 1 FROM refs WHERE refs.path = o.path) AS referenced, EXISTS (SELECT 1 FROM calls WHERE calls.path = o.path AND quality <> 'exact') AS doubtful, EXISTS (SELECT 1 FROM calls WHERE calls.path = o.path) AS called FROM own o),
mut AS (SELECT * FROM op WHERE starts_with(path, 'crates/household/') AND (kind IN ('FieldWrite', 'FieldMutableBorrow') OR (kind = 'FieldReceiverCall' AND method = 'push'))
  AND (replace(name, 'crate::', '') = 'store::f1' OR (quality <> 'exact' AND (starts_with('store::f1', replace(name, 'crate::', '') || '::') OR regexp_extract(name, '[^:]*$') = 'f1')))),
met AS (SELECT * FROM op WHERE starts_with(path, 'crates/furniture/') AND kind = 'MethodCall' AND name = 'serde::f2')
SELECT 'OWN-004' AS id, 'net' AS rule, NULL AS path, 'owner scope "crates/none/**" matches no Rust source' AS message
UNION ALL SELECT 'OWN-002', 'net', a, 'owner policy names missing Rust source "' || a || '"' FROM (VALUES ('crates/building/src/n2/c1.rs'), ('crates/gone.rs')) t(a) WHERE a NOT IN (SELECT path FROM files)
UNION ALL SELECT 'OWN-003', 'net', path, 'source reaches owned capability ' || name || '; allowed owner: crates/building/src/n2/c1.rs, crates/gone.rs' FROM cap WHERE path <> 'crates/building/src/n2/c1.rs'
UNION ALL SELECT 'OWN-004', 'net', path, 'allowed owner "' || path || '" reaches no use of std::net' FROM files WHERE path IN ('crates/building/src/n2/c1.rs', 'crates/gone.rs') AND path NOT IN (SELECT path FROM cap)
UNION ALL SELECT 'OWN-002', 'spawn', path, 'owner policy names missing Rust source "' || path || '"' FROM own WHERE path NOT IN (SELECT path FROM files)
UNION ALL SELECT 'OWN-003', 'spawn', path, 'source reaches owned call authority ' || name || '; allowed owner: ' || array_to_string(['{_ALLOWED}'], ', ') FROM
  (SELECT path, name FROM calls UNION ALL SELECT path, name FROM hit WHERE kind = 'path' AND path NOT IN (SELECT path FROM calls)) WHERE path NOT IN (SELECT path FROM own)
UNION ALL SELECT 'OWN-005', 'spawn', path, 'owned call std::process ' || CASE WHEN referenced THEN 'is referenced outside a direct invocation' ELSE 'cannot be resolved to an exact direct invocation' END FROM inside WHERE referenced OR doubtful
UNION ALL SELECT 'OWN-004', 'spawn', path, 'allowed owner "' || path || '" has no production-reachable use of std::process' FROM inside WHERE NOT referenced AND NOT called AND path IN (SELECT path FROM files)
UNION ALL SELECT 'OWN-003', 'store', path, 'source reaches owned field-mutation authority ' || name || '; allowed owner: crates/household/src/n2/c0.rs' FROM mut WHERE path <> 'crates/household/src/n2/c0.rs'
UNION ALL SELECT DISTINCT 'OWN-006', 'store', path, 'owned field mutation store::f1 cannot be resolved to one exact Rust identity' FROM mut WHERE path = 'crates/household/src/n2/c0.rs' AND quality <> 'exact'
UNION ALL SELECT 'OWN-002', 'store', 'crates/household/src/n2/c0.rs', 'owner policy names missing Rust source "crates/household/src/n2/c0.rs"' WHERE 'crates/household/src/n2/c0.rs' NOT IN (SELECT path FROM files)
UNION ALL SELECT 'OWN-004', 'store', path, 'allowed owner "' || path || '" reaches no field mutation of store::f1' FROM files WHERE path = 'crates/household/src/n2/c0.rs' AND path NOT IN (SELECT path FROM mut)
UNION ALL SELECT 'OWN-003', 'method', path, 'source reaches owned written method-name authority ' || name || '; allowed owner: ' FROM met
""")
def owner_rules(spark: SparkSession, d: str) -> DataFrame:
    """Owners of a capability, a call, a field and a method name over all facts."""
    none = spark.createDataFrame([], "path string, ordinal long, name string, span struct<line:bigint,column:bigint,end_line:bigint,end_column:bigint>, guard boolean, closed array<string>")
    return shown(C.owner_findings(facts.rows(spark, d, "files"), facts.rows(spark, d, "facts"), facts.rows(spark, d, "operations"), none, OWNERS))
