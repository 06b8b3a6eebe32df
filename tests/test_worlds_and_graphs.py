import json

from pyspark.sql import functions as F

from plumbline.operators import diff as D, explain as X, findings, report as O, source_graph as G, worlds as W

SPAN = "span struct<line:bigint,column:bigint,end_line:bigint,end_column:bigint>"
DEPS = "package string, ordinal long, alias string, kind string, target string, optional boolean, default_features boolean, features array<string>, internal_package string"


def cargo(spark):
    declared = spark.createDataFrame([("app", "default"), ("app", "fast"), ("lib", "default"), ("lib", "simd"), ("lib", "log"), ("mac", "x")], "package string, feature string")
    activations = spark.createDataFrame([("app", "default", "fast"), ("app", "fast", "l/simd"), ("app", "fast", "dep:opt"), ("lib", "default", "log")], "package string, feature string, entry string")
    implicit = spark.createDataFrame([], "package string, alias string")
    deps = spark.createDataFrame([("app", 0, "l", "normal", None, False, False, [], "lib"), ("app", 1, "opt", "normal", None, True, True, [], "lib"), ("lib", 0, "m", "build", None, False, False, ["x"], "mac")], DEPS)
    return declared, activations, implicit, deps


def test_feature_worlds(spark):
    declared, activations, implicit, deps = cargo(spark)
    selections = spark.createDataFrame([("full", "app", True, []), ("full", "lib", False, []), ("full", "mac", False, []), ("bare", "app", False, []), ("bare", "lib", False, ["log"]), ("bare", "mac", False, [])], "world string, package string, default_features boolean, features array<string>")
    resolved, requested = W.world_features(selections, declared, activations, implicit, deps)
    active = {}
    for r in resolved.filter("kind = 'active'").collect():
        active.setdefault((r.world, r.package), set()).add(r.name)
    assert active == {("full", "app"): {"default", "fast"}, ("full", "lib"): {"default", "simd", "log"}, ("full", "mac"): {"x"}, ("bare", "lib"): {"log"}, ("bare", "mac"): {"x"}}
    assert {(r.world, r.package, r.feature) for r in requested.collect()} == {("full", "lib", "default"), ("full", "lib", "simd"), ("full", "mac", "x"), ("bare", "lib", "log"), ("bare", "mac", "x")}
    packages = spark.createDataFrame([("app", False), ("lib", False), ("mac", True)], "name string, proc_macro boolean")
    assert sorted(map(tuple, W.split_packages(packages, deps).collect())) == [("mac", "proc-macro", None, 0)]
    problems = {tuple(r) for r in W.inexact_worlds(selections, declared, activations, implicit, packages, deps).collect()}
    assert problems == {("full", "mac", "x", "differs"), ("bare", "mac", "x", "differs"), ("full", "mac", "x", "split"), ("bare", "mac", "x", "split")}
    assert W.inexact_worlds(selections, declared, activations, implicit, packages, deps.filter("package = 'app'")).collect() == []


def test_split_contexts_spread(spark):
    packages = spark.createDataFrame([(x, x == "host") for x in ("host", "a", "b", "c", "d")], "name string, proc_macro boolean")
    edge = lambda p, i, q, kind="normal", target=None: (p, i, q, kind, target, False, False, [], q)
    deps = spark.createDataFrame([edge("host", 0, "a"), edge("a", 0, "b"), edge("d", 0, "c", "normal", "cfg(unix)"), edge("d", 1, "host")], DEPS)
    split = W.split_packages(packages, deps)
    assert sorted(map(tuple, split.collect())) == [("a", "transitive", "host", 1), ("b", "transitive", "a", 2), ("c", "direct", "d", 0), ("host", "proc-macro", None, 0)]
    assert [(r.package, r.ordinal, r.split) for r in W.split_edges(deps, split).orderBy("package", "ordinal").collect()] == [("a", 0, True), ("d", 0, True), ("d", 1, False), ("host", 0, True)]


def test_active_facts(spark):
    facts = spark.createDataFrame([("a", None, 1), ("a", "on", 2), ("a", "off", 3), ("a", "unknown", 4), ("a", "some", 5), ("b", None, 6)], "path string, guard string, n int")
    domains = spark.createDataFrame([("a", "x"), ("a", "y")], "path string, domain string")
    values = spark.createDataFrame([("on", "x", True), ("on", "y", True), ("off", "x", False), ("off", "y", False), ("unknown", "x", None), ("unknown", "y", False), ("some", "x", False), ("some", "y", True)], "guard string, domain string, value boolean")
    assert {r.n for r in W.active_facts(facts, domains, values, True).collect()} == {1, 2, 4, 5}
    assert W.active_facts(facts, domains, values, False).count() == 6


def test_source_graph(spark):
    at = (1, 1, 1, 9)
    targets = spark.createDataFrame([("p", "p", "p", "lib", "src/lib.rs", []), ("p", "p", "t", "test", "tests/t.rs", ["x"]), ("q", ".", "q", "bin", "src/main.rs", [])], "package string, directory string, name string, kind string, path string, required_features array<string>")
    row = lambda p, n, at_=None, inline=(), guard=None: (p, 0, n, at_, list(inline), guard, at)
    modules = spark.createDataFrame([row("p/src/lib.rs", "a"), row("p/src/lib.rs", "b"), row("p/src/a.rs", "deep"), row("p/src/a.rs", "x", None, ["inner"]), row("p/src/lib.rs", "only", None, (), "test"), row("p/src/lib.rs", "odd", "../other/odd.rs"), row("p/src/lib.rs", "two"), row("p/src/lib.rs", "lost"), row("p/src/lib.rs", "link"), row("p/src/lib.rs", "never", None, (), "no"), row("src/main.rs", "out", "../out.rs")], f"path string, ordinal long, name string, at string, inline array<string>, guard string, {SPAN}")
    includes = spark.createDataFrame([("p/src/b/mod.rs", 0, "part.rs", "literal include \"part.rs\"", None, at)], f"path string, ordinal long, target string, label string, guard string, {SPAN}")
    names = ["p/src/lib.rs", "p/src/a.rs", "p/src/a/deep.rs", "p/src/a/inner/x.rs", "p/src/b/mod.rs", "p/src/b/part.rs", "p/src/only.rs", "p/other/odd.rs", "p/src/two.rs", "p/src/two/mod.rs", "src/main.rs", "p/src/orphan.rs", "p/src/never.rs", "p/tests/t.rs"]
    entries = spark.createDataFrame([(x, "file") for x in names] + [("p/src/link.rs", "symlink")], "path string, kind string")
    worlds = spark.createDataFrame([("w", "p", ["y"]), ("w", "q", [])], "world string, package string, active array<string>")
    domains = [f"p|p|{m}|w" for m in ("library", "library-test")]
    guards = spark.createDataFrame([("test", domains[0], False), ("test", domains[1], True), ("no", domains[0], False), ("no", domains[1], False)], "guard string, domain string, value boolean")
    test_only = spark.createDataFrame([("test",)], "guard string")
    roots = ["p", "src"]
    files, states, _ = G.reach(targets, worlds, modules, includes, entries, guards, test_only, roots, ["p/gen/**"])
    got = {r.path: (r.bits, r.packages, len(r.domains)) for r in files.collect()}
    both = (1, ["p"], 2)
    assert got == {"p/src/lib.rs": both, "p/src/a.rs": both, "p/src/a/deep.rs": both, "p/src/a/inner/x.rs": both, "p/src/b/mod.rs": both, "p/src/b/part.rs": both, "p/src/only.rs": (2, ["p"], 1), "p/other/odd.rs": both, "src/main.rs": (1, ["q"], 2)}
    found = G.graph_findings(targets, worlds, modules, includes, entries, guards, test_only, entries.filter("kind = 'file'").select("path"), roots, ["p/gen/**"])
    assert sorted((r.id, r.path, r.message) for r in found.collect()) == [
        ("RUST-GRAPH-001", "p/src/lib.rs", 'module "lost" has no source file at either Rust module path'), ("RUST-GRAPH-001", "p/src/lib.rs", 'module "two" is ambiguous because both Rust module paths exist'),
        ("RUST-GRAPH-002", "p/src/lib.rs", 'module "link" resolves to a symlink or non-file boundary: p/src/link.rs'), ("RUST-GRAPH-002", "src/main.rs", 'module "out" resolves outside the indexed Rust roots: out.rs'),
        *[("RUST-GRAPH-004", x, "Rust source is unreachable from every Cargo target") for x in ("p/src/never.rs", "p/src/orphan.rs", "p/src/two.rs", "p/src/two/mod.rs", "p/tests/t.rs")],
    ]
    assert G.seeds(targets, None).count() == 5


def test_reports(spark):
    rows = spark.createDataFrame([("b.rs", 2, "B-1"), ("a.rs", 9, "A-1"), (None, 0, "A-1")], "path string, line long, id string")
    found = findings.union([findings.finding(rows, F.col("id"), "rule", "c", findings.said("it's ", F.col("line")), F.col("path"), F.when(F.col("path").isNotNull(), F.struct(F.col("line"), F.lit(1).cast("long").alias("column"), F.col("line").alias("end_line"), F.lit(4).cast("long").alias("end_column"))), emit=("line",))])
    whole = O.report(found, {"complete": True, "rust_files": 1234}, 2)
    assert [f.get("path") for f in whole["findings"]] == [None, "b.rs"] and whole["summary"] == {"errors": 3, "warnings": 0, "notes": 0, "retained": 2, "omitted": 1} and whole["truncated"] and whole["status"] == "fail"
    assert [(g["id"], g["count"]) for g in whole["groups"]] == [("A-1", 2), ("B-1", 1)]
    text = O.report_text(whole)
    assert text.startswith("error[A-1]: it's 0\n   = rule: rule\n") and "  --> b.rs:2:1\n" in text and "1,234 Rust files" in text and text.endswith("Status: fail (3 errors, 0 warnings, 0 notes)\n")
    assert json.loads(O.report_json(whole)) == whole and O.report(found.limit(0), {"complete": True})["status"] == "pass" and O.report(found.limit(0), {})["status"] == "invalid"
    ten = spark.range(12)
    many = findings.union([findings.finding(ten, "X", "r", "c", findings.said(F.col("id")), emit=(-F.col("id"),)), findings.finding(ten, "Y", "r", "c", findings.said(F.col("id")), emit=("id",))])
    assert [f["message"] for f in sorted(O.report(many, {"complete": True}, 14)["findings"], key=lambda f: (f["id"], int(f["message"]))) if f["id"] == "Y"] == ["0", "1"]
    assert [f["message"] for f in O.report(many.filter("id = 'Y'"), {"complete": True}, 11)["findings"]] == sorted(map(str, range(11)))
    changes = D.compare(spark, {}, None, {"repository": {"exclude": ["x"]}}, None)
    assert O.changes_text(changes) == "GRANT repository.exclude repository:x\n  contract now excludes repository source\n\nChanges: 1 grants, 0 revokes, 0 debt, 0 cleanup, 0 neutral, 0 unknown\n"
    assert json.loads(O.changes_json(changes))["summary"]["grants"] == 1


def test_explain_and_coverage(spark):
    packages = spark.createDataFrame([("core", "crates/core")], "name string, directory string")
    contract = {"layers": [{"name": "l", "packages": ["core"], "profiles": ["pure"]}], "scopes": [{"name": "s", "include": ["crates/**"], "deny": ["std::fs"]}], "owners": [{"name": "o", "kind": "Call", "within": ["crates/core/**"], "selector": "a::b", "allow": ["crates/core/src/x.rs"]}], "ratchets": [{"rule": "r", "target": "crates/core/src/x.rs"}], "generated": [{"root": "gen"}], "profiles": {"pure": {}}}
    got = [tuple(r) for r in X.explain(spark, "crates/core/src/x.rs", packages, contract).collect()]
    assert got == [("owner", "o", "Call a::b (allowed)"), ("profile", "pure", ""), ("ratchet", "r", ""), ("scope", "s", "std::fs")]
    assert X.enabled_rails(contract) == ["layer:l", "owner:o", "profile:pure", "scope:s"]
    sets = spark.createDataFrame([("g", "b", b"2"), ("g", "a", b"1"), ("h", "b", b"2")], "gate string, path string, content binary")
    a, b = (X.file_set_digest(x, "gate").orderBy("gate").collect() for x in (sets, sets.orderBy(F.desc("path"))))
    assert a == b and [r.n for r in a] == [2, 1] and a[0].sha256 != a[1].sha256
    facts = spark.createDataFrame([("x", "unresolved", []), ("x", "conservative", ["a", "b"]), ("y", "exact", ["a", "b"])], "path string, quality string, canonical array<string>")
    assert X.unresolved_counts(facts).first().asDict() == {"unresolved": 1, "ambiguous": 1}
    assert {r.path: r.n for r in X.fact_counts([facts, facts.filter("path = 'y'")]).collect()} == {"x": 2, "y": 2}
    assert X.census(packages, packages, facts, [facts], facts.withColumn("domain", F.lit("d"))).first().asDict() == {"packages": 1, "targets": 1, "rust_files": 2, "physical_facts": 3, "base_source_instances": 2}
