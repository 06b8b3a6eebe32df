import json

from pyspark.sql import functions as F

from plumbline.operators import capability as C, findings, rules

PACKAGES = [("fixture-core", "crates/fixture-core"), ("fixture-manager", "crates/fixture-manager"), ("loose", "."), ("both", "b")]
DEPS = "package string, ordinal long, alias string, name string, kind string, internal_package string"
SPAN = "span struct<line:bigint,column:bigint,end_line:bigint,end_column:bigint>"


def ids(df):
    return sorted(((r.id, r.path or "") for r in df.collect()))


def test_dependency_rules(spark):
    packages = spark.createDataFrame(PACKAGES, "name string, directory string")
    layers = [{"name": "core", "packages": ["fixture-core", "both"], "may_depend_on": [], "external": "none"}, {"name": "manager", "packages": ["fixture-man*", "both"], "may_depend_on": ["core"]}, {"name": "empty", "packages": ["nothing-*", "x" * 5000]}]
    deps = spark.createDataFrame([("fixture-core", 0, "m", "fixture-manager", "normal", "fixture-manager"), ("fixture-manager", 0, "c", "fixture-core", "build", "fixture-core"), ("fixture-core", 1, "s", "serde", "normal", None), ("loose", 0, "c", "fixture-core", "normal", "fixture-core")], DEPS)
    members = spark.createDataFrame([("a",), ("b",)], "member string"), spark.createDataFrame([("b",), ("c",)], "member string")
    found = rules.dependency_findings(packages, deps, layers, members=members)
    core = "crates/fixture-core/Cargo.toml"
    assert ids(found) == sorted([("DEP-001", "c/Cargo.toml"), ("DEP-002", ""), ("DEP-005", core), ("DEP-003", "Cargo.toml"), ("DEP-004", "b/Cargo.toml"), ("DEP-006", core), ("DEP-009", ""), ("DEP-010", ""), ("DEP-010", "")])
    told = {r.id: (r.rule, r.message) for r in found.collect()}
    assert told["DEP-006"] == ("dependency.external", "package fixture-core in layer core has normal external dependency s")
    assert told["DEP-009"][1] == "workspace dependency cycle: fixture-core -> fixture-manager -> fixture-core"
    assert told["DEP-002"][1] == 'workspace.members names missing package directory "a"'
    assert "DEP-003" not in {r.id for r in rules.dependency_findings(packages, deps, layers, "allow").collect()}


def test_denied_paths_over_the_lock(spark):
    """Shortest paths from the root, by the first edge's kind; a dependency that resolves to no node or to several can't be decided."""
    packages = spark.createDataFrame([("app", "."), ("blurred", "b")], "name string, directory string")
    deps = spark.createDataFrame([("app", 0, "x", "x", "normal", None), ("app", 1, "y", "y", "build", None), ("blurred", 0, "z", "z", "normal", None)], DEPS)
    nodes = spark.createDataFrame([(n, n, "1.0", "registry+r", None) for n in ("app", "x", "y", "bad", "worse")], "node string, name string, version string, source string, checksum string")
    edges = spark.createDataFrame([("app", "x"), ("app", "y"), ("x", "worse"), ("y", "bad"), ("worse", "bad"), ("bad", "app")], "src string, dst string")
    roots = spark.createDataFrame([("app", "app"), ("blurred", "app")], "package string, node string")
    mapping = spark.createDataFrame([("app", 0, 1, "x"), ("app", 1, 1, "y"), ("blurred", 0, 2, None)], "package string, ordinal long, matches long, node string")
    lock = {"nodes": nodes, "edges": edges, "roots": roots, "mapping": mapping}
    policy = [
        {"name": "deep", "from": "app", "deny": ["bad", "app"], "reachability": "transitive"}, {"name": "normal", "from": "app", "deny": ["bad"], "reachability": "transitive", "kinds": ["normal"]},
        {"name": "direct", "from": "app", "deny": ["bad", "y"]}, {"name": "lost", "from": "none", "deny": []}, {"name": "blur", "from": "blurred", "deny": ["bad"], "reachability": "transitive"},
    ]
    label = lambda n: f"{n} 1.0 (registry+r; checksum=none)"
    got = {(r.id, r.rule): r.message for r in rules.denied_findings(packages, deps, policy, lock).collect()}
    assert got == {
        ("DEP-008", "deep"): "package app has denied resolved build dependency path: " + " -> ".join(map(label, ("app", "y", "bad"))),
        ("DEP-008", "normal"): "package app has denied resolved normal dependency path: " + " -> ".join(map(label, ("app", "x", "worse", "bad"))),
        ("DEP-008", "direct"): "package app has denied resolved build dependency path: " + " -> ".join(map(label, ("app", "y"))),
        ("DEP-007", "lost"): 'dependency rule names missing package "none"',
        ("DEP-011", "blur"): 'manifest dependency "z" from package "blurred" maps ambiguously to 2 Cargo.lock nodes',
    }
    assert {r.id for r in rules.denied_findings(packages, deps, policy[:1]).collect()} == {"DEP-011"}


def test_sizes_and_report(spark):
    files = spark.createDataFrame([("a", "implementation", 10), ("b", "implementation", 100), ("c", "implementation", 100), ("d", "other", 999), ("e", "implementation", 40), ("f", "implementation", 50), ("g", "implementation", 5)], "path string, role string, lines long")
    budgets = spark.createDataFrame([("implementation", 30, 60)], "role string, target long, hard long")
    ratchets = spark.createDataFrame([("c", "r"), ("d", "r"), ("e", "r"), ("f", "r"), ("gone", "r")], "path string, reason string")
    locked = spark.createDataFrame([("e", 41), ("f", 49), ("g", 9)], "path string, value long")
    found = rules.size_findings(files, budgets, ratchets, locked)
    assert ids(found) == [("RUST-SIZE-001", "b"), ("RUST-SIZE-002", "b"), ("RUST-SIZE-003", "c"), ("RUST-SIZE-003", "f"), ("RUST-SIZE-004", "e"), ("RUST-SIZE-004", "g"), ("RUST-SIZE-005", "d"), ("RUST-SIZE-005", "gone")]
    lines = [json.loads(r.value) for r in rules.report_lines(found).collect()]
    assert len(lines) == 8 and all(list(x) == [*findings.FINDING, "fingerprint"] and len(x["fingerprint"]) == 64 for x in lines)


def test_owners_by_hand(spark):
    """References and doubtful calls inside, calls before paths outside, opaque expansions, and unnamed fields."""
    files = spark.createDataFrame([("in.rs", [], 1), ("in2.rs", [], 1), ("out.rs", [], 1), ("out2.rs", [], 2)], "path string, packages array<string>, bits int")
    at = lambda n: (n, 1, n, 9)
    facts = spark.createDataFrame([
        ("in.rs", "call", 1, "std::fs::read", [], at(1), "exact", None), ("in.rs", "path", 2, "std::fs::read", [], at(1), "exact", None), ("in.rs", "path", 3, "std::fs::read", [], at(2), "exact", None),
        ("in2.rs", "call", 1, "std::fs", [], at(1), "unresolved", True), ("out.rs", "call", 1, "x", ["::std::fs::r#write"], at(4), "exact", None), ("out.rs", "path", 2, "std::fs::open", [], at(5), "exact", None), ("out2.rs", "path", 1, "std::fs::open", [], None, "exact", False),
    ], f"path string, kind string, ordinal long, name string, canonical array<string>, {SPAN}, quality string, guard boolean")
    operations = spark.createDataFrame([("in.rs", "FieldRead", 1, "Order::*", [], at(1), "unresolved", None, None), ("out.rs", "FieldReceiverCall", 1, "store::Order::total", [], at(1), "exact", None, "push"), ("out.rs", "FieldRead", 2, "store::Order::total", [], at(2), "exact", None, None)], f"path string, kind string, ordinal long, name string, canonical array<string>, {SPAN}, quality string, guard boolean, method string")
    expansions = spark.createDataFrame([("in2.rs", 1, "gen", at(1), None, []), ("out.rs", 2, "gen2", at(7), None, ["FieldRead"])], f"path string, ordinal long, name string, {SPAN}, guard boolean, closed array<string>")
    owners = [
        {"name": "fs", "kind": "Call", "reachability": "all", "within": ["*.rs"], "selector": "std::fs", "allow": ["in.rs", "in2.rs"]},
        {"name": "prod", "kind": "Call", "reachability": "production", "within": ["out*.rs"], "selector": "std::fs", "allow": []},
        {"name": "read", "kind": "FieldRead", "within": ["*.rs"], "selector": "store::Order::total", "allow": ["in.rs", "in2.rs"]},
        {"name": "dir", "kind": "Directory", "within": ["none"], "selector": "x", "allow": []},
    ]
    got = {(r.id, r.rule, r.path, r.span.line if r.span else None) for r in C.owner_findings(files, facts, operations, expansions, owners).collect()}
    assert got == {
        ("OWN-005", "fs", "in.rs", 2), ("OWN-005", "fs", "in2.rs", 1), ("OWN-003", "fs", "out.rs", 4), ("OWN-003", "fs", "out2.rs", None), ("OWN-003", "prod", "out.rs", 4),
        ("OWN-006", "read", "in.rs", 1), ("OWN-006", "read", "in2.rs", 1), ("OWN-003", "read", "out.rs", 2),
    }


def test_owner_rules_read_facts_once_and_take_few_along(spark, sf_dir, monkeypatch):
    """The result comes from stored evidence, an owner's words meet it after every exchange, and selectors filter facts before they are joined, or only travel."""
    from plumbline.plans import policy_queries

    found = policy_queries.owner_rules(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "o_custkey" not in plan
    rows = sorted(map(tuple, found.select("id", "rule", "message").collect()))
    facts = policy_queries.facts.rows(spark, sf_dir, "facts")
    kept = C._selected(C._with_names(facts), [C.path_matches(F.lit("std::net"), F.col("names"), F.col("quality"))])
    above, below = kept._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
    assert "std::net::" not in above and "std::net::" in below
    monkeypatch.setattr(C, "MAX_FILTERS", 0)
    assert sorted(map(tuple, policy_queries.owner_rules(spark, sf_dir).select("id", "rule", "message").collect())) == rows
