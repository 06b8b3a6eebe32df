from plumbline.operators import lock_drift as L

LOCK = {"schema": 1, "semantics": 2, "contract_sha256": "c", "packages": [{"name": "p", "dependencies": ["q"]}], "ratchets": [{"rule": "r", "target": "t", "value": 3}], "gates": [{"name": "g", "path": "p", "sha256": "1", "inputs": [{"path": "i", "sha256": "2"}]}], "macro_sources": [{"allowance": "m", "package": "a", "version": "1", "source": "s"}]}


def test_drift(spark):
    now = {**LOCK, "packages": [{"name": "p"}, {"name": "q"}], "ratchets": [{"rule": "r", "target": "t", "value": 4}], "gates": [{"name": "g", "path": "p", "sha256": "1", "inputs": [{"path": "i", "sha256": "9"}]}], "macro_sources": [{"allowance": "m", "package": "a", "version": "2", "source": "s"}]}
    contract = {"dependencies": {"mode": "locked"}}
    run = lambda *a: sorted((r.id, r.message) for r in L.lock_findings(spark, *a, 1, 2).collect())
    assert run(contract, "c", LOCK, now) == [
        ("LOCK-003", 'workspace package "q" is not reviewed in the lock'), ("LOCK-006", "the lock retains stale dependency edge p->q"), ("LOCK-010", 'ratchet "r:t" records 3 but repository resolves to 4'),
        ("LOCK-026", 'qualification gate input "g:i" changed after review'), ("LOCK-038", 'macro allowance "m" resolved package changed from a 1 (s) to a 2 (s)'),
    ]
    assert run(contract, "c", LOCK, LOCK) == [] == run({}, "c", None, now)
    assert [x for x, _ in run(contract, "other", {**LOCK, "schema": 9, "semantics": 3}, LOCK)] == ["LOCK-002", "LOCK-008", "LOCK-020"] and [x for x, _ in run({"ratchets": [1]}, "c", None, now)] == ["LOCK-001"]


def test_generated_sources(spark):
    good, other = "a" * 64, "b" * 64
    generated = [{"root": "gen", "manifest": "gen/m.toml", "auxiliary": ["aux.rs"], "inputs": ["in/*"], "reason": "r"}, {"root": "lost", "manifest": "lost/m.toml", "auxiliary": [], "inputs": [], "reason": "r"}, {"root": "odd", "manifest": "odd/m.toml", "auxiliary": [], "inputs": [], "reason": "r"}]
    manifests = spark.createDataFrame([("gen", 1, "tool"), ("odd", 2, " ")], "root string, schema long, generator string")
    sha = "root string, path string, sha256 string"
    listed = spark.createDataFrame([("gen", "gen/a.rs", good), ("gen", "gen/b.rs", other), ("gen", "gen/c.rs", "x"), ("gen", "gen/gone.rs", good), ("gen", "gen/a.rs", good)], sha)
    inputs = spark.createDataFrame([("gen", "in/1", good), ("gen", "in/2", other), ("gen", "out/3", good)], sha)
    entries = spark.createDataFrame([(x, "file") for x in ("gen/a.rs", "gen/b.rs", "gen/c.rs", "gen/extra.rs", "gen/m.toml", "in/1", "in/2", "in/4", "out/3")], "path string, kind string")
    contents = spark.createDataFrame([(x, good, x != "gen/b.rs") for x in ("gen/a.rs", "gen/b.rs", "gen/c.rs", "in/1", "in/2", "out/3")], "path string, sha256 string, banner boolean")
    selected = spark.createDataFrame([("gen", "in/*", "in/1"), ("gen", "in/*", "in/2"), ("gen", "in/*", "in/4"), ("gen", "gen/*", "gen/a.rs"), ("gen", "no/*", None)], "root string, pattern string, path string")
    got = sorted((r.id, r.path) for r in L.generated_findings(generated, manifests, listed, inputs, entries, contents, selected).collect())
    assert got == sorted([
        ("GEN-001", "lost/m.toml"), *[("GEN-001", "odd/m.toml")] * 4, *[("GEN-001", "gen/m.toml")] * 3, ("GEN-002", "gen/b.rs"), ("GEN-002", "gen/b.rs"), ("GEN-003", "gen/extra.rs"), ("GEN-003", "gen/gone.rs"),
        ("GEN-004", "in/2"), ("GEN-005", "gen/a.rs"), ("GEN-005", "gen/m.toml"), ("GEN-005", "in/4"), ("GEN-005", "out/3"),
    ])
