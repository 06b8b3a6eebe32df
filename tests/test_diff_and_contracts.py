import pytest

from plumbline.operators import diff as D
from plumbline.sources import contracts as S


def told(df):
    return [(r.kind, r.rail, r.subject, r.before, r.after) for r in df.collect()]


BEFORE = {
    "repository": {"roots": ["crates"], "exclude": ["gen"], "symlinks": "deny"}, "dependencies": {"mode": "locked", "cycles": "deny", "crate_roots": [{"package": "p", "source": "s", "root": "r"}]},
    "layers": [{"name": "a", "packages": ["x", "y"], "may_depend_on": ["b"], "external": "locked", "profiles": ["pure"]}, {"name": "b", "packages": ["z"]}],
    "profiles": {"pure": {"reachability": "all", "effects": {"deny": ["network", "wall-clock"]}}}, "dependency_rules": [{"from": "x", "deny": ["bad"], "kinds": ["build"]}],
    "owners": [{"name": "o", "kind": "call", "selector": "a::b", "within": ["w"], "allow": ["f"]}, {"name": "gone", "kind": "call", "within": ["q"]}], "scopes": [{"name": "s", "include": ["i"], "symbols": {"deny": ["d"]}}],
    "analysis": {"limits": {"projected_facts": 5}}, "gates": [{"name": "g", "kind": "local", "path": "p", "inputs": ["i"]}],
    "source": {"rust": {"size": {"facade": {"target": 10, "hard": 20}}, "file_roles": [{"path": "m.rs", "role": "facade"}], "facades": "declarative", "hygiene": {"glob_imports": "deny", "deny_methods": ["unwrap"]}}},
}
AFTER = {
    "repository": {"roots": ["crates", "tools"], "exclude": ["gen", "tmp"], "symlinks": "inside"}, "dependencies": {"mode": "locked", "cycles": "allow", "crate_roots": [{"package": "p", "source": "s", "root": "r2"}]},
    "layers": [{"name": "a", "packages": ["x"], "may_depend_on": [], "external": "none", "profiles": ["pure"]}, {"name": "b", "packages": ["z", "y"]}],
    "profiles": {"pure": {"reachability": "production", "effects": {"deny": ["network"]}}}, "dependency_rules": [{"from": "x", "deny": ["bad"], "kinds": ["build"], "reachability": "transitive"}],
    "owners": [{"name": "o", "kind": "capability", "selector": "a::b", "within": ["w"], "allow": ["f", "g"]}, {"name": "new", "kind": "call", "within": ["k"]}], "scopes": [{"name": "s", "include": ["i"], "symbols": {"deny": []}}],
    "analysis": {"limits": {"projected_facts": 7, "include_work": 1}}, "gates": [{"name": "g", "kind": "local", "path": "p", "inputs": ["i", "j"]}],
    "source": {"rust": {"size": {"facade": {"target": 12, "hard": 15}}, "file_roles": [{"path": "m.rs", "role": "implementation"}, {"path": "n.rs", "role": "facade"}], "facades": "declarative", "hygiene": {"glob_imports": "facade-reexports-only", "deny_methods": []}}},
}


def test_contract_changes(spark):
    got = told(D.compare(spark, BEFORE, None, AFTER, None))
    assert got == [
        ("grant", "analysis.limit", "include-work", "input-derived", "1"), ("grant", "analysis.limit", "projected-facts", "5", "7"), ("grant", "dependency.cycles", "dependencies.cycles", None, None),
        ("grant", "effect.boundary", "pure:WallClock", None, None), ("grant", "effect.reachability", "pure", "All", "Production"), ("grant", "owner", "gone", None, None), ("grant", "owner.allow", "o:g", None, None),
        ("grant", "repository.exclude", "repository:tmp", None, None), ("grant", "repository.symlinks", "repository.symlinks", None, None), ("grant", "rust.deny-methods", "source:unwrap", None, None),
        ("grant", "rust.file-role", "m.rs", "Some(Facade)", "Some(Implementation)"), ("grant", "rust.file-size", "facade.target", "10", "12"), ("grant", "rust.glob-imports", "source.rust.hygiene.glob_imports", None, None), ("grant", "symbol.deny", "s:d", None, None),
        ("revoke", "dependency.explicit-deny", "x->bad:transitive:Build", None, None), ("revoke", "dependency.external", "a", None, None), ("revoke", "dependency.layer-edge", "a->b", None, None), ("revoke", "owner", "new", None, None),
        ("revoke", "qualification.gate-input", "g:j", None, None), ("revoke", "repository.root", "repository:tools", None, None), ("revoke", "rust.file-role", "n.rs", "None", "Some(Facade)"), ("revoke", "rust.file-size", "facade.hard", "20", "15"),
        ("unknown", "dependency.crate-root", "p@s", "r", "r2"), ("unknown", "dependency.package-layer", "y", "a", "b"), ("unknown", "owner.kind", "o", "Call", "Capability"),
    ]
    assert told(D.compare(spark, BEFORE, None, BEFORE, None)) == [] == told(D.compare(spark, {}, None, {}, None))
    found = D.compare(spark, BEFORE, None, AFTER, None)
    assert D.summary(found).first().asDict() == {"grants": 14, "revokes": 8, "debt": 0, "cleanup": 0, "neutral": 0, "unknown": 3}
    assert D.denies(found).first().denied and D.denies(found, allow_grants=True).first().denied and not D.denies(found.filter("kind = 'grant'"), allow_grants=True).first().denied


LOCK = {"schema": 1, "semantics": 2, "contract_sha256": "c", "packages": [{"name": "p", "dependencies": ["q"]}, {"name": "q"}], "ratchets": [{"rule": "r", "selector": "a::r#b", "target": "t", "value": 3}, {"rule": "r", "target": "u", "value": 1}], "gates": [{"name": "g", "path": "p", "sha256": "1", "inputs": [{"path": "i", "sha256": "2"}]}]}
LATER = {**LOCK, "packages": [{"name": "p"}, {"name": "w"}], "ratchets": [{"rule": "r", "selector": "r#a::b", "target": "t", "value": 5}], "gates": [{"name": "g", "path": "p", "sha256": "9", "inputs": [{"path": "j", "sha256": "2"}]}]}


def test_lock_changes_and_authority(spark):
    assert told(D.compare(spark, {}, LOCK, {}, LATER)) == [
        ("grant", "qualification.gate-input-lock", "g:i", None, None), ("grant", "repository.package", "w", None, None), ("revoke", "dependency.resolved-edge", "p->q", None, None), ("revoke", "qualification.gate-input-lock", "g:j", None, None),
        ("revoke", "repository.package", "q", None, None), ("debt", "ratchet", "r[a::b]:t", "3", "5"), ("cleanup", "ratchet", "r:u", "1", "<none>"), ("unknown", "qualification.gate-lock", "g", "p@1", "p@9"),
    ]
    doubted = told(D.compare(spark, {}, LOCK, {}, LATER, ("c", "other", 1, 2)))
    assert doubted == [("unknown", "lock.authority", "after:contract", "c", "other")]
    assert told(D.compare(spark, {}, None, {}, LOCK, ("c", "c", 1, 3))) == [("unknown", "lock.authority", "after:semantics", "2", "3"), ("unknown", "lock.authority", "before:missing", None, None)]
    assert told(D.compare(spark, {}, LOCK, {}, None)) == [("grant", "lock", "lock", None, None)]


def test_contract_reader(tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text)
    write("main.toml", 'schema = 2\nimports = ["a.toml", "./b.toml"]\n[repository]\nroots = ["x"]\n[[layers]]\nname = "one"\n')
    write("a.toml", '[[layers]]\nname = "two"\n[repository]\nexclude = ["y"]\n')
    write("b.toml", '[profiles.pure]\nreachability = "all"\n')
    doc, files = S.read_contract(str(tmp_path), "main.toml")
    assert doc == {"schema": 2, "repository": {"roots": ["x"], "exclude": ["y"]}, "layers": [{"name": "one"}, {"name": "two"}], "profiles": {"pure": {"reachability": "all"}}}
    assert [p for p, _ in files] == ["main.toml", "a.toml", "b.toml"] and all(len(h) == 64 for _, h in files)
    for text, said in (('imports = ["a.toml", "a.toml"]', "more than once"), ('imports = ["loop.toml"]', "cycle"), ('imports = ["*.toml"]', "pattern"), ('imports = ["../x.toml"]', "leaves"), ('imports = ["a.toml"]\nrepository = {exclude = ["z"]}', "again"), ("x = ", "contract")):
        write("loop.toml", text)
        with pytest.raises(S.ContractError, match=said):
            S.read_contract(str(tmp_path), "loop.toml")


def test_lock_text(tmp_path):
    text = S.render_lock(LOCK)
    (tmp_path / "lock").write_text(text)
    assert S.read_lock(str(tmp_path / "lock")) == S.canonical(LOCK) and S.read_lock(str(tmp_path / "none")) is None
    mixed = {**LOCK, "ratchets": LOCK["ratchets"][::-1], "packages": [*LOCK["packages"][::-1], LOCK["packages"][0]]}
    assert S.render_lock(mixed) == text


def test_replace_only_what_was_planned(tmp_path):
    path = str(tmp_path / "f")
    S.replace_file(path, None, b"one")
    S.replace_file(path, b"one", b"two")
    with pytest.raises(S.ContractError):
        S.replace_file(path, b"one", b"three")
    assert open(path, "rb").read() == b"two" and [x.name for x in tmp_path.iterdir()] == ["f"]
