import pytest

from plumbline.functions import versions as V
from plumbline.operators import evidence as E, rules
from plumbline.sources import resolution as R


@pytest.mark.parametrize("requirement,yes,no", [
    ("1.2.3", ["1.2.3", "1.9.0"], ["1.2.2", "2.0.0", "1.3.0-alpha", "2.0.0-alpha"]), ("^0.2.3", ["0.2.3", "0.2.9"], ["0.3.0", "0.2.2"]), ("0.0.3", ["0.0.3"], ["0.0.4", "0.0.2"]), ("0", ["0.0.1", "0.9.9"], ["1.0.0"]), ("0.0", ["0.0.5"], ["0.1.0"]), ("1", ["1.0.0", "1.9.9"], ["2.0.0", "0.9.0"]),
    ("~1.2.3", ["1.2.3", "1.2.9"], ["1.3.0"]), ("~1.2", ["1.2.0"], ["1.3.0", "1.1.9"]), ("~1", ["1.9.0"], ["2.0.0"]), ("=1.2.3", ["1.2.3"], ["1.2.4"]), ("=1.2", ["1.2.7"], ["1.3.0"]), ("1.*", ["1.0.0", "1.7.1"], ["2.0.0"]), ("1.2.*", ["1.2.9"], ["1.3.0"]), ("*", ["0.0.1", "9.9.9"], ["1.0.0-a"]),
    (">1.2", ["1.3.0"], ["1.2.9"]), (">1.2.3", ["1.2.4"], ["1.2.3"]), (">=1.2, <1.5", ["1.2.0", "1.4.9"], ["1.5.0", "1.1.0"]), ("<=1.2", ["1.2.9"], ["1.3.0"]), ("<1.2.3", ["1.2.2"], ["1.2.3"]), ("<=1.2.3", ["1.2.3"], ["1.2.4"]), (">=1.0.0-beta.2", ["1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc", "1.0.0"], ["1.0.0-beta.1", "1.0.0-alpha", "1.1.0-beta.3"]), (None, ["1.0.0-a"], []),
])
def test_requirements(requirement, yes, no):
    assert [V.version_matches(v, requirement) for v in yes + no] == [True] * len(yes) + [False] * len(no)


def test_bad_versions_are_errors():
    for version, requirement in (("1.2", "1"), ("01.2.3", "1"), ("1.2.3", "one"), ("1.2.3", "1.2.3.4")):
        with pytest.raises(ValueError):
            V.version_matches(version, requirement)


C = "a" * 40


def test_git_references():
    assert V.git_reference(f"git+https://h/r#{C}") == ("https://h/r", "default", "", C) and V.git_reference("registry+x") is None
    assert V.git_reference(f"git+https://h/r?branch=a%2Fb+c#{C}") == ("https://h/r", "branch", "a/b c", C)
    assert V.git_matches(f"git+u?rev=AAAA#{C}", "u", None, None, "AAAA") and not V.git_matches(f"git+u?rev=bb#{C}", "u", None, None, "bb")
    assert V.git_matches(f"git+u#{C}", "u", None, None, None) and not V.git_matches(f"git+u?tag=v#{C}", "u", "v", None, None) and not V.git_matches(f"git+w#{C}", "u", None, None, None)
    for bad in ("git+u", "git+u#abc", f"git+u?x=1#{C}", f"git+u?branch=a&tag=b#{C}", f"git+u?branch=#{C}", f"git+u?branch=%2#{C}", f"git+?branch=a#{C}"):
        with pytest.raises(ValueError):
            V.git_reference(bad)
    with pytest.raises(ValueError):
        V.git_matches(f"git+u?rev=main#{C}", "u", None, None, "main")


def test_manifests_against_a_lock(spark):
    """From manifests and a lock's nodes to the denied path: registry, path and Git dependencies, and ambiguous ones."""
    deps = spark.createDataFrame([("app", 0, "serde", "registry", None, "1", None, None, None), ("app", 1, "mine", "path", "crates/mine", None, None, None, None), ("app", 2, "forked", "git", "https://h/f", None, "main", None, None), ("app", 3, "gone", "registry", None, "2", None, None, None), ("app", 4, "twice", "registry", None, "*", None, None, None)], "package string, ordinal long, name string, source_kind string, location string, requirement string, branch string, tag string, rev string")
    nodes = spark.createDataFrame([("r", "app", "0.1.0", "path+."), ("s1", "serde", "1.4.0", R.REGISTRY), ("s2", "serde", "2.0.0", R.REGISTRY), ("m", "mine", "0.1.0", "path+crates/mine"), ("f", "forked", "3.0.0", f"git+https://h/f?branch=main#{C}"), ("g", "gone", "1.0.0", R.REGISTRY), ("t1", "twice", "1.0.0", R.REGISTRY), ("t2", "twice", "2.0.0", R.REGISTRY), ("u", "serde", "1.5.0", R.REGISTRY)], "node string, name string, version string, source string")
    edges = spark.createDataFrame([("r", x) for x in ("s1", "s2", "m", "f", "g", "t1", "t2")] + [("f", "s2")], "src string, dst string")
    roots = spark.createDataFrame([("app", "r")], "package string, node string")
    mapping = R.lock_mapping(deps, nodes, edges, roots)
    assert sorted(map(tuple, mapping.collect())) == [("app", 0, 1, "s1"), ("app", 1, 1, "m"), ("app", 2, 1, "f"), ("app", 3, 0, None), ("app", 4, 2, None)]
    manifest = spark.createDataFrame([("app", 2, "forked", "forked", "normal", None)], "package string, ordinal long, alias string, name string, kind string, internal_package string")
    lock = {"nodes": nodes.selectExpr("*", "cast(null as string) as checksum"), "edges": edges, "roots": roots, "mapping": mapping}
    found = rules.denied_findings(spark.createDataFrame([("app", ".")], "name string, directory string"), manifest, [{"name": "no-serde", "from": "app", "deny": ["serde"], "reachability": "transitive"}], lock).collect()
    assert [(r.id, r.path) for r in found] == [("DEP-008", "Cargo.toml")] and found[0].message.endswith(f"-> serde 2.0.0 ({R.REGISTRY}; checksum=none)")
    selectors = spark.createDataFrame([("a", "serde", None, None), ("b", "serde", "2.0.0", None), ("c", "mine", None, "path+crates/mine"), ("d", "none", None, None)], "selector string, name string, version string, source string")
    assert sorted(map(tuple, R.lock_select(selectors, nodes).collect())) == [("a", 3, None), ("b", 1, "s2"), ("c", 1, "m"), ("d", 0, None)]


def test_execution_groups(spark):
    e = {"command": "c", "package": "p", "default_features": True, "features": ["x"], "target": "t", "toolchain": "1"}
    df = spark.createDataFrame([(e,), (dict(e),), ({**e, "target": "u"},)], f"execution {E.EXECUTION}")
    assert len({r[0] for r in df.select(E.execution_group(df.execution)).collect()}) == 2
