"""Two snapshots of a contract and its lock as changes with a direction.

A snapshot is a table of entries (key, subject, value, rank, parent): what the contract says of a subject, one row each; rank orders
values that have a direction; parent names the entry without which this one isn't compared (an owner's paths, for an owner that is
new, are no news). All families meet in one full outer join on (key, subject), and RAILS says what a difference means.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ENTRY = "key string, subject string, value string, rank double, parent string"

#: The kinds of change, in their order.
KINDS = ("grant", "revoke", "debt", "cleanup", "neutral", "unknown")

_G, _R, _D, _C, _N, _U = KINDS
_MODE = "enforcement mode changed"


def _set(key: str, rail: str, added: str, removed: str, verb: str) -> tuple:
    return (key, rail, added, f"contract now {verb}", removed, f"contract no longer {verb}", None, None, None, None, False, None)


def _keyed(key: str, rail: str, added: str | None, added_text: str | None, removed: str | None, removed_text: str | None, changed_text: str | None = None, changed: str = _U, shows: bool = True) -> tuple:
    return (key, rail, added, added_text, removed, removed_text, None, None, changed, changed_text, shows, None)


def _mode(key: str, rail: str) -> tuple:
    return (key, rail, None, None, None, None, _R, _G, None, _MODE, False, None)


def _number(key: str, rail: str) -> tuple:
    return (key, rail, None, None, None, None, _G, _R, None, "source-size permission changed", True, None)


def _either(key: str, rail: str, text: str, shows: bool = False) -> tuple:
    """A value of two, whose greater one gives more."""
    return (key, rail, None, None, None, None, _G, _R, None, text, shows, None)


RAIL_COLUMNS = "key string, rail string, added string, added_text string, removed string, removed_text string, up string, down string, changed string, changed_text string, shows boolean, absent string"

#: What a difference of each key means: its rail, the kinds of an added, a removed, a raised, a lowered and another value, and the texts.
RAILS = (
    _set("repository.root", "repository.root", _R, _G, "checks repository source"), _set("repository.exclude", "repository.exclude", _G, _R, "excludes repository source"),
    _mode("repository.nested_git", "repository.nested-git"), _mode("repository.submodules", "repository.submodules"), _mode("repository.symlinks", "repository.symlinks"),
    _mode("dependencies.mode", "dependency.lock"), _mode("dependencies.unassigned_packages", "dependency.assignment"), _mode("dependencies.cycles", "dependency.cycles"), _mode("layer.external", "dependency.external"),
    _keyed("crate-root", "dependency.crate-root", _G, "contract now trusts an external package crate-root identity", _R, "contract no longer trusts an external package crate-root identity", "attested external crate-root identity changed"),
    _set("layer.edge", "dependency.layer-edge", _G, _R, "permits a layer dependency"), _set("layer.profile", "effect.layer-profile", _R, _G, "applies an effect profile to a layer"),
    ("layer.package", "dependency.package-layer", _U, "package layer assignment changed and requires review", _U, "package layer assignment changed and requires review", None, None, _U, "package layer assignment changed and requires review", True, "<unassigned>"),
    _keyed("profile.effect", "effect.boundary", _R, "profile now denies this architectural effect", _G, "profile no longer denies this architectural effect"),
    _keyed("profile.syntax", "syntax.boundary", _R, "profile now denies this runtime-neutral syntax", _G, "profile no longer denies this runtime-neutral syntax"),
    _either("profile.reachability", "effect.reachability", "profile source reachability changed", True), _set("dependency.deny", "dependency.explicit-deny", _R, _G, "denies resolved package reachability"),
    _keyed("scope", "symbol.scope", _R, "new scope introduces symbol restrictions", _G, "scope and its symbol restrictions were removed"),
    _set("scope.include", "symbol.scope-include", _R, _G, "applies restrictions to source"), _set("scope.exclude", "symbol.scope-exclude", _G, _R, "exempts source from restrictions"), _set("scope.deny", "symbol.deny", _R, _G, "denies an exact symbol"),
    _keyed("owner", "owner", _R, "new ownership boundary was declared", _G, "ownership boundary was removed"),
    _keyed("owner.kind", "owner.kind", None, None, None, None, "ownership kind changed and requires review"), _keyed("owner.selector", "owner.selector", None, None, None, None, "ownership selector changed and requires review"),
    _either("owner.reachability", "owner.reachability", "owner source reachability changed", True), _set("owner.mutating_methods", "owner.mutating-method", _R, _G, "treats this written receiver method as field mutation"),
    _set("owner.within", "owner.within", _R, _G, "enforces ownership within this source scope"), _set("owner.allow", "owner.allow", _G, _R, "may own this architectural resource"),
    _keyed("size", "rust.file-size", _R, "file-size policy became enforced", _G, "file-size policy was removed"), _number("size.number", "rust.file-size"),
    ("file-role", "rust.file-role", "by rank", "effective Rust source role changed", "by rank", "effective Rust source role changed", _G, _R, None, "effective Rust source role changed", True, "None"),
    _keyed("world.mode", "rust.feature-world.mode", None, None, None, None, "Cargo feature analysis changed between legacy conditional and exact worlds", shows=False),
    _keyed("world", "rust.feature-world", _R, "an exact Cargo feature compilation world is now analyzed", _G, "an exact Cargo feature compilation world is no longer analyzed"),
    _keyed("world.package", "rust.feature-world.package", _U, "the complete workspace package map changed", _U, "the complete workspace package map changed"),
    _keyed("world.default", "rust.feature-world.default-features", None, None, None, None, "default-feature analysis changed", shows=False),
    _keyed("world.feature", "rust.feature-world.feature", _U, "the feature world now analyzes this selected feature", _U, "the feature world no longer analyzes this selected feature"),
    _keyed("generated", "rust.generated-source", _G, "source became generator-owned", _R, "source returned to handwritten enforcement"), _number("generated.number", "rust.generated-source"),
    _keyed("generated.manifest", "rust.generated-source", None, None, None, None, "generated manifest identity changed"),
    _set("generated.auxiliary", "rust.generated-source.auxiliary", _G, _R, "allows manifest-owned source outside the Cargo graph"), _set("generated.input", "rust.generated-source.input", _R, _G, "verifies generator input"),
    _keyed("out-dir", "rust.source-graph.out-dir", _G, "OUT_DIR expansion became trusted through a generated snapshot", _R, "OUT_DIR generated-source trust was removed", "OUT_DIR generated snapshot identity changed"),
    _keyed("item-macro", "rust.source-graph.item-macro", _G, "contract now trusts an item macro not to create source edges", _R, "contract no longer trusts an item macro not to create source edges"),
    _mode("macros.mode", "rust.macro-expansion"), _keyed("macro", "rust.macro-expansion.allow", _G, "trusts an uninspected macro expansion", _R, "no longer trusts an uninspected macro expansion"),
    _either("macro.binding", "rust.macro-binding", "changes whether unresolved written macro names may bind"), _either("macro.inputs", "rust.macro-input", "changes whether opaque macro input is trusted"),
    _either("macro.bindings", "rust.macro-bindings", "changes whether reviewed expansion may replace items or introduce lexical bindings"),
    _either("macro.async_syntax", "rust.macro-async-syntax", "changes whether reviewed expansion is trusted to introduce no async syntax"),
    _keyed("type", "rust.type-policy", _R, "adds exact type-shape or duplication enforcement", _G, "removes exact type-shape and duplication enforcement"),
    _keyed("type.subject", "rust.type-policy.subject", None, None, None, None, "changes the exact governed type subject", shows=False), _keyed("type.shape", "rust.type-policy.shape", None, None, None, None, "changes the accepted exact Rust type representation", shows=False),
    _keyed("type.prohibition", "rust.type-policy.prohibition", _R, "adds a per-type duplication prohibition", _G, "removes a per-type duplication prohibition"),
    _either("type.reachability", "rust.type-policy.reachability", "changes source reachability covered by the exact type policy"),
    _mode("rust.module_docs", "rust.module-docs"), _mode("rust.facades", "rust.facades"), _mode("rust.entrypoints", "rust.entrypoints"), _mode("rust.tests", "rust.tests"), _mode("hygiene.unsafe", "rust.unsafe"),
    _mode("hygiene.lint_suppressions", "rust.lint-suppressions"), _mode("hygiene.glob_imports", "rust.glob-imports"), _set("hygiene.deny_methods", "rust.deny-methods", _R, _G, "denies method use"), _set("hygiene.deny_macros", "rust.deny-macros", _R, _G, "denies macro use"),
    _keyed("gate", "qualification.gate", _R, "new qualification gate was declared", _G, "qualification gate was removed"),
    _keyed("gate.kind", "qualification.gate-kind", None, None, None, None, "qualification gate kind changed and requires review"), _keyed("gate.path", "qualification.gate-path", None, None, None, None, "qualification gate file changed and requires review"),
    _set("gate.inputs", "qualification.gate-input", _R, _G, "content-addresses this qualification input"), _set("gate.requires", "qualification.gate-requirement", _R, _G, "requires this lower qualification gate"),
    _keyed("invariant", "invariant", _R, "new evidence-backed invariant was declared", _G, "evidence-backed invariant was removed"),
    _keyed("invariant.definition", "invariant.definition", None, None, None, None, "invariant meaning or documentation changed and requires review", shows=False), _set("invariant.evidence", "invariant.evidence", _R, _G, "requires this exact evidence"),
    _keyed("mirror", "rust.test-mirror", _R, "production source gained an exact execution-backed test mirror", _G, "production source lost its exact execution-backed test mirror", "test mirror identity or receipt path changed and requires review"),
    _set("mirror.inputs", "rust.test-mirror-input", _R, _G, "content-addresses this execution input"), _keyed("mirror.execution", "rust.test-mirror-execution", None, None, None, None, "test command, package, features, target, or toolchain changed"),
    ("limit", "analysis.limit", _G, "changes a content-bound multiplicative analysis budget", _R, "changes a content-bound multiplicative analysis budget", _G, _R, None, "changes a content-bound multiplicative analysis budget", True, "input-derived"),
    _keyed("lock.analysis", "lock.analysis", _R, "the analyzed universe became content-bound", _G, "the analyzed universe is no longer content-bound"),
    _keyed("lock.analysis.inventory", "lock.analysis", None, None, None, None, "the canonical analyzed inventory changed"), _keyed("lock.analysis.exclusions", "lock.analysis", None, None, None, None, "the analyzed exclusion set changed"),
    _keyed("lock.analysis.features", "lock.analysis", None, None, None, None, "Cargo feature definitions changed"), _keyed("lock.analysis.worlds", "lock.analysis", None, None, None, None, "configured or resolved Cargo feature worlds changed"),
    _keyed("lock.analysis.semantics", "lock.analysis", None, None, None, None, "the completeness certificate changed interpretation"),
    _keyed("lock.package", "repository.package", _G, "resolved workspace gained a package", _R, "resolved workspace lost a package"), _keyed("lock.edge", "dependency.resolved-edge", _G, "resolved dependency graph gained an edge", _R, "resolved dependency graph lost an edge"),
    _keyed("lock.generated", "rust.generated-provenance", _R, "generated provenance became lock-protected", _G, "generated provenance is no longer lock-protected", "generated provenance manifest changed"),
    _keyed("lock.gate", "qualification.gate-lock", _R, "qualification gate became content-addressed", _G, "qualification gate is no longer content-addressed", "reviewed qualification gate contents changed"),
    _keyed("lock.gate.input", "qualification.gate-input-lock", _R, "qualification input became content-addressed", _G, "qualification input is no longer content-addressed", "reviewed qualification input contents changed"),
    _keyed("lock.receipt", "rust.test-mirror-receipt-lock", _R, "test mirror execution receipt became content-addressed", _G, "test mirror execution receipt is no longer content-addressed", "reviewed execution receipt contents or identity changed"),
    _keyed("lock.macro-source", "rust.macro-source", _R, "macro authority became bound to an exact Cargo.lock package", _G, "exact Cargo.lock macro authority was removed", "the exact macro implementation package changed"),
    _keyed("lock.macro-implementation", "rust.macro-implementation", _G, "repository macro implementation package became trusted", _R, "repository macro implementation package is no longer trusted", "trusted repository macro implementation package changed"),
    _keyed("lock.item-macro", "rust.item-macro-manifest", _R, "item-macro namespace became exactly manifested", _G, "exact item-macro namespace authority was removed", "item-macro manifest, definition, invocation, guard, or compilation authority changed", shows=False),
    ("lock.ratchet", "ratchet", _D, "reviewed architecture debt was recorded", _C, "reviewed architecture debt was removed", _D, _C, None, "ratchet ceiling increased", True, "<none>"),
)

#: Strictness of modes, from the loosest.
RANKS = {
    "repository.nested_git": ("allow", "deny"), "repository.submodules": ("allow", "deny"), "repository.symlinks": ("inside", "deny"), "dependencies.mode": ("observed", "locked"),
    "dependencies.unassigned_packages": ("allow", "deny"), "dependencies.cycles": ("allow", "deny"), "layer.external": ("allow", "locked", "none"), "macros.mode": ("allow", "deny-unreviewed"),
    "rust.module_docs": ("allow", "required"), "rust.facades": ("allow", "declarative"), "rust.entrypoints": ("allow", "declarative"), "rust.tests": ("allow", "sibling"), "hygiene.unsafe": ("allow", "deny"),
    "hygiene.lint_suppressions": ("allow", "reasoned", "deny"), "hygiene.glob_imports": ("allow", "facade-reexports-and-test-super", "facade-reexports-only", "deny"),
    "file-role": ("Some(Facade)", "Some(Implementation)"), "profile.reachability": ("All", "Production"), "owner.reachability": ("All", "Production"), "type.reachability": ("all", "production"),
    "macro.binding": ("exact", "conservative"), "macro.inputs": ("inspected", "opaque"), "macro.bindings": ("unknown", "none"), "macro.async_syntax": ("unknown", "none"),
}

#: What forbids copies of a type as a whole.
CLONE_COPY = ("derive-clone", "derive-copy", "impl-clone", "impl-copy", "opaque-expansion")


def _entry(key: str, subject: str, value=None, parent: str | None = None) -> tuple:
    """A row of ENTRY; a mode's rank is its place in RANKS, a number's the number."""
    if key in RANKS:
        return key, subject, value, float(RANKS[key].index(value)), parent
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return key, subject, None if value is None else str(value), float(value) if number else None, parent


def _title(mode: str) -> str:
    return "".join(x.capitalize() for x in mode.split("-"))


def contract_entries(doc: dict) -> list[tuple]:
    """The entries of a contract as read (`sources.contracts`); what it doesn't set gives none."""
    out: list[tuple] = []
    add = lambda *a: out.append(_entry(*a))

    def members(key: str, owner: str | None, values, parent: str | None = None) -> None:
        for v in sorted(set(values or ())):
            add(key, f"{owner}:{v}" if owner else v, None, parent)

    def modes(section: dict, prefix: str, names: str, shown: str) -> None:
        for name in names.split():
            if name in section:
                add(f"{prefix}.{name}", f"{shown}.{name}", section[name])

    repository, dependencies, rust = doc.get("repository", {}), doc.get("dependencies", {}), doc.get("source", {}).get("rust", {})
    members("repository.root", "repository", repository.get("roots"))
    members("repository.exclude", "repository", repository.get("exclude"))
    modes(repository, "repository", "nested_git submodules symlinks", "repository")
    modes(dependencies, "dependencies", "mode unassigned_packages cycles", "dependencies")
    for r in dependencies.get("crate_roots", ()):
        add("crate-root", f"{r['package']}@{r['source']}", r["root"])
    for x in doc.get("layers", ()):
        members("layer.edge", None, [f"{x['name']}->{y}" for y in x.get("may_depend_on", ())])
        members("layer.profile", x["name"], x.get("profiles"))
        if "external" in x:
            add("layer.external", x["name"], x["external"])
        out.extend(_entry("layer.package", p, x["name"]) for p in x.get("packages", ()))
    for name, x in doc.get("profiles", {}).items():
        members("profile.effect", name, [_title(e) for e in x.get("effects", {}).get("deny", ())])
        members("profile.syntax", name, [_title(e) for e in x.get("syntax", {}).get("deny", ())])
        add("profile.reachability", name, _title(x.get("reachability", "all")))
    for r in doc.get("dependency_rules", ()):
        depths = ("direct", "transitive") if r.get("reachability") == "transitive" else ("direct",)
        members("dependency.deny", None, [f"{r['from']}->{t}:{depth}:{kind.capitalize()}" for t in r["deny"] for depth in depths for kind in r.get("kinds") or ("normal", "development", "build")])
    for x in doc.get("scopes", ()):
        add("scope", x["name"])
        for part, values in (("include", x.get("include")), ("exclude", x.get("exclude")), ("deny", x.get("symbols", {}).get("deny"))):
            members(f"scope.{part}", x["name"], values, f"scope:{x['name']}")
    for x in doc.get("owners", ()):
        add("owner", x["name"])
        add("owner.kind", x["name"], _title(x["kind"]))
        add("owner.selector", x["name"], x.get("selector", ""))
        add("owner.reachability", x["name"], _title(x.get("reachability", "all")))
        for part in ("mutating_methods", "within", "allow"):
            members(f"owner.{part}", x["name"], x.get(part), f"owner:{x['name']}")
    if "size" in rust:
        add("size", "source.rust.size")
        out.extend(_entry("size.number", f"{role}.{n}", v) for role, b in rust["size"].items() for n, v in b.items())
    out.extend(_entry("file-role", r["path"], f"Some({_title(r['role'])})") for r in rust.get("file_roles", ()))
    worlds = rust.get("feature_worlds", ())
    add("world.mode", "source.rust.feature_worlds", "exact" if worlds else "legacy")
    for w in worlds:
        add("world", w["name"], None, "world.mode:exact")
        for p in w.get("packages", ()):
            own = f"{w['name']}:{p['package']}"
            add("world.package", own, None, f"world:{w['name']}")
            add("world.default", own, bool(p.get("default_features", False)), f"world.package:{own}")
            members("world.feature", own, p.get("features"), f"world.package:{own}")
    for g in rust.get("generated", ()):
        add("generated", g["root"])
        out.extend(_entry("generated.number", f"{g['root']}.{n}", g[n]) for n in ("target", "hard") if n in g)
        add("generated.manifest", g["root"], g.get("manifest", ""))
        members("generated.auxiliary", g["root"], g.get("auxiliary"), f"generated:{g['root']}")
        members("generated.input", g["root"], g.get("inputs"), f"generated:{g['root']}")
    out.extend(_entry("out-dir", f"{x['path']}:{x['output']}", x["source"]) for x in rust.get("out_dir", ()))
    for x in rust.get("item_macros", ()):
        where = f"path={x['path']}" if "path" in x else "within=" + ",".join(sorted(x["within"])) if x.get("within") else "repository"
        add("item-macro", f"{x['name']}:{where}")
    macros = rust.get("macros", {})
    if "mode" in macros:
        add("macros.mode", "source.rust.macros.mode", macros["mode"])
    for x in macros.get("allow", ()):
        add("macro", x["name"])
        out.extend(_entry(f"macro.{n}", x["name"], x[n]) for n in ("binding", "inputs", "bindings", "async_syntax") if n in x)
    for x in rust.get("types", ()):
        add("type", x["name"])
        add("type.subject", x["name"], "|".join(str(x.get(n)) for n in ("identity", "path", "kind")))
        add("type.shape", x["name"], "|".join(str(x.get(n)) for n in ("visibility", "leaf_module", "fields")))
        add("type.reachability", x["name"], x.get("reachability", "all"))
        members("type.prohibition", x["name"], CLONE_COPY if x.get("clone_copy") == "forbidden" else x.get("deny"), f"type:{x['name']}")
    modes(rust, "rust", "module_docs facades entrypoints tests", "source.rust")
    hygiene = rust.get("hygiene", {})
    modes(hygiene, "hygiene", "unsafe lint_suppressions glob_imports", "source.rust.hygiene")
    members("hygiene.deny_methods", "source", hygiene.get("deny_methods"))
    members("hygiene.deny_macros", "source", hygiene.get("deny_macros"))
    for x in doc.get("gates", ()):
        add("gate", x["name"])
        add("gate.kind", x["name"], _title(x["kind"]))
        add("gate.path", x["name"], x["path"])
        members("gate.inputs", x["name"], x.get("inputs"), f"gate:{x['name']}")
        members("gate.requires", x["name"], x.get("requires"), f"gate:{x['name']}")
    for x in doc.get("invariants", ()):
        add("invariant", x["id"])
        add("invariant.definition", x["id"], f"{x.get('title')}|{x.get('document')}")
        members("invariant.evidence", x["id"], x.get("evidence"), f"invariant:{x['id']}")
    for x in rust.get("test_mirrors", ()):
        e, own = x.get("execution", {}), f"{x['test']}::{x['name']}@{x['receipt']}"
        add("mirror", x["production"], own)
        members("mirror.inputs", x["production"], x.get("inputs"), f"mirror:{x['production']}={own}")
        add("mirror.execution", x["production"], f"{e.get('command')}|package={e.get('package')}|default-features={str(bool(e.get('default_features'))).lower()}|features={','.join(e.get('features', ()))}|target={e.get('target')}|toolchain={e.get('toolchain')}", f"mirror:{x['production']}={own}")
    out.extend(_entry("limit", name.replace("_", "-"), v) for name, v in doc.get("analysis", {}).get("limits", {}).items())
    return out


def lock_entries(lock: dict) -> list[tuple]:
    """The entries of a lock as read (`sources.contracts`)."""
    out: list[tuple] = []
    add = lambda *a: out.append(_entry(*a))
    if a := lock.get("analysis"):
        add("lock.analysis", "certificate")
        for key, field, subject in (("inventory", "inventory_sha256", "inventory"), ("exclusions", "exclusions_sha256", "exclusions"), ("features", "cargo_features_sha256", "cargo-features"), ("worlds", "feature_worlds_sha256", "feature-worlds"), ("semantics", "analyzer_semantics", "semantics")):
            if field in a:
                out.append((f"lock.analysis.{key}", subject, str(a[field]), None, None))
    for p in lock.get("packages", ()):
        add("lock.package", p["name"])
        out.extend(_entry("lock.edge", f"{p['name']}->{d if isinstance(d, str) else d['name']}") for d in p.get("dependencies", ()))
    out.extend(_entry("lock.generated", g["root"], g["manifest_sha256"]) for g in lock.get("generated", ()))
    for g in lock.get("gates", ()):
        add("lock.gate", g["name"], f"{g['path']}@{g['sha256']}")
        out.extend(_entry("lock.gate.input", f"{g['name']}:{i['path']}", i["sha256"], f"lock.gate:{g['name']}") for i in g.get("inputs", ()))
    out.extend(_entry("lock.receipt", r["production"], f"{r['test']}::{r['name']}@{r['receipt']}#{r['sha256']}") for r in lock.get("execution_receipts", ()))
    out.extend(_entry("lock.macro-source", m["allowance"], f"{m['package']} {m['version']} ({m['source']})") for m in lock.get("macro_sources", ()))
    out.extend(_entry("lock.macro-implementation", f"{m['directory']}:{m['package']}", m["inputs_sha256"]) for m in lock.get("macro_implementations", ()))
    out.extend(_entry("lock.item-macro", f"{m['name']}:{m['invocation_path']}", str(sorted(m.items()))) for m in lock.get("item_macro_manifests", ()))
    for r in lock.get("ratchets", ()):
        selector = "::".join(s.removeprefix("r#") for s in r["selector"].split("::")) if r.get("selector") else None
        add("lock.ratchet", f"{r['rule']}[{selector}]:{r['target']}" if selector else f"{r['rule']}:{r['target']}", r["value"])
    return out


def entries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ENTRY)


def owned_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, subject, before, r0, had, after, r1, has) of the entries of either side whose parent, if they name one, both sides have."""
    a, b = (x.dropDuplicates(["key", "subject"]) for x in (before, after))
    both = a.select("key", "subject", F.col("value").alias("before"), F.col("rank").alias("r0"), F.col("parent").alias("p0"), F.lit(True).alias("had")).join(
        b.select("key", "subject", F.col("value").alias("after"), F.col("rank").alias("r1"), F.col("parent").alias("p1"), F.lit(True).alias("has")), ["key", "subject"], "full_outer")
    name = lambda x: x.select(F.concat_ws(":", "key", "subject").alias("parent")).union(x.filter("value is not null").select(F.concat(F.col("key"), F.lit(":"), F.col("subject"), F.lit("="), F.col("value")))).union(x.filter("key = 'world.mode'").select(F.concat(F.lit("world.mode:"), F.col("value"))))
    owned = name(a).intersect(name(b))  # parents that both sides have
    both = both.withColumn("parent", F.coalesce("p0", "p1"))
    return both.filter("parent is null").unionByName(both.filter("parent is not null").join(owned, "parent", "left_semi"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind_ord, kind, rail, subject, message, before, after) of two tables of entries; equal values give no row, repeated entries count once."""
    spark = before.sparkSession
    rails = F.broadcast(spark.createDataFrame(list(RAILS), RAIL_COLUMNS))
    free = owned_rows(before, after)
    row = free.join(rails, "key")
    up, down = F.col("r1") > F.col("r0"), F.col("r1") < F.col("r0")
    by_rank = lambda kind, rank, more, less: F.when(F.col(kind) == "by rank", F.when(F.col(rank) > 0, more).otherwise(less)).otherwise(F.col(kind))
    new, gone = F.col("had").isNull(), F.col("has").isNull()
    other = ~F.col("before").eqNullSafe(F.col("after"))
    kind = F.when(new, by_rank("added", "r1", _G, _R)).when(gone, by_rank("removed", "r0", _R, _G)).when(other & up, F.col("up")).when(other & down, F.col("down")).when(other, F.col("changed"))
    text = F.when(new, F.col("added_text")).when(gone, F.col("removed_text")).when(down & (F.col("key") == "lock.ratchet"), F.lit("ratchet tightened with the repository")).otherwise(F.col("changed_text"))
    keyed = F.col("key").isin("crate-root")
    subject = F.when((new | gone) & keyed, F.concat_ws(":", "subject", F.coalesce("after", "before"))).otherwise(F.col("subject"))
    shown = lambda c: F.when(new | gone, F.when(F.col("absent").isNotNull(), F.coalesce(F.col(c), F.col("absent")))).when(F.col("shows"), F.col(c))
    found = row.select(kind.alias("kind"), "rail", subject.alias("subject"), text.alias("message"), shown("before").alias("before"), shown("after").alias("after")).filter("kind is not null and message is not null")
    return found.withColumn("kind_ord", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1).select("kind_ord", "kind", "rail", "subject", "message", "before", "after")


def sort_changes(found: DataFrame) -> DataFrame:
    """By the kind's place, then rail, subject and message (O2)."""
    return found.orderBy("kind_ord", "rail", "subject", "message")


def summary(found: DataFrame) -> DataFrame:
    """One row with the count of each of the six kinds (A4)."""
    plural = {"grant": "grants", "revoke": "revokes"}
    return found.agg(*[F.count_if(F.col("kind") == k).alias(plural.get(k, k)) for k in KINDS])


def denies(found: DataFrame, allow_grants: bool = False) -> DataFrame:
    """Whether automation must refuse: any grant, debt or unknown; a review may waive grants, and only these."""
    bad = [k for k in ("grant", "debt", "unknown") if not (allow_grants and k == "grant")]
    return found.agg(F.coalesce(F.bool_or(F.col("kind").isin(bad)), F.lit(False)).alias("denied"))


def lock_authority(side: str, contract_sha256: str, lock: dict | None, schema: int, semantics: int) -> list[tuple]:
    """(kind, rail, subject, message, before, after) for each reason why a lock can't speak for its contract; with any, locks aren't compared."""
    if lock is None:
        return [(_U, "lock.authority", f"{side}:missing", "architecture comparison has no lock authority for this repository state", None, None)]
    out = []
    for part, have, want, text in (("schema", lock.get("schema"), schema, "lock schema is unsupported by this engine"), ("semantics", lock.get("semantics"), semantics, "lock semantics are incompatible with this engine"), ("contract", lock.get("contract_sha256"), contract_sha256, "lock was produced from different contract bytes")):
        if have != want:
            out.append((_U, "lock.authority", f"{side}:{part}", text, str(have), str(want)))
    return out


def compare(spark: SparkSession, before: dict, before_lock: dict | None, after: dict, after_lock: dict | None, checked: tuple[str, str, int, int] | None = None) -> DataFrame:
    """Changes of contracts and locks. checked: the contracts' digests, the lock schema and semantics: locks without authority aren't compared."""
    doubts = []
    if checked:
        doubts = lock_authority("before", checked[0], before_lock, *checked[2:]) + lock_authority("after", checked[1], after_lock, *checked[2:])
    left, right = contract_entries(before), contract_entries(after)
    if not doubts:
        left, right = left + lock_entries(before_lock or {}) if before_lock and after_lock else left, right + lock_entries(after_lock or {}) if before_lock and after_lock else right
        if bool(before_lock) != bool(after_lock):
            doubts = [(_N if after_lock else _G, "lock", "lock", "resolved architecture state is now checked in" if after_lock else "resolved architecture state was removed", None, None)]
    found = changes(entries(spark, left), entries(spark, right))
    more = spark.createDataFrame([(KINDS.index(d[0]), *d) for d in doubts], "kind_ord int, kind string, rail string, subject string, message string, before string, after string")
    return sort_changes(found.unionByName(more))
