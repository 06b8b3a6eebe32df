"""Rules on source files: counted debt and its ratchets, shape, roles, test placement.

files(path, class, bits, syntax, module_docs), class inferred; facts(path, kind, ordinal, name, span, quality) with kinds test,
suppression, unsafe, method, macro and facade; macros match by their last segment too. Counts are taken of facts grouped by
file, so a file of any size is one row in the joins with policy.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.predicates import effective_role, is_non_test_target, is_test_only, quoted, ratchet_selector
from plumbline.operators.findings import finding, policy, said, small

#: The name of a suppression that gives no reason, and of the lock in messages.
UNREASONED, LOCK = "unreasoned lint suppression", "the lock file"

#: Of each counted rule: the fact's kind, the ratchet's id, rule and category, what its debt is called, and the id, rule and text of a single occurrence.
COUNTED = {
    "rust.hygiene.denied-method": ("method", "RUST-HYG-007", "rust.hygiene.method.ratchet", "source-hygiene", None, "RUST-HYG-001", "rust.hygiene.method"),
    "rust.hygiene.denied-macro": ("macro", "RUST-HYG-008", "rust.hygiene.macro.ratchet", "source-hygiene", None, "RUST-HYG-002", "rust.hygiene.macro"),
    "rust.hygiene.lint-suppressions": ("suppression", "RUST-HYG-006", "rust.hygiene.lint-suppression.ratchet", "source-hygiene", "lint-suppression violations", "RUST-HYG-003", "rust.hygiene.lint-suppression"),
    "rust.hygiene.unsafe": ("unsafe", "RUST-HYG-005", "rust.hygiene.unsafe.ratchet", "source-hygiene", "unsafe constructs", "RUST-HYG-004", "rust.hygiene.unsafe"),
    "rust.module-docs": (None, "RUST-DOC-002", "rust.module-docs.ratchet", "source-shape", "missing module documentation", "RUST-DOC-001", "rust.module-docs"),
    "rust.inline-tests": ("test", "RUST-TEST-005", "rust.tests.inline.ratchet", "test-placement", "inline tests", "RUST-TEST-001", "rust.tests.sibling"),
}


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def occurrences(files: DataFrame, facts: DataFrame, rust: dict) -> DataFrame:
    """(rule, selector, path, ordinal, name, span, quality) of each counted construct in a governed file.

    rust: hygiene (deny_methods, deny_macros, lint_suppressions: allow, reasoned or deny, unsafe: allow or deny), module_docs and
    tests. A rule whose policy is off governs nothing.
    """
    spark, hygiene = files.sparkSession, rust.get("hygiene", {})
    target = files.filter(is_non_test_target(F.col("bits"))).select("path", "class")
    base = ["path", "ordinal", "name", "span", "quality"]
    told = lambda df, rule, selector=None: df.select(F.lit(rule).alias("rule"), (F.lit(None).cast("string") if selector is None else F.col(selector)).alias("selector"), *base)
    here = facts.join(target, "path")
    out = []
    for rule, names in (("rust.hygiene.denied-method", hygiene.get("deny_methods", ())), ("rust.hygiene.denied-macro", hygiene.get("deny_macros", ()))):
        chosen = small(spark.createDataFrame([(x,) for x in names], "selector string"), len(names))
        name, wanted = ratchet_selector(F.col("name")), ratchet_selector(F.col("selector"))
        same = name == wanted
        if rule.endswith("macro"):
            same = same | (F.element_at(F.split(name, "::"), -1) == wanted)
        out.append(told(here.filter(F.col("kind") == COUNTED[rule][0]).join(chosen, same), rule, "selector"))
    if (mode := hygiene.get("lint_suppressions", "allow")) != "allow":
        bad = here.filter("kind = 'suppression' and class <> 'generated'")
        out.append(told(bad if mode == "deny" else bad.filter(F.col("name") == UNREASONED), "rust.hygiene.lint-suppressions"))
    if hygiene.get("unsafe", "allow") == "deny":
        out.append(told(here.filter("kind = 'unsafe'"), "rust.hygiene.unsafe"))
    if rust.get("tests", "allow") == "sibling":
        out.append(told(here.filter("kind = 'test'"), "rust.inline-tests"))
    if rust.get("module_docs", "allow") == "required":
        bare = files.filter("syntax = 'items' and class <> 'generated' and not module_docs")
        out.append(told(bare.select("path", F.lit(0).cast("long").alias("ordinal"), F.lit("").alias("name"), F.lit(None).cast(facts.schema["span"].dataType).alias("span"), F.lit("exact").alias("quality")), "rust.module-docs"))
    return _all(out)


def governed(files: DataFrame, rust: dict) -> DataFrame:
    """(rule, selector, path) of every file that a counted rule measures, with no occurrences too: null isn't zero."""
    hygiene, target = rust.get("hygiene", {}), is_non_test_target(F.col("bits"))
    rules = [("rust.hygiene.denied-method", x, target) for x in hygiene.get("deny_methods", ())] + [("rust.hygiene.denied-macro", x, target) for x in hygiene.get("deny_macros", ())]
    if hygiene.get("lint_suppressions", "allow") != "allow":
        rules.append(("rust.hygiene.lint-suppressions", None, target & (F.col("class") != "generated")))
    if hygiene.get("unsafe", "allow") == "deny":
        rules.append(("rust.hygiene.unsafe", None, target))
    if rust.get("tests", "allow") == "sibling":
        rules.append(("rust.inline-tests", None, target))
    if rust.get("module_docs", "allow") == "required":
        rules.append(("rust.module-docs", None, (F.col("syntax") == "items") & (F.col("class") != "generated")))
    each = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(r).alias("rule"), F.lit(s).cast("string").alias("selector"))) for r, s, on in rules]))
    return files.dropDuplicates(["path"]).select("path", F.explode(each).alias("x")).select("x.rule", "x.selector", "path")


def measurements(files: DataFrame, facts: DataFrame, rust: dict) -> DataFrame:
    """(rule, selector, path, value) of each governed file and rule."""
    counts = occurrences(files, facts, rust).groupBy("rule", "selector", "path").agg(F.count("*").alias("n"))
    own = governed(files, rust).alias("g")
    key = [F.col("g.rule").eqNullSafe(F.col("c.rule")), F.col("g.selector").eqNullSafe(F.col("c.selector")), F.col("g.path") == F.col("c.path")]
    return own.join(counts.alias("c"), reduce(lambda a, b: a & b, key), "left").select("g.rule", "g.selector", "g.path", F.coalesce("n", F.lit(0)).alias("value"))


def ratcheted(measured: DataFrame, ratchets: DataFrame, locked: DataFrame) -> DataFrame:
    """measured with reason and declared (a ratchet of the contract) and locked (its value in the lock); selectors without `r#`.

    ratchets(rule, selector, path, reason), locked(rule, selector, path, value). Ratchets whose file isn't governed have a null value.
    """
    key = lambda df: df.select(F.concat_ws("\0", "rule", F.coalesce(ratchet_selector(F.col("selector")), F.lit("\1")), "path").alias("k"), "*")
    a = key(ratchets).dropDuplicates(["k"]).select("k", F.col("rule").alias("r_rule"), F.col("selector").alias("r_selector"), F.col("path").alias("r_path"), "reason", F.lit(True).alias("declared"))
    b = key(locked).dropDuplicates(["k"]).select("k", F.col("value").alias("locked"))
    both = key(measured).join(a, "k", "full_outer").join(b, "k", "left")
    return both.select(F.coalesce("rule", "r_rule").alias("rule"), F.coalesce("selector", "r_selector").alias("selector"), F.coalesce("path", "r_path").alias("path"), "value", "reason", F.coalesce("declared", F.lit(False)).alias("declared"), "locked")


def counted_findings(files: DataFrame, facts: DataFrame, rust: dict, ratchets: DataFrame, locked: DataFrame) -> DataFrame:
    """RUST-HYG-001 to -008, RUST-DOC-001 and -002, RUST-TEST-001 and -005: each occurrence without a ratchet, and drift of ratchets."""
    state = ratcheted(measurements(files, facts, rust), ratchets, locked)
    hygiene = rust.get("hygiene", {})
    named = [("rust.hygiene.denied-method", x) for x in hygiene.get("deny_methods", ())] + [("rust.hygiene.denied-macro", x) for x in hygiene.get("deny_macros", ())]
    others = [r for r, on in (("rust.hygiene.lint-suppressions", hygiene.get("lint_suppressions", "allow") != "allow"), ("rust.hygiene.unsafe", hygiene.get("unsafe", "allow") == "deny"), ("rust.inline-tests", rust.get("tests", "allow") == "sibling"), ("rust.module-docs", rust.get("module_docs", "allow") == "required")) if on]
    policies = small(files.sparkSession.createDataFrame([*named, *[(r, None) for r in others]], "rule string, own string"), len(named)).alias("p")  # what a ratchet may be of, by the policy's own selector
    same = (F.col("s.rule") == F.col("p.rule")) & ratchet_selector(F.col("s.selector")).eqNullSafe(ratchet_selector(F.col("p.own")))
    state = state.alias("s").join(policies, same).select("s.rule", F.col("p.own").alias("selector"), "s.path", "value", "reason", "declared", "locked")
    columns = ("kind", "id", "finding_rule", "category", "debt", "one_id", "one_rule")
    spec = F.broadcast(files.sparkSession.createDataFrame([(r, *s) for r, s in COUNTED.items()], "rule string, " + ", ".join(f"{c} string" for c in columns)))
    debt = F.coalesce("debt", F.when(F.col("kind") == "method", said("uses of denied method ", F.col("selector"), "()")).otherwise(said("uses of denied macro ", F.col("selector"), "!")))
    row = state.join(spec, "rule").withColumn("debt", debt)
    value, held, docs = F.col("value"), F.col("locked"), F.col("rule") == "rust.module-docs"
    drift = F.when(value.isNull(), F.when(~docs, said(F.col("debt"), " ratchet names missing governed source ", quoted(F.col("path"))))).when(
        value == 0, F.when(~docs, said(F.col("debt"), " was removed but the source retains a stale ratchet"))).when(
        held.isNull(), F.when(~docs, said("reviewed ", F.col("debt"), f" ratchet is absent from {LOCK}"))).when(
        value > held, said(F.col("debt"), " grew from the ", held, "-construct ratchet to ", value)).when(
        (value < held) & ~docs, said(F.col("debt"), " shrank to ", value, " constructs but the lock still permits ", held))
    drifted = row.filter("declared").withColumn("text", drift).filter("text is not null")
    free = state.filter(~F.col("declared") & (value > 0)).select("rule", F.coalesce("selector", F.lit("")).alias("s"), "path")
    each = occurrences(files, facts, rust).withColumn("s", F.coalesce("selector", F.lit(""))).join(free, ["rule", "s", "path"], "left_semi").join(spec, "rule")
    kind, name = F.col("kind"), F.col("name")
    text = F.when(kind == "method", said("production source uses denied method ", name, "()")).when(kind == "macro", said("production source uses denied macro ", name, "!")).when(
        kind == "suppression", said("production source suppresses a compiler or Clippy lint", F.when(name == UNREASONED, F.lit(" without a reason")).otherwise(F.lit("")))).when(
        kind == "unsafe", said("production source contains ", name)).when(kind == "test", said("production source contains test construct ", name)).otherwise(F.lit("Rust source is missing its module contract (`//!`)"))
    one = finding(each, F.col("one_id"), F.col("one_rule"), "", text, F.col("path"), F.col("span"), analysis=F.col("quality"), emit=("rule", "s", "path", "ordinal"))
    many = finding(drifted, F.col("id"), F.col("finding_rule"), "", F.col("text"), F.col("path"), reason=F.col("reason"), emit=("rule", F.coalesce("selector", F.lit("")), "path"))
    category = F.when(F.col("id").startswith("RUST-HYG"), "source-hygiene").when(F.col("id").startswith("RUST-DOC"), "source-shape").otherwise("test-placement")
    return _all([one, many]).withColumn("category", category)


def role_findings(files: DataFrame, roles: list[dict]) -> DataFrame:
    """RUST-ROLE-001 to -003: overrides of roles for files that no target reaches, that may not be changed, or that change nothing (N12, R22). roles: path, role, reason."""
    own = small(policy(files.sparkSession, roles, "path string, role string, reason string"), len(roles))
    there = own.join(files.filter("bits <> 0").dropDuplicates(["path"]).select("path", "class"), "path", "left")
    may = F.col("class").isin("facade", "implementation") | ((F.col("class") == "entrypoint") & (F.col("role") == "implementation"))
    told = lambda df, id_, text: finding(df, id_, "rust.file-role", "source-shape", text, F.col("path"), reason=F.col("reason"), emit=("ord",))
    return _all([
        told(there.filter("class is null"), "RUST-ROLE-001", said("file-role override names missing reachable Rust source ", quoted(F.col("path")))),
        told(there.filter(F.col("class").isNotNull() & ~may), "RUST-ROLE-002", said("inferred ", F.col("class"), " source may not be reclassified as ", F.col("role"))),
        told(there.filter(may & (F.col("class") == F.col("role"))), "RUST-ROLE-003", said("file-role override redundantly declares inferred ", F.col("class"), " role")),
    ])


def facade_findings(files: DataFrame, facts: DataFrame, roles: DataFrame, facades: str, entrypoints: str) -> DataFrame:
    """RUST-FACADE-001: implementation in files that are to declare only (R23). roles(path, role) override inferred classes; facts of kind facade."""
    of = files.join(roles.select("path", F.col("role").alias("declared")), "path", "left").select("path", effective_role(F.col("class"), F.col("declared")).alias("role"))
    on = [r for r, mode in (("facade", facades), ("entrypoint", entrypoints)) if mode == "declarative"]
    rows = facts.filter("kind = 'facade'").join(of.filter(F.col("role").isin(on)), "path")
    entry = F.col("role") == "entrypoint"
    return finding(rows, "RUST-FACADE-001", F.when(entry, "rust.entrypoints").otherwise("rust.facades"), "source-shape", said("declarative ", F.col("role"), " contains implementation item ", F.col("name")), F.col("path"), F.col("span"), help_="move implementation behind a named module boundary", analysis=F.col("quality"), emit=("path", "ordinal"))


def sibling_test(path: Column) -> Column:
    return path.endswith("_test.rs") & F.array_contains(F.split(path, "/"), "src")


def placement_findings(files: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """RUST-TEST-002 to -004 on sibling tests.

    edges(child, ord, parent, span, bits, test_only): module edges in their order, bits their reachability, test_only whether
    their guard holds in tests alone. modules(path, ordinal, name, span): module declarations.
    """
    tests = files.filter(sibling_test(F.col("path"))).select("path", "bits")
    to = edges.groupBy(F.col("child").alias("path")).agg(F.min_by(F.struct("parent", "span"), "ord").alias("first"), F.bool_or(F.col("test_only") & is_test_only(F.col("bits"))).alias("proper"))
    reached = tests.filter(is_non_test_target(F.col("bits")))
    rest = tests.filter(~is_non_test_target(F.col("bits"))).join(to, "path", "left").filter(~(is_test_only(F.col("bits")) & F.coalesce("proper", F.lit(False))))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"[.]rs$", "")
    lost = rest.filter("first is null").withColumn("stem", stem)
    named = modules.groupBy(F.col("name").alias("stem")).agg(F.min_by(F.struct(F.col("path").alias("at"), "span"), F.struct("path", "ordinal")).alias("m"))
    lost = lost.join(named, "stem", "left")
    told = lambda df, id_, rule, text, path, span=None: finding(df, id_, rule, "test-placement", text, path, span, emit=("path",))
    return _all([
        told(reached, "RUST-TEST-004", "rust.tests.reachability", said("sibling test ", F.col("path"), " is reachable by production code"), F.col("path")),
        told(rest.filter("first is not null"), "RUST-TEST-002", "rust.tests.declaration", said("sibling test ", F.col("path"), " is declared without #[cfg(test)]"), F.col("first.parent"), F.col("first.span")),
        told(lost.filter("m is not null"), "RUST-TEST-003", "rust.tests.path", said("module ", F.col("stem"), " does not resolve to sibling test ", F.col("path")), F.col("m.at"), F.col("m.span")),
        told(lost.filter("m is null"), "RUST-TEST-002", "rust.tests.declaration", said("sibling test ", F.col("path"), " has no reachable #[cfg(test)] module declaration"), F.col("path")),
    ])
