"""Rule evaluators as findings: dependencies (R5, G1, G2), sizes (R28) and a report of them (K1)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.predicates import quoted
from plumbline.operators import graph, relate
from plumbline.operators.findings import FINDING, finding, matched, patterns, policy, said, small, union, with_fingerprint

LAYERS = "name string, packages array<string>, may_depend_on array<string>, external string, reason string"
DEPENDENCY_RULES = "name string, `from` string, deny array<string>, reachability string, kinds array<string>, reason string"
KIND = {"normal": 0, "development": 1, "build": 2}
LOCK = "the lock file"


def manifest_path(directory: Column) -> Column:
    return F.when(directory == ".", "Cargo.toml").otherwise(F.concat(directory, F.lit("/Cargo.toml")))


def layer_matches(packages: DataFrame, layers: DataFrame) -> DataFrame:
    """(package, directory, layers) of each package: the layers whose patterns fit its name, in their order."""
    globs = patterns(layers, "packages")
    fits = matched(packages.select(F.col("name").alias("path")), globs).select(F.col("path").alias("package"), "ord").distinct()
    named = fits.join(small(layers.select("ord", F.col("name").alias("layer")), layers.count()), "ord")
    own = named.groupBy("package").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "layer"))), lambda x: x["layer"]).alias("layers"))
    return packages.select(F.col("name").alias("package"), "directory").join(own, "package", "left").withColumn("layers", F.coalesce("layers", F.array().cast("array<string>")))


def members_findings(declared: DataFrame, observed: DataFrame) -> list[DataFrame]:
    """DEP-001 and -002 over declared(member) and observed(member)."""
    apart = relate.membership(declared, observed, ["member"])
    rule, category, name = "cargo.workspace-members", "dependency", quoted(F.col("member"))
    return [
        finding(apart.filter("finding = 'undeclared'"), "DEP-001", rule, category, said("Cargo package ", name, " is absent from workspace.members"), said(F.col("member"), "/Cargo.toml"), emit=("member",)),
        finding(apart.filter("finding = 'missing'"), "DEP-002", rule, category, said("workspace.members names missing package directory ", name), emit=("member",)),
    ]


def dependency_findings(packages: DataFrame, deps: DataFrame, layers: list[dict], unassigned: str = "deny", rules: list[dict] = (), resolved: dict | None = None, members: tuple[DataFrame, DataFrame] | None = None, cycles: str = "deny") -> DataFrame:
    """The dependency rule: DEP-001 to -011.

    packages(name, directory), deps(package, ordinal, alias, name, kind, internal_package); layers: name, packages (globs of
    package names), may_depend_on, external ('none' or not), reason. Packages in no layer or in several take no part in edge
    rules. rules and resolved: see `denied_findings`. members: declared(member) and observed(member).
    """
    spark = packages.sparkSession
    own = policy(spark, layers, LAYERS)
    matches = layer_matches(packages, own)
    n, where = F.size("layers"), manifest_path(F.col("directory"))
    category, name = "dependency", quoted(F.col("package"))
    out = members_findings(*members) if members else []
    globs = patterns(own, "packages")
    live = matched(packages.select(F.col("name").alias("path")), globs).select("ord", "at").distinct()
    stale = globs.join(live, ["ord", "at"], "left_anti").join(own.select("ord", F.col("name").alias("layer"), "reason"), "ord")
    out.append(finding(stale, "DEP-010", "dependency.package-layer", category, said("layer ", quoted(F.col("layer")), " package selector ", quoted(F.col("pattern")), " matches no Cargo package"), reason=F.col("reason"), help_="remove the stale selector or correct its package pattern", emit=("ord", "at")))
    if unassigned == "deny":
        out.append(finding(matches.filter(n == 0), "DEP-003", "dependency.package-layer", category, said("package ", name, " is not assigned to an architecture layer"), where, emit=("package",)))
    out.append(finding(matches.filter(n > 1), "DEP-004", "dependency.package-layer", category, said("package ", name, " matches multiple architecture layers"), where, emit=("package",)))
    assigned = matches.filter(n == 1).select("package", F.get("layers", F.lit(0)).alias("layer"), "directory")
    edges = deps.join(assigned, "package").join(small(own.select(F.col("name").alias("layer"), "may_depend_on", "external", "reason"), len(layers)), "layer")
    to = assigned.select(F.col("package").alias("internal_package"), F.col("layer").alias("to_layer"))
    may = F.coalesce("may_depend_on", F.array().cast("array<string>"))
    denied = edges.join(to, "internal_package").filter((F.col("to_layer") != F.col("layer")) & ~F.array_contains(may, F.col("to_layer")))
    out.append(finding(denied, "DEP-005", "dependency.layer-edge", category, said("package ", F.col("package"), " in layer ", F.col("layer"), " may not depend on ", F.col("internal_package"), " in layer ", F.col("to_layer")), where, reason=F.col("reason"), emit=("package", "ordinal")))
    outside = edges.filter("internal_package is null and external = 'none'")
    out.append(finding(outside, "DEP-006", "dependency.external", category, said("package ", F.col("package"), " in layer ", F.col("layer"), " has ", F.col("kind"), " external dependency ", F.col("alias")), where, reason=F.col("reason"), emit=("package", "ordinal")))
    if rules:
        out.append(denied_findings(packages, deps, rules, resolved))
    if cycles == "deny":
        rings = graph.witnesses(deps.filter("internal_package is not null").select(F.col("package").alias("src"), F.col("internal_package").alias("dst")))
        out.append(finding(rings, "DEP-009", "dependency.cycles", category, said("workspace dependency cycle: ", F.array_join("cycle", " -> ")), emit=("component",)))
    return union(out)


def denied_findings(packages: DataFrame, deps: DataFrame, rules: list[dict], resolved: dict | None = None) -> DataFrame:
    """DEP-007, -008 and -011: what a package may not depend on, directly or over others (G1).

    rules: name, from (a package), deny (names), reachability ('direct' or 'transitive'), kinds of the first edge (none: all),
    reason. resolved: nodes(node, name, version, source, checksum), edges(src, dst), roots(package, node),
    mapping(package, ordinal, matches, node): what each manifest dependency resolves to (J8). Without it a direct rule reads the
    manifests, and a transitive one can't be decided.
    """
    spark = packages.sparkSession
    own = policy(spark, list(rules), DEPENDENCY_RULES).withColumns({"kinds": F.coalesce("kinds", F.array().cast("array<string>")), "reachability": F.coalesce("reachability", F.lit("direct"))})
    own = small(own.select(F.col("ord").alias("rule_ord"), F.col("name").alias("rule_name"), F.col("from").alias("package"), "deny", "reachability", "kinds", "reason"), len(rules))
    there = packages.select(F.col("name").alias("package"), "directory")
    out = [finding(own.join(there, "package", "left_anti"), "DEP-007", F.col("rule_name"), "dependency", said("dependency rule names missing package ", quoted(F.col("package"))), emit=("rule_ord",))]
    ruled = own.join(there, "package")
    where = manifest_path(F.col("directory"))
    chosen = (F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind"))
    help_ = "regenerate the lock from reviewed manifests or narrow the ambiguous declaration"
    if resolved is None:
        out.append(finding(ruled.filter("reachability = 'transitive'"), "DEP-011", F.col("rule_name"), "dependency", F.lit("transitive dependency policy requires Cargo.lock"), where, reason=F.col("reason"), help_=help_, emit=("rule_ord",)))
        direct = ruled.filter("reachability = 'direct'").join(deps.select("package", "ordinal", "kind", F.col("name").alias("dep")), "package").filter(chosen & F.array_contains("deny", F.col("dep")))
        out.append(finding(direct, "DEP-008", F.col("rule_name"), "dependency", said("package ", F.col("package"), " has explicitly denied ", F.col("kind"), " dependency ", F.col("dep")), where, reason=F.col("reason"), emit=("rule_ord", "ordinal")))
        return reduce(DataFrame.unionByName, out)
    nodes = resolved["nodes"].select("*", F.row_number().over(Window.orderBy("name", "version", "source", F.coalesce("checksum", F.lit("")))).alias("rank"))  # a lock has at most 100,000
    rank = lambda node, as_: nodes.select(F.col("node").alias(node), F.col("rank").alias(as_))
    first = ruled.join(deps.select("package", "ordinal", "kind", "alias"), "package").filter(chosen).join(resolved["mapping"], ["package", "ordinal"], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    unclear = first.filter("matches <> 1").groupBy("rule_ord").agg(F.min(F.struct("ordinal", "matches", "alias")).alias("m"))
    nowhere = ruled.join(resolved["roots"].select("package", F.col("node").alias("root")), "package", "left")
    no_root = nowhere.filter("root is null")
    out.append(finding(no_root, "DEP-011", F.col("rule_name"), "dependency", said("Cargo.lock contains no local node for workspace package ", quoted(F.col("package"))), where, reason=F.col("reason"), help_=help_, emit=("rule_ord",)))
    failed = nowhere.filter("root is not null").join(unclear, "rule_ord")
    what = said("manifest dependency ", quoted(F.col("m.alias")), " from package ", quoted(F.col("package")), F.when(F.col("m.matches") == 0, F.lit(" maps to no outgoing Cargo.lock node")).otherwise(said(" maps ambiguously to ", F.col("m.matches"), " Cargo.lock nodes")))
    out.append(finding(failed, "DEP-011", F.col("rule_name"), "dependency", what, where, reason=F.col("reason"), help_=help_, emit=("rule_ord",)))
    sound = nowhere.filter("root is not null").join(unclear, "rule_ord", "left_anti")
    kind = F.create_map(*[x for k, v in KIND.items() for x in (F.lit(k), F.lit(v))])
    roots = sound.join(rank("root", "root_rank"), "root").select("rule_ord", "root_rank")
    begin = first.join(roots, "rule_ord").join(rank("node", "start"), "node").filter("start <> root_rank")
    begin = begin.select("rule_ord", F.col("start").alias("node"), F.array(kind[F.col("kind")], "root_rank", "start").alias("path"))
    edges = resolved["edges"].join(rank("src", "s"), "src").join(rank("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), F.col("d").alias("ord"))
    deep = own.filter("reachability = 'transitive'").select("rule_ord")
    reached = graph.shortest_paths(edges, begin.join(deep, "rule_ord"), by=("rule_ord",)).select("rule_ord", "node", "path")
    near = begin.join(deep, "rule_ord", "left_anti").groupBy("rule_ord", "node").agg(F.min("path").alias("path"))
    labelled = nodes.select(F.col("rank").alias("node"), "name", said(F.col("name"), " ", F.col("version"), " (", F.col("source"), "; checksum=", F.coalesce("checksum", F.lit("none")), ")").alias("label"))
    hits = reached.unionByName(near).join(roots, "rule_ord").filter("node <> root_rank").join(labelled.select("node", "name"), "node").join(sound, "rule_ord").filter(F.array_contains("deny", F.col("name")))
    steps = hits.select("rule_ord", "rule_name", "package", "directory", "reason", "node", F.get("path", F.lit(0)).alias("kind"), F.posexplode(F.slice("path", 2, 1 << 30)).alias("at", "step"))
    told = steps.join(labelled.select(F.col("node").alias("step"), "label"), "step").groupBy("rule_ord", "rule_name", "package", "directory", "reason", "node", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), " -> ").alias("way"))
    kind_name = F.element_at(F.create_map(*[x for k, v in KIND.items() for x in (F.lit(v), F.lit(k))]), F.col("kind"))
    out.append(finding(told, "DEP-008", F.col("rule_name"), "dependency", said("package ", F.col("package"), " has denied resolved ", kind_name, " dependency path: ", F.col("way")), where, reason=F.col("reason"), emit=("rule_ord", "node")))
    return reduce(DataFrame.unionByName, out)


def size_findings(files: DataFrame, budgets: DataFrame, ratchets: DataFrame, locked: DataFrame) -> DataFrame:
    """The size rule: RUST-SIZE-001 over the hard ceiling, -002 over the design target (both, over both), -003 to -005 on ratchets.

    files(path, role, lines), budgets(role, target, hard), ratchets(path, reason), locked(path, value), the last two one row a
    path. A ratchet of the contract suppresses -001 and -002: without a locked value, or if the file grew, -003; if it shrank, or is no longer
    over its target (where a locked value alone is enough), -004; without a budget, or without the file, -005.
    """
    rule, category = "rust.file-size", "source-size"
    held = files.dropDuplicates(["path"]).join(budgets, "role", "left").join(ratchets.select("path", F.col("reason"), F.lit(True).alias("declared")), "path", "left").join(locked.select("path", "value"), "path", "left")
    any_ = F.col("declared").isNotNull() | F.col("value").isNotNull()
    lines, over = F.col("lines"), held.filter("lines > target")
    at = {"path": F.col("path"), "emit": ("path",)}
    mine = over.filter("declared")
    free = over.filter("declared is null")
    missing = ratchets.select("path").distinct().join(files.select("path").distinct(), "path", "left_anti")
    return union([
        finding(free.filter(lines > F.col("hard")), "RUST-SIZE-001", f"{rule}.hard", category, said("source is ", lines, " lines, above its absolute ", F.col("hard"), "-line ceiling"), **at),
        finding(free, "RUST-SIZE-002", f"{rule}.target", category, said("source is ", lines, " lines, above its ", F.col("target"), "-line design target"), **at),
        finding(mine.filter("value is null"), "RUST-SIZE-003", f"{rule}.ratchet", category, F.lit(f"reviewed ratchet is absent from {LOCK}"), reason=F.col("reason"), **at),
        finding(mine.filter(lines > F.col("value")), "RUST-SIZE-003", f"{rule}.ratchet", category, said("source grew from its ", F.col("value"), "-line ratchet to ", lines, " lines"), reason=F.col("reason"), **at),
        finding(mine.filter(lines < F.col("value")), "RUST-SIZE-004", f"{rule}.ratchet", category, said("source shrank to ", lines, " lines but lock still permits ", F.col("value")), **at),
        finding(held.filter("lines <= target").filter(any_), "RUST-SIZE-004", f"{rule}.ratchet", category, F.lit("file returned below its design target but retains a stale ratchet"), **at),
        finding(held.filter("target is null").filter(any_), "RUST-SIZE-005", rule, category, F.lit("file-size ratchet has no active size policy"), **at),
        finding(missing, "RUST-SIZE-005", rule, category, said("file-size ratchet names missing source ", quoted(F.col("path"))), **at),
    ])


def report_lines(findings: DataFrame) -> DataFrame:
    """Findings as JSON, one in each row, nulls kept, in a fixed order of fields."""
    return with_fingerprint(findings).select(F.to_json(F.struct(*FINDING, "fingerprint"), {"ignoreNullFields": "false"}).alias("value"))
