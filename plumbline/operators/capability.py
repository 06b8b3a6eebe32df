"""Scopes, effect profiles and owners of source (R7, R8, R11 to R15; J4 to J6, J14, N4, N5) over fact tables.

files(path, packages, bits); facts(path, kind, ordinal, name, canonical, span, quality, guard), where kind is path, call or
macro and guard is the fact's condition with `test` false, in three values; operations(path, kind, ordinal, name, canonical,
span, quality, guard, method); expansions(path, ordinal, name, span, guard, closed): macro expansions, closed naming the owner kinds
whose operations a review excludes.

Policies travel to the data: globs of paths meet distinct paths once, and facts then meet policy by path, so that no fact is
compared with a policy that doesn't govern its file.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.predicates import normalized_path, path_matches, policy_names, production_applicable, quoted
from plumbline.operators.findings import finding, matched, patterns, policy, said, small
from plumbline.sources.shared import discard, materialize

#: Selectors of owners up to this many also filter facts before these meet their files; beyond it they only travel as a policy.
MAX_FILTERS = 64

SCOPES = "name string, include array<string>, exclude array<string>, deny array<string>, reason string"
PROFILES = "name string, reachability string, effects array<string>"
OWNERS = "name string, kind string, reachability string, within array<string>, selector string, mutating_methods array<string>, allow array<string>, reason string"

#: The identities that give an effect, in the order they are looked for.
EFFECT_TOKENS = {
    "Filesystem": ("std::fs",), "CompileFilesystem": (), "CompileEnvironment": (), "Network": ("std::net", "std::os::unix::net"),
    "Process": ("std::process", "tokio::process"), "Synchronization": ("std::sync", "tokio::sync"), "Thread": ("std::thread",),
    "WallClock": ("std::time::Instant", "std::time::SystemTime"), "AsyncRuntime": ("tokio", "async_std", "smol"),
    "Database": ("sqlx", "diesel", "rusqlite"), "ContainerRuntime": ("bollard", "containerd_client", "docker_api"),
    "Environment": ("std::env",), "Randomness": ("rand", "getrandom"),
}

#: Which operations each kind of owner governs; a receiver call only by a method that mutates.
GOVERNS = {
    "TypeConstruction": ("TypeConstruction", "ConstructorCapability"), "MethodName": ("MethodCall",), "FieldRead": ("FieldRead",), "FieldWrite": ("FieldWrite",),
    "FieldMutableBorrow": ("FieldMutableBorrow",), "FieldMutation": ("FieldWrite", "FieldMutableBorrow", "FieldReceiverCall"), "FieldAuthority": ("FieldRead", "FieldWrite", "FieldMutableBorrow"),
}

#: How messages name what an owner of each kind governs: the resource, the operation, and a use of it.
WORDS = {
    "Call": ("call authority", "call", "direct invocation"), "Capability": ("capability", "capability use", "use"),
    "TypeConstruction": ("type construction authority", "type construction", "construction"), "MethodName": ("written method-name authority", "written method call", "call with the written method name"),
    "FieldRead": ("field-read authority", "field read", "field read"), "FieldWrite": ("field-write authority", "field write", "field write"),
    "FieldMutableBorrow": ("field mutable-borrow authority", "field mutable borrow", "field mutable borrow"),
    "FieldMutation": ("field-mutation authority", "field mutation", "field mutation"), "FieldAuthority": ("field authority", "field access", "field access"),
    "Directory": ("directory authority", "directory use", "directory use"),
}


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _with_names(facts: DataFrame) -> DataFrame:
    return facts.withColumn("names", policy_names(F.col("canonical"), F.col("name")))


def applies(reachability: Column, bits: Column, guard: Column) -> Column:
    return (reachability == "all") | production_applicable(bits, guard)


def governed(files: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(path, ord): files that fit one of the globs of a policy row, once each."""
    return matched(files.select("path").distinct(), patterns(rows, column)).select("path", "ord").distinct()


def unmatched(files: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """(ord, at, pattern) of the globs that no file fits."""
    globs = patterns(rows, column)
    return globs.join(matched(files.select("path").distinct(), globs).select("ord", "at").distinct(), ["ord", "at"], "left_anti").select("ord", "at", "pattern")


def scope_files(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """(path, ord): files that a scope includes and doesn't exclude."""
    return governed(files, scopes, "include").join(governed(files, scopes, "exclude"), ["path", "ord"], "left_anti")


def scope_findings(files: DataFrame, facts: DataFrame, scopes: list[dict]) -> DataFrame:
    """CAP-001 to -003: denied symbols in scopes; scopes with a pattern that fits no file, or without files, which are passed over."""
    spark = files.sparkSession
    own = policy(spark, scopes, SCOPES)
    told = small(own.select("ord", F.col("name").alias("scope"), "reason"), len(scopes))
    no_include, no_exclude = (unmatched(files, own, c).join(told, "ord") for c in ("include", "exclude"))
    stale = no_include.select("ord").union(no_exclude.select("ord")).distinct()
    inside = scope_files(files, own).join(stale, "ord", "left_anti")
    empty = told.join(stale, "ord", "left_anti").join(inside.select("ord").distinct(), "ord", "left_anti")
    denied = small(own.select("ord", F.col("name").alias("scope"), "reason", F.posexplode("deny").alias("deny_at", "denied")), len(scopes))
    seen = _with_names(facts.filter(F.col("kind").isin("path", "macro"))).join(inside, "path").join(denied, "ord")
    hits = seen.filter(path_matches(F.col("denied"), F.col("names"), F.col("quality")))
    scope, reason = F.col("scope"), F.col("reason")
    return _all([
        finding(no_include, "CAP-002", scope, "capability", said("scope include ", quoted(F.col("pattern")), " matches no Rust source"), reason=reason, emit=("ord", F.lit(0), "at")),
        finding(no_exclude, "CAP-003", scope, "capability", said("scope exclusion ", quoted(F.col("pattern")), " matches no Rust source"), reason=reason, emit=("ord", F.lit(1), "at")),
        finding(empty, "CAP-002", scope, "capability", F.lit("capability scope matches no Rust source after exclusions"), reason=reason, emit=("ord", F.lit(2))),
        finding(hits, "CAP-001", scope, "capability", said("source reaches denied symbol ", F.col("name")), F.col("path"), F.col("span"), reason, "move the effect to its owning adapter and pass facts inward", F.col("quality"), emit=("ord", F.lit(3), "path", "deny_at", F.col("kind") == "macro", "ordinal")),
    ])


def assigned_profiles(files: DataFrame, packages: DataFrame, layers: list[dict]) -> DataFrame:
    """(path, profile) of each file: those of the layers of its packages, or of the package of the longest directory that holds it."""
    spark = files.sparkSession
    own = policy(spark, layers, "name string, packages array<string>, profiles array<string>")
    by_layer = matched(packages.select(F.col("name").alias("path")), patterns(own, "packages")).select(F.col("path").alias("package"), "ord").distinct()
    of_package = by_layer.join(small(own.select("ord", F.explode("profiles").alias("profile")), len(layers)), "ord").select("package", "profile").distinct()
    known = files.filter(F.size("packages") > 0).select("path", F.explode("packages").alias("package"))
    parts = F.split("path", "/")
    above = F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    held = files.filter(F.size("packages") == 0).select("path", F.explode(above).alias("directory")).join(packages.select("directory", F.col("name").alias("package")), "directory")
    nearest = held.groupBy("path").agg(F.max_by("package", F.length("directory")).alias("package"))
    return known.unionByName(nearest.select("path", "package")).join(of_package, "package").select("path", "profile").distinct()


def effect_findings(files: DataFrame, facts: DataFrame, packages: DataFrame, layers: list[dict], profiles: list[dict]) -> DataFrame:
    """EFFECT-001, once for each path, span, profile and effect (R8): the first identity and the first fact that give the effect."""
    spark = files.sparkSession
    own = policy(spark, profiles, PROFILES)
    tokens = spark.createDataFrame([(e, i, t) for e, ts in EFFECT_TOKENS.items() for i, t in enumerate(ts)], "effect string, token_at int, token string")
    denied = own.select(F.col("name").alias("profile"), "reachability", F.posexplode("effects").alias("effect_at", "effect")).join(F.broadcast(tokens), "effect")
    governed_files = assigned_profiles(files, packages, layers).join(files.select("path", "bits"), "path")
    seen = _with_names(facts.filter("kind = 'path'")).join(governed_files, "path").join(small(denied, len(profiles)), "profile")
    hits = seen.filter(applies(F.col("reachability"), F.col("bits"), F.col("guard")) & path_matches(F.col("token"), F.col("names"), F.col("quality")))
    first = hits.groupBy("path", "span", "profile", "effect", "effect_at").agg(F.min(F.struct("token_at", "ordinal", "name", "quality")).alias("f"))
    return finding(
        first, "EFFECT-001", said("profile.", F.col("profile")), "effect", said("profile ", quoted(F.col("profile")), " denies ", F.col("effect"), ", provided here by ", F.col("f.name")), F.col("path"), F.col("span"),
        help_="acquire the effect in an outer adapter and inject an explicit capability", analysis=F.col("f.quality"), emit=("path", "profile", "effect_at", "f.token_at", "f.ordinal"),
    )


def call_evidence(calls: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, and the paths with a span that aren't a call of the same span and name, as references (J14); keys are the rows' own."""
    span = paths.filter("span is not null").join(calls.select(*keys, "span", "name").distinct(), [*keys, "span", "name"], "left_anti")
    return calls.withColumn("evidence", F.lit("call")).unionByName(span.withColumn("evidence", F.lit("reference")))


def _last(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "::"), -1), "^r#", "")


def operation_matches(selector: Column, owner_kind: Column, name: Column, canonical: Column, names: Column, quality: Column, kind: Column) -> Column:
    """An owner's selector against an operation's identity: the written name of a method; else a prefix of whole segments, the last segment
    of one that isn't resolved, or a read of some unnamed field of the selector's type."""
    open_ = (quality != "exact") & (F.coalesce(F.size(canonical), F.lit(0)) == 0)
    base = F.regexp_replace(selector, "::[^:]*$", "")

    def any_field(n: Column) -> Column:
        of = F.regexp_replace(n, r"::\*$", "")
        return n.endswith("::*") & ((normalized_path(base) == normalized_path(of)) | (of == "<unresolved>") | (open_ & (_last(base) == _last(of))))

    reads = owner_kind.isin("FieldRead", "FieldAuthority") & (kind == "FieldRead") & (quality != "exact") & selector.contains("::")
    whole = (reads & F.exists(names, any_field)) | path_matches(selector, names, quality) | (open_ & (_last(selector) == _last(name)))
    return F.when(owner_kind == "MethodName", normalized_path(selector) == normalized_path(name)).otherwise(whole)


def _selected(rows: DataFrame, fits: list[Column]) -> DataFrame:
    """The rows that some owner's selector fits: a filter on their own columns, which the engine takes to where they are read."""
    if len(fits) > MAX_FILTERS:
        return rows
    return rows.filter(reduce(Column.__or__, fits, F.lit(False)))


def owner_evidence(files: DataFrame, facts: DataFrame, operations: DataFrame, owners: DataFrame, n_owners: int) -> DataFrame:
    """(ord, path, evidence, kind, ordinal, name, span, quality) of what each owner governs in the files within it (J4); a stored table.

    Facts and operations are read once each, and only those that some selector fits leave where they are read.
    """
    spark = files.sparkSession
    within = governed(files, owners, "within").join(files.select("path", "bits"), "path")
    o = small(owners.select("ord", F.col("kind").alias("owner_kind"), "reachability", "selector", "mutating_methods"), n_owners)
    selectors = sorted({(r.kind, r.selector) for r in owners.filter("selector is not null").select("kind", "selector").collect()})  # a policy's rows
    base = ["ord", "path", "kind", "ordinal", "name", "span", "quality"]
    named = _with_names(facts.filter("kind in ('path', 'call')"))
    named = _selected(named, [path_matches(F.lit(x), F.col("names"), F.col("quality")) for x in sorted({x for k, x in selectors if k in ("Call", "Capability")})])
    plain = named.join(within, "path").join(o, "ord").filter("owner_kind in ('Call', 'Capability')")
    plain = plain.filter(applies(F.col("reachability"), F.col("bits"), F.col("guard")) & path_matches(F.col("selector"), F.col("names"), F.col("quality")))
    pairs = F.broadcast(spark.createDataFrame([(k, x) for k, xs in GOVERNS.items() for x in xs], "owner_kind string, kind string"))
    fits = lambda selector, owner_kind: operation_matches(selector, owner_kind, F.col("name"), F.col("canonical"), F.col("names"), F.col("quality"), F.col("kind"))
    ops = _selected(_with_names(operations), [F.col("kind").isin(*GOVERNS[k]) & fits(F.lit(x), F.lit(k)) for k, x in selectors if k in GOVERNS])
    ops = ops.join(within, "path").join(o, "ord").join(pairs, ["owner_kind", "kind"])
    mutates = (F.col("kind") != "FieldReceiverCall") | F.coalesce(F.array_contains("mutating_methods", F.col("method")), F.lit(False))
    ops = ops.filter(mutates & applies(F.col("reachability"), F.col("bits"), F.col("guard")) & fits(F.col("selector"), F.col("owner_kind")))
    hits, path = materialize(_all([x.select(*base, "owner_kind", F.lit(is_op).alias("is_op")) for x, is_op in ((plain, False), (ops, True))]), "owner-hits")
    paths = hits.filter("not is_op and kind = 'path'")
    capability = paths.filter("owner_kind = 'Capability'").select(*base, F.lit("use").alias("evidence"))
    calls = call_evidence(hits.filter("not is_op and owner_kind = 'Call' and kind = 'call'").select(*base), paths.filter("owner_kind = 'Call'").select(*base), ["ord", "path"])
    spanless = paths.filter("owner_kind = 'Call' and span is null").select(*base, F.lit("path").alias("evidence"))
    found, _ = materialize(_all([capability, calls, spanless, hits.filter("is_op").select(*base, F.lit("operation").alias("evidence"))]), "owner-evidence")
    discard(spark, path)
    return found


def owner_findings(files: DataFrame, facts: DataFrame, operations: DataFrame, expansions: DataFrame, owners: list[dict]) -> DataFrame:
    """OWN-002 to -006: uses outside an owner's files, doubtful ones inside, and policy that fits nothing."""
    spark, n = files.sparkSession, len(owners)
    own = policy(spark, owners, OWNERS).filter("kind <> 'Directory'").withColumn("reachability", F.coalesce("reachability", F.lit("all")))
    words = spark.createDataFrame([(k, *w) for k, w in WORDS.items()], "kind string, resource string, operation string, a_use string")
    told = small(own.join(F.broadcast(words), "kind").select("ord", F.col("name").alias("owner"), F.col("kind").alias("owner_kind"), "reachability", "selector", "reason", F.array_join("allow", ", ").alias("allowed"), "resource", "operation", "a_use"), n)
    allow = small(own.select("ord", F.explode(F.array_distinct("allow")).alias("path")), n)
    within = governed(files, own, "within")
    stale = unmatched(files, own, "within").join(told, "ord")
    missing = allow.join(within, ["ord", "path"], "left_anti").join(told, "ord")
    found = owner_evidence(files, facts, operations, own, n)
    inside = found.join(allow, ["ord", "path"], "left_semi")
    outside = found.join(allow, ["ord", "path"], "left_anti")
    # Outside, a call owner's paths count only in files without a matching call; its references are paths as well (no other owner has either).
    has_call = outside.filter("evidence = 'call'").select("ord", "path").distinct()
    plain = outside.filter("evidence not in ('reference', 'path')")
    fallback = outside.filter("evidence in ('reference', 'path')").join(has_call, ["ord", "path"], "left_anti")
    used_outside = plain.unionByName(fallback).join(told, "ord")  # what is told of an owner may be long: last
    of = {"path": F.col("path"), "span": F.col("span"), "reason": F.col("reason"), "analysis": F.col("quality")}
    order = ("ord", F.lit(1), "path", "ordinal")
    # Inside, a file gives one finding: of its first reference, else of its first call that isn't exact, or operation.
    evidence = inside.join(told, "ord")
    rank = F.when(F.col("evidence") == "reference", 0).when((F.col("evidence") == "call") & (F.col("quality") != "exact"), 1)
    call = evidence.filter("owner_kind = 'Call'").withColumn("rank", rank).filter("rank is not null")
    first = lambda rows, by: rows.withColumn("_n", F.row_number().over(Window.partitionBy("ord", "path").orderBy(*by))).filter("_n = 1")
    call = first(call, ("rank", "ordinal"))
    detail = F.when(F.col("rank") == 0, F.lit("is referenced outside a direct invocation")).otherwise(F.lit("cannot be resolved to an exact direct invocation"))
    doubtful = first(evidence.filter("evidence = 'operation' and owner_kind <> 'MethodName' and quality <> 'exact'"), ("ordinal",))
    opened = expansions.join(within, "path").join(files.select("path", "bits"), "path").join(told.filter(F.col("owner_kind").isin(list(GOVERNS))), "ord")
    opened = opened.filter(applies(F.col("reachability"), F.col("bits"), F.col("guard")) & ~F.array_contains(F.coalesce("closed", F.array().cast("array<string>")), F.col("owner_kind"))).withColumn("quality", F.lit("unresolved"))
    open_in, open_out = (opened.join(allow, ["ord", "path"], how) for how in ("left_semi", "left_anti"))
    used = inside.filter("evidence <> 'path'").select("ord", "path").union(open_in.select("ord", "path")).distinct()
    unused = allow.join(files.select("path").distinct(), "path", "left_semi").join(used, ["ord", "path"], "left_anti").join(told, "ord")
    idle = F.when(F.col("reachability") == "production", said("allowed owner ", quoted(F.col("path")), " has no production-reachable use of ", F.col("selector"))).otherwise(said("allowed owner ", quoted(F.col("path")), " reaches no ", F.col("a_use"), " of ", F.col("selector")))
    owner = F.col("owner")
    may = said("macro expansion ", F.col("name"), " may emit owned ", F.col("operation"), " ", F.col("selector"))
    return _all([
        finding(stale, "OWN-004", owner, "ownership", said("owner scope ", quoted(F.col("pattern")), " matches no Rust source"), reason=F.col("reason"), emit=("ord", F.lit(0), "at")),
        finding(missing, "OWN-002", owner, "ownership", said("owner policy names missing Rust source ", quoted(F.col("path"))), F.col("path"), reason=F.col("reason"), emit=("ord", F.lit(0), "path")),
        finding(used_outside, "OWN-003", owner, "ownership", said("source reaches owned ", F.col("resource"), " ", F.col("name"), "; allowed owner: ", F.col("allowed")), **of, emit=order),
        finding(call, "OWN-005", owner, "ownership", said("owned call ", F.col("selector"), " ", detail), **of, help_="invoke the owned call directly so that its authority boundary can be verified", emit=order),
        finding(doubtful, "OWN-006", owner, "ownership", said("owned ", F.col("operation"), " ", F.col("selector"), " cannot be resolved to one exact Rust identity"), **of, help_="use an exact type or receiver identity at the ownership boundary", emit=order),
        finding(open_in, "OWN-006", owner, "ownership", said(may, ", but its source operations are opaque"), **of, emit=("ord", F.lit(2), "path", "ordinal")),
        finding(open_out, "OWN-003", owner, "ownership", said(may, "; allowed owner: ", F.col("allowed")), **of, emit=("ord", F.lit(2), "path", "ordinal")),
        finding(unused, "OWN-004", owner, "ownership", idle, F.col("path"), reason=F.col("reason"), emit=("ord", F.lit(3), "path")),
    ])
