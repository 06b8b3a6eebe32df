"""Scalar predicates on paths, identities, guards and reachability, as column expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Limits of a pattern, and the bits of reachability.
MAX_PATTERN_BYTES, MAX_SEGMENTS = 4096, 256
REACH_BITS = {"production": 1, "test": 2, "benchmark": 4, "example": 8, "build": 16}


def _bytes(text: str) -> str:
    """A text as a string of one character for each byte of its UTF-8 form."""
    return text.encode().decode("latin-1")


def glob_regex(pattern: str) -> str | None:
    """A glob as an anchored regular expression over a path's bytes (one character each); None for a pattern over the limits.

    `?` is one byte but `/`, `*` any number of them, a whole segment `**` any number of segments, empty ones too. No
    escapes. Patterns are compiled once, on the driver; one over the limits matches nothing.
    """
    pattern = pattern.strip("/")
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        return None
    segments = _bytes(pattern).split("/") if pattern else []
    kept = [s for i, s in enumerate(segments) if not (s == "**" and i and segments[i - 1] == "**")]
    if len(kept) > MAX_SEGMENTS:
        return None
    if kept == ["**"]:
        return r"(?s)\A.*\z"
    out = ""
    for i, s in enumerate(kept):
        last = i == len(kept) - 1
        if s == "**":  # the slash goes with it
            out += "(?:/.*)?" if last else "(?:[^/]*/)*"
            continue
        one = "".join("[^/]" if c == "?" else "[^/]*" if c == "*" else re.escape(c) for c in s)
        out += one + ("" if last or kept[i + 1 :] == ["**"] else "/")
    return rf"(?s)\A{'(?=.)' if kept else ''}{out}\z"  # an empty path has no segment


def path_bytes(path: Column) -> Column:
    """A path without slashes at its ends, as glob_regex reads it."""
    return F.decode(F.encode(F.regexp_replace(path, r"\A/+|/+\z", ""), "UTF-8"), "ISO-8859-1")


def glob_matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path, without slashes at its ends, matches any pattern; null for a null path."""
    out = F.lit(False)
    for r in filter(None, map(glob_regex, patterns)):
        out = out | path_bytes(path).rlike(r)
    return F.when(path.isNotNull(), out)


def quoted(text: Column) -> Column:
    """A text in double quotes, with escapes for quotes, backslashes and line ends."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def normalized_path(name: Column) -> Column:
    """One leading `::`, then one leading `crate::`, then `r#` of each segment go."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^::", ""), "^crate::", ""), "(^|::)r#", "$1")


def policy_names(canonical: Column, name: Column) -> Column:
    return F.when(F.coalesce(F.size(canonical), F.lit(0)) == 0, F.array(name)).otherwise(canonical)


def path_matches(selector: Column, names: Column, quality: Column) -> Column:
    """An identity selector against a fact's names: equal, or a prefix of whole segments; where the quality isn't
    exact, also the other way round."""
    s = normalized_path(selector)

    def fits(n: Column) -> Column:
        n = normalized_path(n)
        return (n == s) | n.startswith(F.concat(s, F.lit("::"))) | ((quality != "exact") & s.startswith(F.concat(n, F.lit("::"))))

    return F.exists(names, fits)


def availability(guard: Column) -> Column:
    """A three-valued guard (null: unknown) as exact, possible or absent."""
    return F.when(guard.isNull(), "possible").when(guard, "exact").otherwise("absent")


def covers(have: Column, need: Column) -> Column:
    return have.bitwiseAND(need) == need


def is_test_only(bits: Column) -> Column:
    return bits == REACH_BITS["test"]


def reaches(bits: Column, kind: str) -> Column:
    return bits.bitwiseAND(F.lit(REACH_BITS[kind])) != 0


def is_non_test_target(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(31 - REACH_BITS["test"])) != 0


def reach_name(bits: Column) -> Column:
    """unreachable, test-only, production, both (production and test), or the kinds in order, by commas."""
    named = F.array_join(F.array_compact(F.array(*[F.when(reaches(bits, k), k) for k in REACH_BITS])), ",")
    return F.when(bits == 0, "unreachable").when(bits == 2, "test-only").when(bits == 3, "both").otherwise(named)


def production_applicable(bits: Column, guard: Column) -> Column:
    """Whether a fact counts for production policy: its file reaches production, and its guard, with `test` false, isn't false."""
    return reaches(bits, "production") & F.coalesce(guard, F.lit(True))


def ratchet_selector(selector: Column) -> Column:
    """A selector without `r#` at its segments."""
    return F.regexp_replace(selector, "(^|::)r#", "$1")


def relative_path(path: Column) -> Column:
    """A path without `.` segments and empty ones; null for one that is absolute, has a backslash or leaves its root."""
    kept = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    bad = path.startswith("/") | path.contains("\\") | F.exists(kept, lambda x: x == "..")
    return F.when(~bad, F.array_join(kept, "/"))


def effective_role(inferred: Column, declared: Column) -> Column:
    """An inferred class, or the one declared for the path: a facade or an implementation may be either, an entrypoint only an implementation."""
    open_ = inferred.isin("facade", "implementation") | ((inferred == "entrypoint") & (declared == "implementation"))
    return F.when(open_ & declared.isNotNull(), declared).otherwise(inferred)


def budget_role(class_: Column, bits: Column) -> Column:
    """Which budget governs a file: that of tests for a test-only file, else its class's; a generated file has its root's own."""
    role = F.when(class_ == "test", "implementation").when(class_ == "entrypoint", "auxiliary").otherwise(class_)
    return F.when((class_ != "generated") & is_test_only(bits), "test").otherwise(role)


def under_root(path: Column, root: Column) -> Column:
    return (root == ".") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def worst_quality(quality: Column) -> Column:
    """The worst of exact, conservative, unresolved in a group, by rank and not by spelling."""
    rank = F.when(quality == "exact", 0).when(quality == "conservative", 1).otherwise(2)
    return F.max_by(quality, rank)


def classify_path(path: Column, generated: list[str]) -> Column:
    """The first class that fits: generated, test, entrypoint, facade, auxiliary, implementation."""
    name = F.element_at(F.split(path, "/"), -1)
    roots = F.lit(False)
    for r in generated:
        roots = roots | under_root(path, F.lit(r))
    is_test = path.rlike("(^|/)tests/") | name.rlike("^tests[.]rs$|_tests?[.]rs$")
    ladder = ((roots, "generated"), (is_test, "test"), (name == "main.rs", "entrypoint"), (name.isin("lib.rs", "mod.rs"), "facade"), (path.rlike("(^|/)examples/|(^|/)src/bin/"), "auxiliary"))
    out = F.lit("implementation")
    for fits, cls in reversed(ladder):
        out = F.when(fits, cls).otherwise(out)
    return out


def fingerprint(id_: Column, rule: Column, path: Column, message: Column, span: list[Column] | None = None) -> Column:
    """SHA-256 of the four fields, each ended by a zero byte (a null path is empty), then a span's four numbers as
    8 little-endian bytes each, where all of them are given."""
    zero = F.unhex(F.lit("00"))
    parts = [x for f in (id_, rule, F.coalesce(path, F.lit("")), message) for x in (F.encode(f, "UTF-8"), zero)]
    if span is None:
        return F.sha2(F.concat(*parts), 256)
    numbers = F.concat(*[F.concat(*[F.substring(F.lpad(F.hex(n), 16, "0"), 15 - 2 * i, 2) for i in range(8)]) for n in span])
    return F.sha2(F.concat(*parts, F.coalesce(F.unhex(numbers), F.unhex(F.lit("")))), 256)


def _u64(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("long")), 16, "0")


def counted_digest(domain: str, fields: Column) -> Column:
    """SHA-256 of a domain, a zero byte, and an array of binary fields, each after its length as 8 big-endian bytes."""
    framed = F.array_join(F.transform(fields, lambda f: F.concat(_u64(F.octet_length(f)), F.hex(f))), "")
    return F.sha2(F.unhex(F.concat(F.hex(F.lit(domain + "\0").cast("binary")), framed)), 256)


def policy_id(prefix: str, domain: str, fields: list[Column]) -> Column:
    """`prefix:sha256:` and the digest of a domain and texts, each as its length in bytes, a zero byte, itself, a 255 byte."""
    framed = [F.concat(F.hex(F.octet_length(f).cast("string").cast("binary")), F.lit("00"), F.hex(f.cast("binary")), F.lit("FF")) for f in fields]
    return F.concat(F.lit(prefix + ":sha256:"), F.sha2(F.unhex(F.concat(F.hex(F.lit(domain + "\0").cast("binary")), *framed)), 256))


def framed_digest(frames: Column) -> Column:
    """SHA-256 over an ordered array of (label, value) structs, each framed by its lengths in bytes: `n:label`, a
    zero byte, `n:value`, a 255 byte."""

    def frame(f: Column) -> Column:
        sized = lambda x: F.hex(F.encode(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), "UTF-8"))
        return F.concat(sized(f["label"]), F.lit("00"), sized(f["value"]), F.lit("FF"))

    return F.sha2(F.unhex(F.array_join(F.transform(frames, frame), "")), 256)
