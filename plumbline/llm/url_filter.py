"""URL filters: a cascade of Bloom filters gives exact membership of hosts without joins.

Level 1 encodes the listed keys; level 2 the keys of the corpus that level 1 takes for listed but that
aren't; level 3 the listed keys that level 2 takes for unlisted; and so on until a level errs on no key of
the corpus's complete key universe (every host of the corpus and each of its parent domains). A lookup walks
the levels until one doesn't hold the key: listed if that is an even number of levels down. Levels are binary
literals of the plan, read a byte at a time: no join, no Python, and a row carries none of them. Only building the
cascade reads the corpus's distinct keys, after map-side distinct; its levels go through the driver, as literals do.

Size: a level takes about 1.44 * log2(1/p) bits a key. Where a list would take more than `max_bits`, its keys are
dealt to groups by their hash; each group has a cascade of its own over the universe's keys of that group, and a pass.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import discard, materialize, table

NAME = "op3_url_filter"

#: Rules of the registered query as (host, path, verdict), and its listed domains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LISTED = ("adult-x.example.com", "adult-x.example.net", "adult-x.example.org", "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org")

FIRST_FPP, LEAST_FPP, NEXT_FPP, MAX_BITS = 0.01, 1e-7, 0.5, 1 << 27

#: Bits of a literal's byte (a byte of ASCII is a character, whose code Spark can read); bytes that are put together in one row.
BITS, BLOCK = 7, 4096


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or end, A-Z lower-cased. Path: then up to ?, # or end.
    Both empty where url is null or has no ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)), F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def host_keys(host: Column) -> Column:
    """The host and each parent domain; none for an empty host."""
    parts = F.split(host, r"\.")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def best_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Of the rules that fit, the longest (host and path together; then by its text): its text and its verdict."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def _bits(key: Column, level: int, m: int, k: int) -> list[Column]:
    """The k bit numbers of a key in a level of m bits (double hashing; the level is part of the key's hash)."""
    a, b = F.xxhash64(F.lit(level), key), F.xxhash64(F.lit(-1 - level), key)
    start, step = F.pmod(a, F.lit(m)), F.pmod(b, F.lit(m - 1)) + 1
    return [F.pmod(start + F.lit(i) * step, F.lit(m)) for i in range(k)]


def _level(keys: DataFrame, n: int, level: int, fpp: float) -> tuple[bytes, int, int]:
    """A Bloom filter over keys(key): its bytes, bits and hashes. Bits are or-ed before and after a shuffle."""
    m = max(BITS, BITS * math.ceil(n * -math.log(fpp) / (math.log(2) ** 2) / BITS))
    k = min(16, max(1, round(m / max(n, 1) * math.log(2))))
    bits = keys.select(F.explode(F.array(*_bits(F.col("key"), level, m, k))).alias("bit"))
    some = bits.select(F.call_function("div", F.col("bit"), F.lit(BITS)).alias("i"), F.call_function("shiftleft", F.lit(1), F.pmod("bit", F.lit(BITS)).cast("int")).alias("w"))
    every = keys.sparkSession.range(m // BITS).select(F.col("id").alias("i"), F.lit(0).alias("w"))
    each = some.unionByName(every).groupBy("i").agg(F.bit_or("w").alias("w"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: F.char(x["w"]))
    rows = each.groupBy(F.call_function("div", F.col("i"), F.lit(BLOCK)).alias("block")).agg(F.array_join(ordered, "").alias("bytes"))
    return "".join(r.bytes for r in sorted(rows.collect(), key=lambda r: r.block)).encode("ascii"), m, k  # at most max_bits / BITS bytes


class Cascade:
    """levels: (bytes, bits, hashes) from the first to the last."""

    def __init__(self, levels: list[tuple[bytes, int, int]]):
        self.levels = levels

    def holds(self, key: Column, i: int) -> Column:
        data, m, k = self.levels[i]
        byte = lambda b: F.ascii(F.substring(F.lit(data), (F.call_function("div", b, F.lit(BITS)) + 1).cast("int"), F.lit(1)).cast("string"))
        hit = lambda b: F.call_function("shiftright", byte(b), F.pmod(b, F.lit(BITS)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return reduce(lambda x, y: x & y, [hit(b) for b in _bits(key, i, m, k)])

    def listed(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over; a key that no level errs on ends the walk."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.holds(key, i), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade over universe(key) and listed(key), both distinct. Each level errs on about half as many keys as the one before."""
    spark = universe.sparkSession
    others, outside_path = materialize(universe.join(listed, "key", "left_anti"), "unlisted")
    n, n_others, keys, levels, paths = listed.count(), others.count(), listed, [], [outside_path]
    while True:
        i = len(levels)
        fpp = min(FIRST_FPP, max(LEAST_FPP, 0.7 * n / max(n_others, 1))) if i == 0 else NEXT_FPP
        levels.append(_level(keys, n, i, fpp))
        wrong, path = materialize(others.filter(Cascade(levels).holds(F.col("key"), i)), f"wrong{i}")
        paths.append(path)
        n = wrong.count()
        if n == 0:
            discard(spark, *paths)
            return Cascade(levels)
        keys, others = wrong, keys


def _group(key: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(groups), key), F.lit(groups))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=(), url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """pages with host, path, rule, listed and verdict ('allow' or 'block').

    listed(key) names domains; a url is listed if its host or one of the host's parent domains is. A rule that
    fits decides before the list. Nulls, urls without :// and empty hosts: host and path empty, never listed,
    so allowed. Repeated rows each get their row; an empty table gives an empty result; null listed keys are
    ignored. The five output names replace columns of the same name.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    out = pages.drop(*[c for c in ("host", "path", "rule", "listed", "verdict") if c != url]).withColumns({"host": host, "path": path})
    wanted, wanted_path = materialize(listed.select(F.col(listed.columns[0]).alias("key")).filter("key is not null").distinct(), "listed-keys")
    universe, stored = materialize(out.select("host").distinct().select(F.explode(host_keys(F.col("host"))).alias("key")).distinct(), "url-keys")
    groups = max(1, math.ceil((12 * wanted.count() + 3 * FIRST_FPP * universe.count()) / max_bits))
    out = out.withColumn("listed", F.lit(False))
    before: list[str] = []
    for g in range(groups):
        mine = lambda key: _group(key, groups) == g if groups > 1 else F.lit(True)  # noqa: B023, E731  used within the round
        cascade = build_cascade(universe.filter(mine(F.col("key"))), wanted.filter(mine(F.col("key"))))
        out = out.withColumn("listed", F.col("listed") | F.exists(host_keys(F.col("host")), lambda key: mine(key) & cascade.listed(key)))
        if g < groups - 1:  # a plan holds the literals of one group
            out, now = materialize(out, "url-verdicts")
            discard(spark, *before)
            before = [now]
    discard(spark, wanted_path, stored)
    text, verdict = best_rule(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": text, "verdict": F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def _oracle() -> str:
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda i: " ".join(f"WHEN {fits(r[0], r[1])} THEN '{r[0] + r[1] if i == 3 else r[2]}'" for r in order)
    listed = "(" + " OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in LISTED) + ")"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM a)
SELECT page_id, host, path, CASE {case(3)} ELSE NULL END AS rule,
       CASE {case(2)} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict, {listed} AS listed FROM b
"""


ORACLE_SQL = _oracle()
