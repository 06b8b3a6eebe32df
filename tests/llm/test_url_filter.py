import random
import time

from pyspark.sql import functions as F

from plumbline.llm import url_filter as m


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, chars: s[: min([s.find(c) for c in chars if c in s] or [len(s)])]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def judge(url, rules, listed):
    host, path = host_path(url)
    under = lambda h: host == h or host.endswith("." + h)
    fits = [r for r in rules if under(r[0]) and path.startswith(r[1])]
    on = host != "" and any(under(k) for k in listed)
    if fits:
        best = max(fits, key=lambda r: len(r[0] + r[1]))
        return host, path, best[0] + best[1], best[2], on
    return host, path, None, "block" if on else "allow", on


URLS = [None, "", "no scheme", "http://", "http://ADULT-x.Example.NET", "https://www.adult-x.example.net?q", "http://xadult-x.example.net/", "http://a.org/es/", "https://example.org/en/1", "https://m.example.org/en/12?x#y", "http://example.org/es/?a", "http://b.com/fr/x", "http://b.com/de", "http://b.com/de/", "http://h#/x", "http://spam-farm.example.com/fr/1", "http://x.spam-farm.example.org/", "http://a..b./c", "ftp://É.com/Ü", "http://a/" + "p" * 100000, "http://a.com/b://c/d"]


def run(spark, urls, listed, rules=m.RULES, **kw):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, listed int")
    keys = spark.createDataFrame([(x,) for x in listed], "key string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in m.filter_urls(df, keys, rules, **kw).collect()}


def test_cases(spark):
    want = {i: judge(u, m.RULES, m.LISTED) for i, u in enumerate(URLS)}
    assert run(spark, URLS, [*m.LISTED, None, m.LISTED[0]]) == want
    assert run(spark, URLS, m.LISTED, max_bits=30) == want  # three groups, each a pass
    assert run(spark, [], m.LISTED) == {}
    assert run(spark, URLS, []) == {i: judge(u, m.RULES, []) for i, u in enumerate(URLS)}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(m, "FIRST_FPP", 0.4)  # many false positives, so many levels
    rng = random.Random(8)
    keys = [f"k{rng.getrandbits(30)}" for _ in range(3000)]
    universe = spark.createDataFrame([(k,) for k in set(keys)], "key string")
    listed = spark.createDataFrame([(k,) for k in set(keys[:700]) | {"elsewhere"}], "key string")
    cascade = m.build_cascade(universe, listed)
    assert len(cascade.levels) > 2
    got = universe.select("key", cascade.listed(F.col("key")).alias("on")).collect()
    assert {r.key for r in got if r.on} == set(keys[:700])


def test_clashing_names(spark):
    df = spark.createDataFrame([("http://adult-x.example.net/", 1, 2, 3)], "url string, key int, _words0 int, byte int")
    keys = spark.createDataFrame([("adult-x.example.net",)], "key string")
    assert m.filter_urls(df, keys).select("key", "_words0", "byte", "listed").collect() == [(1, 2, 3, True)]


def test_a_million_listed_keys(spark):
    """The time follows the rows, not rows times keys."""
    keys = spark.range(1_000_000).select(F.concat(F.lit("host"), F.col("id").cast("string"), F.lit(".example.net")).alias("key"))
    df = spark.range(0, 60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.host"), (F.col("id") * 37).cast("string"), F.lit(".example.net/a")).alias("url"))
    began = time.time()
    got = m.filter_urls(df, keys).groupBy("listed", (F.col("page_id") * 37 < 1_000_000).alias("want")).count().collect()
    assert sorted((r.listed, r.want, r["count"]) for r in got) == [(False, False, 32972), (True, True, 27028)]
    assert time.time() - began < 120


def test_query(spark, sf_dir):
    want = {r.page_id: judge(r.url, m.RULES, m.LISTED) for r in m.table(spark, sf_dir, "pages").collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in m.query(spark, sf_dir).collect()} == want
