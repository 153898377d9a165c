import random

from pyspark.sql import functions as F

from logpond.llm.op7_url_filters import build_filter, entries_table, matches, repeated_urls, url_filter, whole_matches
from logpond.llm.queries import URL_LIST, URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    m = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return host, path[:m]


def brute(url, rules, listed):
    host, path = parts(url)
    fit = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    best = max(((len(h + p), h + p, a) for h, p, a in rules if fit(h, p)), default=None)
    on = any(fit(h, p) for h, p, _ in listed)
    return host, path, best and best[1], best[2] if best else "block" if on else "allow"


URLS = [None, "", "no scheme.net/", "http://example.net", "http://example.net/", "HTTP://EXAMPLE.Net/en/x?q#f",
        "x://a://b.net/", "http://notexample.net/en/", "http://a.example.com/de", "http://a.example.com/de/?", "http://É.ORG/fr/a",
        "http://org/fr/", "http://net/", "http://fr.org?x=/fr/", "http://spam-farm.example.com", "http://www.free-bets.example.org/fr/1",
        "http://xspam-farm.example.com/", "http://e.net\n/x", "http://.net/", "http://a..net/", "http://" + "a." * 500 + "net/" + "p" * 3000]


def test_against_brute_force(spark):
    rng = random.Random(1)
    urls = URLS + ["http" + rng.choice(["://", "s://", ":"]) + rng.choice(["www.", "", "a.b."]) +
                   rng.choice(["example.net", "Example.com", "x.org", "net", "free-bets.example.net"]) +
                   rng.choice(["", "/", "/en/1", "/de/", "/fr/x", "/en"]) + rng.choice(["", "?a", "#b"]) for _ in range(300)]
    rows = list(enumerate(urls)) + [(None, "http://a.net/"), (3, urls[3])]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, rule int")
    got = url_filter(df, entries_table(spark, URL_RULES), entries_table(spark, URL_LIST)).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(i, *brute(u, URL_RULES, URL_LIST)) for i, u in rows], key=str)
    assert url_filter(df.where(F.lit(False)), entries_table(spark, URL_RULES), entries_table(spark, URL_LIST)).count() == 0


def test_larger_list_has_no_false_positive(spark):
    rng = random.Random(2)
    listed = [(f"h{rng.randrange(3000)}.com", rng.choice(["", "/a", "/a/b/"]), "block") for _ in range(2000)]
    urls = [f"http://{rng.choice(['', 'w.'])}h{rng.randrange(6000)}.com{rng.choice(['', '/', '/a', '/a/b/c'])}" for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter(df, entries_table(spark, URL_RULES), entries_table(spark, listed)).collect()
    fits = {(h, p) for h, p, _ in listed}
    for r in got:
        h, p = parts(urls[r["id"]])
        on = any((s, q) in fits for s in (h, h.removeprefix("w.")) for q in ("", "/a", "/a/b/") if p.startswith(q))
        assert (r["verdict"] == "block") == on


def test_filter_rules_out_most(spark):
    listed = entries_table(spark, [(f"h{i}.com", "/", "block") for i in range(1000)])
    bloom, blocks = build_filter(listed.select(F.col("host").alias("e_host"), F.col("path").alias("e_path")), 1000)
    assert bloom.count() <= blocks
    probe = spark.range(5000).select(F.concat(F.lit("g"), F.col("id").cast("string"), F.lit(".com")).alias("host"), F.lit("/").alias("path"))
    assert matches(probe, listed).count() == 0


def test_list_of_whole_urls(spark):
    rng = random.Random(3)
    urls = [f"http{rng.choice(['', 's'])}://H{rng.randrange(40)}.example.org/p/{rng.randrange(60)}{rng.choice(['', '?a', '#b', '/'])}"
            for _ in range(2500)] + [None, None, "no scheme", "no scheme", "http://x.org", "http://x.org?q"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    seen = {}
    for u in urls:
        seen[parts(u)] = seen.get(parts(u), 0) + 1
    want = {k for k, n in seen.items() if n >= 2 and k[0]}
    listed = repeated_urls(df, 2)
    assert {(r["host"], r["path"]) for r in listed.collect()} == want and ("x.org", "") in want
    got = url_filter(df, entries_table(spark, URL_RULES), entries_table(spark, URL_LIST), listed).collect()
    for r in got:
        host, path, rule, verdict = brute(urls[r["id"]], URL_RULES, URL_LIST)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict if rule else "block" if verdict == "block" or (host, path) in want else "allow")
    # the filter lets only few through that are not listed, the join none
    others = spark.range(20_000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("host"), F.lit("/").alias("path"))
    assert whole_matches(others, listed).count() == 0
    assert whole_matches(others, listed.limit(0)).count() == 0
