import random
import re

from barloom.llm import url_filter

URLS = [
    None, "", "no scheme", "http://Example.ORG/es/1", "https://a.b.example.org/en/1?x", "http://example.org", "http://example.org?x/es/", "http://notexample.org/en/12", "x://COM/fr/", "http://a.com/de/x#y",
    "http://ads.example.net/", "http://m.ads-track.site.net/q", "http://badsite.net/", "ftp://é.com/fr/é", "http://com./de/", "://org/", "http://..org/a://b", "http://a\nb.org/x\ny?z",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.search(r"[/?#]", rest)
        host = re.sub("[A-Z]", lambda c: c[0].lower(), rest[: m.start()] if m else rest)
        path = re.split(r"[?#]", rest[m.start() :] if m else "")[0]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, verdict = max(fits, key=lambda f: len(f[0]))
        return host, path, rule, verdict
    return host, path, None, "block" if re.search(url_filter.BLOCKED_HOST, host) else "allow"


def pages(spark):
    r = random.Random(1)
    labels = ["ads", "example", "org", "com", "net", "a", "tracker", "xads", "EXAMPLE", "m"]
    more = [f"http://{'.'.join(r.choice(labels) for _ in range(r.randint(1, 4)))}{r.choice(['', '/', '/es/', '/en/1', '/en/2', '/fr/q', '/de/'])}{r.choice(['', '?a=b', '#c'])}" for _ in range(600)]
    rows = [(i, u, "h", "k") for i, u in enumerate(URLS + more)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, keys string")


def test_verdicts_equal_brute_force(spark):
    rows, df = pages(spark)
    for limit in (url_filter.MOST_BITS, 800):  # one slice of the keys, and several
        out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(df, most_bits=limit).collect()}
        for i, url, *_ in rows:
            assert out[i] == brute(url), url


def test_a_list_as_a_table(spark):
    """A list with null, repeated and strange hosts decides where no rule fits; the pages' own columns do not matter."""
    rows = [(1, "http://Bad.net/x", "a", 1), (2, "http://good.net/", "a", 1), (1, "http://bad.net/", "b", 2), (3, "http://bad.net.example.org/es/", "c", 3), (4, "http://ads.net/", None, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, listed string, hits int")
    bad = spark.createDataFrame([("BAD.net",), ("bad.net",), (None,), ("other",), ("bad.net.example.org",)], "host string")
    out = sorted((r.page_id, r.rule, r.verdict) for r in url_filter.judged(df, listed=bad).collect())
    assert out == [(1, None, "block"), (1, None, "block"), (2, None, "allow"), (3, "example.org/es/", "block"), (4, None, "allow")]


def test_cascade_is_exact_over_its_universe(spark):
    keys = [(f"key {i}", i % 7 == 0) for i in range(20_000)]
    levels = url_filter.build_cascade(spark.createDataFrame(keys, "key string, listed boolean"))
    assert len(levels) >= 3
    assert all(url_filter.member(levels, k.encode()) == listed for k, listed in keys)


def test_empty_tables(spark):
    _, df = pages(spark)
    assert url_filter.judged(df.limit(0)).collect() == []
    only = url_filter.judged(spark.createDataFrame([(1, None)], "page_id long, url string")).first()
    assert (only.host, only.path, only.rule, only.verdict) == ("", "", None, "allow")


def test_very_long_urls_take_no_longer_than_their_length(spark):
    """Hosts of 100,000 labels and a path of a million characters."""
    rows = [(0, "http://" + "a." * 100_000 + "example.org/es/x"), (1, "http://" + "b." * 100_000 + "net/"), (2, "http://example.org/en/1" + "z" * 1_000_000)]
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert out == {i: brute(u)[2:] for i, u in rows} and out[0] == ("example.org/es/", "block")
