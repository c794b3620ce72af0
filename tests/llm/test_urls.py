import random

import duckdb

from quire.llm import urls
from quire.llm.queries import RULES

URLS = [None, "", "no scheme", "https://a.example.org/es/1", "http://EXAMPLE.org/en/17?x", "https://example.org", "https://org/", "https://xorg/", "https://example.com/fr/", "https://example.com/fr", "ftp://b.com/de/?://x.org/", "https://example.net/a#b", "://org/x", "https://com/de/\nfr/", "https://user@example.org:80/es/", "https://a.b.example.org/EN/1", "https://example.org/en/1", "x" * 3000 + "://com/fr/" + "y" * 3000, "https://пример.org/é"]


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.host), r.name), default=None)
    return host, path, best.name if best else None, best.action if best else default


def frame(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(None, URLS[3], "c"), (3, URLS[3], "c"), (3, URLS[3], "c")]
    return spark.createDataFrame(rows, "page_id bigint, url string, host string")


def test_contract(spark):
    df = frame(spark)
    got = sorted((tuple(r) for r in urls.judge(df, RULES).collect()), key=str)
    assert got == sorted(((r.page_id, *brute(r.url, RULES)) for r in df.collect()), key=str)
    assert urls.judge(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge(df, []).collect()} == {"allow"}


def test_oracle(spark):
    df = frame(spark)
    con = duckdb.connect()
    pages = df.toArrow()
    con.register("pages", pages)
    assert sorted(map(str, con.execute(urls.oracle(RULES, "allow")).fetchall())) == sorted(str(tuple(r)) for r in urls.judge(df, RULES).collect())


def test_many_rules(spark, monkeypatch):
    """The joined index gives what the inline one gives, and rules without a whole token are found."""
    r = random.Random(2)
    label = lambda: "".join(r.choice("abc") for _ in range(2))
    rules = list({urls.Rule(r.choice(["allow", "block"]), f"{label()}.{label()}", f"/{label()[: r.randint(0, 2)]}") for _ in range(60)} | {urls.Rule("block", "a", "/")})
    rules = list({x.name: x for x in rules}.values())
    df = spark.createDataFrame([(k, f"https://{label()}.{label()}.{label()}/{label()}/{label()}") for k in range(400)], "page_id bigint, url string")
    want = sorted((x.page_id, *brute(x.url, rules)) for x in df.collect())
    assert sorted(map(tuple, urls.judge(df, rules).collect())) == want
    monkeypatch.setattr(urls, "INLINE_RULES", 5)
    assert sorted(map(tuple, urls.judge(df, rules).collect())) == want
    monkeypatch.setattr(urls, "HOT", 7)  # tokens of more URLs are dealt out
    assert sorted(map(tuple, urls.judge(df, rules).collect())) == want
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    twice = df.unionByName(df)
    assert sorted(map(tuple, urls.judge(twice, rules).collect())) == sorted(want * 2)
    nulls = spark.createDataFrame([(1, None), (None, "https://a/x"), (2, "none")], "page_id bigint, url string")
    assert sorted((tuple(r) for r in urls.judge(nulls, rules).collect()), key=str) == sorted(((x.page_id, *brute(x.url, rules)) for x in nulls.collect()), key=str)


def test_wildcards(spark):
    rules = [urls.Rule("block", "net", "/*/ads/")]
    df = spark.createDataFrame([(1, "https://a.net/x/ads/1"), (2, "https://a.net/x/bads/1"), (3, "https://a.net/ads/")], "page_id bigint, url string")
    assert [r.verdict for r in urls.judge(df, rules).orderBy("page_id").collect()] == ["block", "allow", "allow"]
    assert rules[0].tokens == ["net", "ads"]


def test_native(spark):
    plan = urls.judge(frame(spark), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
