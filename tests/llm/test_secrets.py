import hashlib
import re
import time
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quire.llm import secrets

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def brute(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text or ""):
            value = m[2] if kind == "assign" else m[0]
            if len(value) >= secrets.LEAST[kind]:
                out.append((m.start(), rank, kind, m.end(), value))
    return sorted(out)


def repository(i):
    return 9 if i is None else i % 3


def check(df):
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    owners, repositories = defaultdict(set), defaultdict(set)
    for i, t, s in rows:
        for x in brute(t):
            owners[x[4]].add(s)
            repositories[x[4]].add((s, repository(i)))
    want = []
    for i, t, s in rows:
        found = brute(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in found).encode()).hexdigest()
        more = set()
        for a, _, _, b, v in found:
            live = re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= secrets.LIVE_DISTINCT and not re.search(secrets.PLACEHOLDERS, v)
            if len(owners[v]) >= secrets.EXAMPLE_OWNERS or (len(owners[v]) == 2 and len(repositories[v]) >= secrets.EXAMPLE_REPOSITORIES):
                more.add((b - len(v), 4, "example", b, ""))
            elif len(owners[v]) == 1 and live:
                more.add((b - len(v), 3, "live", b, ""))
        spans = ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in sorted([*found, *more], key=lambda x: (x[0], x[1], x[3])))
        most = [max((len(of[x[4]]) for x in found), default=0) for of in (owners, repositories)]
        want.append((i, *[sum(x[2] == k for x in found) for k in secrets.LEAST], digest, spans, *most))
    got = [tuple(r) for r in secrets.scan(df, owner=F.col("source"), repository=F.coalesce(F.col("doc_id") % 3, F.lit(9))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "owners", "repositories").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


TEXTS = [
    "password=abc123XYZ, PassWord : 'q9w8e7r6t5', secret=token : abcdef token=ab", "AKIA" + "Z9" * 8 + " xAKIAAKIA" + "B" * 16 + " AKIASHORT", "deadbeef" * 3 + " " + "0" * 23 + "g" + "f" * 24,
    "ſecret=abcdefgh toKen=abcdefgh", "api_key==a+b/c_d.e-f= apikey: \"unfinished", "\U0001f600 é password=zyxw9876VUTS \U0001f600 secret:abc\n123456", "password=password=abcdef", "token = example-token-12345", "a password=xK9fQ2mN7p b", "",
]


def test_patterns(spark):
    rows = [(k, t, f"s{k % 4}") for k, t in enumerate(TEXTS * 3)] + [(1000, None, None), (None, TEXTS[0], None), (1, TEXTS[0], "s1"), (1, TEXTS[0], "s1")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))


def test_odd(odd, empty):
    check(odd)
    assert secrets.scan(empty).count() == 0


def test_redact(odd, spark):
    got = secrets.redact(odd, owner=F.col("source"), repository=F.col("source"))
    assert got.columns == odd.columns and got.count() == odd.count()
    before = {(r.doc_id, r.text) for r in odd.collect()}
    for r in got.collect():
        assert not brute(r.text) or "<" in (r.text or "")
        if (r.doc_id, r.text) not in before:
            assert "<SECRET>" in r.text or "<EXAMPLE>" in r.text
    one = spark.createDataFrame([(1, "x password=xK9fQ2mN7p y " + "0f" * 12, "a"), (2, "clean", "a"), (3, None, "b")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.text) for r in secrets.redact(one).collect()) == [(1, "x <SECRET> y <SECRET>"), (2, "clean"), (3, None)]


def test_repositories_decide(spark):
    """A value of two owners is an example only if it lies in many repositories."""
    value = "password=xK9fQ2mN7p"
    wide = spark.createDataFrame([(k, value, f"s{k % 2}") for k in range(6)], "doc_id bigint, text string, source string")
    check(wide)
    narrow = wide.where("doc_id < 2")
    check(narrow)
    kinds = lambda df: {(r.n_example, r.n_live) for r in secrets.scan(df, owner=F.col("source"), repository=F.col("doc_id") % 3).collect()}
    assert kinds(wide) == {(1, 0)} and kinds(narrow) == {(0, 0)}


def plain_mask(text, marks):
    out, at = "", 0
    for a, b, m in sorted(marks):
        if a >= at:
            out += text[at:a] + m
        at = max(at, b)
    return out + text[at:]


def test_mask_against_plain(spark):
    r = np.random.default_rng(1)
    rows = []
    for n in (0, 1, 2, 3, 7, 20, 50):
        text = "".join(r.choice(list("abcé\U0001f600 "), 60))
        starts = r.integers(0, 55, n)
        rows.append((n, text, [(int(a), int(a + r.integers(1, 6)), "<M>") for a in sorted(starts)]))
    df = spark.createDataFrame(rows, "n int, t string, marks array<struct<start:int,end:int,mark:string>>")
    got = {x.n: x.out for x in df.select("n", secrets.mask(F.col("t"), F.array_sort("marks")).alias("out")).collect()}
    assert got == {n: plain_mask(t, m) for n, t, m in rows}


def test_many_matches_in_one_text(spark):
    """A megabyte of digests: 32,000 spans are found and replaced in a few seconds."""
    text = " ".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(32_000))
    df = spark.createDataFrame([(1, text, "a")], "doc_id bigint, text string, source string").cache()
    secrets.scan(df.where("false")).count()
    began = time.time()
    r = secrets.scan(df).select("n_hex", "base_sha256").first()
    assert time.time() - began < 20
    want = ",".join(f"hex:{33 * k}:{33 * k + 32}" for k in range(32_000))
    assert (r.n_hex, r.base_sha256) == (32_000, hashlib.sha256(want.encode()).hexdigest())
    began = time.time()
    assert secrets.redact(df).first().text == " ".join(["<SECRET>"] * 32_000)
    assert time.time() - began < 30


def test_native(odd):
    plan = secrets.scan(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
