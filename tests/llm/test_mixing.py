import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quire.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Targets by resharing the excess until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        open_ = sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in order if s not in capped and left * weight[s] / open_ > 2 * sizes[s]} if open_ else set()
        if not over:
            return {s: 2 * sizes[s] if s in capped else left * weight[s] / open_ for s in order}
        capped |= over


def check(df):
    rows = df.select("doc_id", "text", "source").collect()
    got = mixing.summary(df).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), size(r.text)) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size(r.text)
    want = brute_targets(sizes)
    by = {(r.source_size, round(r.target, 3)) for r in got}
    assert by == {(sizes[s], round(t, 3)) for s, t in want.items()}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    largest, taken = max(r.size for r in got), defaultdict(int)
    for r in got:
        taken[r.source_size, round(r.target, 3)] += r.taken
    for (s, t), n in taken.items():
        same = sum((sizes[x], round(y, 3)) == (s, t) for x, y in want.items())
        assert abs(n - same * t) <= same * largest
    return got


def test_targets_and_draws(corpus, odd, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 4)
    first = check(corpus)
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, mixing.summary(corpus).collect()), key=str)
    check(odd.where("size(split(text, ' ')) < 20000 or text is null"))
    assert mixing.summary(empty).count() == 0
    assert {r.taken for r in mixing.summary(odd.where("text is null")).collect()} == {0}


def test_apply_takes_what_the_summary_says(corpus):
    took = Counter(r.doc_id for r in mixing.apply(corpus).collect())
    want = {r.doc_id: len(r.shards) for r in mixing.summary(corpus).collect() if r.shards}
    assert took == want


def test_apply_writes_shard_by_shard_in_random_order(corpus):
    """The rows lie in partitions as the summary deals them: shards together, positions ascending."""
    places = {}
    for r in mixing.summary(corpus, levels=3).collect():
        for s, p in zip(r.shards, r.positions):
            places.setdefault(r.doc_id, []).append((s, p))
    parts = [[r.doc_id for r in part] for part in mixing.apply(corpus, levels=3).select("doc_id").rdd.glom().collect() if part]
    where = {}
    for k, part in enumerate(parts):
        seen = []
        for i, n in Counter(part).items():
            assert n == len(places[i])
        todo = {i: sorted(p) for i, p in places.items()}
        for i in part:
            seen.append(todo[i].pop(0))
        assert seen == sorted(seen)
        for s, _ in seen:
            assert where.setdefault(s, k) == k
    assert len(where) > 1 and sum(map(len, parts)) == sum(map(len, places.values()))


def test_rows_that_differ_in_other_columns_stay_apart(spark):
    df = spark.createDataFrame([(1, "a b c", "x", n, {"k": n}) for n in range(4)], "doc_id int, text string, source string, n int, m map<string,int>")
    assert set(r.n for r in mixing.apply(df).collect()) <= {0, 1, 2, 3} and mixing.apply(df).count() == sum(len(r.shards) for r in mixing.summary(df).collect()) > 3


def test_shards_hold_their_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPREAD", 2)
    quotas = spark.createDataFrame([(1, 40), (2, 7), (3, 1), (4, 100)], "_n int, draws bigint")
    got = mixing.split_tree(quotas, 3).toPandas()
    assert got.groupby("_n").draws.sum().to_dict() == {1: 40, 2: 7, 3: 1, 4: 100}
    sums = got.groupby("shard").draws.sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= 3 and (got.draws >= 0).all()


def test_hypergeometric_draws(spark):
    """Means and variances of many draws, and their bounds."""
    for good, every, picks in ((30, 100, 50), (3, 1000, 500), (990, 1000, 10), (0, 5, 3), (5, 5, 3), (400, 1000, 300)):
        args = [F.lit(x).cast("long") for x in (good, every, picks)]
        df = spark.range(4000).select(mixing.hypergeometric(*args, (F.col("id") + 0.5) / 4000).alias("k"))
        k = np.array([r.k for r in df.collect()])
        mean, p = picks * good / every, good / every
        assert max(0, picks - (every - good)) <= k.min() and k.max() <= min(good, picks)
        assert abs(k.mean() - mean) < 0.02 + 0.002 * mean
        assert abs(k.var() - picks * p * (1 - p) * (every - picks) / max(1, every - 1)) < 0.05 + 0.02 * k.var()


def test_native(corpus):
    plan = mixing.summary(corpus)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
