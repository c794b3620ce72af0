import random
import time
from collections import defaultdict

import corpus_pipeline as pipeline
import numpy as np
import pyarrow as pa
import pytest

from quire.llm import similar


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(rows):
    """(id, shingles) of the rows that stay, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    while True:
        new = [min(root[j] for j in range(len(rows)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == root:
            break
        root = new
    groups = defaultdict(list)
    for (i, _), r in zip(rows, root):
        groups[r].append(i)
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)


def edited(text, r, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"x{r.randrange(10**9)}"
    return " ".join(words)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((r.doc_id for r in similar.keep_one(df).collect()), key=str) == brute(rows)


@pytest.fixture(scope="module")
def copies(spark):
    r = random.Random(4)
    bases = [" ".join(r.choice(["the", "of", "and", "ing"]) + str(r.randrange(50)) for _ in range(n)) for n in (6, 12, 40, 90, 150, 300)]
    texts = [edited(b, r, n) for b in bases for n in (0, 1, 1, 2, 3, 4, 5, 6)] + [f"{b} more words" for b in bases]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)


def test_against_all_pairs(corpus, odd, empty, copies):
    check(copies)
    check(corpus.select("doc_id", "text"))
    check(odd.select("doc_id", "text"))
    assert similar.keep_one(empty).count() == 0 and similar.keep_one(odd).columns == odd.columns


def test_long_lists(copies, corpus, monkeypatch):
    """Lists that are cut into blocks lose no pair."""
    monkeypatch.setattr(similar, "BLOCK", 2)
    monkeypatch.setattr(similar, "RING", 1)
    check(copies)
    check(corpus.select("doc_id", "text"))
    monkeypatch.setattr(similar, "NEAREST", 0)
    check(copies)


def test_chains_over_batches_and_tasks():
    """However rows are cut into batches, lists of two or more are told whole, and each member is linked with the next two."""
    r = np.random.default_rng(2)
    h = np.sort(r.integers(0, 40, 120))
    key = np.concatenate([np.sort(r.choice(1000, n, replace=False)) for n in np.unique(h, return_counts=True)[1]])
    h, key = np.repeat(h, 2), np.repeat(key, 2)  # each row twice
    for size in (1, 2, 3, 7, 500):
        batches = [pa.RecordBatch.from_pydict({"h": h[a : a + size], "key": key[a : a + size], "n": np.full(len(h[a : a + size]), 10), "place": np.zeros(len(h[a : a + size]), np.int64)}) for a in range(0, len(h), size)]
        rows = [x for b in similar.chains(iter(batches), 2) for x in zip(*[c.to_pylist() for c in b.columns])]
        lists = defaultdict(list)
        for a, b in sorted(set(zip(h.tolist(), key.tolist()))):
            lists[a].append(b)
        edges = {h[0], h[-1]}
        assert sorted(x[1:3] for x in rows if x[0] == similar.MEMBER) == [(a, b) for a, own in lists.items() for b in own if len(own) > 1 or a in edges]
        assert {x[1:3] for x in rows if x[0] == similar.LINK} == {(own[i], own[j]) for own in lists.values() for i in range(len(own)) for j in (i + 1, i + 2) if j < len(own)}


def test_bounds_keep_similar_pairs():
    """Sizes, places and sketches never speak against sets of a similarity of 4/5."""
    r = np.random.default_rng(6)
    for _ in range(400):
        both, a, b = (np.unique(r.integers(0, 1 << 63, k, dtype=np.uint64)) for k in (r.integers(1, 300), r.integers(0, 40), r.integers(0, 40)))
        x, y = np.union1d(both, a), np.union1d(both, b)
        if 5 * len(both) < 4 * len(np.union1d(x, y)):
            continue
        n, m = len(x), len(y)
        p, q = np.searchsorted(x, both), np.searchsorted(y, both)
        assert similar.close(n, m, p, q).all()
        assert 9 * int(np.bitwise_count((similar.sketch(x) ^ similar.sketch(y)).view(np.uint64)).sum()) <= n + m


def test_stage_drops_copies_that_differ_in_many_bits(spark):
    """Pairs of sf0.1 with a similarity of 0.9 and 5 or 6 differing bits."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (5733, 2465, 3006, 783)")
    assert sorted(r.doc_id for r in pipeline.drop_copies(spark, docs, "").collect()) == [783, 2465]


def test_rows_that_share_an_id(spark):
    x, y = "a b c d e f g", "p q r s t u v"
    df = spark.createDataFrame([(3, x), (5, x), (5, y), (None, "only here"), (None, "only here"), (None, y)], "doc_id bigint, text string")
    assert sorted(map(tuple, similar.keep_one(df).collect()), key=str) == [(3, x), (5, y), (None, "only here")]


def prints(rows):
    return np.array(rows, np.uint64).view(np.int64).tolist()


def test_positional_bytes(spark, monkeypatch):
    """Of fingerprints that lie apart, just those pairs are retained that share three positional bytes and differ in at most BITS bits; long lists are cut, and lists of copies are chained."""
    r = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        one = r.integers(0, 256, similar.BYTES, dtype=np.uint8)
        two = one.copy()
        for k in r.permutation(similar.BYTES)[: r.integers(8, 15)]:
            two[k] ^= np.bitwise_or.reduce(np.uint8(1) << r.integers(0, 8, r.integers(1, 5), dtype=np.uint8))
        rows += [one, two]
    octets = np.array(rows)
    values = octets.view(np.uint64)
    shared = (octets[:, None] == octets[None]).sum(2)
    differ = np.bitwise_count(values[:, None] ^ values[None]).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero((shared >= 3) & (differ <= similar.BITS))) if i < j}
    assert 100 < len(want) < 300 and ((shared >= 3) & (differ > similar.BITS)).any() and (shared[::2, 1::2].diagonal() == 2).any()
    table = spark.createDataFrame([(k, *prints(v)) for k, v in enumerate(values)], "key bigint, f0 bigint, f1 bigint").repartition(3)
    assert {(p.u, p.v) for p in similar.alike(table).collect()} == want
    one = spark.createDataFrame([(k, 7, k % 2) for k in range(100)], "key bigint, f0 bigint, f1 bigint")
    pairs = {(p.u, p.v) for p in similar.alike(one).collect()}
    assert {(k, k + 1) for k in range(99)} <= pairs and len(pairs) < 200
    assert [list(similar.runs(np.array(x))) for x in ([1, 1, 2], [])] == [[(0, 3)], []]
    monkeypatch.setattr(similar, "MEMBERS", 2)
    assert list(similar.runs(np.array([1, 1, 1, 2, 3, 4]))) == [(0, 2), (2, 3), (3, 5), (5, 6)]


def test_fingerprints_find_most_pairs(corpus, spark):
    """The index over fingerprints alone shows most similar pairs of sf0.1; the lists of shingles are for the rest."""
    texts = sorted({t.text or "" for t in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()})
    hashes = similar.shingler()
    sets = [shingles(t) for t in texts]
    owners = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            owners[x].append(k)
    near = {(i, j) for own in owners.values() if len(own) < 50 for i in own for j in own if i < j}
    near = {(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    table = spark.createDataFrame([(k, *similar.fingerprint(hashes(t)).tolist()) for k, t in enumerate(texts)], "key bigint, f0 bigint, f1 bigint")
    found = {(p.u, p.v) for p in similar.alike(table).collect()}
    assert near and len(near & found) >= 0.9 * len(near)


def test_shuffles_are_deleted(spark, corpus):
    """No shuffle file stays when the links are found, whether or not the driver has collected garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    held = files()
    similar.keep_one(corpus)
    assert spark.conf.get(name) == before
    for _ in range(50):
        if files() <= held:
            break
        time.sleep(0.2)
    assert files() <= held
