import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quire.llm import components, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(rows):
    """Components by comparing all pairs of fingerprints."""
    fps = [brute_fingerprint(t) for _, t in rows]
    distinct = np.array(sorted(set(fps)), np.uint64)
    near = np.bitwise_count(distinct[:, None] ^ distinct[None, :]) <= 3
    root = np.arange(len(distinct))
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    least = defaultdict(list)
    of = {int(f): int(r) for f, r in zip(distinct, root)}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[of[f]].append(i)
    return sorted(((i, f"{f:016x}", min(least[of[f]], default=None)) for (i, _), f in zip(rows, fps)), key=str)


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_against_all_pairs(corpus):
    check(corpus)
    kept = {r.doc_id for r in simhash.keep_one(corpus).collect()}
    assert kept == {r.component_id for r in simhash.near_duplicates(corpus).collect()}


def test_odd(odd, empty):
    check(odd)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


def test_blocks_cover_every_error():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    assert all(any(not set(e) & set(b) for b in simhash.BLOCKS) for e in combinations(range(8), 3))


def test_links_of_close_fingerprints(spark, monkeypatch):
    """Fingerprints around a few centres: chains, stars, and lists above the bound give the components of all pairs."""
    monkeypatch.setattr(simhash, "LIST", 16)
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)) for b in base]]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    lists = simhash.postings(df).repartition(3, "block", "key").sortWithinPartitions("block", "key")
    links = [(x.u, x.v) for x in lists.mapInArrow(simhash.list_links, "u bigint, v bigint").collect()]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    assert all(near[np.searchsorted(fps, np.int64(a).view(np.uint64)), np.searchsorted(fps, np.int64(b).view(np.uint64))] for a, b in links)

    def groups(edges):
        root = {int(x): int(x) for x in fps.view(np.int64)}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for x in root:
            out[find(x)].add(x)
        return sorted(map(sorted, out.values()))

    pairs = [(int(fps.view(np.int64)[a]), int(fps.view(np.int64)[b])) for a, b in zip(*np.nonzero(near))]
    assert groups(links) == groups(pairs)


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (600, 602), (601, 602)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500, 601: 600, 602: 600}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
    star = [(0, k) for k in range(1, 300)]
    assert components.components(spark.createDataFrame(star, "u bigint, v bigint")).agg(F.max("root")).first()[0] == 0


def connected(fps, edges):
    """The set of each fingerprint's component, by plain union."""
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(int(a))] = find(int(b))
    out = defaultdict(set)
    for x in root:
        out[find(x)].add(x)
    return sorted(map(sorted, out.values()))


def all_pairs(fps):
    out = []
    for k, x in enumerate(fps):
        out += [(x, y) for y in fps[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ x) <= 3]]
    return out


def indexed(fps):
    """Links of all lists of the index."""
    out = []
    for block in simhash.BLOCKS:
        mask = np.uint64(sum(0xFF << (8 * k) for k in block))
        order = np.argsort(fps & mask, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(fps[order] & mask)) + 1):
            out += simhash.links(fps[part], block)
    return out


def test_long_lists_lose_no_link():
    """Over 4,096 fingerprints that agree in five bytes, with planted links of one bit in each of the other three bytes; and lists whose bytes are constant, nearly constant or random."""
    r = np.random.default_rng(8)
    high = np.unique(r.integers(0, 1 << 24, 2600, dtype=np.uint64))
    high = np.unique(np.r_[high, high ^ np.uint64(0x010101)])
    planted = high << np.uint64(40) | np.uint64(0x1234567890)
    assert len(planted) > simhash.LIST
    few = r.integers(0, 3, (3000, 8), dtype=np.uint8).view(np.uint64).ravel()
    near = np.uint64(0x0F1E2D3C4B5A6978) ^ sum((np.uint64(1) << r.integers(0, 64, 5000, dtype=np.uint64)) * np.uint64(k) for k in (1,)) ^ (np.uint64(1) << r.integers(0, 64, 5000, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 20, 5000, dtype=np.uint64))
    for fps in (planted, np.unique(few), np.unique(near)):
        assert connected(fps, indexed(fps)) == connected(fps, all_pairs(fps))
    assert all(int(a ^ b).bit_count() <= 3 for a, b in indexed(planted))


def test_look_up_is_the_same_as_expansion():
    r = np.random.default_rng(2)
    fps = np.unique(r.integers(0, 1 << 9, 300, dtype=np.uint64) << np.uint64(10))
    assert connected(fps, simhash.partners(fps, list(range(10, 34)))) == connected(fps, simhash.forest(fps)) == connected(fps, all_pairs(fps))


def test_one_row_of_each_component(spark):
    """Rows that share an id with another text, and rows without an id."""
    x, y = "a b c d e f g", "p q r s t u v"
    df = spark.createDataFrame([(3, x), (5, x), (5, y), (None, "only here"), (None, "only here"), (None, y)], "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=str) == [(3, x), (5, y), (None, "only here")]


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    """Both ways agree with plain search; of few edges the whole takes a few jobs, however long their chains are."""
    r = random.Random(8)
    nodes = [r.randrange(-(2**63), 2**63) for _ in range(900)]
    edges = [(nodes[k], nodes[k + 1]) for k in range(300)] + [(nodes[400], x) for x in nodes[401:600]] + [tuple(r.sample(nodes[600:], 2)) for _ in range(160)] + [(nodes[0], nodes[0])]
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = start
                todo += near[x]
    table = spark.createDataFrame(edges + [e[::-1] for e in edges[::7]], "u bigint, v bigint").repartition(5)
    spark.sparkContext.setJobGroup("one task", "")
    try:
        got = {x.node: x.root for x in components.components(table).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one task"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {x: root for x, root in want.items() if x != root} and jobs < 15
    monkeypatch.setattr(components, "EDGES", 100)
    assert {x.node: x.root for x in components.components(table).collect()} == got
