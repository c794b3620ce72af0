import numpy as np
from pyspark.sql import functions as F

from quire.llm import toxicity


def test_finds_labelled_toxic_documents(spark):
    """A model fitted on documents of even id finds the toxic ones among those of odd id and leaves the clean ones alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("label")), "doc_id")
    n = {(r.label, r.toxic): r["count"] for r in got.groupBy("label", "toxic").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.9
    assert n.get((0, True), 0) / n[0, False] < 0.01


def test_shared_weights_give_ordered_thresholds():
    sample = [(0, ["the", "of"], [3, 2])] * 40 + [(1, ["the", "bad"], [3, k]) for k in (1, 2, 3, 9) for _ in range(10)]
    model = toxicity.fit(sample)
    assert list(model.cuts) == sorted(model.cuts) and len(model.cuts) >= 2
    p = model.scores(["the bad", "the bad bad bad bad bad bad", "the of", None, ""])
    assert sum(p[2]) < sum(p[0]) < sum(p[1]) and p[3] == p[4]
    assert all(a >= b for row in p for a, b in zip(row, row[1:]))


def test_scores_against_plain_formula():
    model = toxicity.Model({"bad": 2.0, "worse": 3.0, "^badwo": 0.5, "": -0.25}, (1.0, 2.5))
    z = 2.0 * np.log2(3) + 3.0 * np.log2(2) + 0.5 * np.log2(2) - 0.25 * np.log2(6)
    assert np.allclose(model.scores(["Bad BAD fine worse badword"])[0], [1 / (1 + np.exp(1.0 - z)), 1 / (1 + np.exp(2.5 - z))])
    assert model.scores(["fine", None]) == [[0.0, 0.0]] * 2


def test_learning_is_the_same_on_executors(spark, corpus):
    """learn() chooses the features and fits the weights of fit() over the whole texts."""
    texts = {r.doc_id: r.text for r in corpus.collect()}
    bad = {k: f"{t} awful awfully {'vile ' * (k % 5)}" for k, t in texts.items() if k % 3 == 0}
    docs = spark.createDataFrame(list((texts | bad).items()), "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k in bad)) for k in texts], "doc_id bigint, toxic int")
    got = toxicity.learn(docs, labels)
    words = {k: toxicity.counted(t) for k, t in (texts | bad).items()}
    want = toxicity.fit([(int(k in bad), list(w), list(w.values())) for k, w in words.items()])
    assert {"awful", "awfully"} <= set(got.weights) == set(want.weights)
    assert np.allclose([got.weights[f] for f in sorted(got.weights)], [want.weights[f] for f in sorted(want.weights)], atol=1e-6) and np.allclose(got.cuts, want.cuts, atol=1e-6)


def test_words_late_in_a_long_text_are_learned(spark):
    filler = " ".join("".join(chr(97 + (k * 7 + j * (k // 26 + 1)) % 26) for j in range(6)) + chr(97 + k % 26) for k in range(9000))
    docs = spark.createDataFrame([(k, f"{filler} {'vileword' if k % 2 else 'nice'}") for k in range(40)], "doc_id bigint, text string")
    model = toxicity.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    assert "vileword" in model.weights


def sparse(seed, n=60, m=5):
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, m)) < 0.5, r.random((n, m)) * 3, 0.0)
    z = x @ np.array([1.0, -0.5, 2.0, 0.0, -1.0]) + r.logistic(size=n)
    grade = np.searchsorted([1.0, 2.5, 4.0], z)
    rows, cols = np.nonzero(x)
    return x, toxicity.Problem(grade, rows, cols, x[rows, cols], m, 0.02)


def test_slope_against_finite_differences():
    x, problem = sparse(1)
    theta = np.r_[0.3, -0.2, 0.5, 0.1, -0.4, 0.5, 1.5, 3.0]
    _, slope = problem.likelihood(theta)
    plain = 0.0
    for row, g in zip(x, problem.grade):  # the likelihood from its definition
        p = [1.0, *[1 / (1 + np.exp(c - row @ theta[:5])) for c in theta[5:]], 0.0]
        plain += np.log(p[g] - p[g + 1])
    assert np.isclose(problem.likelihood(theta)[0], plain - 0.01 * (theta[:5] @ theta[:5]))
    for k in range(len(theta)):
        step = np.eye(len(theta))[k] * 1e-6
        assert np.isclose(slope[k], (problem.likelihood(theta + step)[0] - problem.likelihood(theta - step)[0]) / 2e-6, atol=1e-4)


def test_climb_reaches_the_optimum():
    """A plain optimiser, one parameter at a time, finds nothing better."""
    _, problem = sparse(1)
    theta = toxicity.climb(problem, np.r_[np.zeros(5), -1.0, 0.0, 1.0], 3000, 0.05)
    reached, here, step = problem.likelihood(theta)[0], np.r_[np.zeros(5), -1.0, 0.0, 1.0], 0.5
    now = problem.likelihood(here)[0]
    while step > 1e-5:
        tries = [here + s * step * np.eye(8)[k] for k in range(8) for s in (1, -1)]
        value, k = max((problem.likelihood(t)[0], k) for k, t in enumerate(tries) if (np.diff(t[5:]) > 0).all())
        if value > now:
            now, here = value, tries[k]
        else:
            step /= 2
    assert abs(now - reached) < 1e-2 and np.allclose(theta, here, atol=0.05)


def test_odd(spark, odd, empty):
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(40)] + [(None, 1), (7, None), (8, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(odd, labels)
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and not [r for r in got.collect() if r.doc_id in (100, 101, 102) and r.toxic]
    assert toxicity.score(empty, model).count() == 0
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert not toxicity.score(odd, toxicity.learn(odd, none)).where("toxic").count()
    assert toxicity.learn(empty, labels) == toxicity.Model({}, ())
