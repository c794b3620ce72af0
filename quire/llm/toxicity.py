"""Operator 1: toxicity by cumulative-link ordinal regression over sparse text features.

Grades: 0 for documents labelled clean; documents labelled toxic get the grades 1 to GRADES by how much of what is significantly more frequent in toxic than in clean labelled documents they hold. One weight vector serves all ordered thresholds: P(grade >= k) = s(w.x - c_k) with c_1 < c_2 < ... Features are words and the beginnings of words (compounds of an abusive stem are rare one by one), each valued log2(1 + count), and the text's length, so that one hit weighs less in a long text. The expected severity is the sum of these probabilities; a document is toxic where P(grade >= 1) is over one half.

Fitting uses a bounded sample of labelled rows (SAMPLE_ROWS, picked by the hash of the id), whole texts. The executors count in how many of them each feature occurs and choose the VOCABULARY most significant ones, then make a sparse vector of each text; the driver gets these and fits in numpy. Grades are quantiles of evidence within the sample's toxic documents, so severity is relative to the sample. Scoring reads every whole text.

Edge cases: an id of several texts is learned from by the one whose hash is least, so refits agree. a text without any of the features, null and empty ones included, has severity 0. Rows without an id or a label are not learned from; an id that is labelled more than once counts as toxic if any label is. With no toxic or no clean label nothing is toxic and the severity is 0. Repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, map_arrow, slices

#: Labelled rows that fitting uses at most, features of the model at most (the most significant ones), toxic documents that a feature must occur in, and the likelihood ratio (twice its logarithm) by which its frequency must differ: so high that chance among some hundred thousand features hardly reaches it.
SAMPLE_ROWS, VOCABULARY, LEAST_DOCS, SIGNIFICANT, GRADES = 8000, 20_000, 4, 25.0, 3
#: Lengths of beginnings, and how many words' features a scorer keeps.
BEGINNINGS, KEPT = (5, 6, 7, 8), 200_000
WORDS = re.compile(r"[^\W\d_]+").findall
#: The feature that holds the number of words; no word is empty.
LENGTH = ""


def features(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


class Model(NamedTuple):
    weights: dict[str, float]
    cuts: tuple[float, ...]

    def scores(self, texts: list[str | None]) -> list[list[float]]:
        """P(grade >= k) for each k, for each text."""
        own: dict[str, tuple] = {}
        z = np.full(len(texts), -np.inf)
        for i, text in enumerate(texts):
            if not text:
                continue
            found: dict[str, int] = {}
            words = Counter(WORDS(text.lower()))
            total = sum(words.values())
            for word, n in words.items():
                if (known := own.get(word)) is None:
                    if len(own) >= KEPT:
                        own.clear()
                    own[word] = known = tuple(f for f in features(word) if f in self.weights)
                for f in known:
                    found[f] = found.get(f, 0) + n
            if found:
                z[i] = sum(self.weights[f] * math.log2(1 + n) for f, n in found.items()) + self.weights.get(LENGTH, 0.0) * math.log2(1 + total)
        if not self.cuts:
            return [[0.0] for _ in texts]
        p = 1 / (1 + np.exp(np.clip(np.array(self.cuts) - z[:, None], -500, 500)))
        return np.where(np.isneginf(z)[:, None], 0.0, p).tolist()


def counted(text: str) -> dict[str, int]:
    return Counter(WORDS(text.lower()))


def of_text(words: dict[str, int]) -> dict[str, int]:
    """How often each feature occurs, given a text's words."""
    found: dict[str, int] = {}
    for w, n in words.items():
        for f in features(w):
            found[f] = found.get(f, 0) + n
    return found


def evidence(bad: np.ndarray, seen: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """Of features that occur in `bad` toxic documents and `seen` in all: the logarithm of the lift, and twice the logarithm of the likelihood ratio where the lift is over one (else 0)."""
    lift = np.log((bad + 0.5) / (n1 + 1)) - np.log((seen - bad + 0.5) / (n0 + 1))
    base = n1 / max(n1 + n0, 1)
    part = lambda k, share: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(seen * share, 1e-300)), 0.0)
    return lift, np.where((lift > 0) & (bad >= LEAST_DOCS), 2 * (part(bad, base) + part(seen - bad, 1 - base)), 0.0)


class Feature(NamedTuple):
    name: str
    lift: float
    strength: float


def best(found: Iterable[Feature]) -> list[Feature]:
    return sorted((f for f in found if f.strength >= SIGNIFICANT), key=lambda f: (-f.strength, f.name))[:VOCABULARY]


def vector(words: dict[str, int], place: dict[str, int]) -> tuple[list[int], list[float]]:
    """Places and values of a text's features, the length's last."""
    found = [(place[f], math.log2(1 + n)) for f, n in of_text(words).items() if f in place]
    return [p for p, _ in found] + [len(place)], [v for _, v in found] + [math.log2(1 + sum(words.values()))]


def fit(sample: list[tuple[int, list[str], list[int]]], **options) -> Model:
    """The model of a few rows (label, words, counts): what learn() does on executors, in one place."""
    texts = [dict(zip(words, n, strict=True)) for _, words, n in sample]
    y = [int(s[0] > 0) for s in sample]
    seen, bad = Counter(f for t in texts for f in of_text(t)), Counter(f for t, l in zip(texts, y, strict=True) if l for f in of_text(t))
    names = list(bad)
    n1 = sum(y)
    lift, strength = evidence(np.array([bad[f] for f in names], float), np.array([seen[f] for f in names], float), n1, len(y) - n1)
    chosen = best(map(Feature, names, lift.tolist(), strength.tolist()))
    place = {f.name: k for k, f in enumerate(chosen)}
    return solve(y, [vector(t, place) for t in texts], chosen, **options)


class Problem(NamedTuple):
    """The sample as arrays: grades, and the places of feature values. Parameters are the weights, then the cuts."""

    grade: np.ndarray
    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    names: int
    ridge: float

    def likelihood(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Log likelihood less the ridge, and its slope. The derivative of log P(grade = g) by w.x is 1 - P(grade >= g) - P(grade >= g + 1)."""
        w, cuts = theta[: self.names], theta[self.names :]
        n, each = len(self.grade), np.arange(len(self.grade))
        z = np.bincount(self.rows, w[self.cols] * self.vals, n)
        above = np.c_[np.ones(n), 1 / (1 + np.exp(np.clip(cuts - z[:, None], -500, 500))), np.zeros(n)]
        here, over = above[each, self.grade], above[each, self.grade + 1]
        p = np.maximum(here - over, 1e-9)
        by_cut = np.zeros((n, len(cuts) + 2))
        by_cut[each, self.grade] -= here * (1 - here) / p
        by_cut[each, self.grade + 1] += over * (1 - over) / p
        slope = np.r_[np.bincount(self.cols, (1 - here - over)[self.rows] * self.vals, self.names) - self.ridge * w, by_cut[:, 1:-1].sum(0)]
        return float(np.log(p).sum() - self.ridge * (w @ w) / 2), slope


def graded(y: np.ndarray, amount: np.ndarray, grades: int) -> np.ndarray:
    """Grade 0 for clean rows; toxic ones are cut at the quantiles of their amount of evidence."""
    inner = np.quantile(amount[y > 0], np.arange(1, grades) / grades) if grades > 1 else np.zeros(0)
    grade = np.where(y > 0, 1 + np.searchsorted(inner, amount, side="left"), 0)
    return np.searchsorted(np.unique(grade), grade)  # a grade that ties leave empty is none


def solve(labels: list[int], vectors: list[tuple[list[int], list[float]]], chosen: list[Feature], grades: int = GRADES, ridge: float = 0.02, steps: int = 800, rate: float = 0.05) -> Model:
    """Maximum likelihood with a ridge by Adam over sparse vectors, whose last place is the length."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model({}, ())
    names = [f.name for f in chosen] + [LENGTH] * bool(chosen)
    size = [len(p) if chosen else 0 for p, _ in vectors]
    rows = np.repeat(np.arange(len(y)), size)
    cols, vals = (np.concatenate([np.asarray(v[k], t) for v in vectors]) if chosen else np.zeros(0, t) for k, t in enumerate((np.int64, np.float64)))
    strong = np.array([f.lift > math.log(4) and not f.name.startswith("^") for f in chosen] + [False], bool)
    amount = np.bincount(rows, vals * strong[cols], len(y)) if chosen else np.zeros(len(y))
    problem = Problem(graded(y, amount, grades), rows, cols, vals, len(names), ridge)
    top = int(problem.grade.max())
    share = (problem.grade[:, None] >= np.arange(1, top + 1)).mean(0)
    theta = climb(problem, np.r_[np.zeros(len(names)), np.log((1 - share + 1e-3) / (share + 1e-3))], steps, rate)
    return Model({f: float(x) for f, x in zip(names, theta, strict=False) if abs(x) > 1e-4}, tuple(map(float, theta[len(names) :])))


def climb(problem: Problem, theta: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam from `theta` on; the cuts stay in order. Few steps stop early, which holds weights of rare features back further than the ridge does."""
    first, second, n = np.zeros_like(theta), np.zeros_like(theta), problem.names
    apart = 1e-3 * np.arange(len(theta) - n)
    for t in range(1, steps + 1):
        _, slope = problem.likelihood(theta)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        theta[n:] = np.maximum.accumulate(theta[n:] + apart) - apart
    return theta


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """label, text of each id of the sample, written to the shared folder."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    picked = known.orderBy(F.xxhash64(F.col(id_col), F.lit(11)), id_col).limit(rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(picked), id_col)  # `rows` rows at most
    one = texts.groupBy(id_col).agg(F.first("_label").alias("label"), F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("t"))
    return cut(one.select(F.col(id_col).alias("id"), "label", F.col("t._text").alias("text")))


def feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, bad, seen over the texts (label, text) of a task."""
    seen, bad = Counter(), Counter()
    for batch in batches:
        for part in slices(batch, 1):
            for label, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                own = of_text(counted(text))
                seen.update(own.keys())
                if label:
                    bad.update(own.keys())
    names = list(seen)
    for a in range(0, len(names), 1 << 16):
        part = names[a : a + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string()), "bad": pa.array([bad[f] for f in part], pa.int64()), "seen": pa.array([seen[f] for f in part], pa.int64())})


def choose(sample: DataFrame, n1: int, n0: int) -> list[Feature]:
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lift, strength = evidence(batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).to_numpy(zero_copy_only=False).astype(float), n1, n0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lift), pa.array(strength)], names=["name", "lift", "strength"]).filter(pa.array(strength >= SIGNIFICANT))

    counts = sample.select("label", "text").mapInArrow(feature_counts, "feature string, bad bigint, seen bigint").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")).where(F.col("bad") >= LEAST_DOCS)
    found = counts.mapInArrow(judged, "name string, lift double, strength double").orderBy(F.desc("strength"), "name").limit(VOCABULARY)
    return best(Feature(*r) for r in found.collect())


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled(docs, labels, id_col, text_col, label_col, rows)
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return Model({}, ())
    chosen = choose(sample, n[1], n[0])
    place = {f.name: k for k, f in enumerate(chosen)}

    def make():
        def work(cols):
            found = [vector(counted(t), place) for t in cols[1]]
            return [cols[0], [p for p, _ in found], [v for _, v in found]]

        return work

    rows_of = map_arrow(sample.orderBy(F.xxhash64("id", F.lit(11)), "id").select("label", "text"), make, "label int, places array<int>, values array<double>", text="text").toArrow()
    return solve(rows_of["label"].to_pylist(), list(zip(rows_of["places"].to_pylist(), rows_of["values"].to_pylist(), strict=True)), chosen)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs`, then severity (expected grade), p_toxic, grade (thresholds passed with over one half) and toxic."""
    keep = keep or ["doc_id"]
    bound = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY weights at most

    def make():
        m = bound.value

        def work(cols):
            p = m.scores(cols[-1])
            return [*cols[:-1], [sum(x) for x in p], [x[0] for x in p], [sum(v > 0.5 for v in x) for x in p], [x[0] > 0.5 for x in p]]

        return work

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*keep, F.col(text_col).alias("_scored")), make, f"{schema}, severity double, p_toxic double, grade int, toxic boolean", text="_scored")
