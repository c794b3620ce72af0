"""Operator 7: language identification by cross-parsing entropy.

For each language a suffix automaton is built over the whole texts of a bounded sample of its labelled rows (SAMPLE_DOCS rows of at most SAMPLE_CHARS characters). A text is parsed from left to right into the longest phrases that the automaton knows; a phrase ends where no known substring goes on. The language whose reference needs the fewest phrases for each symbol, normalised by the entropy of its reference's size, wins. All letters of the references have a symbol of their own, over all code points. The automata are dense transition tables for the commonest letters and sorted transitions for the others, and all texts of a batch are walked in step in numpy, whole.

Prediction reads the text alone. Learning reads the text and the label of the rows that the caller gives for it.

Edge cases: a text that is null or has no letter is `und` with score 0. Ties go to the language that sorts first. With nothing to learn from every text is `und`. Repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, uniform

#: Learning: labelled rows of each language at most, characters that such a row has at most (if its language has no shorter one, its shortest), and symbols of the dense tables.
SAMPLE_DOCS, SAMPLE_CHARS, SYMBOLS = 24, 1000, 48
UNKNOWN = "und"


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """A reference text for each language: the whole texts of a bounded sample of its rows. Of the rows of at most `chars` characters, `docs` are taken by the hash of id and text, repeated rows once; a language of longer rows only gives one of its shortest. The driver gets some counts of each language, and the sample."""
    size, key = F.length(text_col), F.xxhash64(F.lit(7), F.col(id_col), F.col(text_col))
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), size.alias("size"), key.alias("key"))
    counts = {r.lang: r for r in known.groupBy("lang").agg(F.min("size").alias("least"), F.approx_count_distinct(F.when(F.col("size") <= chars, F.col("key"))).alias("n")).collect()}
    if not counts:
        return {}
    of = lambda f: F.create_map(*[F.lit(x) for k, r in counts.items() for x in (k, f(r))])[F.col("lang")]
    # Over twice the wanted share, for the counts are rough and draws scatter; of these, the first ones are taken.
    share = of(lambda r: min(1.0, 2.5 * docs / max(r.n, 1)))
    drawn = known.where((F.col("size") <= of(lambda r: max(r.least, chars))) & (uniform(F.col("key")) < share)).dropDuplicates(["lang", "key"])
    first = Window.partitionBy("lang").orderBy("key", "text")
    most = of(lambda r: docs if r.n else 1)
    rows = drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).select("lang", "place", "text").collect()
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(rows):
        out.setdefault(lang, []).append(text)
    return {lang: " ".join(texts) for lang, texts in out.items()}


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


class Model:
    """Automata of all languages in one transition table.

    `step[state * symbols + symbol]` holds twice the place of the next state, plus one where a phrase ends. States of language k lie after those of the languages before it. Letters that are not among the commonest have symbols from `width` on; their transitions are `next` at the place of `place * rare + symbol - width` in the sorted `keys`, and `first` where no known substring goes on.
    """

    def __init__(self, references: dict[str, str], symbols: int = SYMBOLS):
        self.langs = sorted(references)
        texts = [fold(references[k]) for k in self.langs]
        letters = Counter(c for t in texts for c in t if c.isalpha())
        self.alphabet = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
        self.width = min(len(self.alphabet) + 2, symbols)  # 0: not a letter, 1: a letter of no reference
        self.rare = len(self.alphabet) + 2 - self.width
        self.code = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.int32, 0x110000)
        for k, c in enumerate(self.alphabet):
            self.code[ord(c)] = k + 2
        self.starts, tables, base = [], [], 0
        others: list[tuple[int, int]] = []
        self.first = np.zeros((self.rare, len(texts)), np.int64)
        for k, t in enumerate(texts):
            edges = automaton(self.symbols(t).tolist())
            table = self.table(edges, base)
            w = self.width
            others += [((base + s * w) * self.rare + c - w, (base + t * w) * 2) for s, own in enumerate(edges) for c, t in own.items() if c >= w]
            self.first[:, k] = [(base + edges[0].get(c + w, 0) * w) * 2 + 1 for c in range(self.rare)]
            self.starts.append(base)
            tables.append(table)
            base += len(table)
        self.keys, self.next = np.array(sorted(others), np.int64).reshape(-1, 2).T.copy()
        self.step = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        if 2 * len(self.step) < 1 << 31:
            self.step = self.step.astype(np.int32)
        self.norm = np.array([np.log2(max(2, len(t))) for t in texts])

    def symbols(self, folded: str) -> np.ndarray:
        points = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.code[points]

    def table(self, edges: list[dict[int, int]], base: int) -> np.ndarray:
        w = self.width
        first = np.array([edges[0].get(c, 0) for c in range(w)], np.int64)
        out = np.tile((base + first * w) * 2 + 1, len(edges))
        for s, own in enumerate(edges):
            for c, t in own.items():
                if c < w:
                    out[s * w + c] = (base + t * w) * 2
        return out

    def rare_step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What `step` holds for states of all languages, by symbols from `width` on."""
        keys = state * self.rare + symbol[:, None] - self.width
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.next[at], self.first[symbol - self.width])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text under each language."""
        coded = [self.symbols(t) for t in texts]
        order = sorted(range(len(coded)), key=lambda i: -len(coded[i]))
        lengths = np.array([len(coded[i]) for i in order])
        most = int(lengths[0]) if len(order) else 0
        count = np.zeros((len(order), len(self.langs)), np.int64)
        state = np.tile(np.array(self.starts, np.int64), (len(order), 1))
        for a in range(0, most, 512):  # columns of 512 symbols for the texts that reach so far
            here = int(np.searchsorted(-lengths, -a, side="left"))
            block = np.zeros((512, here), np.int64)
            for k in range(here):
                part = coded[order[k]][a : a + 512]
                block[: len(part), k] = part
            live = np.searchsorted(-lengths, -np.arange(a + 1, min(most, a + 512) + 1), side="right")
            rare = block >= self.width
            dense, some = np.where(rare, 1, block), rare.any(1)
            for j, n in enumerate(live.tolist()):
                got = self.step.take(state[:n] + dense[j, :n, None])
                if some[j]:
                    own = np.flatnonzero(rare[j, :n])
                    got[own] = self.rare_step(state[own], block[j, own])
                count[:n] += got & 1
                np.right_shift(got, 1, out=state[:n])
        out = np.empty_like(count)
        out[order] = count
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score: how much fewer phrases the winner needs than the next, 0 to 1."""
        folded = [fold(t) if t else "" for t in texts]
        some = [i for i, t in enumerate(folded) if self.langs and any(map(str.isalpha, t))]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if some:
            size = np.array([len(folded[i]) for i in some])
            rate = (self.phrases([folded[i] for i in some]) + 1) * self.norm / size[:, None]
            best = rate.argmin(1)
            win = rate[np.arange(len(some)), best]
            rest = rate.copy()
            rest[np.arange(len(some)), best] = np.inf
            score = 1 - win / rest.min(1) if len(self.langs) > 1 else np.ones(len(some))
            for i, b, s in zip(some, best, score, strict=True):
                langs[i], scores[i] = self.langs[b], float(min(1.0, max(0.0, s)))
        return langs, scores


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


@lru_cache(2)
def model(references: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(references))


def identify(docs: DataFrame, references: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score of each row of `docs`."""
    fixed = tuple(sorted(references.items()))

    def make():
        m = model(fixed)

        def work(cols):
            return [cols[0], *m.predict(cols[1])]

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col), F.col(text_col).alias("_text")), make, f"`{id_col}` {kind}, lang_pred string, score double", text="_text")
