"""Operator 3: BPE encoding and decoding by batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat integer array. In each round the keys of adjacent symbols are looked up by binary search among the sorted keys of the merge table, every word finds the lowest rank among its pairs, and that pair is merged wherever it stands in the word. Words that are done leave the array. Results are kept for each word, in a cache of CACHE_BYTES at most, so that a word is merged once for many occurrences. Ids are int32 arrays throughout; the decoded text is made from them.

Latin texts are normalised and cut into words by patterns here, other texts by the tokenizer file's own normaliser and pre-tokenizer; the encoding itself does not use the library.

Edge cases: a null or empty text has no tokens, and its hashes are those of the empty string. Repeated rows give repeated rows. An empty table gives an empty table. Columns other than the id and the text are not passed on, so names can't clash. A text of any length is encoded whole: its words are independent, so a text of over PIECE characters is taken in pieces that end at a blank or line end, and a task holds its ids (four bytes each), its decoded text's hash and one piece.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

#: When the kept words take more than CACHE_BYTES (an entry has about ENTRY bytes besides its word and ids), only those of the texts at hand stay.
CACHE_BYTES, ENTRY = 16 << 20, 220
#: Characters that a piece of a long text has, about; ids that are put into words at once; bytes of text in a batch.
PIECE, AT_ONCE, BATCH = 1 << 20, 1 << 16, 1 << 20
NONE = np.int64(1) << 40


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it is visible Latin-1, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """Encoder and decoder for a tokenizers file whose model is byte-level BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        self.names = [named.get(i) for i in range(max(named, default=-1) + 1)]
        # The library is asked for words only, so it gets no vocabulary.
        library = Library.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": [], "unk_token": None}, "added_tokens": [], "post_processor": None, "decoder": None}))
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.apart = not any(c.isspace() for t in self.special for c in t)
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        end, size = model["end_of_word_suffix"] or "", max(max(vocab.values()), len(named)) + 1
        self.size = size
        chars = byte_chars()
        missing = [c for c in chars if c not in vocab or c + end not in vocab]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        self.of_char = {c: b for b, c in enumerate(chars)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        order = order[np.r_[True, np.diff(keys[order]) > 0]]  # a pair listed twice keeps its first rank
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = made
        # A merge may be applied to the whole word at once unless what it makes takes part in an earlier merge.
        first_use = np.full(size, NONE)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        self.at_once = first_use[made] > np.arange(len(pairs))
        self.fixed = {s: np.array([i], np.int32).tobytes() for s, i in self.special.items()}
        self.cache, self.room = dict(self.fixed), CACHE_BYTES

    def words(self, text: str) -> list[str]:
        """The normalised words of a text; special tokens are words of their own."""
        if self.cut_special and any(t in text for t in self.special):
            return [w for k, piece in enumerate(self.cut_special.split(text)) for w in ([piece] if k % 2 else self.plain_words(piece))]
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS(text.lower())
        if LATIN(composed := unicodedata.normalize("NFC", text)):
            return LATIN_WORDS(composed.lower())
        of = self.of_char
        return [bytes([of[c] for c in w]).decode("utf-8", "surrogateescape") for w, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each (non-empty) word."""
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), NONE)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            if (low == NONE).any():
                over = np.repeat(low == NONE, count)
                done.append((word[over], sym[over]))
                sym, word, rank = sym[~over], word[~over], rank[~over]
                count, low = count[low < NONE], low[low < NONE]
                if not len(sym):
                    break
            low_each = np.repeat(low, count)
            hit = rank == low_each
            start = np.r_[0, np.cumsum(count)[:-1]]
            place = np.arange(len(sym))
            if not self.at_once[low].all():  # one merge at a time where the order can matter
                leftmost = np.minimum.reduceat(np.where(hit, place, NONE), start)
                hit &= self.at_once[low_each] | (place == np.repeat(leftmost, count))
            before = np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(hit & ~before, place, 0))
            hit &= (place - run) % 2 == 0
            sym = np.where(hit, self.made[np.minimum(low_each, len(self.made) - 1)], sym)
            keep = ~np.r_[False, hit[:-1]]
            sym, word = sym[keep], word[keep]
        out_word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        out_sym = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        flat_ids = out_sym[np.argsort(out_word, kind="stable")].astype(np.int32).tobytes()
        cuts = 4 * np.r_[0, np.cumsum(np.bincount(out_word, minlength=len(words)))]
        return [flat_ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def learn(self, words: list[str]) -> None:
        """Puts the encoding of words into the cache."""
        for w, ids in zip(words, self.merge([w.encode("utf-8", "surrogateescape") for w in words]), strict=True):
            self.cache[w] = ids
            self.room -= ENTRY + len(w) + len(ids)

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces that no word lies across: a piece ends before a blank or line end, which belong to no word."""
        a = 0
        while len(text) - a > PIECE:
            b = max(text.rfind(" ", a + 1, a + PIECE), text.rfind("\n", a + 1, a + PIECE))
            if b < 0:
                ends = [x for x in (text.find(" ", a + PIECE), text.find("\n", a + PIECE)) if x >= 0]
                b = min(ends, default=len(text))
            yield text[a:b]
            a = b
        if a < len(text):
            yield text[a:]

    def encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as int32. New words of all texts, or of a piece of a long one, are merged together."""
        long = [bool(t) and len(t) > PIECE and self.apart for t in texts]
        if not any(long):
            return self._encoded(texts)
        return [np.concatenate([x for p in self.pieces(t) for x in self._encoded([p])]) if far else self._encoded([t])[0] for t, far in zip(texts, long, strict=True)]

    def _encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.words(t or "") for t in texts]
        used = set().union(*cut)
        if self.room < 0:
            self.cache = self.fixed | {w: e for w, e in self.cache.items() if w in used}
            self.room = CACHE_BYTES - sum(ENTRY + len(w) + len(e) for w, e in self.cache.items())
        if missing := [w for w in used if w not in self.cache]:
            self.learn(missing)
        kept = self.cache
        return [np.frombuffer(b"".join([kept[w] for w in own]), np.int32) for own in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encoded([text])[0].tolist()

    def words_of(self, ids) -> list[str]:
        names, most = self.names, len(self.names)
        return [n for i in ids if 0 <= i < most and (n := names[i]) is not None]

    def decode(self, ids) -> str:
        """Token strings joined by one space, as a tokenizer without a decoder gives them; unknown ids are left out."""
        return " ".join(self.words_of(ids))

    def hashes(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the ids, and of the text that they decode to, some of them at a time."""
        of_ids, of_text = hashlib.sha256(), hashlib.sha256()
        any_text = False
        for a in range(0, len(ids), AT_ONCE):
            part = ids[a : a + AT_ONCE].tolist()
            of_ids.update((" " * (a > 0) + " ".join(map(str, part))).encode())
            if words := self.words_of(part):
                of_text.update((" " * any_text + " ".join(words)).encode())
                any_text = True
        return of_ids.hexdigest(), of_text.hexdigest()


def _class(kinds: str) -> str:
    """The characters below U+0370 of some general categories, for use in a pattern."""
    return "".join(re.escape(chr(c)) for c in range(0x370) if unicodedata.category(chr(c))[0] in kinds)


#: White space as the tokenizer's pattern language has it, below U+0370.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_CUT = "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{2}{0}{1}]+"
ASCII_WORDS = re.compile(_CUT.format("a-z", "0-9", "\t\n\x0b\x0c\r ")).findall
LATIN_WORDS = re.compile(_CUT.format(_class("L"), _class("N"), _SPACE)).findall
#: Texts of these characters alone take the quick way; they mean the same in every Unicode version in use. Other texts go through the library's own normaliser and cutter.
LATIN = re.compile(r"[\x00-\u036f\u2010-\u2027]*").fullmatch


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of `docs`: the id column, n_tokens, ids_sha256, decoded_sha256 and, on demand, ids. `path` is the tokenizer file, at the same place on every machine."""

    def make():
        tok = tokenizer(path)

        def work(cols):
            ids, texts = cols
            got = tok.encoded(texts)
            sizes = [len(g) for g in got]
            of_ids, of_text = zip(*map(tok.hashes, got), strict=True) if got else ((), ())
            out = [ids, sizes, of_ids, of_text]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate([*got, np.zeros(0, np.int32)]))))
            return out

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col(id_col), F.col(text_col).alias("_text")), make, schema, text="_text", batch_bytes=BATCH)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column and the decoded text of a column of token ids; null ids decode to the empty string."""

    def make():
        tok = tokenizer(path)
        return lambda cols: [cols[0], [tok.decode(i or []) for i in cols[1]]]

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_arrow(encoded.select(F.col(id_col), F.col(ids_col).alias("_ids")), make, f"`{id_col}` {kind}, text string")
