"""Operator 4: near-duplicates by SimHash with a byte-position inverted index and count filtering.

Fingerprints of 64 bits that differ in at most BITS = 3 bits differ in at most three of their eight bytes, so they share at least SHARED = 5 (position, byte) postings. Lists of single postings would hold a 256th of all fingerprints, so they are dealt out by four postings at once: the fourteen blocks of the Steiner system S(3, 4, 8), of which, whichever three positions differ, one has only equal bytes. What lies in one place so has four postings in common. There the lists of the other four positions are made, (position, byte) by (position, byte), and a pair that meets in one of them has the tally of five. Pairs that meet in none are never compared. Retained pairs are verified bit by bit.

Only distinct fingerprints are indexed: exact copies meet in a group-by with partial aggregation. A list yields a spanning forest of its links, not all pairs: each fingerprint is expanded once against those not reached yet. In a list of over LIST members, which agree in five bytes, each fingerprint instead looks up the 2,324 others that it could be linked with: work grows with the list, not with its square, and no link is lost either way. A list holds distinct fingerprints that agree in 40 bits; one of near copies is bounded by the number of bit patterns near their centre, however many documents there are. Links become components in DataFrames.

Edge cases: null and empty texts and texts of white space have no words and the fingerprint zero, and are linked like any other. Repeated rows give repeated rows. A null id never names a component unless all ids of it are null. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, map_arrow
from .components import components

BITS, BYTES, SEED, SHINGLE = 3, 8, 42, 3
#: Least number of positional bytes that linked fingerprints share.
SHARED = BYTES - BITS
#: In lists above this size possible partners are looked up.
LIST = 4096
#: Blocks of the Steiner system: four places whose numbers cancel out under exclusive or.
BLOCKS = [b for b in combinations(range(BYTES), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a text's lower-cased word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for a in range(0, n, 1 << 16):
        part = words[a : a + (1 << 16) + shingle - 1]
        grams = zip(*[part[k:] for k in range(shingle)], strict=False)
        h = np.array([xxh64_intdigest(g, SEED) for g in map(b" ".join, grams)], np.uint64)
        total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(total * 2 > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The id and `fp`, a bigint with the fingerprint's bits, of each row."""

    def make():
        return lambda cols: [cols[0], [x - (1 << 64) if x >> 63 else x for x in (fingerprint(t, shingle) for t in cols[1])]]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col), F.col(text_col).alias("_text")), make, f"`{id_col}` {kind}, fp bigint", text="_text")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each is verified once against those not reached yet."""
    if len(fps) == 2:
        return [(fps[0], fps[1])] if int(fps[0] ^ fps[1]).bit_count() <= BITS else []
    out, open_ = [], fps
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            one = queue.pop()
            near = np.bitwise_count(open_ ^ one) <= BITS
            if near.any():
                hit = open_[near]
                out += [(one, x) for x in hit]
                queue += list(hit)
                open_ = open_[~near]
    return out


def partners(fps: np.ndarray, free: list[int]) -> list[tuple[int, int]]:
    """As forest() for distinct fingerprints that differ in the bits `free` at most: every pattern of BITS or fewer of these is looked up for all of them."""
    fps = np.sort(fps)
    root = np.arange(len(fps))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for n in range(1, BITS + 1):
        for bits in combinations(free, n):
            other = fps ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            for i in np.flatnonzero((fps[at] == other) & (fps < other) & (root != root[at])).tolist():
                a, b = top(i), top(int(at[i]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((fps[i], fps[at[i]]))
    return out


def links(fps: np.ndarray, block: tuple[int, ...] = ()) -> list[tuple[int, int]]:
    """Links that connect what is linked among distinct fingerprints that share the bytes at the positions of `block`: all that meet in SHARED - len(block) lists of the other positions."""
    octets, out = fps.view(np.uint8).reshape(-1, BYTES), []

    def narrowed(rows: np.ndarray, same: tuple[int, ...], after: int) -> None:
        if len(same) >= SHARED:
            out.extend(forest(fps[rows]) if len(rows) <= LIST else partners(fps[rows], [8 * k + b for k in range(BYTES) if k not in same for b in range(8)]))
            return
        for k in (k for k in range(after, BYTES) if k not in same):
            order = rows[np.argsort(octets[rows, k], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(octets[order, k])) + 1):
                if len(part) > 1:
                    narrowed(part, (*same, k), k + 1)

    narrowed(np.arange(len(fps)), tuple(block), 0)
    return out


def list_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (block, key, fp) rows. A list that goes on in the next batch waits for it."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def flush(cols):
        block, key, fp = cols
        starts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(key) != 0)]) if len(fp) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(fp)]
        pairs = [p for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True) for p in links(fp[a:b].astype(np.uint64, copy=False), BLOCKS[block[a]])]
        u, v = (np.array([p[k] for p in pairs], np.uint64).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        cols = [np.r_[h, c.to_numpy(zero_copy_only=False).astype(np.int64)] for h, c in zip(held, batch.columns, strict=True)]
        if len(cols[0]):
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            whole = len(same) - (np.argmin(same[::-1]) if not same.all() else len(same))
            held = [c[whole:] for c in cols]
            if whole:
                yield flush([cols[0][:whole], cols[1][:whole], cols[2][:whole].view(np.uint64)])
    yield flush([held[0], held[1], held[2].view(np.uint64)])


def postings(distinct: DataFrame) -> DataFrame:
    """block, key, fp for each distinct fingerprint and block of byte positions."""
    masks = [sum(0xFF << (8 * k) for k in b) for b in BLOCKS]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(n).cast("long").alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(signed)])
    return distinct.select(F.explode(keys).alias("k"), "fp").select("k.block", "k.key", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """For each row: the id, fingerprint (16 hex digits) and component_id, the smallest id that links lead to."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    lists = postings(rows.select("fp").distinct()).repartition("block", "key").sortWithinPartitions("block", "key")
    roots = components(lists.mapInArrow(list_links, "u bigint, v bigint"))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component one row, of its smallest id. Rows are told apart by id and text; a null id comes after all others."""
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.lit(SEED), F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    named = docs.withColumn("_id", row)
    kept = near_duplicates(named.select("_id", text_col), "_id", text_col, shingle).where(F.col("_id") == F.col("component_id")).select("_id").distinct()
    return named.join(kept, "_id", "left_semi").dropDuplicates(["_id"]).select(*docs.columns)
