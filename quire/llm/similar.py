"""Near copies by Jaccard similarity: all pairs of texts whose sets of five-word shingles have a similarity of 4/5 or more, and the components that these pairs make.

Such pairs are found by SimHash with an inverted index over positional bytes and count filtering, and verified on whole sets. No SimHash guarantees them (of 128 bits they differ by about 19), so an exact check of what fingerprints leave apart follows, by an index over shingles.

SimHash: a fingerprint has BYTES bytes. Texts are posted under two equal bytes of one half; in these lists those of the other positions are made, so what meets shares SHARED = 3 positional bytes, and any three have two in one half. Members are verified bit by bit against the next one of their list, in BITS bits. Of the retained pairs each text's closest one is verified on whole sets, then each component's, in CLOSEST rounds. A list of over MEMBERS texts is looked at in parts; what that or these rounds leave out, the exact check finds.

Exact check of the rest:

1. All texts sort their shingles by one order, rare ones first (a table of 2**20 counters, so the order is rough, which costs time but no pairs). If two sets of n and m shingles share 4/9 of n + m, they share one of the first n - ceil(4 n / 5) + 1 in this order. Only these are posted.
2. Chains: the members of each list, in one order for all lists, are linked with the RING next ones. Lists of near copies have nearly the same members, so these links are few, however many lists repeat them. They are verified and become components: a group of near copies is one component from here on, and no list emits its pairs.
3. Nearest: where a list's members lie in several components, each component's pair with the most alike sketches is verified, NEAREST times, and components grow by what holds. So the pieces that chains leave of a large group of near copies meet before pairs of theirs are listed.
4. Across: where a list's members still lie in several components, pairs of two components are listed and verified.

A pair is passed over at once if sizes, places in the order or sketches show that it can't be similar. All three bounds are exact: a sketch holds the parities of the shingles in SKETCH * 64 cells, and sets differ in at least as many shingles as parities. And a pair is passed over in a list if it meets in another one before: each member knows the LOOK lists that it was in just before this one, and if two members have one of these in common, they are a pair there already. The first list that a pair shares always shows it.

A list of more than BLOCK texts is cut into blocks, and each two blocks of it are one group, so no task holds more than 2 BLOCK members of a list at once. A shingle is a hash of 64 bits of lower-cased words (ASCII, as in simhash); a text is known by a hash of 64 bits.

Edge cases: a text of at most five words is one shingle; null and empty texts and texts of white space are copies of each other. Repeated rows and rows that share an id with another text are told apart by their text; of several rows equal in id and text one can stay. A null id comes after all others. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, freed, map_arrow, removed, stored
from .components import components

SHINGLE, SEED = 5, 42
#: Neighbours that a member of a list is linked with, members of a list that are compared in one place, and lists before one that its members know.
RING, BLOCK, LOOK = 2, 1024, 4
#: Words of 64 parities in a sketch, and rounds in which components are linked by their most alike members.
SKETCH, NEAREST = 4, 1
#: Rounds in which each component grows by its closest retained pair.
CLOSEST = 2
#: Counters of the order, and parts in which they are summed.
COUNTERS, PARTS = 1 << 20, 64
#: Words whose hashes a task keeps, and pairs that it holds at once.
KEPT, PAIRS = 1 << 17, 1 << 16
#: So many keys are sent to all executors, so that texts not asked for aren't shuffled.
FEW = 1 << 20
PARITIES, BEFORE = [f"s{k}" for k in range(SKETCH)], [f"b{k}" for k in range(LOOK)]
#: A fingerprint has 64 bits for each salt. Pairs that share SHARED of its positional bytes and differ in at most BITS bits are retained.
SALTS, SHARED, BITS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 3, 36
PRINTS = [f"f{k}" for k in range(len(SALTS))]
BYTES = 8 * len(PRINTS)
#: Lists have two positions in one half of the fingerprint: of any three positions two are in the same half. MEMBERS of a list are looked at together.
BLOCKS, MEMBERS = [b for k in range(len(PRINTS)) for b in combinations(range(8 * k, 8 * k + 8), 2)], 1 << 15


def least(n):
    """Shingles that a set of n shares with any similar one, at least."""
    return -(-4 * n // 5)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingler(distinct: bool = True) -> Callable[[str | None], np.ndarray]:
    """A function from a text to its sorted distinct shingles, or to all of them in their order."""
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = {}

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) < SHINGLE:
            return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        if len(known) > KEPT:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxh64_intdigest(w, SEED)
        h, n = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), len(words) - SHINGLE + 1
        total = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
        return np.unique(mixed(total)) if distinct else mixed(total)

    return shingles


def counters(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def levels(docs: DataFrame, text_col: str) -> np.ndarray:
    """The logarithm, in quarters, of how often a shingle of each counter occurs. The driver gets one byte for each counter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = shingler(distinct=False), np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, counters(shingles(text.as_py())), 1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "n": pa.array([x.tobytes() for x in total.reshape(PARTS, -1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(n, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "n": pa.array([(4 * np.log2(x + 1)).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())})

    kind = "part int, n binary"
    rows = docs.select(text_col).mapInArrow(count, kind).repartition("part").mapInArrow(add, kind).collect()
    return np.frombuffer(b"".join(r.n for r in sorted(rows, key=lambda r: r.part)) or bytes(COUNTERS), np.uint8)


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCH numbers: the parity of the shingles in each of their bits."""
    cells = np.bincount((h % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles: a number for each of SALTS, whose bits are set in over half the shingles' hashes."""
    total, step = np.zeros(64 * len(SALTS), np.int64), 1 << 16
    for a in range(0, len(h), step):
        wide = np.stack([mixed(h[a : a + step] ^ np.uint64(salt)) for salt in SALTS], axis=1)
        total += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * total > len(h)).view(np.int64)


def postings(docs: DataFrame, level: np.ndarray, text_col: str) -> DataFrame:
    """h, key, n (size of the whole set) and place in the order for the first shingles of each text, and one row with a null h, the sketch and the fingerprint. A task posts a text once; other tasks may post it again."""

    def make():
        shingles, seen = shingler(), set()

        def work(cols):
            hs, keys, ns, places, parities = [], [], [], [], []
            for key, text in zip(*cols, strict=True):
                if key in seen:
                    continue
                seen.add(key)
                h = shingles(text)
                n = len(h)
                first = np.argsort(level[counters(h)], kind="stable")[: n - least(n) + 1]
                hs.append(np.r_[h[first], np.uint64(0)])
                keys.append(np.full(len(first) + 1, key, np.int64))
                ns.append(np.full(len(first) + 1, n, np.int32))
                places.append(np.r_[np.arange(len(first)), -1])
                parities.append(np.r_[sketch(h), fingerprint(h)])
            if not hs:
                return [[] for _ in range(4 + len(PARITIES + PRINTS))]
            place = np.concatenate(places)
            own = place < 0
            wide = np.zeros((len(place), len(PARITIES + PRINTS)), np.int64)
            wide[own] = parities
            return [pa.array(np.concatenate(hs).view(np.int64), mask=own), np.concatenate(keys), np.concatenate(ns), place.astype(np.int32), *[pa.array(wide[:, k].copy(), mask=~own) for k in range(wide.shape[1])]]

        return work

    return map_arrow(docs.select("_key", F.col(text_col).alias("_text")), make, "h bigint, key bigint, n int, place int, " + ", ".join(f"{c} bigint" for c in PARITIES + PRINTS), text="_text", batch_bytes=1 << 20)


def close(n, m, p, q):
    """Whether sets of sizes n and m that share the shingle at places p and q can be similar: what they share before and after it is bounded."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * (np.minimum(p, q) + np.minimum(n - p, m - q)) >= 4 * (n + m))


def whole_lists(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first `keys` ones, so that no list is cut."""
    held: list[list[np.ndarray]] = []
    width = 0
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        width = len(cols)
        if not len(cols[0]):
            continue
        other = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
        last = int(other[-1]) + 1 if len(other) else 0
        if last or (held and any(held[-1][k][-1] != cols[k][0] for k in range(keys))):
            done = [*held, [c[:last] for c in cols]]
            held = []
            yield [np.concatenate([d[k] for d in done]) for k in range(width)]
        held.append([c[last:] for c in cols])
    if held:
        yield [np.concatenate([d[k] for d in held]) for k in range(width)]


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Retained pairs u, v, with the number of bits in which they differ, of rows (list, key, fingerprint) sorted by the first two. A list has the fingerprints with two equal bytes (its block is list >> 16); in it the lists of the other positions are made, so members of these share SHARED bytes, and each is verified against the next one. A pair is told by the first block that it shares."""
    places = np.array(BLOCKS)
    for cols in whole_lists(batches, 1):
        for a, b in runs(cols[0]):
            of, key = cols[0][a:b], cols[1][a:b]
            new = np.r_[True, (np.diff(of) != 0) | (np.diff(key) != 0)]
            of, key, prints = of[new], key[new], np.stack([c[a:b][new] for c in cols[2:]], axis=1)
            octets = prints.view(np.uint8)
            number = np.cumsum(np.r_[False, np.diff(of) != 0])
            block = of >> 16
            found = []
            for k in range(BYTES):
                # Three positions in one half are made once, from the first two of them.
                rows = np.flatnonzero((k // 8 != places[block, 0] // 8) | (k > places[block, 1]))
                code = ((number[rows] << 8) | octets[rows, k]).astype(np.uint16)
                order = np.argsort(code, kind="stable")
                rows, code = rows[order], code[order]
                at = np.flatnonzero(code[1:] == code[:-1])
                found.append(np.stack([rows[at], rows[at + 1]]))
            x, y = np.unique(np.concatenate(found, axis=1), axis=1)
            differ = np.bitwise_count((prints[x] ^ prints[y]).view(np.uint64)).sum(1, dtype=np.int32)
            x, y, differ = x[differ <= BITS], y[differ <= BITS], differ[differ <= BITS]
            same = octets[x] == octets[y]
            first = np.argmax(same[:, places[:, 0]] & same[:, places[:, 1]], axis=1) == block[x]
            x, y, differ = x[first], y[first], differ[first]
            if len(x):
                yield pa.RecordBatch.from_pydict({"u": pa.array(np.minimum(key[x], key[y])), "v": pa.array(np.maximum(key[x], key[y])), "differ": pa.array(differ)})


def runs(of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of sorted numbers: 256 different ones at most, and MEMBERS rows at most unless one number has more, which is cut."""
    starts = np.flatnonzero(np.r_[True, np.diff(of) != 0])
    ends, a = np.r_[starts[1:], len(of)], 0
    while a < len(starts):
        b = max(a + 1, min(a + 256, int(np.searchsorted(ends, starts[a] + MEMBERS, "right"))))
        for c in range(int(starts[a]), int(ends[b - 1]), MEMBERS):
            yield c, min(c + MEMBERS, int(ends[b - 1]))
        a = b


def alike(prints: DataFrame) -> DataFrame:
    """Pairs u, v of keys, and in how many bits they differ, whose fingerprints share SHARED positional bytes and differ in at most BITS bits, by an inverted index over these bytes."""

    def octet(k: int) -> Column:
        return F.shiftrightunsigned(PRINTS[k // 8], 8 * (k % 8)).bitwiseAND(F.lit(255))

    lists = F.array(*[(F.lit(n << 16) + octet(i) * 256 + octet(j)).cast("int") for n, (i, j) in enumerate(BLOCKS)])
    rows = prints.select(F.explode(lists).alias("list"), "key", *PRINTS).repartition("list").sortWithinPartitions("list", "key")
    return rows.mapInArrow(tallied, "u bigint, v bigint, differ int").distinct()


#: Rows of the pass over the lists: a pair (u, v), and a member of a list (h, key, size, place).
LINK, MEMBER = 0, 1


def rows_of(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a), "b": pa.array(b), "n": pa.array(n.astype(np.int32)), "place": pa.array(place.astype(np.int32))})


def chains(batches: Iterator[pa.RecordBatch], ring: int) -> Iterator[pa.RecordBatch]:
    """Links and members of the lists in rows sorted by h and key, of which another task may have the rows before or after. Only `ring` rows are carried from batch to batch, and one that waits for the row after it. A list of one member is left out unless it is the first or last here, for it may go on elsewhere."""

    def told(cols: list[np.ndarray], a: int, b: int, begin: bool, end: bool) -> Iterator[pa.RecordBatch]:
        """What the rows from a to b show."""
        h, key, n, place = cols
        same = h[1:] == h[:-1]
        single = ~(np.r_[begin & (h[0] == h[:1]), same] | np.r_[same, np.full(1, end)])
        at = a + np.flatnonzero(~single[a:b])
        yield rows_of(MEMBER, h[at], key[at], n[at], place[at])
        found = []
        for r in range(1, ring + 1):
            j = np.arange(max(a, r), b)
            j = j[h[j] == h[j - r]]
            i = j - r
            ok = close(n[i], n[j], place[i], place[j])
            found.append(np.stack([key[i[ok]], key[j[ok]]]))
        u, v = np.unique(np.concatenate(found, axis=1), axis=1)
        yield rows_of(LINK, u, v, u * 0, u * 0)

    held, begin = [np.zeros(0, np.int64)] * 4, True
    for batch in batches:
        old = len(held[0])
        cols = [np.r_[x, c.to_numpy(zero_copy_only=False).astype(np.int64)] for x, c in zip(held, batch.columns, strict=True)]
        new = np.r_[True, (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)] if len(cols[0]) else np.zeros(0, bool)
        cols = [c[new] for c in cols]
        size = len(cols[0])
        if size > max(old, 1):
            yield from told(cols, max(old - 1, 0), size - 1, begin, False)
            begin = False
        held = [c[-(ring + 1) :] for c in cols]
    if len(held[0]):
        yield from told(held, len(held[0]) - 1, len(held[0]), begin, True)


def crossing(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs u, v of two components, or only each component's most alike pair of each list. In rows (h, i, j, own, key, n, place, root, lists before, sketch), which are sorted by the first three. A group has the members of block i, or of the blocks i and j, of the list of h; `own` is a member's block."""
    for h, i, j, own, key, n, place, root, *rest in whole_lists(batches, 3):
        before, s = rest[:LOOK], rest[LOOK:]
        starts = np.flatnonzero(np.r_[True, (np.diff(h) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
        sizes = np.diff(np.r_[starts, len(h)])
        found, count = [], 0

        def pairs(p: np.ndarray, q: np.ndarray) -> None:
            nonlocal count
            for a in range(0, len(p), PAIRS):
                x, y = p[a : a + PAIRS], q[a : a + PAIRS]
                # Two blocks of a list meet once; within a block its members meet in the group of the block alone.
                ok = (root[x] != root[y]) & close(n[x], n[y], place[x], place[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
                x, y = x[ok], y[ok]
                differ = np.zeros(len(x), np.int64)
                for c in s:
                    differ += np.bitwise_count((c[x] ^ c[y]).view(np.uint64))
                ok = 9 * differ <= n[x] + n[y]
                x, y, differ = x[ok], y[ok], differ[ok]
                met = np.zeros(len(x), bool)
                for c in before:
                    for d in before:
                        met |= c[x] == d[y]
                x, y, differ = x[~met], y[~met], differ[~met]
                u, v = np.minimum(key[x], key[y]), np.maximum(key[x], key[y])
                if nearest:
                    part = (differ << 32) // (n[x] + n[y])
                    for own_root in (root[x], root[y]):
                        found.append(first_of(np.stack([h[x], own_root, part, u, v])))
                else:
                    found.append(np.stack([u, v]))
                count += len(x)

        for size in np.unique(sizes[sizes > 1]).tolist():
            at = starts[sizes == size]
            if size > 64:
                for a in at.tolist():
                    for b in range(a, a + size - 1, max(1, PAIRS // size)):
                        rows = np.arange(b, min(a + size - 1, b + max(1, PAIRS // size)))
                        p = np.repeat(rows, a + size - 1 - rows)
                        pairs(p, p + 1 + np.concatenate([np.arange(a + size - 1 - r) for r in rows.tolist()]))
            else:
                x, y = np.triu_indices(size, 1)
                step = max(1, PAIRS // len(x))
                for a in range(0, len(at), step):
                    pairs((at[a : a + step, None] + x).ravel(), (at[a : a + step, None] + y).ravel())
                    if count > PAIRS:
                        yield listed(found)
                        found.clear()
                        count = 0
            if count > PAIRS:
                yield listed(found)
                found.clear()
                count = 0
        if count:
            yield listed(found)


def first_of(rows: np.ndarray) -> np.ndarray:
    """Of the columns of `rows` that agree in the first two places the least one."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)][: rows.shape[1]]]


def listed(found: list[np.ndarray]) -> pa.RecordBatch:
    """u, v of these pairs, each once."""
    rows = np.concatenate(found, axis=1)
    u, v = np.unique(first_of(rows)[3:] if len(rows) > 2 else rows, axis=1)
    return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v)})


def verified(docs: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """The pairs u, v of keys whose texts are similar."""

    def make():
        shingles, last = shingler(), [None, None]

        def similar(x: str, v: int, y: str) -> bool:
            if v != last[0]:  # rows come sorted by v
                last[:] = v, shingles(y)
            a, b = shingles(x), last[1]
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 5 * both >= 4 * (len(a) + len(b) - both)

        def work(cols):
            ok = [k for k, (_, v, x, y) in enumerate(zip(*cols, strict=True)) if similar(x, v, y)]
            return [[cols[0][k] for k in ok], [cols[1][k] for k in ok]]

        return work

    wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("_key")).distinct())
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = docs.select("_key", F.col(text_col).alias("_text")).join(wanted, "_key", "left_semi")
    texts = texts.dropDuplicates(["_key"])
    both = pairs.join(texts.select(F.col("_key").alias("u"), F.col("_text").alias("x")), "u").join(texts.select(F.col("_key").alias("v"), F.col("_text").alias("y")), "v")
    return cut(map_arrow(both.select("u", "v", "x", "y"), make, "u bigint, v bigint", text="x"))


def differing(one: str, two: str) -> Column:
    """In how many parities two sketches differ."""
    return sum((F.bit_count(F.col(f"{one}.{c}").bitwiseXOR(F.col(f"{two}.{c}"))) for c in PARITIES), F.lit(0))


def links(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Pairs u, v of `_key`s of similar texts, such that all similar texts are connected."""
    ring, each = RING, BLOCK
    posted = stored(postings(docs, levels(docs, text_col), text_col))
    sketches = posted.where("h is null").select("key", "n", *PARITIES).dropDuplicates(["key"])

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches don't speak against them."""
        both = pairs.join(sketches.alias("x"), F.col("u") == F.col("x.key")).join(sketches.alias("y"), F.col("v") == F.col("y.key"))
        return both.where(9 * differing("x", "y") <= F.col("x.n") + F.col("y.n")).select(*[pairs[c] for c in pairs.columns])

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs that no component has yet, with the components of their ends."""
        for end in ("u", "v"):
            pairs = pairs.join(some.select(F.col("u").alias(end), F.col("v").alias(f"{end}_root")), end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
        return pairs.where("u_root <> v_root")

    def grown(pairs: DataFrame) -> DataFrame:
        """Components as edges u, v from each text to its root: what holds of `pairs` goes in, and the pairs themselves aren't kept."""
        return components(pairs).select(F.col("node").alias("u"), F.col("root").alias("v"))

    retained = cut(possible(alike(posted.where("h is null").select("key", *PRINTS))))
    some = cut(retained.select("u", "v").limit(0))
    for _ in range(CLOSEST):
        ends = apart(retained).withColumn("root", F.explode(F.array("u_root", "v_root")))
        closest = ends.groupBy("root").agg(F.min(F.struct("differ", "u", "v")).alias("p")).select("p.u", "p.v").distinct()
        some = grown(some.unionByName(verified(docs, cut(closest), text_col)))
    lists = posted.where("h is not null").select("h", "key", "n", "place").repartitionByRange("h", "key").sortWithinPartitions("h", "key")
    seen = stored(lists.mapInArrow(lambda batches: chains(batches, ring), "kind int, a bigint, b bigint, n int, place int"))
    chained = seen.where(F.col("kind") == LINK).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    some = grown(some.unionByName(verified(docs, cut(possible(apart(chained).select("u", "v"))), text_col)))
    members = seen.where(F.col("kind") == MEMBER).select(F.col("a").alias("h"), F.col("b").alias("key"), "n", "place")

    def across(nearest: bool) -> DataFrame:
        """Pairs of members of several components that share a list."""
        rooted = members.join(some, members.key == some.u, "left").select("h", "key", "n", "place", F.coalesce("v", "key").alias("root"))
        several = rooted.groupBy("h").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h", F.ceil(F.col("size") / each).alias("blocks"))
        open_ = rooted.join(several, "h").join(sketches.select("key", *PARITIES), "key").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")))
        # The lists before, of those that are looked at; where there are none, a number of the member's own.
        order = Window.partitionBy("key").orderBy("place")
        open_ = open_.select("*", *[F.coalesce(F.lag("h", k + 1).over(order), F.xxhash64("key", F.lit(k))).alias(c) for k, c in enumerate(BEFORE)])
        meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
        groups = open_.withColumn("m", F.explode(meets)).select("h", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "own", "key", "n", "place", "root", *BEFORE, *PARITIES)
        found = groups.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "key").mapInArrow(lambda batches: crossing(batches, nearest), "u bigint, v bigint")
        return cut(found.distinct())

    for _ in range(NEAREST):
        some = grown(some.unionByName(verified(docs, across(True), text_col)))
    out = cut(some.unionByName(verified(docs, across(False), text_col)))
    removed(posted, seen)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near copies: of each component one row, of its smallest id."""
    keyed = docs.withColumn("_key", F.xxhash64(F.lit(SEED), F.coalesce(F.col(text_col), F.lit("")))).withColumn("_row", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_key"))
    with freed(docs.sparkSession):
        roots = cut(components(links(keyed, text_col)))
    first = keyed.groupBy("_key").agg(F.min("_row").alias("first"))
    rooted = first.join(roots, first._key == roots.node, "left").select(F.coalesce("root", "_key").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("_row")).select("_row")
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
