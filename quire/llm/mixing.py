"""Operator 5: mixing sources to target weights by a multivariate-hypergeometric splitting tree. Native.

1. Sizes: words of each document; totals of each source.
2. Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share SHARE of all words; no target exceeds twice its source. The water level that this fixes is found exactly from the sources in the order in which they fill up.
3. Blocks: each source's documents are dealt into blocks of about BLOCK_DOCS by hash. A draw is one pass over one block. Draws are put into a random order, the first pass before the second, and taken until the source's target is reached; the one draw that the target falls into is taken document by document. That gives each source an exact quota of draws.
4. Splitting tree: the root holds the quotas of all sources, and each node deals its draws to two halves by a multivariate hypergeometric draw, source after source, until each leaf, an output shard, has its own quota of each source. The draws of a source, in their random order, then go to the shards in disjoint runs of these lengths.
5. Each shard is shuffled locally: `position` orders its rows by hash. apply() writes rows out shard by shard in this order.

All random numbers are hashes of a seed and of keys, so reruns agree. Documents are shuffled without their text; the per-source and per-block tables have no row for a document.

Edge cases: a null text has size 0; a document of size 0 is taken 0 words, whatever its draws. Null sources are one source. Rows are told apart by a row number, so repeated or null ids give a row each. Without any word all targets are 0. Other columns are not passed on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, uniform, word_count

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents of a block, words of an output shard (about), levels of the tree after which its nodes are dealt out anew.
BLOCK_DOCS, SHARD_WORDS, SPREAD, SEED = 512, 1 << 22, 6, 17


def keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two hashes that tell rows apart: `_mix` of id and text, which orders rows at random, and `_check` of all columns but maps, which have no hash."""
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("_mix"), F.xxhash64(F.lit(SEED), *rest).alias("_check")]


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Id, source, size, keys and row number of each row, written to the shared folder."""
    rows = docs.select(F.col(id_col), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), *keys(docs, id_col, text_col))
    return cut(rows.withColumn("_row", F.monotonically_increasing_id()))


def targets(rows: DataFrame) -> DataFrame:
    """_source, docs, source_size and target of each source. One row for each source: the windows below run over sources, not documents."""
    by = rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    everything = Window.orderBy(F.col("_source").asc_nulls_last())
    weighed = by.withColumn("_n", F.row_number().over(everything)).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_n") - 1) % len(WEIGHTS) + 1))
    # Sources fill up in the order of size by weight. If the first k are full, the level is what is left over for each unit of the other weight; the true level is the first that does not overfill the next source.
    weighed = weighed.withColumn("full_at", MOST * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", "_n")
    before, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = SHARE * F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(rest))
    levels = levels.withColumn("_k", F.row_number().over(order))
    fits = levels.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("_k", "level"))).over(whole)["level"])
    return fits.select("_source", "_n", "docs", "source_size", F.least(MOST * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), MOST * F.col("source_size"))).cast("double").alias("target"))


def place(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's numbers and their block. The plan has one row for each source."""
    same = F.col("r._source").eqNullSafe(F.col("p._source"))
    return rows.alias("r").join(plan.alias("p"), same).select("r.*", "_n", "source_size", "target", F.pmod(F.xxhash64(F.lit(SEED), "_mix"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS))).alias("block"))


def draws(placed: DataFrame) -> DataFrame:
    """The quota of each source: _n, pass, block, words, goal (the target's words still open at its start), number (from 1, in random order)."""
    blocks = placed.groupBy("_n", "block").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    twice = blocks.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("pass"))
    order = Window.partitionBy("_n").orderBy("pass", F.xxhash64(F.lit(SEED), "_n", "pass", "block"), "block")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = twice.withColumn("goal", F.col("target") - F.sum("words").over(run) + F.col("words")).withColumn("number", F.row_number().over(order))
    return out.where((F.col("goal") > 0) & (F.col("words") > 0)).withColumn("number", F.row_number().over(order)).select("_n", "block", "pass", "words", "goal", "number")


def hypergeometric(good: Column, all_: Column, picks: Column, u: Column) -> Column:
    """Number of good ones among `picks` of `all_`, by inversion with the uniform number u over eight standard deviations either side of the mean. SQL columns of bigint and double; `u` decides alone, so reruns agree."""
    low, high = F.greatest(F.lit(0), picks - (all_ - good)), F.least(good, picks)
    share = good / F.greatest(all_, F.lit(1))
    sd = F.sqrt(picks * share * (1 - share) * (all_ - picks) / F.greatest(all_ - 1, F.lit(1)))
    first = F.greatest(low, F.floor(picks * share - 8 * sd - 8).cast("long"))
    end = F.least(high, F.ceil(picks * share + 8 * sd + 8).cast("long"))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

    def ratio(k):  # P(k) / P(k - 1)
        return (good - k + 1) * (picks - k + 1) / (k * (all_ - good - picks + k)).cast("double")

    ks = F.when(first < end, F.sequence(first + 1, end)).otherwise(F.expr("cast(array() as array<bigint>)"))
    total = F.aggregate(ks, start, lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["sum"] + a["w"]).alias("sum")), lambda a: a["sum"] + a["w"])
    walk = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("sum"), first.cast("long").alias("k"), (u * total).alias("goal"))
    return F.aggregate(ks, walk, lambda a, k: F.struct((a["w"] * ratio(k)).alias("w"), (a["sum"] + a["w"] * ratio(k)).alias("sum"), F.when(a["sum"] < a["goal"], k).otherwise(a["k"]).cast("long").alias("k"), a["goal"].alias("goal")), lambda a: a["k"])


def halve(level: int):
    """Step of the fold over sources at a node of the splitting tree: `all` and `picks` are what is left of its draws and of its left half."""

    def step(acc: Column, i: Column) -> Column:
        good = F.element_at("q", (i + 1).cast("int"))
        got = hypergeometric(good, acc["all"], acc["picks"], uniform(SEED, level, F.col("shard"), i + 1))
        return F.struct((acc["all"] - good).alias("all"), (acc["picks"] - got).alias("picks"), F.concat(acc["out"], F.array(got)).alias("out"))

    return step


def split_tree(quotas: DataFrame, levels: int) -> DataFrame:
    """Quotas (_n, draws) dealt to 2**levels shards: shard, _n, draws. At each level every node's draws are halved; how many of each source go left is a multivariate hypergeometric draw, made source by source, each given those before it."""
    spark_type = "array<bigint>"
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("_n", "draws"))).alias("q")).select(F.lit(0).alias("shard"), F.transform("q", lambda x: x["_n"]).alias("names"), F.transform("q", lambda x: x["draws"]).cast(spark_type).alias("q"))
    for level in range(levels):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        rounding = F.when(uniform(SEED, level, F.col("shard"), 0) < 0.5, 1).otherwise(0)
        node = node.withColumn("total", total).withColumn("half", F.floor((F.col("total") + rounding) / 2).cast("long"))
        begin = F.struct(F.col("total").alias("all"), F.col("half").alias("picks"), F.expr(f"cast(array() as {spark_type})").alias("out"))

        # The node's row is written down before it branches, so no draw is made twice.
        node = node.withColumn("left", F.when(F.size("q") > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(F.size("q") - 1, F.lit(0))), begin, halve(level), lambda a: a["out"])).otherwise(F.col("q")))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        node = node.select("names", F.posexplode(F.array("left", right)).alias("side", "branch"), "shard").select((F.col("shard") * 2 + F.col("side")).alias("shard"), "names", F.col("branch").alias("q"))
        if level % SPREAD == SPREAD - 1 and level + 1 < levels:
            node = cut(node.repartition("shard"))
    return node.select("shard", F.explode(F.arrays_zip("names", "q")).alias("x")).select("shard", F.col("x.names").alias("_n"), F.col("x.q").alias("draws"))


def depth(quota: DataFrame) -> int:
    """Levels of the tree that give shards of about SHARD_WORDS words."""
    words = quota.agg(F.sum("words")).first()[0] or 0
    return max(0, math.ceil(math.log2(max(1, words / SHARD_WORDS))))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int | None = None) -> DataFrame:
    """A row for each time that a document is taken: the row's number `_row`, id, size, source_size, target, shard and position in it; a document not taken has one row with null shard."""
    rows = sized(docs, id_col, text_col, source_col)
    placed = cut(place(rows, targets(rows)))
    quota = cut(draws(placed))
    shards = cut(split_tree(quota.groupBy("_n").agg(F.count("*").alias("draws")), depth(quota) if levels is None else levels))
    ends = shards.withColumn("last", F.sum("draws").over(Window.partitionBy("_n").orderBy("shard"))).select("_n", "shard", (F.col("last") - F.col("draws")).alias("after"), "last")
    # Runs of draws: one row for each source and shard, so this table has sources x shards rows.
    dealt = quota.alias("d").join(ends.alias("e"), (F.col("d._n") == F.col("e._n")) & (F.col("number") > F.col("after")) & (F.col("number") <= F.col("last")), "left").select("d.*", "shard")
    whole = dealt.where("words <= goal").select("_n", "block", "pass", "shard")
    part = dealt.where("words > goal").select("_n", "block", "pass", "shard", "goal")
    taken = placed.join(whole, ["_n", "block"]).select("_row", "pass", "shard")
    # One draw of each source at most is cut; its documents, about BLOCK_DOCS of them, are taken in random order while their middle lies before the target.
    order = Window.partitionBy("_n").orderBy(F.xxhash64(F.lit(SEED), "_mix", "pass"), "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut_part = placed.join(part, ["_n", "block"]).withColumn("run", F.sum("size").over(order)).where(F.col("run") - F.col("size") / 2 <= F.col("goal"))
    every = taken.unionByName(cut_part.select("_row", "pass", "shard"))
    out = placed.join(every, "_row", "left")
    return out.select("_row", "_mix", "_check", id_col, "size", "source_size", "target", "shard", F.when(F.col("shard").isNotNull(), F.xxhash64(F.lit(SEED), "_mix", "pass", "_row")).alias("position"))


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int | None = None) -> DataFrame:
    """One row for each row of `docs`: id, size, source_size, target, taken (words, repeats counted), and for each time that it is taken, sorted, the shard that holds it and its position there."""
    by = mixed(docs, id_col, text_col, source_col, levels).groupBy("_row").agg(
        *[F.first(c).alias(c) for c in (id_col, "size", "source_size", "target")], F.array_sort(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "position")))).alias("_places")
    )
    taken = (F.col("size") * F.size("_places")).cast("long").alias("taken")
    return by.select(id_col, "size", "source_size", "target", taken, F.col("_places.shard").alias("shards"), F.col("_places.position").alias("positions"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int | None = None) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, each output shard's rows together and in their random order. Rows that are equal in every column are drawn together."""
    drawn = mixed(docs, id_col, text_col, source_col, levels).where("shard is not null").select("_mix", "_check", F.col("shard").alias("_shard"), F.col("position").alias("_position"))
    once = docs.select("*", *keys(docs, id_col, text_col)).dropDuplicates(["_mix", "_check"])
    rows = once.join(drawn, ["_mix", "_check"])
    return rows.repartition("_shard").sortWithinPartitions("_shard", "_position").select(*docs.columns)
