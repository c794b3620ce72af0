"""Operator 10: secret scans with corpus-wide ownership frequency. Native.

Base spans come from three patterns. Offsets are found with built-in functions: the text is split by a pattern and the lengths of the pieces and of the matches add up to code-point offsets. Each span has a candidate value (for an assignment its second group). The hashes of the values are aggregated over the whole corpus by distinct repositories and owners. A value of one owner that looks live (letters and digits mixed, many distinct characters, no placeholder word) is added as a span of kind `live`; a value of EXAMPLE_OWNERS owners or more, or of two owners in EXAMPLE_REPOSITORIES repositories or more, is a widely copied example, a span of kind `example`.

Work on a text grows with its length and with the 1.5th power of its matches: offsets and replacements are put together in runs (chunks).

Counting is two-step: distinct (hash, owner, repository) with partial aggregation, then by hash, so a value that a third of all rows share is reduced before it is shuffled. Texts are never shuffled.

Edge cases: a null text counts as empty: no spans, hashes of the empty string. A null owner or repository is one value of its own. Rows are told apart by a row number, so repeated or null ids give a row each. Other columns are not passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Fixed by the contract, with (?i) for "either case": ASCII letters only, as Java's flag has it.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: So many owners make a value a widely copied example, and so do two owners that have it in so many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 4
LIVE_DISTINCT = 8
PLACEHOLDERS = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|your|test"
KINDS = ("assign", "access", "hex", "live", "example")
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def chunks(items: Column) -> Column:
    """An array cut into runs of about the root of its size: what grows by copies within a run, or over the runs, stays short."""
    def run(items: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(items))).cast("int"), lambda c: F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / c).cast("int") - 1), lambda k: F.slice(items, k * c + 1, c)))

    return let(items, lambda x: F.when(F.size(x) > 0, run(x)).otherwise(F.array(x)))


def before(numbers: Column, add) -> Column:
    """For each number what add makes of 0 and the ones before it; the last element is for all of them."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(add(F.element_at(acc, -1), x))))


def offsets(pieces: Column, matches: Column) -> Column:
    """Start and match of each match, given the pieces between them. Lengths are added up in runs, then over the runs."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,m:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["piece"])
        return F.struct((at + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), x["m"].alias("m")))).alias("out"))

    pairs = F.filter(F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), m.alias("m"))), lambda x: x["m"].isNotNull())
    runs = F.transform(chunks(pairs), lambda run: F.aggregate(run, start, step))
    moved = lambda run, base: F.transform(run["out"], lambda x: F.struct((x["start"] + base).alias("start"), x["m"].alias("m")))
    return let(runs, lambda r: F.flatten(F.zip_with(r, F.slice(before(F.transform(r, lambda x: x["at"]), lambda a, n: a + n), 1, F.size(r)), moved)))


def spans(text: Column, kind: str) -> Column:
    """The base spans of a kind in a non-null text, as an array of SPAN."""
    # A hex run that is too short to count need not be extracted: runs are maximal either way.
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": "[0-9a-f]{24,}"}[kind]
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = offsets(F.split(text, pattern, -1), found)
    value = (lambda m: F.regexp_extract(m, ASSIGN, 2)) if kind == "assign" else (lambda m: m)
    out = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).alias("end"), value(x["m"]).alias("value")))
    kept = F.filter(out, lambda x: F.length(x["value"]) >= LEAST[kind])
    return F.when(text.rlike(pattern), kept).otherwise(none).cast(f"array<{SPAN}>")


def listed(span_array: Column) -> Column:
    ordered = F.array_sort(F.transform(span_array, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= LIVE_DISTINCT) & ~value.rlike(PLACEHOLDERS)


def base(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """Base spans of each row with its number, written to the shared folder: no text goes on from here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col), owner.cast("string").alias("_owner"), repository.cast("string").alias("_repository"), text.alias("_t"))
    found = named.select(id_col, "_owner", "_repository", *[spans(F.col("_t"), k).alias(f"_{k}") for k in LEAST])
    return cut(found.withColumn("_row", F.monotonically_increasing_id()))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners and repositories of each candidate value."""
    values = found.select("_owner", "_repository", F.explode(F.array_distinct(F.transform(F.concat("_assign", "_access", "_hex"), lambda s: F.xxhash64(s["value"])))).alias("hash"))
    once = values.groupBy("hash", "_owner", "_repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "_owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def copied() -> Column:
    """Whether the owners and repositories of a value make it an example."""
    return (F.col("owners") >= EXAMPLE_OWNERS) | ((F.col("owners") == 2) & (F.col("repositories") >= EXAMPLE_REPOSITORIES))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """For each row: the id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, all of them), n_live and n_example, and the owners and repositories of its most widely copied value (0 without any). `owner` and `repository` name the row's owner and repository; without them every row is its own."""
    alone = F.col(id_col).cast("string")
    found = base(docs, id_col, text_col, alone if owner is None else owner, alone if repository is None else repository)
    stats = ownership(found)
    each = found.select("_row", F.explode(F.concat("_assign", "_access", "_hex")).alias("s")).select("_row", "s", F.xxhash64("s.value").alias("hash"))
    # Every value has its row in stats, so an inner join drops nothing; a hot hash is on one side only, which adaptive execution can split.
    judged = each.join(stats, "hash").withColumn("kind", F.when(copied(), "example").when((F.col("owners") == 1) & looks_live(F.col("s.value")), "live"))
    start = F.col("s.end") - F.length("s.value")
    added = judged.select("_row", "owners", "repositories", F.when(F.col("kind").isNotNull(), F.struct(start.cast("int").alias("start"), F.when(F.col("kind") == "live", 3).otherwise(4).alias("rank"), F.col("kind"), F.col("s.end").alias("end"), F.lit("").alias("value")).cast(SPAN)).alias("a"))
    added = added.groupBy("_row").agg(F.collect_set("a").alias("_added"), F.max("owners").alias("_owners"), F.max("repositories").alias("_repositories"))
    known = F.concat("_assign", "_access", "_hex")
    more = F.coalesce(F.col("_added"), F.expr(f"cast(array() as array<{SPAN}>)"))
    count = lambda k: F.size(F.filter(more, lambda s: s["kind"] == k)).cast("long")
    return found.join(added, "_row", "left").select(
        id_col, *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in LEAST], F.sha2(listed(known), 256).alias("base_sha256"), listed(F.concat(known, more)).alias("spans"), count("live").alias("n_live"), count("example").alias("n_example"),
        *[F.coalesce(f"_{c}", F.lit(0)).cast("long").alias(c) for c in ("owners", "repositories")]
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """`docs` with every base span in the text replaced: widely copied values by `<EXAMPLE>`, all others by `<SECRET>`. Rows without a secret stay as they are, null texts stay null.

    What to mark follows from the text alone, so decisions are kept by the text's hash. Only rows with a secret are joined with them; the others are passed through where they lie.
    """
    alone = F.col(id_col).cast("string")
    text = F.col(text_col)
    some = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike("[0-9a-f]{24,}")
    keyed = docs.where(some).withColumn("_key", F.sha2(text, 256))
    found = base(keyed.select(id_col, text_col, "_key", (alone if owner is None else owner).alias("_o"), (alone if repository is None else repository).alias("_r")), "_key", text_col, F.col("_o"), F.col("_r"))
    each = found.dropDuplicates(["_key"]).select("_key", F.explode(F.concat("_assign", "_access", "_hex")).alias("s")).select("_key", "s", F.xxhash64("s.value").alias("hash"))
    marked = each.join(ownership(found), "hash").select("_key", F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.when(copied(), "<EXAMPLE>").otherwise("<SECRET>").alias("mark")).alias("m"))
    marks = marked.groupBy("_key").agg(F.array_sort(F.collect_set("m")).alias("_marks"))
    changed = keyed.join(marks, "_key", "left").withColumn(text_col, F.when(F.col("_marks").isNull(), text).otherwise(mask(text, F.col("_marks"))))
    return docs.where(~some | some.isNull()).unionByName(changed.select(*docs.columns))


def mask(text: Column, marked: Column) -> Column:
    """`text` with each struct(start, end, mark) of a sorted array replaced by its mark; a span that starts inside an earlier one is part of it. Runs of spans are put into their own stretches of the text."""

    def stretch(run: Column, base: Column, end: Column) -> Column:
        own = F.substring(text, base + 1, end - base)
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return let(own, lambda x: inner(x, run, base, begin))

    def inner(own: Column, run: Column, base: Column, begin: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            at = s["start"] - base
            out = F.when(at >= acc["at"], F.concat(acc["out"], F.substring(own, acc["at"] + 1, at - acc["at"]), s["mark"])).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"] - base).alias("at"), out.alias("out"))

        return F.aggregate(run, begin, step)["out"]

    def whole(runs: Column) -> Column:
        tops = F.transform(runs, lambda run: F.coalesce(F.array_max(F.transform(run, lambda s: s["end"])), F.lit(0)))
        return let(before(tops, lambda a, x: F.greatest(a, x)), lambda cuts: F.concat(
            F.array_join(F.transform(runs, lambda run, k: stretch(run, cuts[k], cuts[k + 1])), ""), F.substring(text, F.element_at(cuts, -1) + 1, F.length(text))
        ))

    return let(chunks(marked), whole)
