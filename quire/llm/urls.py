"""Operator 9: URL filters by pattern rules, indexed by their rarest literal token. Native.

A rule names an action, a host that also stands for its subdomains, and a path pattern that the URL's path must start with (`*` stands for any run of characters). Its literal tokens are the runs of letters and digits that the rule bounds on both sides, so any URL that the rule fits has them as whole tokens. The frequency of these tokens over all URLs is counted, and each rule is filed under its rarest one. A URL's tokens fetch candidate rules from the index, and only those run their regular expressions. The longest rule that fits wins; of equally long ones the one with the longer host, then the one that sorts first.

Up to INLINE_RULES rules the index is a literal map inside the expression, whose size that bound fixes; above it, tokens of distinct URLs are joined with the index. Rules come as a list, so the size of the index is known: up to BROADCAST_BYTES it is sent to all executors, above it, it is shuffled, and a token that very many URLs have is dealt out over several keys.

Edge cases: a null URL or one without `://` has an empty host and path, fits no rule and gets the default verdict. Repeated rows give equal rows; an empty table gives an empty one; other columns are not passed on.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Rules up to which the index is a literal, bytes up to which it is broadcast, and URLs with a token that one key of the join takes.
INLINE_RULES, BROADCAST_BYTES, HOT = 500, 16 << 20, 1_000_000


class Rule(NamedTuple):
    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Regular expression over host and path put together."""
        path = ".*".join(quoted(p) for p in self.path.split("*"))
        return f"(?s)^(?:[^/]*\\.)?{quoted(self.host)}{path}"

    @property
    def tokens(self) -> list[str]:
        """Whole tokens that any URL has which the rule fits: the last run of the path is open at its end, runs beside `*` are open too."""
        text = f".{self.host}{self.path}"
        return [m[1] for m in re.finditer(r"(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])", text)]


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, "[^A-Za-z0-9]+"), lambda t: t != ""))


def index(keys: DataFrame, rules: list[Rule]) -> tuple[dict[str, list[Rule]], dict[str, int]]:
    """Rules by their rarest token over `keys(key)`, and how many keys have each token; a rule without a whole token is under the empty one, which all URLs fetch."""
    wanted = sorted({t for r in rules for t in r.tokens})
    seen = {}
    if wanted:
        hits = keys.select(F.explode(F.array_intersect(tokens_of(F.col("key")), F.array(*map(F.lit, wanted)))).alias("token"))
        seen = {r[0]: r[1] for r in hits.groupBy("token").count().collect()}  # one row for each token of the rules at most
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), t), default=""), []).append(r)
    return out, seen


def as_struct(r: Rule) -> Column:
    # Ordered so that the greatest is the winner; the negative place in the sorted list ends ties.
    return F.struct(F.lit(len(r.name)).alias("size"), F.lit(len(r.host)).alias("host_size"), F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The id, host, path, rule and verdict of each row of `pages`."""
    rules = sorted(set(rules), key=lambda r: (r.name, r.action))
    url = F.col(url_col)
    pages = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", F.concat("host", "path"))
    if not rules:
        win = F.lit(None).cast("struct<rule:string,action:string>")
        return finish(pages.withColumn("win", win), id_col, default)
    by_token, seen = index(pages.select("key"), rules)
    if len(rules) > INLINE_RULES:
        return finish(joined(pages, by_token, seen), id_col, default)
    filed = F.create_map(*[x for t, own in sorted(by_token.items()) for x in (F.lit(t), F.array(*map(as_struct, own)))])
    tokens = F.concat(tokens_of(F.col("key")), F.array(F.lit("")))
    known = F.array_intersect(tokens, F.array(*map(F.lit, sorted(by_token))))
    fetched = F.flatten(F.transform(known, lambda t: F.element_at(filed, t)))
    fit = F.filter(fetched, lambda c: F.rlike(F.col("key"), c["pattern"]))
    return finish(pages.withColumn("win", F.array_max(fit)), id_col, default)


def joined(pages: DataFrame, by_token: dict[str, list[Rule]], seen: dict[str, int]) -> DataFrame:
    """As above for many rules: (token, rule) rows joined with the tokens of distinct keys. Only tokens under which a rule is filed are joined; one of more than HOT keys is dealt out, its rules repeated for each part."""
    spark = pages.sparkSession
    parts = {t: -(-n // HOT) for t, n in seen.items() if n > HOT and t in by_token}
    rows = [(t, part, len(r.name), len(r.host), r.name, r.action, r.pattern) for t, own in by_token.items() for r in own for part in range(parts.get(t, 1))]
    filed = spark.createDataFrame(rows, "token string, part int, size int, host_size int, rule string, action string, pattern string")
    if sum(len(t) + len(r.name) + len(r.pattern) + 64 for t, own in by_token.items() for r in own for _ in range(parts.get(t, 1))) <= BROADCAST_BYTES:
        filed = F.broadcast(filed)  # its size has just been counted
    known = cut(spark.createDataFrame([(t,) for t in by_token], "token string"))
    keys = cut(pages.select("key").distinct())
    tokens = keys.select("key", F.explode(F.concat(tokens_of(F.col("key")), F.array(F.lit("")))).alias("token")).join(known, "token", "left_semi")
    many = F.coalesce(F.create_map(*[F.lit(x) for x in (i for t in sorted(parts) for i in (t, parts[t]))])[F.col("token")], F.lit(1)) if parts else F.lit(1)
    fit = tokens.withColumn("part", F.pmod(F.xxhash64("key"), many).cast("int")).join(filed, ["token", "part"]).where(F.expr("key rlike pattern"))
    wins = fit.groupBy("key").agg(F.max(F.struct("size", "host_size", "rule", "action")).alias("win"))
    return pages.join(wins, "key", "left")


def finish(pages: DataFrame, id_col: str, default: str) -> DataFrame:
    return pages.select(id_col, "host", "path", F.col("win.rule").alias("rule"), F.coalesce(F.col("win.action"), F.lit(default)).alias("verdict"))


def oracle(rules: list[Rule], default: str) -> str:
    """DuckDB SQL for judge() over `pages` with rules without `*`."""
    raw = "regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
    host = f"coalesce(translate({raw.format(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    fits = [(r, f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')") for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))]
    case = lambda f, rest: "case " + " ".join(f"when {w} then '{f(r)}'" for r, w in fits) + f" else {rest} end"
    return f"select page_id, host, path, {case(lambda r: r.name, 'null')} as rule, {case(lambda r: r.action, repr(default))} as verdict from (select page_id, {host} as host, coalesce({raw.format(2)}, '') as path from pages)"

