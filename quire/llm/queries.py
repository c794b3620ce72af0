"""The queries of the ten operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bm25, bpe, jpeg, langid, mixing, secrets, simhash, toxicity, urls
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


RULES = [urls.Rule("allow", "org"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where(F.pmod("doc_id", F.lit(100)) == 0))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards", "positions")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.text_media(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    known = langid.sample(docs.where(~held_out), "doc_id", "text", "lang")
    return langid.identify(docs, known).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.audit_pages(table(spark, sf_dir, "pages"))


def queries() -> dict:
    own = (op1_toxicity, op2_topk_search, op3_bpe, op4_simhash, op5_mixing, op6_media, op7_langid, op8_warc, op9_url_filters, op10_secrets)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filters": urls.oracle(RULES, "allow")}
