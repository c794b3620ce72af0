"""The document pipeline: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import bpe, mixing, secrets, similar, toxicity
from quire.llm.common import removed, stored, table
from quire.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted model doesn't call toxic."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where(~F.col("toxic")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that share 4/5 of their five-word shingles the document with the smallest id."""
    return similar.keep_one(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced, n_chars follows the text."""
    done = secrets.redact(docs.select(*COLUMNS), owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; shard by shard, in random order within each."""
    return mixing.apply(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the hashes of ids and of the decoded text."""
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_copies), ("secrets", mask_secrets), ("mixing", mix), ("bpe", encode)]
#: The fitted classifier, fingerprints and tokens have no SQL form: tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each one keeps is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
            removed(*before)  # the last table stays, for the result is read from it
            before = [docs]
    return docs
