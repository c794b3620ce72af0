"""PDF files as they arrive: a stream of pages in order within each file."""

from __future__ import annotations

from collections.abc import Callable
from tempfile import gettempdir
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.reader import Corpus


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New PDF files of a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_trigger).load(path)


def stream_pages(files: DataFrame, password: str | None = None) -> DataFrame:
    """Stream-order text of each page of a stream of files."""
    return Corpus(files.select(F.col("path").alias("doc_id"), "path", "length", "content"), password).legacy_pages()


def for_each_page(pages: DataFrame, call: Callable[[str, int, str], None], checkpoint: str) -> StreamingQuery:
    """Calls `call(doc_id, page_no, text)` on the driver for every page, pages of a file in order, batch after batch, until no new file is left. Rows come to the driver one partition at a time."""

    def batch(df: DataFrame, _: int) -> None:
        for r in df.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "page_no").toLocalIterator():
            call(r["doc_id"], r["page_no"], r["text"])

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_table(pages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes pages to Parquet files under `path`, by the executors, each page once, until no new file is left."""
    return pages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pages_of_batches(docs: DataFrame) -> DataFrame:
    """Stream-order text of the pages of documents (a DataFrame over Parquet files) that are read as a stream of files, made into PDF files and read on the way. The result is a table in the shared folder."""
    from ..sources.sinks import pdf_corpus

    spark = docs.sparkSession
    files = docs.inputFiles()
    folders = {f.rsplit("/", 1)[0] for f in files}
    if len(folders) != 1:
        raise ValueError("the files must lie in one folder")
    arriving = spark.readStream.schema(docs.schema).parquet(f"{folders.pop()}/*{files[0].rsplit('/', 1)[1] if len(files) == 1 else '.parquet'}")
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    to_table(pdf_corpus(arriving).legacy_pages(), f"{folder}/pages", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/pages")


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a session on one machine may name nothing."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"file://{gettempdir()}/quire-streams"


def document_text(pages: DataFrame) -> DataFrame:
    """Pages put together in order: for a batch of whole files."""
    parts = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
