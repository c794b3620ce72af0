"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The queries make their PDF files from the documents, so they are also timed without that: `books_*` read files that were made before the clock starts (header, page number, TJ arrays, structure trees), and `book_of_1000_pages_*` one long file, which is dealt out by pages.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.plans import catalogue
from quire.sources.books import book_pdf
from quire.sources.reader import Corpus, from_table, read_pdf
from quire.sources.sinks import with_book

HEADLINE = ("grep_lines", "header_footer_cores", "strip_headers_anti_join", "line_bands", "iqr_outliers", "leading_breaks", "reading_order", "xref_latest_wins", "page_tree_recursive", "diff_pages", "pdf_roundtrip_words", "pdf_text", "pdf_items", "pdf_regions", "pdf_tagged_text", "pdf_packed_text", "pdf_outline", "stream_pages")


def seconds(df: DataFrame) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    folder = tempfile.mkdtemp(prefix="quire-bench-")
    conf = {"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.files.maxPartitionBytes": "4m", "spark.checkpoint.dir": f"file://{folder}/shared"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        spark.read.parquet(f"{sf}/region.parquet").write.format("noop").mode("overwrite").save()
        took = {name: seconds(catalogue.QUERIES[name](spark, sf)) for name in HEADLINE}
        docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(4 * cpus)
        made: dict[str, Corpus] = {}
        for shape in ("plain", "tagged"):
            with_book(docs, shape).write.parquet(f"{folder}/{shape}")
            made[shape] = from_table(spark.read.parquet(f"{folder}/{shape}"), "doc_id", "pdf")
        pages = made["plain"].pages().count()
        took |= {"books_geometry": seconds(made["plain"].text("geom")), "books_tagged": seconds(made["tagged"].text("tagged")), "books_stream_order": seconds(made["plain"].legacy_pages())}
        lines = [r[0] for r in docs.select(F.explode(F.split("text", "\n"))).limit(30_000).collect()]
        long = Path(folder, "long")
        long.mkdir()
        long.joinpath("long.pdf").write_bytes(book_pdf("\n".join((lines * (1 + 21_000 // max(1, len(lines))))[:21_000]), "long", "Volume"))
        took["book_of_1000_pages_geometry"] = seconds(read_pdf(spark, str(long)).text("geom"))
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "pages": pages, "pages_per_second": round(pages / took["books_geometry"], 1)}))


if __name__ == "__main__":
    main()
