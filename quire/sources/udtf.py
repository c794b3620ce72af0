"""Table functions for SQL: pdf_pages(content), pdf_items(content, page), pdf_regions(content), pdf_raw_objects(content). A password may follow."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import extract
from ..operators.interpret import Glyph, Interpreter, page_items
from .document import Document
from .syntax import PdfError, show


def open_or_none(content: bytes | None, password: str | None) -> Document | None:
    try:
        return Document(bytes(content or b""), password)
    except PdfError:
        return None


@udtf(returnType="page_no int, page_ref int, text string")
class PdfPages:
    def eval(self, content: bytes, password: str | None = None) -> Iterator[tuple]:
        doc = open_or_none(content, password)
        for k, ref in enumerate(doc.pages() if doc else [], 1):
            try:
                yield k, ref, extract.one_page(doc, k)
            except PdfError:
                yield k, ref, None


@udtf(returnType="seq int, kind string, text string, x double, y double, width double, size double")
class PdfItems:
    def eval(self, content: bytes, page: int, password: str | None = None) -> Iterator[tuple]:
        doc = open_or_none(content, password)
        try:
            items = page_items(doc, doc.page(page)) if doc else []
        except PdfError:
            items = []
        for n, x in enumerate(items):
            yield (n, "glyph", x.text, x.x, x.y, x.width, x.size) if isinstance(x, Glyph) else (n, "graphic" if x.image is None else "image", None, x.x0, x.y0, x.x1 - x.x0, x.y1 - x.y0)


@udtf(returnType="page_no int, para_no int, x0 double, y0 double, x1 double, y1 double, text string")
class PdfRegions:
    def eval(self, content: bytes, password: str | None = None) -> Iterator[tuple]:
        doc = open_or_none(content, password)
        interpreter = Interpreter(doc)
        for k, ref in enumerate(doc.pages() if doc else [], 1):
            try:
                for r in extract.regions(page_items(doc, ref, interpreter)):
                    yield k, *r
            except PdfError:
                continue


@udtf(returnType="obj_num int, value string")
class PdfRawObjects:
    def eval(self, content: bytes, password: str | None = None) -> Iterator[tuple]:
        doc = open_or_none(content, password)
        for n in sorted(doc.xref) if doc else []:
            if doc.xref[n].kind != "free":
                yield n, show(doc.get(n))


def register(spark: SparkSession) -> None:
    for name, f in (("pdf_pages", PdfPages), ("pdf_items", PdfItems), ("pdf_regions", PdfRegions), ("pdf_raw_objects", PdfRawObjects)):
        spark.udtf.register(name, f)
