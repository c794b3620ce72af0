"""The `pdf` data source: pages of PDF files as rows, for spark.read.format("pdf").

Options: path (a folder or file that the workers can open), mode (geom or legacy), password. A filter on page_no is taken over, so other pages are never interpreted. For stores that only Spark can open, use quire.sources.reader.read_pdf.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators import extract, legacy
from .document import Document
from .syntax import PdfError


#: Bytes of files that a task reads, about; a larger file is a task of its own. A file counts as OPEN bytes more.
PART_BYTES, OPEN = 32 << 20, 256 << 10


class PdfPart(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return "path string, page_no int, text string, error string"

    def reader(self, schema: StructType) -> PdfReader:
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode, self.password = options.get("path", "."), options.get("mode", "geom"), options.get("password")
        self.first, self.last, self.chosen = 1, 1 << 31, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over comparisons of page_no with a constant; gives the others back."""
        for f in filters:
            if getattr(f, "attribute", None) != ("page_no",):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            elif isinstance(f, In):
                self.chosen = set(f.value) if self.chosen is None else self.chosen & set(f.value)
            else:
                yield f

    def partitions(self) -> list[PdfPart]:
        """Files in the order of their paths, put together up to PART_BYTES."""
        root = Path(self.path)
        parts: list[list[str]] = []
        room = 0
        for p in [root] if root.is_file() else sorted(root.rglob("*.pdf")):
            size = p.stat().st_size + OPEN
            if not parts or size > room:
                parts.append([])
                room = PART_BYTES
            parts[-1].append(str(p))
            room -= size
        return [PdfPart(p) for p in parts]

    def read(self, partition: PdfPart) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self.pages(path)

    def pages(self, path: str) -> Iterator[tuple]:
        try:
            doc = Document(Path(path).read_bytes(), self.password)
            refs = doc.pages()
        except PdfError as e:
            yield path, None, None, str(e)
            return
        for k in range(max(1, self.first), min(self.last, len(refs)) + 1):
            if self.chosen is None or k in self.chosen:
                try:
                    text = extract.one_page(doc, k) if self.mode == "geom" else legacy.Legacy(doc).page(refs[k - 1])
                    yield path, k, text, None
                except PdfError as e:
                    yield path, k, None, str(e)


def register(spark) -> None:
    """Makes the source and its filter push-down known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)
