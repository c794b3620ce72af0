"""Whole-document and page text in its three modes."""

from __future__ import annotations

from ..sources.document import Document
from ..sources.syntax import PdfError
from . import legacy, structure
from .interpret import Interpreter, page_items
from .layout import Options, document_text, extent, group_paragraphs, join_lines, page_lines, page_text, prepared

MODES = ("tagged", "geom", "legacy")


def all_items(doc: Document) -> tuple[list[int], list[list]]:
    """Page objects and the items of every page; the first page that fails fails the document."""
    refs, interpreter = doc.pages(), Interpreter(doc)
    return refs, [page_items(doc, r, interpreter) for r in refs]


def text(doc: Document, mode: str = "tagged", options: Options = Options()) -> str:
    """Text of a document: by its structure tree if that covers half of it (`tagged`), by geometry (`geom`), or in stream order (`legacy`)."""
    if mode not in MODES:
        raise PdfError("BAD_MODE", mode)
    if mode == "legacy":
        return legacy.document_text(doc)
    root = structure.tree(doc) if mode == "tagged" else None
    refs, pages = all_items(doc)
    if root is not None and structure.usable(pages):
        return structure.assemble(root, refs, pages, options)
    return document_text(pages, options)


def one_page(doc: Document, number: int, options: Options = Options()) -> str:
    return page_text(page_items(doc, doc.page(number)), options)


def regions(items: list, options: Options = Options()) -> list[tuple[int, float, float, float, float, str]]:
    """Number, bounding box and text of each paragraph of a page. Text to fall back on has no box."""
    page = prepared(page_lines(items), options)
    if page.fallback is not None:
        return [(k, 0.0, 0.0, 0.0, 0.0, t) for k, t in enumerate(page.fallback, 1)]
    out = []
    for k, group in enumerate(group_paragraphs(page.lines), 1):
        low, high = extent(group)
        low = min(x.baseline - x.size for x in group)
        start, end = min(min(x.start, x.end) for x in group), max(max(x.start, x.end) for x in group)
        box = (low, start, high, end) if group[0].wmode == 1 else (start, low, end, high)
        out.append((k, *box, join_lines(group)))
    return out
