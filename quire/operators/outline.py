"""Bookmarks, document information and single objects."""

from __future__ import annotations

from typing import Any, NamedTuple

from ..sources.document import Document
from ..sources.syntax import Name, PdfError, Ref, Stream, show, text_of

NO_TITLE = "No title anyway"


class Entry(NamedTuple):
    depth: int
    title: str
    dest: int


def outline(doc: Document) -> list[Entry]:
    """Titles in reading order. `dest` is the object of the page, the page number of a remote one, or 0."""
    root = doc.dict_of(doc.trailer.get("/Root"))
    top = doc.dict_of(root.get("/Outlines"))
    if not top:
        raise PdfError("MISSING_KEY", "/Outlines")
    out: list[Entry] = []
    todo: list[tuple[Any, int]] = [(top.get("/First"), 0)]
    seen: set[int] = set()
    while todo:
        ref, depth = todo.pop()
        if not isinstance(ref, Ref) or ref.number in seen:
            continue
        seen.add(ref.number)
        own = doc.dict_of(ref)
        title = doc.resolve(own.get("/Title"))
        if title is None:
            raise PdfError("MISSING_KEY", f"/Title of outline object {ref.number}")
        out.append(Entry(depth, text_of(title), destination(doc, own)))
        todo += [(own.get("/Next"), depth), (own.get("/First"), depth + 1)]
    return out


def destination(doc: Document, own: dict) -> int:
    if "/Dest" in own:
        return target(doc, own["/Dest"])
    return target(doc, doc.dict_of(own.get("/A")).get("/D"))


def target(doc: Document, value: Any) -> int:
    value = doc.resolve(value)
    if isinstance(value, (Name, bytes)):
        value = named(doc, value)
    value = doc.resolve(value.get("/D")) if isinstance(value, dict) else value
    if isinstance(value, list):
        return next((v.number for v in value if isinstance(v, Ref)), int(value[0]) if value and isinstance(value[0], float) and value[0] >= 0 else 0)
    return int(value) if isinstance(value, float) and value >= 0 else 0


def named(doc: Document, name: Name | bytes) -> Any:
    """A named destination: from the name tree for strings, from the catalog's /Dests for names."""
    root = doc.dict_of(doc.trailer.get("/Root"))
    if isinstance(name, Name):
        own = doc.dict_of(root.get("/Dests"))
        if name in own:
            return doc.resolve(own[name])
        name = name[1:].encode("latin-1", "replace")
    return search_names(doc, doc.dict_of(doc.dict_of(root.get("/Names")).get("/Dests")), text_of(name), set())


def search_names(doc: Document, node: dict, name: str, seen: set[int]) -> Any:
    limits = doc.resolve(node.get("/Limits"))
    if isinstance(limits, list) and len(limits) == 2 and not text_of(doc.resolve(limits[0])) <= name <= text_of(doc.resolve(limits[1])):
        return None
    flat = doc.resolve(node.get("/Names"))
    for key, value in zip(flat[::2], flat[1::2], strict=False) if isinstance(flat, list) else ():
        if text_of(doc.resolve(key)) == name:
            return doc.resolve(value)
    for kid in doc.resolve(node.get("/Kids")) or []:
        if isinstance(kid, Ref) and kid.number not in seen:
            seen.add(kid.number)
            if (found := search_names(doc, doc.dict_of(kid), name, seen)) is not None:
                return found
    return None


def outline_text(entries: list[Entry]) -> str:
    return "\n".join(" " * e.depth + e.title for e in entries)


def title(doc: Document) -> str:
    value = doc.info().get("/Title")
    return NO_TITLE if value is None else text_of(value) if isinstance(value, bytes) else show(value)


def object_text(doc: Document, number: int) -> str:
    """An object as one line; of a stream the start of its decoded data in hexadecimal, after its dictionary if that has a subtype."""
    value = doc.get(number)
    if value is None and number not in doc.xref:
        raise PdfError("MISSING_OBJECT", str(number))
    if not isinstance(value, Stream):
        return show(value)
    data = doc.stream(number)
    if "/Subtype" not in value.info:
        return data.decode("latin-1")
    digits = data.hex()
    return show(value.info) + "\n" + (digits[:256] + "...(omit)" if len(digits) > 256 else digits)
