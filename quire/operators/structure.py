"""The structure tree of tagged files, and text assembled by it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..sources.document import Document
from ..sources.syntax import Name, PdfError, Ref
from .interpret import Glyph
from .layout import Options, build_lines, join_lines, join_run, page_text, ruby_text, strip_headers

DEPTH, TAGGED_SHARE = 512, 0.5
#: Structure types after which a paragraph ends.
PARAGRAPH_TYPES = ("/P", "/H1", "/H2", "/H3", "/H4", "/H5", "/H6", "/LI", "/LBody", "/TD", "/TH", "/Caption", "/Title")


@dataclass
class Element:
    kind: str
    page: int | None
    kids: list = field(default_factory=list)  # Element, or (page object, mcid)


def tree(doc: Document) -> Element | None:
    root = doc.dict_of(doc.trailer.get("/Root")).get("/StructTreeRoot")
    if root is None:
        return None
    own = doc.dict_of(root)
    if not own:
        raise PdfError("BROKEN_STRUCTURE", "/StructTreeRoot")
    return _element(doc, own, None, {root.number} if isinstance(root, Ref) else set(), 0)


def _element(doc: Document, own: dict, page: int | None, seen: set[int], depth: int) -> Element:
    here = own.get("/Pg")
    page = here.number if isinstance(here, Ref) else page
    kind = next((str(own[k]) for k in ("/S", "/Type") if isinstance(own.get(k), Name)), "")
    return Element(kind, page, _kids(doc, own.get("/K"), page, seen, depth))


def _kids(doc: Document, value: Any, page: int | None, seen: set[int], depth: int) -> list:
    if depth > DEPTH or value is None:
        return []
    if isinstance(value, list):
        return [k for v in value for k in _kids(doc, v, page, seen, depth)]
    if isinstance(value, float):
        return [(page, int(value))] if page is not None else []
    if isinstance(value, Ref):
        if value.number in seen:
            return []
        target = doc.get(value.number)
        if target is None:
            raise PdfError("BROKEN_STRUCTURE", f"object {value.number} is missing")
        seen.add(value.number)
        return _kids(doc, target, page, seen, depth + 1)
    if not isinstance(value, dict) or value.get("/Type") == "/OBJR":
        return []
    if value.get("/Type") == "/MCR":
        here, mcid = value.get("/Pg"), value.get("/MCID")
        page = here.number if isinstance(here, Ref) else page
        return [(page, int(mcid))] if isinstance(mcid, float) and page is not None else []
    return [_element(doc, value, page, seen, depth + 1)]


def logical_order(root: Element) -> list[tuple[list[str], int, int]]:
    """Path of types, page object and mcid of each leaf, depth first."""
    out: list[tuple[list[str], int, int]] = []

    def walk(e: Element, path: list[str]) -> None:
        path = [*path, e.kind]
        for k in e.kids:
            if isinstance(k, Element):
                walk(k, path)
            else:
                out.append((path, *k))

    walk(root, [])
    return out


def leaves(e: Element) -> list[tuple[int, int]]:
    return [x for k in e.kids for x in (leaves(k) if isinstance(k, Element) else [k])]


def ruby_spans(root: Element) -> list[tuple[int, list[int], list[int]]]:
    """Page, mcids of the bases and mcids of the readings of each /Ruby element."""
    out = []
    if root.kind == "/Ruby":
        part = {k: next((e for e in root.kids if isinstance(e, Element) and e.kind == k), None) for k in ("/RB", "/RT")}
        if all(part.values()):
            base, ruby = leaves(part["/RB"]), leaves(part["/RT"])
            if base and ruby:
                out.append((base[0][0], [m for _, m in base], [m for _, m in ruby]))
    for k in root.kids:
        if isinstance(k, Element):
            out += ruby_spans(k)
    return out


def by_mcid(items: list) -> dict[int, list[Glyph]]:
    out: dict[int, list[Glyph]] = {}
    for g in items:
        if isinstance(g, Glyph) and g.mcid is not None:
            out.setdefault(g.mcid, []).append(g)
    return out


def untagged(items: list) -> list[Glyph]:
    return [g for g in items if isinstance(g, Glyph) and g.mcid is None]


def usable(pages: list[list]) -> bool:
    """Whether at least half of all segments are tagged."""
    glyphs = [g for p in pages for g in p if isinstance(g, Glyph)]
    return bool(glyphs) and sum(g.mcid is not None for g in glyphs) / len(glyphs) >= TAGGED_SHARE


def assemble(root: Element, refs: list[int], pages: list[list], options: Options) -> str:
    """Segments in the tree's order, then what is untagged of each page."""
    found = {(ref, m): glyphs for ref, items in zip(refs, pages, strict=True) for m, glyphs in by_mcid(items).items()}
    spans = ruby_spans(root) if options.ruby else []
    ruby = {(page, b): text for page, bases, readings in spans for b, r in zip(bases, readings, strict=False) if (text := join_run(found.get((page, r), [])))}
    whole = {ref: items for ref, items in zip(refs, pages, strict=True) if options.ruby and ref not in {p for p, _, _ in spans}}
    out: list[str] = []
    after_paragraph, done = False, set()
    for path, page, mcid in logical_order(root):
        if page in whole and page not in done:
            done.add(page)
            text, ends = page_text(whole[page], options), False
        elif (page, mcid) in found:
            text, ends = join_run(found[page, mcid]), path[-1] in PARAGRAPH_TYPES
            text = ruby_text(text, ruby[page, mcid]) if (page, mcid) in ruby else text
        else:
            continue
        out += ["\n\n"] if after_paragraph and out else []
        out.append(text)
        after_paragraph = ends
    rest = strip_headers([build_lines(untagged(items)) for items in pages])
    for ref, lines in zip(refs, rest, strict=True):
        if ref not in whole and (text := join_lines(lines)):
            out += ["\n\n"] if out else []
            out.append(text)
    return "".join(out) + "\n"
