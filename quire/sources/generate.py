"""Text to PDF: the sink that gives test files and exact round trips."""

from __future__ import annotations

import zlib
from binascii import hexlify

from ..operators.forms import number_text, write_pdf
from ..sources.syntax import Name, Ref, Stream

FONT_SIZE, LEADING, LEFT, TOP, LINES = 10.0, 12.0, 72.0, 780.0, 58
#: Bytes of a code that a composite font shows: UTF-16BE, so any text can be written.
ENCODING = "/UniJIS-UTF16-H"


def text_pages(text: str, lines: int = LINES) -> list[list[str]]:
    """Lines of a text in pages; an empty text has one empty page."""
    all_lines = text.split("\n") if text else []
    return [all_lines[k : k + lines] for k in range(0, len(all_lines), lines)] or [[]]


def content(lines: list[str]) -> bytes:
    out = [b"BT /F1 %b Tf %b TL %b %b Td" % tuple(number_text(x).encode() for x in (FONT_SIZE, LEADING, LEFT, TOP))]
    for k, line in enumerate(lines):
        out.append(b"T*" if k else b"")
        if line:
            out.append(b"<" + hexlify(line.encode("utf-16-be", "surrogatepass")) + b"> Tj")
    return b"\n".join([*filter(None, out), b"ET"])


def text_pdf(text: str, title: str | None = None, lines: int = LINES, compress: bool = True) -> bytes:
    """A file with one line of text for each line, in pages of `lines` lines."""
    pages = text_pages(text, lines)
    kids = [Ref(10 + 2 * k) for k in range(len(pages))]
    objects = {
        1: {"/Type": Name("/Catalog"), "/Pages": Ref(2)},
        2: {"/Type": Name("/Pages"), "/Kids": kids, "/Count": float(len(kids))},
        3: {"/Type": Name("/Font"), "/Subtype": Name("/Type0"), "/BaseFont": Name("/Quire"), "/Encoding": Name(ENCODING), "/DescendantFonts": [Ref(4)]},
        4: {"/Type": Name("/Font"), "/Subtype": Name("/CIDFontType0"), "/BaseFont": Name("/Quire"), "/DW": 500.0},
        5: {"/Title": b"\xfe\xff" + (title or "").encode("utf-16-be", "surrogatepass")},
    }
    for k, own in enumerate(pages):
        data = content(own)
        info = {"/Filter": Name("/FlateDecode")} if compress else {}
        objects[10 + 2 * k] = {"/Type": Name("/Page"), "/Parent": Ref(2), "/MediaBox": [0.0, 0.0, 612.0, 842.0], "/Resources": {"/Font": {"/F1": Ref(3)}}, "/Contents": Ref(11 + 2 * k)}
        objects[11 + 2 * k] = Stream(info, zlib.compress(data, 1) if compress else data)
    return write_pdf(objects, {"/Root": Ref(1), "/Info": Ref(5)})
