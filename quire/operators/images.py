"""Images of pages as JPEG, PNG or raw samples."""

from __future__ import annotations

import json
import struct
import zlib
from typing import Any, NamedTuple

from ..sources.document import Document
from ..sources.filters import filter_names
from ..sources.syntax import PdfError, Ref, Stream
from .interpret import image_hits, page_items


class PageImage(NamedTuple):
    page: int
    index: int
    ref: int
    format: str
    x0: float
    y0: float
    x1: float
    y1: float
    data: bytes

    @property
    def name(self) -> str:
        ends = {"jpeg": "jpg", "png": "png"}
        return f"page{self.page}-{self.index:03d}.{ends.get(self.format, 'raw')}"

    def sidecar(self) -> str:
        """What a raw file's reader has to know, as JSON."""
        box = [self.x0, self.y0, self.x1, self.y1]
        return json.dumps({"page": self.page, "index": self.index, "format": "raw", "length": len(self.data), "bbox": box}, separators=(",", ":"))


def components(doc: Document | None, value: Any) -> int | None:
    """Samples of a pixel, for the colour spaces that PNG has."""
    for _ in range(8):
        if isinstance(value, Ref) and doc:
            value = doc.resolve(value)
        if isinstance(value, dict):
            value = value.get("/ColorSpace")
        elif isinstance(value, list):
            value = value[0] if value else None
        elif not isinstance(value, Ref):
            break
    return {"/DeviceRGB": 3, "/DeviceGray": 1}.get(value) if isinstance(value, str) else None


def positive(info: dict, key: str) -> int:
    value = info.get(key)
    if not isinstance(value, float):
        raise PdfError("MISSING_KEY", f"{key} of an image")
    if int(value) <= 0:
        raise PdfError("UNSUPPORTED_FEATURE", f"invalid {key}")
    return int(value)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width: int, height: int, samples: int, data: bytes) -> bytes:
    row = width * samples
    lines = b"".join(b"\0" + data[k : k + row] for k in range(0, row * height, row))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if samples == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def classify(info: dict, data: bytes, doc: Document | None = None) -> tuple[str, bytes]:
    """jpeg for DCT data, png for whole 8-bit RGB or grey samples, else raw."""
    if "/DCTDecode" in filter_names(info) or data[:3] == b"\xff\xd8\xff":
        return "jpeg", data
    width, height, depth = (positive(info, k) for k in ("/Width", "/Height", "/BitsPerComponent"))
    samples = components(doc, info.get("/ColorSpace"))
    if samples and depth == 8 and len(data) == width * height * samples:
        return "png", png(width, height, samples, data)
    return "raw", data


def page_images(doc: Document, number: int) -> list[PageImage]:
    """Images in drawing order; one that can't be read fails the page."""
    out = []
    for k, hit in enumerate(image_hits(page_items(doc, doc.page(number))), 1):
        value = doc.get(hit.image)
        if not isinstance(value, Stream):
            raise PdfError("MISSING_OBJECT", f"image {hit.image}")
        kind, data = classify({k: doc.resolve(v) for k, v in value.info.items()}, doc.stream(hit.image), doc)
        out.append(PageImage(number, k, hit.image, kind, *hit[:4], data))
    return out
