"""Stream filters and predictors. They follow the specification where readers in use differ on malformed data."""

from __future__ import annotations

import re
import zlib
from typing import Any

import numpy as np

from .syntax import Name, PdfError

SUPPORTED = ("/FlateDecode", "/DCTDecode", "/ASCII85Decode")


def filter_names(info: dict) -> list[str]:
    value = info.get("/Filter")
    if value is None:
        return []
    names = value if isinstance(value, list) else [value]
    if not all(isinstance(n, Name) for n in names):
        raise PdfError("BAD_FILTER", "/Filter is neither a name nor an array of names")
    return [str(n) for n in names]


def inflate(data: bytes) -> bytes:
    """zlib data; what can be read of a damaged stream counts, a stream of which nothing can be read is an error."""
    d = zlib.decompressobj()
    try:
        return d.decompress(data) + d.flush()
    except zlib.error as e:
        out, d = [], zlib.decompressobj()
        try:
            for k in range(0, len(data), 64):
                out.append(d.decompress(data[k : k + 64]))
        except zlib.error:
            pass
        if not (got := b"".join(out)):
            raise PdfError("DECODE_FAILED", f"FlateDecode: {e}") from None
        return got


def ascii85(data: bytes) -> bytes:
    """Base-85 groups up to `~>`; `z` is four zero bytes; a last group of n characters gives n - 1 bytes."""
    data = re.sub(rb"[\0\t\n\x0c\r ]", b"", data.removeprefix(b"<~").partition(b"~")[0])
    out, group = bytearray(), []
    for c in data:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += group_bytes(group)
                group = []
        else:
            raise PdfError("DECODE_FAILED", "ASCII85Decode: character out of range")
    if group:
        out += group_bytes(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def group_bytes(group: list[int]) -> bytes:
    n = 0
    for d in group:
        n = n * 85 + d
    return (n & 0xFFFFFFFF).to_bytes(4, "big")


def number(params: dict, key: str, default: int) -> int:
    value = params.get(key)
    return int(value) if isinstance(value, float) else default


def predict(params: Any, data: bytes) -> bytes:
    """Undoes PNG predictors (10 to 15); the row's own first byte names its filter."""
    if not isinstance(params, dict) or number(params, "/Predictor", 1) < 10:
        return data
    bpp = max(1, number(params, "/Colors", 1) * number(params, "/BitsPerComponent", 8) // 8)
    width = -(-number(params, "/Columns", 1) * number(params, "/Colors", 1) * number(params, "/BitsPerComponent", 8) // 8)
    out, above = [], np.zeros(width, np.uint8)
    for k in range(0, len(data), width + 1):
        kind, raw = data[k], np.frombuffer(data[k + 1 : k + 1 + width], np.uint8)
        if len(raw) < width:
            raw = np.r_[raw, np.zeros(width - len(raw), np.uint8)]
        above = unfilter(kind, raw, above, bpp)
        out.append(above[: len(data) - k - 1].tobytes())
    return b"".join(out)


def unfilter(kind: int, raw: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    if kind == 0:
        return raw
    if kind == 2:
        return raw + above
    if kind == 1:
        padded = np.r_[raw, np.zeros(-len(raw) % bpp, np.uint8)].reshape(-1, bpp)
        return np.cumsum(padded, 0, dtype=np.uint8).ravel()[: len(raw)]
    if kind not in (3, 4):
        raise PdfError("DECODE_FAILED", f"unknown PNG filter {kind}")
    row, up = raw.tolist(), above.tolist()
    for i in range(len(row)):
        left, corner = (row[i - bpp], up[i - bpp]) if i >= bpp else (0, 0)
        row[i] = row[i] + ((left + up[i]) // 2 if kind == 3 else paeth(left, up[i], corner)) & 255
    return np.array(row, np.uint8)


def paeth(left: int, up: int, corner: int) -> int:
    guess = left + up - corner
    return min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]


def decode(info: dict, data: bytes) -> bytes:
    """Data with all filters of its dictionary undone."""
    params = info.get("/DecodeParms", info.get("/DP"))
    names = filter_names(info)
    each = params if isinstance(params, list) else [params] * len(names)
    for k, name in enumerate(names):
        if name == "/FlateDecode":
            data = predict(each[k] if k < len(each) else None, inflate(data))
        elif name == "/ASCII85Decode":
            data = ascii85(data)
        elif name != "/DCTDecode":
            raise PdfError("UNSUPPORTED_FEATURE", f"filter {name}")
    return data
