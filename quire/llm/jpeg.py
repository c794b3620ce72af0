"""Operator 6: media columns held as baseline JPEG.

Store: a byte is one 8 x 8 block of constant luminance. With a quantiser of 8 for the DC term its coefficient is the byte less 128, so the file holds the bytes without loss and its thumbnail at an eighth of the size is the payload itself. Each run of 24 blocks ends in a restart marker. A payload of more rows than a JPEG may have becomes several images, one after the other.

Read: markers are parsed, byte stuffing is removed, and the Huffman codes of all restart intervals of all files with the same tables are decoded in step, one block of each interval at a time, with tables over 16-bit windows. AC coefficients are decoded and skipped. Any baseline JPEG of 8 bits a sample works: several components, in one scan or in scans of their own, sampling factors, no restart markers, AC coefficients.

Edge cases: null or empty text is a payload of 576 bytes 255. Repeated rows give equal rows; an empty table gives an empty one; other columns are not read. Long texts are whole: only the number of images grows, which are stored, read back and hashed one by one, AT_ONCE blocks at a time, so that besides the text itself a task holds one image (under 15 MB) and the arrays of one slice. A file that is not a baseline JPEG raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

UNIT, RUN, WIDTH, MAX_ROWS = 576, 24, 576, 8191
#: Blocks that are coded or decoded at once, and bytes of payload from which a text is stored and read image by image.
AT_ONCE, LONG = 1 << 17, 1 << 18
#: Lengths of the codes for the DC categories 0 to 8 in the files written here: fixed by the DHT segment below.
DC_LENGTHS = (3, 3, 3, 3, 3, 3, 4, 4, 4)


#: The first marker that is neither stuffing nor a restart.
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7]").search


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def canonical(lengths) -> list[int]:
    """Codes of ascending lengths, as DHT assigns them."""
    code, out, before = 0, [], lengths[0]
    for n in lengths:
        code <<= n - before
        out.append(code)
        code, before = code + 1, n
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    counts = bytes(DC_LENGTHS.count(n) for n in range(1, 17))
    return b"".join((
        b"\xff\xd8",
        segment(0xDB, b"\0\x08" + b"\x01" * 63),
        segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + b"\x01\x11\0"),
        segment(0xC4, b"\0" + counts + bytes(range(len(DC_LENGTHS)))),
        segment(0xC4, b"\x10" + b"\x01" + b"\0" * 15 + b"\0"),
        segment(0xDD, struct.pack(">H", RUN)),
        segment(0xDA, b"\x01\x01\0\0\x3f\0"),
    ))


def _code_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 on: category code, value bits, then the one-bit end of block."""
    codes, bits, sizes = canonical(DC_LENGTHS), [], []
    for d in range(-255, 256):
        k = abs(d).bit_length()
        bits.append(((codes[k] << k | (d if d > 0 else d + (1 << k) - 1 if d else 0)) << 1))
        sizes.append(DC_LENGTHS[k] + k + 1)
    return np.array(bits, np.uint64), np.array(sizes, np.int64)


CODE_BITS, CODE_SIZES = _code_table()


def entropy(payload: np.ndarray, last: np.ndarray, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes for whole intervals of RUN samples and the number of bytes of each interval, its marker included; `last` marks the intervals that end an image, which get no marker. Markers count from 0 after each such interval, the first ones from `number`."""
    rows = payload.reshape(-1, RUN).astype(np.int64) - 128
    diff = rows.copy()
    diff[:, 1:] -= rows[:, :-1]
    at = diff + 255
    bits, size = CODE_BITS[at], CODE_SIZES[at]
    total = size.sum(1)
    n, most = len(rows), 6  # 24 blocks of at most 13 bits
    out = np.zeros((n, most), np.uint64)
    start, every = np.zeros(n, np.int64), np.arange(n)
    for k in range(RUN):
        word, room = start >> 6, 64 - (start & 63) - size[:, k]
        b = bits[:, k]
        out[every, word] |= np.where(room >= 0, b << np.maximum(room, 0).astype(np.uint64), b >> np.maximum(-room, 0).astype(np.uint64))
        if (over := np.flatnonzero(room < 0)).size:
            out[over, word[over] + 1] |= b[over] << (64 + room[over]).astype(np.uint64)
        start += size[:, k]
    full = out.astype(">u8").view(np.uint8).reshape(n, most * 8)
    length, spare = (total + 7) >> 3, (-total) & 7
    full[every, length - 1] |= ((1 << spare) - 1).astype(np.uint8)  # padding is ones
    wide = np.zeros((n, most * 8 + 2), np.uint8)
    wide[:, :-2] = full
    group_start = np.r_[0, np.flatnonzero(last)[:-1] + 1] if last.any() else np.zeros(1, np.int64)
    count = every - np.repeat(group_start, np.diff(np.r_[group_start, n]))
    count[: group_start[1] if len(group_start) > 1 else n] += number
    mark = ~last
    wide[every[mark], length[mark]] = 0xFF
    wide[every[mark], length[mark] + 1] = (0xD0 + count[mark] % 8).astype(np.uint8)
    column = np.arange(wide.shape[1])
    flat = wide[column < (length + 2 * mark)[:, None]]
    stuffed = (wide == 0xFF) & (column < length[:, None])
    twice = stuffed[column < (length + 2 * mark)[:, None]]
    grown = np.repeat(flat, 1 + twice)
    grown[np.flatnonzero(twice) + np.cumsum(twice)[twice]] = 0
    return grown, length + 2 * mark + stuffed.sum(1)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stored form for each padded payload; all of them are coded together."""
    images, owner = [], []
    for k, p in enumerate(payloads):
        for i in range(0, len(p), WIDTH * MAX_ROWS):
            images.append(min(len(p) - i, WIDTH * MAX_ROWS))
            owner.append(k)
    if not images:
        return []
    runs = np.array(images) // RUN
    last = np.zeros(runs.sum(), bool)
    last[np.cumsum(runs) - 1] = True
    flat, scans, sizes, number = np.frombuffer(b"".join(payloads), np.uint8), [], [], 0
    for a in range(0, len(last), step := AT_ONCE // RUN):
        part = last[a : a + step]
        scan, size = entropy(flat[a * RUN : (a + step) * RUN], part, number)
        scans.append(scan.tobytes())
        sizes.append(size)
        ends = np.flatnonzero(part)
        number = len(part) - 1 - int(ends[-1]) if len(ends) else number + len(part)
    cuts = np.r_[0, np.cumsum(np.add.reduceat(np.concatenate(sizes), np.r_[0, np.cumsum(runs)[:-1]]))]
    data, out = b"".join(scans), [[] for _ in payloads]
    for k, size, a, b in zip(owner, images, cuts[:-1], cuts[1:], strict=True):
        out[k] += [header(size // WIDTH), data[a:b], b"\xff\xd9"]
    return [b"".join(x) for x in out]


class Image(NamedTuple):
    """What the markers say. parts: (horizontal, vertical, DC table, AC table, quantiser of DC) of each component in the order of the scan that holds the first component, the luminance; columns and rows: samples that this scan codes of it, if it codes no other component."""

    width: int
    height: int
    columns: int
    rows: int
    parts: tuple
    restart: int
    scan: bytes
    end: int


def parse(data: bytes, at: int = 0) -> Image:
    """One image that starts at byte `at`."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no JPEG starts here")
    at, quant, tables, frame, restart, found = at + 2, {}, {}, None, 0, None
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        if data[at + 1] == 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind == 0xD9 and found:
            return found._replace(end=at + 2)
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("a segment is cut off")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xC0:
            frame = body
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif kind == 0xDA:
            if frame is None:
                raise ValueError("a scan comes before its frame")
            if not (end := SCAN_END(data, at)):
                raise ValueError("the scan does not end")
            found = found or scan_of(frame, body, quant, tables, restart, data[at : end.start()])
            at = end.start()


def scan_of(frame: bytes, head: bytes, quant: dict, tables: dict, restart: int, scan: bytes) -> Image | None:
    """The image of a scan, if that holds the first component of the frame."""
    depth, height, width, count = struct.unpack(">BHHB", frame[:6])
    if depth != 8 or not height or not width:
        raise ValueError("not a baseline JPEG")
    own = {frame[6 + 3 * k]: (frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, frame[8 + 3 * k]) for k in range(count)}
    names = [head[1 + 2 * k] for k in range(head[0])]
    if frame[6] not in names:
        return None
    if names[0] != frame[6] or 1 < len(names) < count:
        raise ValueError("the scan has some other order of components")
    parts = []
    for k, name in enumerate(names):
        h, v, q = own[name]
        dc, ac = divmod(head[2 + 2 * k], 16)
        parts.append((h, v, tables[dc], tables[16 + ac], quant[q]))
    most = [max(x[k] for x in own.values()) for k in (0, 1)]
    return Image(width, height, -(-width * parts[0][0] // most[0]), -(-height * parts[0][1] // most[1]), tuple(parts), restart, scan, 0)


def _symbols(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window the symbol that it starts with and its code's length (0: none)."""
    lengths = [n for n in range(1, 17) for _ in range(table[n - 1])]
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for code, n, s in zip(canonical(lengths) if lengths else [], lengths, table[16:], strict=True):
        a, b = code << (16 - n), (code + 1) << (16 - n)
        symbol[a:b], length[a:b] = s, n
    return symbol, length


_KEPT: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def symbols(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    if table not in _KEPT:
        if len(_KEPT) > 16:
            _KEPT.clear()
        _KEPT[table] = _symbols(table)
    return _KEPT[table]


#: A restart marker.
RESTART = re.compile(rb"\xff[\xd0-\xd7]").finditer


def bands(im: Image) -> list[Image]:
    """An image cut into bands of about AT_ONCE blocks, if its rows end where restart intervals do."""
    across, down = -(-im.columns // 8), -(-im.rows // 8)
    if len(im.parts) > 1 or across * down <= AT_ONCE or not im.restart or across % im.restart:
        return [im]
    each = max(1, AT_ONCE // across)
    marks = [m.start() for m in RESTART(im.scan)]
    runs = across // im.restart
    if len(marks) != runs * down - 1:
        raise ValueError("restart markers don't fit the frame")
    cuts = [-2, *marks[runs * each - 1 :: runs * each], len(im.scan)]
    return [im._replace(rows=8 * min(each, down - k * each), scan=im.scan[a + 2 : b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def decode_luminance(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance of each image, one sample for each 8 x 8 block, as uint8. About AT_ONCE blocks are decoded at once."""
    parts: list[list[np.ndarray]] = [[] for _ in images]
    groups = defaultdict(list)
    for k, im in enumerate(images):
        for band in bands(im):
            groups[im.parts].append((k, band))
    for tables, members in groups.items():
        held, blocks = [], 0
        for n, (k, band) in enumerate(members):
            held.append((k, band))
            blocks += band.columns * band.rows // 64
            if blocks >= AT_ONCE or n == len(members) - 1:
                for (i, _), x in zip(held, _decode(tables, [b for _, b in held]), strict=True):
                    parts[i].append(x)
                held, blocks = [], 0
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in parts]


def _decode(parts: tuple, images: list[Image]) -> list[np.ndarray]:
    hmax, vmax, single = max(p[0] for p in parts), max(p[1] for p in parts), len(parts) == 1
    shapes, runs = [], []
    for im in images:
        across, down = (-(-im.columns // 8), -(-im.rows // 8)) if single else (-(-im.width // (8 * hmax)), -(-im.height // (8 * vmax)))
        shapes.append((across, down))
        units = across * down
        each = im.restart or units
        runs.append(np.minimum(each, units - np.arange(0, units, each)))
    raw = np.frombuffer(b"".join(im.scan + b"\xff\xd0" for im in images), np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    marks = ff[after != 0]
    drop = np.zeros(len(raw), bool)
    drop[ff[after == 0] + 1] = True
    drop[marks] = drop[marks + 1] = True
    clean = raw[~drop].astype(np.int64)
    ends = marks - np.cumsum(drop)[marks] + 1
    starts = np.r_[0, ends[:-1]]
    units = np.concatenate(runs)
    if len(starts) != len(units):
        raise ValueError("restart markers don't fit the frame")
    tail = np.r_[clean, np.zeros(4, np.int64)]
    window = tail[:-2] << 16 | tail[1:-1] << 8 | tail[2:]  # 24 bits from each byte on
    bit = starts * 8

    def peek(p):
        return window.take(p >> 3, mode="clip") >> (8 - (p & 7)) & 0xFFFF

    def value(p, size):
        v = np.where(size > 0, peek(p) >> (16 - size), 0)
        return np.where((size > 0) & (v < 1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v)

    per_unit = 1 if single else parts[0][0] * parts[0][1]
    luma = np.zeros((len(units), int(units.max(initial=0)) * per_unit), np.int16)
    dc = np.zeros((len(parts), len(units)), np.int64)
    order = np.argsort(-units, kind="stable")
    live = np.searchsorted(-units[order], -np.arange(1, luma.shape[1] // per_unit + 1), side="right")
    for step, n in enumerate(live):
        row = order[:n]
        p = bit[row]
        for k, (h, v, dc_table, ac_table, quant) in enumerate(parts):
            (ds, dl), (acs, acl) = symbols(dc_table), symbols(ac_table)
            for block in range(1 if single else h * v):
                w = peek(p)
                size, length = ds[w], dl[w]
                if not length.all() or size.max(initial=0) > 11:
                    raise ValueError("bad DC code")
                dc[k, row] += value(p + length, size)
                p = p + length + size
                if k == 0:
                    luma[row, step * per_unit + block] = np.clip((dc[0, row] * quant + 4 >> 3) + 128, 0, 255)
                w = peek(p)
                s, length = acs[w], acl[w]
                if not length.all():
                    raise ValueError("bad AC code")
                p = p + length + (s & 15)
                filled = np.where(s == 0, 64, (s >> 4) + 2)
                pending = np.flatnonzero(filled < 64)
                while pending.size:
                    w = peek(p[pending])
                    s, length = acs[w], acl[w]
                    if not length.all():
                        raise ValueError("bad AC code")
                    p[pending] += length + (s & 15)
                    filled[pending] = np.where(s == 0, 64, filled[pending] + (s >> 4) + 1)
                    pending = pending[filled[pending] < 64]
        bit[row] = p
    out, at = [], 0
    for im, own, (across, down) in zip(images, runs, shapes, strict=True):
        flat = np.concatenate([luma[at + i, : n * per_unit] for i, n in enumerate(own)]) if len(own) == 1 or own[-1] != own[0] else luma[at : at + len(own), : own[0] * per_unit].ravel()
        at += len(own)
        h, v = (1, 1) if single else parts[0][:2]
        grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        out.append(grid[: -(-im.rows // 8), : -(-im.columns // 8)].astype(np.uint8))
    return out


def read(stored: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """Width, height and DC-only luminance of every image of each stored form."""
    images, owner = [], []
    for k, data in enumerate(stored):
        at = 0
        while at < len(data):
            images.append(im := parse(data, at))
            owner.append(k)
            at = im.end
    out: list[list] = [[] for _ in stored]
    for k, im, luma in zip(owner, images, decode_luminance(images), strict=True):
        out[k].append((im.width, im.height, luma))
    return out


def thumbnail_hash(luma: np.ndarray) -> str:
    """16 hex digits: which cells of an 8 x 8 grid over the thumbnail are lighter than the mean cell."""
    (ys, ny), (xs, nx) = (((e := np.arange(9) * n // 8)[:-1], np.maximum(np.diff(e), 1)) for n in luma.shape)
    cells = np.add.reduceat(np.add.reduceat(luma, ys, 0, dtype=np.int64), xs, 1) / np.outer(ny, nx)
    return np.packbits(cells.ravel() > cells.mean()).tobytes().hex()


def one_by_one(raw: bytes) -> tuple:
    """As media_rows for one text, its images stored, read back and hashed one after the other."""
    whole, media, tail, sizes, feature = hashlib.sha256(), hashlib.sha256(), b"", [0, 0], []
    for a in range(0, max(1, len(raw)), step := WIDTH * MAX_ROWS):
        part = raw[a : a + step]
        stored = encode([pad(part) if a + step >= len(raw) else part])[0]
        media.update(stored)
        ((w, h, luma),) = read([stored])[0]
        payload = luma.tobytes()
        whole.update(payload)
        tail, sizes = payload[-32:], [sizes[0] + len(payload), sizes[1] + len(stored)]
        feature.append(f"{w}x{h}:{thumbnail_hash(luma)}")
    return len(raw), sizes[0], whole.hexdigest(), zlib.crc32(tail), sizes[1], media.hexdigest(), ";".join(feature)


def together(raw: list[bytes]) -> list[tuple]:
    """As media_rows for short texts, which are coded together."""
    stored = encode([pad(r) for r in raw])
    out = []
    for r, form, own in zip(raw, stored, read(stored), strict=True):
        payload = b"".join(luma.tobytes() for _, _, luma in own)
        out.append((len(r), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form), hashlib.sha256(form).hexdigest(), ";".join(f"{w}x{h}:{thumbnail_hash(luma)}" for w, h, luma in own)))
    return out


def media_rows(texts: list[str | None]) -> list[list]:
    """The columns n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature; everything of the payload comes from what is read back."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    short = iter(together([r for r in raw if len(r) < LONG]))
    rows = [next(short) if len(r) < LONG else one_by_one(r) for r in raw]
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(7)]


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: the id and the columns of media_rows."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_arrow(docs.select(F.col(id_col), F.col(text_col).alias("_text")), lambda: lambda cols: [cols[0], *media_rows(cols[1])], schema, text="_text", batch_bytes=256 << 10)


def thumbnails(files: DataFrame, id_col: str, content_col: str = "content") -> DataFrame:
    """For a column of JPEG files: id, image number, width, height, thumbnail (raw luminance at an eighth of the size), its hash, and error where a file can't be read. Null content has no images and the error `null`."""

    def make():
        def work(cols):
            rows = []
            for i, data in zip(*cols, strict=True):
                try:
                    if data is None:
                        raise ValueError("null")
                    rows += [(i, n, w, h, luma.tobytes(), thumbnail_hash(luma), None) for n, (w, h, luma) in enumerate(read([data])[0])]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    rows.append((i, None, None, None, None, None, str(e)))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(7)]

        return work

    kind = files.schema[id_col].dataType.simpleString()
    return map_arrow(files.select(F.col(id_col), F.col(content_col).alias("_content")), make, f"`{id_col}` {kind}, image int, width int, height int, thumbnail binary, thumbnail_hash string, error string", text="_content")
