import hashlib
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quire.llm import jpeg


def padded(data):
    return data + b"\xff" * (-len(data) % 576 or (0 if data else 576))


def luma_bytes(stored):
    return b"".join(x.tobytes() for _, _, x in jpeg.read([stored])[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=4))
def test_round_trip(blobs):
    payloads = [padded(b) for b in blobs]
    assert [jpeg.pad(b) for b in blobs] == payloads
    stored = jpeg.encode(payloads)
    assert [luma_bytes(s) for s in stored] == payloads
    assert stored == [jpeg.encode([p])[0] for p in payloads]  # equal payloads, equal files


def test_long_payload_is_several_images():
    p = np.random.default_rng(1).integers(0, 256, 576 * 8191 + 576, dtype=np.uint8).tobytes()
    stored = jpeg.encode([p])[0]
    assert [(w, h) for w, h, _ in jpeg.read([stored])[0]] == [(4608, 65528), (4608, 8)] and luma_bytes(stored) == p


def test_table(spark, odd, empty):
    rows = {(r.doc_id, r.text) for r in odd.collect()}
    want = set()
    for i, t in rows:
        raw = (t or "").encode()
        p = padded(raw)
        want.add((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    got = jpeg.text_media(odd)
    assert {tuple(r) for r in got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()} == want
    assert got.count() == odd.count() and jpeg.text_media(empty).count() == 0
    first = got.first()
    stored = jpeg.encode([padded((odd.first().text or "").encode())])[0]
    assert (first.media_bytes, first.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


class Bits:
    """A plain encoder of one bit after the other, for files of other shapes than the writer makes."""

    def __init__(self):
        self.bits = ""

    def put(self, code, n):
        self.bits += format(code, f"0{n}b") if n else ""

    def done(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def value_bits(v):
    n = abs(v).bit_length()
    return n, v if v > 0 else v + (1 << n) - 1


def test_colour_with_ac_and_subsampling():
    """Three components, luminance sampled 2 x 2, AC coefficients with zero runs, no restart markers, 32 x 16 pixels."""
    r = np.random.default_rng(4)
    # Four-bit codes for DC categories 0 to 11, eight-bit codes for the AC symbols.
    dc_table = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    symbols = [0, 0xF0] + [run << 4 | size for run in (0, 1, 5) for size in (1, 3)]
    ac_table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)
    bits, last, want = Bits(), [0, 0, 0], np.zeros((2, 4), np.uint8)

    def block(k, dc, ac):
        n, v = value_bits(dc - last[k])
        last[k] = dc
        bits.put(n, 4), bits.put(v, n)
        place = 0
        for run, x in ac:
            while run > 15:
                bits.put(symbols.index(0xF0), 8)
                run, place = run - 16, place + 16
            n, v = value_bits(x)
            bits.put(symbols.index(run << 4 | n), 8), bits.put(v, n)
            place += run + 1
        if place < 63:
            bits.put(symbols.index(0), 8)

    for unit in range(2):
        for b in range(4):
            dc = int(r.integers(-60, 60))
            want[b // 2, unit * 2 + b % 2] = np.clip((dc * 16 + 4 >> 3) + 128, 0, 255)
            block(0, dc, [(1, 1), (0, -5), (21, 7)] if b % 2 else [(0, 1)] * 63)
        block(1, int(r.integers(-9, 9)), [])
        block(2, int(r.integers(-9, 9)), [(5, -1)])
    q = jpeg.segment(0xDB, b"\0" + b"\x10" * 64) + jpeg.segment(0xDB, b"\x11" + b"\0\x10" * 64)
    frame = jpeg.segment(0xC0, struct.pack(">BHHB", 8, 16, 32, 3) + b"\x01\x22\0\x02\x11\x01\x03\x11\x01")
    tables = jpeg.segment(0xC4, b"\0" + dc_table + b"\x10" + ac_table)
    data = b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\0") + q + frame + tables + jpeg.segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + bits.done() + b"\xff\xd9"
    (w, h, luma), = jpeg.read([data])[0]
    assert (w, h) == (32, 16) and (luma == want).all()


def test_scans_of_single_components():
    """The luminance in a scan of its own, after one of another component: its blocks are not padded to whole units."""
    dc_table, ac_table = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)), bytes([1] + [0] * 15) + bytes(1)
    want, last, bits, other = np.array([[10, 20, 30], [200, 150, 40]], np.uint8), 0, Bits(), Bits()
    for x in want.ravel().astype(int) - 128:
        n, v = value_bits(int(x - last))
        last = int(x)
        bits.put(n, 4), bits.put(v, n), bits.put(0, 1)
    for _ in range(2):
        other.put(0, 4), other.put(0, 1)
    frame = jpeg.segment(0xC0, struct.pack(">BHHB", 8, 16, 20, 2) + b"\x01\x22\0\x02\x11\0")
    data = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + b"\x08" * 64) + frame + jpeg.segment(0xC4, b"\0" + dc_table + b"\x10" + ac_table)
    data += jpeg.segment(0xDA, b"\x01\x02\0\0\x3f\0") + other.done() + jpeg.segment(0xDA, b"\x01\x01\0\0\x3f\0") + bits.done() + b"\xff\xd9"
    ((w, h, luma),) = jpeg.read([data])[0]
    assert (w, h) == (20, 16) and (luma == want).all()


def plain_hash(luma):
    """Cells of the 8 x 8 grid one after the other; a cell without rows or columns has those at its start."""
    (h, w), cells = luma.shape, []
    for y in range(8):
        for x in range(8):
            ys = range(y * h // 8, max((y + 1) * h // 8, y * h // 8 + 1))
            xs = range(x * w // 8, max((x + 1) * w // 8, x * w // 8 + 1))
            cells.append(sum(int(luma[a, b]) for a in ys for b in xs) / (len(ys) * len(xs)))
    mean = sum(cells) / 64
    return f"{int(''.join('1' if c > mean else '0' for c in cells), 2):016x}"


def test_feature_against_plain():
    texts = ["a", "", None, "some text " * 400, "\U0001f600é" * 3000, "z" * 5000 + "A" * 5000]
    got = jpeg.media_rows(texts)[-1]
    for t, feature in zip(texts, got):
        p = padded((t or "").encode())
        luma = np.frombuffer(p, np.uint8).reshape(-1, 576)
        assert feature == f"4608x{8 * len(luma)}:{plain_hash(luma)}"


def test_slices_change_nothing(monkeypatch):
    """Coded and read in slices and bands, and text by text, everything is as it is at once."""
    r = np.random.default_rng(5)
    texts = ["".join(map(chr, r.integers(32, 1000, n))) for n in (10, 5000, 0, 20_000)]
    want = jpeg.media_rows(texts)
    stored = jpeg.encode([padded(t.encode()) for t in texts])
    for at_once, long in ((24 * 5, 1 << 18), (24 * 24 * 3, 1), (24, 3000)):
        monkeypatch.setattr(jpeg, "AT_ONCE", at_once)
        monkeypatch.setattr(jpeg, "LONG", long)
        assert jpeg.media_rows(texts) == want and jpeg.encode([padded(t.encode()) for t in texts]) == stored
    monkeypatch.setattr(jpeg, "MAX_ROWS", 3)
    whole = jpeg.media_rows(texts)
    monkeypatch.setattr(jpeg, "LONG", 1 << 18)
    assert jpeg.media_rows(texts) == whole


def test_memory_of_a_long_text():
    """A text of 60 MB takes the text, its bytes and under 100 MB more."""
    code = "import resource\nfrom quire.llm import jpeg\npeak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024\njpeg.media_rows(['warm up'])\nt = 'some words and 7 more ' * 2_750_000\nbefore = peak()\nrow = jpeg.media_rows([t])\nassert row[0] == [60_500_000] and row[1][0] % 576 == 0\nprint(peak() - before)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 60 + 100


def test_broken_files(spark):
    good = jpeg.encode([padded(b"x")])[0]
    rows = [(1, good), (2, b"no image"), (3, None), (4, good[:-40]), (5, good.replace(b"\xff\xc0", b"\xff\xc2")), (6, good + good)]
    got = jpeg.thumbnails(spark.createDataFrame(rows, "k int, content binary"), "k").collect()
    assert [(r.k, r.image) for r in got if r.error is None] == [(1, 0), (6, 0), (6, 1)]
    assert {r.k for r in got if r.error} == {2, 3, 4, 5}
    with pytest.raises(ValueError):
        jpeg.parse(b"")
