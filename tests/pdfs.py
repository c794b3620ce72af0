"""PDF files for tests, written part by part so that each kind of file structure occurs."""

from __future__ import annotations

import zlib
from hashlib import md5

from quire.sources import crypto

HEAD = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"
FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
WIDE = b"<< /Type /Font /Subtype /Type1 /BaseFont /Quire /FirstChar 97 /LastChar 122 /Widths [%b] >>" % b" ".join(b"%d" % (400 + 20 * k) for k in range(26))  # a: 400, b: 420, ...
CATALOG, PAGES = b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"
PAGE = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 500 650] /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>"


def stream(data: bytes, info: bytes = b"") -> bytes:
    return b"<< %b/Length %d >>\nstream\n%b\nendstream" % (info, len(data), data)


def show(text: bytes) -> bytes:
    return b"BT /F1 16 Tf 50 600 Td (%b) Tj ET" % text


def body(objects: dict[int, bytes], start: bytes = HEAD) -> tuple[bytes, dict[int, int]]:
    out, at = start, {}
    for n, o in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (n, o)
    return out, at


def classic(objects: dict[int, bytes], trailer: bytes = b"") -> bytes:
    out, at = body(objects)
    size, start = max(at) + 1, len(out)
    table = b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at[n]) for n in sorted(at))
    return out + table + b"trailer\n<< /Size %d /Root 1 0 R %b>>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, start)


def simple(content: bytes, font: bytes = FONT, **more: bytes) -> dict[int, bytes]:
    return {1: CATALOG, 2: PAGES, 3: PAGE, 4: stream(content), 5: font} | {int(k[1:]): v for k, v in more.items()}


def xref_stream(objects: dict[int, bytes], packed: dict[int, bytes] | None = None) -> bytes:
    """A file whose cross-references are a stream; `packed` objects lie in a compressed object stream."""
    objects, packed = dict(objects), packed or {}
    container, last = max([*objects, *packed]) + 1, max([*objects, *packed]) + 1 + bool(packed)
    if packed:
        heads, bodies, at = b"", b"", 0
        for n, o in packed.items():
            heads += b"%d %d " % (n, at)
            bodies += o + b" "
            at = len(bodies)
        objects[container] = stream(zlib.compress(heads + bodies), b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode " % (len(packed), len(heads)))
    out, at = body(objects)
    rows = []
    for n in range(last + 1):
        if n in packed:
            rows.append((2, container, list(packed).index(n)))
        else:
            rows.append((1, at[n], 0) if n in at else (1, len(out), 0) if n == last else (0, 0, 0))
    data = b"".join(bytes([a]) + b.to_bytes(2, "big") + c.to_bytes(2, "big") for a, b, c in rows)
    return out + b"%d 0 obj\n%b\nendobj\nstartxref\n%d\n%%%%EOF\n" % (last, stream(data, b"/Type /XRef /W [1 2 2] /Size %d /Root 1 0 R " % (last + 1)), len(out))


def incremental(objects: dict[int, bytes], new: dict[int, bytes], gone: tuple[int, ...] = ()) -> bytes:
    old = classic(objects)
    out, at = body(new, old)
    table = b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, at[n]) for n in at) + b"".join(b"%d 1\n0000000000 00001 f \n" % n for n in gone)
    prev = int(old.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    return out + table + b"trailer\n<< /Size %d /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (max([*objects, *new]) + 1, prev, len(out))


def encrypted(content: bytes, aes: bool = False, user: bytes = b"", owner: bytes = b"landlord") -> bytes:
    """RC4 of 40 bits, or AES of 128."""
    file_id, revision, length = md5(content).digest(), 4 if aes else 2, 16 if aes else 5
    key = md5(crypto.pad(owner)).digest()
    for _ in range(50 if aes else 0):
        key = md5(key).digest()
    o = crypto.pad(user)
    for k in range(20 if aes else 1):
        o = crypto.rc4(bytes(b ^ k for b in key[:length]), o)
    main = crypto.file_key(user, o, -1, file_id, revision, length, True)
    u = (crypto.user_value(main, file_id, revision) + bytes(16))[:32]
    security = crypto.Security(main, aes)
    data = security.encrypt(4, content)
    kind = b"/V 4 /R 4 /Length 128 /CF << /StdCF << /CFM /AESV2 >> >> /StmF /StdCF /StrF /StdCF" if aes else b"/V 1 /R 2"
    info = b"<< /Filter /Standard %b /O <%b> /U <%b> /P -1 >>" % (kind, o.hex().encode(), u.hex().encode())
    ids = file_id.hex().encode()
    return classic(simple(b"", o6=info) | {4: stream(data)}, b"/Encrypt 6 0 R /ID [<%b> <%b>] " % (ids, ids))

