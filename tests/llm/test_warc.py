import gzip
import hashlib
import time

from pyspark.sql import functions as F

from quire.llm import warc

PAGES = [(k, f"https://example.org/{k}", "<p>" + "text é " * (k * 7 % 900) + "</p>") for k in range(300)] + [(None, None, None), (5, "https://example.org/5", None), (6, "", ""), (7, "x\r\ny", "long" * 100_000), (9, "dup", "same"), (9, "dup", "same")]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, file string")


def test_records_are_parsed_back(spark, tmp_path):
    got = warc.records(frame(spark)).collect()
    assert len(got) == len(PAGES)
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r.record) for r in got))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.record)) for r in got))
    (tmp_path / "c.warc").write_bytes(bytes(got[0].record) + b"rubbish")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    for end in ("a.warc", "b.warc.gz"):
        own = [r for r in rows if r.file.endswith(end)]
        assert [bytes(r.payload).decode() for r in own] == [h or "" for _, _, h in PAGES]
        assert [r.hash for r in own] == [hashlib.sha256(r.record).hexdigest() for r in got]
    broken = [r for r in rows if r.file.endswith("c.warc")]
    assert [r.error is None for r in broken] == [True, False]


def test_parsing_goes_on_after_damage():
    one = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    zipped = gzip.compress(one)
    rows = list(warc.parse(one + bytes(len(one)) + one + zipped + zipped[:-3] + one))
    assert [(r["offset"], "error" in r) for r in rows] == [(0, False), (len(one), True), (2 * len(one), False), (3 * len(one), False), (3 * len(one) + len(zipped), True), (3 * len(one) + 2 * len(zipped) - 3, False)]
    assert all(r["record"] == one for r in rows if "error" not in r)
    assert list(warc.parse(b"")) == []


def test_parsing_takes_time_in_proportion():
    one = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for part in (one, gzip.compress(one)):
        began = time.time()
        assert sum(1 for _ in warc.parse(part * 100_000)) == 100_000
        assert time.time() - began < 20


def brute(one, two):
    keys = {k for k, _ in one} | {k for k, _ in two}
    a, b = ({k: sorted(h for q, h in s if q == k) for k in keys} for s in (one, two))
    return {(*k, "missing" if not b[k] else "extra" if not a[k] else "changed") for k in keys if a[k] != b[k]}


def test_audit_against_plain_comparison(spark):
    import random

    r = random.Random(3)
    one = [((f, k * 5000 + r.randrange(5000)), hashlib.sha256(f"{f}{k}".encode()).hexdigest()) for f in ("a", "b", None, "same") for k in range(700)] + [(("a", 5), "x"), (("a", 5), "y")]
    two = [x for x in one if r.random() > 0.01 or x[0][0] == "same"]
    two = [(k, h if r.random() > 0.01 or k[0] == "same" else "rot") for k, h in two] + [(("new", 1), "z"), (("a", 123456), "z")]
    frames = [spark.createDataFrame([(*k, h) for k, h in s], "file string, offset bigint, hash string") for s in (one, two)]
    got = {tuple(x) for x in warc.audit(*frames).collect()}
    assert got == brute(one, two) and len(got) > 20
    assert warc.audit(frames[0], frames[0]).count() == 0
    assert warc.audit(frames[0].limit(0), frames[0].limit(0)).count() == 0
    roots = [{x.file: x.root for x in warc.roots(f).collect()} for f in frames]
    assert roots[0]["same"] == roots[1]["same"] and roots[0]["a"] != roots[1]["a"]


def test_drill(spark):
    df = frame(spark)
    got = warc.audit_pages(df, rot=20).collect()
    assert len(got) == len(PAGES)
    want = {r.sha256: r.k for r in warc.records(df).select(F.sha2("record", 256).alias("sha256"), F.pmod(F.xxhash64("record"), F.lit(20)).alias("k")).collect()}
    for r in got:
        assert r.status == {0: "changed", 1: "missing"}.get(want[r.sha256], "ok")
    assert warc.audit_pages(df.limit(0)).count() == 0
    ends = {}
    for r in sorted(got, key=lambda r: (r.file, r.offset)):
        assert r.offset == ends.get(r.file, 0)
        ends[r.file] = r.offset + r.length
