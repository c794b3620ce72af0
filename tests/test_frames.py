import json
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pdfs import classic, encrypted, show, simple, stream
from pyspark.sql import Window, functions as F

from quire.functions import columns as C, matrix, numbers, text as T
from quire.operators import diff, forms, images, layout, outline
from quire.operators.interpret import Glyph
from quire.plans import catalogue
from quire.sources import books, datasource, reader, sinks, udtf
from quire.sources.document import Document
from quire.sources.generate import text_pdf
from quire.sources.syntax import Name, PdfError
from quire.streaming import pages as streaming

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_paragraphs_that_feed_back(spark):
    """Each decision by a plain look at all gaps accepted before it."""
    want = set()
    users = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_id").collect():
        users.setdefault(r.user_id, []).append((r.at, r.event_id))
    for user, events in users.items():
        number, accepted, before = 1, [], None
        for at, event in sorted(events):
            if before is not None:
                gap, usual = at - before, float(np.median(accepted)) if len(accepted) > 1 else 1.2 * 3600
                if gap > 1.6 * usual:
                    number += 1
                else:
                    accepted.append(gap)
            before = at
            want.add((user, event, number))
    assert {tuple(r) for r in catalogue.QUERIES["leading_breaks_feedback"](spark, SF).collect()} == want


def test_neighbours_differ_as_by_plain_tables(spark):
    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id", "text").collect()))
    got = {}
    for r in catalogue.QUERIES["diff_lcs"](spark, SF).orderBy("doc_id", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.para_a, r.para_b))
    seen = 0
    for (s, _, before), (other, doc, text) in zip(docs, docs[1:]):
        if s == other and before is not None and text is not None:
            a, b = before.split("\n"), text.split("\n")
            changes = got.get(doc, [])
            kept = [[x for k, x in enumerate(own) if k not in {c[side] for c in changes}] for side, own in enumerate((a, b))]
            assert [" ".join(x.split()) for x in kept[0]] == [" ".join(x.split()) for x in kept[1]]
            assert len(kept[0]) == plain_lcs([" ".join(x.split()) for x in a], [" ".join(x.split()) for x in b])[-1, -1]
            seen += 1
    assert seen > 50 and set(got) <= {d for _, d, _ in docs}


def test_all_other_queries_have_sql():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"leading_breaks_feedback", "diff_lcs"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pdfs")
    (root / "a.pdf").write_bytes(text_pdf("Hello\nworld\n\nnext paragraph", "Title A"))
    (root / "b.pdf").write_bytes(classic(simple(show(b"Hello b"))))
    (root / "c.pdf").write_bytes(b"broken")
    (root / "sub").mkdir()
    (root / "sub" / "d.pdf").write_bytes(text_pdf("\n".join(f"line {k} of many words" for k in range(200)), "Long"))
    (root / "note.txt").write_bytes(b"no pdf")
    return root


def test_reader(spark, folder):
    corpus = reader.read_pdf(spark, str(folder))
    name = F.substring_index("doc_id", "/", -1).alias("name")
    assert {r.name: r.text for r in corpus.text("geom").select(name, "text").collect() if r.name != "d.pdf"} == {"a.pdf": "Hello world\n\nnext paragraph\n", "b.pdf": "Hello b\n"}
    assert {(r.name, r.page_count) for r in corpus.pages().select(name, "page_count").collect()} == {("a.pdf", 1), ("b.pdf", 1), ("d.pdf", 4)}
    assert {r.code for r in corpus.diagnostics().where("severity = 'error'").collect()} == {"NO_TRAILER"}
    with pytest.raises(Exception):
        reader.Corpus(corpus.files, mode="failfast").text().collect()
    assert corpus.where("path like '%a.pdf'").titles().first().title == "Title A"
    assert corpus.items(pages=[4]).select("page_no").distinct().count() == 1
    assert corpus.grep("wor[l]d|words").select("line", "marked").where("line like '%world%'").first().marked == "Hello \x1b[31mworld\x1b[0m"
    assert corpus.regions().where("page_no = 1").select(name).distinct().count() == 3
    assert corpus.lines().count() > 200 and corpus.objects().where("kind = 'stream'").count() == 6
    assert corpus.trailer().where("key = '/Root'").count() == 3 and corpus.xref().where("revision = 0").count() > 10
    assert corpus.legacy_pages().where("size(warnings) > 0").count() == 0
    assert corpus.struct_order().count() == 0 and corpus.images().count() == 0 and corpus.forms().count() == 0
    assert corpus.info().where("key = '/Title'").count() == 2 and corpus.outline().count() == 0
    assert corpus.object_text(1).count() == 3


def test_long_documents_in_ranges(spark, folder, monkeypatch):
    whole = sorted(map(tuple, reader.read_pdf(spark, str(folder)).lines().collect()), key=str)
    monkeypatch.setattr(reader, "LONG_BYTES", 0)
    monkeypatch.setattr(reader, "RANGE_PAGES", 1)
    files = reader.read_pdf(spark, str(folder))
    ranges = files.ranges().collect()
    assert len(ranges) == 7 and sum(not r.whole for r in ranges) == 4
    size = len((folder / "sub" / "d.pdf").read_bytes())
    assert all(len(r.content) < size for r in ranges if not r.whole)  # a range doesn't carry its file
    assert sorted(map(tuple, files.lines().collect()), key=str) == whole


def test_ranges_of_all_shapes(spark, tmp_path, monkeypatch):
    """Items and text of long files that are dealt out by pages are those of the whole files, page and object numbers included."""
    text = "\n".join(f"line {k} of a book" for k in range(70))
    for shape in books.SHAPES:
        (tmp_path / f"{shape}.pdf").write_bytes(books.book_pdf(text, shape, "Volume", shape))
    (tmp_path / "broken.pdf").write_bytes(books.book_pdf(text, "b", "Volume").replace(b"/Contents 13 0 R", b"/Contents 99 0 R"))
    corpus = reader.read_pdf(spark, str(tmp_path), "quire")
    want = [sorted(map(tuple, df.collect()), key=str) for df in (corpus.items(), corpus.text(), corpus.text("geom"), corpus.regions(pages=[2, 4]))]
    monkeypatch.setattr(reader, "LONG_BYTES", 0)
    monkeypatch.setattr(reader, "RANGE_PAGES", 2)
    assert corpus.ranges().where("not whole").count() == 14
    got = [sorted(map(tuple, df.collect()), key=str) for df in (corpus.items(), corpus.text(), corpus.text("geom"), corpus.regions(pages=[2, 4]))]
    assert got == want and len(want[1]) >= 6


def test_a_table_is_read_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = reader.from_table(sinks.with_book(docs), "doc_id", "pdf").items()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 2 and "Exchange" not in plan


def test_password(spark):
    df = spark.createDataFrame([(1, encrypted(show(b"secret"), True, b"user"))], "k int, pdf binary")
    assert reader.from_table(df, "k", "pdf", "user").text().first().text == "secret\n"
    assert reader.from_table(df, "k", "pdf").diagnostics().first().code == "WRONG_PASSWORD"


def test_diff(spark):
    a = spark.createDataFrame([("x", text_pdf("one\n\ntwo\n\nthree"))], "k string, pdf binary")
    b = spark.createDataFrame([("y", text_pdf("one\n\n2\n\nthree\n" + "\n" * 60 + "four"))], "k string, pdf binary")
    got = reader.diff(reader.from_table(a, "k", "pdf"), reader.from_table(b, "k", "pdf"), spark.createDataFrame([("x", "y")], "doc_a string, doc_b string")).orderBy("ord").collect()
    assert [(r.type, r.old, r.new) for r in got] == [("page_count", "", ""), ("text", "two", "2"), ("text", "", "four")]
    assert [r.page_b for r in got] == [None, 1, 2]


def test_data_source(spark, folder, monkeypatch):
    datasource.register(spark)
    df = spark.read.format("pdf").option("path", str(folder)).load()
    assert df.where("error is null").count() == 6
    assert {r.page_no for r in df.where("page_no = 2 or page_no = 3").collect()} == {2, 3}
    r = datasource.PdfReader({"path": str(folder)})
    rest = list(r.pushFilters([datasource.EqualTo(("page_no",), 2), datasource.EqualTo(("path",), "x")]))
    assert len(rest) == 1 and (r.first, r.last) == (2, 2)
    assert df.where("page_no = 2").count() == 1
    assert len(r.partitions()) == 1
    monkeypatch.setattr(datasource, "PART_BYTES", datasource.OPEN + 3000)
    assert [len(p.paths) for p in datasource.PdfReader({"path": str(folder)}).partitions()] == [1, 1, 1, 1] and df.where("error is null").count() == 6
    assert spark.read.format("pdf").option("path", str(folder / "b.pdf")).option("mode", "legacy").load().first().text == " \nHello b"


def test_table_functions(spark):
    udtf.register(spark)
    spark.createDataFrame([(1, text_pdf("a b\nc")), (2, b"junk")], "k int, pdf binary").createOrReplaceTempView("files")
    assert [tuple(r) for r in spark.sql("select k, p.page_no, p.text from files, lateral pdf_pages(pdf) p").collect()] == [(1, 1, "a b c\n")]
    assert spark.sql("select i.text from files, lateral pdf_items(pdf, 1) i").count() == 2
    assert spark.sql("select r.text from files, lateral pdf_regions(pdf) r").first()[0] == "a b c"
    assert spark.sql("select o.* from files, lateral pdf_raw_objects(pdf) o").count() == 7
    spark.createDataFrame([(1, books.book_pdf("locked", "t", "h", "rc4"))], "k int, pdf binary").createOrReplaceTempView("locked")
    assert "locked!" in spark.sql("select p.text from locked, lateral pdf_pages(pdf, 'quire') p").first()[0]
    assert spark.sql("select p.text from locked, lateral pdf_pages(pdf) p").count() == 0


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one\ntwo"), (2, None)], "doc_id int, text string")
    out = sinks.write_files(sinks.with_pdf(docs).withColumn("name", F.format_string("%d.pdf", "doc_id")), str(tmp_path), "name", "pdf")
    assert out.count() == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.pdf", "2.pdf"]
    assert len(Document((tmp_path / "2.pdf").read_bytes()).pages()) == 1


def test_files_of_several_documents_stay_apart(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "page1-001.png", bytearray(b"one")), ("c", "page1-001.png", bytearray(b"two"))], "doc_id string, file string, bytes binary")
    for _ in range(2):  # a task that runs again finds its own files
        assert sinks.write_files(rows, str(tmp_path / "apart"), "file", "bytes", "doc_id").count() == 2
    assert {p.parent.name: p.read_bytes() for p in (tmp_path / "apart").rglob("*.png")} == {"a%2Fb": b"one", "c": b"two"}
    with pytest.raises(Exception, match="another content"):
        sinks.write_files(rows.coalesce(1), str(tmp_path / "together"), "file", "bytes").collect()


def test_stream(spark, folder, tmp_path):
    seen = []
    streaming.for_each_page(streaming.stream_pages(streaming.stream_files(spark, str(folder))), lambda *r: seen.append(r), str(tmp_path)).awaitTermination()
    assert {d.rsplit("/", 1)[1] for d, _, _ in seen} == {"a.pdf", "b.pdf"}
    batch = reader.read_pdf(spark, str(folder / "a.pdf")).text("legacy").first().text
    assert "".join(t for d, _, t in seen if d.endswith("a.pdf")) == batch


def test_documents_that_arrive_in_several_files(spark, tmp_path):
    docs = spark.range(20).selectExpr("id as doc_id", "concat('one two ', id) as text")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    pages = streaming.pages_of_batches(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted(r.text.split() for r in pages.collect()) == sorted(["one", "two", str(k)] for k in range(20))


def test_streamed_pages_make_the_document(spark, folder):
    corpus = reader.read_pdf(spark, str(folder))
    joined = {r.doc_id: r.text for r in streaming.document_text(corpus.legacy_pages()).collect()}
    assert joined == {r.doc_id: r.text for r in corpus.text("legacy").collect()}


# Functions and their column twins

SAMPLES = ["", " ", "a. x", "12. code", "123. x", "b .y", "Sample Book 12", "xiv", "page IV of 7", "- 3 -", "end。」", "end.", "why?\"", "日本", "カタカナ kana", "한글", "Hello, World", "ivxlcdmivx", "#", "3/4", " \t x  y\r\n", "第\u30003\u3000章", "\u00a0a\u3000b\u2003", "\u3000a. x", "\x1c1 .", "終。\u3000", "\u303f\u4dc0\ufe50\u1100\ua000\U00020000\U0001f600", "\u2028"]


def test_column_twins(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(SAMPLES)], "k int, s string")
    s = F.col("s")
    got = df.select("s", C.normal_header(s), C.header_core(s), C.page_number_only(C.normal_header(s)), C.list_marker(s), C.numbered_code(s), C.ends_sentence(s), C.normal_paragraph(s), C.display_width(s), C.script_kinds(s), C.has_cjk(s), C.latin_share(s)).collect()
    for r in got:
        t = r[0]
        shown = [c for c in t if not c.isspace()]
        normal = T.normal_header(t)
        assert tuple(r[1:]) == (normal, T.header_core(normal), T.page_number_only(normal), T.list_marker(t), T.numbered_code(t), T.ends_sentence(t), diff.normal(t), T.display_width(t), len({T.script(c) for c in t} - {None}), any(map(T.is_cjk, t)), pytest.approx(sum(map(T.is_latin, shown)) / len(shown) if shown else 0.0)), t


def test_number_and_space_twins(spark):
    texts = [".5", "-.5", "5.", "-.23999999", "1.5", "-1.5", "x1", "", "--1", "7"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(C.parse_number(F.col("s"))).collect()] == [numbers.parse_number(t) for t in texts]
    cases = [(g, 10.0, a, b) for g in (-1.0, 2.4, 2.5, 3.1, 19.0, 21.0) for a in ("a", "日", "1", "-", "") for b in ("b", "本", "2", "-", "")]
    df = spark.createDataFrame(cases, "g double, z double, a string, b string")
    got = [r[0] for r in df.select(C.segment_space(F.col("g"), F.col("z"), F.col("a"), F.col("b"))).collect()]
    assert got == [T.segment_space(*c) for c in cases]


def test_matrix_twins(spark):
    r = random.Random(1)
    m, n = (tuple(r.uniform(-3, 3) for _ in range(6)) for _ in range(2))
    row = spark.range(1).select(C.multiply(C.matrix(*m), C.matrix(*n)).alias("m"), C.apply(C.matrix(*m), F.lit(2.0), F.lit(3.0)).alias("p"), C.device_size(C.matrix(*m)).alias("s")).first()
    assert np.allclose(tuple(row.m), matrix.multiply(m, n)) and np.allclose(tuple(row.p), matrix.apply(m, 2, 3)) and np.isclose(row.s, matrix.device_size(m))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-9, 9), min_size=18, max_size=18))
def test_matrix_laws(v):
    a, b, c = tuple(v[:6]), tuple(v[6:12]), tuple(v[12:])
    assert matrix.multiply(a, matrix.IDENTITY) == a == matrix.multiply(matrix.IDENTITY, a)
    assert np.allclose(matrix.multiply(matrix.multiply(a, b), c), matrix.multiply(a, matrix.multiply(b, c)))
    assert np.allclose(matrix.apply(b, *matrix.apply(a, 1, 2)), matrix.apply(matrix.multiply(a, b), 1, 2))


def test_code_splitting():
    assert numbers.utf16_codes(bytes.fromhex("65e5d83dde0041")) == [0x65E5, 0x1F600]
    assert numbers.sjis_codes("日A".encode("cp932")) == [0x93FA, 0x41] and numbers.hex_bytes("4a5") == [0x4A, 0x50]
    assert T.clip("日本語abc", 5) == "日本" and T.pad_to("日", 4) == "日  "


# Layout


def glyph(x, y, text, width=20.0, size=10.0, wmode=0):
    return Glyph(text, x, y, width, size, "/F1", wmode)


def test_layout_rules():
    page = lambda *g: layout.page_paragraphs(list(g))
    assert page(glyph(72, 700, "a"), glyph(72, 686, "b")) == ["a b"]
    assert page(glyph(72, 700, "a"), glyph(72, 650, "b")) == ["a", "b"]
    assert page(glyph(72, 700, "a"), glyph(92, 686, "b")) == ["a", "b"]
    assert page(glyph(72, 700, "日"), glyph(72, 660, "本")) == ["日本"]
    assert page(glyph(72, 700, "x"), glyph(72, 686, "a. first"), glyph(72, 672, "b. second")) == ["x", "a. first", "b. second"]
    assert layout.join_lines(layout.build_lines([glyph(72, 700, "1. code", size=7), glyph(82, 690, "2. more", size=7)])) == "1. code\n  2. more"
    assert page(*[glyph(72, 700 - 14 * k, f"w{k}") for k in range(5)], glyph(72, -167, "off")) == ["w0 w1 w2 w3 w4"]
    assert page(glyph(72, 700, "bad", size=0)) == ["bad"]
    assert page() == []
    assert layout.page_text([]) == "\n"
    vertical = [glyph(300, 700, "縦", wmode=1), glyph(280, 700, "書", wmode=1)]
    assert page(*vertical) == ["縦書"]


def test_super_and_subscripts():
    lines = layout.build_lines([glyph(72, 700, "x", 10), glyph(82, 703.5, "2", 4, 7), glyph(86, 703.5, "3", 4, 7), glyph(90, 700, "y", 10)])
    assert len(lines) == 1 and lines[0].markers == [(1, "23")] and lines[0].size == 10
    lead = layout.build_lines([glyph(72, 703.5, "1", 4, 7), glyph(76, 700, "note", 20)])
    assert lead[0].markers == [(0, "1")] and lead[0].baseline == 700


def test_ruby_bar():
    assert layout.ruby_text("漢字", "かんじ") == "漢字《かんじ》" and layout.ruby_text("漢a", "x") == "漢a｜《x》"


# Differences, images, outlines, forms


def plain_lcs(a, b):
    out = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            out[i + 1, j + 1] = out[i, j] + 1 if a[i] == b[j] else max(out[i, j + 1], out[i + 1, j])
    return out


def plain_changes(a, b):
    """The walk back over a whole table; neighbours of an insertion and a removal are put together."""
    table, i, j, steps = plain_lcs(a, b), len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or table[i - 1, j] <= table[i, j - 1]):
            j -= 1
            steps.append((None, j))
        else:
            i -= 1
            steps.append((i, None))
    out = []
    while steps:
        one = steps.pop(0)
        if steps and (one[0] is None) != (steps[0][0] is None):
            two = steps.pop(0)
            one = (two[0] if one[0] is None else one[0], two[1] if one[1] is None else one[1])
        out.append(one)
    return [diff.Change("text", para_a=x, para_b=y, old="" if x is None else a[x], new="" if y is None else b[y]) for x, y in out]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_lengths(a, b):
    assert (np.stack(list(diff.length_rows(a, b))) == plain_lcs(a, b)).all()
    changes = diff.paragraph_changes(a, b)
    assert changes == plain_changes(a, b)
    kept_a = [x for k, x in enumerate(a) if k not in {c.para_a for c in changes}]
    kept_b = [x for k, x in enumerate(b) if k not in {c.para_b for c in changes}]
    assert kept_a == kept_b and len(kept_a) == plain_lcs(a, b)[-1, -1]


def test_change_order_and_rendering():
    got = diff.paragraph_changes(["x1", "x2"], ["y1", "y2"])
    assert [(c.old, c.new) for c in got] == [("", "y2"), ("x2", "y1"), ("x1", "")]
    assert diff.paragraph_changes(["a  b"], ["a b"]) == []
    two = [["x1", "same", "x2"]], [["y1", "same", "y2"]]
    assert [c.old for c in diff.document_changes(*two)] == ["x2", "x1"] and [c.old for c in diff.document_changes(*two, ascending=True)] == ["x1", "x2"]
    every = diff.document_changes([["a"], ["gone"]], [["b"]])
    assert json.loads(diff.to_json(every))[0] == {"type": "pageCountMismatch", "pagesA": 2, "pagesB": 1}
    assert diff.to_text(every)[1:] == ["page 1:\npara 1:\n- old: a\n+ new: b\n", "page 2 (only in first file):\npara 1:\n- old: gone\n+ new: \n"]


def test_images():
    info = {"/Width": 2.0, "/Height": 2.0, "/BitsPerComponent": 8.0, "/ColorSpace": Name("/DeviceRGB")}
    kind, data = images.classify(info, bytes(12))
    assert kind == "png" and data[:8] == b"\x89PNG\r\n\x1a\n"
    assert images.classify(info, bytes(11))[0] == "raw" and images.classify({}, b"\xff\xd8\xff")[0] == "jpeg"
    with pytest.raises(PdfError):
        images.classify({}, b"")
    own = simple(b"q 30 0 0 30 50 50 cm /Im Do Q", o6=stream(bytes(12), b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceCMYK "))
    own[3] = own[3].replace(b"/Font", b"/XObject << /Im 6 0 R >> /Font")
    image = images.page_images(Document(classic(own)), 1)[0]
    assert (image.name, image.x0, image.x1, json.loads(image.sidecar())["length"]) == ("page1-001.raw", 50, 80, 12)


def test_outline():
    own = simple(show(b"x"), o6=b"<< /First 7 0 R >>", o7=b"<< /Title (A) /Dest [3 0 R /Fit] /Next 9 0 R /First 8 0 R >>", o8=b"<< /Title <FEFF00e9> /A << /S /GoTo /D (name) >> >>", o9=b"<< /Title (B) /Next 7 0 R >>", o10=b"<< /Kids [11 0 R 12 0 R] >>", o11=b"<< /Limits [(a) (b)] /Names [(a) [4 0 R]] >>", o12=b"<< /Limits [(m) (p)] /Names [(name) << /D [3 0 R /Fit] >>] >>")
    own[1] = b"<< /Type /Catalog /Pages 2 0 R /Outlines 6 0 R /Names << /Dests 10 0 R >> >>"
    entries = outline.outline(Document(classic(own)))
    assert [tuple(e) for e in entries] == [(0, "A", 3), (1, "é", 3), (0, "B", 0)]
    assert outline.outline_text(entries) == "A\n é\nB" and outline.title(Document(classic(own))) == outline.NO_TITLE


def test_form_export():
    own = simple(b"/Fm0 Do", o6=stream(b"/Fm1 Do BT /F1 9 Tf (in) Tj ET", b"/Subtype /Form /BBox [0 0 100 50] /Resources << /XObject << /Fm1 7 0 R >> /Font << /F1 5 0 R >> >> "), o7=stream(b"0 0 1 1 re f", b"/Subtype /Form /BBox [0 0 20 20] "))
    own[3] = own[3].replace(b"/Font", b"/XObject << /Fm0 6 0 R >> /Font")
    doc = Document(classic(own))
    assert forms.form_names(doc, 1) == ["Fm0"] and forms.closure(doc, 6) == [6, 5, 7]
    copy = Document(forms.form_pdf(doc, 1, "Fm0"))
    assert not copy.scanned and len(copy.pages()) == 1 and forms.form_names(copy, 1) == ["Fm0"]
    from quire.operators.extract import text

    assert text(copy) == "in\n"


def test_pushed_filter_and_pruned_columns(spark):
    plan = reader.read_pdf(spark, SF).where("length > 1000").titles()._jdf.queryExecution().toString()
    assert "GreaterThan(length,1000)" in plan
    plan = catalogue.QUERIES["grep_lines"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search(r"ReadSchema:.*lang", plan)


def test_running_offsets_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "RANGE_KEYS", 16)
    df = spark.createDataFrame([(k, k % 7) for k in range(500)], "k int, n int").repartition(8)
    got = {r.k: r.offset for r in catalogue.running_offsets(df, "k", "n").collect()}
    assert all(got[k] == sum(j % 7 for j in range(k)) for k in range(500))


def test_numbers_in_groups(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "RANGE_KEYS", 16)
    df = spark.createDataFrame([(("a", "b", None)[k % 3], k * 5) for k in range(300)], "g string, k int").repartition(8)
    rows = catalogue.numbered(df, "g", "k", "n").collect()
    for g in ("a", "b", None):
        assert [r.n for r in sorted((r for r in rows if r.g == g), key=lambda r: r.k)] == list(range(1, 101))


def test_line_band_twin(spark):
    df = spark.createDataFrame([(1, 50.0), (1, 700.0), (1, 750.0), (1, 400.0), (2, 5.0)], "p int, y double")
    got = {(r.p, r.y): r.b for r in df.select("p", "y", C.line_band(F.col("y"), Window.partitionBy("p")).alias("b")).collect()}
    assert got == {(1, 50.0): "bottom", (1, 700.0): "top", (1, 750.0): "top", (1, 400.0): "middle", (2, 5.0): "middle"}
