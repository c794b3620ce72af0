import json

from pdfs import classic, show, simple, stream

from quire.__main__ import main
from quire.operators import legacy, view
from quire.sources.generate import text_pdf


def test_commands(tmp_path, capsys):
    a, b = tmp_path / "a.pdf", tmp_path / "b.pdf"
    a.write_bytes(text_pdf("Hello\n\nworld", "A title"))
    b.write_bytes(text_pdf("Hello\n\nthere"))

    def out(*arguments):
        code = main(list(map(str, arguments)))
        return code, capsys.readouterr().out

    assert out("text", a) == (0, "Hello\n\nworld\n\n")
    assert out("text", "-p", 1, a) == (0, "Hello\n\nworld\n") and out("text", "-p", 9, a) == (0, "quire: No Page 9\n")
    assert out("text", "--legacy", a) == (0, " \nHello\nworld\n")
    assert out("title", a) == (0, "A title\n") and out("refs", a) == (0, "[10]\n")
    assert out("grep", "-g", "w.r", a) == (0, "At page 1...\n | \x1b[31mwor\x1b[0mld\n")
    assert json.loads(out("diff", "--json", a, b)[1])[0]["new"] == "there"
    assert "- old: world" in out("diff", a, b)[1] and "/Title" in out("info", a)[1] and "/Root" in out("trailer", a)[1]
    assert out("object", "-r", 2, a)[1].startswith("<< /Count 1") and out("view", "--height", "6", a)[1].startswith(" \nHello")
    assert out("text", tmp_path / "none.pdf")[0] == 1
    own = simple(show(b"x") + b" /Im Do", o6=stream(bytes(4), b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray "), o7=stream(b"", b"/Subtype /Form /BBox [0 0 1 1] "))
    own[3] = own[3].replace(b"/Font", b"/XObject << /Im 6 0 R /Fm 7 0 R >> /Font")
    a.write_bytes(classic(own))
    assert out("image", "-p", 1, "-o", tmp_path / "o", a)[1].strip().endswith("page1-001.png") and (tmp_path / "o" / "page1-001.png").exists()
    assert out("form", "-p", 1, a)[1] == "Fm\n" and out("form", "-p", 1, "-n", "Fm", "-o", tmp_path, a)[1].strip().endswith("Fm.pdf")


def test_window():
    s = view.Scroll(0, 100, 20)
    assert s.by(5).visible() == (5, 25) and s.end().top == 80 and s.half_page().top == 10 and s.by(-3).top == 0 and s.status() == 1
    assert view.Scroll(0, 5, 20).end().visible() == (0, 5)
    lines = ["a", "b", "a"]
    assert view.search_forward("a".__eq__, 1, lines) == 2 and view.search_backward("a".__eq__, 1, lines) == 0 and view.search_forward("x".__eq__, 0, lines) is None
    assert [view.height_spec(x) for x in ("10", "50%", "0", "101%", "x", "")] == [("rows", 10), ("percent", 50), None, None, None, None]
    assert [view.viewport_height(40, s) for s in (None, ("rows", 3), ("percent", 100))] == [20, 6, 40]


def test_viewer():
    v = view.Viewer([f"line {k}" for k in range(1, 31)], 6)
    steps = {"j": 2, "": 3, "k": 2, "d": 5, "u": 2, "G": 25, "g": 1, "12": 12, "/line 2": 20, "n": 21, "N": 20, "?line 1": 19, "/nowhere": 19}
    for command, first in steps.items():
        assert v.do(command) and v.shown()[0] == f"line {first}" and v.shown()[-1] == f"-- {first} of 30 --", command
    assert not v.do("q")


def test_view_takes_commands(tmp_path, capsys, monkeypatch):
    path = tmp_path / "a.pdf"
    path.write_bytes(text_pdf("\n".join(f"row {k}" for k in range(1, 40))))
    monkeypatch.setattr("sys.stdin", ["/row 20\n", "q\n", "j\n"])
    assert main(["view", "--height", "6", "-i", str(path)]) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[6] == "-- 1 of 40 --" and out[7] == "row 20" and len(out) == 14


def test_color_spaces():
    assert legacy.color_spaces(b"/Cs1 cs 0 0 1 rg 0.5 G /P CS 1 0 0 0 k") == ["Cs1", "DeviceRGB", "DeviceGray", "P", "DeviceCMYK"]
