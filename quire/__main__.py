"""Command line for single files: python -m quire text|image|form|diff|info|title|toc|trailer|object|refs|grep|view."""

from __future__ import annotations

import argparse
import os
import re
import sys
from pathlib import Path

from .operators import diff, extract, forms, images, legacy, outline, view
from .operators.interpret import Interpreter, page_items
from .operators.layout import Options, page_paragraphs
from .sources.document import Document
from .sources.syntax import PdfError, show


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quire", description="Text, structure and images of PDF files")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, files: tuple[str, ...] = ("file",)) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        for f in files:
            p.add_argument(f)
        p.add_argument("-P", "--password", default="")
        return p

    p = command("text", "text of a document or a page")
    p.add_argument("-p", "--page", type=int, default=0)
    for flag in ("geom", "tagged", "legacy", "quiet", "footnotes", "ruby"):
        p.add_argument(f"--{flag}", action="store_true")
    for name, about in (("image", "images of a page"), ("form", "forms of a page")):
        p = command(name, about)
        p.add_argument("-p", "--page", type=int, required=True)
        p.add_argument("-o", "--output", default=".")
    p.add_argument("-n", "--name")
    p = command("diff", "changed paragraphs of two files", ("file", "other"))
    for flag in ("geom", "ruby", "json"):
        p.add_argument(f"--{flag}", action="store_true")
    for name, about in (("info", "metadata"), ("title", "title"), ("toc", "outline"), ("trailer", "trailer"), ("refs", "objects of the pages")):
        command(name, about)
    command("object", "an object").add_argument("-r", "--ref", type=int, required=True)
    command("grep", "lines that match").add_argument("-g", "--grep", required=True)
    p = command("view", "a window of the text")
    p.add_argument("--height")
    p.add_argument("--line", type=int, default=1)
    p.add_argument("-i", "--interactive", action="store_true", help="go on with commands from the input, one a line: " + " ".join((view.Viewer.__doc__ or "").split()))
    return top


def opened(path: str, password: str) -> Document:
    return Document(Path(path).read_bytes(), password or None)


def run(a: argparse.Namespace) -> int:
    doc = opened(a.file, a.password)
    if a.command == "text":
        options = Options(a.footnotes, a.ruby)
        if a.page:
            if not 1 <= a.page <= len(doc.pages()):
                print(f"quire: No Page {a.page}")
            else:
                sys.stdout.write(extract.one_page(doc, a.page, options))
        elif a.legacy and not a.geom and not a.tagged:
            legacy_text(doc, a.quiet)
        else:
            print(extract.text(doc, "geom" if a.geom and not a.tagged and not a.legacy else "tagged", options))
    elif a.command == "image":
        found = images.page_images(doc, a.page)
        for x in found:
            print(written(a.output, x.name, x.data))
            if x.format == "raw":
                written(a.output, x.name.removesuffix(".raw") + ".json", x.sidecar().encode())
        if not found:
            print(f"quire: no images on page {a.page}", file=sys.stderr)
    elif a.command == "form":
        if a.name:
            print(written(a.output, f"{a.name.removeprefix('/')}.pdf", forms.form_pdf(doc, a.page, a.name)))
        else:
            print("\n".join(forms.form_names(doc, a.page)))
    elif a.command == "diff":
        options = Options(ruby=a.ruby)
        sides = [[page_paragraphs(page_items(d, r), options) for r in d.pages()] for d in (doc, opened(a.other, a.password))]
        changes = diff.document_changes(*sides)
        print(diff.to_json(changes) if a.json else "\n".join(diff.to_text(changes)))
    elif a.command == "grep":
        grep(doc, a.grep)
    elif a.command == "object":
        print(outline.object_text(doc, a.ref))
    elif a.command == "view":
        lines = extract.text(doc, "legacy").split("\n")
        rows = view.viewport_height(os.get_terminal_size().lines if sys.stdout.isatty() else 24, view.height_spec(a.height or ""))
        window = view.Viewer(lines, rows)
        window.do(str(max(1, a.line)))
        print("\n".join(window.shown() if a.interactive else window.shown()[:-1]))
        for command in sys.stdin if a.interactive else ():
            if not window.do(command.strip()):
                break
            print("\n".join(window.shown()))
    else:
        print({"info": lambda: show(doc.info()), "title": lambda: outline.title(doc), "toc": lambda: outline.outline_text(outline.outline(doc)), "trailer": lambda: show(doc.trailer), "refs": lambda: "[" + ",".join(map(str, doc.pages())) + "]"}[a.command]())
    return 0


def legacy_text(doc: Document, quiet: bool) -> None:
    """Pages as they are done, with progress on a terminal's error stream."""
    total, told = len(doc.pages()), []
    for k, ref in enumerate(doc.pages(), 1):
        if not quiet and sys.stderr.isatty():
            sys.stderr.write(f"\rquire: page {k}/{total}...")
        page = legacy.Legacy(doc)
        try:
            sys.stdout.write(page.page(ref))
            sys.stdout.flush()
        except PdfError as e:
            told.append(f"page {k}: {e}")
        told += [f"page {k}: {code} {message}" for code, message in page.warnings]
    print()
    for line in told:
        print(f"quire: {line}", file=sys.stderr)


def grep(doc: Document, pattern: str) -> None:
    """Matching lines of every page under the page's number; a page that can't be read is reported and left out."""
    interpreter, find = Interpreter(doc), re.compile(pattern)
    for k, ref in enumerate(doc.pages(), 1):
        try:
            text = extract.page_text(page_items(doc, ref, interpreter))
        except PdfError as e:
            print(f"quire: page {k}: {e}", file=sys.stderr)
            continue
        hits = [find.sub(lambda m: f"\x1b[31m{m[0]}\x1b[0m", line, count=1) for line in text.split("\n") if find.search(line)]
        if hits:
            print("\n".join([f"At page {k}...", *(f" | {h}" for h in hits)]))


def written(folder: str, name: str, data: bytes) -> str:
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / name
    path.write_bytes(data)
    return str(path)


def main(arguments: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(arguments))
    except (PdfError, OSError) as e:
        print(f"quire: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
