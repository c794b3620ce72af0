"""Paragraph differences of two documents by longest common subsequences."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Change(NamedTuple):
    """type: page_count or text. Paragraph numbers start at 0; what is absent is null."""

    type: str
    page_a: int | None = None
    page_b: int | None = None
    para_a: int | None = None
    para_b: int | None = None
    old: str = ""
    new: str = ""
    pages_a: int | None = None
    pages_b: int | None = None


def normal(text: str) -> str:
    return " ".join(text.split())


def length_rows(a: list[str], b: list[str]) -> Iterator[np.ndarray]:
    """Lengths of the longest common subsequences of each prefix of `a`, the empty one first, with every prefix of `b`. Rows are running maxima, so each is a few numpy steps."""
    codes = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    right = np.array([codes[t] for t in b], np.int64)
    row = np.zeros(len(b) + 1, np.int32)
    yield row
    for t in a:
        grown = np.where(right == codes[t], row[:-1] + 1, row[1:])
        row = np.r_[np.int32(0), np.maximum.accumulate(grown) if len(b) else grown]
        yield row


def insertions(a: list[str], b: list[str]) -> list[np.ndarray]:
    """A bit for each pair of prefixes (i and j over 0) whose last elements differ: whether the walk back takes b's last one for an insertion. Eight pairs take a byte."""
    out, before = [], None
    for row in length_rows(a, b):
        if before is not None:
            out.append(np.packbits(before[1:] <= row[:-1]))
        before = row
    return out


def paragraph_changes(a: list[str], b: list[str]) -> list[Change]:
    """Changes from the last paragraph to the first; neighbours of an insertion and a removal are one replacement."""
    left, right = list(map(normal, a)), list(map(normal, b))
    i, j = len(a), len(b)
    while i and j and left[i - 1] == right[j - 1]:  # a common end needs no table
        i, j = i - 1, j - 1
    inserted = insertions(left[:i], right[:j])
    steps: list[Change] = []
    while i or j:
        if i and j and left[i - 1] == right[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or inserted[i - 1][(j - 1) >> 3] >> (7 - (j - 1) % 8) & 1):
            j -= 1
            steps.append(Change("text", para_b=j, new=b[j]))
        else:
            i -= 1
            steps.append(Change("text", para_a=i, old=a[i]))
    out: list[Change] = []
    k = 0
    while k < len(steps):
        pair = steps[k : k + 2]
        if len(pair) == 2 and (pair[0].para_a is None) != (pair[1].para_a is None):
            gone, come = sorted(pair, key=lambda c: c.para_a is None)
            out.append(Change("text", para_a=gone.para_a, para_b=come.para_b, old=gone.old, new=come.new))
            k += 2
        else:
            out.append(pair[0])
            k += 1
    return out


def page_changes(page: int, a: list[str], b: list[str]) -> list[Change]:
    return [c._replace(page_a=page, page_b=page) for c in paragraph_changes(a, b)]


def document_changes(a: list[list[str]], b: list[list[str]], ascending: bool = False) -> list[Change]:
    """Changes of two documents given as paragraphs of pages: the page counts, common pages, then pages of one only. Within a page they run from the last paragraph to the first, or the other way if `ascending`."""
    both = min(len(a), len(b))
    out = [Change("page_count", pages_a=len(a), pages_b=len(b))] if len(a) != len(b) else []
    out += [c for k in range(both) for c in page_changes(k + 1, a[k], b[k])[:: -1 if ascending else 1]]
    out += [Change("text", page_a=k + 1, para_a=n, old=t) for k in range(both, len(a)) for n, t in enumerate(a[k])]
    return out + [Change("text", page_b=k + 1, para_b=n, new=t) for k in range(both, len(b)) for n, t in enumerate(b[k])]


def to_json(changes: list[Change]) -> str:
    rows = []
    for c in changes:
        if c.type == "page_count":
            rows.append({"type": "pageCountMismatch", "pagesA": c.pages_a, "pagesB": c.pages_b})
        else:
            numbers = {"pageA": c.page_a, "pageB": c.page_b, "paraA": c.para_a, "paraB": c.para_b}
            rows.append({"type": "textChange", **{k: v for k, v in numbers.items() if v is not None}, "old": c.old, "new": c.new})
    return json.dumps(rows, ensure_ascii=False, separators=(",", ":"))


def _pair(word: str, a: int | None, b: int | None, plus: int, only: bool) -> str:
    if a is not None and b is not None:
        return f"{word} {a + plus}:" if a == b else f"{word} {a + plus} vs {b + plus}:"
    if a is None and b is None:
        return f"{word} ?:"
    side = " (only in first file)" if b is None else " (only in second file)"
    return f"{word} {(b if a is None else a) + plus}{side if only else ''}:"


def to_text(changes: list[Change]) -> list[str]:
    out = []
    for c in changes:
        if c.type == "page_count":
            out.append(f"page count mismatch: {c.pages_a} vs {c.pages_b}")
        else:
            out.append("\n".join((_pair("page", c.page_a, c.page_b, 0, True), _pair("para", c.para_a, c.para_b, 1, False), f"- old: {c.old}", f"+ new: {c.new}")) + "\n")
    return out
