"""Arithmetic of a text window: what is visible, where it scrolls, and the next line that matches."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

LEAST_ROWS = 6


class Scroll(NamedTuple):
    """First visible line, number of lines, and rows of the window."""

    top: int
    total: int
    rows: int

    def to(self, line: int) -> Scroll:
        return self._replace(top=max(0, min(line, self.total - self.rows)))

    def by(self, lines: int) -> Scroll:
        return self.to(self.top + lines)

    def half_page(self, down: bool = True) -> Scroll:
        step = max(1, self.rows // 2)
        return self.by(step if down else -step)

    def end(self) -> Scroll:
        return self.to(self.total)

    def visible(self) -> tuple[int, int]:
        """Half open."""
        return self.top, min(self.total, self.top + self.rows)

    def status(self) -> int:
        return self.top + 1 if self.total else 0


def search_forward(fits: Callable[[str], bool], start: int, lines: Sequence[str]) -> int | None:
    return next((k for k in range(max(0, start), len(lines)) if fits(lines[k])), None)


def search_backward(fits: Callable[[str], bool], start: int, lines: Sequence[str]) -> int | None:
    return next((k for k in range(min(start, len(lines) - 1), -1, -1) if fits(lines[k])), None)


class Viewer:
    """A window that commands move: `j` and `k` by a line, `d` and `u` by half a window, `g` and `G` to the ends, a number to that line, `/words` and `?words` to the next line forwards or backwards that has them, `n` and `N` on in the same or the other direction, `q` to leave."""

    def __init__(self, lines: Sequence[str], rows: int):
        self.lines, self.scroll, self.sought, self.back = lines, Scroll(0, len(lines), rows), "", False

    def shown(self) -> list[str]:
        first, last = self.scroll.visible()
        return [*self.lines[first:last], f"-- {self.scroll.status()} of {len(self.lines)} --"]

    def do(self, command: str) -> bool:
        """Whether the viewer goes on."""
        moves = {"j": lambda s: s.by(1), "": lambda s: s.by(1), "k": lambda s: s.by(-1), "d": Scroll.half_page, "u": lambda s: s.half_page(False), "g": lambda s: s.to(0), "G": Scroll.end}
        if command in moves:
            self.scroll = moves[command](self.scroll)
        elif command.isdecimal():
            self.scroll = self.scroll.to(int(command) - 1)
        elif command[:1] in ("/", "?") or command in ("n", "N"):
            if command not in ("n", "N"):
                self.sought, self.back = command[1:] or self.sought, command[0] == "?"
            back = self.back != (command == "N")
            fits = lambda line: self.sought in line
            hit = search_backward(fits, self.scroll.top - 1, self.lines) if back else search_forward(fits, self.scroll.top + 1, self.lines)
            if hit is not None and (not back or self.scroll.top):
                self.scroll = self.scroll.to(hit)
        return command != "q"


def height_spec(text: str) -> tuple[str, int] | None:
    """("rows", n) or ("percent", n)."""
    m = re.fullmatch(r"([0-9]+)(%?)", text)
    if not m or (m[2] and int(m[1]) > 100) or (not m[2] and not int(m[1])):
        return None
    return "percent" if m[2] else "rows", int(m[1])


def viewport_height(rows: int, spec: tuple[str, int] | None) -> int:
    wanted = rows // 2 if spec is None else spec[1] if spec[0] == "rows" else rows * spec[1] // 100
    return max(LEAST_ROWS, min(rows, wanted))
