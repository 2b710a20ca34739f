"""Scanned tables set right by the tables that a page's geometry shows.

A row is one block of one page, with the page's detected tables, words and drawn
rectangles nested in it, so that pages are independent rows of an Arrow batch and
nothing is shuffled for the matching, which takes tables in order.  Tables within
tables are not looked for.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from html.parser import HTMLParser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.tables import ATTACH, EDGE, FIT, GAP, MATCH, ROW_RATIO, SEPARATOR

#: Height of a page's header, overlap of the halves, needle lengths, and allowances in points.
HEADER, FOLD, NEEDLE, CUT_NEEDLE, LEAST_CELL = 60.0, 5.0, 40, 35, 3
ROW_HEIGHT, SPARE_ROWS, MOST_ROW, HIT, SPARE_WIDTH, NEAR_LINE, FAR_LINE = 20.0, 5, 60.0, 2.0, 50.0, 20.0, 15.0
TABLE = re.compile(r"<table\b.*?</table>", re.S | re.I)
HEAD = re.compile(r"<thead\b.*?</thead>", re.S | re.I)
_WORD = re.compile(r"[\w.,]+")

GEOMETRY = (
    "width double, height double, tables array<struct<x0:double,y0:double,x1:double,y1:double,cells:array<array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>>>>, "
    "words array<struct<x0:double,y0:double,x1:double,y1:double,word:string>>, drawings array<struct<x0:double,y0:double,x1:double,y1:double>>"
)


class Box(NamedTuple):
    """A rectangle."""

    x0: float
    y0: float
    x1: float
    y1: float

    def meets(self, other: Box) -> bool:
        """Whether two rectangles overlap in an area."""
        return self.x0 < other.x1 and other.x0 < self.x1 and self.y0 < other.y1 and other.y0 < self.y1


def around(boxes: list[Box]) -> Box:
    """The smallest box around some."""
    xs0, ys0, xs1, ys1 = zip(*boxes)
    return Box(min(xs0), min(ys0), max(xs1), max(ys1))


def words_of(text: str) -> frozenset[str]:
    """The distinct lower-case tokens of two characters or more."""
    return frozenset(w.lower() for w in _WORD.findall(text) if len(w) > 1)


@dataclass(frozen=True, eq=False)
class Detected:
    """A table that the geometry shows: cells by row, with a null box where another cell covers the place."""

    box: Box
    cells: list[list[tuple[Box | None, str]]]

    @cached_property
    def text(self) -> str:
        """All cell texts."""
        return " ".join(t for row in self.cells for _, t in row if t)

    @cached_property
    def tokens(self) -> frozenset[str]:
        """The tokens of all cells."""
        return words_of(self.text)

    @property
    def rows(self) -> int:
        """How many rows there are."""
        return len(self.cells)

    @cached_property
    def cols(self) -> int:
        """How many columns there are."""
        return max(map(len, self.cells), default=0)

    def lies_with(self, other: Detected) -> bool:
        """Whether both have the same left and right edges."""
        return abs(self.box.x0 - other.box.x0) <= EDGE and abs(self.box.x1 - other.box.x1) <= EDGE

    def placed(self) -> list[list[tuple[int, int, str]]]:
        """By row, (rowspan, colspan, text) of the cells that are not covered."""
        extent = [[row[c][0] for row in self.cells if c < len(row) and row[c][0]] for c in range(self.cols)]
        bottom = [max((b.y1 for b, _ in row if b), default=None) for row in self.cells]
        empty = lambda r, c: c >= len(self.cells[r]) or self.cells[r][c][0] is None
        taken: set[tuple[int, int]] = set()
        out = []
        for r, row in enumerate(self.cells):
            own = []
            for c, (box, text) in enumerate(row):
                if box is None or (r, c) in taken:
                    continue
                wide = high = 1
                while c + wide < self.cols and empty(r, c + wide) and any(b.x0 >= box.x0 - FIT and b.x1 <= box.x1 + FIT for b in extent[c + wide]):
                    wide += 1
                while r + high < self.rows and empty(r + high, c) and bottom[r + high] is not None and bottom[r + high] <= box.y1 + FIT:
                    high += 1
                taken |= {(r + i, c + j) for i in range(high) for j in range(wide)}
                own.append((high, wide, (text or "").strip().replace("\n", " ")))
            out.append(own)
        return out


class _Rows(HTMLParser):
    """Rows of (rowspan, colspan, text) of a table's cells, and how many of them are in its head."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.head, self._in_head, self._open = 0, False, False
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "thead":
            self._in_head = True
        elif tag == "tr":
            self.rows.append([])
            self.head += self._in_head
        elif tag in ("td", "th") and self.rows:
            own = dict(attrs)
            span = lambda name: int(v) if (v := (own.get(name) or "1").strip()).isdecimal() and int(v) else 1
            self.rows[-1].append((span("rowspan"), span("colspan"), []))
            self._open = True

    def handle_endtag(self, tag):
        if tag == "thead":
            self._in_head = False
        elif tag in ("td", "th"):
            self._open = False

    def handle_data(self, data):
        if self._open:
            self.rows[-1][-1][2].append(data)


@dataclass(frozen=True, eq=False)
class Scanned:
    """A table of a scanned page's text: its place in the text, its cells and how many rows its head has."""

    span: tuple[int, int]
    cells: list[list[tuple[int, int, str]]]
    head: int

    @classmethod
    def of(cls, found: re.Match) -> Scanned:
        """A table from its HTML within a text."""
        own = _Rows(found[0])
        return cls(found.span(), [[(h, w, " ".join("".join(t).split())) for h, w, t in row] for row in own.rows], own.head)

    @property
    def rows(self) -> list[list[str]]:
        """The texts of the cells."""
        return [[t for _, _, t in row] for row in self.cells]

    def flat(self, text: str) -> str:
        """The table's HTML with a head of several rows made one."""
        if self.head < 2:
            return text
        return HEAD.sub(lambda _: "<thead><tr>" + "".join(f"<th>{html.escape(n, quote=False)}</th>" for n in names(self.cells[: self.head])) + "</tr></thead>", text, count=1)

    @cached_property
    def tokens(self) -> frozenset[str]:
        """The tokens of all cells."""
        return words_of(" ".join(t for row in self.rows for t in row))


@dataclass(frozen=True)
class Page:
    """The geometry of a page, seen through the half that a block stands for."""

    scope: Box
    width: float
    tables: list[Detected]
    words: list[tuple[Box, str]]
    drawings: list[Box]

    @classmethod
    def of(cls, row, location: str | None) -> Page:
        """A page from a row of GEOMETRY, for the left or right half or all of it."""
        w, h = float(row.width), float(row.height)
        half = {"left": (0.0, w / 2 + FOLD), "right": (w / 2 - FOLD, w)}.get(location or "all", (0.0, w))
        scope = Box(half[0], 0.0, half[1], h)
        box = lambda x: None if x is None or x["x0"] is None else Box(x["x0"], x["y0"], x["x1"], x["y1"])
        tables = [Detected(box(t), [[(box(c), (c["text"] if c is not None else None) or "") for c in r] for r in t["cells"]]) for t in _list(row.tables)]
        return cls(scope, w, [t for t in tables if t.box.meets(scope)], [(box(x), x["word"]) for x in _list(row.words)], [box(x) for x in _list(row.drawings)])

    def find(self, needles: list[str]) -> list[Box]:
        """Where texts stand on the page below its header, in any case; long ones by their beginning."""
        found = []
        for needle in needles:
            sought = (needle if len(needle) <= NEEDLE else needle[:CUT_NEEDLE]).lower()
            for line in self._lines:
                text = " ".join(w.lower() for _, w in line)
                at = text.find(sought)
                while at >= 0:
                    end, pos, hit = at + len(sought), 0, []
                    for box, w in line:
                        if pos < end and pos + len(w) > at:
                            hit.append(box)
                        pos += len(w) + 1
                    found.append(around(hit))
                    at = text.find(sought, end)
        return found

    @property
    def _lines(self) -> list[list[tuple[Box, str]]]:
        below = Box(self.scope.x0, HEADER, self.scope.x1, self.scope.y1)
        lines: list[list[tuple[Box, str]]] = []
        for box, w in sorted(((b, w) for b, w in self.words if b.meets(below)), key=lambda x: (round(x[0].y0), x[0].x0)):
            if not lines or abs(lines[-1][-1][0].y0 - box.y0) > HIT:
                lines.append([])
            lines[-1].append((box, w))
        return lines


def _list(value) -> list:
    return [] if value is None else list(value)


def matched(page: Page, scanned: list[Scanned]) -> list[list[tuple[float, Detected]]]:
    """The detected tables of each scanned one, with shares of their tokens: best matches, then what goes on beside."""
    groups: list[list[tuple[float, Detected]]] = [[] for _ in scanned]
    share = lambda t, g: len(t.tokens & scanned[g].tokens) / len(t.tokens)
    free = []
    for t in page.tables:
        best = max(range(len(scanned)), key=lambda g: (share(t, g), -g), default=None) if t.tokens else None
        if best is not None and share(t, best) >= MATCH:
            groups[best].append((share(t, best), t))
        elif t.tokens:
            free.append(t)
    for g, group in enumerate(groups):
        if not group:
            continue
        anchor = max(group, key=lambda x: x[0])[1]
        beside = lambda t: min(abs(t.box.y0 - anchor.box.y1), abs(anchor.box.y0 - t.box.y1)) <= GAP  # noqa: B023, E731
        more = [t for t in free if share(t, g) >= ATTACH and t.lies_with(anchor) and beside(t) and t.cols == anchor.cols]
        group += [(share(t, g), t) for t in more]
        free = [t for t in free if t not in more]
    return groups


def run_of(page: Page, table: Scanned, group: list[tuple[float, Detected]]) -> list[Detected]:
    """The detected tables, from the top, that together are a scanned one; none if their rows do not fit."""
    if len(group) > 1:
        anchor = max(group, key=lambda x: x[0])[1]
        parts = sorted((t for _, t in group if t.lies_with(anchor)), key=lambda t: t.box.y0)
        if any(b.box.y0 - a.box.y1 > GAP or a.cols != b.cols for a, b in zip(parts, parts[1:])):
            parts = [anchor]
    elif group:
        parts = [group[0][1]]
    else:
        box = locate(page, table)
        inside = [t for t in page.tables if box and t.box.meets(box)]
        parts = [max(inside, key=lambda t: t.rows * t.cols)] if inside else []
    rows = sum(t.rows for t in parts)
    return parts if parts and ROW_RATIO[0] <= rows / len(table.rows) <= ROW_RATIO[1] else []


def locate(page: Page, table: Scanned) -> Box | None:
    """Where a scanned table stands: a chain of its first, middle and last rows, else detected tables with their texts.

    Middle rows are those at a quarter, half and three quarters.  A chain goes down the
    page, its width and height are bounded, and every middle row that is found at all is
    in it; most middle rows and then the height closest to that of so many rows win.
    Drawn rectangles beside the chain then give the edges.
    """
    named = [[t for t in row if len(t) >= LEAST_CELL] for row in table.rows]
    first, last = named[0] if named else [], next((r for r in reversed(named) if r), [])
    if not first or not last:
        return None
    n, w, scope = len(named), page.width, Box(page.scope.x0, HEADER, page.scope.x1, page.scope.y1)
    middle = [hits for k in sorted({n // 4, n // 2, 3 * n // 4}) if 0 < k < n - 1 and (hits := page.find(named[k]))]
    best: tuple[float, list[Box]] | None = None
    tops = page.find(first)
    for foot in page.find(last):
        for top in tops:
            if top.y1 >= foot.y0 or foot.y1 - top.y0 > (n + SPARE_ROWS) * MOST_ROW:
                continue
            chain = [top]
            for hits in middle:
                fits = [m for m in hits if m.y0 >= chain[-1].y0 - HIT and m.y1 <= foot.y1 + HIT and abs(m.x0 - top.x0) < w / 2]
                if not fits:
                    break
                chain.append(min(fits, key=lambda m: m.y0))
            whole = around([*chain, foot])
            if len(chain) <= len(middle) or whole.x1 - whole.x0 > w / 2 + SPARE_WIDTH:
                continue
            score = 1000 * len(middle) - abs(foot.y1 - top.y0 - n * ROW_HEIGHT)
            if best is None or score > best[0]:
                best = score, whole
    if best:
        return _snapped(page, scope, best[1])
    return _by_texts(page, scope, first, last)


def _snapped(page: Page, scope: Box, text: Box) -> Box:
    lines = [d for d in page.drawings if d.meets(scope) and d.y1 >= text.y0 - FAR_LINE and d.y0 <= text.y1 + FAR_LINE and min(abs(d.x0 - text.x0), abs(d.x1 - text.x1)) < page.width / 2]
    if lines:
        tops, ends = [d.y0 for d in lines if abs(d.y0 - text.y0) <= NEAR_LINE], [d.y1 for d in lines if abs(d.y1 - text.y1) <= NEAR_LINE]
        edges = around(lines)
        found = Box(edges.x0, min(tops) - FIT if tops else text.y0 - 2 * FIT, edges.x1, max(ends) + FIT if ends else text.y1 + 2 * FIT)
    else:
        found = Box(text.x0 - 10, text.y0 - 2 * FIT, text.x1 + 10, text.y1 + 2 * FIT)
    return Box(max(scope.x0, found.x0), max(scope.y0, found.y0), min(scope.x1, found.x1), min(scope.y1, found.y1))


def _by_texts(page: Page, scope: Box, first: list[str], last: list[str]) -> Box | None:
    has = lambda t, texts: any(x.lower() in t.text.lower() for x in texts)
    tables = [t for t in page.tables if t.box.meets(scope)]
    end = next((t for t in reversed(tables) if has(t, last)), None)
    if end is None:
        return None
    above = [t for t in tables if t.box.y1 <= end.box.y0 + 35.0 and abs(t.box.x0 - end.box.x0) <= EDGE]
    top = end if has(end, first) else next((t for t in reversed(above) if has(t, first)), end)
    return Box(max(scope.x0, min(top.box.x0, end.box.x0) - HIT), top.box.y0 - HIT, min(scope.x1, max(top.box.x1, end.box.x1) + HIT), end.box.y1 + HIT)


def names(head: list[list[tuple[int, int, str]]]) -> list[str]:
    """One name for each column of header rows: the distinct texts above each other, equal neighbours once."""
    grid: dict[tuple[int, int], str] = {}
    for r, row in enumerate(head):
        c = 0
        for high, wide, text in row:
            while (r, c) in grid:
                c += 1
            grid |= {(r + i, c + j): text for i in range(high) for j in range(wide)}
            c += wide
    out = []
    for c in range(max((c for _, c in grid), default=-1) + 1):
        levels: list[str] = []
        for r in range(len(head)):
            if (t := grid.get((r, c), "").strip()) and levels[-1:] != [t]:
                levels.append(t)
        out.append(SEPARATOR.join(levels))
    return out


def rendered(page: Page, parts: list[Detected], head: int, flat: bool = True) -> str:
    """HTML of detected tables as one, the text between them as rows over all columns; a header of several rows becomes one."""
    top = parts[0].placed()
    k = min(max([head, *(r + cell[0] for r, row in enumerate(top[:head]) for cell in row)]), len(top))
    body = top[k:]
    for a, b in zip(parts, parts[1:]):
        gap = Box(a.box.x0 - HIT, a.box.y1, a.box.x1 + HIT, b.box.y0)
        text = " ".join(w for _, w in sorted(((x.y0, x.x0), w) for x, w in page.words if x.meets(gap))).strip()
        body += ([[(1, parts[0].cols, text)]] if text else []) + b.placed()
    cell = lambda tag, h, w, t: f"<{tag}" + (f' rowspan="{h}"' if h > 1 else "") + (f' colspan="{w}"' if w > 1 else "") + f">{html.escape(t, quote=False)}</{tag}>"
    line = lambda tag, row: "<tr>" + "".join(cell(tag, *x) for x in row) + "</tr>"
    rows = top[:k]
    if flat and k > 1:
        rows = [[(1, 1, name) for name in names(rows)]]
    section = lambda name, lines: f"<{name}>{''.join(lines)}</{name}>" if lines else ""
    return "<table>" + section("thead", [line("th", r) for r in rows]) + section("tbody", [line("td", r) for r in body]) + "</table>"


def reconciled(content: str, page: Page, action: int = 1) -> tuple[str, int]:
    """Return a block's content with its tables set right, and how many detected tables stand for none.

    ``action`` says what holds if there are such: 1 goes on, 2 leaves the content, 3 puts
    all detected tables, from the top, in the place of the first scanned one.
    """
    scanned = [t for t in map(Scanned.of, TABLE.finditer(content)) if t.cells]
    groups = matched(page, scanned)
    runs = [run_of(page, t, g) for t, g in zip(scanned, groups)]
    left = len([t for t in page.tables if not any(t in r for r in runs)])
    if left and action == 2:
        return content, left
    pieces, at = [], 0
    if left and action == 3:
        every = "\n\n".join(rendered(page, [t], 1) for t in sorted(page.tables, key=lambda t: (t.box.y0, t.box.x0)))
        if not scanned:
            return content + every, left
        new = [every, *[""] * (len(scanned) - 1)]
    else:
        new = [rendered(page, r, max(t.head, 1)) if r else t.flat(content[slice(*t.span)]) for t, r in zip(scanned, runs)]
    for t, text in zip(scanned, new):
        pieces += [content[at : t.span[0]], text]
        at = t.span[1]
    return "".join(pieces) + content[at:], left


def reconcile(blocks: DataFrame, geometry: DataFrame, action: int = 1) -> DataFrame:
    """Return the blocks (doc_id, pdf_page, seq, location, content) with their tables set right, and ``unassigned``.

    ``geometry`` is (doc_id, pdf_page) and GEOMETRY, a row for each page.  Blocks of
    pages without one stay as they are.  ``unassigned`` counts the detected tables of the
    block's part of the page that stand for no scanned one; such blocks are worth a look.
    """
    if action not in (1, 2, 3):
        raise ValueError("action must be 1, 2 or 3")
    rows = blocks.join(geometry, ["doc_id", "pdf_page"], "left").select("doc_id", "pdf_page", "seq", "location", F.coalesce("content", F.lit("")).alias("content"), "width", "height", "tables", "words", "drawings")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                page = None if pd.isna(row.width) else Page.of(row, row.location)
                text, left = (row.content, 0) if page is None or "<table" not in row.content.lower() and not page.tables else reconciled(row.content, page, action)
                out.append((row.doc_id, row.pdf_page, row.seq, row.location, text, left))
            yield pd.DataFrame(out, columns=["doc_id", "pdf_page", "seq", "location", "content", "unassigned"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(run, f"doc_id {kinds['doc_id']}, pdf_page {kinds['pdf_page']}, seq {kinds['seq']}, location string, content string, unassigned int")
