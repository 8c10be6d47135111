"""HTML operators that need a parser: visible text, heading level, content references, table grids."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from html.parser import HTMLParser
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements whose end ends a line.
LINE_ENDS = frozenset("address article aside blockquote div footer h1 h2 h3 h4 h5 h6 header li ol p pre section table td th tr ul".split())
MAX_REFERENCE_DEPTH = 64
_BLANKS = re.compile(r"\s+")
# Fixed value: a content reference, empty and with a closing tag.
_REFERENCE = re.compile(r"""<content-ref\s+src=(?:'([^'"]+)'|"([^'"]+)")\s*></content-ref>""")
# Heading elements with their levels.
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}


class HtmlError(ValueError):
    """Markup that breaks the contract of the operator."""


class _Visible(HTMLParser):
    """Collects text and line ends; bodies of script and style are text as they stand."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in LINE_ENDS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        self.out.append(data)


def visible_text(source: str | None) -> str:
    """Text as seen: breaks and block ends are line ends, blanks collapse within a line, empty lines go."""
    if not source:
        return ""
    parser = _Visible()
    parser.feed(source)
    parser.close()
    lines = (_BLANKS.sub(" ", line).strip() for line in "".join(parser.out).splitlines())
    return "\n".join(line for line in lines if line)


class _Heading(HTMLParser):
    level: int | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.level is None:
            self.level = HEADINGS.get(tag)


def heading_level(source: str | None) -> int | None:
    """The level of the first heading element, or None; what looks like one inside a comment is none."""
    if not source:
        return None
    parser = _Heading()
    parser.feed(source)
    parser.close()
    return parser.level


def expand_references(block: Mapping[str, Any]) -> str:
    """A block's HTML with each content reference replaced by its child's, to any level.

    A cycle, a reference without child, a repeated child id and nesting over MAX_REFERENCE_DEPTH are errors.
    """

    def render(node: Mapping[str, Any], path: tuple[str, ...]) -> str:
        if len(path) > MAX_REFERENCE_DEPTH:
            raise HtmlError("references nest too deep")
        children: dict[str, Mapping[str, Any]] = {}
        for child in node.get("children") or []:
            if isinstance(child, Mapping) and isinstance(name := child.get("id"), str):
                if name in children:
                    raise HtmlError(f"repeated child {name}")
                children[name] = child

        def put(m: re.Match[str]) -> str:
            name = m[1] or m[2]
            if name in path:
                raise HtmlError(f"cycle at {name}")
            if name not in children:
                raise HtmlError(f"no child {name}")
            return render(children[name], (*path, name))

        return _REFERENCE.sub(put, node.get("html") or "")

    return render(block, (str(block.get("id")),))


# ---------------------------------------------------------------- tables
class Cell(NamedTuple):
    """A cell of a logical grid."""

    row_start: int
    column_start: int
    row_span: int
    column_span: int
    text: str
    is_header: bool


class Grid(NamedTuple):
    """A table as a logical grid."""

    row_count: int
    column_count: int
    cells: tuple[Cell, ...]


def _span(value: str | None) -> int:
    if value is None:  # absent, or without a value
        return 1
    try:
        n = int(value)
    except ValueError:
        raise HtmlError(f"span {value!r}") from None
    if n < 1:
        raise HtmlError(f"span {n}")
    return n


class _Table(HTMLParser):
    """Collects rows of (text, header, row span, column span); grammar errors raise."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables = 0
        self.inside = self.row_open = False
        self.rows: list[list[tuple[str, bool, int, int]]] = []
        self.cell: tuple[str, bool, int, int] | None = None
        self.text: list[list[str]] = []  # the pieces of each line of the open cell

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            if self.inside:
                raise HtmlError("nested table")
            if self.tables:
                raise HtmlError("multiple tables")
            self.tables, self.inside = 1, True
        elif not self.inside:
            return
        elif tag == "tr":
            if self.row_open or self.cell:
                raise HtmlError("row within a row or cell")
            self.row_open = True
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.row_open or self.cell:
                raise HtmlError("cell outside a row or within a cell")
            spans = dict(attrs)
            self.cell, self.text = ("", tag == "th", _span(spans.get("rowspan")), _span(spans.get("colspan"))), [[]]
        elif tag == "br" and self.cell:
            self.text.append([])

    def handle_endtag(self, tag: str) -> None:
        if not self.inside:
            if tag == "table":
                raise HtmlError("table end without a table")
            return
        if tag in ("td", "th"):
            if not self.cell:
                raise HtmlError("cell end without start")
            text = "\n".join(_BLANKS.sub(" ", "".join(line)).strip() for line in self.text).strip()
            self.rows[-1].append((text, *self.cell[1:]))
            self.cell = None
        elif tag == "tr":
            if not self.row_open or self.cell:
                raise HtmlError("row end without row or with an open cell")
            self.row_open = False
        elif tag == "table":
            if self.row_open or self.cell:
                raise HtmlError("table end with an open row or cell")
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.cell:
            self.text[-1].append(data)


def table_grid(source: str | None) -> Grid | None:
    """The logical grid of the one table in ``source``; None without a table; HtmlError where the grammar is broken.

    Each cell takes the first column of its row where its whole rectangle is free.  A row span may not pass the last row.
    """
    if not source:
        return None
    parser = _Table()
    parser.feed(source)
    parser.close()
    if not parser.tables:
        return None
    if parser.inside or parser.row_open or parser.cell:
        raise HtmlError("unfinished table")
    taken: set[tuple[int, int]] = set()
    cells: list[Cell] = []
    for r, row in enumerate(parser.rows):
        column = 0
        for text, header, down, across in row:
            if r + down > len(parser.rows):
                raise HtmlError("row span beyond the explicit tr rows")
            while any((r + i, column + j) in taken for i in range(down) for j in range(across)):
                column += 1
            taken |= {(r + i, column + j) for i in range(down) for j in range(across)}
            cells.append(Cell(r, column, down, across, text, header))
    return Grid(len(parser.rows), max((c.column_start + c.column_span for c in cells), default=0), tuple(cells))


GRID_SCHEMA = "grid_ok boolean, row_count int, column_count int, row_start int, column_start int, row_span int, column_span int, cell_text string, is_header boolean"


def table_cells(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, grid_ok, row_count, column_count, cell ...): one row per cell of each table.

    A table without cells, and markup that is rejected (grid_ok false), give one row without a cell.  Null sources and
    sources without a table give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[Any, ...]] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    grid = table_grid(text)
                except HtmlError:
                    rows.append((k, False, *[None] * 8))
                    continue
                if grid is None:
                    continue
                head = (k, True, grid.row_count, grid.column_count)
                rows += [(*head, *c) for c in grid.cells] or [(*head, *[None] * 6)]
            kinds = [batch.column(0).type, pa.bool_(), *[pa.int32()] * 6, pa.string(), pa.bool_()]
            names = [key, *(c.split()[0] for c in GRID_SCHEMA.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return df.select(key, source).where(f"`{source}` is not null").mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {GRID_SCHEMA}")


def grid_overlaps(cells: DataFrame, key: str) -> DataFrame:
    """(key, row, column, owners): grid places that more than one cell covers."""
    from pyspark.sql import functions as F

    rows = cells.where("row_start is not null").withColumn("row", F.explode(F.expr("sequence(row_start, row_start + row_span - 1)")))
    places = rows.withColumn("column", F.explode(F.expr("sequence(column_start, column_start + column_span - 1)")))
    return places.groupBy(key, "row", "column").agg(F.count("*").alias("owners")).where("owners > 1")


def visible_columns(df: DataFrame, key: str, source: str) -> DataFrame:
    """(key, visible_text, heading_level) of each HTML source; null and empty sources have empty text and no level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(s) for s in sources], pa.string()), pa.array([heading_level(s) for s in sources], pa.int32())], names=[key, "visible_text", "heading_level"])

    return df.select(key, source).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, visible_text string, heading_level int")
