"""The tables of HTML pages, in one pass over their tags."""

from __future__ import annotations

import html as references
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template)\b.*?(?:</\1\s*>|$)|<(/?)(table|tr|td|th|thead|tbody|tfoot|caption)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[^>]*>", re.S | re.I)
_SPAN = re.compile(r"\b(col|row)span\s*=\s*[\"']?\s*(\d+)", re.I)
#: A span of more columns or rows is taken for this many, as browsers do.
MOST_SPAN = 1_000

TABLES = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType())))]))


class _Cell:
    __slots__ = ("parts", "text", "columns", "rows")

    def __init__(self, attributes: str):
        spans = {k.lower(): min(max(1, int(n)), MOST_SPAN) for k, n in _SPAN.findall(attributes)}
        self.parts, self.text, self.columns, self.rows = [], "", spans.get("col", 1), spans.get("row", 1)

    def close(self) -> str:
        self.text = "".join(self.parts)
        return self.text


def tables_of(page: str | None) -> list[list[list[_Cell]]]:
    """The rows of each table in page order, of cells.

    A row belongs to all tables around it and a cell to all rows around it, and a cell's text holds that of the tables in it: a nested
    table's rows are rows of its own table and of the outer one. A cell ends where the next cell, row or table does, a cell
    without a row begins one, what isn't closed ends with the page. Cells outside of tables are none.
    """
    found: list[list[list[_Cell]]] = []
    open_: list[tuple[str, object]] = []  # table, tr and cell, the innermost last
    at, page = 0, page or ""

    def text(piece: str) -> None:
        if piece and open_ and open_[-1][0] == "cell":
            open_[-1][1].parts.append(piece)

    def end(*kinds: str) -> None:
        """Closes what is open of these kinds, up to the table."""
        while open_ and open_[-1][0] in kinds:
            kind, what = open_.pop()
            if kind == "cell":
                said = what.close()
                outer = next((x for k, x in reversed(open_) if k == "cell"), None)
                if outer is not None:
                    outer.parts.append(said)

    for m in _TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        inside = any(kind == "table" for kind, _ in open_)
        if m[2]:
            if tag == "table" and inside:
                end("cell", "tr")
                open_.pop()
            elif tag == "tr":
                end("cell", "tr")
            elif tag in ("td", "th"):
                end("cell")
            continue
        if tag == "table":
            if open_ and open_[-1][0] == "tr":
                end("tr")
            found.append([])
            open_.append(("table", found[-1]))
        elif not inside:
            continue
        elif tag in ("td", "th"):
            end("cell")
            if open_[-1][0] == "table":
                row: list[_Cell] = []
                for rows in (x for kind, x in open_ if kind == "table"):
                    rows.append(row)
                open_.append(("tr", row))
            cell = _Cell(m[4] or "")
            for row in (x for kind, x in open_ if kind == "tr"):
                row.append(cell)
            open_.append(("cell", cell))
        else:  # a row, or a part of a table
            end("cell", "tr")
            if tag == "tr":
                row = []
                for rows in (x for kind, x in open_ if kind == "table"):
                    rows.append(row)
                open_.append(("tr", row))
    text(page[at:])
    while open_:
        kind = open_[-1][0]
        end("cell", "tr")
        if open_ and open_[-1][0] == "table":
            open_.pop()
        elif open_ and open_[-1][0] == kind:
            break
    return found


def spread(rows: list[list[str]], spans: list[list[tuple[int, int]]]) -> list[list[str]]:
    """Rows as a grid: a cell's text in every column and row that it spans."""
    out, below = [], {}  # column: rows left, text
    for row, sizes in zip(rows, spans, strict=True):
        line: list[str] = []
        cells = iter(zip(row, sizes, strict=True))

        def carried(line=line) -> None:
            while len(line) in below:
                left, said = below.pop(len(line))
                if left > 1:
                    following[len(line)] = (left - 1, said)
                line.append(said)

        following: dict[int, tuple[int, str]] = {}
        carried()
        for said, (columns, down) in cells:
            for _ in range(columns):
                if down > 1:
                    following[len(line)] = (down - 1, said)
                line.append(said)
            carried()
        for column in sorted(below):  # spans beyond the row's end
            while len(line) < column:
                line.append("")
            carried()
        below = following
        out.append(line)
    return out


def _read(page: str | None, spans: bool) -> list[dict]:
    out = []
    for k, rows in enumerate(tables_of(page)):
        said = [[references.unescape(c.text).strip() for c in row] for row in rows]
        said = spread(said, [[(c.columns, c.rows) for c in row] for row in rows]) if spans else said
        out.append({"index": k, "rows": [row for row in said if any(row)]})
    return out


@F.pandas_udf(TABLES)
def html_tables(html: pd.Series) -> pd.Series:
    """Array of struct(index, rows): the cells of each table as they stand, rows without any text left out."""
    return pd.Series([_read(page, False) for page in html])


@F.pandas_udf(TABLES)
def html_grids(html: pd.Series) -> pd.Series:
    """``html_tables`` with every cell repeated over the columns and rows that it spans."""
    return pd.Series([_read(page, True) for page in html])
