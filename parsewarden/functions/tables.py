"""Table rows, Markdown and HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parsewarden.functions.text import normalize_cell


def normalize_rows(rows: Column) -> Column:
    """Cells normalised, null rows dropped; rows may differ in length; null is no rows."""
    own = F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, normalize_cell))
    return F.coalesce(own, F.array().cast("array<array<string>>"))


def rows_to_markdown(rows: Column) -> Column:
    """Markdown table with row 0 as its header, rows padded to the longest; null for no rows."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))

    def line(r: Column) -> Column:
        cells = F.transform(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))


class _Cells(HTMLParser):
    """Rows of all tables. A cell of a nested table counts in every row around it, as well as in its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list[str]]] = []
        self.open_rows: list[list[list[str]]] = []
        self.open_cells: list[list[str]] = []
        self.stack: list[str] = []

    def close(self, *tags: str) -> None:
        while self.stack and self.stack[-1] in tags:
            (self.open_rows if self.stack.pop() == "tr" else self.open_cells).pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.close("td", "th", "tr")
            self.rows.append([])
            self.open_rows.append(self.rows[-1])
            self.stack.append(tag)
        elif tag in ("td", "th"):
            self.close("td", "th")
            cell: list[str] = []
            for row in self.open_rows:
                row.append(cell)
            self.open_cells.append(cell)
            self.stack.append(tag)
        elif tag == "table":
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table") and tag in self.stack:
            while (last := self.stack.pop()) != tag:
                if last != "table":
                    (self.open_rows if last == "tr" else self.open_cells).pop()
            if tag != "table":
                (self.open_rows if tag == "tr" else self.open_cells).pop()

    def handle_data(self, data: str) -> None:
        if piece := data.strip():
            for cell in self.open_cells:
                cell.append(piece)


def parse_html_rows(html: str | None) -> list[list[str]]:
    if not html:
        return []
    parser = _Cells()
    parser.feed(html)
    HTMLParser.close(parser)
    return [[" ".join(" ".join(c).split()) for c in row] for row in parser.rows if row]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def html_table_to_rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Rows of the tables in HTML, in order of their beginning; rows without cells dropped, spans ignored."""
    for s in batches:
        yield s.map(parse_html_rows)
