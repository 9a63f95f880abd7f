"""A cube's layout as a rectangle of cells, and its exports.

The layout is collected: it holds as many cells as are shown, up to a bound.
"""

from __future__ import annotations

import html as _html
import json
from dataclasses import dataclass
from datetime import date, datetime

from gridlark.functions.syntax import date_text
from gridlark.operators.aggregates import Aggregate
from gridlark.plans.cube import Cube, _Axis


@dataclass(frozen=True)
class GridCell:
    """value in a header or body; origin is false where a merged header area goes on."""

    value: object
    origin: bool = True
    header: bool = False
    column_span: int = 1
    row_span: int = 1


@dataclass(frozen=True)
class Entry:
    depth: int
    path: tuple
    ord: tuple[int, ...]
    open: bool


@dataclass(frozen=True)
class Grid:
    rows: list[Entry]
    columns: list[Entry]
    aggregates: list[Aggregate]
    row_labels: list[str]
    column_labels: list[str]
    #: (row, column) -> aggregate values, for cells with facts.
    cells: dict[tuple[tuple, tuple], list]
    row_levels: int
    column_levels: int
    #: (level, position) -> (level_start, level_span, entry_start, entry_span) of the header area there.
    row_areas: dict[tuple[int, int], tuple[int, int, int, int]]
    column_areas: dict[tuple[int, int], tuple[int, int, int, int]]
    empty: str = "(empty)"
    total: str = "Total"

    def name(self, entry: Entry, level: int) -> object:
        """A header's label on a level; a summary's stands on the first."""
        if entry.depth == 0:
            return self.total if level == 0 else None
        if level >= entry.depth:
            return None
        return self.empty if entry.path[level] is None else entry.path[level]

    def value(self, row: Entry, column: Entry, k: int) -> object:
        found = self.cells.get((row.ord, column.ord))
        return None if found is None else found[k]

    def _header(self, areas: dict, entry: Entry, level: int, levels: int, at: int) -> tuple[object, bool, int, int]:
        """(label, whether an area begins here, levels and entries that it spans)."""
        first, span, start, run = areas[level, at]
        return self.name(entry, level), (level, at) == (first, start), min(span, levels - first), run

    def table(self) -> list[list[GridCell]]:
        """Header rows, one for each column level and one for the aggregates, then body rows."""
        out: list[list[GridCell]] = []
        corner = max(self.row_levels, 1)
        levels = max(self.column_levels, 1)
        many = len(self.aggregates)
        for level in range(levels):
            row = [GridCell(None, header=True) for _ in range(corner)]
            if self.column_labels and level < self.column_levels:
                row[0] = GridCell(self.column_labels[level], header=True)
            for at, c in enumerate(self.columns):
                label, origin, deep, wide = self._header(self.column_areas, c, level, levels, at)
                row += [GridCell(label, origin and k == 0, True, wide * many if k == 0 and origin else 1, deep if origin else 1) for k in range(many)]
            out.append(row)
        head = [GridCell(self.row_labels[k] if k < len(self.row_labels) else None, header=True) for k in range(corner)]
        out.append(head + [GridCell(a.label, header=True) for _ in self.columns for a in self.aggregates])
        for at, r in enumerate(self.rows):
            row = []
            for level in range(corner):
                label, origin, wide, deep = self._header(self.row_areas, r, level, corner, at)
                row.append(GridCell(label, origin, True, wide if origin else 1, deep if origin else 1))
            row += [GridCell(self.value(r, c, k)) for c in self.columns for k in range(many)]
            out.append(row)
        return out


def _entries(frame, axis: _Axis) -> list[Entry]:
    rows = frame.where("has_entry").orderBy("pos").collect()
    return [Entry(r["depth"], tuple(r[n] for n in axis.names()[: r["depth"]]), tuple(r["ord"]), r["open"]) for r in rows]


#: Cells that a collected layout may hold.
MOST_CELLS = 2_000_000


def grid_of(cube: Cube, aggregates: list[Aggregate] | None = None, empty: str = "(empty)", total: str = "Total") -> Grid:
    """The layout, collected.  Raises ValueError for one of more than MOST_CELLS cells: write the cube's cells then."""
    shown = list(aggregates or cube.spec.aggregates)
    size = cube.row_entries.where("has_entry").count() * cube.column_entries.where("has_entry").count()
    if size > MOST_CELLS:
        raise ValueError(f"{size} cells are more than a grid can hold; write Cube.result() or Cube.table() instead")
    cells = {}
    for r in cube.grid.where("facts > 0").select("ro", "co", *(cube._name(a) for a in shown)).collect():
        cells[tuple(r["ro"]), tuple(r["co"])] = [r[cube._name(a)] for a in shown]
    areas = lambda side: {(r["level"], r["pos"]): (r["level_start"], r["level_span"], r["entry_start"], r["entry_span"]) for r in cube.header_areas(side).collect()}
    labels = lambda axis: [_label(cube, d.dimension) for d in axis.axis.dimensions[: axis.levels]]
    return Grid(
        _entries(cube.row_entries, cube._rows),
        _entries(cube.column_entries, cube._columns),
        shown,
        labels(cube._rows),
        labels(cube._columns),
        cells,
        cube._rows.levels,
        cube._columns.levels,
        areas("rows"),
        areas("columns"),
        empty,
        total,
    )


def _label(cube: Cube, dimension) -> str:
    source = getattr(dimension, "source_column", None)
    if dimension.explicit_label is None and source == dimension.id and source is not None:
        return cube.facts[source].label
    return dimension.label


def format_number(value: float, decimal: str = ".") -> str:
    """15 significant digits, whole numbers without a point."""
    if isinstance(value, int) or (value == value and value == int(value) and abs(value) < 2**53):
        text = str(int(value))
    else:
        text = repr(float(f"{value:.15g}"))
        text = text[:-2] if text.endswith(".0") else text
    return text if decimal == "." else text.replace(".", decimal)


@dataclass(frozen=True)
class CsvExportOptions:
    delimiter: str = ","
    quote: str = '"'
    line_ending: str = "\r\n"
    decimal: str = "."
    repeat_labels: bool = False
    byte_order_mark: bool = False

    def field(self, text: str) -> str:
        if any(c in text for c in (self.delimiter, self.quote, "\n", "\r")):
            return self.quote + text.replace(self.quote, self.quote * 2) + self.quote
        return text


EUROPEAN_EXCEL = CsvExportOptions(delimiter=";", decimal=",", byte_order_mark=True)


def _text(value: object, decimal: str = ".") -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return format_number(value, decimal)
    if isinstance(value, datetime):
        return date_text(value)
    return value.isoformat() if isinstance(value, date) else str(value)


def to_csv(cube: Cube, aggregates: list[Aggregate] | None = None, options: CsvExportOptions = CsvExportOptions()) -> str:
    """The grid; merged labels stand once, or on every row and column if labels repeat."""
    lines = []
    for row in grid_of(cube, aggregates).table():
        cells = ["" if not c.origin and not options.repeat_labels else _text(c.value, options.decimal) for c in row]
        lines.append(options.delimiter.join(map(options.field, cells)) + options.line_ending)
    return ("﻿" if options.byte_order_mark else "") + "".join(lines)


def json_records(cube: Cube, aggregates: list[Aggregate] | None = None) -> list[dict]:
    """One object for each row: its groups by label, and values named like '2024 / Q1 / sum of x'."""
    g = grid_of(cube, aggregates)
    names: list[str] = []
    for c in g.columns:
        for a in g.aggregates:
            path = [_text(g.name(c, level)) for level in range(max(c.depth, 1))] if g.column_levels else []
            base = " / ".join([*path, a.label])
            name, n = base, 2
            while name in names or name in g.row_labels:
                name, n = f"{base} ({n})", n + 1
            names.append(name)
    out = []
    for r in g.rows:
        record: dict = {label: (_json(g.name(r, level)) if r.depth == 0 or level < r.depth else None) for level, label in enumerate(g.row_labels)}
        values = [_json(g.value(r, c, k)) for c in g.columns for k in range(len(g.aggregates))]
        out.append(record | dict(zip(names, values, strict=True)))
    return out


def _json(value: object) -> object:
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def to_json(cube: Cube, aggregates: list[Aggregate] | None = None, lines: bool = False) -> str:
    records = json_records(cube, aggregates)
    if lines:
        return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records)
    return json.dumps(records, ensure_ascii=False)


_STYLE = "table{border-collapse:collapse}th,td{border:1px solid #ccc;padding:2px 6px}td{text-align:right}thead th{position:sticky;top:0;background:#fff}"


def to_html(cube: Cube, aggregates: list[Aggregate] | None = None, stylesheet: bool = True) -> str:
    """A table whose header areas are one cell each."""
    g = grid_of(cube, aggregates)
    head = max(g.column_levels, 1) + 1
    out = ["<style>" + _STYLE + "</style>"] if stylesheet else []
    out.append("<table><thead>")
    for y, row in enumerate(g.table()):
        if y == head:
            out.append("</thead><tbody>")
        out.append("<tr>")
        for cell in row:
            if cell.origin:
                tag = "th" if cell.header else "td"
                spans = "".join(f' {name}="{n}"' for name, n in (("colspan", cell.column_span), ("rowspan", cell.row_span)) if n > 1)
                out.append(f"<{tag}{spans}>{_html.escape(_text(cell.value))}</{tag}>")
        out.append("</tr>")
    return "".join(out) + "</tbody></table>"
