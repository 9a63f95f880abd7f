"""Cubes as JSON: specification, expansion and schema, in the established shape (version 1).

Members of a user's own (mapped dimensions, predicates, custom aggregates) need
adapters: name -> (class, to JSON, from JSON).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from typing import Any

from gridlark.functions.registry import STANDARD, FunctionRegistry
from gridlark.operators.aggregates import (
    COUNT,
    NEXT,
    PREVIOUS,
    Aggregate,
    CountAggregate,
    DifferenceFrom,
    DistinctCountAggregate,
    FormulaAggregate,
    Item,
    MeasureAggregate,
    PercentOf,
    Rank,
    RunningTotal,
)
from gridlark.operators.dimensions import ColumnDimension, ColumnMeasure, DatePartDimension, Dimension, ExpressionDimension, ExpressionMeasure, Measure
from gridlark.operators.facts import ColumnType
from gridlark.operators.filters import AndFilter, CompareFilter, EmptyFilter, ExpressionFilter, FactFilter, NotFilter, OrFilter, RangeFilter, TextFilter, ValueFilter
from gridlark.plans.cube import AxisDimension, AxisSort, Cube, CubeAxis, CubeSpec, Expansion
from gridlark.sources.schema import NULL_VALUES, ColumnSpec, NumberSyntax, Schema
from gridlark.sources.schema import STANDARD as STANDARD_NUMBERS

VERSION = 1

#: Function of a measure -> type in JSON.
_MEASURE_TYPES = {"sum": "sum", "avg": "avg", "min": "min", "max": "max", "count": "countValues", "stdev": "stdev", "stdevp": "stdevp", "var": "var", "varp": "varp"}
_FUNCTIONS = {v: k for k, v in _MEASURE_TYPES.items()}


def _some(**members: object) -> dict:
    return {k: v for k, v in members.items() if v is not None}


class FormatError(ValueError):
    """JSON that is no configuration."""


class CubeJson:
    def __init__(self, functions: FunctionRegistry = STANDARD, adapters: dict[str, tuple[type, Callable, Callable]] | None = None):
        self.functions, self.adapters = functions, adapters or {}

    # Values and paths

    def value(self, v: Any) -> object:
        if isinstance(v, datetime):
            return {"date": v.isoformat(timespec="milliseconds") + "Z"}
        if isinstance(v, date):
            return {"date": f"{v.isoformat()}T00:00:00.000Z"}
        if v is None or isinstance(v, (bool, int, float, str)):
            return v
        raise TypeError(f"can't encode {v!r}")

    def to_value(self, j: Any) -> object:
        if isinstance(j, dict) and set(j) == {"date"}:
            try:
                moment = datetime.fromisoformat(j["date"].replace("Z", "+00:00")).replace(tzinfo=None)
            except ValueError:
                raise FormatError(f"invalid date {j['date']!r}") from None
            return moment
        if j is None or isinstance(j, (bool, int, float, str)):
            return j
        raise FormatError(f"unexpected value {j!r}")

    # Members

    def _own(self, x: object, what: str) -> dict:
        for name, (kind, encode, _) in self.adapters.items():
            if isinstance(x, kind):
                return {"type": name, **encode(x)}
        raise TypeError(f"no adapter for the {what} {x!r}")

    def _from_own(self, j: dict, what: str) -> Any:
        if j.get("type") in self.adapters:
            return self.adapters[j["type"]][2](j)
        raise FormatError(f"unknown {what} {j.get('type')!r}")

    def dimension(self, d: Dimension) -> dict:
        if isinstance(d, ColumnDimension):
            return {"type": "column", "column": d.source_column, **_some(label=d.explicit_label)}
        if isinstance(d, DatePartDimension):
            return {"type": "datePart", "column": d.source_column, "part": d.part, **_some(label=d.explicit_label)}
        if isinstance(d, ExpressionDimension):
            return {"type": "expression", "source": d.source, **_some(id=d.given_id, label=d.explicit_label)}
        return self._own(d, "dimension")

    def to_dimension(self, j: dict) -> Dimension:
        kind = j.get("type")
        if kind == "column":
            return ColumnDimension(j["column"], j.get("label"))
        if kind == "datePart":
            return DatePartDimension(j["column"], j["part"], j.get("label"))
        if kind == "expression":
            return ExpressionDimension(j["source"], j.get("id"), j.get("label"), self.functions)
        return self._from_own(j, "dimension")

    def measure(self, m: Measure) -> dict:
        if isinstance(m, ColumnMeasure):
            return {"column": m.source_column, **_some(label=m.explicit_label)}
        if isinstance(m, ExpressionMeasure):
            return {"expression": m.source, **_some(id=m.given_id, label=m.explicit_label)}
        raise TypeError(f"can't encode {m!r}")

    def to_measure(self, j: dict) -> Measure:
        if "expression" in j:
            return ExpressionMeasure(j["expression"], j.get("id"), j.get("label"), self.functions)
        return ColumnMeasure(j["column"], j.get("label"))

    def aggregate(self, a: Aggregate) -> dict:
        if isinstance(a, CountAggregate):
            return {"type": "count"}
        if isinstance(a, DistinctCountAggregate):
            return {"type": "distinct", "dimension": self.dimension(a.dimension)}
        if isinstance(a, FormulaAggregate):
            return {"type": "expression", "source": a.source, **_some(id=a.given_id, label=a.explicit_label)}
        if isinstance(a, MeasureAggregate):
            return {"type": _MEASURE_TYPES[a.function], "measure": self.measure(a.measure)}
        if isinstance(a, PercentOf):
            return {"type": "percentOf", "base": self.aggregate(a.base), "of": a.of}
        if isinstance(a, DifferenceFrom):
            item = {"value": self.value(a.item.value)} if a.item.kind == "value" else a.item.kind
            kind = "percentDifferenceFrom" if a.percent else "differenceFrom"
            return {"type": kind, "base": self.aggregate(a.base), "axis": a.axis, "item": item}
        if isinstance(a, RunningTotal):
            return {"type": "runningTotal", "base": self.aggregate(a.base), "axis": a.axis}
        if isinstance(a, Rank):
            return {"type": "rank", "base": self.aggregate(a.base), "axis": a.axis, **({"ascending": True} if a.ascending else {})}
        return self._own(a, "aggregate")

    def to_aggregate(self, j: dict) -> Aggregate:
        kind = j.get("type")
        if kind == "count":
            return COUNT
        if kind == "distinct":
            return DistinctCountAggregate(self.to_dimension(j["dimension"]))
        if kind == "expression":
            return FormulaAggregate(j["source"], j.get("id"), j.get("label"), self.functions)
        if kind in _FUNCTIONS:
            return MeasureAggregate(_FUNCTIONS[kind], self.to_measure(j["measure"]))
        if kind == "percentOf":
            return PercentOf(self.to_aggregate(j["base"]), j["of"])
        if kind in ("differenceFrom", "percentDifferenceFrom"):
            item = j["item"]
            found = {"previous": PREVIOUS, "next": NEXT}.get(item) if isinstance(item, str) else Item("value", self.to_value(item["value"]))
            if found is None:
                raise FormatError(f"item: expected previous, next or a value, got {item!r}")
            return DifferenceFrom(self.to_aggregate(j["base"]), j["axis"], found, kind.startswith("percent"))
        if kind == "runningTotal":
            return RunningTotal(self.to_aggregate(j["base"]), j["axis"])
        if kind == "rank":
            return Rank(self.to_aggregate(j["base"]), j["axis"], j.get("ascending") is True)
        return self._from_own(j, "aggregate")

    def filter(self, f: FactFilter) -> dict:
        if isinstance(f, ValueFilter):
            return {"type": "value", "dimension": self.dimension(f.dimension), "values": [self.value(v) for v in f.values]}
        if isinstance(f, ExpressionFilter):
            return {"type": "expression", "source": f.source, **_some(label=f.label)}
        if isinstance(f, CompareFilter):
            return {"type": "compare", "column": f.column, "op": f.op, "value": self.value(f.value)}
        if isinstance(f, RangeFilter):
            return {"type": "range", "column": f.column, "low": self.value(f.low), "high": self.value(f.high)}
        if isinstance(f, TextFilter):
            return {"type": "text", "column": f.column, "match": f.match, "text": f.text}
        if isinstance(f, EmptyFilter):
            return {"type": "empty", "column": f.column, "negated": f.negated}
        if isinstance(f, (AndFilter, OrFilter)):
            return {"type": "and" if isinstance(f, AndFilter) else "or", "filters": [self.filter(x) for x in f.filters]}
        if isinstance(f, NotFilter):
            return {"type": "not", "filter": self.filter(f.filter)}
        return self._own(f, "filter")

    def to_filter(self, j: dict) -> FactFilter:
        kind = j.get("type")
        if kind == "value":
            return ValueFilter(self.to_dimension(j["dimension"]), tuple(self.to_value(v) for v in j["values"]))
        if kind == "expression":
            return ExpressionFilter(j["source"], j.get("label"), self.functions)
        if kind == "compare":
            return CompareFilter(j["column"], j["op"], self.to_value(j["value"]))
        if kind == "range":
            return RangeFilter(j["column"], self.to_value(j["low"]), self.to_value(j["high"]))
        if kind == "text":
            return TextFilter(j["column"], j["match"], j["text"])
        if kind == "empty":
            return EmptyFilter(j["column"], j.get("negated") is True)
        if kind in ("and", "or"):
            return (AndFilter if kind == "and" else OrFilter)(tuple(self.to_filter(x) for x in j["filters"]))
        if kind == "not":
            return NotFilter(self.to_filter(j["filter"]))
        return self._from_own(j, "filter")

    # Axes and configurations

    def sort(self, s: AxisSort) -> dict:
        path = None if s.key_path is None else [self.value(v) for v in s.key_path]
        return {
            "by": s.by,
            **_some(aggregate=self.aggregate(s.aggregate) if s.aggregate else None, keyPath=path),
            "direction": "descending" if s.descending else "ascending",
            "nulls": "last" if s.nulls_last else "first",
        }

    def to_sort(self, j: dict) -> AxisSort:
        path = j.get("keyPath")
        return AxisSort(
            j.get("by", "value"),
            self.to_aggregate(j["aggregate"]) if j.get("aggregate") else None,
            None if path is None else tuple(self.to_value(v["value"] if isinstance(v, dict) and "value" in v else v) for v in path),
            j.get("direction") == "descending",
            j.get("nulls") == "last",
        )

    def axis(self, a: CubeAxis) -> dict:
        dims = [{"dimension": self.dimension(d.dimension), **_some(sort=self.sort(d.sort) if d.sort else None)} for d in a.dimensions]
        return {"dimensions": dims, "summary": a.summary, "subtotals": a.subtotals}

    def to_axis(self, j: dict) -> CubeAxis:
        dims = tuple(AxisDimension(self.to_dimension(d["dimension"]), self.to_sort(d["sort"]) if d.get("sort") else None) for d in j["dimensions"])
        return CubeAxis(dims, j.get("summary", "end"), j.get("subtotals", "top"))

    def spec(self, s: CubeSpec) -> dict:
        members = {"rows": self.axis(s.rows), "columns": self.axis(s.columns), "aggregates": [self.aggregate(a) for a in s.aggregates]}
        return members | ({"filter": self.filter(s.filter)} if s.filter else {})

    def to_spec(self, j: dict) -> CubeSpec:
        aggregates = tuple(self.to_aggregate(a) for a in j["aggregates"])
        return CubeSpec(self.to_axis(j["rows"]), self.to_axis(j["columns"]), aggregates, self.to_filter(j["filter"]) if j.get("filter") else None)

    def expansion(self, e: Expansion) -> object:
        paths = sorted(([self.value(v) for v in p] for p in e.paths), key=lambda p: (len(p), str(p)))
        if e.depth is not None:
            return {"depth": e.depth} | ({"paths": paths} if paths else {})
        return paths

    def to_expansion(self, j: Any) -> Expansion:
        paths = j.get("paths", []) if isinstance(j, dict) else j
        found = Expansion.of(tuple(map(self.to_value, p)) for p in paths)
        return Expansion(found.paths, j["depth"]) if isinstance(j, dict) else found

    def config(self, cube: Cube, schema: Schema | None = None) -> dict:
        members = {
            "version": VERSION,
            "spec": self.spec(cube.spec),
            "rowExpansion": self.expansion(cube.row_expansion),
            "columnExpansion": self.expansion(cube.column_expansion),
        }
        return members | ({"schema": self.schema(schema)} if schema else {})

    def to_cube(self, j: dict, facts) -> Cube:
        """Raises FormatError for JSON that is no configuration of a known version."""
        if not isinstance(j, dict) or j.get("version") != VERSION:
            raise FormatError(f"config: unsupported version {j.get('version') if isinstance(j, dict) else j!r}")
        try:
            part = lambda name: self.to_expansion(j[name]) if j.get(name) is not None else None
            return Cube(facts, self.to_spec(j["spec"]), part("rowExpansion"), part("columnExpansion"))
        except (KeyError, TypeError, AttributeError) as e:
            raise FormatError(f"config: {e!r}") from e

    # Schemas

    def schema(self, s: Schema) -> dict:
        return {"columns": [self._column(c) for c in s.columns]}

    def _column(self, c: ColumnSpec) -> dict:
        out: dict = {"name": c.name, "type": c.type.value, **_some(label=c.label)}
        if not c.include:
            out["include"] = False
        out |= _some(format=c.format)
        if c.number_syntax != STANDARD_NUMBERS:
            out["numberSyntax"] = {"decimal": c.number_syntax.decimal, "thousands": list(c.number_syntax.thousands)}
        if c.null_values != NULL_VALUES:
            out["nullValues"] = list(c.null_values)
        return out

    def to_schema(self, j: dict) -> Schema:
        def column(c: dict) -> ColumnSpec:
            syntax = c.get("numberSyntax")
            return ColumnSpec(
                c["name"],
                ColumnType(c["type"]),
                c.get("label"),
                c.get("include") is not False,
                c.get("format"),
                NumberSyntax(syntax["decimal"], tuple(syntax["thousands"])) if syntax else STANDARD_NUMBERS,
                tuple(c["nullValues"]) if "nullValues" in c else NULL_VALUES,
            )

        return Schema(tuple(map(column, j["columns"])))
