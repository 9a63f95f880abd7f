"""Type checking of expressions and their compilation to Spark columns, in one walk.

The walk gives each node a type (None: a bare null) and a maker of its column;
no column is made before the whole expression has been checked, so checking
needs no session.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.registry import STANDARD, FunctionRegistry, no_nan
from gridlark.functions.syntax import ErrorKind, ExpressionError, Node, parse, to_source
from gridlark.functions.types import ExprType

_N, _B, _D = ExprType.NUMBER, ExprType.BOOLEAN, ExprType.DATE
_DAY_MS = 86_400_000

Make = Callable[[], Column]


@dataclass(frozen=True)
class Scope:
    """columns: name -> (type, maker of its column in the type's Spark form).

    aggregate makes it a cell formula's scope: it gets (name, argument or None)
    for sum(x), count and the like, and gives the maker of the aggregate's column.
    """

    columns: dict[str, tuple[ExprType, Make]]
    functions: FunctionRegistry = STANDARD
    aggregate: Callable[[str, Node | None, Scope], Make] | None = None

    @property
    def is_cell(self) -> bool:
        return self.aggregate is not None

    def row(self) -> Scope:
        return Scope(self.columns, self.functions)


# Aggregates of cell formulas.
AGGREGATES = frozenset("sum avg average min max count distinct stdev stdevp var varp".split())


@dataclass(frozen=True)
class CompiledExpression:
    source: str
    root: Node
    type: ExprType
    make: Make
    #: Names of the columns it reads.
    columns: tuple[str, ...] = field(default=())

    def column(self) -> Column:
        return self.make()

    @property
    def canonical(self) -> str:
        return to_source(self.root)


def compile_expression(source: str, scope: Scope, expected: ExprType | None = None) -> CompiledExpression:
    """Raises ExpressionError for bad syntax and types, before any data is read."""
    root = parse(source)
    walk = _Walk(scope)
    kind, make = walk.visit(root)
    if kind is None:
        raise ExpressionError(ErrorKind.UNKNOWN_TYPE, root.offset, root.length)
    if expected is not None and kind is not expected:
        raise ExpressionError(ErrorKind.RESULT_TYPE, root.offset, root.length, expected.value, kind.value)
    return CompiledExpression(source, root, kind, make, tuple(dict.fromkeys(walk.columns)))


def _name(kind: ExprType | None) -> str:
    return kind.value if kind else "null"


_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        return F.when(b != 0, a / b)
    if op == "%":  # never negative
        return F.when(b != 0, F.pmod(a, F.abs(b)) + 0.0)
    return no_nan({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]())


def _moved(date: Column, days: Column) -> Column:
    ms = F.round(days * _DAY_MS).try_cast("long")
    return F.timestamp_add("MILLISECOND", F.when(F.abs(ms) < 10**14, ms), date)


class _Walk:
    def __init__(self, scope: Scope):
        self.scope = scope
        self.columns: list[str] = []

    def fail(self, at: Node, kind: ErrorKind, *arguments: object) -> Any:
        raise ExpressionError(kind, at.offset, at.length, *arguments)

    def visit(self, e: Node) -> tuple[ExprType | None, Make]:
        if e.op == "literal":
            return self.literal(e.value)
        if e.op == "name":
            return self.name(e)
        if e.op == "call":
            return self.call(e)
        args = [self.visit(a) for a in e.args]
        kinds, makes = [k for k, _ in args], [self.typed(m, k) for k, m in args]
        if e.op in ("neg", "plus"):
            self.need(e.args[0], kinds[0], _N, "-" if e.op == "neg" else "+")
            return _N, (lambda: -makes[0](_N)) if e.op == "neg" else (lambda: makes[0](_N))
        if e.op == "not":
            self.need(e.args[0], kinds[0], _B, "not")
            return _B, lambda: ~makes[0](_B)
        if e.op in ("and", "or"):
            for a, k in zip(e.args, kinds, strict=True):
                self.need(a, k, _B, e.op)
            return _B, (lambda: makes[0](_B) & makes[1](_B)) if e.op == "and" else (lambda: makes[0](_B) | makes[1](_B))
        if e.op in _COMPARE:
            kind = self.unify(e, kinds, e.op, ordered=e.op not in ("=", "<>"))
            return _B, lambda: _COMPARE[e.op](makes[0](kind), makes[1](kind))
        if e.op == "empty":
            return _B, lambda: makes[0](kinds[0]).isNotNull() if e.value else makes[0](kinds[0]).isNull()
        if e.op == "in":
            kind = self.unify(e, kinds, "in")
            return _B, lambda: self.within(makes[0](kind), [m(kind) for m in makes[1:]], bool(e.value))
        if e.op == "between":
            kind = self.unify(e, kinds, "between", ordered=True)
            inside = lambda: makes[0](kind).between(makes[1](kind), makes[2](kind))
            return _B, (lambda: ~inside()) if e.value else inside
        return self.arithmetic(e, kinds, makes)

    @staticmethod
    def typed(make: Make, kind: ExprType | None) -> Callable[[ExprType | None], Column]:
        """A bare null takes the type that is asked for."""
        return lambda wanted: make() if kind or not wanted else F.lit(None).cast(wanted.spark)

    @staticmethod
    def within(subject: Column, items: list[Column], negated: bool) -> Column:
        found = F.when(subject.isNotNull(), F.lit(False))
        if items:
            found = subject == items[0]
            for item in items[1:]:
                found = found | (subject == item)
        return ~found if negated else found

    def need(self, at: Node, kind: ExprType | None, wanted: ExprType, operator: str) -> None:
        if kind not in (None, wanted):
            self.fail(at, ErrorKind.OPERAND_TYPE, operator, wanted.value, _name(kind))

    def unify(self, at: Node, kinds: list[ExprType | None], operator: str, ordered: bool = False) -> ExprType | None:
        known = list(dict.fromkeys(k for k in kinds if k))
        if len(known) > 1 or (ordered and known and not known[0].ordered):
            self.fail(at, ErrorKind.INCOMPATIBLE_TYPES, operator, _name(kinds[0]), _name(kinds[-1] if len(known) < 2 else known[1]))
        return known[0] if known else None

    def literal(self, value: object) -> tuple[ExprType | None, Make]:
        if value is None:
            return None, lambda: F.lit(None)
        if isinstance(value, bool):
            return _B, lambda: F.lit(value)
        if isinstance(value, datetime):
            return _D, lambda: F.lit(value.isoformat(" ")).cast("timestamp_ntz")
        return (_N if isinstance(value, float) else ExprType.TEXT), lambda: F.lit(value)

    def name(self, e: Node) -> tuple[ExprType, Make]:
        name = str(e.value)
        known = self.scope.columns.get(name)
        if self.scope.aggregate:
            if name.lower() == "count":
                return _N, self.scope.aggregate("count", None, self.scope)
            self.fail(e, ErrorKind.NOT_ALLOWED_HERE if known else ErrorKind.UNKNOWN_COLUMN, name)
        if known is None:
            return self.fail(e, ErrorKind.UNKNOWN_COLUMN, name)
        self.columns.append(name)
        return known

    def arithmetic(self, e: Node, kinds: list, makes: list) -> tuple[ExprType | None, Make]:
        left, right = kinds
        if left is None and right is None:
            return None, lambda: F.lit(None)
        if _D in kinds:
            if e.op == "-" and left is _D and right is _D:
                apart = lambda: F.timestamp_diff("MILLISECOND", makes[1](_D), makes[0](_D)).cast("double") / _DAY_MS
                return _N, apart
            if e.op in "+-" and left is _D and right in (None, _N):
                return _D, lambda: _moved(makes[0](_D), makes[1](_N) if e.op == "+" else -makes[1](_N))
            if e.op == "+" and left in (None, _N):
                return _D, lambda: _moved(makes[1](_D), makes[0](_N))
            if e.op == "-" and left is None:
                return _D, lambda: F.lit(None).cast(_D.spark)
            self.fail(e, ErrorKind.INCOMPATIBLE_TYPES, e.op, _name(left), _name(right))
        for a, k in zip(e.args, kinds, strict=True):
            self.need(a, k, _N, e.op)
        return _N, lambda: _arithmetic(e.op, makes[0](_N), makes[1](_N))

    def call(self, e: Node) -> tuple[ExprType | None, Make]:
        name, n = str(e.value).lower(), len(e.args)
        if name in ("if", "coalesce", "isempty"):
            return self.generic(e, name, n)
        if self.scope.aggregate and name in AGGREGATES and (make := self.aggregated(e, name, n)):
            return _N, make
        overloads = self.scope.functions.lookup(name)
        if not overloads:
            raise ExpressionError(ErrorKind.UNKNOWN_FUNCTION, e.offset, len(str(e.value)), e.value)
        args = [self.visit(a) for a in e.args]
        fitting = [f for f in overloads if f.accepts(n)]
        if not fitting:
            self.fail(e, ErrorKind.ARGUMENT_COUNT, name, " or ".join(dict.fromkeys(f.arity for f in overloads)), n)
        for f in fitting:
            if all(k in (None, f.parameter(i)) for i, (k, _) in enumerate(args)):
                makes = [self.typed(m, k) for k, m in args]
                return f.returns, lambda: f.make(*(m(f.parameter(i)) for i, m in enumerate(makes)))
        k = next(i for i, (kind, _) in enumerate(args) if kind not in (None, fitting[0].parameter(i)))
        return self.fail(e.args[k], ErrorKind.ARGUMENT_TYPE, name, k + 1, fitting[0].parameter(k).value, _name(args[k][0]))

    def generic(self, e: Node, name: str, n: int) -> tuple[ExprType | None, Make]:
        """Functions of any type."""
        fits, arity = {"if": (n == 3, "3"), "coalesce": (n > 0, "at least 1"), "isempty": (n == 1, "1")}[name]
        if not fits:
            self.fail(e, ErrorKind.ARGUMENT_COUNT, name, arity, n)
        args = [self.visit(a) for a in e.args]
        makes = [self.typed(m, k) for k, m in args]
        kinds = [k for k, _ in args]
        if name == "isempty":
            return _B, lambda: makes[0](kinds[0]).isNull()
        if name == "if":
            self.need(e.args[0], kinds[0], _B, "if")
            kind = self.unify(e, kinds[1:], "if")
            return kind, lambda: F.when(makes[0](_B), makes[1](kind)).otherwise(makes[2](kind))
        kind = self.unify(e, kinds, "coalesce")
        return kind, lambda: F.coalesce(*(m(kind) for m in makes))

    def aggregated(self, e: Node, name: str, n: int) -> Make | None:
        """sum(x) and the like in a cell formula; None for min and max that are the plain functions."""
        plain = name in ("min", "max")
        assert self.scope.aggregate
        if n != 1:
            if name == "count" and n == 0:
                return self.scope.aggregate("count", None, self.scope)
            if plain:
                return None
            self.fail(e, ErrorKind.ARGUMENT_COUNT, name, "0-1" if name == "count" else "1", n)
        (argument,) = e.args
        row = _Walk(self.scope.row())
        if argument.op != "name" and self.has_aggregate(argument):
            if plain:
                return None
            self.fail(argument, ErrorKind.ARGUMENT_TYPE, name, 1, "a column or a row expression", "an expression over aggregates")
        try:
            kind, _ = row.visit(argument)
        except ExpressionError:
            if plain and argument.op != "name":
                return None
            raise
        if name == "distinct":
            if kind is None:
                self.fail(argument, ErrorKind.UNKNOWN_TYPE)
        elif kind is not _N:
            if plain and argument.op != "name":
                return None
            self.fail(argument, ErrorKind.ARGUMENT_TYPE, name, 1, "number", _name(kind))
        self.columns += row.columns
        return self.scope.aggregate(name, argument, self.scope)

    def has_aggregate(self, e: Node) -> bool:
        own = (e.op == "call" and str(e.value).lower() in AGGREGATES - {"min", "max"}) or (e.op == "name" and str(e.value).lower() == "count" and str(e.value) not in self.scope.columns)
        return own or any(map(self.has_aggregate, e.args))
