"""Functions of the expression language as Spark columns.

Missing values follow one rule: a function gives null if an argument is null,
unless stated here; impossible results (a zero divisor, a text that is no
number, 30 February) are null, never an error, whatever the session's ANSI
setting.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.functions.types import ExprType

_N, _T, _B, _D = ExprType.NUMBER, ExprType.TEXT, ExprType.BOOLEAN, ExprType.DATE


@dataclass(frozen=True)
class ExpressionFunction:
    """make gets one column for each argument; optional counts the last parameters that may be left out.

    With variadic the last parameter repeats.  Functions of the same name and
    parameter types replace each other.
    """

    name: str
    parameters: tuple[ExprType, ...]
    returns: ExprType
    make: Callable[..., Column]
    optional: int = 0
    variadic: bool = False

    def parameter(self, k: int) -> ExprType:
        return self.parameters[min(k, len(self.parameters) - 1)]

    def accepts(self, count: int) -> bool:
        least = len(self.parameters) - self.optional
        return count >= least and (self.variadic or count <= len(self.parameters))

    @property
    def arity(self) -> str:
        least, most = len(self.parameters) - self.optional, len(self.parameters)
        return f"at least {least}" if self.variadic else str(most) if least == most else f"{least}-{most}"


@dataclass(frozen=True)
class FunctionRegistry:
    functions: tuple[ExpressionFunction, ...] = field(default=())

    def lookup(self, name: str) -> list[ExpressionFunction]:
        return [f for f in self.functions if f.name == name.lower()]

    def with_functions(self, *more: ExpressionFunction) -> FunctionRegistry:
        keys = {(f.name.lower(), f.parameters) for f in more}
        kept = tuple(f for f in self.functions if (f.name, f.parameters) not in keys)
        return FunctionRegistry(kept + more)


def python_function(name: str, parameters: tuple[ExprType, ...], returns: ExprType, implementation: Callable, optional: int = 0) -> ExpressionFunction:
    """A function in Python, run as an Arrow UDF row by row; what isn't of the result's type becomes null."""
    kinds = {_N: (int, float), _T: str, _B: bool, _D: datetime}[returns]

    def safe(*args):
        value = implementation(*args)
        return (float(value) if returns is _N else value) if isinstance(value, kinds) and not (returns is _N and isinstance(value, bool)) else None

    return ExpressionFunction(name.lower(), parameters, returns, F.udf(safe, returns.spark, useArrow=True), optional)


def no_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


def _trimmed(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def _whole(n: Column) -> Column:
    return n.try_cast("int")


def _round(n: Column, digits: Column | None = None) -> Column:
    """Half away from zero, in doubles: round(1.005, 2) is 1."""
    away = lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")
    if digits is None:
        return away(n)
    scale = F.pow(F.lit(10.0), _whole(digits).cast("double"))
    return no_nan(away(n * scale) / scale)


def number_from_text(t: Column) -> Column:
    t = _trimmed(t)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def text_from_number(n: Column) -> Column:
    """Whole numbers without a point, others in their shortest form."""
    plain = lambda scale: F.regexp_replace(n.try_cast(f"decimal(38,{scale})").cast("string"), r"0+$", "")
    size = F.abs(n)
    return (
        F.when((n == F.floor(n)) & (size < 1e15), n.try_cast("long").cast("string"))
        .when((size >= 1e7) & (size < 1e21), plain(12))
        .when((size >= 1e-6) & (size < 1e-3), plain(24))
        .otherwise(F.lower(n.cast("string")))
    )


def text_from_date(d: Column) -> Column:
    fine = F.date_format(d, "SSS") != "000"
    return (
        F.when(fine, F.date_format(d, "yyyy-MM-dd HH:mm:ss.SSS"))
        .when(F.date_format(d, "HHmmss") != "000000", F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )


def date_from_text(t: Column) -> Column:
    """The grammar of date literals, without the signs round them."""
    t = _trimmed(t)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,3})?)?)?$"
    return F.when(t.rlike(shape), t.try_cast("timestamp_ntz"))


def date_from_parts(y: Column, m: Column, d: Column) -> Column:
    """Months and days roll over into neighbouring years and months."""
    y, m, d = _whole(y), _whole(m), _whole(d)
    sane = y.between(1, 9999) & m.between(-100_000, 100_000) & d.between(-3_000_000, 3_000_000)
    start = F.make_date(F.when(sane, y), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(start, m - 1), d - 1).cast("timestamp_ntz")


def date_part(part: str, d: Column) -> Column:
    """year, quarter, month, week (ISO 8601), day, weekday (Monday is 1) or hour, as an int."""
    if part == "weekday":
        return F.weekday(d) + 1
    return {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour}[part](d)


DATE_PARTS = ("year", "quarter", "month", "week", "day", "weekday", "hour")


def _extreme(pick: Callable[..., Column]) -> Callable[..., Column]:
    return lambda *xs: xs[0] if len(xs) == 1 else pick(*xs)


def _substring(t: Column, start: Column, length: Column | None = None) -> Column:
    start = F.greatest(_whole(start), F.lit(1))
    return F.substr(t, start) if length is None else F.substr(t, start, F.greatest(_whole(length), F.lit(0)))


def _part(name: str) -> ExpressionFunction:
    return ExpressionFunction(name, (_D,), _N, lambda d: date_part(name, d).cast("double"))


def _f(name: str, parameters: tuple[ExprType, ...], returns: ExprType, make: Callable[..., Column], **more) -> ExpressionFunction:
    return ExpressionFunction(name, parameters, returns, make, **more)


STANDARD = FunctionRegistry(
    (
        _f("abs", (_N,), _N, F.abs),
        _f("round", (_N, _N), _N, _round, optional=1),
        _f("floor", (_N,), _N, lambda n: F.floor(n).cast("double")),
        _f("ceil", (_N,), _N, lambda n: F.ceil(n).cast("double")),
        _f("sqrt", (_N,), _N, lambda n: F.when(n >= 0, F.sqrt(n))),
        # These two skip nulls.
        _f("min", (_N,), _N, _extreme(F.least), variadic=True),
        _f("max", (_N,), _N, _extreme(F.greatest), variadic=True),
        _f("number", (_T,), _N, number_from_text),
        # UTF-16 code units: a character beyond U+FFFF counts twice.
        _f("len", (_T,), _N, lambda t: (F.octet_length(F.encode(t, "UTF-16BE")) / 2).cast("double")),
        _f("lower", (_T,), _T, F.lower),
        _f("upper", (_T,), _T, F.upper),
        _f("trim", (_T,), _T, _trimmed),
        _f("left", (_T, _N), _T, lambda t, n: F.left(t, F.greatest(_whole(n), F.lit(0)))),
        _f("right", (_T, _N), _T, lambda t, n: F.right(t, F.greatest(_whole(n), F.lit(0)))),
        _f("substring", (_T, _N, _N), _T, _substring, optional=1),
        _f("contains", (_T, _T), _B, F.contains),
        _f("startswith", (_T, _T), _B, F.startswith),
        _f("endswith", (_T, _T), _B, F.endswith),
        _f("replace", (_T, _T, _T), _T, lambda t, a, b: F.when(a == "", F.when(b.isNotNull(), t)).otherwise(F.replace(t, a, b))),
        # Skips nulls; all null is an empty text.
        _f("concat", (_T,), _T, lambda *ts: F.concat_ws("", *ts), variadic=True),
        _f("text", (_N,), _T, text_from_number),
        _f("text", (_D,), _T, text_from_date),
        _f("text", (_B,), _T, lambda b: b.cast("string")),
        _f("text", (_T,), _T, lambda t: t),
        *map(_part, DATE_PARTS),
        _f("date", (_T,), _D, date_from_text),
        _f("date", (_N, _N, _N), _D, date_from_parts),
        _f("today", (), _D, lambda: F.lit(datetime.now(UTC).date()).cast("timestamp_ntz")),
    )
)
