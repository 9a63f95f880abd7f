"""How text becomes typed values: number syntaxes, date patterns, column specifications."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.operators.facts import ColumnType

# Cells that mean missing, and date patterns in the order in which they are tried.
NULL_VALUES = ("", "null", "NULL", "n/a", "N/A", "NA", "-")
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-ddTHH:mm:ss",
    "yyyy-MM-ddTHH:mm:ss.SSS",
    "yyyy-MM-ddTHH:mm:ssZ",
    "yyyy-MM-ddTHH:mm:ss.SSSZ",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@dataclass(frozen=True)
class NumberSyntax:
    decimal: str = "."
    thousands: tuple[str, ...] = (",",)

    def _plain(self, text: Column) -> Column:
        """text with a point and without separators, null if they don't stand between groups of three digits."""
        mark = re.escape(self.decimal)
        grouped = "|".join(rf"\d{{1,3}}(?:{re.escape(s)}\d{{3}})+" for s in self.thousands)
        whole = rf"(?:\d*{'|' + grouped if grouped else ''})"
        fits = text.rlike(rf"^[+-]?{whole}(?:{mark}\d*)?(?:[eE][+-]?\d+)?$")
        plain = text
        for s in self.thousands:
            plain = F.replace(plain, F.lit(s), F.lit(""))
        return F.when(fits, plain if self.decimal == "." else F.replace(plain, F.lit(self.decimal), F.lit(".")))

    def integer(self, text: Column) -> Column:
        plain = self._plain(text)
        return F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("long"))

    def number(self, text: Column) -> Column:
        plain = self._plain(text)
        value = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double"))
        return F.when(F.abs(value) < float("inf"), value)


STANDARD = NumberSyntax()
EUROPEAN = NumberSyntax(",", (".", " ", " "))


def boolean(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("true", "yes"), F.lit(True)).when(low.isin("false", "no"), F.lit(False))


#: Token -> (regular expression, what it gives), the longest first.
_TOKENS = (
    ("yyyy", r"(\d{4})", "year"),
    ("SSS", r"(\d{3})", "milli"),
    ("yy", r"(\d{2})", "short"),
    ("MM", r"(\d{2})", "month"),
    ("dd", r"(\d{2})", "day"),
    ("HH", r"(\d{2})", "hour"),
    ("mm", r"(\d{2})", "minute"),
    ("ss", r"(\d{2})", "second"),
    ("M", r"(\d{1,2})", "month"),
    ("d", r"(\d{1,2})", "day"),
    ("H", r"(\d{1,2})", "hour"),
    ("m", r"(\d{1,2})", "minute"),
    ("s", r"(\d{1,2})", "second"),
)


@dataclass(frozen=True)
class DatePattern:
    """yyyy yy MM M dd d HH H mm m ss s SSS; anything else stands for itself."""

    pattern: str

    def _compiled(self) -> tuple[str, list[str]]:
        out, parts, at = "", [], 0
        while at < len(self.pattern):
            for token, expression, part in _TOKENS:
                if self.pattern.startswith(token, at):
                    out += expression
                    parts.append(part)
                    at += len(token)
                    break
            else:
                out += re.escape(self.pattern[at])
                at += 1
        return f"^{out}$", parts

    @property
    def has_time(self) -> bool:
        return bool({"hour", "minute", "second", "milli"} & set(self._compiled()[1]))

    def parse(self, text: Column) -> Column:
        """As a zoneless timestamp; null for other texts and for days that don't exist."""
        expression, parts = self._compiled()
        if re.fullmatch(r"yyyy-MM-dd([T ]HH:mm(:ss(\.SSS)?)?)?Z?", self.pattern):  # a text of this shape can be cast as it stands
            plain = F.substring(text, 1, len(self.pattern) - 1) if self.pattern.endswith("Z") else text
            return F.when(text.rlike(expression), plain.try_cast("timestamp_ntz"))
        of = {p: F.regexp_extract(text, expression, k + 1) for k, p in enumerate(parts)}
        two = lambda p: F.lpad(of[p], 2, "0") if p in of else F.lit("01" if p in ("month", "day") else "00")
        year = of["year"] if "year" in of else F.concat(F.when(of["short"] < "70", F.lit("20")).otherwise(F.lit("19")), of["short"]) if "short" in of else F.lit("1970")
        date = F.concat_ws("-", year, two("month"), two("day"))
        time = F.concat(F.concat_ws(":", two("hour"), two("minute"), two("second")), F.lit("."), of.get("milli", F.lit("000")))
        return F.when(text.rlike(expression), F.concat_ws(" ", date, time).try_cast("timestamp_ntz"))


def is_midnight(moment: Column) -> Column:
    return moment == F.date_trunc("DAY", moment).cast("timestamp_ntz")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: ColumnType
    label: str | None = None
    include: bool = True
    #: A DatePattern's text; without it DATE_FORMATS are tried on each value.
    format: str | None = None
    number_syntax: NumberSyntax = STANDARD
    null_values: tuple[str, ...] = NULL_VALUES
    #: Column -> column of the type, for anything else.
    parser: Callable[[Column], Column] | None = field(default=None, compare=False)

    def moments(self, text: Column) -> Column:
        if self.format:
            return DatePattern(self.format).parse(text)
        return F.coalesce(*(DatePattern(f).parse(text) for f in DATE_FORMATS))

    def cleaned(self, raw: Column) -> Column:
        """raw, null if it says that the value is missing."""
        return F.when(~trimmed(raw).isin(*self.null_values), raw)

    def parsed(self, raw: Column, as_type: ColumnType | None = None) -> Column:
        """The text's value; null where it is missing or doesn't fit."""
        present = self.cleaned(raw)
        return self.value_of(present, trimmed(present), as_type)

    def value_of(self, present: Column, text: Column, as_type: ColumnType | None = None) -> Column:
        """parsed() from the cleaned text and the same, trimmed: columns, so that neither is worked out for each test."""
        kind = as_type or self.type
        if self.parser:
            return self.parser(present).try_cast(kind.spark)
        if kind is ColumnType.TEXT:
            return present
        if kind is ColumnType.INTEGER:
            return self.number_syntax.integer(text)
        if kind is ColumnType.NUMBER:
            return self.number_syntax.number(text)
        if kind is ColumnType.BOOLEAN:
            return boolean(text)
        moment = self.moments(text)
        return F.when(is_midnight(moment), moment.cast("date")) if kind is ColumnType.DATE else moment

    def copy_with(self, **changes) -> ColumnSpec:
        return replace(self, **changes)


@dataclass(frozen=True)
class Schema:
    columns: tuple[ColumnSpec, ...]

    def __post_init__(self):
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError("column names must differ")

    @property
    def included(self) -> tuple[ColumnSpec, ...]:
        return tuple(c for c in self.columns if c.include)

    def __getitem__(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)

    def replace(self, spec: ColumnSpec) -> Schema:
        return Schema(tuple(spec if c.name == spec.name else c for c in self.columns))

    @property
    def structure_key(self) -> str:
        return json.dumps([c.name for c in self.columns], ensure_ascii=False, separators=(",", ":"))
