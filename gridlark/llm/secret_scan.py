"""Secret scans: three base patterns, and windows of high Shannon entropy by character class.

All of it is DataFrame functions; no Python runs on the executors, nothing is
shuffled.  A run of characters of one class is read with a window of fixed
width.  Its entropy is log2(width) - sum(c * log2(c)) / width over the counts c
of its characters.  The counts stand in a string with a place for each
character; as the window moves, that of the character that leaves falls by one,
that of the one that enters rises, and the sum changes by their two terms, in
whole millionths, so that it never drifts.  A run whose highest window reaches the class's bits is a finding, from
the first such window's start to the last one's end, unless an allow-list
pattern clears the whole run.

Work is linear in the text; findings are listed in blocks (see spans).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import let
from gridlark.llm.spans import matches, replaced

# The base kinds, in the order in which they sort.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ASSIGN_LEAST = 12
#: Matches of [A-Z0-9]+ and [0-9a-f]+ are whole runs, so the least lengths can stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyClass:
    name: str
    run: str
    #: Characters of a window.
    width: int
    #: Bits per character that a window must reach.
    bits: float
    #: Runs that this pattern matches belong to another class.
    unless: str = r"^\b$"


CLASSES = (
    EntropyClass("hexadecimal", r"[0-9A-Fa-f]{20,}", 20, 3.0),
    EntropyClass("base64", r"[A-Za-z0-9+/_-]{24,}", 24, 3.9, r"^[0-9A-Fa-f]+$"),
)
#: A run that one of these finds is no secret.
ALLOW = (
    # Words, in one case or with capitals at their starts, and paths of them: letters in random cases are not cleared.
    r"^(?:[A-Z]?[a-z]+|[A-Z]+|[a-z]*(?:[A-Z][a-z]{2,})+)(?:[/+_-]+(?:[A-Z]?[a-z]+|[A-Z]+|[a-z]*(?:[A-Z][a-z]{2,})+))*[/+_-]*$",
    r"^[0-9/+_-]+$",  # numbers and dates
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # identifiers
    r"(?i)example|placeholder|dummy|changeme|x{6}|0{8}|deadbeef|0123456789abcdef|abcdefghijklmnop",
    r"^[A-Za-z]+(?:[/_-][A-Za-z0-9]{1,6})+$",  # slugs and paths of short parts
)
MARK = "[REDACTED]"


def _sums(width: int) -> Column:
    return F.array(*(F.lit(round(c * math.log2(c) * 1e6) if c else 0) for c in range(width + 2)))


#: A window's counts: a character for each of U+0020 to U+007F, that of a count of 0 being "0".
_NO_COUNTS = "0" * 96


def hot_range(run: Column, width: int, bits: float) -> Column:
    """(first, last) place covered by windows of run that reach bits, last exclusive; nulls if none does.

    run is of printable ASCII; width is 70 at most.
    """
    most = math.floor((math.log2(width) - bits) * width * 1e6)
    table = _sums(width)
    none = F.lit(None).cast("int")
    zero = F.struct(F.lit("").alias("window"), F.lit(_NO_COUNTS).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("at"), none.alias("first"), none.alias("last"))
    place = lambda char: F.ascii(char) - 31
    count = lambda counts, char: F.ascii(F.substring(counts, place(char), F.lit(1))) - 48
    changed = lambda counts, char, n: F.overlay(counts, F.chr(n + 48), place(char), F.lit(1))

    def add(acc: Column, char: Column) -> Column:
        full = F.length(acc["window"]) == width
        gone = F.substring(acc["window"], 1, 1)

        def leave(n: Column) -> Column:
            return F.struct(changed(acc["counts"], gone, n - 1).alias("counts"), (acc["sum"] - F.get(table, n) + F.get(table, n - 1)).alias("sum"))

        def enter(rest: Column) -> Column:
            made = lambda n: F.struct(changed(rest["counts"], char, n + 1).alias("counts"), (rest["sum"] - F.get(table, n) + F.get(table, n + 1)).alias("sum"))
            return let(count(rest["counts"], char), made)

        def close(new: Column) -> Column:
            end = acc["at"] + 1
            window = F.concat(F.when(full, F.substring(acc["window"], 2, width)).otherwise(acc["window"]), char)
            hot = (end >= width) & (new["sum"] <= most)
            return F.struct(
                window.alias("window"),
                new["counts"],
                new["sum"],
                end.alias("at"),
                F.coalesce(acc["first"], F.when(hot, end - width)).alias("first"),
                F.when(hot, end).otherwise(acc["last"]).alias("last"),
            )

        rest = F.when(full, let(count(acc["counts"], gone), leave)).otherwise(F.struct(acc["counts"], acc["sum"]))
        return let(let(rest, enter), close)

    return F.aggregate(F.split(run, ""), zero, add, lambda acc: F.struct(acc["first"], acc["last"]))


def _class_spans(text: Column, c: EntropyClass, allow: tuple[str, ...]) -> Column:
    cleared = "|".join(f"(?:{p})" for p in (c.unless, *allow))
    runs = F.filter(matches(text, c.run), lambda m: ~m["value"].rlike(cleared))

    def hot(m: Column) -> Column:
        place = lambda r: F.struct((m["start"] + r["first"]).alias("start"), (m["start"] + r["last"]).alias("end"))
        return let(hot_range(m["value"], c.width, c.bits), place)

    return F.filter(F.transform(runs, hot), lambda s: s["end"].isNotNull())


def entropy_spans(text: Column, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> Column:
    """(start, end) of the findings of each class."""
    return F.concat(*(_class_spans(text, c, allow) for c in classes))


def base_spans(text: Column) -> dict[str, Column]:
    """(start, end, value) of each base kind."""
    assigned = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN_VALUE, 1)) >= ASSIGN_LEAST)
    return {"assign": assigned, "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def secret_scan(df: DataFrame, text: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """df with secrets: an array of (start, rank, end, kind), sorted, places in code points.

    rank 0 to 2 are the base kinds assign, access and hex; 3 is entropy.  A
    null or empty text has none; no row is lost; a column named secrets is
    replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    by_kind = base_spans(whole) | {"entropy": entropy_spans(whole, classes, allow)}

    def ranked(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    parts = [ranked(k, kind, spans) for k, (kind, spans) in enumerate(by_kind.items())]
    return df.withColumn("secrets", F.array_sort(F.concat(*parts)))


def spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame, text: str = "text", mark: str = MARK) -> DataFrame:
    """df, which has secrets, with each secret in text replaced by mark; null texts stay null."""
    return df.withColumn(text, F.when(F.col(text).isNull(), F.col(text)).otherwise(replaced(F.col(text), F.col("secrets"), mark)))
