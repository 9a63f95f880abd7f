"""Places of regular-expression matches, and what is built from places, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlark.llm.common import let

_FOUND = "array<struct<start:int,end:int,value:string>>"
#: Items of a block: lists are copied as they grow, so they grow in blocks only.
BLOCK = 128


def scanned(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    merge: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    none: Column,
) -> Column:
    """What emit(state, item) gives for each item in order, as one array; emit gives an array, none is an empty one.

    The state goes from item to item by step.  Blocks of items are summed up
    first, so that each block's first state is known and its list is built
    alone: work is linear but for a sum over blocks.
    """

    def within(block: Column, state: Column) -> Column:
        start = F.struct(state.alias("state"), none.alias("out"))
        add = lambda acc, item: F.struct(step(acc["state"], item).alias("state"), F.concat(acc["out"], emit(acc["state"], item)).alias("out"))
        return F.aggregate(block, start, add, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, zero, step))
        before = lambda sums, b: F.aggregate(F.slice(sums, F.lit(1), b), zero, merge)
        return let(sums, lambda sums: F.flatten(F.transform(blocks, lambda block, b: within(block, before(sums, b)))))

    def cut(items: Column) -> Column:
        last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(items) > 0, let(blocks, joined)).otherwise(none)

    return let(items, cut)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value), in code points, end exclusive.

    Splitting at the pattern gives the gaps between matches, so places are
    running sums of gap and match lengths.  pattern (Java's dialect) must not
    match the empty string.
    """

    def of(parts: Column) -> Column:
        steps = F.transform(parts["hits"], lambda hit, i: F.struct(F.length(F.get(parts["gaps"], i)).alias("gap"), hit.alias("hit"), F.length(hit).alias("size")))

        def one(at: Column, s: Column) -> Column:
            start = at + s["gap"]
            return F.array(F.struct(start.alias("start"), (start + s["size"]).alias("end"), s["hit"].alias("value")))

        none = F.array().cast(_FOUND)
        return scanned(steps, F.lit(0), lambda at, s: at + s["gap"] + s["size"], lambda a, b: a + b, one, none)

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("hits"))
    return F.when(text.rlike(pattern), let(parts, of)).otherwise(F.array().cast(_FOUND))


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping or touching spans (start, end; sorted by start) replaced by mark.

    A text is cut at places of spans once for each block of them, then each
    part by itself, as finding a place takes a walk from the part's start.
    """
    high = lambda spans: F.array_max(F.transform(spans, lambda s: s["end"]))

    def pieces(part: Column, spans: Column, first: Column, at: Column) -> Column:
        """part begins at first; at: the end of what is replaced so far."""
        zero = F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))

        def add(acc: Column, s: Column) -> Column:
            same = (s["start"] < acc["at"]) | ((s["start"] == acc["at"]) & (acc["at"] > 0))
            gap = F.substring(part, acc["at"] - first + 1, s["start"] - acc["at"])
            out = F.when(same, acc["out"]).otherwise(F.concat(acc["out"], F.array(gap, F.lit(mark))))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        return F.aggregate(spans, zero, add, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, high)

        def block(ends: Column, spans: Column, b: Column) -> Column:
            at = F.coalesce(F.array_max(F.slice(ends, F.lit(1), b)), F.lit(0))
            return let(at, lambda at: let(F.substring(text, at + 1, F.greatest(F.lit(0), high(spans) - at)), lambda part: pieces(part, spans, at, at)))

        made = lambda ends: F.flatten(F.transform(blocks, lambda spans, b: block(ends, spans, b)))
        return let(ends, lambda ends: F.concat(F.array_join(made(ends), ""), F.substring(text, F.array_max(ends) + 1, F.length(text))))

    def cut(spans: Column) -> Column:
        last = F.floor((F.size(spans) - 1) / BLOCK).cast("int")
        return let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))), joined)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, cut))
