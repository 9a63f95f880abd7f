"""A cube: two hierarchical axes of dimensions, aggregates, a filter, and which groups are open.

The plan of a cube's cells is one grouping: facts, filtered, are aggregated once
at the finest visible level; every other level comes from those groups by
grouping sets over row prefixes x column prefixes.  Depth columns, not nulls,
tell a rolled-up axis from the group of missing values.

Two or more distinct counts each have finest groups of their own, cut by the
counted dimension; whole numbers are cut into runs of 64 values, told by the
bits of one number, and each grouping set is merged on its own from a finer
one, so that no task holds a row for each value on every level.

Standard deviations merge in a second look at the finest groups: their squares
are moved to each cell's own mean, so large means lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.operators.aggregates import COUNT, Aggregate, BaseAggregate, DerivedAggregate, DistinctCountAggregate, LayoutAggregate, innermost
from gridlark.operators.dimensions import Dimension
from gridlark.operators.facts import FactTable, all_of, any_of
from gridlark.operators.filters import AndFilter, FactFilter, ValueFilter, literal
from gridlark.sources.folders import shared_folder

Path = tuple


@dataclass(frozen=True)
class AxisSort:
    """by value, nulls first or last whatever the direction; or by an aggregate.

    By an aggregate the key is the cell at key_path on the other axis (its
    summary if that isn't visible); no value is the least, and ties stay in
    ascending order of value.
    """

    by: str = "value"
    aggregate: Aggregate | None = None
    key_path: Path | None = None
    descending: bool = False
    nulls_last: bool = False

    def __post_init__(self):
        if self.by not in ("value", "aggregate") or (self.by == "aggregate") != (self.aggregate is not None):
            raise ValueError("a sort is by value, or by an aggregate that it names")


@dataclass(frozen=True)
class AxisDimension:
    dimension: Dimension
    sort: AxisSort | None = None


@dataclass(frozen=True)
class CubeAxis:
    """Dimensions from the outermost in; summary: start, end or hidden; subtotals: top, bottom or hidden."""

    dimensions: tuple[AxisDimension, ...] = ()
    summary: str = "end"
    subtotals: str = "top"

    @classmethod
    def of(cls, *dimensions: Dimension, **more) -> CubeAxis:
        return cls(tuple(d if isinstance(d, AxisDimension) else AxisDimension(d) for d in dimensions), **more)

    def __post_init__(self):
        if self.summary not in ("start", "end", "hidden") or self.subtotals not in ("top", "bottom", "hidden"):
            raise ValueError("summary is start, end or hidden; subtotals are at the top, bottom or hidden")

    def sort_at(self, level: int) -> AxisSort:
        """A level without a sort has that of the nearest one above."""
        return next((d.sort for d in reversed(self.dimensions[: level + 1]) if d.sort), AxisSort())


@dataclass(frozen=True)
class CubeSpec:
    rows: CubeAxis = field(default_factory=CubeAxis)
    columns: CubeAxis = field(default_factory=CubeAxis)
    aggregates: tuple[Aggregate, ...] = (COUNT,)
    filter: FactFilter | None = None

    def __post_init__(self):
        ids = [d.dimension.id for axis in (self.rows, self.columns) for d in axis.dimensions]
        if len(set(ids)) < len(ids):
            raise ValueError("a dimension may stand once on the axes")

    def copy_with(self, **changes) -> CubeSpec:
        return replace(self, **changes)


@dataclass(frozen=True)
class Expansion:
    """Open groups of an axis: a set of paths with all their prefixes, and every group above a depth, if there is one."""

    paths: frozenset[Path] = frozenset({()})
    depth: int | None = None

    @classmethod
    def of(cls, paths: Iterable[Path]) -> Expansion:
        return cls(frozenset(p[:k] for p in map(tuple, paths) for k in range(len(p) + 1)))

    @classmethod
    def to_depth(cls, depth: int) -> Expansion:
        """Levels 1 to depth are visible."""
        return cls(frozenset(), depth)

    @classmethod
    def collapsed(cls) -> Expansion:
        return cls(frozenset())

    def is_open(self, path: Path) -> bool:
        return (self.depth is not None and len(path) < self.depth) or tuple(path) in self.paths

    def expand(self, path: Path) -> Expansion:
        return Expansion(self._set() | Expansion.of([path]).paths)

    def collapse(self, path: Path) -> Expansion:
        return Expansion(frozenset(p for p in self._set() if p[: len(path)] != tuple(path)))

    def toggle(self, path: Path) -> Expansion:
        return self.collapse(path) if self.is_open(path) else self.expand(path)

    def expand_level(self, level: int) -> Expansion:
        """Opens every group of a level (0: the root) and above; what is open further down stays so."""
        return Expansion(self.paths, max(self.depth or 0, level + 1))

    def collapse_level(self, level: int) -> Expansion:
        """Closes the groups of a level (0: the root) and all below."""
        return Expansion(frozenset(p for p in self.paths if len(p) < level), None if self.depth is None else min(self.depth, level))

    def retain(self, keep) -> Expansion:
        return Expansion.of(p for p in self._set() if keep(p)) if self._set() else self

    def _set(self) -> frozenset[Path]:
        if self.depth is not None:
            raise ValueError("an expansion by depth has no set of paths")
        return self.paths

    def visible_depth(self, levels: int) -> int:
        return min(max([self.depth or 0, *(len(p) + 1 for p in self.paths)]), levels)

    def parent_open(self, depth: Column, values: list[Column]) -> Column:
        """Whether the group at depth with these values stands in an open group; the root always stands."""
        if self.depth is not None and not any(len(p) >= self.depth for p in self.paths):
            return depth <= self.depth
        at = [(depth == len(p) + 1) & all_of(v.eqNullSafe(literal(x)) for v, x in zip(values, p, strict=False)) for p in self.paths if len(p) <= len(values)]
        return (depth <= (self.depth or 0)) | any_of(at)


_LAST = 2**31 - 1


def _run_and_bit(value: Column, kind: T.DataType) -> tuple[Column, Column]:
    """Where a value is counted: whole numbers by a bit of their run of 64, others by the one bit of a run of their own; null has none."""
    if not isinstance(kind, T.IntegralType):
        return value, F.when(value.isNotNull(), F.lit(1).cast("long"))
    at = value.cast("long")
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


@dataclass(frozen=True)
class _Axis:
    """An axis of the plan: side is r or c, levels the visible ones."""

    side: str
    axis: CubeAxis
    expansion: Expansion
    levels: int

    @property
    def depth(self) -> str:
        return f"{self.side}d"

    def names(self, upto: int | None = None) -> list[str]:
        return [f"{self.side}{k}" for k in range(self.levels if upto is None else upto)]


#: Cells up to which a layout is worked out in one task, from a copy on the driver; larger ones are dealt out.
SMALL_LAYOUT = 20_000


class Cube:
    """Frames of a cube; none holds more rows than the visible layout.

    cells and table() are lazy.  Entries and grids are worked out over the
    cells, which are computed when the first of them is asked for.
    """

    def __init__(self, facts: FactTable, spec: CubeSpec, rows: Expansion | None = None, columns: Expansion | None = None, base: DataFrame | None = None):
        self.facts, self.spec = facts, spec
        #: Finest groups of all dimensions, as prepared() stores them.
        self._base = base
        self.row_expansion = rows if rows is not None else Expansion()
        self.column_expansion = columns if columns is not None else Expansion()
        levels = lambda e, axis: e.visible_depth(len(axis.dimensions))
        self._rows = _Axis("r", spec.rows, self.row_expansion, levels(self.row_expansion, spec.rows))
        self._columns = _Axis("c", spec.columns, self.column_expansion, levels(self.column_expansion, spec.columns))

    # Aggregates

    @cached_property
    def _order(self) -> list[Aggregate]:
        """Every aggregate needed, dependencies first, each once."""
        found: dict[str, Aggregate] = {}

        def add(a: Aggregate) -> None:
            if a.id not in found:
                for d in a.dependencies(self.facts):
                    add(d)
                found[a.id] = a

        for a in (COUNT, *self.spec.aggregates):
            add(a)
        for axis in (self.spec.rows, self.spec.columns):
            for d in axis.dimensions:
                if d.sort and d.sort.aggregate:
                    a = innermost(d.sort.aggregate)
                    if a.id not in found:
                        raise ValueError(f"sorted by {a.id}, which the cube doesn't have")
        return list(found.values())

    def _name(self, a: Aggregate) -> str:
        return f"a{[x.id for x in self._order].index(a.id)}"

    # Cells

    def _with(self, rows: Expansion | None = None, columns: Expansion | None = None) -> Cube:
        return Cube(self.facts, self.spec, rows if rows is not None else self.row_expansion, columns if columns is not None else self.column_expansion, self._base)

    @cached_property
    def _filtered(self) -> FactTable:
        return self.facts.where(self.spec.filter.condition(self.facts)) if self.spec.filter else self.facts

    @cached_property
    def _distinct(self) -> list[DistinctCountAggregate]:
        return [a for a in self._order if isinstance(a, DistinctCountAggregate)]

    def _keys(self, every: bool = False) -> dict[str, Column]:
        """Columns of the visible dimensions, or of all."""
        found = {}
        for axis in (self._rows, self._columns):
            names = axis.names(len(axis.axis.dimensions) if every else None)
            for name, d in zip(names, axis.axis.dimensions, strict=False):
                found[name] = d.dimension.column(self._filtered)
        return found

    @cached_property
    def _partials(self) -> dict:
        found: dict = {}
        for a in self._order:
            if isinstance(a, BaseAggregate) and a not in self._distinct:
                found |= a.partials(self._filtered)
        return found

    @property
    def _state_names(self) -> dict[str, str]:
        return {name: f"s{k}" for k, name in enumerate(self._partials)}

    def groups(self, counted: list[DistinctCountAggregate], every: bool = False) -> DataFrame:
        """The finest groups with their states, cut by the counted dimensions, too; of all dimensions or the visible ones."""
        return self._grouped_facts(self._keys(every) | {self._name(a): a.dimension.column(self._filtered) for a in counted}, [])

    def _grouped_facts(self, keys: dict[str, Column], more: list[Column]) -> DataFrame:
        grouped = self._filtered.frame.groupBy(*(c.alias(n) for n, c in keys.items()))
        return grouped.agg(*(fold.alias(f"s{k}") for k, (fold, _) in enumerate(self._partials.values())), *more)

    @cached_property
    def _finest(self) -> DataFrame:
        """The finest groups of the cells, cut by the runs of a lone distinct count."""
        if self._base is not None:
            return self._base
        if len(self._distinct) != 1:
            return self.groups([])
        a = self._distinct[0]
        value = a.dimension.column(self._filtered)
        run, bit = _run_and_bit(value, self._filtered.frame.select(value).schema[0].dataType)
        return self._grouped_facts(self._keys() | {self._name(a): run}, [F.bit_or(bit).alias(self._bits(a))])

    def prepared(self) -> Cube:
        """This cube over stored groups of all its dimensions: what is opened and closed later reads no facts.

        Worth it where the groups are few against the facts.
        """
        path = shared_folder(self.facts.frame.sparkSession)
        found = self.groups(self._distinct, every=True)
        found.write.parquet(path)
        return Cube(self.facts, self.spec, self.row_expansion, self.column_expansion, found.sparkSession.read.schema(found.schema).parquet(path))

    @cached_property
    def cells(self) -> DataFrame:
        """rd, r0.., cd, c0.., and a column for each base and derived aggregate: one row for each cell with facts."""
        apart = {} if len(self._distinct) < 2 else {a: self._of_counted(a) for a in self._distinct}
        return self._rolled_up(self._finest, apart)

    def _bits(self, a: DistinctCountAggregate) -> str:
        return f"b_{self._name(a)}"

    def _marked(self, frame: DataFrame, a: DistinctCountAggregate) -> DataFrame:
        """frame with a's values turned into their runs and bits."""
        name = self._name(a)
        run, bit = _run_and_bit(F.col(name), frame.schema[name].dataType)
        return frame.withColumns({name: run, self._bits(a): bit})

    def _of_counted(self, a: DistinctCountAggregate) -> DataFrame:
        """The runs of a's values in each finest group, with the bits of those that are there."""
        keys, name = self._keys(), self._name(a)
        if self._base is not None:
            values = self._base.select(*keys, name)
        else:
            values = self._filtered.frame.select(*(c.alias(n) for n, c in (keys | {name: a.dimension.column(self._filtered)}).items()))
        return self._run_groups(self._marked(values.where(F.col(name).isNotNull()), a), [], a)

    def over_groups(self, finest: DataFrame) -> DataFrame:
        """table() from finest groups that were aggregated elsewhere, as a stream's are: see groups()."""
        return self._labelled_cells(self._rolled_up(finest, {}), lambda i: i)

    @property
    def _sets(self) -> list[list[str]]:
        rows, columns = self._rows, self._columns
        return [rows.names(i) + columns.names(j) for i in range(rows.levels + 1) for j in range(columns.levels + 1)]

    def _grouped(self, frame: DataFrame, made: list[Column]) -> DataFrame:
        """_bits (which keys are rolled up), keys, and made over the grouping sets."""
        keys = self._rows.names() + self._columns.names()
        if keys:
            return frame.groupingSets(self._sets, *keys).agg(F.grouping_id().alias("_bits"), *made)
        return frame.agg(*made).withColumn("_bits", F.lit(0).cast("long"))

    def _place(self, of: list[str], kinds: T.StructType) -> list[Column]:
        """_bits and keys of a grouping set, as grouping sets have them."""
        keys = self._rows.names() + self._columns.names()
        bits = sum(1 << (len(keys) - 1 - k) for k, name in enumerate(keys) if name not in of)
        return [F.lit(bits).cast("long").alias("_bits"), *((F.col(n) if n in of else F.lit(None).cast(kinds[n].dataType)).alias(n) for n in keys)]

    def _run_groups(self, frame: DataFrame, made: list[Column], a: DistinctCountAggregate) -> DataFrame:
        """frame by keys and runs, its states merged by made."""
        name, bits = self._name(a), self._bits(a)
        return frame.groupBy(*self._rows.names(), *self._columns.names(), name).agg(*made, F.bit_or(bits).alias(bits))

    def _counted(self, frame: DataFrame, made: list[Column], a: DistinctCountAggregate) -> DataFrame:
        """_grouped for merges of states, with a's count as n_, from groups by keys and runs.

        Each set takes its runs from a set with one key more and is merged on
        its own: no task holds the runs of several sets at once.
        """
        rows, columns = self._rows, self._columns
        name, bits = self._name(a), self._bits(a)
        runs: dict[tuple[int, int], DataFrame] = {}
        for i in range(rows.levels, -1, -1):
            for j in range(columns.levels, -1, -1):
                wider = runs.get((i, j + 1), runs.get((i + 1, j)))
                if wider is None:
                    runs[i, j] = frame
                else:
                    runs[i, j] = wider.groupBy(*rows.names(i), *columns.names(j), name).agg(*made, F.bit_or(bits).alias(bits))
        states = [n for n in frame.columns if n in self._state_names.values()]
        placed = [f.select(*self._place(rows.names(i) + columns.names(j), frame.schema), *states, bits) for (i, j), f in runs.items()]
        cells = reduce(DataFrame.union, placed).groupBy("_bits", *rows.names(), *columns.names())
        found = cells.agg(*made, F.coalesce(F.sum(F.bit_count(bits)), F.lit(0)).alias(f"n_{name}"))
        once = frame.agg(*made).schema if made else T.StructType()  # sums of decimals widen with every merge
        return found.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in once})

    def _joined(self, cells: DataFrame, more: DataFrame, columns: list[str]) -> DataFrame:
        """cells with columns of more, both by _bits and keys; null keys are equal."""
        names = ["_bits", *self._rows.names(), *self._columns.names()]
        more = more.select(*(F.col(n).alias(f"_of{n}") for n in names), *columns)
        return cells.join(more, all_of(F.col(n).eqNullSafe(F.col(f"_of{n}")) for n in names), "left").drop(*(f"_of{n}" for n in names))

    def _rolled_up(self, finest: DataFrame, apart: dict[DistinctCountAggregate, DataFrame]) -> DataFrame:
        rows, columns = self._rows, self._columns
        made, spread = [], []
        for k, (_, merge) in enumerate(self._partials.values()):
            state = F.col(f"s{k}")
            if merge is None:
                spread.append(f"s{k}")
                n = F.sum(state["n"])
                made.append(F.struct(n.alias("n"), (F.sum(state["n"] * state["mean"]) / F.nullif(n, F.lit(0))).alias("mean")).alias(f"s{k}"))
            else:
                made.append(merge(state).alias(f"s{k}"))
        together = [a for a in self._distinct if a not in apart]
        if len(together) == 1:
            a = together[0]
            runs = finest if self._bits(a) in finest.columns else self._run_groups(self._marked(finest, a), made, a)
            # The squares of moments are taken from the finest groups later.
            grouped = self._counted(runs.withColumns({s: F.struct(F.col(s)["n"].alias("n"), F.col(s)["mean"].alias("mean")) for s in spread}), made, a)
        else:
            grouped = self._grouped(finest, made + [F.count_distinct(F.col(self._name(a))).alias(f"n_{self._name(a)}") for a in together])
        depth = lambda names, shift: len(names) - F.bit_count(F.shiftright("_bits", shift).bitwiseAND(F.lit((1 << len(names)) - 1)))
        placed = grouped.withColumns({"rd": depth(rows.names(), columns.levels).cast("int"), "cd": depth(columns.names(), 0).cast("int")})
        visible = placed.where(self._state("facts") > 0)
        for axis in (rows, columns):
            visible = visible.where(axis.expansion.parent_open(F.col(axis.depth), [F.col(n) for n in axis.names()]))
        for a, frame in apart.items():
            name = f"n_{self._name(a)}"
            visible = self._joined(visible, self._counted(frame, [], a), [name]).na.fill(0, [name])
        if spread:
            visible = self._with_squares(visible, finest, spread)
        return self._valued(visible).select("rd", *rows.names(), "cd", *columns.names(), *(self._name(a) for a in self._plain))

    def _with_squares(self, cells: DataFrame, finest: DataFrame, spread: list[str]) -> DataFrame:
        """cells, whose spread states have n and mean, with m2: the groups' own and those of their means about the cell's."""
        keys = self._rows.names() + self._columns.names()
        places = [F.struct(*self._place(of, finest.schema)) for of in self._sets]
        parts = finest.select(F.explode(F.array(*places)).alias("_at"), *spread).select("_at.*", *(F.col(s).alias(f"_{s}") for s in spread))
        means = cells.select("_bits", *keys, *(F.col(s)["mean"].alias(f"_mean_{s}") for s in spread))
        moved = lambda s: F.col(f"_{s}")["m2"] + F.col(f"_{s}")["n"] * F.pow(F.col(f"_{s}")["mean"] - F.col(f"_mean_{s}"), F.lit(2))
        met = self._joined(parts, means, [f"_mean_{s}" for s in spread])
        squares = met.groupBy("_bits", *keys).agg(*(F.sum(moved(s)).alias(f"_m2_{s}") for s in spread))
        found = self._joined(cells, squares, [f"_m2_{s}" for s in spread])
        return found.withColumns({s: F.struct(F.col(s)["n"].alias("n"), F.col(s)["mean"].alias("mean"), F.col(f"_m2_{s}").alias("m2")) for s in spread})

    @cached_property
    def _held(self) -> tuple[DataFrame, bool]:
        """cells, for the several parts of a layout, and whether they are few.

        Few cells are copied to the driver, from where one task works out the
        layout without a shuffle; more are stored in the shared folder.
        """
        spark = self.facts.frame.sparkSession
        few = self.cells.limit(SMALL_LAYOUT + 1).toArrow()
        if few.num_rows <= SMALL_LAYOUT:
            return spark.createDataFrame(few, self.cells.schema).coalesce(1), True
        path = shared_folder(spark)
        self.cells.write.parquet(path)
        return spark.read.schema(self.cells.schema).parquet(path), False

    @property
    def _kept(self) -> DataFrame:
        return self._held[0]

    def _state(self, name: str) -> Column:
        return F.col(self._state_names[name])

    @property
    def _plain(self) -> list[Aggregate]:
        return [a for a in self._order if not isinstance(a, LayoutAggregate)]

    def _valued(self, frame: DataFrame) -> DataFrame:
        """The base aggregates from their states, then the formulas that need no layout."""
        base = {}
        for a in self._order:
            if isinstance(a, DistinctCountAggregate):
                base[self._name(a)] = F.col(f"n_{self._name(a)}")
            elif isinstance(a, BaseAggregate):
                base[self._name(a)] = a.result(self._state)
        return self._derived(frame.drop(*(n for n in base if n in frame.columns)).withColumns(base))

    def _derived(self, frame: DataFrame) -> DataFrame:
        for a in self._order:
            if isinstance(a, DerivedAggregate):
                frame = frame.withColumn(self._name(a), a.value(self.facts, lambda x: F.col(self._name(x))))
        return frame

    # Axes

    def _entries(self, axis: _Axis, other: _Axis) -> DataFrame:
        """Groups of an axis: depth, values, facts, ord (sibling ordinals from the root), open."""
        cells = self._kept
        own = cells.where(F.col(other.depth) == 0)
        facts = self._name(COUNT)
        level = own.where(F.col(axis.depth) == 0).select(*[F.col(n) for n in axis.names()], F.col(facts).alias("facts"), F.array().cast("array<int>").alias("ord"))
        levels = [level.withColumn("depth", F.lit(0))]
        for d in range(1, axis.levels + 1):
            here = own.where(F.col(axis.depth) == d)
            sort = axis.axis.sort_at(d - 1)
            value = F.col(f"{axis.side}{d - 1}")
            if sort.by == "value":
                order = [value.isNull() if sort.nulls_last else value.isNotNull(), value.desc() if sort.descending else value.asc()]
                here = here.select(*axis.names(), F.col(facts).alias("facts"))
            else:
                here = self._keyed(here, axis, other, sort).select(*axis.names(), F.col(facts).alias("facts"), "_key")
                key = F.col("_key").desc_nulls_last() if sort.descending else F.col("_key").asc_nulls_first()
                order = [key, value.asc_nulls_first()]
            parent = axis.names(d - 1)
            if parent:
                here = here.withColumn("_o", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)))
            else:
                here = self._numbered(here, order, "_o")
            here = here.drop("_key")
            above = levels[-1].select(*(F.col(n).alias(f"_{n}") for n in parent), F.col("ord").alias("_ord"))
            if parent:
                here = here.join(above, all_of(F.col(n).eqNullSafe(F.col(f"_{n}")) for n in parent))
                here = here.withColumn("ord", F.concat("_ord", F.array("_o")))
            else:
                here = here.withColumn("ord", F.array("_o"))
            levels.append(here.select(*axis.names(), "facts", "ord").withColumn("depth", F.lit(d)))
        found = reduce(DataFrame.unionByName, levels)
        inner = F.col("depth") < axis.levels
        is_open = axis.expansion.parent_open(F.col("depth") + 1, [F.col(n) for n in axis.names()])
        return found.withColumn("open", inner & is_open)

    def _keyed(self, here: DataFrame, axis: _Axis, other: _Axis, sort: AxisSort) -> DataFrame:
        """here with _key: the sort's aggregate at its key path."""
        name = self._name(innermost(sort.aggregate))  # type: ignore[arg-type]
        path = sort.key_path or ()
        at = (F.col(other.depth) == len(path)) & all_of(F.col(n).eqNullSafe(literal(v)) for n, v in zip(other.names(), path, strict=False))
        if not path or len(path) > other.levels or self._kept.where((F.col(axis.depth) == 0) & at).isEmpty():
            return here.withColumn("_key", F.col(name))
        keys = self._kept.where(at).where(F.col(axis.depth).isNotNull()).select(F.col(axis.depth).alias("_d"), *(F.col(n).alias(f"_{n}") for n in axis.names()), F.col(name).alias("_key"))
        on = (F.col(axis.depth) == F.col("_d")) & all_of(F.col(n).eqNullSafe(F.col(f"_{n}")) for n in axis.names())
        return here.join(keys, on, "left")

    def _displayed(self, axis: _Axis, other: _Axis) -> DataFrame:
        """_entries with has_entry and pos, the place in display order (from 0; null for hidden ones)."""
        e = self._entries(axis, other)
        last = F.array(F.lit(_LAST))
        root = F.col("depth") == 0
        summary, subtotals = axis.axis.summary, axis.axis.subtotals
        # A lone summary of a collapsed axis is an entry like any other.
        hidden = F.when(root, F.lit(summary == "hidden")).otherwise(F.col("open") & F.lit(subtotals == "hidden"))
        below = F.when(root, F.lit(summary == "end")).otherwise(F.col("open") & F.lit(subtotals == "bottom"))
        e = e.withColumns({"has_entry": ~hidden, "_place": F.when(below, F.concat("ord", last)).otherwise(F.col("ord"))})
        shown = self._numbered(e.where("has_entry"), [F.col("_place").asc()], "pos").withColumn("pos", (F.col("pos") - 1).cast("int"))
        return shown.unionByName(e.where("not has_entry").withColumn("pos", F.lit(None).cast("int"))).drop("_place")

    def _numbered(self, frame: DataFrame, order: list[Column], name: str) -> DataFrame:
        """frame with its rows' numbers, from 1, in an order without ties.

        A small layout's rows are sorted by one task.  Others are dealt out by
        range and stored; each part counts its own rows, on top of those before.
        """
        if self._held[1]:
            return frame.withColumn(name, F.row_number().over(Window.orderBy(*order)))
        spark = frame.sparkSession
        path = shared_folder(spark)
        frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
        dealt = spark.read.parquet(path)
        parts = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
        before, total = [], 0
        for part, n in parts:
            before.append((part, total))
            total += n
        starts = F.broadcast(spark.createDataFrame(before, "_part int, _before long"))
        within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
        return dealt.join(starts, "_part").withColumn(name, (within + F.col("_before")).cast("int")).drop("_part", "_before")

    @cached_property
    def row_entries(self) -> DataFrame:
        """depth, r0.., facts, ord, open, has_entry, pos."""
        return self._displayed(self._rows, self._columns)

    @cached_property
    def column_entries(self) -> DataFrame:
        """depth, c0.., facts, ord, open, has_entry, pos."""
        return self._displayed(self._columns, self._rows)

    # Looking things up in a layout

    def _side(self, side: str) -> tuple[_Axis, DataFrame]:
        if side not in ("rows", "columns"):
            raise ValueError("a side is rows or columns")
        return (self._rows, self.row_entries) if side == "rows" else (self._columns, self.column_entries)

    def entry_for(self, side: str, path: Path) -> Row | None:
        """The entry of a visible group, shown or hidden; None if there is none."""
        axis, entries = self._side(side)
        if len(path) > axis.levels:
            return None
        same = all_of(F.col(n).eqNullSafe(literal(v)) for n, v in zip(axis.names(), path, strict=False))
        return entries.where((F.col("depth") == len(path)) & same).first()

    def index_of(self, side: str, path: Path) -> int:
        """The place of a group's entry in display order; -1 if it has none."""
        found = self.entry_for(side, path)
        return -1 if found is None or found["pos"] is None else found["pos"]

    def cell_at(self, row: int, column: int) -> Row | None:
        """The cell at two places in display order."""
        return self.result(hidden=False).where((F.col("row_pos") == row) & (F.col("column_pos") == column)).first()

    def cell_for(self, row: Path = (), column: Path = ()) -> Row | None:
        """The cell of two paths; None if one of them has no entry."""
        i, j = self.index_of("rows", row), self.index_of("columns", column)
        return self.cell_at(i, j) if i >= 0 and j >= 0 else None

    def _prefixes(self, entries: DataFrame) -> DataFrame:
        """(at, first, n): the places that the shown entries of a group and of its descendants take, by the group's ord."""
        shown = entries.where("has_entry and depth > 0")
        every = shown.select("pos", F.explode(F.transform(F.sequence(F.lit(1), "depth"), lambda k: F.slice("ord", 1, k))).alias("at"))
        return every.groupBy("at").agg(F.min("pos").alias("first"), F.count(F.lit(1)).cast("int").alias("n"))

    def descendant_counts(self, side: str) -> DataFrame:
        """(pos, descendants): shown entries below each shown entry; 0 for the summary."""
        _, entries = self._side(side)
        runs = self._prefixes(entries)
        found = entries.where("has_entry").join(runs, F.col("ord") == F.col("at"), "left")
        return found.select("pos", F.when(F.col("depth") == 0, 0).otherwise(F.coalesce(F.col("n"), F.lit(1)) - 1).alias("descendants"))

    def header_areas(self, side: str) -> DataFrame:
        """(level, pos, depth, entry, level_start, level_span, entry_start, entry_span, is_label) of every header place.

        An open group's label spans its whole run of entries on its level, with
        a blank leg below it on its own row; any other label goes down to the
        last level, the summary's over all of them.  depth and entry tell whose
        area it is (entry -1: a group without an entry of its own).
        """
        axis, entries = self._side(side)
        levels = len(axis.axis.dimensions)
        shown = entries.where("has_entry").select("pos", "depth", "ord", (F.col("open") & (F.col("depth") < levels)).alias("open"))
        places = shown.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(levels, 1) - 1))))
        # Whose area it is: an ancestor's above the entry's own level, else its own.
        places = places.withColumn("owner", F.least(F.col("level") + 1, "depth"))
        runs = self._prefixes(entries)
        own = shown.where("depth > 0").select(F.col("ord").alias("_own"), F.col("pos").alias("entry"))
        at = F.slice("ord", 1, F.col("owner"))
        met = places.withColumn("_at", at).join(runs, F.col("_at") == F.col("at"), "left").join(own, F.col("_at") == F.col("_own"), "left")
        root, above, label = F.col("depth") == 0, F.col("level") < F.col("depth") - 1, F.col("level") == F.col("depth") - 1
        run = above | (label & F.col("open"))
        leg = ~root & ~above & ~label & F.col("open")
        level_start = F.when(root, 0).when(run, F.col("level")).when(leg, F.col("depth")).otherwise(F.col("depth") - 1)
        level_span = F.when(root, max(levels, 1)).when(run, 1).when(leg, levels - F.col("depth")).otherwise(levels - F.col("depth") + 1)
        return met.select(
            "level",
            "pos",
            F.col("owner").alias("depth"),
            F.when(root, F.col("pos")).otherwise(F.coalesce("entry", F.lit(-1))).alias("entry"),
            level_start.cast("int").alias("level_start"),
            level_span.cast("int").alias("level_span"),
            F.when(run, F.col("first")).otherwise(F.col("pos")).alias("entry_start"),
            F.when(run, F.col("n")).otherwise(1).alias("entry_span"),
            (~leg).alias("is_label"),
        )

    # The grid

    @cached_property
    def grid(self) -> DataFrame:
        """Every visible row x column: rd, r0.., rpos, ro, cd, c0.., cpos, co, facts, all aggregates.

        Its size is the layout's own.  Cells without facts have facts 0, counts
        0 and other aggregates null before formulas are worked out.
        """
        from gridlark.plans.values import with_layout_values

        def side(entries: DataFrame, axis: _Axis) -> DataFrame:
            s = axis.side
            return entries.select(
                F.col("depth").alias(f"{s}d"), *axis.names(), F.col("ord").alias(f"{s}o"), F.col("pos").alias(f"{s}pos"), F.col("open").alias(f"{s}open")
            )

        rows, columns = side(self.row_entries, self._rows), side(self.column_entries, self._columns)
        names = [self._name(a) for a in self._order if isinstance(a, BaseAggregate)]
        cells = self._kept.select("rd", *self._rows.names(), "cd", *self._columns.names(), *names)
        for entries, axis in ((rows, self._rows), (columns, self._columns)):
            s = axis.side
            keys = entries.select(F.col(f"{s}d").alias("_d"), *(F.col(n).alias(f"_{n}") for n in axis.names()), F.col(f"{s}o").alias(f"_{s}o"))
            on = (F.col(f"{s}d") == F.col("_d")) & all_of(F.col(n).eqNullSafe(F.col(f"_{n}")) for n in axis.names())
            cells = cells.join(keys, on).drop("_d", *axis.names(), f"{s}d", *(f"_{n}" for n in axis.names()))
        dense = rows.crossJoin(F.broadcast(columns) if columns.count() <= SMALL_LAYOUT else columns)
        dense = dense.join(cells, (F.col("ro") == F.col("_ro")) & (F.col("co") == F.col("_co")), "left").drop("_ro", "_co")
        zeros = {self._name(a): F.coalesce(self._name(a), F.lit(0)) for a in self._order if isinstance(a, BaseAggregate) and a.counts}
        dense = self._derived(dense.withColumns(zeros))
        dense = dense.withColumn("facts", F.col(self._name(COUNT)))
        return with_layout_values(dense, [a for a in self._order if isinstance(a, LayoutAggregate)], self._name, self._rows.levels, self._columns.levels)

    def result(self, names: dict[str, str] | None = None, hidden: bool = False) -> DataFrame:
        """The grid under readable names: row_depth, row values by dimension id, row_pos, and so on.

        names renames dimension and aggregate ids.  Hidden totals are left out unless asked for.
        """
        of = lambda i: (names or {}).get(i, i)
        g = self.grid if hidden else self.grid.where(F.col("rpos").isNotNull() & F.col("cpos").isNotNull())
        return g.select(*self._labelled(of), F.col("rpos").alias("row_pos"), F.col("cpos").alias("column_pos"), "facts", *(F.col(self._name(a)).alias(of(a.id)) for a in self.spec.aggregates))

    def table(self, names: dict[str, str] | None = None) -> DataFrame:
        """The cells with facts under readable names, in no order: the cheapest result."""
        of = lambda i: (names or {}).get(i, i)
        layout = [a for a in self.spec.aggregates if isinstance(a, LayoutAggregate)]
        if layout:
            raise ValueError("layout aggregates need the grid: see result()")
        return self._labelled_cells(self.cells, of)

    def _labelled_cells(self, cells: DataFrame, of) -> DataFrame:
        return cells.select(*self._labelled(of), *(F.col(self._name(a)).alias(of(a.id)) for a in self.spec.aggregates))

    def _labelled(self, of) -> list[Column]:
        named = []
        for word, axis in (("row", self._rows), ("column", self._columns)):
            named.append(F.col(f"{axis.side}d").alias(f"{word}_depth"))
            named += [F.col(n).alias(of(d.dimension.id)) for n, d in zip(axis.names(), axis.axis.dimensions, strict=False)]
        return named

    # Expansion

    def toggle_row(self, path: Path) -> Cube:
        return self._with(rows=self.row_expansion.toggle(path))

    def toggle_column(self, path: Path) -> Cube:
        return self._with(columns=self.column_expansion.toggle(path))

    def expand_to_depth(self, rows: int | None = None, columns: int | None = None) -> Cube:
        return self._with(
            Expansion.to_depth(rows) if rows is not None else None,
            Expansion.to_depth(columns) if columns is not None else None,
        )

    def expand_level(self, side: str, level: int) -> Cube:
        """Every group of a level (0: of the first dimension) opened, and those above."""
        if side == "rows":
            return self._with(rows=self.row_expansion.expand_level(level + 1))
        return self._with(columns=self.column_expansion.expand_level(level + 1))

    def collapse_level(self, side: str, level: int) -> Cube:
        if side == "rows":
            return self._with(rows=self.row_expansion.collapse_level(level + 1))
        return self._with(columns=self.column_expansion.collapse_level(level + 1))

    def added_by_expanding_level(self, side: str, level: int) -> int:
        """Entries that expand_level would add; no cell is computed for it."""

        def entries(cube: Cube) -> int:
            axis, expansion = (cube.spec.rows, cube.row_expansion) if side == "rows" else (cube.spec.columns, cube.column_expansion)
            plain = replace(axis, dimensions=tuple(AxisDimension(d.dimension) for d in axis.dimensions))
            alone = Cube(cube.facts, CubeSpec(rows=plain, filter=cube.spec.filter), expansion)
            return alone.row_entries.where("has_entry").count()

        return entries(self.expand_level(side, level)) - entries(self)

    def child_counts(self, side: str = "rows") -> DataFrame:
        """(depth, values.., children): groups on the next level of each visible group that has one, open or not."""
        axis = self._rows if side == "rows" else self._columns
        dims = [d.dimension for d in axis.axis.dimensions]
        upto = min(axis.levels + 1, len(dims))
        named = [d.column(self._filtered).alias(f"{axis.side}{k}") for k, d in enumerate(dims[:upto])]
        groups = (self._base.select(*(f"{axis.side}{k}" for k in range(upto))) if self._base is not None else self._filtered.frame.select(*named)).distinct()
        parts = []
        for d in range(upto):
            own = groups.select(*(f"{axis.side}{k}" for k in range(d + 1))).distinct()
            counted = own.groupBy(*(f"{axis.side}{k}" for k in range(d))).agg(F.count(F.lit(1)).alias("children"))
            rest = [F.lit(None).cast(groups.schema[f"{axis.side}{k}"].dataType).alias(f"{axis.side}{k}") for k in range(d, axis.levels)]
            shown = axis.expansion.parent_open(F.lit(d), [F.col(f"{axis.side}{k}") for k in range(d)])
            parts.append(counted.where(shown).select(F.lit(d).alias("depth"), *(f"{axis.side}{k}" for k in range(d)), *rest, "children"))
        return reduce(DataFrame.unionByName, parts)

    # Drill-through

    def cell_filter(self, row: Path = (), column: Path = ()) -> FactFilter:
        """The cube's filter and the values that pin a cell."""
        pinned = [ValueFilter(d.dimension, (v,)) for axis, path in ((self.spec.rows, row), (self.spec.columns, column)) for d, v in zip(axis.dimensions, path, strict=False)]
        return AndFilter(tuple(([self.spec.filter] if self.spec.filter else []) + pinned))

    def fact_rows(self, row: Path = (), column: Path = (), names: Iterable[str] | None = None) -> DataFrame:
        """The facts of a cell."""
        return self.facts.where(self.cell_filter(row, column).condition(self.facts)).rows(names)
