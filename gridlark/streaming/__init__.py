"""Cubes over streams: the finest groups are a streaming aggregation, the layout is read from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from gridlark.operators.facts import FactTable
from gridlark.plans.cube import Cube, CubeSpec, Expansion


def start_cube(
    stream: DataFrame,
    spec: CubeSpec,
    on_update: Callable[[DataFrame, int], None],
    checkpoint: str,
    rows: Expansion | None = None,
    columns: Expansion | None = None,
    available_now: bool = False,
):
    """Calls on_update(table, batch) with the cube of everything seen whenever new facts have come.

    The stream keeps one row of partial states for each finest group, which
    merge exactly as in a batch cube.
    """
    cube = Cube(FactTable.of(stream), spec, rows, columns)
    finest = cube.groups(cube._distinct)

    def batch(groups: DataFrame, number: int) -> None:
        on_update(cube.over_groups(groups), number)

    writer = finest.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
