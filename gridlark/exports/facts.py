"""Facts as files, and snapshots: Parquet and a JSON file that together bring back a table and its cube."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.facts import FactTable
from gridlark.operators.filters import FactFilter


def _chosen(facts: FactTable, columns: list[str] | None, filter: FactFilter | None) -> DataFrame:
    return (facts.where(filter.condition(facts)) if filter else facts).rows(columns)


def write_csv(facts: FactTable, path: str, columns: list[str] | None = None, filter: FactFilter | None = None, delimiter: str = ",") -> None:
    """Files that read_csv and infer_schema bring back with the same types."""
    df = _chosen(facts, columns, filter)
    dated = {n: F.date_format(F.col(f"`{n}`"), "yyyy-MM-dd'T'HH:mm:ss.SSS") for n, k in df.dtypes if k == "timestamp_ntz"}
    df.withColumns(dated).write.option("header", True).option("sep", delimiter).option("escape", '"').option("quote", '"').option("emptyValue", "").csv(path)


def write_json(facts: FactTable, path: str, columns: list[str] | None = None, filter: FactFilter | None = None) -> None:
    """One object a line, missing values as null."""
    _chosen(facts, columns, filter).write.option("ignoreNullFields", False).json(path)


def write_snapshot(facts: FactTable, path: str, config: dict | None = None) -> None:
    """facts at path/facts as Parquet; labels and the configuration (exports.config) at path/config as text."""
    facts.rows().write.parquet(f"{path}/facts")
    meta = {"version": 1, "columns": [{"name": c.name, "type": c.type.value, "label": c.label} for c in facts.columns], "config": config}
    spark = facts.frame.sparkSession
    spark.createDataFrame([(json.dumps(meta, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{path}/config")


def read_snapshot(spark: SparkSession, path: str) -> tuple[FactTable, dict | None]:
    """Raises ValueError for another version or columns that don't fit."""
    meta = json.loads(spark.read.text(f"{path}/config").first()[0])
    if meta.get("version") != 1:
        raise ValueError(f"unsupported version {meta.get('version')}")
    facts = FactTable.of(spark.read.parquet(f"{path}/facts"), {c["name"]: c["label"] for c in meta["columns"]})
    if [(c.name, c.type.value) for c in facts.columns] != [(c["name"], c["type"]) for c in meta["columns"]]:
        raise ValueError("the columns are not those of the snapshot")
    return facts, meta["config"]
