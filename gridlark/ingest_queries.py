"""Registered queries of import and export: files are written beside the checkpoints and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.exports.facts import read_snapshot, write_csv, write_json, write_snapshot
from gridlark.exports.grid import json_records
from gridlark.operators.aggregates import sum_of
from gridlark.operators.dimensions import ColumnDimension
from gridlark.operators.facts import FactTable
from gridlark.plans.cube import Cube, CubeAxis, CubeSpec
from gridlark.sources.folders import shared_folder
from gridlark.sources.ingest import infer_schema, load_facts
from gridlark.sources.readers import CsvOptions, flattened, read_csv, read_jsonl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@_query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def csv_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    write_csv(FactTable.of(spark.read.parquet(f"{sf_dir}/orders.parquet")), path, columns)
    facts, _ = load_facts(read_csv(spark, path))
    return facts.rows().withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@_query(
    "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'key' ELSE 'k' || o_orderkey END AS key, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'said' WHEN o_orderkey % 5 = 0 THEN 'a, \"b\"' ELSE o_orderpriority END AS said FROM orders"
)
def csv_skip_lines(spark, sf_dir):
    """The first line of each file is cut by its place; later lines that are just like it stay."""
    path = shared_folder(spark)
    key = F.when(F.col("o_orderkey") % 7 == 0, F.lit("key")).otherwise(F.concat(F.lit("k"), "o_orderkey"))
    said = F.when(F.col("o_orderkey") % 7 == 0, F.lit("said")).when(F.col("o_orderkey") % 5 == 0, F.lit('a, "b"')).otherwise(F.col("o_orderpriority"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("key"), said.alias("said"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    facts, _ = load_facts(read_csv(spark, path, CsvOptions(has_header=False, skip_leading_lines=1)).toDF("key", "said"))
    return facts.rows()


@_query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def jsonl_flatten(spark, sf_dir):
    path = shared_folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    nested = events.select("event_id", "event_type", F.from_json("props", "k bigint").alias("props"))
    nested.write.option("ignoreNullFields", False).json(path)
    return read_jsonl(spark, path)


@_query("SELECT event_id, value, CASE WHEN event_id % 10 <> 0 THEN event_type END AS kind FROM events")
def json_facts_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    write_json(FactTable.of(events.withColumn("kind", F.when(F.col("event_id") % 10 != 0, F.col("event_type")))), path, ["event_id", "value", "kind"])
    return flattened(spark.read.json(path)).select("event_id", "value", "kind")


@_query(
    "SELECT * FROM (VALUES ('l_orderkey', 'integer'), ('l_quantity', 'number'), ('l_returnflag', 'text'), ('l_shipdate', 'date'), ('odd', 'boolean')) t(name, type)"
)
def infer_schema_types(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        (F.col("l_quantity") + 0.5).cast("string").alias("l_quantity"),
        "l_returnflag",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"),
        F.when(F.col("l_orderkey") % 2 == 0, "yes").otherwise("No").alias("odd"),
    )
    found = infer_schema(raw)
    return spark.createDataFrame([(c.name, c.type.value) for c in found.columns], "name string, type string")


@_query("SELECT event_id, CASE WHEN value <= 400 THEN value END AS value FROM events")
def import_nullify(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("value") <= 400, F.col("value").cast("string")).otherwise("much").alias("value")
    )
    schema = infer_schema(raw.where("value <> 'much'"))
    facts, _ = load_facts(raw, schema, "nullify")
    return facts.rows()


@_query("SELECT 'value' AS \"column\", count(*) FILTER (value > 400)::BIGINT AS cells, count(*)::BIGINT AS all_rows FROM events HAVING cells > 0")
def import_nullify_report(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("value") <= 400, F.col("value").cast("string")).otherwise("much").alias("value"))
    _, report = load_facts(raw, infer_schema(raw.where("value <> 'much'")), "nullify")
    return spark.createDataFrame([(c, n, report.rows) for c, n in report.nullified.items()], "column string, cells bigint, all_rows bigint")


@_query("SELECT CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE 'n' || event_id END AS mixed FROM events")
def import_widen(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("n"), "event_id")).alias("mixed")
    )
    facts, _ = load_facts(raw, infer_schema(raw.where("mixed not like 'n%'")))
    return facts.rows()


@_query(
    "SELECT coalesce(region, 'Total') AS r_name, sum(q) FILTER (f = 'A') AS a, sum(q) AS total FROM "
    "(SELECT r_name AS region, l_returnflag AS f, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) x GROUP BY ROLLUP (region)"
)
def json_cube_records(spark, sf_dir):
    from gridlark.queries import star

    qty = sum_of("l_quantity")
    cube = Cube(star(spark, sf_dir), CubeSpec(CubeAxis.of(ColumnDimension("r_name")), CubeAxis.of(ColumnDimension("l_returnflag")), (qty,)))
    records = json_records(cube)
    rows = [(r["r_name"], r["A / sum of l_quantity"], r["Total / sum of l_quantity"]) for r in records]
    return spark.createDataFrame(rows, "r_name string, a double, total double")


@_query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def snapshot_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    write_snapshot(FactTable.of(spark.read.parquet(f"{sf_dir}/orders.parquet")), path)
    return read_snapshot(spark, path)[0].rows()
