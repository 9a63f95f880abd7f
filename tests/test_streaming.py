from pyspark.sql import functions as F

from gridlark.operators.aggregates import COUNT, average_of, distinct_count, std_dev, sum_of
from gridlark.operators.dimensions import ColumnDimension
from gridlark.operators.facts import FactTable
from gridlark.plans import Cube, CubeAxis, CubeSpec
from gridlark.streaming import start_cube


def test_a_stream_gives_the_batch_cube(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity", "l_suppkey")
    path = str(tmp_path / "in")
    source.repartition(4).write.parquet(path)
    spec = CubeSpec(CubeAxis.of(ColumnDimension("l_returnflag")), CubeAxis.of(ColumnDimension("l_linestatus")), (sum_of("l_quantity"), COUNT, average_of("l_quantity")))
    seen = []
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = start_cube(stream, spec, lambda table, n: seen.append(sorted(map(str, table.collect()))), str(tmp_path / "state"), available_now=True)
    query.awaitTermination(120)
    assert len(seen) > 1
    assert seen[-1] == sorted(map(str, Cube(FactTable.of(source), spec).table().collect()))


def test_distinct_counts_over_a_stream(spark, tmp_path):
    source = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("v"))
    path = str(tmp_path / "in")
    source.repartition(3).write.parquet(path)
    spec = CubeSpec(CubeAxis.of(ColumnDimension("k")), aggregates=(distinct_count("v"),))
    seen = []
    stream = spark.readStream.schema(source.schema).parquet(path)
    start_cube(stream, spec, lambda table, n: seen.append({r["k"]: r["distinct(v)"] for r in table.collect()}), str(tmp_path / "state"), available_now=True).awaitTermination(120)
    assert seen[-1] == {0: 7, 1: 7, 2: 7, None: 7}


def test_spread_over_a_stream(spark, tmp_path):
    source = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") % 17 + 1e6).alias("v"), (F.col("id") % 5).alias("w"))
    path = str(tmp_path / "in")
    source.repartition(3).write.parquet(path)
    spec = CubeSpec(CubeAxis.of(ColumnDimension("k")), aggregates=(std_dev("v"), distinct_count("v"), distinct_count("w")))
    seen = []
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rounded = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())
    start_cube(stream, spec, lambda table, n: seen.append(rounded(table)), str(tmp_path / "state"), available_now=True).awaitTermination(120)
    assert seen[-1] == rounded(Cube(FactTable.of(source), spec).table())
