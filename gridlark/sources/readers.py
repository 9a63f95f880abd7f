"""Readers give a DataFrame whose text cells are still text; other cells keep their types."""

from __future__ import annotations

import codecs
import csv
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.sources.folders import copied, head_of, shared_folder, size_of


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    quote: str = '"'
    has_header: bool = True
    skip_leading_lines: int = 0
    trim_cells: bool = False
    encoding: str = "UTF-8"
    #: Whether quoted cells may hold line ends; None: the text is scanned for them.
    multi_line: bool | None = None


def unique_names(names: Iterable[str | None]) -> list[str]:
    """Empty names become column1.., repeated ones get _2, _3."""
    found: list[str] = []
    for k, name in enumerate(names):
        base = (name or "").strip() or f"column{k + 1}"
        new, n = base, 2
        while new in found:
            new, n = f"{base}_{n}", n + 1
        found.append(new)
    return found


def _first_record(lines: list[str], options: CsvOptions) -> tuple[list[str], int]:
    """The first record that isn't blank, which may go over several lines, and the lines up to its end."""
    reader = csv.reader(iter([line + "\n" for line in lines]), delimiter=options.delimiter, quotechar=options.quote or None, doublequote=True)
    return next(((r, reader.line_num) for r in reader if any(c.strip() for c in r)), ([], 0))


def _decoded(df: DataFrame, encoding: str) -> DataFrame:
    """df, whose column value holds the bytes of a text in the encoding, with that text; in Python, as Spark knows few encodings."""
    if codecs.lookup(encoding).name == "utf-8":
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("value")
            texts = pa.array([x.as_py().decode(encoding, errors="replace") for x in batch.column(at)], pa.string())
            yield batch.set_column(at, "value", texts)

    return df.withColumn("value", F.col("value").cast("binary")).mapInArrow(run, df.schema)


def _lines(spark: SparkSession, path: str, options: CsvOptions) -> DataFrame:
    """(value, file, block): the lines, the file of each and where its split of the file begins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return _decoded(lines, options.encoding)


def _without_head(lines: DataFrame, n: int) -> DataFrame:
    """value of the lines, without the first n of each file.

    Lines come in order from their splits, so a count per file is enough; the
    first n must be in the file's first split, and a file that goes on without
    holding them there stops the read rather than lose a line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, int] = {}
        for batch in batches:
            stay = []
            for k, (file, block) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if block:
                    if left.get(file):
                        raise ValueError(f"the leading lines of {file} go beyond its first split")
                    stay.append(k)
                elif left.setdefault(file, n):
                    left[file] -= 1
                else:
                    stay.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(stay, pa.int64()))], ["value"])

    return lines.mapInArrow(run, "value string")


def has_quoted_newlines(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> bool:
    """Whether a record may go over several lines: whether any line has an odd number of quotes.  One scan of the text."""
    if not options.quote:
        return False
    quotes = F.length("value") - F.length(F.replace("value", F.lit(options.quote), F.lit("")))
    return not _lines(spark, path, options).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """All cells as text; short records end in nulls, blank lines are skipped.

    Files are split and read side by side, unless records go over several lines
    (options.multi_line; looked up by a scan if None): then a file is one task.
    Leading lines are cut by their place in each file, the header after them,
    too; lines that look like it later on are records.
    """
    skip = options.skip_leading_lines
    multi = has_quoted_newlines(spark, path, options) if options.multi_line is None else options.multi_line
    head = [r[0].lstrip("\ufeff") for r in _lines(spark, path, options).limit(skip + 200).collect()][skip:]
    first, header_lines = _first_record(head, options)
    names = unique_names(first if options.has_header else [None] * len(first))
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    how = {"sep": options.delimiter, "quote": options.quote, "escape": options.quote, "mode": "PERMISSIVE", "emptyValue": "", "nullValue": "\ufffe"}
    how |= {"ignoreLeadingWhiteSpace": str(options.trim_cells).lower(), "ignoreTrailingWhiteSpace": str(options.trim_cells).lower()}
    if not skip:
        reader = spark.read.schema(schema).options(**how).option("multiLine", multi).option("encoding", options.encoding)
        found = reader.option("header", options.has_header).option("enforceSchema", True).csv(path)
        if multi and "\r\n" in head_of(spark, path):  # the parser takes the first line end, which may stand in a cell, for all
            found = found.select(*(F.regexp_replace(c, r"\r\z", "").alias(c) for c in found.columns))
        return found.toDF(*names)
    cut = skip + (header_lines if options.has_header else 0)
    if multi:
        whole = _decoded(spark.read.text(path, wholetext=True), options.encoding)
        body = whole.select(F.regexp_replace("value", rf"\A(?:[^\r\n]*(?:\r\n|\n|\r)){{0,{cut}}}", "").alias("value"))
        # One text is one document, so the parser may see it as a whole; each goes to a file of its own.
        copy = shared_folder(spark)
        body.repartition(max(1, body.count()), F.monotonically_increasing_id()).write.option("lineSep", "\n").text(copy)
        return spark.read.schema(schema).options(**how).option("multiLine", True).option("header", False).csv(copy).toDF(*names)
    lines = _without_head(_lines(spark, path, options), cut).where(F.trim("value") != "")
    kinds = ", ".join(f"{f.name} string" for f in schema.fields)
    return lines.select(F.from_csv("value", kinds, how).alias("r")).select("r.*").toDF(*names)


def read_csv_url(spark: SparkSession, url: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """read_csv of what an http(s) or file url gives; it is copied to the shared folder first."""
    return read_csv(spark, copied(spark, url), options)


def estimated_rows(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> int | None:
    """About how many records files hold, from their size and the records of the first one's start; None without any.

    No data is read but that start.
    """
    start = head_of(spark, path)
    head = start.splitlines()[options.skip_leading_lines :]
    total = size_of(spark, path)
    read = sum(len(line.encode()) + 1 for line in head)
    records = sum(1 for r in csv.reader(iter([line + "\n" for line in head]), delimiter=options.delimiter, quotechar=options.quote or None) if any(c.strip() for c in r))
    if not records:
        return None
    header = 1 if options.has_header else 0
    if len(start.encode()) >= total:  # that was all of it
        return max(0, records - header)
    return max(0, round(total / (read / records)) - header)


@dataclass(frozen=True)
class JsonOptions:
    flatten: bool = True
    separator: str = "."
    columns: tuple[str, ...] | None = None
    #: JSON lines: the columns of every record, not of the first alone.
    scan_all_rows: bool = False


def _quoted(path: list[str]) -> str:
    return ".".join(f"`{p.replace('`', '``')}`" for p in path)


def flattened(df: DataFrame, options: JsonOptions = JsonOptions()) -> DataFrame:
    """Objects become columns of joined names, arrays their JSON text; without flatten objects do, too."""
    made: list[tuple[str, Column]] = []

    def add(path: list[str], kind: T.DataType) -> None:
        if isinstance(kind, T.StructType) and options.flatten:
            for f in kind.fields:
                add([*path, f.name], f.dataType)
            return
        column = F.col(_quoted(path))
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        made.append((options.separator.join(path), F.to_json(column) if nested else column))

    for f in df.schema.fields:
        add([f.name], f.dataType)
    if options.columns is not None:
        of = dict(made)
        made = [(n, of.get(n, F.lit(None).cast("string"))) for n in options.columns]
    return df.select(*(c.alias(n) for n, c in made))


def _keys_in_order(values: Iterable[dict]) -> list[str]:
    return list(dict.fromkeys(k for v in values for k in v))


def read_json(spark: SparkSession, path: str, options: JsonOptions = JsonOptions()) -> DataFrame:
    """A document that is an array of objects; columns in the order in which the first records name them.

    Raises for a document that isn't one.
    """
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = head_of(spark, path).lstrip("\ufeff \t\r\n")
    if not head.startswith("["):
        raise ValueError("expected a JSON array of objects")
    return flattened(df.select(*_in_order(df, _head_objects(head[1:]))), options)


def read_jsonl(spark: SparkSession, path: str, options: JsonOptions = JsonOptions()) -> DataFrame:
    """One object a line; blank lines are skipped.

    Columns are those that the first record names, or, with scan_all_rows,
    those of all records, the first record's first.
    """
    df = spark.read.option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "").limit(20 if options.scan_all_rows else 1).collect()
    head = [json.loads(r[0]) for r in lines]
    if not all(isinstance(r, dict) for r in head):
        raise ValueError("expected an object on each line")
    ordered = df.select(*_in_order(df, head))
    if options.scan_all_rows or options.columns is not None or not head:
        return flattened(ordered, options)
    found = flattened(ordered, options)
    return found.select(*(F.col(_quoted([c])) for c in found.columns if _names(head[0], c.split(options.separator) if options.flatten else [c])))


def _names(record: object, path: list[str]) -> bool:
    """Whether a record has a value, or a null, at the path or on the way to it."""
    for name in path:
        if record is None:
            return True
        if not isinstance(record, dict) or name not in record:
            return False
        record = record[name]
    return True


def _head_objects(text: str) -> list[dict]:
    """Objects at the start of an array's inside, as far as the text holds them whole."""
    decoder, found, at = json.JSONDecoder(), [], 0
    while len(found) < 20:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            break
        if isinstance(value, dict):
            found.append(value)
    return found


def _in_order(df: DataFrame, head: list[dict]) -> list[Column]:
    """Top-level columns, those of the head first; Spark sorts them by name."""
    known = [k for k in _keys_in_order(head) if k in df.columns]
    return [F.col(_quoted([c])) for c in [*known, *(c for c in df.columns if c not in known)]]


def read_rows(spark: SparkSession, columns: list[str], rows: list[list]) -> DataFrame:
    """Rows from memory; a column of mixed types is text."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    schema, values = [], [list(r) + [None] * (len(columns) - len(r)) for r in rows]
    for k, name in enumerate(columns):
        seen = {type(r[k]) for r in values if r[k] is not None}
        if seen <= {int, float} and len(seen) == 2:
            kind = "double"
        elif len(seen) == 1 and next(iter(seen)) in kinds:
            kind = kinds[next(iter(seen))]
        elif len(seen) == 1:
            kind = {"date": "date", "datetime": "timestamp_ntz"}.get(next(iter(seen)).__name__, "string")
        else:
            kind = "string"
        if kind == "string":
            for r in values:
                r[k] = None if r[k] is None else str(r[k])
        elif kind == "double":
            for r in values:
                r[k] = None if r[k] is None else float(r[k])
        schema.append(f"c{k} {kind}")
    return spark.createDataFrame([tuple(r[: len(columns)]) for r in values], ", ".join(schema)).toDF(*unique_names(columns))
