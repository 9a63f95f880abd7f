"""Where files go that all of a cluster must see, and a look at the start of one."""

from __future__ import annotations

import tempfile
import urllib.request
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one.

    That is the checkpoint folder of the context, or spark.checkpoint.dir.  A
    temporary one serves only on a local master; elsewhere none set is an error.
    """
    context = spark.sparkContext
    set_ = context._jsc.sc().getCheckpointDir()
    base = set_.get() if set_.isDefined() else context.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gridlark-")
    return f"{base}/files-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str) -> tuple[object, list]:
    """The file system of a path, and the files it stands for: itself, a folder's, or those of a pattern."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(system.globStatus(where) or ())
    found = [s for top in found for s in (system.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return system, sorted((s for s in found if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda s: s.getPath().getName())


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a path."""
    return sum(s.getLen() for s in _files(spark, path)[1])


def copied(spark: SparkSession, url: str, name: str = "data") -> str:
    """A new shared folder with what the url gives, read block by block by the driver."""
    folder = shared_folder(spark)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        with urllib.request.urlopen(url) as source:
            while block := source.read(1 << 20):
                out.write(bytearray(block))
    finally:
        out.close()
    return folder


def head_of(spark: SparkSession, path: str, size: int = 100_000) -> str:
    """The first size bytes or so, as UTF-8, of the file, or of the first file of a folder or pattern."""
    system, found = _files(spark, path)
    if not found:
        return ""
    first = found[0]
    stream = system.open(first.getPath())
    try:
        data = stream.readNBytes(size) if first.getLen() else b""
    finally:
        stream.close()
    return bytes(data).decode("utf-8", errors="ignore")
