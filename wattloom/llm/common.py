"""Shared pieces: stage tables in the session's shared folder, safe column names, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where Spark is a single process without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="wattloom-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def digest_key(*cols: Column) -> Column:
    """128-bit key of a row's identity; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\u0001", *parts)))


def strings(column: pa.ChunkedArray | pa.Array, lo: int, hi: int) -> list[str]:
    """Values lo..hi as Python strings, nulls as empty strings."""
    return [x or "" for x in column.slice(lo, hi - lo).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cuts Arrow batches so that a piece's texts hold about ``most`` characters (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column, at, size, lo = batch.column(text), [], 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= most:
                at.append((lo, i + 1))
                lo, size = i + 1, 0
        if lo < len(lengths):
            at.append((lo, len(lengths)))
        for lo, hi in at:
            yield batch.slice(lo, hi - lo), strings(column, lo, hi)


