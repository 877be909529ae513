"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words; ``bytes.split()`` splits on exactly these.
ASCII_SPACE = "\t\n\x0b\x0c\r "


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was started from another folder."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session, whose one machine does all, may go without and gets a temporary one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            return context.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)  # when the driver ends
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, once their result is saved.

    Spark deletes them when the driver collects its garbage. The plan's last events still hold it for a moment.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def dropped(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote, once no later plan reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores (a small file with one row group) dealt out over all of them.

    Larger tables have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def met_by_key(left: DataFrame, right: DataFrame, key: str, rows: int, share: int = 1000) -> DataFrame:
    """Inner join with ``right``, which has each key once and in ``n`` the number of its rows in ``left``, of ``rows`` in all.

    Keys with more than one row in ``share`` are fewer than ``share``: that part of ``right`` is broadcast, so hot keys do not gather.
    """
    hot = F.col("n") * share > rows
    few = F.broadcast(right.where(hot)).drop("n")
    rest = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti")
    return left.join(few, key).union(rest.join(right.where(~hot).drop("n"), key))


def column_at(df: DataFrame, name: str) -> int:
    """Place of a column by exact name first, so that extra columns that differ only in case do not clash."""
    same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"column {name} is missing; there are {df.columns}")
    return same[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns _0, _1, ... in place of names that may clash."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def take(df: DataFrame, *names: str, into: tuple[str, ...] | None = None) -> DataFrame:
    """The named columns alone, under the names ``into`` if given."""
    return numbered(df).select(*[F.col(f"_{column_at(df, n)}").alias(m) for n, m in zip(names, into or names)])


def small_batches(batch: pa.RecordBatch, text: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``max_bytes`` of text (always at least one row)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text))
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n) + 16
    yield batch.slice(start)


def over_text(df: DataFrame, text: str, schema: str, fn: Callable[[pa.RecordBatch], dict[str, list]], max_bytes: int = 2 << 20) -> DataFrame:
    """Map each small Arrow batch to a dictionary of columns. Only the columns in ``df`` reach Python."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in small_batches(whole, text, max_bytes):
                got = fn(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in arrow for x in [got[f.name]]], schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def unsigned_crc32(col: Column) -> Column:
    """CRC-32 of the UTF-8 bytes as an unsigned number; null counts as empty."""
    return F.crc32(F.coalesce(col, F.lit("")))
