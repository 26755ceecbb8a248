"""What the operators share: written intermediate tables, text conventions, and row numbering."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paywarden.session import scratch_path

#: The white space that separates words, as bytes and as a regular expression of a word.
SPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The same rows read back from the shared folder: cuts the lineage and survives lost executors."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the machine: workers stay for later tasks, of other stages too, and would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of a group, whose memory is given back after it."""

    def run(group: pa.Table) -> pa.Table:
        try:
            return function(group)
        finally:
            give_back()

    return run


def lean_pair(function: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function of two groups that meet, whose memory is given back after it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return function(left, right)
        finally:
            give_back()

    return run


def lean_batches(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function of a task's batches, whose memory is given back after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def text_mark() -> dict[str, Column]:
    """128 bits that stand for the text of a row."""
    return {"mark_a": F.xxhash64(F.lit(1), F.col("text")), "mark_b": F.xxhash64(F.lit(2), F.col("text"))}


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id's text leaves no remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def numbered(rows: DataFrame, order: Sequence[Column], number: str) -> DataFrame:
    """Rows with their place (from 0) in a total order, without one task that sees them all.

    The rows are dealt out by range and written, so that both passes see the
    same ranges; the only global step adds up one count per range.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = written(ranged, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("_inside", inside).join(starts, "_range").select(
        *rows.columns, (F.col("_start") + F.col("_inside")).alias(number)
    )


def alike(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on null-safe keys that stand once in the result."""
    right = right.withColumnsRenamed({key: f"_{key}" for key in keys})
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    return left.join(right, same).drop(*(f"_{key}" for key in keys))


def running(rows: DataFrame, group: list[str], order: list[Column], dealt: list[Column], total, join, **values: str) -> DataFrame:
    """Rows with the totals of their group up to and including them, and whether they are the group's last row.

    Rows are dealt out by ranges of ``dealt``, which must not contradict ``order``, so no task sees a large group whole.
    """
    ranged = written(rows.repartitionByRange(*group, *dealt).withColumn("_range", F.spark_partition_id()), "ranges")
    by_range = Window.partitionBy(*group).orderBy("_range")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*group, "_range").agg(*(total(value).alias(f"_{name}") for name, value in values.items())).select(
        *group, "_range", F.lead("_range").over(by_range).isNull().alias("final"),
        *(F.coalesce(total(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in values),
    )
    upto = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.lead(F.lit(1)).over(Window.partitionBy(*group, "_range").orderBy(*order)).isNull()
    inside = ranged.withColumns({name: total(value).over(upto) for name, value in values.items()} | {"last": end})
    found = alike(inside, starts, *group, "_range")
    return found.withColumns({name: join(F.col(name), F.col(f"_{name}")) for name in values}).withColumn(
        "last", F.col("last") & F.col("final")
    ).drop("_range", "final", *(f"_{name}" for name in values))
