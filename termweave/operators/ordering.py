"""Running sums and numbers in a total order, without a task that sees all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.sources.workspace import PACKED, stage


def running_sum(df: DataFrame, by: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of the same `by` up to and with each row, in `order`.

    Rows are dealt by ranges of (by, order), which sampling keeps even whatever the keys are. Each range is summed
    on its own; what lies before it is a sum over one row for each range and group.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_v", value).repartitionByRange(parts, *by, *order).withColumn("_p", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    one = by or [F.lit(0)]
    sums = dealt.groupBy(*by, "_p").agg(F.sum("_v").alias("_s"))
    before = sums.select(*by, "_p", (F.sum("_s").over(Window.partitionBy(*one).orderBy("_p")) - F.col("_s")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_p"]]
    rows = dealt.withColumn("_inside", inside).alias("r").join(F.broadcast(before.alias("b")) if not by else before.alias("b"), keys)
    return rows.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("b._before") + F.col("r._inside")).alias(name))


#: The column with a row's task in its upper 31 bits and its place there in the others, in a total order of all rows.
SLOT = "_slot"


def in_slots(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df with SLOT, dealt by ranges and in order: rows are shuffled once. It must be written before it is used."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(SLOT, F.monotonically_increasing_id())


def before_slots(written: DataFrame) -> DataFrame:
    """How many rows lie before each task's: a row for each task that wrote."""
    n = written.groupBy(F.shiftright(SLOT, 33).alias("_task")).agg(F.count("*").alias("_n"))
    return n.select("_task", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_task")) - F.col("_n")).alias("_before"))


def index_of_slot(df: DataFrame, before: DataFrame, name: str) -> DataFrame:
    """df with each row's number, 0 and up, in place of SLOT."""
    rows = df.withColumn("_task", F.shiftright(SLOT, 33)).join(F.broadcast(before), "_task")  # a row for each task
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != SLOT], (F.col("_before") + F.col(SLOT).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "n") -> DataFrame:
    """df with each row's number, 0 and up, in its group."""
    if not by:
        rows = stage(in_slots(df, order), "slots", **PACKED)
        return index_of_slot(rows, before_slots(rows), name)
    got = running_sum(df, by, order, F.lit(1).cast("long"), name)
    return got.withColumn(name, F.col(name) - 1)
