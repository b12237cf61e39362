"""Row numbers over whole tables or large groups without one task that holds them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is named, a temporary one on one machine; on a cluster that fails."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def position(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds pos, the rank from 1 by ``order`` (nulls first) within ``by``.

    Rows are dealt out by ranges of (by, order) and ranked in each range; what stands before a range comes from the
    ranges' sizes, of which there are as many as partitions. The ranges are fixed by a checkpoint, since a second run
    could draw other bounds."""
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    size = ranged.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_p")
    shift = size.select(*by, "_p", (F.sum("_c").over(before) - F.col("_c")).alias("_s"))
    local = F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order))
    return ranged.withColumn("_n", local).join(shift, [*by, "_p"]).withColumn("pos", F.col("_n") + F.col("_s")).drop("_n", "_s", "_p")


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for every new name, the sum of a column over the rows of its group up to each row by ``order``, which has no ties.

    As in ``position``, rows are dealt out by ranges: a range adds up its own rows, and what stands before it comes from
    one row of totals a range, so that a group of any size is summed by all tasks."""
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_p").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*by, "_p", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums))
    local = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ranged.withColumns({f"_l_{n}": F.sum(c).over(local) for n, c in sums.items()}).join(shift, [*by, "_p"])
    return own.select(*df.columns, *((F.col(f"_l_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums))
