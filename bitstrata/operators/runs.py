"""Run lengths over one ordered stream that may span any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_lengths(df: DataFrame, value: Column, block: str, order: str) -> DataFrame:
    """(run, length, value) of maximal equal runs of a stream ordered by (block, order).

    Runs are found inside each block, in parallel; then a block's first run is joined to
    the last of the block before where their values agree.  Only the second step orders
    all rows, and it sees two rows a block and no more: inner runs can't merge.
    """
    w = Window.partitionBy(block).orderBy(order)
    x = df.select(F.col(block).alias("b"), F.col(order).alias("o"), value.alias("value"))
    w = Window.partitionBy("b").orderBy("o")
    x = x.withColumn("new", F.when(F.lag("value").over(w) == F.col("value"), 0).otherwise(1)).withColumn("r", F.sum("new").over(w))
    local = x.groupBy("b", "r").agg(F.count("*").alias("n"), F.first("value").alias("value"))
    local = local.withColumn("last", F.max("r").over(Window.partitionBy("b")))
    edge = local.filter((F.col("r") == 1) | (F.col("r") == F.col("last")))
    all_edges = Window.orderBy("b", "r")
    joins = (F.lag("b").over(all_edges) != F.col("b")) & (F.lag("value").over(all_edges) == F.col("value"))
    edge = edge.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("g", F.sum("new").over(all_edges))
    merged = edge.groupBy("g").agg(F.min(F.struct("b", "r")).alias("at"), F.sum("n").alias("n"), F.first("value").alias("value")).select("at.b", "at.r", "n", "value")
    inner = local.filter((F.col("r") > 1) & (F.col("r") < F.col("last"))).select("b", "r", "n", "value")
    return merged.unionByName(inner)


def numbered(runs: DataFrame) -> DataFrame:
    """Runs with their place in the stream: counts before each block, then places inside it."""
    per = runs.groupBy("b").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return runs.join(per.select("b", "before"), "b").withColumn("run", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("r")) - 1)


def run_deltas(runs: DataFrame) -> DataFrame:
    """Each run's length less the one before, 0 for the first."""
    x = numbered(runs)
    inside = Window.partitionBy("b").orderBy("r")
    tail = x.groupBy("b").agg(F.max(F.struct("r", "n")).alias("z"), F.min("run").alias("first")).select("b", F.col("z.n").alias("tail"))
    tail = tail.withColumn("prior", F.lag("tail").over(Window.orderBy("b"))).drop("tail")
    x = x.join(tail, "b")
    prev = F.coalesce(F.lag("n").over(inside), F.col("prior"))
    return x.select("run", F.col("n").alias("length"), F.coalesce(F.col("n") - prev, F.lit(0)).alias("delta"))
