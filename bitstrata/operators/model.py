"""Integer probability models: context counts to cumulative tables, top symbols, code length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTAL = 1 << 15


def context(left: Column, up: Column) -> Column:
    """Nine contexts by how far the neighbours differ."""
    d = F.coalesce(left - up, F.lit(0))
    size = F.when(d == 0, 0).when(F.abs(d) == 1, 1).when(F.abs(d) <= 3, 2).when(F.abs(d) <= 8, 3).otherwise(4)
    return F.when(d < 0, 4 + size).otherwise(size)


def frequencies(counts: DataFrame, by: str = "ctx", symbols: int = 256, total: int = TOTAL) -> DataFrame:
    """(by, symbol, n, freq): every symbol at least 1, a context's frequencies add up to `total`.

    A symbol has 1 + floor(share * (total - symbols)); what is missing goes to the largest
    remainders, ties to the higher symbol.  Remainders are compared as integers.
    """
    ctx = counts.groupBy(by).agg(F.sum("n").alias("whole"))
    grid = ctx.crossJoin(F.broadcast(counts.sparkSession.range(symbols).select(F.col("id").cast("int").alias("symbol"))))
    x = grid.join(counts, [by, "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    scaled = F.col("n") * F.lit(total - symbols)
    x = x.withColumn("rem", scaled % F.col("whole")).withColumn("base", F.lit(1) + F.floor((scaled - F.col("rem")) / F.col("whole")))
    w = Window.partitionBy(by)
    x = x.withColumn("short", F.lit(total) - F.sum("base").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("rem"), F.desc("symbol"))))
    return x.select(by, "symbol", "n", (F.col("base") + F.when(F.col("rank") <= F.col("short"), 1).otherwise(0)).cast("long").alias("freq"))


def cumulative(freq: DataFrame, by: str = "ctx") -> DataFrame:
    """Adds `lo`, the frequencies before each symbol."""
    w = Window.partitionBy(by).orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return freq.withColumn("lo", F.coalesce(F.sum("freq").over(w), F.lit(0)))


def top_symbols(freq: DataFrame, k: int = 5, by: str = "ctx") -> DataFrame:
    """The k likeliest symbols, ties to the higher symbol."""
    w = Window.partitionBy(by).orderBy(F.desc("freq"), F.desc("symbol"))
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def code_length(counts: DataFrame, freq: DataFrame, by: str = "ctx", total: int = TOTAL) -> DataFrame:
    """Top-1 and top-5 hit rates, mean bits, perplexity and proxy bytes of coding counts with a model.

    Symbols are weighted by how often they occur, so the sums run over the tables only.
    """
    w = Window.partitionBy(by).orderBy(F.desc("freq"), F.desc("symbol"))
    m = freq.withColumn("rank", F.row_number().over(w)).select(by, "symbol", "freq", "rank")
    x = counts.join(m, [by, "symbol"])
    bits = -F.log2(F.greatest(F.col("freq") / F.lit(float(total)), F.lit(1e-9)))
    n = F.sum("n")
    out = x.agg(n.alias("n"), (F.sum(F.when(F.col("rank") <= 1, F.col("n")).otherwise(0)) / n).alias("top1"), (F.sum(F.when(F.col("rank") <= 5, F.col("n")).otherwise(0)) / n).alias("top5"), (F.sum(bits * F.col("n")) / n).alias("bits"))
    return out.withColumn("perplexity", F.pow(F.lit(2.0), "bits")).withColumn("proxy_bytes", F.ceil(F.round(F.col("bits") * F.col("n") / 8, 6)))
