"""Histograms, entropies and bit statistics over voxel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitstrata.functions.bits import bernoulli_entropy, exponent, mantissa, sign


def histogram(df: DataFrame, symbol: Column, size: int = 256) -> DataFrame:
    """(symbol, n) for all of 0..size-1; one row a symbol is shuffled by each task."""
    counts = df.select(symbol.alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(size).select(F.col("id").cast("int").alias("symbol"))
    return bins.join(counts, "symbol", "left").select("symbol", F.coalesce("n", F.lit(0)).alias("n"))


def entropy(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Shannon entropy in bits of (by..., n) counts, from sums alone: log2 N - sum(n log2 n) / N."""
    live = counts.filter("n > 0").groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nlog"), F.count("*").alias("bins"))
    return live.select(*by, "total", "bins", (F.log2("total") - F.col("nlog") / F.col("total")).alias("entropy"))


def sign_counts(bits: Column, split_zero: bool = True) -> list[Column]:
    zero = bits.bitwiseAND(F.lit(0x7FFFFFFF)) == 0
    if not split_zero:
        return [F.count_if(sign(bits) == 0).alias("pos"), F.count_if(sign(bits) == 1).alias("neg")]
    return [F.count_if((sign(bits) == 0) & ~zero).alias("pos"), F.count_if((sign(bits) == 1) & ~zero).alias("neg"), F.count_if(zero).alias("zero")]


def volume_stats(volume: DataFrame) -> DataFrame:
    """One row a trace and one of the whole (p, t null), from one scan."""
    b = F.col("bits")
    return volume.groupingSets([[F.col("p"), F.col("t")], []], "p", "t").agg(
        F.count("*").alias("n"), F.avg(exponent(b)).alias("mean_exponent"), *sign_counts(b), (F.count_if(b.bitwiseAND(F.lit(0x7FFFFFFF)) != 0) / F.count("*")).alias("nonzero_ratio"), ((F.count_if(F.col("v") > 0) - F.count_if(F.col("v") < 0)) / F.count("*")).alias("balance")
    )


def plane_counts(volume: DataFrame, planes: int = 23) -> DataFrame:
    """(k, ones, n) a mantissa bit, from one aggregate of all planes."""
    sums = volume.agg(F.count("*").alias("n"), *[F.sum(F.getbit(mantissa(F.col("bits")), F.lit(k)).cast("long")).alias(f"k{k}") for k in range(planes)])
    return sums.select("n", F.posexplode(F.array(*[F.col(f"k{k}") for k in range(planes)])).alias("k", "ones"))


def bit_entropies(volume: DataFrame, planes: int = 23) -> DataFrame:
    """Entropy of each bit, running total from the lowest bit, and its group (low 8, mid 8, high 7)."""
    h = plane_counts(volume, planes).withColumn("h", bernoulli_entropy(F.col("ones") / F.col("n")))
    # as many rows as there are planes
    up = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumn("cumulative", F.sum("h").over(up)).withColumn("grp", F.when(F.col("k") >= 16, "high").when(F.col("k") >= 8, "mid").otherwise("low"))


def heat_map(volume: DataFrame, profile: int, max_cols: int, max_rows: int) -> DataFrame:
    """Every stride-th trace and sample of one profile, with the range of what is shown."""
    one = volume.filter(F.col("p") == profile)
    size = one.agg((F.max("t") + 1).alias("nt"), (F.max("s") + 1).alias("ns"))
    step = one.crossJoin(F.broadcast(size))  # one row
    dt, ds = F.greatest(F.lit(1), F.floor(F.col("nt") / max_cols)), F.greatest(F.lit(1), F.floor(F.col("ns") / max_rows))
    shown = step.filter((F.col("t") % dt == 0) & (F.col("s") % ds == 0) & (F.col("t") / dt < max_cols))
    span = shown.agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    return shown.crossJoin(F.broadcast(span)).select("t", "s", "v", "vmin", "vmax")
