"""Scores of mantissas: how far from noise windows' nibbles and traces' bit streams are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitstrata.functions import bits as B
from bitstrata.operators import roi

#: A stream's values, the step between starts, and bits shown: high m22..m15, low m7..m0.
VALUES, STRIDE = 40, 4
HIGH, LOW = tuple(range(22, 14, -1)), tuple(range(7, -1, -1))
NIBBLES = {"nib19": 19, "nib15": 15, "nib4": 4, "nib0": 0}


def stream_bits(m: Column, bits: tuple[int, ...]) -> Column:
    """The chosen bits of a mantissa as an array."""
    return F.array(*[B.field(m, k, 1) for k in bits])


def window_nibble_scores(cells: DataFrame, height: int, width: int, stride: int, traces: int, samples: int) -> DataFrame:
    """(p, t0, s0, score) of windows of mantissas (p, t, s, m): over four nibbles the mean of their
    distance from uniform times min(entropy / 2.5, 1), and 1.8 times the mean share of equal neighbours."""

    def origins(x: Column, size: int, window: int) -> Column:
        return F.filter(roi.starts(F.lit(size), window, stride), lambda o: (o <= x) & (x < o + window))

    along, across = Window.partitionBy("p", "t").orderBy("s"), Window.partitionBy("p", "s").orderBy("t")
    c = cells.withColumn("ms", F.lag("m").over(along)).withColumn("mt", F.lag("m").over(across))
    d = c.withColumn("t0", F.explode(origins(F.col("t"), traces, height))).withColumn("s0", F.explode(origins(F.col("s"), samples, width)))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("nibble"), B.field(F.col("m"), at, 15).alias("x"), (B.field(F.col("m"), at, 15) == B.field(F.col("ms"), at, 15)).cast("int").alias("eq_s"), (B.field(F.col("m"), at, 15) == B.field(F.col("mt"), at, 15)).cast("int").alias("eq_t")) for k, at in NIBBLES.items()]))
    n = d.select("p", "t0", "s0", (F.col("s") > F.col("s0")).alias("in_s"), (F.col("t") > F.col("t0")).alias("in_t"), parts.alias("z")).select("p", "t0", "s0", "in_s", "in_t", "z.*")
    counts = n.groupBy("p", "t0", "s0", "nibble", "x").agg(F.count("*").alias("n"), F.sum(F.when(F.col("in_s"), F.col("eq_s"))).alias("same_s"), F.sum(F.col("in_s").cast("int")).alias("n_s"), F.sum(F.when(F.col("in_t"), F.col("eq_t"))).alias("same_t"), F.sum(F.col("in_t").cast("int")).alias("n_t"))
    total = F.sum("n")
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    by = counts.groupBy("p", "t0", "s0", "nibble").agg(entropy.alias("entropy"), (0.5 * (F.sum("same_s") / F.sum("n_s") + F.sum("same_t") / F.sum("n_t"))).alias("same"))
    term = (4 - F.col("entropy")) * F.least(F.col("entropy") / 2.5, F.lit(1.0))
    return by.groupBy("p", "t0", "s0").agg((F.avg(term) + 1.8 * F.avg("same")).alias("score"))


def _useful(m: Column, bits: tuple[int, ...]) -> Column:
    """Of each bit of a stream: share of equal neighbours times 4 q (1 - q)."""
    n = F.size(m)

    def of(k: int) -> Column:
        b = F.transform(m, lambda x: B.field(x, k, 1))
        q = F.aggregate(b, F.lit(0), lambda a, x: a + x) / n
        same = F.aggregate(F.zip_with(F.slice(b, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x) / (n - 1)
        return same * 4 * q * (1 - q)

    return F.array(*[of(k) for k in bits])


def _mean(a: Column, n: int) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / n


def stream_scores(traces: DataFrame, middle: tuple[float, float], greatest: float, least: float = 0.8, least_std: float = 0.08) -> DataFrame:
    """(p, trace, start, component, score) of every stream of VALUES samples of trace rows
    (p, t, samples) that is active, and near enough to `middle` (trace, sample).

    1.15 times a mix of the mean and of the best four of the high bits' usefulness, and 0.25
    times the low bits'; times a weight for nearness and one for activity."""
    v = F.transform("samples", lambda x: F.abs(x.cast("double")))
    x = traces.select("p", "t", F.transform("samples", lambda x: x.cast("double")).alias("v"), v.alias("a"), "m")
    values = x.select("p", F.explode("v").alias("v"))
    of = values.groupBy(F.col("p").alias("of")).agg(F.percentile(F.abs("v"), F.lit(0.2)).alias("floor"), F.stddev_pop("v").alias("whole"))
    x = x.join(of, F.col("p") == F.col("of")).filter(F.size("a") >= VALUES)
    x = x.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("a") - VALUES, F.lit(STRIDE))))
    x = x.select("p", F.col("t").alias("trace"), "start", "floor", "whole", F.slice("a", F.col("start") + 1, F.lit(VALUES)).alias("a"), F.slice("m", F.col("start") + 1, F.lit(VALUES)).alias("m"))
    d = F.sqrt(F.pow(F.col("trace") - F.lit(middle[0]), 2) + F.pow(F.col("start") + VALUES / 2 - F.lit(middle[1]), 2))
    mean = _mean(F.col("a"), VALUES)
    x = x.withColumns({"d": d, "active": F.size(F.filter("a", lambda y: y > F.col("floor"))) / VALUES, "mean": mean}).filter((F.col("d") <= greatest) & (F.col("active") >= least))
    x = x.withColumn("std", F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, y: s + (y - F.col("mean")) * (y - F.col("mean"))) / VALUES)).filter(F.col("std") >= least_std * F.col("whole"))
    x = x.withColumns({"high": _useful(F.col("m"), HIGH), "low": _useful(F.col("m"), LOW)})
    best = _mean(F.slice(F.sort_array("high", asc=False), 1, 4), 4)
    part = 1.15 * (0.70 * _mean(F.col("high"), len(HIGH)) + 0.30 * best) + 0.25 * _mean(F.col("low"), len(LOW))
    x = x.withColumn("component", F.round(part, 9))
    near = 0.75 + 0.25 * (1 - F.col("d") / greatest)
    weight = F.least(F.lit(1.20), 0.80 + 0.40 * F.col("active"))
    return x.select("p", "trace", "start", "component", F.round(F.col("component") * near * weight, 9).alias("score"))


def best_streams(scores: DataFrame, size: tuple[int, int], traces: int, samples: int) -> DataFrame:
    """Each profile's best stream, the first in scan order at a tie, and the window around its middle."""
    best = scores.groupBy("p").agg(F.max_by(F.struct("trace", "start", "score"), F.struct("score", -F.col("trace"), -F.col("start"))).alias("w")).select("p", "w.*")
    return best.select("*", window_start(F.col("trace"), size[0], traces).alias("t0"), window_start(F.col("start") + VALUES // 2, size[1], samples).alias("s0"))


def window_start(middle: Column, size: int, whole: int) -> Column:
    """Start of a window of `size` around a place, moved inside of 0..whole."""
    return F.greatest(F.lit(0), F.least(middle - size // 2, F.lit(whole - size))).cast("int")
