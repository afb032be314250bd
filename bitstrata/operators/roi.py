"""Regions of interest: per-profile trace intervals, their complement, and search for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_traces(volume: DataFrame, ratio: float, samples: int) -> DataFrame:
    """Traces with enough non-zero samples: one, or ceil(ratio * samples)."""
    from math import ceil

    least = 1 if ratio <= 0 else max(1, ceil(ratio * samples))
    return volume.groupBy("p", "t").agg((F.count_if(F.col("v") != 0) >= least).alias("valid"))


def rectangles(volume: DataFrame, ratio: float, samples: int, margin: int = 0, group: int = 1) -> DataFrame:
    """(p, left, right): first to last valid trace, widened, whole where none is valid; then
    the union over each `group` profiles in turn."""
    t = valid_traces(volume, ratio, samples).groupBy("p").agg(F.max("t").alias("last"), F.min(F.when(F.col("valid"), F.col("t"))).alias("a"), F.max(F.when(F.col("valid"), F.col("t"))).alias("b"))
    n = F.col("last") + 1
    r = t.select("p", F.when(F.col("a").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("a") - margin)).alias("left"), F.when(F.col("a").isNull(), n).otherwise(F.least(n, F.col("b") + 1 + margin)).alias("right"))
    if group <= 1:
        return r
    g = Window.partitionBy(F.floor(F.col("p") / group))
    return r.select("p", F.min("left").over(g).alias("left"), F.max("right").over(g).alias("right"))


def rectangle_summary(rects: DataFrame, samples: int) -> DataFrame:
    w = F.greatest(F.lit(0), F.col("right") - F.col("left"))
    return rects.agg(F.count("*").alias("profiles"), F.min(w).alias("min_width"), F.max(w).alias("max_width"), F.avg(w).alias("mean_width"), (F.sum(w) * samples).alias("voxels"))


def split_by_roi(volume: DataFrame, rects: DataFrame) -> DataFrame:
    """Adds `inside`; a profile without a rectangle is outside."""
    x = volume.join(rects.withColumnRenamed("p", "rp"), F.col("p") == F.col("rp"), "left")
    return x.withColumn("inside", F.coalesce((F.col("t") >= F.col("left")) & (F.col("t") < F.col("right")), F.lit(False))).drop("rp", "left", "right")


def starts(size: Column, window: int, stride: int) -> Column:
    """0, stride, ... and the last start at which the window still fits."""
    last = F.greatest(size - window, F.lit(0)).cast("int")
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def correlation(a: str, b: str) -> Column:
    """Pearson, 0 where a side does not vary."""
    return F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))


def window_scores(cells: DataFrame, height: int, width: int, stride: int, traces: int, samples: int, by: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """Scores of windows of one profile's cells (t, s, v, e, sgn), or of each `by`; `more` aggregates.

    A cell is dealt to every window it lies in, (height / stride) * (width / stride) of them, and
    one aggregate scores all windows.
    """

    def origins(x: Column, size: int, window: int) -> Column:
        return F.filter(starts(F.lit(size), window, stride), lambda o: (o <= x) & (x < o + window))

    def pearson(a: Column, b: Column) -> Column:  # corr() fails on a window without variation
        return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))

    along, across = Window.partitionBy(*by, "t").orderBy("s"), Window.partitionBy(*by, "s").orderBy("t")
    c = cells.withColumn("es", F.lag("e").over(along)).withColumn("et", F.lag("e").over(across)).withColumn("gs", F.lag("sgn").over(along))
    d = c.withColumn("t0", F.explode(origins(F.col("t"), traces, height))).withColumn("s0", F.explode(origins(F.col("s"), samples, width)))
    inner_s, inner_t = F.col("s") > F.col("s0"), F.col("t") > F.col("t0")
    share = F.avg("sgn")
    return d.groupBy(*by, "t0", "s0").agg(
        F.count("*").alias("n"), F.stddev_pop("e").alias("e_std"), (F.max("e") - F.min("e")).alias("e_span"), F.stddev_pop("v").alias("v_std"),
        F.coalesce(F.avg(F.when(inner_s, F.abs(F.col("e") - F.col("es")))), F.lit(0.0)).alias("e_step"), F.coalesce(F.avg(F.when(inner_s, (F.col("sgn") == F.col("gs")).cast("int"))), F.lit(0.0)).alias("same_sign"),
        (F.abs(share - 0.5) * 2).alias("sign_bias"),
        pearson(F.when(inner_s, F.col("e")), F.when(inner_s, F.col("es"))).alias("corr_s"),
        pearson(F.when(inner_t, F.col("e")), F.when(inner_t, F.col("et"))).alias("corr_t"), *more,
    )


def active_windows(cells: DataFrame, height: int, width: int, stride: int, traces: int, samples: int, least: float = 0.8, least_std: float = 0.15) -> DataFrame:
    """`window_scores` of every profile's windows that are active: enough of |v| over the profile's
    20th percentile, and |v| varying enough against the profile's v; with `active` and its `weight`."""
    a = F.abs(F.col("v").cast("double"))
    of = cells.groupBy(F.col("p").alias("of")).agg(F.percentile(a, F.lit(0.2)).alias("floor"), F.stddev_pop(F.col("v").cast("double")).alias("whole_std"))
    c = cells.join(of, F.col("p") == F.col("of")).drop("of")
    more = (F.avg((a > F.col("floor")).cast("int")).alias("active"), F.stddev_pop(a).alias("a_std"), F.max("whole_std").alias("whole_std"))
    x = window_scores(c, height, width, stride, traces, samples, ("p",), more)
    x = x.filter((F.col("active") >= least) & (F.col("a_std") >= least_std * F.col("whole_std")))
    return x.withColumn("weight", F.least(F.lit(1.25), 0.75 + 0.5 * F.col("active")))


def best_windows(scores: DataFrame, score: Column, middle: tuple[float, float], greatest: float, size: tuple[int, int]) -> DataFrame:
    """Each profile's window with the highest score times activity weight and nearness of its middle;
    those beyond the greatest distance are out, the first in scan order wins ties."""
    d = F.sqrt(F.pow(F.col("t0") + size[0] / 2 - middle[0], 2) + F.pow(F.col("s0") + size[1] / 2 - middle[1], 2))
    x = scores.withColumn("d", d).filter(F.col("d") <= greatest)
    x = x.withColumn("score", F.round(score * F.col("weight") * (0.65 + 0.35 * (1 - F.col("d") / greatest)), 9))
    return x.groupBy("p").agg(F.max_by(F.struct("t0", "s0", "score"), F.struct("score", -F.col("t0"), -F.col("s0"))).alias("w")).select("p", "w.*")


def best_window(scores: DataFrame, score: Column, centre: tuple[float, float] | None = None) -> DataFrame:
    """The window with the highest score times nearness to a centre; the first in scan order wins ties."""
    near = F.lit(1.0)
    if centre is not None:
        d = F.sqrt(F.pow(F.col("t0") - centre[0], 2) + F.pow(F.col("s0") - centre[1], 2))
        near = 0.65 + 0.35 * (1 - F.least(d / (centre[0] + centre[1] + 1), F.lit(1.0)))
    x = scores.withColumn("score", F.round(score * near, 9))
    return x.orderBy(F.desc("score"), "t0", "s0").limit(1)


def max_energy(volume: DataFrame, dp: int = 1, dt: int = 1, first: int = 200, least: float = 0.001) -> DataFrame:
    """The trace with the largest mean |v| of its first samples among every dp-th profile and dt-th trace."""
    x = volume.filter((F.col("p") % dp == 0) & (F.col("t") % dt == 0) & (F.col("s") < first))
    e = x.groupBy("p", "t").agg(F.round(F.avg(F.abs(F.col("v").cast("double"))), 9).alias("energy"), F.count_if(F.abs(F.col("v")) > least).alias("live")).filter("live > 2")
    return e.orderBy(F.desc("energy"), "p", "t").limit(1).select("p", "t", "energy")
