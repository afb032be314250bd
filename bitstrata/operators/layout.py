"""Survey layout from trace headers: inline groups, coordinate jumps, grid candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def inline_layout(headers: DataFrame) -> DataFrame:
    """(profile_count, traces_per_profile) by inline number, 0 left out: the one count there is, or the median's whole part."""
    per = headers.filter("inline <> 0").groupBy("inline").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("profile_count"), F.when(F.min("n") == F.max("n"), F.min("n")).otherwise(F.floor(F.percentile("n", F.lit(0.5)))).cast("long").alias("traces_per_profile"))


def jump_segments(headers: DataFrame, x: str | None, y: str, threshold: float, file_col: str = "file", order: str = "seq") -> DataFrame:
    """(file, segment, length): traces between jumps of a coordinate, inside each file."""
    w = Window.partitionBy(file_col).orderBy(order)
    jump = F.abs(F.col(y) - F.lag(y).over(w)) > threshold
    if x:
        jump = jump | (F.abs(F.col(x) - F.lag(x).over(w)) > threshold)
    h = headers.withColumn("new", F.coalesce(jump, F.lit(False)).cast("int")).withColumn("segment", F.sum("new").over(w))
    return h.groupBy(F.col(file_col).alias("file"), "segment").agg(F.count("*").alias("length"))


def modal_length(segments: DataFrame) -> DataFrame:
    """Most frequent segment length of each file; of several, the one met first."""
    c = segments.groupBy("file", "length").agg(F.count("*").alias("k"), F.min("segment").alias("first"))
    return c.groupBy("file").agg(F.max_by("length", F.struct("k", -F.col("first"))).alias("length"))


def header_axis(headers: DataFrame, field: str) -> DataFrame:
    """Distinct non-zero values of a field and what they make of the trace count."""
    a = headers.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col(field) != 0, F.col(field))).alias("distinct_values"))
    d = F.when(F.col("distinct_values") > 1, F.col("distinct_values"))
    return a.select("n", "distinct_values", F.floor(F.col("n") / d).alias("per_value"), (F.col("n") % d).alias("rest"))


def grid_score(coords: DataFrame, widths: list[int]) -> DataFrame:
    """Error of laying traces out in rows of each width: mean distance of steps in a row, and
    between rows, from their median steps (whole part)."""
    spark = coords.sparkSession
    w = spark.range(len(widths)).select(F.element_at(F.array(*[F.lit(x) for x in widths]), (F.col("id") + 1).cast("int")).alias("width"))
    c = coords.crossJoin(F.broadcast(w)).withColumn("row", F.floor(F.col("seq") / F.col("width"))).withColumn("col", F.col("seq") % F.col("width"))
    c = c.withColumn("last", F.floor(F.lit(coords.count()) / F.col("width"))).filter("row < last")
    inrow, incol = Window.partitionBy("width", "row").orderBy("col"), Window.partitionBy("width", "col").orderBy("row")
    steps = c.select("width", *[(F.col(a) - F.lag(a).over(v)).alias(f"{k}{a}") for k, v in (("r", inrow), ("c", incol)) for a in ("x", "y")])
    cols = ["rx", "ry", "cx", "cy"]
    med = steps.groupBy("width").agg(*[F.coalesce(F.percentile(k, F.lit(0.5)).cast("long"), F.lit(0)).alias(f"m{k}") for k in cols])
    err = steps.join(F.broadcast(med), "width").groupBy("width").agg(*[F.coalesce(F.avg(F.abs(F.col(k) - F.col(f"m{k}"))), F.lit(0.0)).alias(k) for k in cols])
    return err.select("width", F.round(sum((F.col(k) for k in cols), F.lit(0.0)), 6).alias("error"))


def best_grids(scores: DataFrame, top: int) -> DataFrame:
    """The `top` widths of least error, of equal ones the wider first."""
    return scores.orderBy("error", F.desc("width")).limit(top)


def factor_pairs(spark: SparkSession, n: int) -> DataFrame:
    a = F.col("id")
    return spark.range(1, int(n**0.5) + 1).filter(F.lit(n) % a == 0).select(a.alias("a"), F.floor(F.lit(n) / a).alias("b"))


def ragged_headers(headers: DataFrame) -> DataFrame:
    """Per subline: xline range, traces, distinct traces and whether they are gapless."""
    g = headers.groupBy("subline").agg(F.min("xline").alias("xline_start"), F.max("xline").alias("xline_end"), F.count("*").alias("n"), F.countDistinct("xline").alias("distinct_n"), F.count_if(F.col("cdp") != F.col("subline") * 10000 + F.col("xline")).alias("cdp_mismatch"))
    return g.withColumn("duplicates", F.col("n") - F.col("distinct_n")).withColumn("gapless", (F.col("xline_end") - F.col("xline_start") + 1 == F.col("distinct_n")).cast("int"))


def varying_fields(rows: DataFrame, fields: list[str], top: int) -> DataFrame:
    """Fields with several distinct values, one of them not 0; most varied first."""
    sums = rows.agg(*[F.countDistinct(f).alias(f"d_{f}") for f in fields], *[F.count_if(F.col(f) != 0).alias(f"z_{f}") for f in fields])
    each = sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"d_{f}").alias("distinct_values"), F.col(f"z_{f}").alias("nonzero")) for f in fields])).alias("x")).select("x.*")
    return each.filter("distinct_values > 1 and nonzero > 0").orderBy(F.desc("distinct_values"), "field").limit(top)


def profile_layout(traces: Column, manual: Column, inline: Column, crossline: Column) -> tuple[Column, Column]:
    """(traces per profile, where from): manual, inline, crossline, first usual divisor, else unknown."""
    usual = F.coalesce(*[F.when(traces % n == 0, F.lit(n)) for n in (600, 601, 2001, 500, 1000)])
    n = F.coalesce(manual, inline, crossline, usual)
    return n, F.when(manual.isNotNull(), "manual").when(inline.isNotNull(), "inline").when(crossline.isNotNull(), "crossline").when(usual.isNotNull(), "divisor").otherwise("unknown")
