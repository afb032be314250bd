"""Blocks, splits, segments, tiles and samples: what to read and in which pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def regular_blocks(spark: SparkSession, profiles: int, traces: int, samples: int, per_block: int) -> DataFrame:
    """Fixed-size profile blocks with offsets; the last is what remains, per_block <= 0 is one block."""
    size = per_block if per_block > 0 else profiles
    start = F.col("id") * size
    end = F.least(start + size, F.lit(profiles)) - 1
    x = spark.range(-(-profiles // size)).select(F.col("id").alias("block"), start.alias("profile_start"), end.alias("profile_end"))
    n = F.col("profile_end") - F.col("profile_start") + 1
    x = x.withColumn("profiles", n).withColumn("trace_offset", F.col("profile_start") * traces).withColumn("trace_count", F.col("profiles") * traces)
    return x.withColumn("value_offset", F.col("trace_offset") * samples).withColumn("value_count", F.col("trace_count") * samples).withColumn("byte_offset", F.col("value_offset") * 4).withColumn("byte_count", F.col("value_count") * 4)


def _blocked(rows: DataFrame, key: str, per_block: int) -> DataFrame:
    return rows.withColumn("_block", F.floor(F.col(key) / per_block))


def sum_before(rows: DataFrame, value: Column, name: str, key: str, order: list[str], per_block: int = 4096) -> DataFrame:
    """Adds the sum of `value` over all rows before, in an order that `key` leads; a task orders
    the rows of one range of the key, and only the ranges' sums are ordered together."""
    x = _blocked(rows, key, per_block)
    back = (Window.unboundedPreceding, -1)
    sums = x.groupBy("_block").agg(F.sum(value).alias("_sum"))
    sums = sums.select(F.col("_block").alias("_of"), F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(*back)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_block").orderBy(*order).rowsBetween(*back))
    return x.join(sums, F.col("_block") == F.col("_of")).withColumn(name, F.col("_before") + F.coalesce(own, F.lit(0))).drop("_block", "_of", "_before")


def row_before(rows: DataFrame, cols: list[str], name: str, key: str, order: list[str], per_block: int = 4096) -> DataFrame:
    """Adds the struct of `cols` of the row before, null at the first; ordered as in `sum_before`."""
    x = _blocked(rows, key, per_block)
    last = x.groupBy("_block").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last"))
    last = last.select(F.col("_block").alias("_of"), F.lag("_last").over(Window.orderBy("_block")).alias("_prev"))
    own = F.lag(F.struct(*cols)).over(Window.partitionBy("_block").orderBy(*order))
    return x.join(last, F.col("_block") == F.col("_of")).withColumn(name, F.coalesce(own, F.col("_prev"))).drop("_block", "_of", "_prev")


def with_trace_offsets(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Manifest rows with the traces before each; a manifest has a row a subline."""
    return sum_before(rows, F.col("trace_count"), "trace_offset", order, [order])


def ragged_blocks(rows: DataFrame, samples: int) -> DataFrame:
    """Maximal runs of consecutive sublines with one xline range and gapless offsets."""
    per, order = 1 << 19, ["trace_offset"]
    rows = row_before(rows, ["subline", "xline_start", "xline_end", "trace_count", "trace_offset"], "was", "trace_offset", order, per)
    same = (F.col("subline") == F.col("was.subline") + 1) & (F.col("xline_start") == F.col("was.xline_start")) & (F.col("xline_end") == F.col("was.xline_end")) & (F.col("trace_count") == F.col("was.trace_count")) & (F.col("trace_offset") == F.col("was.trace_offset") + F.col("was.trace_count"))
    rows = rows.withColumn("new", F.when(same, 0).otherwise(1))
    rows = sum_before(rows, F.col("new"), "g", "trace_offset", order, per).withColumn("g", F.col("g") + F.col("new"))
    b = rows.groupBy("g").agg(F.min("subline").alias("subline_start"), F.max("subline").alias("subline_end"), F.min("xline_start").alias("xline_start"), F.min("xline_end").alias("xline_end"), F.count("*").alias("profiles"), F.min("trace_count").alias("traces_per_profile"), F.min("trace_offset").alias("trace_offset"), F.sum("trace_count").alias("trace_count"))
    name = F.format_string("b%04d_s%d-%d_x%d-%d", F.col("g") - 1, "subline_start", "subline_end", "xline_start", "xline_end")
    return b.withColumn("block_id", name).withColumn("value_offset", F.col("trace_offset") * samples).withColumn("value_count", F.col("trace_count") * samples).withColumn("byte_offset", F.col("value_offset") * 4).drop("g")


def in_ranges(v: Column, ranges: list[tuple[int, int]]) -> Column:
    """Inclusive ranges, any of them."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | v.between(a, b)
    return out


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """'a-b' or 'a:b' or 'a', separated by commas, ends included."""
    out = []
    for part in filter(None, (x.strip() for x in text.split(","))):
        a, _, b = part.replace(":", "-").partition("-")
        lo, hi = int(a), int(b or a)
        if hi < lo:
            raise ValueError(f"range {part!r} ends before it starts")
        out.append((lo, hi))
    return out


def split_label(v: Column, val: list[tuple[int, int]], test: list[tuple[int, int]], full_train: bool = False) -> Column:
    """train, val or test; test wins over val."""
    if full_train:
        return F.lit("train")
    return F.when(in_ranges(v, test), "test").when(in_ranges(v, val), "val").otherwise("train")


def contiguous_split(p: Column, train: int, val: int, test: int, offset: int = 0) -> Column:
    """Half-open slices one after the other from an offset; null outside."""
    x = p - offset
    return F.when(x < 0, None).when(x < train, "train").when(x < train + val, "val").when(x < train + val + test, "test")


def segments(blocks: DataFrame, val: list[tuple[int, int]], test: list[tuple[int, int]]) -> DataFrame:
    """Runs of one split label inside each block (block, profile_start, profile_end)."""
    rows = blocks.select("block", F.explode(F.sequence("profile_start", "profile_end")).alias("profile"), "profile_start")
    rows = rows.withColumn("split", split_label(F.col("profile"), val, test))
    w = Window.partitionBy("block").orderBy("profile")
    rows = rows.withColumn("new", F.when(F.lag("split").over(w) == F.col("split"), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    s = rows.groupBy("block", "g", "split").agg(F.min("profile").alias("seg_start"), F.max("profile").alias("seg_end"), F.min(F.col("profile") - F.col("profile_start")).alias("local_start"), F.count("*").alias("profiles"))
    return s.withColumn("segment_id", F.format_string("block%d_%s_p%04d_%04d", "block", "split", "seg_start", "seg_end")).drop("g")


def allocate(segs: DataFrame, voxels: Column, total: int, least: int) -> DataFrame:
    """Samples a segment: its share of `total` rounded half to even, at least `least`, at most all."""
    whole = segs.agg(F.sum(voxels).alias("all_voxels"))
    share = F.bround(F.lit(total) * voxels / F.col("all_voxels"), 0).cast("long")
    return segs.crossJoin(F.broadcast(whole)).withColumn("samples", F.least(voxels, F.greatest(F.lit(least), share))).drop("all_voxels")


def prune_profiles(blocks: DataFrame, first: int, last: int, traces: int, samples: int) -> DataFrame:
    """The parts of blocks inside a profile range, with new offsets and counts."""
    a, b = F.greatest("profile_start", F.lit(first)), F.least("profile_end", F.lit(last))
    x = blocks.filter((F.col("profile_end") >= first) & (F.col("profile_start") <= last)).select("block", a.alias("profile_start"), b.alias("profile_end"))
    n = F.col("profile_end") - F.col("profile_start") + 1
    return x.withColumn("value_offset", F.col("profile_start") * (traces * samples)).withColumn("value_count", n * (traces * samples)).withColumn("byte_offset", F.col("value_offset") * 4)


def tiles(spark: SparkSession, shape: tuple[int, int, int], tile: tuple[int, int]) -> DataFrame:
    """(tile, p, t0, s0, h, w) in row-major order, smaller at the edges."""
    p, t, s = shape
    h, w = tile
    nt, ns = -(-t // h), -(-s // w)
    i = F.col("id")
    x = spark.range(p * nt * ns).select(i.alias("tile"), F.floor(i / (nt * ns)).alias("p"), (F.floor(i / ns) % nt * h).alias("t0"), (i % ns * w).alias("s0"))
    return x.withColumn("h", F.least(F.lit(h), F.lit(t) - F.col("t0"))).withColumn("w", F.least(F.lit(w), F.lit(s) - F.col("s0")))


def tile_steps(tile_rows: DataFrame, diagonal: bool) -> DataFrame:
    """(step, active): how many tiles code a cell at each lock step, raster or wavefront."""
    cells = tile_rows.select("tile", "h", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("ti")).select("tile", "ti", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("si"))
    if diagonal:
        return cells.groupBy((F.col("ti") + F.col("si")).alias("step")).agg(F.count("*").alias("cells"), F.countDistinct("tile").alias("active"))
    return cells.groupBy("ti", "si").agg(F.count("*").alias("active"))


def grid_sample(volume: DataFrame, dt: int, ds: int, left: Column | None = None) -> DataFrame:
    t = F.col("t") - (F.lit(0) if left is None else left)
    return volume.filter((t % max(1, dt) == 0) & (F.col("s") % max(1, ds) == 0))


def hash_sample(volume: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for any partitioning."""
    return volume.withColumn("_h", F.xxhash64("p", "t", "s", F.lit(seed))).orderBy("_h", "p", "t", "s").limit(n).drop("_h")


def sample_in_rectangles(volume: DataFrame, rects: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """n of the voxels (p, t, s) with t in [left, right) of their profile, or all of them; the same for any partitioning."""
    r = rects.select(F.col("p").alias("rp"), "left", "right")
    x = volume.join(r, F.col("p") == F.col("rp")).filter((F.col("t") >= F.col("left")) & (F.col("t") < F.col("right"))).drop("rp", "left", "right")
    return x if n is None else hash_sample(x, n, seed)


def margin_sample(volume: DataFrame, n: int, traces: int, samples: int, margin: int = 10, seed: int = 42) -> DataFrame:
    """n voxels at least `margin` from the ends of traces and samples."""
    inside = F.col("t").between(margin, traces - margin - 1) & F.col("s").between(margin, samples - margin - 1)
    return hash_sample(volume.filter(inside), n, seed)


def materialise(rows: DataFrame, segments_: DataFrame, seed: int = 42) -> DataFrame:
    """Rows (p, t, s, ...) sampled by segment (seg_start, seg_end, n): `n` of each, by hash, with segment_id and split.

    Rows meet their segment on the profile (segments don't overlap); only keys are ranked."""
    seg = segments_.select("segment_id", "split", F.col("n").alias("wanted"), F.explode(F.sequence("seg_start", "seg_end")).alias("sp"))
    x = rows.join(seg, F.col("p") == F.col("sp")).drop("sp")
    keys = x.select("segment_id", "wanted", "p", "t", "s", F.xxhash64("p", "t", "s", F.lit(seed)).alias("h"))
    w = Window.partitionBy("segment_id").orderBy("h", "p", "t", "s")
    picked = keys.withColumn("place", F.row_number().over(w)).filter("place <= wanted").select("p", "t", "s")
    return x.drop("wanted").join(picked, ["p", "t", "s"], "left_semi")


def energy_crop(volume: DataFrame, shape: tuple[int, int, int], first: int = 200) -> DataFrame:
    """(p, t, s, v) of a dense block of `shape` that starts at the trace with the most energy; zeros beyond the volume."""
    from bitstrata.operators.roi import max_energy

    spark = volume.sparkSession
    at = max_energy(volume.select("p", "t", "s", "v"), 1, 1, first).select(F.col("p").alias("p0"), F.col("t").alias("t0"))
    n_p, n_t, n_s = shape
    i = F.col("id")
    cells = spark.range(n_p * n_t * n_s).select(F.floor(i / (n_t * n_s)).cast("int").alias("a"), (F.floor(i / n_s) % n_t).cast("int").alias("b"), (i % n_s).cast("int").alias("s1")).crossJoin(F.broadcast(at))  # one row
    v = volume.select("p", "t", "s", "v")
    x = cells.join(v, (F.col("p") == F.col("p0") + F.col("a")) & (F.col("t") == F.col("t0") + F.col("b")) & (F.col("s") == F.col("s1")), "left")
    return x.select(F.col("a").alias("p"), F.col("b").alias("t"), F.col("s1").alias("s"), F.coalesce("v", F.lit(0.0)).alias("v"))
