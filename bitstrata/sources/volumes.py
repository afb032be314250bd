"""Volumes as keyed voxel rows (p, t, s, v, bits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitstrata.functions.bits import bits_of, exponent
from bitstrata.sources.raw import read_raw


def voxels(traces: DataFrame, samples: str = "samples") -> DataFrame:
    """(p, t, samples) trace rows to voxel rows."""
    return traces.select("p", "t", F.posexplode(samples).alias("s", "v")).withColumn("bits", bits_of("v"))


def embedding_volume(spark: SparkSession, sf_dir: str, traces_per_profile: int = 50) -> DataFrame:
    """The `embeddings` table as a volume: one trace a vector."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = F.lit(traces_per_profile)
    return voxels(emb.select(F.floor(F.col("vec_id") / n).cast("int").alias("p"), (F.col("vec_id") % n).cast("int").alias("t"), F.col("embedding").alias("samples")))


def exponents(volume: DataFrame) -> DataFrame:
    return volume.select("p", "t", "s", exponent(F.col("bits")).alias("e"))


def padded(exps: DataFrame, profiles: int, traces: int, samples: int) -> DataFrame:
    """`exps` (p, t, s, e) and a 0 for each cell that it lacks of `profiles` whole profiles."""
    n = exps.groupBy(F.col("p").alias("q")).agg(F.count("*").alias("n"))
    every = exps.sparkSession.range(profiles).select(F.col("id").cast("int").alias("p"))
    short = every.join(n, F.col("p") == F.col("q"), "left").filter(F.coalesce("n", F.lit(0)) < traces * samples)
    cells = short.select("p", F.explode(F.sequence(F.lit(0), F.lit(traces - 1))).alias("t")).select("p", "t", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("s"))
    lacking = cells.join(exps.select("p", "t", "s"), ["p", "t", "s"], "left_anti").withColumn("e", F.lit(0))
    return exps.select("p", "t", "s", "e").unionByName(lacking)


def raw_volume(spark: SparkSession, uri: str, traces_per_profile: int, samples_per_trace: int) -> DataFrame:
    """Trace rows (p, t, samples) of little-endian float32 files, read by byte ranges."""
    n = F.lit(traces_per_profile)
    return read_raw(spark, uri, samples_per_trace).select(F.floor(F.col("trace") / n).cast("int").alias("p"), (F.col("trace") % n).cast("int").alias("t"), "samples")


def infer_profiles(size: Column, traces: int, samples: int) -> Column:
    """Profiles of a file of `size` bytes; null where they don't divide it."""
    n = F.floor(size / 4).cast("long")
    return F.when(n % (traces * samples) == 0, F.floor(n / (traces * samples)).cast("long"))


def linear_index(p: Column, t: Column, s: Column, traces: int, samples: int) -> Column:
    return p.cast("long") * (traces * samples) + t * samples + s


def from_linear(i: Column, profiles: int, traces: int, samples: int) -> tuple[Column, Column, Column]:
    return F.pmod(F.floor(i / (traces * samples)), F.lit(profiles)), F.floor(i / samples) % traces, i % samples


#: Synthetic volumes by rule: expressions over p, t, s.
SYNTHETIC = {
    "constant": lambda p, t, s, shape: F.lit(3.14159),
    "gradient": lambda p, t, s, shape: (10 * p + 0.1 * t + 0.01 * s) / (10.0 * (shape[0] - 1) + 0.1 * (shape[1] - 1) + 0.01 * (shape[2] - 1)) * 100,
    "pulse": lambda p, t, s, shape: F.when(F.floor(s / 10) % 2 == 0, 10.0).otherwise(-10.0),
    "noise": lambda p, t, s, shape: (F.pmod(F.xxhash64(p, t, s, F.lit(42)), F.lit(1 << 24)) / float(1 << 23) - 1.0) * F.when(F.pmod(F.xxhash64(s, t, p, F.lit(43)), F.lit(20)) == 0, 10.0).otherwise(1.0),
    "mixed": lambda p, t, s, shape: F.when(t < shape[1] / 2, 0.01 * s).otherwise((F.pmod(F.xxhash64(p, t, s, F.lit(999)), F.lit(1 << 24)) / float(1 << 23) - 1.0) * 5),
    "layers": lambda p, t, s, shape: F.exp(-F.pow((s - 40.0 - 0.2 * t) / 4, 2)) * 5 - F.exp(-F.pow((s - 90.0 + 0.1 * t) / 6, 2)) * 3,
    "smooth": lambda p, t, s, shape: F.sin(0.05 * t) + F.cos(0.03 * s) + 0.01 * p,
}


def synthetic_volume(spark: SparkSession, kind: str, shape: tuple[int, int, int] = (2, 100, 200)) -> DataFrame:
    n = shape[0] * shape[1] * shape[2]
    i = F.col("id")
    ids = spark.range(n).select(F.floor(i / (shape[1] * shape[2])).cast("int").alias("p"), (F.floor(i / shape[2]) % shape[1]).cast("int").alias("t"), (i % shape[2]).cast("int").alias("s"))
    return ids.withColumn("v", SYNTHETIC[kind](F.col("p"), F.col("t"), F.col("s"), shape).cast("float")).withColumn("bits", bits_of("v"))
