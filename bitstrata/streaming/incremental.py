"""Incremental operators on streams of trace rows: an extension beyond the batch engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from bitstrata.functions.bits import bits_of, exponent, sign


def stream_exponents(values: DataFrame, value: str = "v") -> DataFrame:
    """Running exponent counts of a stream of floats; state is one row a symbol."""
    return values.withColumn("bits", bits_of(F.col(value).cast("float"))).groupBy(exponent(F.col("bits")).alias("e")).agg(F.count("*").alias("n"))


def stream_window_stats(values: DataFrame, time: str, value: str = "v", window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Counts and sign balance a time window, closed `late` after its rows."""
    x = values.withColumn("bits", bits_of(F.col(value).cast("float"))).withWatermark(time, late)
    s = sign(F.col("bits"))
    return x.groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.sum(1 - 2 * s).alias("balance"), F.avg(exponent(F.col("bits"))).alias("mean_exponent"))


def stream_runs(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, length, value) of the runs that ended so far: the open run of each key is its state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, last = state.get if state.exists else (0, None)
        out = []
        for v in pd.concat(list(frames)).sort_values(order)[value].tolist():
            if last is not None and v != last:
                out.append((k[0], length, last))
                length = 0
            length, last = length + 1, v
        state.update((length, last))
        yield pd.DataFrame(out, columns=["key", "length", "value"])

    return rows.select(F.col(key).cast("long").alias("key"), order, F.col(value).cast("int").alias(value)).groupBy("key").applyInPandasWithState(step, "key long, length long, value int", "length long, last int", "append", GroupStateTimeout.NoTimeout)
