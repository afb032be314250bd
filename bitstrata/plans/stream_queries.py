"""Queries on real coded streams: sizes, best candidates, schemes, and volumes read back from them."""

from __future__ import annotations

from pyspark.sql import functions as F


from bitstrata.operators import blocks, coders, model, streams
from bitstrata.plans.catalog import TRACES, VOL, exps, query, table
from bitstrata.plans.model_queries import tile_counts

PER_BLOCK = 16


def traces(spark, sf):
    """Trace rows of the volume; a vector without values is no trace."""
    n = F.lit(TRACES)
    return table(spark, sf, "embeddings").filter(F.size("embedding") > 0).select(F.floor(F.col("vec_id") / n).cast("int").alias("p"), (F.col("vec_id") % n).cast("int").alias("t"), F.col("embedding").alias("samples"))


def _model(spark, sf):
    return coders.model_table(model.frequencies(tile_counts(exps(spark, sf))))


_HEX = f"""{VOL}, x AS (SELECT p // {PER_BLOCK} AS block, row_number() OVER (PARTITION BY p // {PER_BLOCK} ORDER BY p, t, s) - 1 AS i, sgn, m, (m >> 4) & 32767 AS mid, (((m >> 19) & 15) << 4) | (m & 15) AS side FROM vol),
h AS (SELECT block, 'whole' AS stream, string_agg(printf('%02x%02x%02x', m & 255, (m >> 8) & 255, m >> 16), '' ORDER BY i) AS hex FROM x GROUP BY block
UNION ALL SELECT block, 'mid_words', string_agg(printf('%02x%02x', mid & 255, mid >> 8), '' ORDER BY i) FROM x GROUP BY block
UNION ALL SELECT block, 'mid_low', string_agg(printf('%02x', mid & 255), '' ORDER BY i) FROM x GROUP BY block
UNION ALL SELECT block, 'mid_high', string_agg(printf('%02x', mid >> 8), '' ORDER BY i) FROM x GROUP BY block
UNION ALL SELECT block, 'side_bytes', string_agg(printf('%02x', side), '' ORDER BY i) FROM x GROUP BY block
UNION ALL SELECT block, 'sign_bits', string_agg(printf('%02x', b), '' ORDER BY a) FROM (SELECT block, i // 8 AS a, CAST(sum(sgn << CAST(i % 8 AS INTEGER)) AS INTEGER) AS b FROM x GROUP BY ALL) GROUP BY block
UNION ALL SELECT block, 'mid_planes', string_agg(printf('%02x', b), '' ORDER BY k, a) FROM (SELECT block, k, i // 8 AS a, CAST(sum(((mid >> CAST(k AS INTEGER)) & 1) << CAST(7 - i % 8 AS INTEGER)) AS INTEGER) AS b FROM x, range(15) r(k) GROUP BY ALL) GROUP BY block
UNION ALL SELECT block, 'side_planes', string_agg(printf('%02x', b), '' ORDER BY k, a) FROM (SELECT block, k, i // 8 AS a, CAST(sum(((side >> CAST(k AS INTEGER)) & 1) << CAST(7 - i % 8 AS INTEGER)) AS INTEGER) AS b FROM x, range(8) r(k) GROUP BY ALL) GROUP BY block)"""


@query("block:l stream:s n_bytes:l sha256:s", f"{_HEX}\n--\nSELECT block, stream, length(hex) // 2 AS n_bytes, sha256(unhex(hex)) AS sha256 FROM h")
def aux_streams(spark, sf):
    """Sign and mantissa streams of each block of 16 profiles before compression, byte for byte."""
    return streams.digests(traces(spark, sf), PER_BLOCK).filter(~F.col("stream").isin("sign_runs", "sign_steps"))


_BRUN = f"""{VOL}, x AS (SELECT p // {PER_BLOCK} AS block, p, t, s, sgn FROM vol), n AS (SELECT *, CASE WHEN lag(sgn) OVER w = sgn THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY block ORDER BY p, t, s)),
g AS (SELECT *, sum(new) OVER (PARTITION BY block ORDER BY p, t, s ROWS UNBOUNDED PRECEDING) AS g FROM n), r AS (SELECT block, g, count(*) AS len FROM g GROUP BY block, g), d AS (SELECT block, g, len, len - coalesce(lag(len) OVER (PARTITION BY block ORDER BY g), len) AS step FROM r),
h AS (SELECT block, 'sign_runs' AS stream, string_agg(printf('%02x', len), '' ORDER BY g) AS hex FROM d GROUP BY block UNION ALL SELECT block, 'sign_steps', string_agg(printf('%02x%02x', step & 255, (step >> 8) & 255), '' ORDER BY g) FROM d GROUP BY block)"""


@query("block:l stream:s n_bytes:l sha256:s", f"{_BRUN}\n--\nSELECT block, stream, length(hex) // 2 AS n_bytes, sha256(unhex(hex)) AS sha256 FROM h")
def aux_sign_rle(spark, sf):
    """Run-length streams of each block's signs, byte for byte (runs here are shorter than 256)."""
    return streams.digests(traces(spark, sf), PER_BLOCK).filter(F.col("stream").isin("sign_runs", "sign_steps"))


@query("part:s method:s n:l raw:l bytes:l ok:b")
def aux_sizes(spark, sf):
    """Every candidate for signs and mantissas, compressed, read back and summed over blocks."""
    return streams.totals(streams.sizes(traces(spark, sf), PER_BLOCK))


@query("stream:s method:s size:l")
def best_method(spark, sf):
    """The smallest candidate of each part of the values, the first listed at a tie."""
    chosen = streams.best(streams.totals(streams.sizes(traces(spark, sf), PER_BLOCK)))
    return chosen.select(F.col("part").alias("stream"), "method", F.col("bytes").alias("size"))


@query("scheme:s n:l sign_bytes:l exponent_bytes:l mantissa_bytes:l total:l ratio:d6 saving:d6 bits_per_value:d6")
def scheme_summary(spark, sf):
    """Bytes of the two ways to store the volume, all of them of real streams, against plain float32."""
    x = traces(spark, sf)
    e = blocks.encode_blocks(blocks.exponent_traces(x), _model(spark, sf), "diag", PER_BLOCK).agg(F.sum(F.length("blob")).alias("e"))
    chosen = streams.best(streams.totals(streams.sizes(x, PER_BLOCK)))
    return streams.schemes(chosen, F.lit(int(e.first().e or 0)))


def _exponents_back(spark, sf, codec):
    x, freq = blocks.exponent_traces(traces(spark, sf)), _model(spark, sf)
    rects = x.groupBy("p").agg(F.min("t").alias("left")).select("p", (F.col("p") % 7).alias("left"), (F.lit(TRACES) - F.col("p") % 5).alias("right")) if codec != "diag" else None
    coded = blocks.encode_blocks(x, freq, codec, PER_BLOCK, rects)
    again = blocks.decode_blocks(coded, freq, codec)
    if codec == "raster":  # what lies outside is not in the stream
        x = x.select("p", "t", F.when((F.col("t") >= F.col("p") % 7) & (F.col("t") < TRACES - F.col("p") % 5), F.col("e")).otherwise(F.transform("e", lambda v: F.lit(0))).alias("e"))
    j = x.join(again.select("p", "t", F.col("e").alias("e2")), ["p", "t"], "full_outer")
    return j.agg(F.sum(F.coalesce(F.size("e"), F.lit(0))).alias("n"), F.sum(F.coalesce(F.size("e2"), F.lit(0))).alias("decoded"), F.count_if(~F.col("e").eqNullSafe(F.col("e2"))).alias("mismatches"))


_SAME = f"{VOL}\n--\nSELECT count(*) AS n, count(*) AS decoded, 0 AS mismatches FROM vol"


@query("n:l decoded:l mismatches:l", _SAME)
def diag_codec_roundtrip(spark, sf):
    """Exponents of each block coded by wavefronts and read back from the stream alone."""
    return _exponents_back(spark, sf, "diag")


@query("n:l decoded:l mismatches:l", _SAME)
def raster_codec_roundtrip(spark, sf):
    """Exponents inside a rectangle of each profile, cell by cell; outside is zero."""
    return _exponents_back(spark, sf, "raster")


@query("n:l decoded:l mismatches:l", _SAME)
def hybrid_codec_roundtrip(spark, sf):
    """The rectangle by the model, the rest by zstd, put together again."""
    return _exponents_back(spark, sf, "hybrid")


@query("codec:s n:l inside:l stream_bytes:l bits_per_value:d6")
def block_codec_sizes(spark, sf):
    x, freq = blocks.exponent_traces(traces(spark, sf)), _model(spark, sf)
    rects = x.select("p").distinct().select("p", (F.col("p") % 7).alias("left"), (F.lit(TRACES) - F.col("p") % 5).alias("right"))
    out = None
    for codec in ("diag", "raster", "hybrid"):
        one = blocks.encode_blocks(x, freq, codec, PER_BLOCK, None if codec == "diag" else rects).agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"), F.sum(F.length("blob")).alias("stream_bytes"))
        one = one.select(F.lit(codec).alias("codec"), "*", (8 * F.col("stream_bytes") / F.greatest("n", F.lit(1))).alias("bits_per_value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("p:l t:l n:l total:d4 mismatches:l", f"{VOL}\n--\nSELECT p, t, count(*) AS n, sum(CAST(v AS DOUBLE)) AS total, 0 AS mismatches FROM vol GROUP BY p, t")
def volume_roundtrip(spark, sf):
    """All values from three streams (zlib signs, zlib mantissas, wavefront exponents) alone, held against the volume."""
    x, freq = traces(spark, sf), _model(spark, sf)
    e = blocks.decode_blocks(blocks.encode_blocks(blocks.exponent_traces(x), freq, "diag", PER_BLOCK), freq)
    again = streams.unpack_values(streams.pack_values(x, PER_BLOCK), e)
    j = x.join(again.select("p", "t", F.col("samples").alias("again")), ["p", "t"], "full_outer")
    total = F.aggregate("again", F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double"))
    return j.select("p", "t", F.size("again").alias("n"), total.alias("total"), (~F.col("samples").eqNullSafe(F.col("again"))).cast("int").alias("mismatches"))


