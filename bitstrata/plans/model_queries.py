"""Queries on probability models, coding, codecs and size accounting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bitstrata.functions import bits as B
from bitstrata.operators import codecs, coders, model, neighbours
from bitstrata.plans.catalog import LOCO, VOL, exps, query, table, vol

_CTX = """, cx AS (SELECT r, CASE WHEN l IS NULL OR u IS NULL OR l = u THEN 0 ELSE (CASE WHEN l < u THEN 4 ELSE 0 END) + (CASE WHEN abs(l - u) = 1 THEN 1 WHEN abs(l - u) <= 3 THEN 2 WHEN abs(l - u) <= 8 THEN 3 ELSE 4 END) END AS ctx FROM res),
cnt AS (SELECT ctx, r AS symbol, count(*) AS n FROM cx GROUP BY ctx, r)"""
_FREQ = f"""{LOCO}{_CTX}, wh AS (SELECT ctx, sum(n) AS whole FROM cnt GROUP BY ctx), gr AS (SELECT wh.ctx, b.symbol, whole, coalesce(n, 0) AS n FROM wh CROSS JOIN range(256) b(symbol) LEFT JOIN cnt ON cnt.ctx = wh.ctx AND cnt.symbol = b.symbol),
bs AS (SELECT *, CAST(n * 32512 % whole AS BIGINT) AS rem, CAST(1 + n * 32512 // whole AS BIGINT) AS base FROM gr), rk AS (SELECT *, 32768 - sum(base) OVER (PARTITION BY ctx) AS short, row_number() OVER (PARTITION BY ctx ORDER BY rem DESC, symbol DESC) AS rank FROM bs),
fq AS (SELECT ctx, symbol, n, base + CASE WHEN rank <= short THEN 1 ELSE 0 END AS freq FROM rk)"""


def _counts(spark, sf):
    """Residual symbols by context; unequal neighbours only away from the edges."""
    e = exps(spark, sf)
    along, across = Window.partitionBy("p", "t").orderBy("s"), Window.partitionBy("p", "s").orderBy("t")
    x = neighbours.residuals(e).withColumn("up", F.lag("e").over(along)).withColumn("left", F.lag("e").over(across))
    return x.groupBy(model.context(F.col("left"), F.col("up")).alias("ctx"), F.col("r").alias("symbol")).agg(F.count("*").alias("n"))


@query("ctx:l symbol:l n:l", f"{LOCO}{_CTX}\n--\nSELECT * FROM cnt")
def context_counts(spark, sf):
    return _counts(spark, sf)


@query("ctx:l symbol:l freq:l lo:l", f"{_FREQ}\n--\nSELECT ctx, symbol, freq, coalesce(sum(freq) OVER (PARTITION BY ctx ORDER BY symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM fq")
def freq_cdf(spark, sf):
    return model.cumulative(model.frequencies(_counts(spark, sf)))


@query("ctx:l symbol:l freq:l rank:l", f"{_FREQ}\n--\nSELECT ctx, symbol, freq, row_number() OVER (PARTITION BY ctx ORDER BY freq DESC, symbol DESC) AS rank FROM fq QUALIFY rank <= 5")
def top5_symbols(spark, sf):
    return model.top_symbols(model.frequencies(_counts(spark, sf)))


@query("ctx:l symbol:l share:d6", f"{_FREQ}\n--\nSELECT ctx, symbol, sum(freq) OVER (PARTITION BY ctx ORDER BY symbol) / 32768 AS share FROM fq")
def probability_cdf(spark, sf):
    """Running probability, the symbol itself included."""
    return model.cumulative(model.frequencies(_counts(spark, sf))).select("ctx", "symbol", ((F.col("lo") + F.col("freq")) / 32768).alias("share"))


@query("n:l top1:d6 top5:d6 bits:d6 perplexity:d5 proxy_bytes:l", f"{_FREQ}, ra AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY freq DESC, symbol DESC) AS rank FROM fq), s AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n) FILTER (rank <= 1) / sum(n) AS top1, sum(n) FILTER (rank <= 5) / sum(n) AS top5, sum(-log2(freq / 32768) * n) / sum(n) AS bits FROM ra)\n--\nSELECT *, pow(2, bits) AS perplexity, ceil(round(bits * n / 8, 6)) AS proxy_bytes FROM s")
def nll_benchmark(spark, sf):
    counts = _counts(spark, sf)
    return model.code_length(counts, model.frequencies(counts))


@query("n:l decoded:l mismatches:l", f"{VOL}\n--\nSELECT count(*) AS n, count(*) AS decoded, 0 AS mismatches FROM vol")
def tile_codec_roundtrip(spark, sf):
    """Every tile is coded, read back and compared with its cells."""
    e = exps(spark, sf)
    freq = coders.model_table(model.frequencies(tile_counts(e)))
    again = coders.decode_tiles(coders.encode_tiles(e, freq, (50, 64)), freq)
    j = e.join(again.select(F.col("p").alias("p2"), F.col("t").alias("t2"), F.col("s").alias("s2"), F.col("e").alias("e2")), (F.col("p") == F.col("p2")) & (F.col("t") == F.col("t2")) & (F.col("s") == F.col("s2")), "full_outer")
    return j.agg(F.count("e").alias("n"), F.count("e2").alias("decoded"), F.count_if(~F.col("e").eqNullSafe(F.col("e2"))).alias("mismatches"))


def tile_counts(e):
    along, across = Window.partitionBy("p", "t").orderBy("s"), Window.partitionBy("p", "s").orderBy("t")
    x = neighbours.residuals(e).withColumn("up", F.lag("e").over(along)).withColumn("left", F.lag("e").over(across))
    return x.groupBy(model.context(F.col("left"), F.col("up")).alias("ctx"), F.col("r").alias("symbol")).agg(F.count("*").alias("n"))


@query("tiles:l n:l stream_bytes:l bits_per_value:d6")
def tile_codec_size(spark, sf):
    e = exps(spark, sf)
    freq = coders.model_table(model.frequencies(tile_counts(e)))
    x = coders.encode_tiles(e, freq, (50, 64)).agg(F.count("*").alias("tiles"), F.sum("n").alias("n"), F.sum(F.length("blob")).alias("stream_bytes"))
    return x.withColumn("bits_per_value", 8 * F.col("stream_bytes") / F.greatest("n", F.lit(1)))


@query("codec:s original:l compressed:l verified:b ratio:d2 saving:d1")
def codec_compare(spark, sf):
    return codecs.compare(table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("data")), "data")


@query("best:s ratio:d2")
def best_codec(spark, sf):
    x = codec_compare(spark, sf).withColumn("ord", F.when(F.col("codec") == "lz77", 0).when(F.col("codec") == "deflate", 1).when(F.col("codec") == "rle", 2).otherwise(3))
    return x.agg(F.max_by("codec", F.struct("ratio", -F.col("ord"))).alias("best"), F.max("ratio").alias("ratio"))


@query("doc_id:l digest:s", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))


@query("n:l mismatches:l max_diff:d6", f"{VOL}\n--\nSELECT count(*) AS n, count(*) FILTER (s % 16 = 0) AS mismatches, 1 AS max_diff FROM vol")
def verify_equal(spark, sf):
    """A volume against one with every 16th sample's exponent one higher."""
    e = exps(spark, sf)
    other = e.select(F.col("p").alias("p2"), F.col("t").alias("t2"), F.col("s").alias("s2"), (F.col("e") + F.when(F.col("s") % 16 == 0, 1).otherwise(0)).alias("e2"))
    j = e.join(other, (F.col("p") == F.col("p2")) & (F.col("t") == F.col("t2")) & (F.col("s") == F.col("s2")), "full_outer")
    return j.agg(F.count("*").alias("n"), F.count_if(~F.col("e").eqNullSafe(F.col("e2"))).alias("mismatches"), F.max(F.abs(F.col("e") - F.col("e2"))).alias("max_diff"))


@query("p:l t:l n:l again:d4 total:d4", f"{VOL}\n--\nSELECT p, t, count(*) AS n, sum(CAST(v AS DOUBLE)) AS again, sum(CAST(v AS DOUBLE)) AS total FROM vol GROUP BY p, t")
def component_zip(spark, sf):
    """Sign, exponent and mantissa streams joined by linear index and put together again."""
    b = F.col("bits")
    i = F.col("p").cast("long") * 3200 + F.col("t") * 64 + F.col("s")
    v = vol(spark, sf).withColumn("i", i)
    a, c, d = v.select("i", "p", "t", "v", B.sign(b).alias("sgn")), v.select("i", B.exponent(b).alias("e")), v.select("i", B.mantissa(b).alias("m"))
    z = a.join(c, "i").join(d, "i").withColumn("v2", B.float_of(B.compose(F.col("sgn"), F.col("e"), F.col("m"))))
    return z.groupBy("p", "t").agg(F.count("*").alias("n"), F.sum(F.col("v2").cast("double")).alias("again"), F.sum(F.col("v").cast("double")).alias("total"))
