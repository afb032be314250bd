"""Queries on mantissa scores, samples in regions, and training features."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitstrata.functions import bits as B
from bitstrata.operators import mantissa, neighbours, planning
from bitstrata.plans.catalog import SAMPLES, TRACES, VOL, exp_traces, query, vol
from bitstrata.plans.planning_queries import split_segments
from bitstrata.plans.stream_queries import traces

_NIB = f"""{VOL}, c AS (SELECT p, t, s, m, lag(m) OVER (PARTITION BY p, t ORDER BY s) AS ms, lag(m) OVER (PARTITION BY p, s ORDER BY t) AS mt FROM vol),
d AS (SELECT c.*, a.o AS t0, b.o AS s0 FROM c, (SELECT unnest([0, 10, 20, 30, 34]) AS o) a, (SELECT unnest([0, 10, 20, 30, 40, 48]) AS o) b WHERE t >= a.o AND t < a.o + 16 AND s >= b.o AND s < b.o + 16),
x AS (SELECT p, t0, s0, k, (m >> k) & 15 AS x, CASE WHEN s > s0 THEN CAST(((m >> k) & 15) = ((ms >> k) & 15) AS INTEGER) END AS es, CASE WHEN t > t0 THEN CAST(((m >> k) & 15) = ((mt >> k) & 15) AS INTEGER) END AS et FROM d, (SELECT unnest([19, 15, 4, 0]) AS k)),
n AS (SELECT p, t0, s0, k, x, count(*) AS n FROM x GROUP BY ALL), h AS (SELECT p, t0, s0, k, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM n GROUP BY p, t0, s0, k), e AS (SELECT p, t0, s0, k, 0.5 * (avg(es) + avg(et)) AS same FROM x GROUP BY p, t0, s0, k)"""


@query("p:l t0:l s0:l score:d6", f"{_NIB}\n--\nSELECT p, t0, s0, avg((4 - h) * least(h / 2.5, 1.0)) + 1.8 * avg(same) AS score FROM h JOIN e USING (p, t0, s0, k) GROUP BY p, t0, s0")
def mantissa_scores(spark, sf):
    """Nibble scores of every profile's windows."""
    cells = vol(spark, sf).select("p", "t", "s", B.mantissa(F.col("bits")).alias("m"))
    return mantissa.window_nibble_scores(cells, 16, 16, 10, TRACES, SAMPLES)


@query("p:l t:l s:l high:s low:s", f"{VOL}\n--\nSELECT p, t, s, lpad(bin(m >> 15), 8, '0') AS high, lpad(bin(m & 255), 8, '0') AS low FROM vol")
def mantissa_stream_bits(spark, sf):
    """Bits m22..m15 and m7..m0 of every value."""
    m = B.mantissa(F.col("bits"))
    text = lambda bits: F.array_join(F.transform(mantissa.stream_bits(m, bits), lambda x: x.cast("string")), "")
    return vol(spark, sf).select("p", "t", "s", text(mantissa.HIGH).alias("high"), text(mantissa.LOW).alias("low"))


_STREAM = f"""{VOL}, pr AS (SELECT p AS rp, quantile_cont(abs(CAST(v AS DOUBLE)), 0.2) AS p20, stddev_pop(CAST(v AS DOUBLE)) AS whole FROM vol GROUP BY p),
st AS (SELECT p, t, o AS start, s - o AS i, abs(CAST(v AS DOUBLE)) AS a, m, p20, whole FROM vol JOIN pr ON rp = p, (SELECT unnest(range(0, 25, 4)) AS o) WHERE s >= o AND s < o + 40),
ok AS (SELECT p, t, start, avg(CASE WHEN a > p20 THEN 1 ELSE 0 END) AS active, stddev_pop(a) AS sd, max(whole) AS whole, sqrt(pow(t - 25.0, 2) + pow(start + 20 - 32.0, 2)) AS d FROM st GROUP BY p, t, start),
bt AS (SELECT p, t, start, i, k, (m >> k) & 1 AS b FROM st, (SELECT unnest([22, 21, 20, 19, 18, 17, 16, 15, 7, 6, 5, 4, 3, 2, 1, 0]) AS k)),
lg AS (SELECT *, lag(b) OVER (PARTITION BY p, t, start, k ORDER BY i) AS pb FROM bt),
us AS (SELECT p, t, start, k, avg(CASE WHEN b = pb THEN 1 ELSE 0 END) FILTER (i > 0) * 4 * avg(b) * (1 - avg(b)) AS u FROM lg GROUP BY p, t, start, k),
rk AS (SELECT *, row_number() OVER (PARTITION BY p, t, start, k > 10 ORDER BY u DESC) AS rk FROM us),
co AS (SELECT p, t, start, round(1.15 * (0.7 * avg(u) FILTER (k > 10) + 0.3 * avg(u) FILTER (k > 10 AND rk <= 4)) + 0.25 * avg(u) FILTER (k < 10), 9) AS component FROM rk GROUP BY p, t, start),
sc AS (SELECT p, t AS trace, start, component, round(component * (0.75 + 0.25 * (1 - d / 30.0)) * least(1.2, 0.8 + 0.4 * active), 9) AS score FROM co JOIN ok USING (p, t, start) WHERE d <= 30 AND active >= 0.8 AND sd >= 0.08 * whole)"""


def _streams(spark, sf):
    m = F.transform("samples", lambda x: x)
    rows = traces(spark, sf).select("p", "t", "samples", F.posexplode(m).alias("s", "v"))
    cells = rows.select("p", "t", "s", "v", B.mantissa(B.bits_of("v")).alias("m"))
    x = cells.groupBy("p", "t").agg(F.sort_array(F.collect_list(F.struct("s", "v", "m"))).alias("x")).select("p", "t", F.col("x.v").alias("samples"), F.col("x.m").alias("m"))
    return mantissa.stream_scores(x, (25.0, 32.0), 30.0)


@query("p:l trace:l start:l component:d6 score:d6", f"{_STREAM}\n--\nSELECT * FROM sc")
def mantissa_stream_scores(spark, sf):
    """Active streams of 40 values near each profile's middle."""
    return _streams(spark, sf)


@query("p:l trace:l start:l score:d6 t0:l s0:l", f"{_STREAM}\n--\nSELECT p, trace, start, score, greatest(0, least(trace - 8, 50 - 16)) AS t0, greatest(0, least(start + 20 - 8, 64 - 16)) AS s0 FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY score DESC, trace, start) AS rn FROM sc) WHERE rn = 1")
def best_mantissa_stream(spark, sf):
    return mantissa.best_streams(_streams(spark, sf), (16, 16), TRACES, SAMPLES)




@query("segment_id:s n:l labels:l usable:l")
def sample_features(spark, sf):
    """Of each split segment its share of a sample, with patch and label of each sampled voxel: counts and sums."""
    segs = planning.allocate(split_segments(spark, sf), F.col("profiles") * (TRACES * SAMPLES), 2000, 50)
    found = planning.materialise(neighbours.patches(exp_traces(spark, sf)), segs.withColumn("n", F.col("samples")))
    label = F.element_at("value", 1)
    return found.groupBy("segment_id").agg(F.count("*").alias("n"), F.sum(label).alias("labels"), F.sum(F.size(F.filter("kind", lambda k: k > 0))).alias("usable"))


_RNG = f"{VOL}, rc AS (SELECT DISTINCT p AS rp, p % 7 AS lft, 50 - p % 5 AS rgt FROM vol)"


@query("p:l t:l s:l", f"{_RNG}\n--\nSELECT p, t, s FROM vol JOIN rc ON rp = p WHERE t >= lft AND t < rgt")
def roi_sample_all(spark, sf):
    """All voxels inside of each profile's rectangle: a sample without a limit."""
    v = vol(spark, sf)
    rects = v.select("p").distinct().select("p", (F.col("p") % 7).alias("left"), (F.lit(TRACES) - F.col("p") % 5).alias("right"))
    return planning.sample_in_rectangles(v.select("p", "t", "s"), rects, None)


@query("n:l outside:l")
def roi_sample(spark, sf):
    """1000 voxels inside of the rectangles, by hash; how many of them are not."""
    v = vol(spark, sf)
    rects = v.select("p").distinct().select("p", (F.col("p") % 7).alias("left"), (F.lit(TRACES) - F.col("p") % 5).alias("right"))
    x = planning.sample_in_rectangles(v.select("p", "t", "s"), rects, 1000)
    return x.agg(F.count("*").alias("n"), F.count_if((F.col("t") < F.col("p") % 7) | (F.col("t") >= TRACES - F.col("p") % 5)).alias("outside"))


@query("p:l t:l s:l v:d6", f"{VOL}, g AS (SELECT p, t, round(avg(abs(CAST(v AS DOUBLE))), 9) AS energy, count(*) FILTER (abs(v) > 0.001) AS live FROM vol WHERE s < 40 GROUP BY p, t), b AS (SELECT p AS bp, t AS bt FROM g WHERE live > 2 ORDER BY energy DESC, p, t LIMIT 1), o AS (SELECT bp + a AS p, bt + c AS t, a, c, s FROM b, range(2) x(a), range(2) y(c), (SELECT CAST(unnest(range(80)) AS INTEGER) AS s))\n--\nSELECT a AS p, c AS t, o.s, coalesce(v, 0) AS v FROM o LEFT JOIN vol ON vol.p = o.p AND vol.t = o.t AND vol.s = o.s")
def demo_volume(spark, sf):
    """Two by two traces of 80 samples at the trace with the most energy, zeros where the volume ends."""
    return planning.energy_crop(vol(spark, sf), (2, 2, 80), 40)
