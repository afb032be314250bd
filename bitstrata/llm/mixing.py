"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source with token share p gets a weight in proportion to p ** a.  The exponent
a in [0, 1] is found by bisection on the table of sources: the entropy of the
weights falls with a, and so does the largest number of times a source has to
be repeated.  Four halvings are one small aggregate; the table of sources stays
distributed and only the two sums it needs come back.

The weights are realised as block permutations.  A source's documents are dealt
by hash into blocks, and blocks and documents have a pseudo-random order that
each epoch draws anew.  A source with budget b and size t is taken whole
floor(b / t) times; the rest of its budget goes to whole blocks in that order,
and to the documents at the head of the one block where it runs out.  Running
sums are taken over blocks, then inside a block, so a source that holds a third
of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitstrata.llm import scratch
from bitstrata.llm.names import col, fresh

#: Documents a block holds on average.
BLOCK_DOCS = 512
STEPS = 40


def entropy_bits(z: float, s: float) -> float:
    """Entropy in bits of p / z from z = sum p and s = sum p log2 p."""
    return log2(z) - s / z


def text_tokens(text: Column) -> Column:
    """Words of a text, by DataFrame functions: ends of runs without white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def row_key(id_col: str, source_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), col(id_col), col(source_col), col(text_col))


def source_weights(sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """sources (source, tokens) -> with share, weight, exponent, budget, epochs.

    Exactly one target: the entropy in bits of the weights, or the most often any
    source may be repeated.  Without `budget_tokens` the budget is the least at which
    every source is taken whole at least once.  A target that no exponent in [0, 1]
    meets gives the nearest end.  Sources without tokens have weight 0.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    live = sources.filter("tokens > 0")
    total = live.agg(F.sum("tokens").alias("t")).first().t or 0
    low, high = 0.0, 1.0
    share = F.col("tokens") / F.lit(float(total or 1))

    def over(exponents: list[float]) -> list[bool]:
        """Does each exponent flatten the shares more than the target asks for?"""
        out = []
        for k, a in enumerate(exponents):
            p = F.pow(share, F.lit(a))
            out += [F.sum(p).alias(f"z{k}"), F.sum(p * F.log2(p)).alias(f"s{k}"), F.max(p / F.col("tokens")).alias(f"most{k}"), F.min(p / F.col("tokens")).alias(f"least{k}")]
        r = live.agg(*out).first()
        if target_entropy is not None:
            return [entropy_bits(r[f"z{k}"], r[f"s{k}"]) > target_entropy for k in range(len(exponents))]
        return [(r[f"most{k}"] / r[f"least{k}"] if budget_tokens is None else r[f"most{k}"] / r[f"z{k}"] * budget_tokens) > max_repeats for k in range(len(exponents))]

    if total:
        flat, steep = over([0.0, 1.0])
        if not flat:
            high = 0.0
        elif steep:
            low = 1.0
        else:
            # four halvings in one aggregate: the 15 exponents that they could come to
            for _ in range(STEPS // 4):
                grid = [low + (high - low) * k / 16 for k in range(17)]
                at = sum(over(grid[1:16]))  # the more an exponent flattens, the less it is
                low, high = grid[at], grid[at + 1]
    a = high
    p = F.when(F.col("tokens") > 0, F.pow(share, F.lit(a))).otherwise(F.lit(0.0))
    z = live.agg(F.sum(F.pow(share, F.lit(a))).alias("z"), F.min(F.pow(share, F.lit(a)) / F.col("tokens")).alias("least")).first()
    budget = float(budget_tokens) if budget_tokens is not None else (z.z / z.least if z.z else 0.0)
    weight = p / F.lit(z.z or 1.0)
    # the source that is taken exactly once must not lose a document to rounding
    spent = F.floor(weight * F.lit(budget) + F.lit(1e-6) * F.col("tokens") / F.lit(1e3)).cast("long")
    return sources.select("source", "tokens", share.alias("share"), weight.alias("weight"), F.lit(a).alias("exponent"), spent.alias("budget"), F.when(F.col("tokens") > 0, spent / F.col("tokens")).otherwise(F.lit(0.0)).alias("epochs"))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_tokens: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(id, source, tokens, repeats): how often each row of `docs` is in the mixture.

    A null source is a source of its own.  Texts without words have no tokens: they
    cost nothing and are taken once in every epoch that their source is.  A source
    without any tokens is taken once.  Rows equal in id, source and text are drawn
    together and given once, with the tokens of all.  An empty table gives no rows.
    Taken tokens never exceed a source's budget, and miss it by less than one document.
    """
    own = docs.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"), text_tokens(col(text_col).cast("string")).alias("tokens"), row_key(id_col, source_col, text_col, seed).alias("h"))
    own = scratch.keep(own.groupBy("id", "source", "h").agg(F.sum("tokens").alias("tokens")), "sizes")
    sums = own.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    sums = scratch.keep(sums, "sources")
    weights = source_weights(sums.select("source", "tokens"), target_entropy, max_repeats, budget_tokens)
    plan = weights.join(sums.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).select("source", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("long").alias("whole"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("rest"), F.ceil(F.col("docs") / block_docs).alias("blocks"))
    plan = scratch.keep(plan, "plan")

    # how many blocks a source has and what is left of its budget travel by join: sources are far fewer than documents
    dealt = own.join(plan.select(F.col("source").alias("s"), "whole", "rest", "blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = F.xxhash64(F.lit(seed), F.col("whole"), F.col("h"))
    dealt = scratch.keep(dealt.withColumn("o", order).withColumn("block", F.pmod(F.col("h"), F.col("blocks"))), "dealt")
    blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.first("blocks").alias("blocks"))
    blocks = blocks.withColumn("o", F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("whole"), F.col("block")))
    # running sums over a source's blocks: in each of 1024 stretches of the order, then over the stretches
    blocks = scratch.keep(blocks.withColumn("stretch", F.shiftright("o", 54)), "blocks")
    upto = (Window.unboundedPreceding, -1)
    stretches = blocks.groupBy("source", "stretch").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(*upto)), F.lit(0)))
    inside = blocks.withColumn("own", F.coalesce(F.sum("n").over(Window.partitionBy("source", "stretch").orderBy("o", "block").rowsBetween(*upto)), F.lit(0)))
    placed = inside.join(stretches.select(F.col("source").alias("s"), F.col("stretch").alias("t"), "before"), F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t"))).select("source", "block", (F.col("rest") - F.col("own") - F.col("before")).alias("left"), "n")
    placed = scratch.keep(placed, "placed")

    at = dealt.join(placed.select(F.col("source").alias("s"), F.col("block").alias("b"), "left", "n"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    edge = (F.col("left") > 0) & (F.col("left") < F.col("n"))
    settled = at.filter(~edge).select("id", "source", "tokens", "h", (F.col("whole") + F.when((F.col("left") >= F.col("n")) & (F.col("left") > 0) & (F.col("tokens") > 0), 1).otherwise(0)).alias("repeats"))
    run = Window.partitionBy("source", "block").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    split = at.filter(edge).withColumn("sum", F.sum("tokens").over(run)).select("id", "source", "tokens", "h", (F.col("whole") + F.when((F.col("sum") <= F.col("left")) & (F.col("tokens") > 0), 1).otherwise(0)).alias("repeats"))
    return settled.unionByName(split).select("id", "source", "tokens", "h", F.col("repeats").cast("long").alias("repeats"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, **target) -> DataFrame:
    """The mixture itself: the rows of `docs`, each as often as `mix` says, with its columns,
    whatever their names.  Rows equal in id, source and text are each given as often as all
    of them were drawn together.  An empty table gives no rows."""
    i, k, h, n, copy = fresh(docs.columns, "id_2", "h_2", "h", "repeats", "copy")
    times = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, **target)
    times = times.select(F.col("id").alias(i), F.col("h").alias(k), F.col("repeats").alias(n)).filter(col(n) > 0)
    keyed = docs.withColumn(h, row_key(id_col, source_col, text_col, seed))
    out = keyed.join(times, (col(h) == col(k)) & col(id_col).eqNullSafe(col(i)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), col(n).cast("int")))).select(*[col(c) for c in docs.columns])
