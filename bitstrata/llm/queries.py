"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitstrata.llm import scratch
from bitstrata.llm.decontaminate import contaminated
from bitstrata.llm.language_id import held_out, identify
from bitstrata.llm.lattice_lm import lattice_scores
from bitstrata.llm.license_scan import scan
from bitstrata.llm.line_dedup import deduplicated_lines
from bitstrata.llm.mixing import mix
from bitstrata.llm.near_dedup import near_duplicates
from bitstrata.llm.token_counts import token_counts
from bitstrata.llm.token_file import read, write
from bitstrata.llm.topk_search import top_k

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def WORD_VOCABULARY() -> str:
    return vocabulary("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    hits = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = hits.select("doc_id", F.explode("hits").alias("h"))
    return hits.select("doc_id", F.col("h.item_id").alias("item_id"), F.col("h.n_shingles").alias("n_shingles"), F.col("h.n_common").alias("n_common"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, WORD_VOCABULARY())
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train=~held_out(F.col("doc_id"), 4, 2))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, those that stay, and a checksum of the text they make."""
    out = deduplicated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op6_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and license text or line that it holds."""
    return scan(table(spark, sf_dir, "documents"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), held_out(F.col("doc_id"), 5, 1))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is in a mixture that repeats no source more than twice."""
    out = mix(table(spark, sf_dir, "documents"), max_repeats=2.0)
    return out.select(F.col("id").alias("doc_id"), "source", "tokens", "repeats")


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_output": op3_token_output,
    "op4_language_id": op4_language_id,
    "op5_line_dedup": op5_line_dedup,
    "op6_threshold_topk": op6_threshold_topk,
    "op7_token_counts": op7_token_counts,
    "op8_license_scan": op8_license_scan,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_source_mixing": op10_source_mixing,
}
#: Word spans as DuckDB says them: A-Z lower-cased, parted at the six ASCII white-space characters.
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SHINGLES = "SELECT DISTINCT {id}, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM {words} WHERE len(w) > 0"
ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS ({_SHINGLES.format(id="doc_id", words="d")}), bs AS ({_SHINGLES.format(id="item_id", words="b")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_common
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= 0.8 * n_shingles""",
    "op6_threshold_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
}
