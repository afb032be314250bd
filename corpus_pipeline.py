"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet and read again, so a lost executor never reaches back
beyond one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitstrata.llm import scratch
from bitstrata.llm.decontaminate import contaminated
from bitstrata.llm.language_id import identify
from bitstrata.llm.mixing import mixed
from bitstrata.llm.names import col, fresh
from bitstrata.llm.near_dedup import deduplicated
from bitstrata.llm.queries import WORD_VOCABULARY, table
from bitstrata.llm.token_file import read, write


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is beyond doubt too far from all known ones, or that have no
    letters (null and empty texts too), go.  Repeated rows are judged one by one; null ids and
    labels only take no part in the learning.  An empty table stays empty.  Columns may have any names."""
    new = fresh(docs.columns, "lang_pred", "score", "rejected")
    found = identify(docs, carry=tuple(docs.columns), names=tuple(new))
    return found.filter(~col(new[2])).select(*[col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id (five-word
    shingles, similarity 0.8; 40 bands of four miss a pair at 0.8 with probability 7e-10).
    Texts without words have no copies, rows with a null id all stay, rows equal in id and
    text are one.  An empty table stays empty.  Columns may have any names."""
    return deduplicated(docs, link_num=80, link_den=100, band_rows=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item to 0.8 of its shingles go.  Texts without words hold
    none; repeated rows and null ids are judged by their text.  An empty table stays empty.
    Columns may have any names."""
    (hits,) = fresh(docs.columns, "hits")
    return contaminated(docs, table(spark, sf_dir, "benchmark"), hits_col=hits).filter(F.size(col(hits)) == 0).select(*[col(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source whole at least once, small ones up to twice.  A null source is a source of
    its own, texts without words cost nothing, equal rows are drawn together.  An empty table
    stays empty.  Columns may have any names."""
    return mixed(docs, max_repeats=2.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the coded file.  A null
    or empty text has the end id alone; null ids come first, repeated rows follow each other.
    An empty table gives no rows."""
    path = scratch.new_path(spark, "tokens")
    write(docs, path, WORD_VOCABULARY())
    return read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The tokenizer, the hashed permutations and k-means are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage has read is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.drop(getattr(before, "scratch_path", ""))
    return STAGES[-1][1](spark, docs, sf_dir)
