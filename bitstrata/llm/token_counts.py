"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitstrata.llm import kernels as K
from bitstrata.llm.subwords import pair_merges


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = pair_merges(path)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            n_bytes = np.diff(K.utf8(text)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_bytes), pa.array(counter.count(text))], names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, in one pass without a shuffle.

    Counts are those of the `tokenizers` library for a byte-level vocabulary, special
    strings in a text included.  Null and empty texts have no bytes and no tokens.
    Ids are passed through, null or repeated; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(_count(vocabulary), f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
