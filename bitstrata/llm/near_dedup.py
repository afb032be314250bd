"""Near-duplicate documents: distinct five-word shingles, linked by min-max hashing.

At a similarity of 0.85 all 32 bands of five values miss a pair with probability 7e-9.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from bitstrata.llm import kernels as K
from bitstrata.llm import scratch, sketches
from bitstrata.llm.names import col, fresh
from bitstrata.llm.set_links import homes, linked

N_PERM, BAND_ROWS = 80, 5
LINK_NUM, LINK_DEN = 85, 100


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, link_num: int = LINK_NUM, link_den: int = LINK_DEN, n_perm: int = N_PERM, band_rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Ids are integers.  Null and empty texts, and texts without words, have no shingles
    and no links: their component is their own id.  Rows that repeat an id are one
    document and are each returned; so are rows with a null id (component null, kept).
    Equal sets are linked whatever their texts.  An empty table gives no rows.  Other
    columns are not read.
    """
    text = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    links = linked(text, lambda data, offsets: K.shingle_sets(data, offsets, size), link_num, link_den, n_perm, band_rows)
    out = links.items.join(homes(links), ["fp_hi", "fp_lo", "n"], "left")
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.col("component"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    return scratch.keep(out, "near_duplicates")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with their columns, whatever their names: those of one id
    of each component, and all with a null id.  Of rows equal in id and text one stays, that
    with the least hash of its other plain columns; rows that have one id and different texts
    are one document and stay or go together.  An empty table gives no rows."""
    found = near_duplicates(docs, id_col, text_col, **options)
    key, place = fresh(docs.columns, "gone", "place")
    gone = scratch.keep(found.filter(~F.col("kept")).select(F.col("doc_id").alias(key)), "gone")
    some, others = sketches.parted(docs, col(id_col).cast("long"), gone, key)
    out = others.unionByName(some.join(gone, col(id_col).cast("long") == col(key), "left_anti"))
    if not found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty():
        plain = [col(f.name) for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
        w = Window.partitionBy(col(id_col), col(text_col)).orderBy(F.xxhash64(*plain))
        one = out.filter(col(id_col).isNotNull()).withColumn(place, F.row_number().over(w)).filter(col(place) == 1).drop(place)
        out = one.unionByName(out.filter(col(id_col).isNull()))
    return out
