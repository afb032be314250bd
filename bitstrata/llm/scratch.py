"""Tables between the steps of an operator, in the folder that driver and
executors share (``spark.checkpoint.dir``).

A written table cuts the lineage: after it, a lost executor costs the tasks of
one step.  Where the setting is absent on one machine (tests), a temporary folder is
made once and set; on a cluster that is an error, as executors would not share it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

ROW_GROUP = 16 << 20
_made: dict[str, object] = {}


def root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="bitstrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/bitstrata-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` written as Parquet and read again; row groups are small, so that any task can read a part."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{"parquet.block.size": str(ROW_GROUP)} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path  # type: ignore[attr-defined]
    return out


def drop(*tables: DataFrame | str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "scratch_path", None)
        spark = _made.pop(path, None) if path else None
        if spark is not None:
            jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)
    sc = SparkContext._active_spark_context
    if sc is not None:
        sc._jvm.System.gc()  # lets Spark's cleaner delete the shuffle files of steps that are over


@atexit.register
def _tidy() -> None:
    for path in list(_made):
        try:
            drop(path)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner clears it
            _made.pop(path, None)
