"""Column names of callers' tables, which may be any, also those that an operator uses itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """`names`, each with underscores after it until no taken name equals it in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def schema_of(df: DataFrame, columns: list[str], more: str) -> StructType:
    """The columns' fields, and those of a DDL string after them."""
    fields = {f.name: f for f in df.schema.fields}
    return StructType([fields[c] for c in columns] + StructType.fromDDL(more).fields)
