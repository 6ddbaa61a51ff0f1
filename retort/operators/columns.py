"""Column operators: add, rename, drop, keep and list properties."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _known(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")


def add(df: DataFrame, name: str, value: object) -> DataFrame:
    """A constant column; one of that name is replaced."""
    return df.withColumn(name, F.lit(value))


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """Fails if old is missing, where Spark would do nothing."""
    _known(df, [old])
    return df.withColumnRenamed(old, new)


def drop(df: DataFrame, *names: str) -> DataFrame:
    """Drops those that are there and warns of the rest."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        warnings.warn(f"no such column: {', '.join(missing)}", stacklevel=2)
    return df.drop(*names)


def keep(df: DataFrame, *names: str) -> DataFrame:
    """In the order asked for."""
    _known(df, list(names))
    return df.select(*names)


def listed(df: DataFrame) -> DataFrame:
    """A row for each column of df: position, column."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position int, column string")
