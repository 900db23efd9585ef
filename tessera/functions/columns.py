"""Choosing columns by exact name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, matched exactly.

    Works where ``df`` has further columns whose names repeat or differ only in case, which a plain
    select would call ambiguous; of several exact matches the first is taken."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])
