"""Long-form reshaping helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.functions.columns import as_number


def to_long(df: DataFrame, cols, ids=(), name: str = "feature", value: str = "value") -> DataFrame:
    """Unpivot numeric ``cols`` to (ids..., feature, value double; NaN -> NULL). Rows x len(cols)."""
    ids = list(ids)
    cast = df.select(*ids, *[as_number(c).alias(c) for c in cols])
    return cast.unpivot(ids, list(cols), name, value)
