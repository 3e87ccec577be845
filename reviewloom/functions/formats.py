"""Numbers as the dashboard shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def display_number(value: Column, digits: int) -> Column:
    """Thousands separators, and no decimals for a whole number."""
    return F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(
        F.format_number(value, digits)
    )


def display_digits(kind: T.DataType) -> int:
    """Two decimals, or one for a decimal kept with a single place."""
    if isinstance(kind, T.DecimalType) and kind.scale == 1:
        return 1
    return 2


def format_stats(df: DataFrame) -> DataFrame:
    """Every numeric column of ``df`` as display text; the others as they are."""
    return df.select(
        *[
            display_number(F.col(field.name), display_digits(field.dataType)).alias(field.name)
            if isinstance(field.dataType, T.NumericType)
            else F.col(field.name)
            for field in df.schema.fields
        ]
    )


def percent_text(percent: Column, digits: int) -> Column:
    return F.concat(F.format_number(percent, digits), F.lit("%"))
