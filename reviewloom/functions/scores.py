"""Score columns: rescaling, the stored raw-score string and the valid domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom import schema


def rescale_score(score: Column) -> Column:
    """0..10 to -1.0..1.0; the unclear -1 becomes -1.2."""
    return ((score.cast("decimal(9,1)") - F.lit(5)) / F.lit(5)).cast(schema.SCORE)


def raw_score(rescaled: Column) -> Column:
    """The stored text of a score: ``1``, ``0``, ``-0.8``, and ``-`` when unclear.

    A missing score gives an empty text, which no stored score has.  Never being
    null keeps Spark from repeating the scoring in a not-null test at the scan.
    """
    plain = F.coalesce(F.regexp_replace(rescaled.cast(schema.SCORE).cast("string"), "\\.0$", ""), F.lit(""))
    return F.when(
        rescaled == F.lit(schema.UNCLEAR_RESCALED).cast(schema.SCORE), F.lit(schema.UNKNOWN_RAW)
    ).otherwise(plain)


def raw_phrase_score(flag: Column, rescaled: Column) -> Column:
    """As :func:`raw_score`, and ``-`` wherever the phrase is not discussed."""
    return F.when(flag == 0, F.lit(schema.UNKNOWN_RAW)).otherwise(raw_score(rescaled))


def is_valid_score(score: Column) -> Column:
    """Whole numbers from -1 to 10; anything else, null included, is invalid."""
    within = score.between(schema.UNCLEAR_SCORE, schema.HIGHEST_SCORE)
    return F.coalesce(within & (score == F.floor(score)), F.lit(False))


def exact_ratio(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole`` as a decimal rounded half up, null for an empty whole."""
    quotient = part.cast("decimal(24,6)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.round(quotient, digits).cast(f"decimal(32,{digits})")
