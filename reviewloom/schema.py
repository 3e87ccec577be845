"""Names, types and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# The two states of an unscored review and their shared raw score.
UNPROCESSED = "Unknown - Unprocessed"
PROCESSED_UNKNOWN = "Unknown - Processed"
UNKNOWN_RAW = "-"

# What a scorer may answer (0..10, -1 when unclear) and the
# rescaled value that stands for "unclear".
UNCLEAR_SCORE = -1
UNCLEAR_RESCALED = "-1.2"
LOWEST_SCORE = 0
HIGHEST_SCORE = 10

# Limits of one scoring batch and of one summary.
BATCH_ROWS = 50
SUMMARY_WORDS = 50
TOP_ASPECTS = 3
TOP_OPERATORS = 10

SCORE = T.DecimalType(3, 1)

# Scorer replies arrive as JSON numbers and are narrowed only after they have been
# checked to be whole.  Ids are read as decimals: a double would blur those above 2^53.
REPLY_ID = T.DecimalType(38, 6)

OVERALL_ITEM = T.StructType(
    [
        T.StructField("ReviewID", REPLY_ID),
        T.StructField("Sentiment", T.DoubleType()),
    ]
)
PHRASE_ITEM = T.StructType(
    [
        T.StructField("ReviewID", REPLY_ID),
        T.StructField("PhraseFlag", T.DoubleType()),
        T.StructField("Sentiment", T.DoubleType()),
    ]
)
SUMMARY_ITEM = T.StructType(
    [
        T.StructField("Summary", T.StringType()),
        T.StructField("Pros", T.StringType()),
        T.StructField("Cons", T.StringType()),
    ]
)
