"""Counts of reviews that are kept up to date: additions and retractions instead of counting anew.

A rollup has two tables of whole-number weights in a folder, a part for each number:

=======  =======================================================================================
reviews  VenueID, Review_DateID, ReviewSentimentID, ReviewRating, Written, N
phrases  VenueID, Review_DateID, PhraseSentimentFlagID, N, of reviews with a text
=======  =======================================================================================

``N`` counts the reviews, or flags of reviews, of a cell.  Part 0 counts all; each change adds a part, in which
the old state of a changed review counts -1 and the new one 1.  Cells of several parts add up, so no part is
ever rewritten, and a change that is stored again under its number replaces itself.
The dashboard queries take a star with a rollup as they take one without (``over``); they read
counts then, and the reviews only where these are narrowed by phrases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.session import keep_for_broadcast
from reviewloom.sources.star import ReviewStar

REVIEW_CELL = ["VenueID", "Review_DateID", "ReviewSentimentID", "ReviewRating", "Written"]
PHRASE_CELL = ["VenueID", "Review_DateID", "PhraseSentimentFlagID"]
TABLES = {
    "reviews": (REVIEW_CELL, "VenueID long, Review_DateID int, ReviewSentimentID int, ReviewRating int, Written boolean, N long"),
    "phrases": (PHRASE_CELL, "VenueID long, Review_DateID int, PhraseSentimentFlagID int, N long"),
}


def review_cells(reviews: DataFrame, n: int = 1) -> DataFrame:
    """Rows of the review table as cells of weight ``n``, not added up yet."""
    return reviews.withColumn("Written", F.col("ReviewText").isNotNull()).select(*REVIEW_CELL, F.lit(n).cast("long").alias("N"))


def phrase_cells(bridge: DataFrame, reviews: DataFrame, n: int = 1) -> DataFrame:
    """Rows of the bridge table as cells of weight ``n``."""
    written = reviews.where(F.col("ReviewText").isNotNull()).select("ReviewID", "VenueID", "Review_DateID")
    return bridge.select("ReviewID", "PhraseSentimentFlagID").join(written, "ReviewID").select(*PHRASE_CELL, F.lit(n).cast("long").alias("N"))


@dataclass(frozen=True)
class Rollup:
    folder: str

    def _write(self, cells: DataFrame, table: str, part: int) -> None:
        keys, kinds = TABLES[table]
        added = cells.groupBy(*keys).agg(F.sum("N").alias("N")).where("N <> 0")
        typed = added.select(*(F.col(name).cast(kind).alias(name) for name, kind in (field.split() for field in kinds.split(", "))))
        typed.write.mode("overwrite").parquet(f"{self.folder}/{table}/part={part}")

    def _read(self, spark: SparkSession, table: str) -> DataFrame:
        keys, kinds = TABLES[table]
        return spark.read.schema(f"{kinds}, part int").parquet(f"{self.folder}/{table}").select(*keys, "N")

    def reviews(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "reviews")

    def phrases(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "phrases")

    def build(self, star: ReviewStar) -> Rollup:
        """Count all reviews and flags as part 0."""
        self._write(review_cells(star.review), "reviews", 0)
        self._write(phrase_cells(star.phrase_review, star.review), "phrases", 0)
        return self

    def add_reviews(self, part: int, added: DataFrame, flags: DataFrame | None = None) -> None:
        """Count new rows of the review table, and the bridge rows that came with them."""
        self._write(review_cells(added), "reviews", part)
        if flags is not None:
            self._write(phrase_cells(flags, added), "phrases", part)

    def remove_reviews(self, part: int, removed: DataFrame, flags: DataFrame | None = None) -> None:
        """Take back rows of the review table, and their bridge rows."""
        self._write(review_cells(removed, -1), "reviews", part)
        if flags is not None:
            self._write(phrase_cells(flags, removed, -1), "phrases", part)

    def change_sentiments(self, part: int, reviews: DataFrame, changes: DataFrame) -> None:
        """Count the new sentiments of ``changes`` (ReviewID, ReviewSentimentID) in place of those in ``reviews``.

        Only changed rows are told apart, and only their counts are written.
        """
        new = changes.select("ReviewID", F.col("ReviewSentimentID").alias("_new"))
        changed = reviews.join(new, "ReviewID").where(~F.col("_new").eqNullSafe(F.col("ReviewSentimentID")))
        both = F.array(
            F.struct(F.col("ReviewSentimentID").cast("int").alias("state"), F.lit(-1).alias("n")),
            F.struct(F.col("_new").cast("int").alias("state"), F.lit(1).alias("n")),
        )
        rows = changed.withColumn("Written", F.col("ReviewText").isNotNull()).withColumn("_side", F.explode(both))
        cells = [F.col("_side.state").alias(name) if name == "ReviewSentimentID" else F.col(name) for name in REVIEW_CELL]
        self._write(rows.select(*cells, F.col("_side.n").cast("long").alias("N")), "reviews", part)

    def change_flags(self, part: int, reviews: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> None:
        """Count bridge rows that came, and take back those that went.

        They are written first, so that a few are broadcast and spare the reviews a shuffle.  More than that
        are never broadcast, however small their compressed files look.
        """

        def cells_of(flags: DataFrame, n: int) -> DataFrame:
            kept, small = keep_for_broadcast(flags.select("ReviewID", "PhraseSentimentFlagID"))
            return phrase_cells(kept if small else kept.hint("merge"), reviews, n)

        cells = cells_of(added, 1)
        if removed is not None:
            cells = cells.unionByName(cells_of(removed, -1))
        self._write(cells, "phrases", part)

    def compacted(self, spark: SparkSession, folder: str) -> Rollup:
        """The same counts as one part in another folder; readers change over when it is whole."""
        found = Rollup(folder)
        for table in TABLES:
            found._write(self._read(spark, table), table, 0)
        return found

    def over(self, star: ReviewStar) -> ReviewStar:
        """The star, whose dashboard queries read these counts."""
        spark = star.sentiment.sparkSession
        return star.counted_by(self.reviews(spark), self.phrases(spark))
