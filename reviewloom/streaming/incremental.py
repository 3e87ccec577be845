"""Scoring reviews as they arrive, by a stream whose progress is checkpointed.

Every micro-batch leaves the state that scoring all reviews at once would have left: a new copy of a text can make
older copies due, by being unprocessed itself or by its date, and copies of a text that has a
score get that score without asking for it again.

The state is a folder of Parquet tables, a part for each batch number:

========  ====================================================================================
arrived   ReviewID, TextKey, Dated, Open of every review with a text
texts     TextKey, Sentiment of every distinct text that was scored
scores    ReviewID, Sentiment of every review that got a score
rejected  TextKey, ReviewID, ReviewText of texts without an accepted score, asked for again later
========  ====================================================================================

A batch reads parts of smaller numbers only and replaces its own, so a batch that is repeated after a
failure, at whatever point, gives the same state.  Only the narrow columns of older reviews are read again, and
those of the texts at hand are picked by a broadcast as long as these are few (``keep_for_broadcast``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom import schema
from reviewloom.functions.text import text_key
from reviewloom.plans import scoring
from reviewloom.session import cut_lineage, keep_for_broadcast, kept_results

# Rows ReviewID, ReviewText with ids of their own in; ReviewID, Sentiment (rescaled) of those that got one out.
Score = Callable[[DataFrame], DataFrame]

PARTS = {
    "arrived": "ReviewID long, TextKey string, Dated boolean, Open boolean",
    "texts": "TextKey string, Sentiment decimal(3,1)",
    "scores": "ReviewID long, Sentiment decimal(3,1)",
    "rejected": "TextKey string, ReviewID long, ReviewText string",
}


@dataclass(frozen=True)
class ScoreStore:
    """The state in ``folder``.

    ``min_date`` is that of ``candidates_overall``.  A text whose score was refused is asked for again with
    each batch, ``attempts`` times in all.
    """

    folder: str
    min_date: int | None = None
    score: Score = scoring.score_reviews
    attempts: int = 3

    def _write(self, rows: DataFrame, part: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{part}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return rows.sparkSession.read.schema(PARTS[part]).parquet(path)

    def read(self, spark: SparkSession, part: str, before: int | None = None) -> DataFrame:
        """A table of the state; with ``before``, of the batches below that number."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
        rows = spark.read.schema(f"{PARTS[part]}, batch int").parquet(f"{self.folder}/{part}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def scores(self, spark: SparkSession) -> DataFrame:
        """``ReviewID, Sentiment`` of all reviews scored so far; of a review that came twice, the last."""
        return self.read(spark, "scores").groupBy("ReviewID").agg(F.max_by("Sentiment", "batch").alias("Sentiment"))

    def unscored_texts(self, spark: SparkSession) -> DataFrame:
        """Texts that have no score although they were asked for, with the number of attempts."""
        known = self.read(spark, "texts").select("TextKey")
        return self._rejected(spark, None).join(known, "TextKey", "left_anti")

    def _rejected(self, spark: SparkSession, before: int | None) -> DataFrame:
        return self.read(spark, "rejected", before).groupBy("TextKey").agg(
            F.min("ReviewID").alias("ReviewID"), F.any_value("ReviewText").alias("ReviewText"), F.count("*").alias("Attempts")
        )

    def absorb(self, reviews: DataFrame, batch: int, open_ids: DataFrame) -> None:
        """Take in one batch of rows of the review table; ``open_ids`` has the SentimentID of unprocessed reviews."""
        spark = reviews.sparkSession
        with kept_results(spark):
            dated = F.lit(True) if self.min_date is None else F.coalesce(F.col("Review_DateID") >= self.min_date, F.lit(False))
            is_open = F.broadcast(open_ids.select(F.col("SentimentID").alias("ReviewSentimentID"), F.lit(True).alias("_open")))
            written = cut_lineage(
                reviews.where(F.col("ReviewText").isNotNull()).join(is_open, "ReviewSentimentID", "left").select(
                    F.col("ReviewID").cast("long").alias("ReviewID"), text_key(F.col("ReviewText")).alias("TextKey"), "ReviewText",
                    dated.alias("Dated"), F.coalesce("_open", F.lit(False)).alias("Open"),
                )
            )
            own = self._write(written.select("ReviewID", "TextKey", "Dated", "Open"), "arrived", batch)
            self._score(written, own, batch)

    def _score(self, written: DataFrame, own: DataFrame, batch: int) -> None:
        spark = own.sparkSession
        known_texts = self.read(spark, "texts", batch).select("TextKey", "Sentiment")
        retried = self._rejected(spark, batch).where(F.col("Attempts") < self.attempts).join(known_texts, "TextKey", "left_anti")
        at_hand, _ = keep_for_broadcast(own.select("TextKey").unionByName(retried.select("TextKey")).distinct())
        known = cut_lineage(known_texts.join(at_hand, "TextKey", "left_semi"))
        older = self.read(spark, "arrived", batch).drop("batch").join(at_hand, "TextKey", "left_semi")
        rows = cut_lineage(older.withColumn("Older", F.lit(True)).unionByName(own.withColumn("Older", F.lit(False))))

        # When a text is due, and whether it was so before: a running maximum of dates in id order reaches the
        # minimum from the first dated id on.
        first = lambda only: F.min(F.when(F.col("Dated") & only, F.col("ReviewID")))
        due = (
            rows.groupBy("TextKey").agg(
                F.bool_or("Open").alias("Wanted"), first(F.lit(True)).alias("FirstID"),
                F.coalesce(F.bool_or(F.col("Open") & F.col("Older")), F.lit(False)).alias("WantedBefore"), first(F.col("Older")).alias("FirstBefore"),
            )
            .where("Wanted AND FirstID IS NOT NULL")
            .join(known, "TextKey", "left")
        )
        due = cut_lineage(due)

        # Texts without a score are asked for once, whatever their copies.
        asked = due.where(F.col("Sentiment").isNull()).select("TextKey")
        texts = written.select("TextKey", "ReviewID", "ReviewText").unionByName(retried.select("TextKey", "ReviewID", "ReviewText"))
        chosen = cut_lineage(
            texts.join(asked, "TextKey", "left_semi").groupBy("TextKey").agg(
                F.min("ReviewID").alias("ReviewID"), F.any_value("ReviewText").alias("ReviewText")
            )
        )
        scored = self.score(chosen.select("ReviewID", "ReviewText")).select("ReviewID", F.col("Sentiment").cast(schema.SCORE).alias("Sentiment"))
        fresh = self._write(chosen.join(scored, "ReviewID").select("TextKey", "Sentiment"), "texts", batch)
        self._write(chosen.join(fresh, "TextKey", "left_anti").select("TextKey", "ReviewID", "ReviewText"), "rejected", batch)

        # Reviews of a text that had a score before have theirs, as far as they were due then.
        done = F.col("Older") & F.col("Scored") & F.col("WantedBefore") & (F.col("ReviewID") >= F.coalesce("FirstBefore", F.lit((1 << 63) - 1)))
        found = due.withColumnRenamed("Sentiment", "Known").join(fresh, "TextKey", "left").select(
            "TextKey", "FirstID", "WantedBefore", "FirstBefore", F.col("Known").isNotNull().alias("Scored"), F.coalesce("Known", "Sentiment").alias("Sentiment")
        ).where(F.col("Sentiment").isNotNull())
        found, _ = keep_for_broadcast(found)
        self._write(
            rows.join(found, "TextKey").where((F.col("ReviewID") >= F.col("FirstID")) & ~done).select("ReviewID", "Sentiment"), "scores", batch
        )


def score_stream(reviews: DataFrame, store: ScoreStore, sentiment: DataFrame, available_now: bool = True) -> StreamingQuery:
    """Start scoring a streaming DataFrame of the review table's rows.

    Progress is kept beside the state: a stream started anew goes on where the last one ended, and repeats a batch that
    was not finished under its old number.  With ``available_now`` it ends when what there is has been read.
    """
    open_ids = sentiment.where(F.col("SentimentText") == schema.UNPROCESSED).select("SentimentID")

    def absorb(rows: DataFrame, batch: int) -> None:
        store.absorb(rows, batch, open_ids)

    writer = reviews.writeStream.foreachBatch(absorb).option("checkpointLocation", f"{store.folder}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
