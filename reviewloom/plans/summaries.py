"""Summaries of venues, then of operators and regions from their venues."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom import schema
from reviewloom.functions.dates import window_ids
from reviewloom.functions.text import (
    alpha_only,
    aspects,
    clean_text,
    lexicon_score,
    sentences,
    word_count,
    word_list,
)
from reviewloom.operators.relational import key_of, venue_operator, venue_region, without
from reviewloom.operators.strongest import strongest_distinct
from reviewloom.operators.upserts import (
    RANGE_KEYS,
    absent_rows,
    date_range_upsert,
    insert_date_ranges,
    insert_if_absent,
)
from reviewloom.session import cut_lineage, keep_for_broadcast
from reviewloom.sources.star import ReviewStar

# A summariser takes some texts of one group and the category (Venue, Operator or
# Region), and returns (Summary, Pros, Cons).
Summariser = Callable[[list[str], str], tuple[str, str, str]]

# A combiner takes what was made of the parts of a group, each with its number of texts, and
# the category, and returns (Summary, Pros, Cons) of the whole.
Part = tuple[str, str, str, int]
Combiner = Callable[[list[Part], str], tuple[str, str, str]]

Keep = Callable[[DataFrame], DataFrame]


# ---- inputs ---------------------------------------------------------------

def range_id(date_range: DataFrame, start: int, end: int) -> Column:
    """Id of a stored window; null, and then no work, when it is not stored."""
    return (
        date_range.where((F.col("StartDateID") == start) & (F.col("EndDateID") == end))
        .agg(F.min("DateRangeID"))
        .scalar()
    )


def _open_venues(star: ReviewStar, start: int, end: int) -> DataFrame:
    """Venues without a summary for the window."""
    wanted = range_id(star.date_range, start, end)
    done = star.summary_venue.where(F.col("DateRangeID") == wanted)
    return without(star.venue.select("VenueID"), done, ["VenueID"]).where(wanted.isNotNull())


def _window_reviews(star: ReviewStar, start: int, end: int) -> DataFrame:
    return star.review.where(
        F.col("ReviewText").isNotNull() & F.col("Review_DateID").between(start, end)
    )


def remaining_venues(star: ReviewStar, start: int, end: int) -> DataFrame:
    """Number of venues that have reviews in the window and no summary yet."""
    reviewed = _window_reviews(star, start, end).select("VenueID").distinct()
    return reviewed.join(_open_venues(star, start, end), "VenueID", "left_semi").agg(
        F.count("*").alias("Remaining")
    )


def venue_inputs(star: ReviewStar, start: int, end: int) -> DataFrame:
    """Distinct texts of unsummarised venues in the window, with their latest date.

    Reviews of the other venues go before the texts are grouped.  The open venues are
    written while this is called, so that Spark knows their size: it broadcasts them, or
    shuffles both sides and splits a busy venue.
    """
    open_venues = cut_lineage(_open_venues(star, start, end))
    reviews = _window_reviews(star, start, end)
    return venue_texts(reviews.join(open_venues, "VenueID", "left_semi"))


def venue_texts(reviews: DataFrame) -> DataFrame:
    """Distinct texts of each venue with their latest date; copies are merged on the
    map side."""
    return reviews.groupBy("VenueID", "ReviewText").agg(F.max("Review_DateID").alias("Review_DateID"))


def operator_inputs(star: ReviewStar) -> DataFrame:
    """Distinct venue summaries of operators without a summary for that window."""
    rows = star.summary_venue.select("VenueID", "VenueSummary", "DateRangeID").join(
        venue_operator(star), "VenueID"
    )
    return (
        without(rows, star.summary_operator, ["OperatorID", "DateRangeID"])
        .select("VenueSummary", "OperatorID", "DateRangeID")
        .distinct()
    )


def remaining_operators(star: ReviewStar) -> DataFrame:
    return operator_inputs(star).select("OperatorID").distinct().agg(F.count("*").alias("Remaining"))


def region_inputs(star: ReviewStar) -> DataFrame:
    """Venue summaries of (operator, region) pairs without a summary for that window."""
    rows = (
        star.summary_venue.select("VenueID", "VenueSummary", "DateRangeID")
        .join(venue_operator(star).select("VenueID", "OperatorID"), "VenueID")
        .join(venue_region(star).select("VenueID", "RegionID"), "VenueID")
    )
    return without(rows, star.summary_region, ["RegionID", "OperatorID", "DateRangeID"]).select(
        "VenueID", "VenueSummary", "OperatorID", "DateRangeID", "RegionID"
    )


def remaining_regions(star: ReviewStar) -> DataFrame:
    return region_inputs(star).select("OperatorID", "RegionID").distinct().agg(
        F.count("*").alias("Remaining")
    )


# ---- the default summary --------------------------------------------------

def aspect_counts(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows of each group that mention an aspect, and rows in all.

    An aspect counts once for a row.  Every row also has one hit that is neither
    good nor bad: it carries the group's total through the same aggregation, and
    keeps groups without any aspect.
    """
    every_row = F.array(F.struct(F.lit(None).cast("boolean").alias("good"), F.lit("").alias("aspect")))
    hits = texts.select(*keys, word_list(clean_text(F.col(text))).alias("Words")).select(
        *keys, F.inline(F.concat(every_row, F.coalesce(aspects(F.col("Words")), F.array())))
    )
    counts = hits.groupBy(*keys, "good", "aspect").agg(F.count("*").alias("Mentions"))
    total = F.max(F.when(F.col("good").isNull(), F.col("Mentions"))).over(Window.partitionBy(*keys))
    return counts.withColumn("Total", total)


def top_aspects(
    texts: DataFrame, keys: list[str], text: str, top: int = schema.TOP_ASPECTS
) -> DataFrame:
    """Up to three pros and cons of each group, with the share of rows that name
    them to the nearest 10 %; ``-`` where there are none."""
    best_first = Window.partitionBy(*keys, "good").orderBy(F.desc("Mentions"), "aspect")
    share = F.round(F.col("Mentions") * 100 / F.col("Total"), -1).cast("int")
    ranked = (
        aspect_counts(texts, keys, text)
        .withColumn("Place", F.row_number().over(best_first))
        .where(F.col("Place") <= top)
        .withColumn("Label", F.concat("aspect", F.lit(" ("), share, F.lit("%)")))
    )

    def listed(good: bool) -> Column:
        labels = F.sort_array(F.collect_list(F.when(F.col("good") == good, F.struct("Place", "Label"))))
        joined = F.array_join(F.transform(labels, lambda row: row["Label"]), ", ")
        return F.coalesce(F.nullif(joined, F.lit("")), F.lit(schema.UNKNOWN_RAW))

    return ranked.groupBy(*keys).agg(listed(True).alias("Pros"), listed(False).alias("Cons"))


def summary_text(texts: DataFrame, keys: list[str], text: str, limit: int = schema.SUMMARY_WORDS) -> DataFrame:
    """The strongest sentences of each group, up to ``limit`` words in all.

    A longer sentence is cut into runs of ``limit`` words, which are sentences then.  A
    sentence has a word at least, so the first ``limit`` distinct ones of a group are enough to
    fill its summary, and each task keeps only those of its own rows before anything is shuffled.
    """
    strength = F.when(F.col("Score") < 0, 0).otherwise(F.abs(F.col("Score") - 5))
    candidates = (
        texts.select(*keys, F.explode(sentences(F.col(text), limit)).alias("Sentence"))
        .withColumn("Words", word_list(clean_text(F.col("Sentence"))))
        .withColumn("Score", lexicon_score(F.col("Words")))
        .select(*keys, "Sentence", strength.alias("Strength"))
    )
    so_far = Window.partitionBy(*keys).orderBy("Place").rowsBetween(Window.unboundedPreceding, 0)
    chosen = (
        strongest_distinct(candidates, keys, "Sentence", "Strength", limit)
        .withColumn("Total", F.sum(word_count(F.col("Sentence"))).over(so_far))
        .where(F.col("Total") <= limit)
    )
    ordered = F.sort_array(F.collect_list(F.struct("Place", "Sentence")))
    return chosen.groupBy(*keys).agg(
        F.concat(F.array_join(F.transform(ordered, lambda row: row["Sentence"]), ". "), F.lit(".")).alias("Summary")
    )


def summarise_group(texts: DataFrame, keys: list[str], text: str, category: str = "") -> DataFrame:
    """Summary, Pros and Cons of each group, whatever its category."""
    return (
        top_aspects(texts, keys, text)
        .join(summary_text(texts, keys, text), keys, "left")
        .select(*keys, F.coalesce("Summary", F.lit(schema.UNKNOWN_RAW)).alias("Summary"), "Pros", "Cons")
    )


# ---- a summary by a function of the user ----------------------------------

def summarise_with(
    texts: DataFrame, keys: list[str], text: str, category: str, summariser: Summariser,
    chunk: int = 200, combine: Combiner | None = None,
) -> DataFrame:
    """Summary, Pros and Cons of each group from a function of texts, and a Reason if it failed.

    A group of any size is read in parts of about ``chunk`` texts, and what was made of its
    parts is put together the same way until one part is left.  Every distinct text is read,
    and no call, row or task gets a whole large group.  Summaries of parts are summarised
    again; Pros and Cons, with their shares, then come from all the group's rows
    (:func:`top_aspects`), so that its size doesn't change what they mean.  With ``combine``
    that function puts the parts together instead, Pros and Cons included; it sees how many
    texts each part stands for, and a group of one part, too.
    A call that raises or returns something else than three texts gives its group a Reason.
    Each round is written to the checkpoint folder, so no call is made twice.
    """
    if chunk < 2:
        raise ValueError("a part has two texts or more")
    source = F.col(text)
    plain = alpha_only(source) if category == "Venue" else source
    rows = texts.select(*keys, plain.alias("Text")).where(F.col("Text").isNotNull()).distinct().select(
        *keys, F.struct("Text", F.lit("").alias("Pros"), F.lit("").alias("Cons"), F.lit(1).cast("long").alias("Texts"), F.xxhash64("Text").alias("Place")).alias("Item")
    )

    def read(items: list, category: str) -> tuple[str, str, str]:
        return summariser([item["Text"] for item in items], category)

    def join(items: list, category: str) -> tuple[str, str, str]:
        if combine is None:
            return read(items, category)
        return combine([(item["Text"], item["Pros"], item["Cons"], item["Texts"]) for item in items], category)

    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    finished, number = None, 0
    while True:
        # With a combiner its first call comes after the first round, whatever the size.
        last = largest <= chunk and (combine is None or number > 0)
        answers = cut_lineage(_summarise_parts(rows, keys, category, join if number else read, chunk))
        failed = answers.where(F.col("Reason").isNotNull())
        whole = F.col("Parts") == 1
        done = answers.where(whole & F.col("Reason").isNull()) if combine is None or number else answers.where(F.lit(False))
        # A failed part ends its group: one line says why.
        lines = failed.groupBy(*keys).agg(
            F.lit(None).cast("string").alias("Summary"), F.lit(None).cast("string").alias("Pros"),
            F.lit(None).cast("string").alias("Cons"), F.min("Reason").alias("Reason"),
        ).unionByName(done.select(*keys, "Summary", "Pros", "Cons", "Reason"))
        finished = lines if finished is None else finished.unionByName(lines)
        if last:
            break
        left = answers.where(F.col("Reason").isNull()) if combine is not None and not number else answers.where(~whole & F.col("Reason").isNull())
        rows = without(left, failed, keys).select(
            *keys, F.struct(F.col("Summary").alias("Text"), "Pros", "Cons", "Texts", F.col("Part").alias("Place")).alias("Item")
        )
        largest = math.ceil(largest / chunk)
        number += 1
    if combine is not None:
        return finished
    aspects_of = top_aspects(texts.select(*keys, plain.alias("_text")), keys, "_text")
    return finished.drop("Pros", "Cons").join(aspects_of, keys, "left").select(*keys, "Summary", "Pros", "Cons", "Reason")


def _summarise_parts(
    rows: DataFrame, keys: list[str], category: str, call: Callable, chunk: int
) -> DataFrame:
    """One call for each part.  Parts are as many as the group's own size asks for;
    places of its items differ, so dealing by them fills the parts evenly."""
    sizes, _ = keep_for_broadcast(rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias("Parts")))
    lists = (
        rows.join(sizes, keys)
        .groupBy(*keys, "Parts", F.pmod(F.col("Item.Place"), F.col("Parts")).alias("Part"))
        .agg(F.sort_array(F.collect_list("Item")).alias("Items"))
    )

    def attempt(items: list) -> tuple[str | None, str | None, str | None, str | None]:
        try:
            answer = call(items, category)
        except Exception as error:
            return None, None, None, f"summariser failed: {type(error).__name__}: {error}"[:500]
        if not (isinstance(answer, tuple | list) and len(answer) == 3 and all(isinstance(x, str) for x in answer)):
            return None, None, None, "unexpected reply"
        return (*answer, None)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = [attempt(list(found)) for found in frame["Items"]]
            out = frame[[*keys, "Parts", "Part"]].copy()
            for place, name in enumerate(("Summary", "Pros", "Cons", "Reason")):
                out[name] = pd.Series([result[place] for result in results], dtype=object, index=frame.index)
            out["Texts"] = [sum(int(item["Texts"]) for item in found) for found in frame["Items"]]
            yield out

    fields = [lists.schema[key] for key in [*keys, "Parts", "Part"]]
    more = [T.StructField("Reason", T.StringType()), T.StructField("Texts", T.LongType())]
    return lists.mapInPandas(answer, T.StructType([*fields, *schema.SUMMARY_ITEM.fields, *more]))


def json_summariser(ask: Callable[[str], str]) -> Summariser:
    """A summariser from a function of JSON, which has to return one record under one root key.

    It gets the category and the texts, and its record has to have the keys Summary, Pros and
    Cons and no others, all texts; anything else raises, which sets the group aside.
    """
    names = schema.SUMMARY_ITEM.fieldNames()

    def summarise(texts: list[str], category: str) -> tuple[str, str, str]:
        reply = json.loads(ask(json.dumps({"category": category, "texts": texts})))
        records = next(iter(reply.values())) if isinstance(reply, dict) and len(reply) == 1 else None
        if not isinstance(records, list) or len(records) != 1 or not isinstance(records[0], dict):
            raise ValueError("not one record under one root key")
        if sorted(records[0]) != sorted(names) or not all(isinstance(value, str) for value in records[0].values()):
            raise ValueError("unexpected keys")
        return tuple(records[0][name] for name in names)

    return summarise


# ---- staging and publishing -----------------------------------------------

def summary_is_short(summary: Column, limit: int = schema.SUMMARY_WORDS) -> Column:
    return word_count(summary) <= limit


def refused_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries that cannot be stored, with the Reason why not."""
    given = F.col("Reason") if "Reason" in summaries.columns else F.lit(None).cast("string")
    summary = F.col("Summary")
    reason = F.coalesce(
        given,
        F.when(summary.isNull() | (F.trim(summary) == ""), "empty summary"),
        F.when(~summary_is_short(summary), "too long"),
    )
    return summaries.withColumn("Reason", reason)


def _renamed(judged: DataFrame, category: str) -> DataFrame:
    return judged.where(F.col("Reason").isNull()).drop("Reason").withColumnsRenamed(
        {name: f"{category}{name}" for name in ("Summary", "Pros", "Cons")}
    )


GROUP_KEYS = ["VenueID", "OperatorID", "RegionID", "DateRangeID"]


def _judged(category: str, summaries: DataFrame, inputs: DataFrame, keys: list[str], keep: Keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The judged summaries of a level, kept; those refused; and the level's counts.

    The counts are observed while the summaries are written, so nothing is read again for them; groups left
    are counted on the kept inputs if someone asks.
    """
    seen = Observation()
    judged = keep(
        refused_summaries(summaries).observe(
            seen, F.count_if(F.col("Reason").isNull()).alias("Completed"), F.count("Reason").alias("Failed")
        )
    )
    missing = [F.lit(None).cast("long").alias(key) for key in GROUP_KEYS if key not in judged.columns]
    rejects = judged.where(F.col("Reason").isNotNull()).select(
        F.lit(category).alias("Category"), *missing,
        *[F.col(key).cast("long").alias(key) for key in GROUP_KEYS if key in judged.columns], "Summary", "Reason",
    ).select("Category", *GROUP_KEYS, "Summary", "Reason")
    waiting = inputs.select(*keys).distinct().agg(F.count("*").alias("Waiting"))
    counts = {name: F.lit(value).cast("long") for name, value in seen.get.items()}
    metrics = waiting.select(
        F.lit(category).alias("Category"), counts["Completed"].alias("Completed"), counts["Failed"].alias("Failed"),
        (F.col("Waiting") - counts["Completed"]).alias("Remaining"),
    )
    return judged, rejects, metrics


@dataclass(frozen=True)
class Level:
    """One level's summary table with the new rows; what was refused; its counts."""

    table: DataFrame
    rejects: DataFrame
    metrics: DataFrame


def venue_level(
    star: ReviewStar, start: int, end: int, summarise=summarise_group, keep: Keep = cut_lineage
) -> Level:
    """Venue summaries with those of the window added; the links stay 0 for now.

    Here and below ``keep`` writes the inputs, which a summary reads more than once, and the new
    summaries, and only those, since numbering, the next levels and the publishing all read them.
    """
    wanted = range_id(star.date_range, start, end)
    inputs = keep(venue_inputs(star, start, end).select("VenueID", "ReviewText"))
    made = summarise(inputs, ["VenueID"], "ReviewText", "Venue").withColumn("DateRangeID", wanted)
    judged, rejects, metrics = _judged("Venue", made, inputs, ["VenueID"], keep)
    rows = _renamed(judged, "Venue").select(
        "*",
        F.lit(0).alias("RegionSummaryID"),
        F.lit(0).alias("OperatorSummaryID"),
    )
    return Level(_staged(star.summary_venue, rows, ["VenueID", "DateRangeID"], "VenueSummaryID"), rejects, metrics)


def stage_venues(
    star: ReviewStar, start: int, end: int, summarise=summarise_group, keep: Keep = cut_lineage
) -> DataFrame:
    return venue_level(star, start, end, summarise, keep).table


def _staged(table: DataFrame, rows: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """The table with new rows, which numbering has written."""
    return table.unionByName(absent_rows(table, rows, keys, id_column))


def operator_level(star: ReviewStar, summarise=summarise_group, keep: Keep = cut_lineage) -> Level:
    keys = ["OperatorID", "DateRangeID"]
    inputs = keep(operator_inputs(star))
    judged, rejects, metrics = _judged("Operator", summarise(inputs, keys, "VenueSummary", "Operator"), inputs, keys, keep)
    return Level(_staged(star.summary_operator, _renamed(judged, "Operator"), keys, "OperatorSummaryID"), rejects, metrics)


def stage_operators(star: ReviewStar, summarise=summarise_group, keep: Keep = cut_lineage) -> DataFrame:
    return operator_level(star, summarise, keep).table


def region_level(star: ReviewStar, summarise=summarise_group, keep: Keep = cut_lineage) -> Level:
    """Region summaries; the unknown region gets dashes without being summarised."""
    keys = ["OperatorID", "RegionID", "DateRangeID"]
    inputs = keep(region_inputs(star))
    unknown = F.coalesce(key_of(star.region, "Region", schema.UNKNOWN_RAW, "RegionID"), F.lit(-1))
    dash = F.lit(schema.UNKNOWN_RAW)
    known = summarise(inputs.where(F.col("RegionID") != unknown), keys, "VenueSummary", "Region")
    dashes = inputs.where(F.col("RegionID") == unknown).select(*keys).distinct().select(
        *keys, dash.alias("Summary"), dash.alias("Pros"), dash.alias("Cons")
    )
    both = known.unionByName(dashes, allowMissingColumns=True)
    judged, rejects, metrics = _judged("Region", both, inputs, keys, keep)
    return Level(_staged(star.summary_region, _renamed(judged, "Region"), keys, "RegionSummaryID"), rejects, metrics)


def stage_regions(star: ReviewStar, summarise=summarise_group, keep: Keep = cut_lineage) -> DataFrame:
    return region_level(star, summarise, keep).table


def publish_summaries(star: ReviewStar, staged: ReviewStar) -> ReviewStar:
    """Append the staged rows the published tables lack.

    New venue summaries link to the published region and operator summaries of
    their venue, whose ids are the ones readers see.
    """
    date_range = insert_date_ranges(star.date_range, staged.date_range.select(*RANGE_KEYS))
    operators = insert_if_absent(
        star.summary_operator, staged.summary_operator, ["OperatorID", "DateRangeID"], "OperatorSummaryID"
    )
    regions = insert_if_absent(
        star.summary_region, staged.summary_region, ["OperatorID", "RegionID", "DateRangeID"], "RegionSummaryID"
    )
    linked = (
        staged.summary_venue.drop("VenueSummaryID", "RegionSummaryID", "OperatorSummaryID")
        .join(venue_operator(star).select("VenueID", "OperatorID"), "VenueID")
        .join(venue_region(star).select("VenueID", "RegionID"), "VenueID")
        .join(
            regions.select("RegionID", "OperatorID", "DateRangeID", "RegionSummaryID"),
            ["RegionID", "OperatorID", "DateRangeID"],
        )
        .join(
            operators.select("OperatorID", "DateRangeID", "OperatorSummaryID"),
            ["OperatorID", "DateRangeID"],
        )
        .drop("OperatorID", "RegionID")
    )
    venues = insert_if_absent(
        star.summary_venue, linked, ["VenueID", "DateRangeID"], "VenueSummaryID"
    )
    return star.replace(
        date_range=date_range,
        summary_operator=operators,
        summary_region=regions,
        summary_venue=venues,
    )


@dataclass(frozen=True)
class SummaryRun:
    """Staged and published tables, refused summaries with their Reason, counts of each level."""

    staged: ReviewStar
    published: ReviewStar
    rejects: DataFrame
    metrics: DataFrame


def summarise_all(
    star: ReviewStar, label: str, months: int, summarise=summarise_group, keep: Keep = cut_lineage
) -> SummaryRun:
    """Summarise every unsummarised venue, operator and region of a window.

    Three jobs in a row, each over all its groups at once.
    """
    start, end = window_ids(label, months)
    staged = star.replace(date_range=date_range_upsert(star.date_range, start, end, months))
    venues = venue_level(staged, start, end, summarise, keep)
    staged = staged.replace(summary_venue=venues.table)
    operators = operator_level(staged, summarise, keep)
    staged = staged.replace(summary_operator=operators.table)
    regions = region_level(staged, summarise, keep)
    staged = staged.replace(summary_region=regions.table)
    levels = (venues, operators, regions)
    return SummaryRun(
        staged,
        publish_summaries(star, staged),
        rejects=reduce(DataFrame.unionByName, [level.rejects for level in levels]),
        metrics=reduce(DataFrame.unionByName, [level.metrics for level in levels]),
    )
