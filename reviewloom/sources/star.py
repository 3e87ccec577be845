"""The star of reviews that every plan works on."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.sources.tables import Reader

# Table names in a stored star, by field.
TABLES = {
    "review": "Review",
    "venue": "Venue",
    "brand": "Brand",
    "operator": "Operator",
    "postcode": "Postcode",
    "region": "Region",
    "dates": "Dates",
    "sentiment": "Sentiment",
    "phrase_flag": "Phrase_SentimentFlag",
    "phrase_review": "Phrase_SentimentReview",
    "date_range": "DateRange",
    "summary_venue": "Summary_Venue",
    "summary_operator": "Summary_Operator",
    "summary_region": "Summary_Region",
    "venue_export": "vw_VenueExport",
}


class ReviewStar:
    """The tables as attributes, each opened when it is first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        unknown = set(makers) - set(TABLES)
        if unknown:
            raise ValueError(f"not tables of the star: {sorted(unknown)}")
        self._makers = dict(makers)
        # Counts that stand for the reviews and their flags, if there are any.
        self.review_counts: DataFrame | None = None
        self.phrase_counts: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._makers:
            raise AttributeError(name)
        table = self._makers[name]()
        setattr(self, name, table)
        return table

    def replace(self, **tables: DataFrame) -> ReviewStar:
        """The same star with other contents in some tables."""
        made = {name: (lambda table=table: table) for name, table in tables.items()}
        return ReviewStar({**{name: (lambda name=name: getattr(self, name)) for name in self._makers}, **made})

    def counted_by(self, review_counts: DataFrame, phrase_counts: DataFrame) -> ReviewStar:
        """The same star with counts, which dashboard queries read in place of the reviews."""
        star = self.replace()
        star.review_counts, star.phrase_counts = review_counts, phrase_counts
        return star


def read_star(read: Reader) -> ReviewStar:
    """A star whose tables are kept under their own names."""
    return ReviewStar({field: (lambda name=name: read(name)) for field, name in TABLES.items()})


def star_from_orders(spark, folder: str) -> ReviewStar:
    """A star derived from order, customer, nation, region, part and line tables.

    Orders become reviews, customers venues, nations both brands and operators.
    """

    @cache
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    def derived(name: str, *columns: str) -> Callable[[], DataFrame]:
        def make() -> DataFrame:
            return table(name).selectExpr(*columns)

        return make

    star = ReviewStar(
        {
            "review": derived("orders", *_REVIEW),
            "venue": derived("customer", *_VENUE),
            # Brands belong to the first twelve operators only; the others have none.
            "brand": derived("nation", "n_nationkey AS BrandID", "n_nationkey % 12 AS OperatorID"),
            "operator": derived(
                "nation", "n_nationkey AS OperatorID", "concat('OPERATOR ', n_nationkey) AS OperatorName"
            ),
            "postcode": derived(
                "nation",
                "n_nationkey AS PostcodeID",
                "CASE WHEN n_nationkey >= 23 THEN 99 ELSE n_regionkey END AS RegionID",
            ),
            "region": lambda: table("region")
            .selectExpr("r_regionkey AS RegionID", "r_name AS Region")
            .unionByName(spark.sql("SELECT 99 AS RegionID, '-' AS Region")),
            "dates": lambda: derived(
                "orders", f"{_DATE_ID} AS DateID", "to_date(o_orderdate) AS ActualDate"
            )().distinct(),
            "sentiment": lambda: _sentiments(spark),
            "phrase_flag": lambda: derived("part", "CAST(p_partkey % 78 AS int) AS k")()
            .distinct()
            .selectExpr(*_FLAG),
            # Orders of which over a third of the lines were returned have a flag; all lines are read for that.
            "phrase_review": lambda: table("lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.sum("l_quantity").alias("quantity"),
                F.count("*").alias("lines"),
                F.count_if(F.col("l_returnflag") == "A").alias("returned"),
            )
            .where("returned * 3 > lines")
            .selectExpr("l_orderkey AS ReviewID", f"{_FLAG_OF_REVIEW} AS PhraseSentimentFlagID"),
            "date_range": lambda: spark.sql(
                """SELECT 1 AS DateRangeID, 19980228 AS StartDateID, 19990228 AS EndDateID, 12 AS Months
                UNION ALL SELECT 2, 19970228, 19980228, 12 UNION ALL SELECT 3, 19960228, 19970228, 12"""
            ),
            # Every venue, operator and region is summarised for one of the windows.
            "summary_venue": derived("customer", *_SUMMARY_VENUE),
            "summary_operator": derived("nation", *_SUMMARY_OPERATOR),
            "summary_region": derived("nation", *_SUMMARY_REGION),
            "venue_export": lambda: star.venue.join(star.brand, "BrandID")
            .join(star.operator, "OperatorID")
            .select("OperatorVenueCode", "OperatorName"),
        }
    )
    return star


def _sentiments(spark) -> DataFrame:
    """The two unknown states, then -1.0 to 1.0 in steps of 0.2."""
    return spark.sql(
        """
        SELECT 1 AS SentimentID, 'Unknown - Unprocessed' AS SentimentText,
               '-' AS SentimentRawScore, CAST(NULL AS decimal(3,1)) AS SentimentScore
        UNION ALL SELECT 2, 'Unknown - Processed', '-', NULL
        UNION ALL
        SELECT CAST(8 + step AS int),
               CASE WHEN step < 0 THEN 'Negative' WHEN step = 0 THEN 'Neutral' ELSE 'Positive' END,
               regexp_replace(CAST(CAST(step * 0.2 AS decimal(3,1)) AS string), '\\\\.0$', ''),
               CAST(step * 0.2 AS decimal(3,1))
        FROM (SELECT id AS step FROM range(-5, 6))
        """
    )


_DATE_ID = "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)"

_REVIEW = [
    "o_orderkey AS ReviewID",
    "o_custkey AS VenueID",
    f"{_DATE_ID} AS Review_DateID",
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS int) END AS ReviewRating",
    """CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('The ',
        CASE o_orderkey % 6 WHEN 0 THEN 'staff' WHEN 1 THEN 'food' WHEN 2 THEN 'atmosphere'
            WHEN 3 THEN 'price' WHEN 4 THEN 'drinks' ELSE 'portion' END, ' ',
        CASE WHEN o_orderkey % 5 = 0 THEN 'wasn\\'t' ELSE 'was' END, ' ',
        CASE o_orderkey % 7 WHEN 0 THEN 'great' WHEN 1 THEN 'friendly' WHEN 2 THEN 'cold'
            WHEN 3 THEN 'terrible' WHEN 4 THEN 'lovely' WHEN 5 THEN 'fine' ELSE 'slow' END,
        CASE WHEN o_orderkey % 3 = 0 THEN '!' WHEN o_orderkey % 3 = 1 THEN ' & we\\'ll be back.' ELSE '' END,
        CASE WHEN o_orderkey % 2 = 0 THEN concat(' Table ', CAST(o_orderkey % 120 AS string), '.') ELSE '' END)
       END AS ReviewText""",
    """CAST(CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 < 3 THEN 1
                 WHEN o_orderkey % 13 = 0 THEN 2
                 ELSE 3 + (o_custkey + o_orderkey) % 11 END AS int) AS ReviewSentimentID""",
]

_VENUE = [
    "c_custkey AS VenueID",
    "CAST(c_custkey % 25 AS int) AS BrandID",
    "c_nationkey AS PostcodeID",
    "concat('OV', c_custkey) AS OperatorVenueCode",
]

_SUMMARY_VENUE = [
    "CAST(c_custkey + 1 AS int) AS VenueSummaryID",
    "concat('The staff was great. Seed ', c_mktsegment) AS VenueSummary",
    "'-' AS VenuePros",
    "'-' AS VenueCons",
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS DateRangeID",
    "c_custkey AS VenueID",
    "0 AS RegionSummaryID",
    "0 AS OperatorSummaryID",
]

_SUMMARY_OPERATOR = [
    "n_nationkey + 1 AS OperatorSummaryID",
    "'seed' AS OperatorSummary",
    "'-' AS OperatorPros",
    "'-' AS OperatorCons",
    "CASE WHEN n_regionkey = 0 THEN 1 ELSE 3 END AS DateRangeID",
    "n_nationkey AS OperatorID",
]

_SUMMARY_REGION = [
    "n_nationkey + 1 AS RegionSummaryID",
    "'seed' AS RegionSummary",
    "'-' AS RegionPros",
    "'-' AS RegionCons",
    "CASE WHEN n_regionkey = 0 THEN 1 ELSE 3 END AS DateRangeID",
    "n_regionkey AS RegionID",
    "n_nationkey AS OperatorID",
]

# Thirteen flags for each of six phrases: not discussed, unclear, and 11 scores.
_FLAG = [
    "k AS PhraseSentimentFlagID",
    """CASE k % 6 WHEN 0 THEN 'Price or Value' WHEN 1 THEN 'Atmosphere' WHEN 2 THEN 'Food'
        WHEN 3 THEN 'Drink' WHEN 4 THEN 'Staff or Service' ELSE 'Portion Size' END AS Phrase""",
    "CASE WHEN k < 6 THEN 0 ELSE 1 END AS PhraseFlag",
    "CAST(CASE WHEN k < 12 THEN 2 ELSE 3 + floor((k - 12) / 6) END AS int) AS PhraseSentimentID",
]

# Large orders have the phrase discussed, small ones have another one ruled out.
_FLAG_OF_REVIEW = """CAST(CASE WHEN quantity < 25 * lines THEN (l_orderkey + 1) % 6
    ELSE 12 + 6 * (l_orderkey % 7 + CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 4 END) + l_orderkey % 6
    END AS int)"""
