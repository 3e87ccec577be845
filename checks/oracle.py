"""DuckDB SQL for the registered queries, over the same given tables."""

from __future__ import annotations

import re

from checks import params as P
from reviewloom.functions import words as W
from reviewloom.functions.phrasebook import PhraseBook, cleaned_words
from reviewloom.operators.batches import QUEUE_ROWS

# ---- pieces ---------------------------------------------------------------

STAR = r"""
Operator AS (SELECT n_nationkey AS OperatorID, concat('OPERATOR ', n_nationkey) AS OperatorName FROM nation),
Brand AS (SELECT n_nationkey AS BrandID, n_nationkey % 12 AS OperatorID FROM nation),
RegionDim AS (SELECT r_regionkey AS RegionID, r_name AS Region FROM region UNION ALL SELECT 99, '-'),
Postcode AS (SELECT n_nationkey AS PostcodeID, CASE WHEN n_nationkey >= 23 THEN 99 ELSE n_regionkey END AS RegionID FROM nation),
Venue AS (SELECT c_custkey AS VenueID, CAST(c_custkey % 25 AS INT) AS BrandID, c_nationkey AS PostcodeID,
    concat('OV', c_custkey) AS OperatorVenueCode FROM customer),
VenueExport AS (SELECT OperatorVenueCode, OperatorName FROM Venue JOIN Brand USING (BrandID) JOIN Operator USING (OperatorID)),
Sentiment AS (
    SELECT 1 AS SentimentID, 'Unknown - Unprocessed' AS SentimentText, '-' AS SentimentRawScore, CAST(NULL AS DECIMAL(3,1)) AS SentimentScore
    UNION ALL SELECT 2, 'Unknown - Processed', '-', NULL
    UNION ALL SELECT CAST(8 + step AS INT),
        CASE WHEN step < 0 THEN 'Negative' WHEN step = 0 THEN 'Neutral' ELSE 'Positive' END,
        regexp_replace(CAST(CAST(step * 0.2 AS DECIMAL(3,1)) AS VARCHAR), '\.0$', ''),
        CAST(step * 0.2 AS DECIMAL(3,1)) FROM range(-5, 6) t(step)),
Review AS (SELECT o_orderkey AS ReviewID, o_custkey AS VenueID,
    CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS Review_DateID,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END AS ReviewRating,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('The ',
        CASE o_orderkey % 6 WHEN 0 THEN 'staff' WHEN 1 THEN 'food' WHEN 2 THEN 'atmosphere' WHEN 3 THEN 'price' WHEN 4 THEN 'drinks' ELSE 'portion' END, ' ',
        CASE WHEN o_orderkey % 5 = 0 THEN 'wasn''t' ELSE 'was' END, ' ',
        CASE o_orderkey % 7 WHEN 0 THEN 'great' WHEN 1 THEN 'friendly' WHEN 2 THEN 'cold' WHEN 3 THEN 'terrible' WHEN 4 THEN 'lovely' WHEN 5 THEN 'fine' ELSE 'slow' END,
        CASE WHEN o_orderkey % 3 = 0 THEN '!' WHEN o_orderkey % 3 = 1 THEN ' & we''ll be back.' ELSE '' END,
        CASE WHEN o_orderkey % 2 = 0 THEN concat(' Table ', o_orderkey % 120, '.') ELSE '' END) END AS ReviewText,
    CAST(CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 < 3 THEN 1 WHEN o_orderkey % 13 = 0 THEN 2 ELSE 3 + (o_custkey + o_orderkey) % 11 END AS INT) AS ReviewSentimentID FROM orders),
Written AS (SELECT * FROM Review WHERE ReviewText IS NOT NULL),
Flags AS (SELECT k AS PhraseSentimentFlagID,
    CASE k % 6 WHEN 0 THEN 'Price or Value' WHEN 1 THEN 'Atmosphere' WHEN 2 THEN 'Food' WHEN 3 THEN 'Drink' WHEN 4 THEN 'Staff or Service' ELSE 'Portion Size' END AS Phrase,
    CASE WHEN k < 6 THEN 0 ELSE 1 END AS PhraseFlag,
    CAST(CASE WHEN k < 12 THEN 2 ELSE 3 + floor((k - 12) / 6) END AS INT) AS PhraseSentimentID
    FROM (SELECT DISTINCT CAST(p_partkey % 78 AS INT) AS k FROM part)),
Bridge AS (SELECT l_orderkey AS ReviewID,
    CAST(CASE WHEN sum(l_quantity) < 25 * count(*) THEN (l_orderkey + 1) % 6
        ELSE 12 + 6 * (l_orderkey % 7 + CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 4 END) + l_orderkey % 6 END AS INT) AS PhraseSentimentFlagID
    FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_returnflag = 'A') * 3 > count(*)),
Dates AS (SELECT DISTINCT CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS DateID,
    CAST(o_orderdate AS DATE) AS ActualDate FROM orders),
DateRange AS (SELECT 1 AS DateRangeID, 19980228 AS StartDateID, 19990228 AS EndDateID, 12 AS Months
    UNION ALL SELECT 2, 19970228, 19980228, 12 UNION ALL SELECT 3, 19960228, 19970228, 12),
Summary_Venue AS (SELECT CAST(c_custkey + 1 AS INT) AS VenueSummaryID, concat('The staff was great. Seed ', c_mktsegment) AS VenueSummary,
    '-' AS VenuePros, '-' AS VenueCons, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS DateRangeID,
    c_custkey AS VenueID, 0 AS RegionSummaryID, 0 AS OperatorSummaryID FROM customer),
Summary_Operator AS (SELECT n_nationkey + 1 AS OperatorSummaryID, 'seed' AS OperatorSummary, '-' AS OperatorPros, '-' AS OperatorCons,
    CASE WHEN n_regionkey = 0 THEN 1 ELSE 3 END AS DateRangeID, n_nationkey AS OperatorID FROM nation),
Summary_Region AS (SELECT n_nationkey + 1 AS RegionSummaryID, 'seed' AS RegionSummary, '-' AS RegionPros, '-' AS RegionCons,
    CASE WHEN n_regionkey = 0 THEN 1 ELSE 3 END AS DateRangeID, n_regionkey AS RegionID, n_nationkey AS OperatorID FROM nation),
VenueOperator AS (SELECT VenueID, OperatorID, OperatorName FROM Venue JOIN Brand USING (BrandID) JOIN Operator USING (OperatorID)),
VenueRegion AS (SELECT VenueID, RegionID, Region FROM Venue JOIN Postcode USING (PostcodeID) JOIN RegionDim USING (RegionID))
"""


def quoted(words) -> str:
    return ", ".join("'" + word.replace("'", "''") + "'" for word in words)


WHITESPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def clean(column: str) -> str:
    return (
        f"trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(lower({column}), '{WHITESPACE}'), "
        f"lambda w: w <> '' AND w NOT IN ({quoted(W.stop_words())})), ' '), '[^a-zA-Z ]', '', 'g'))"
    )


def letters(column: str) -> str:
    return f"trim(regexp_replace({column}, '[^a-zA-Z ]', '', 'g'))"


def half_up(part: str, whole: str, digits: int) -> str:
    """part / whole to ``digits`` places, from whole numbers."""
    return f"round(CAST({part} AS DOUBLE) * 1e{digits} / nullif({whole}, 0)) / 1e{digits}"


def table(groups: dict, columns: str) -> str:
    """A VALUES list of (term, group name)."""
    rows = ", ".join(
        f"('{term}', {name})" if isinstance(name, int) else f"('{term}', '{name}')"
        for name, terms in groups.items()
        for term in terms
    )
    return f"(VALUES {rows}) t({columns})"


NEGATORS = quoted(W.NEGATORS)


def word_ctes(name: str, source: str, keys: str, column: str) -> str:
    """``{name}_words``: words of a cleaned text with their neighbours."""
    return f"""
{name}_split AS (SELECT {keys}, regexp_split_to_array({column}, ' +') AS ws FROM {source}),
{name}_words AS (SELECT {keys}, unnest(ws) AS w, unnest(list_prepend(NULL, ws[1:len(ws)-1])) AS before,
    unnest(list_concat([NULL, NULL], ws[1:greatest(len(ws)-2, 0)])) AS before2,
    unnest(list_append(ws[2:], NULL)) AS after FROM {name}_split)"""


def score_ctes(name: str, source: str, keys: str, column: str) -> str:
    """``{name}``: Sentiment of each row of ``source``, whose ``keys`` are unique."""
    return f"""{word_ctes(name, source, keys, column)},
{name}_hits AS (SELECT {keys}, sum(CASE WHEN before IN ({NEGATORS}) THEN -wt ELSE wt END) AS total
    FROM {name}_words JOIN {table(W.LEXICON, 'term, wt')} ON w = term GROUP BY {keys}),
{name} AS (SELECT s.*, CAST(CASE WHEN total IS NULL THEN -1 ELSE least(10, greatest(0, 5 + total)) END AS INT) AS Sentiment
    FROM {source} s LEFT JOIN {name}_hits USING ({keys}))"""


def aspect_ctes(name: str, source: str, keys: str, column: str) -> str:
    """``{name}_pros``: Pros and Cons of each group.  ``source`` has a unique ``rid``."""
    noun = lambda side: f"(SELECT min(n) FROM {table(W.ASPECT_NOUNS, 'term, n')} WHERE term = {side})"
    return f"""
{name}_clean AS (SELECT {keys}, rid, {clean(column)} AS c FROM {source}),
{word_ctes(name + '_a', name + '_clean', keys + ', rid', 'c')},
{name}_nouns AS (SELECT term, n FROM {table(W.ASPECT_NOUNS, 'term, n')}),
{name}_adj AS (SELECT term, name, TRUE AS praise FROM {table(W.PRAISE, 'term, name')}
    UNION ALL SELECT term, name, FALSE FROM {table(W.BLAME, 'term, name')}),
{name}_found AS (SELECT {keys}, rid, a.praise <> coalesce(before IN ({NEGATORS}), FALSE) AS good,
    concat(CASE WHEN before IN ({NEGATORS}) THEN 'not ' ELSE '' END, a.name, ' ', coalesce(n1.n, n2.n, n3.n)) AS aspect
    FROM {name}_a_words JOIN {name}_adj a ON w = a.term
    LEFT JOIN {name}_nouns n1 ON n1.term = before LEFT JOIN {name}_nouns n2 ON n2.term = before2
    LEFT JOIN {name}_nouns n3 ON n3.term = after WHERE coalesce(n1.n, n2.n, n3.n) IS NOT NULL),
{name}_counts AS (SELECT {keys}, good, aspect, count(DISTINCT rid) AS mentions FROM {name}_found GROUP BY {keys}, good, aspect),
{name}_totals AS (SELECT {keys}, count(*) AS total FROM {source} GROUP BY {keys}),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys}, good ORDER BY mentions DESC, aspect) AS place,
    concat(aspect, ' (', CAST(round(mentions * 10.0 / total) * 10 AS INT), '%)') AS label
    FROM {name}_counts JOIN {name}_totals USING ({keys})),
{name}_pros AS (SELECT {keys},
    coalesce(string_agg(label, ', ' ORDER BY place) FILTER (WHERE good AND place <= 3), '-') AS Pros,
    coalesce(string_agg(label, ', ' ORDER BY place) FILTER (WHERE NOT good AND place <= 3), '-') AS Cons
    FROM {name}_totals LEFT JOIN {name}_ranked USING ({keys}) GROUP BY {keys})"""


def summary_ctes(name: str, source: str, keys: str, column: str) -> str:
    """``{name}``: Summary, Pros and Cons of each group."""
    return f"""{aspect_ctes(name, source, keys, column)},
{name}_pieces AS (SELECT {keys}, unnest(regexp_split_to_array({column}, '[.!?\\n]+')) AS piece FROM {source}),
{name}_whole AS (SELECT {keys}, string_split(regexp_replace({letters('piece')}, ' +', ' ', 'g'), ' ') AS ws FROM {name}_pieces),
{name}_plain AS (SELECT DISTINCT {keys}, unnest(list_transform(range(0, len(ws), 50), lambda i: array_to_string(ws[i + 1:i + 50], ' '))) AS sentence
    FROM {name}_whole WHERE ws <> ['']),
{name}_kept AS (SELECT {keys}, sentence, len(string_split(sentence, ' ')) AS n, {clean('sentence')} AS c FROM {name}_plain),
{score_ctes(name + '_s', name + '_kept', keys + ', sentence', 'c')},
{name}_order AS (SELECT *, row_number() OVER g AS place, sum(n) OVER g AS length FROM {name}_s
    WINDOW g AS (PARTITION BY {keys} ORDER BY CASE WHEN Sentiment < 0 THEN 0 ELSE abs(Sentiment - 5) END DESC, sentence
                 ROWS UNBOUNDED PRECEDING)),
{name}_text AS (SELECT {keys}, concat(string_agg(sentence, '. ' ORDER BY place), '.') AS Summary
    FROM {name}_order WHERE length <= 50 GROUP BY {keys}),
{name} AS (SELECT {keys}, coalesce(Summary, '-') AS Summary, Pros, Cons FROM {name}_pros LEFT JOIN {name}_text USING ({keys}))"""


def sql(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([STAR, *ctes]) + "\n" + select


ORACLE: dict[str, str] = {}

# ---- dashboard ------------------------------------------------------------

RANKED = """
PhraseScores AS (SELECT OperatorID, Phrase, round(CAST(sum(SentimentScore) AS DOUBLE) * 1e6 / count(*)) / 1e6 AS AvgSentimentScore
    FROM VenueOperator JOIN Written USING (VenueID) JOIN Bridge USING (ReviewID) JOIN Flags USING (PhraseSentimentFlagID)
    JOIN Sentiment ON SentimentID = PhraseSentimentID
    WHERE PhraseFlag = 1 AND SentimentScore IS NOT NULL GROUP BY OperatorID, Phrase),
Ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY OperatorID ORDER BY AvgSentimentScore DESC, Phrase) AS INT) AS PositiveRank,
    CAST(row_number() OVER (PARTITION BY OperatorID ORDER BY AvgSentimentScore, Phrase) AS INT) AS NegativeRank FROM PhraseScores)"""

ORACLE["rank_phrases"] = sql("SELECT * FROM Ranked", RANKED)

STATS = f"""{RANKED},
Ends AS (SELECT OperatorID,
    first(Phrase ORDER BY PositiveRank) AS MostPositivePhraseName,
    max(AvgSentimentScore) AS MostPositivePhraseSentiment,
    first(Phrase ORDER BY NegativeRank) AS MostNegativePhraseName,
    min(AvgSentimentScore) AS MostNegativePhraseSentiment FROM Ranked GROUP BY OperatorID),
Known AS (SELECT OperatorID, SentimentID <> 1 AS processed, CAST(SentimentScore * 10 AS INT) AS tenth
    FROM Written JOIN VenueOperator USING (VenueID) LEFT JOIN Sentiment ON SentimentID = ReviewSentimentID),
Counts AS (SELECT OperatorID, count(*) AS n, count(*) FILTER (WHERE processed) AS done, count(*) FILTER (WHERE tenth > 0) AS good,
    count(tenth) FILTER (WHERE processed) AS scored, sum(tenth) FILTER (WHERE processed) AS tenths FROM Known GROUP BY OperatorID),
Stats AS (SELECT OperatorID, OperatorName,
    coalesce({half_up('done * 100', 'n', 1)}, 0) AS ProcessedReviewRatio,
    {half_up('tenths', '(10 * scored)', 2)} AS AvgSentimentScore,
    {half_up('good * 100', 'done', 1)} AS PositiveReviewPercentage,
    coalesce(n, 0) AS CountReviews, Ends.* EXCLUDE (OperatorID)
    FROM Operator LEFT JOIN Counts USING (OperatorID) LEFT JOIN Ends USING (OperatorID))"""

ORACLE["operator_stats"] = sql("SELECT * EXCLUDE (OperatorID) FROM Stats", STATS)
ORACLE["operator_stats_selected"] = sql(
    "SELECT * EXCLUDE (OperatorID) FROM Stats WHERE OperatorID IN (1, 4, 7)", STATS
)


PICKED = f"""Picked AS (SELECT * FROM Written WHERE Review_DateID BETWEEN {P.START} AND {P.END} AND ReviewID IN (
    SELECT ReviewID FROM Bridge JOIN Flags USING (PhraseSentimentFlagID) WHERE PhraseFlag = 1 AND Phrase IN ('Atmosphere', 'Food')))"""
ORACLE["operator_stats_filtered"] = sql(
    "SELECT * EXCLUDE (OperatorID) FROM Stats WHERE OperatorID IN (1, 4, 7)",
    PICKED,
    STATS.replace("JOIN Written", "JOIN Picked")
    .replace("FROM Written", "FROM Picked")
    .replace("WHERE PhraseFlag = 1", "WHERE Phrase IN ('Atmosphere', 'Food') AND PhraseFlag = 1"),
)


def display(column: str, digits: int) -> str:
    """Half-even at ``digits`` places, worked out on millionths."""
    unit = 10 ** (6 - digits)
    millionths = f"CAST(round(abs({column}) * 1e6) AS BIGINT)"
    units = (
        f"({millionths} // {unit} + CASE WHEN {millionths} % {unit} * 2 > {unit} THEN 1 "
        f"WHEN {millionths} % {unit} * 2 = {unit} THEN ({millionths} // {unit}) % 2 ELSE 0 END)"
    )
    return (
        f"CASE WHEN {column} = floor({column}) THEN format('{{:,}}', CAST({column} AS BIGINT)) "
        f"WHEN {column} IS NOT NULL THEN concat(CASE WHEN {column} < 0 THEN '-' ELSE '' END, "
        f"printf('%.{digits}f', {units} / 1e{digits})) END"
    )


ORACLE["format_stats"] = sql(
    f"""SELECT OperatorName, {display('ProcessedReviewRatio', 1)} AS ProcessedReviewRatio,
    {display('AvgSentimentScore', 2)} AS AvgSentimentScore,
    {display('PositiveReviewPercentage', 1)} AS PositiveReviewPercentage,
    {display('CountReviews', 2)} AS CountReviews, MostPositivePhraseName,
    {display('MostPositivePhraseSentiment', 2)} AS MostPositivePhraseSentiment, MostNegativePhraseName,
    {display('MostNegativePhraseSentiment', 2)} AS MostNegativePhraseSentiment FROM Stats""",
    STATS,
)

LISTED = """Listed AS (SELECT DISTINCT OperatorID, OperatorName FROM VenueOperator JOIN Review USING (VenueID))"""
ORACLE["list_operators"] = sql("SELECT * FROM Listed ORDER BY OperatorName", LISTED)
ORACLE["list_phrases"] = sql("SELECT DISTINCT Phrase FROM Flags ORDER BY Phrase")
ORACLE["select_members"] = sql(f"SELECT * FROM Listed WHERE OperatorName IN ({quoted(P.OPERATORS)})", LISTED)
ORACLE["search_dimension"] = sql("SELECT * FROM Listed WHERE contains(lower(OperatorName), 'tor 1')", LISTED)

SCORED = """Scored AS (SELECT * FROM Review JOIN VenueOperator USING (VenueID)
    JOIN Sentiment ON SentimentID = ReviewSentimentID WHERE SentimentScore IS NOT NULL)"""

ORACLE["rating_vs_sentiment"] = sql(
    f"""SELECT OperatorName, {half_up('sum(ReviewRating)', 'count(ReviewRating)', 2)} AS AvgReviewRating,
    {half_up('sum(CAST(SentimentScore * 10 AS INT))', '(10 * count(*))', 2)} AS AvgSentimentScore
    FROM Scored GROUP BY OperatorName ORDER BY AvgReviewRating DESC NULLS LAST, OperatorName LIMIT 10""",
    SCORED,
)
DISTRIBUTION = "SELECT CAST(SentimentScore AS DOUBLE) AS SentimentScore, count(*) AS CountSentimentScore FROM Scored"
ORACLE["sentiment_distribution"] = sql(f"{DISTRIBUTION} GROUP BY 1", SCORED)
ORACLE["sentiment_distribution_filtered"] = sql(
    f"""{DISTRIBUTION} WHERE OperatorID IN (1, 4, 7) AND Review_DateID BETWEEN {P.START} AND {P.END}
    AND ReviewID IN (SELECT ReviewID FROM Bridge JOIN Flags USING (PhraseSentimentFlagID)
                     WHERE PhraseFlag = 1 AND Phrase IN ({quoted(P.PHRASES)})) GROUP BY 1""",
    SCORED,
)
SHARES = f"""{SCORED}, Slices AS ({DISTRIBUTION} GROUP BY 1),
Shares AS (SELECT *, {half_up('CountSentimentScore * 100', '(SELECT sum(CountSentimentScore) FROM Slices)', 1)} AS Share FROM Slices)"""
ORACLE["sentiment_share"] = sql("SELECT * FROM Shares", SHARES)
ORACLE["sentiment_share_text"] = sql("SELECT SentimentScore, printf('%.1f%%', Share) AS Share FROM Shares", SHARES)
ORACLE["rating_by_sentiment"] = sql(
    f"""SELECT CAST(SentimentScore AS DOUBLE) AS SentimentScore,
    {half_up('sum(ReviewRating)', 'count(ReviewRating)', 6)} AS AvgReviewRating FROM Scored GROUP BY 1""",
    SCORED,
)
MIX = f"""Rated AS (SELECT CAST(year(ActualDate) AS INT) AS ReviewYear, ReviewRating, count(*) AS n
    FROM Review SEMI JOIN VenueOperator USING (VenueID) JOIN Dates ON DateID = Review_DateID WHERE ReviewRating IS NOT NULL GROUP BY ALL),
Years AS (SELECT ReviewYear, sum(n) AS total FROM Rated GROUP BY ReviewYear),
Mix AS (SELECT ReviewYear, ReviewRating, {half_up('n', 'total', 6)} AS RatingProportion FROM Rated JOIN Years USING (ReviewYear))"""
ORACLE["rating_mix_by_year"] = sql("SELECT * FROM Mix ORDER BY 1, 2", MIX)
ORACLE["rating_mix_pivot"] = sql(
    "SELECT ReviewYear, "
    + ", ".join(
        f"CAST(coalesce(max(CASE WHEN ReviewRating = {r} THEN round(RatingProportion * 100) END), 0) AS INT) AS Rating{r}"
        for r in (3, 4, 5)
    )
    + " FROM Mix GROUP BY ReviewYear ORDER BY 1",
    MIX,
)
ORACLE["preset_range"] = sql(
    """SELECT OperatorID, CAST(greatest(min(d), CAST(max(d) - INTERVAL 3 MONTH AS DATE)) AS VARCHAR) AS StartDate,
    CAST(max(d) AS VARCHAR) AS EndDate
    FROM (SELECT OperatorID, CAST(strptime(CAST(Review_DateID AS VARCHAR), '%Y%m%d') AS DATE) AS d
          FROM Review JOIN VenueOperator USING (VenueID)) GROUP BY OperatorID"""
)

# ---- joins and sets -------------------------------------------------------

ORACLE["review_operator"] = sql(
    "SELECT ReviewID, VenueID, OperatorID, OperatorName FROM Review JOIN VenueOperator USING (VenueID)"
)
ORACLE["venue_region"] = sql("SELECT * FROM VenueRegion")
ORACLE["operator_left_reviews"] = sql(
    """SELECT Operator.OperatorID, OperatorName, Venue.VenueID, r.ReviewID FROM Operator LEFT JOIN Brand USING (OperatorID)
    LEFT JOIN Venue USING (BrandID) LEFT JOIN Review r ON r.VenueID = Venue.VenueID AND r.ReviewText IS NOT NULL"""
)
ORACLE["anti_leftnull"] = sql(
    """SELECT VenueID, BrandID FROM Venue LEFT JOIN (SELECT * FROM Summary_Venue WHERE DateRangeID = 1) USING (VenueID)
    WHERE VenueSummaryID IS NULL"""
)
ORACLE["anti_not_exists"] = sql(
    """SELECT ReviewID, 0 AS PhraseSentimentFlagID FROM Bridge b WHERE NOT EXISTS (
    SELECT * FROM Bridge c WHERE c.ReviewID = b.ReviewID AND c.PhraseSentimentFlagID = 0)"""
)
ORACLE["anti_not_in"] = sql("SELECT ReviewID, VenueID FROM Review WHERE ReviewID NOT IN (SELECT ReviewID FROM Bridge)")
ORACLE["semi_text"] = sql(
    """SELECT ReviewID, ReviewText FROM Review WHERE ReviewText IN (
    SELECT DISTINCT ReviewText FROM Review WHERE ReviewSentimentID = 1 AND ReviewText IS NOT NULL)"""
)
REGION_INPUTS = """RegionInputs AS (SELECT VenueID, VenueSummary, OperatorID, DateRangeID, RegionID
    FROM Summary_Venue JOIN VenueOperator USING (VenueID) JOIN VenueRegion USING (VenueID)
    ANTI JOIN Summary_Region USING (RegionID, OperatorID, DateRangeID))"""
ORACLE["region_inputs"] = sql("SELECT * FROM RegionInputs", REGION_INPUTS)
ORACLE["nth_group"] = sql(
    "SELECT * FROM RegionInputs QUALIFY dense_rank() OVER (ORDER BY OperatorID, RegionID) = 3",
    REGION_INPUTS,
)

# ---- text and duplicates --------------------------------------------------

CLEANED = f"Cleaned AS (SELECT ReviewID, {clean('ReviewText')} AS CleanText FROM Written)"
DOCUMENTS = f"Docs AS (SELECT doc_id AS ReviewID, {clean('text')} AS CleanText FROM documents)"
UNIQUE = """Uniq AS (SELECT min(ReviewID) AS ReviewID, CleanText AS ReviewText FROM Cleaned GROUP BY CleanText)"""

ORACLE["clean_text"] = sql(f"SELECT ReviewID, {clean('ReviewText')} AS CleanText FROM Review")
ORACLE["clean_documents"] = sql("SELECT ReviewID AS doc_id, CleanText FROM Docs", DOCUMENTS)
ORACLE["alpha_only"] = sql(f"SELECT ReviewID, {letters('ReviewText')} AS Letters FROM Review")
ORACLE["alpha_only_documents"] = f"SELECT doc_id, {letters('text')} AS Letters FROM documents"
ORACLE["summary_length"] = """SELECT doc_id, CAST(len(string_split(text, ' ')) AS INT) AS Words,
    len(string_split(text, ' ')) <= 50 AS Accepted FROM documents"""
ORACLE["collapse_duplicates"] = sql(
    "SELECT CleanText, min(ReviewID) AS ReviewID, count(*) AS Copies FROM Cleaned GROUP BY CleanText", CLEANED
)
ORACLE["collapse_documents"] = "SELECT text, min(doc_id) AS doc_id, count(*) AS Copies FROM documents GROUP BY text"
ORACLE["duplicate_id_lists"] = sql(
    f"""SELECT CleanText, ReviewID // {P.LIST_WIDTH} AS Block, string_agg(ReviewID, ',' ORDER BY ReviewID) AS MatchedTextIDs
    FROM Cleaned GROUP BY 1, 2""",
    CLEANED,
)
RUNNING = """Running AS (SELECT ReviewID, ReviewText, max(Review_DateID) OVER (PARTITION BY ReviewText ORDER BY ReviewID) AS RunningMax,
    max(Review_DateID) OVER (PARTITION BY ReviewText) AS FullMax FROM Written)"""
ORACLE["running_max_date"] = sql("SELECT ReviewID, RunningMax FROM Running", RUNNING)
SPARSE = "(ReviewID * 2654435761) % 1099511627776"
ORACLE["running_max_sparse"] = sql(
    f"""SELECT {SPARSE} AS ReviewID, max(Review_DateID) OVER (PARTITION BY ReviewText ORDER BY {SPARSE}) AS RunningMax
    FROM Written"""
)
ORACLE["running_max_nulls"] = sql(
    "SELECT ReviewID, max(Review_DateID) OVER (PARTITION BY ReviewText ORDER BY ReviewID) AS RunningMax FROM Review"
)
ORACLE["propagate_labels"] = sql(
    """SELECT copy.ReviewID, PhraseSentimentFlagID FROM Bridge JOIN Written AS known USING (ReviewID)
    JOIN Written AS copy ON copy.ReviewText = known.ReviewText EXCEPT SELECT ReviewID, PhraseSentimentFlagID FROM Bridge"""
)
ORACLE["propagate_document_labels"] = """SELECT copy.doc_id, quality, toxic FROM labels JOIN documents AS known USING (doc_id)
    JOIN documents AS copy ON copy.text = known.text EXCEPT SELECT doc_id, quality, toxic FROM labels"""

# ---- candidates -----------------------------------------------------------


def candidates(wanted: str, date: str = "RunningMax") -> str:
    return f"""{RUNNING},
    Wanted AS (SELECT DISTINCT ReviewText FROM Written r2 {wanted}),
    Found AS (SELECT ReviewID, ReviewText FROM Running WHERE ReviewText IN (SELECT ReviewText FROM Wanted)
              AND {date} >= {P.MIN_DATE})"""


NAMED = f"""JOIN Venue v ON v.VenueID = r2.VenueID JOIN VenueExport vw ON vw.OperatorVenueCode = v.OperatorVenueCode
    AND vw.OperatorName IN ({quoted(P.OPERATORS)})"""
OPEN = "JOIN Sentiment s ON s.SentimentID = r2.ReviewSentimentID AND s.SentimentText = 'Unknown - Unprocessed'"
UNFLAGGED = f"""WHERE ReviewID NOT IN (SELECT ReviewID FROM Bridge JOIN Flags USING (PhraseSentimentFlagID)
    WHERE Phrase = '{P.PHRASES[0]}')"""

ORACLE["candidates_overall"] = sql("SELECT * FROM Found", candidates(OPEN))
ORACLE["candidates_overall_full"] = sql("SELECT * FROM Found", candidates(OPEN, "FullMax"))
ORACLE["candidates_overall_operators"] = sql("SELECT * FROM Found", candidates(f"{OPEN} {NAMED}"))
ORACLE["candidates_overall_undated"] = sql(
    "SELECT ReviewID, ReviewText FROM Running WHERE ReviewText IN (SELECT ReviewText FROM Wanted)", candidates(OPEN)
)
ORACLE["candidates_phrase"] = sql("SELECT * FROM Found", candidates(UNFLAGGED))
ORACLE["candidates_phrase_operators"] = sql("SELECT * FROM Found", candidates(f"{NAMED} {UNFLAGGED}"))

# ---- scoring --------------------------------------------------------------

OVERALL = score_ctes("Overall", "Cleaned", "ReviewID", "CleanText")
RESCALED = "CAST((Sentiment - 5) / 5.0 AS DECIMAL(3,1))"
RAW = f"CASE WHEN Sentiment = -1 THEN '-' ELSE regexp_replace(CAST({RESCALED} AS VARCHAR), '\\.0$', '') END"


def phrase_ctes(source: str, phrases: list[str] = P.PHRASES) -> str:
    """``Phrased``: PhraseFlag and the score for the phrase, from ``Overall``."""
    terms = quoted(W.phrase_terms(phrases))
    return f"""Phrased AS (SELECT ReviewID, CAST(len(list_filter(regexp_split_to_array(CleanText, ' +'),
        lambda w: w IN ({terms}))) > 0 AS INT) AS PhraseFlag, Sentiment AS s FROM {source}),
    PhraseScored AS (SELECT ReviewID, PhraseFlag, CASE WHEN PhraseFlag = 1 THEN s ELSE -1 END AS Sentiment FROM Phrased)"""


FOUND_CLEAN = f"Cleaned AS (SELECT ReviewID, {clean('ReviewText')} AS CleanText FROM Found)"

ORACLE["score_overall"] = sql("SELECT ReviewID, Sentiment FROM Overall", CLEANED, OVERALL)
ORACLE["score_documents"] = sql(
    "SELECT ReviewID, Sentiment FROM Overall", DOCUMENTS, score_ctes("Overall", "Docs", "ReviewID", "CleanText")
)
ORACLE["score_phrase"] = sql("SELECT * FROM PhraseScored", CLEANED, OVERALL, phrase_ctes("Overall"))
ORACLE["score_phrase_lower"] = sql("SELECT * FROM PhraseScored", CLEANED, OVERALL, phrase_ctes("Overall", ["Drink"]))
ORACLE["score_two_phrases"] = sql("SELECT * FROM PhraseScored", CLEANED, OVERALL, phrase_ctes("Overall", ["Food", "Drink"]))
ORACLE["rescale_score"] = sql(
    f"SELECT ReviewID, CAST({RESCALED} AS DOUBLE) AS Sentiment, {RAW} AS RawScore FROM Overall", CLEANED, OVERALL
)


def batched(source: str, size: int) -> str:
    queues = f"(SELECT greatest(1, (count(*) + {QUEUE_ROWS - 1}) // {QUEUE_ROWS}) FROM {source})"
    return f"""SELECT *, CAST((row_number() OVER (PARTITION BY Queue ORDER BY ReviewID) - 1) // {size} AS INT) AS Batch
    FROM (SELECT *, CAST(CAST('0x' || substr(md5(CAST(ReviewID AS VARCHAR)), 1, 8) AS BIGINT) % {queues} AS INT) AS Queue FROM {source})"""


ORACLE["assign_batches"] = sql(f"SELECT ReviewID, Queue, Batch FROM ({batched('Review', 50)})")
ORACLE["batch_json"] = sql(
    f"""SELECT Queue, Batch, CAST(to_json(list({{'ReviewID': ReviewID, 'ReviewText': ReviewText}} ORDER BY ReviewID)) AS VARCHAR) AS ItemsJson
    FROM ({batched('Uniq', 5)}) GROUP BY Queue, Batch""",
    CLEANED,
    UNIQUE,
)
ORACLE["group_json"] = sql(
    f"""SELECT VenueID, Block, Chunk, count(*) AS "Values", CAST(to_json(list(Letters ORDER BY Letters)) AS VARCHAR) AS ValuesJson FROM (
    SELECT *, CAST((row_number() OVER (PARTITION BY VenueID, Block ORDER BY Letters, ReviewID) - 1) // 3 AS INT) AS Chunk FROM (
    SELECT VenueID, min(ReviewID) AS ReviewID, min(ReviewID) // {P.LIST_WIDTH} AS Block, {letters('ReviewText')} AS Letters
    FROM Written GROUP BY VenueID, ReviewText)) GROUP BY VenueID, Block, Chunk"""
)
ORACLE["parse_scores"] = sql(
    f"""SELECT Queue, Batch, CAST(ReviewID AS DOUBLE) AS ReviewID,
    CAST(coalesce(SentimentScore * 5 + 5, -1) AS DOUBLE) AS Sentiment
    FROM ({batched('(SELECT * FROM Review JOIN Sentiment ON SentimentID = ReviewSentimentID)', 50)})"""
)
ORACLE["validate_scores"] = sql(
    """SELECT Queue, Batch, ReviewID, Sentiment, State, bool_and(State = 'ok') OVER (PARTITION BY Queue, Batch) AS Accepted FROM (
    SELECT Queue, Batch, ReviewID, CASE WHEN State <> 'missing' THEN coalesce(ReviewRating * 2, 11) END AS Sentiment, State FROM (
        SELECT *, CASE WHEN Review_DateID < 19950301 THEN 'missing' WHEN ReviewRating IS NULL THEN 'invalid' ELSE 'ok' END AS State FROM Sent)
    UNION ALL SELECT Queue, Batch, -ReviewID - 1, 5, 'extra' FROM Sent WHERE Review_DateID >= 20010701)""",
    f"Sent AS ({batched('Review', 50)})",
)

REASON = """CASE WHEN bool_or(contains(ReviewText, 'portion')) THEN 'ids differ'
    WHEN bool_or(contains(ReviewText, 'price')) THEN 'invalid scores'
    WHEN bool_or(contains(ReviewText, 'drinks')) THEN 'empty reply' END"""
VERDICTS = f"""Verdicts AS (SELECT Queue, Batch, string_agg(ReviewID, ',' ORDER BY ReviewID) AS ReviewIDs, count(*) AS n, {REASON} AS Reason
    FROM ({batched('Uniq', 2)}) GROUP BY Queue, Batch)"""
# What the faulty scorer says: without the first record, with a first score of 11, or nothing.
ANSWERS = f"""Scores AS (SELECT CleanText, min(Sentiment) AS Sentiment FROM Overall GROUP BY CleanText),
Lines AS (SELECT Queue, Batch, ReviewID, Sentiment, row_number() OVER (PARTITION BY Queue, Batch ORDER BY ReviewID) AS place
    FROM ({batched('Uniq', 2)}) JOIN Scores ON CleanText = ReviewText),
Answers AS (SELECT Queue, Batch, CASE Reason WHEN 'empty reply' THEN ''
        ELSE concat('{{"review_sentiment": [', coalesce(string_agg(concat('{{"ReviewID": ', ReviewID, ', "Sentiment": ',
            CASE WHEN Reason = 'invalid scores' AND place = 1 THEN 11 ELSE Sentiment END, '}}'), ', ' ORDER BY place)
            FILTER (WHERE Reason <> 'ids differ' OR place > 1), ''), ']}}') END AS Reply
    FROM Lines JOIN Verdicts USING (Queue, Batch) WHERE Reason IS NOT NULL GROUP BY Queue, Batch, Reason)"""
ORACLE["quarantine"] = sql(
    """SELECT Queue, Batch, ReviewIDs, Reply, CAST(NULL AS VARCHAR) AS Error,
    CASE Reason WHEN 'invalid scores' THEN '11.0' WHEN 'ids differ' THEN '' END AS InvalidScores,
    Reason = 'invalid scores' AS SameIds,
    CASE WHEN Reply = '{"review_sentiment": []}' THEN 'empty reply' ELSE Reason END AS Reason
    FROM Verdicts JOIN Answers USING (Queue, Batch)""",
    CLEANED,
    OVERALL,
    UNIQUE,
    VERDICTS,
    ANSWERS,
)
BAD = "regexp_matches(CleanText, 'portion|price|drinks')"
ORACLE["rescued_scores"] = sql(
    f"SELECT ReviewID, CAST({RESCALED} AS DOUBLE) AS Sentiment FROM Overall WHERE NOT {BAD}", CLEANED, OVERALL
)
ORACLE["rescued_metrics"] = sql(
    f"""SELECT count(DISTINCT CleanText) FILTER (WHERE NOT {BAD}) AS Completed, count(DISTINCT CleanText) FILTER (WHERE {BAD}) AS Failed,
    count(DISTINCT CleanText) FILTER (WHERE {BAD}) AS Remaining FROM Cleaned""",
    CLEANED,
)
ORACLE["run_metrics"] = sql(
    """SELECT CAST(sum(n) FILTER (WHERE Reason IS NULL) AS BIGINT) AS Completed,
    CAST(sum(n) FILTER (WHERE Reason IS NOT NULL) AS BIGINT) AS Failed,
    CAST(sum(n) FILTER (WHERE Reason IS NOT NULL) AS BIGINT) AS Remaining FROM Verdicts""",
    CLEANED,
    UNIQUE,
    VERDICTS,
)
RUN_OVERALL = [candidates(OPEN), FOUND_CLEAN, OVERALL]
RUN_PHRASE = [candidates(UNFLAGGED), FOUND_CLEAN, OVERALL, phrase_ctes("Overall")]
ORACLE["score_reviews"] = sql(
    f"SELECT ReviewID, CAST({RESCALED} AS DOUBLE) AS Sentiment FROM Overall", *RUN_OVERALL
)
ORACLE["score_reviews_batched"] = ORACLE["score_reviews"]
ORACLE["score_reviews_phrase"] = sql(
    f"SELECT ReviewID, PhraseFlag, CAST({RESCALED} AS DOUBLE) AS Sentiment FROM PhraseScored", *RUN_PHRASE
)
ORACLE["score_phrase_batched"] = ORACLE["score_reviews_phrase"]
ORACLE["score_documents_batched"] = sql(
    f"SELECT ReviewID, CAST({RESCALED} AS DOUBLE) AS Sentiment FROM Overall",
    DOCUMENTS,
    score_ctes("Overall", "Docs", "ReviewID", "CleanText"),
)

# ---- write-back and upserts -----------------------------------------------

DIM_JOIN = "JOIN (SELECT * FROM Sentiment WHERE SentimentID <> 1) d ON d.SentimentRawScore = x.Raw"
ORACLE["score_dim_or_join"] = sql(
    f"""SELECT ReviewID, d.SentimentID, d.SentimentText FROM (
    SELECT ReviewID, SentimentRawScore AS Raw FROM Review JOIN Sentiment ON SentimentID = ReviewSentimentID) x {DIM_JOIN}"""
)
ORACLE["update_scores"] = sql(
    """SELECT ReviewID, coalesce(f, ReviewSentimentID) AS ReviewSentimentID FROM Review LEFT JOIN (
    SELECT ReviewID, max(PhraseSentimentFlagID) AS f FROM Bridge GROUP BY ReviewID) USING (ReviewID)"""
)
ORACLE["writeback_overall"] = sql(
    f"""SELECT r.ReviewID, coalesce(n.SentimentID, r.ReviewSentimentID) AS ReviewSentimentID FROM Review r LEFT JOIN (
    SELECT ReviewID, d.SentimentID FROM (SELECT ReviewID, {RAW} AS Raw FROM Overall) x {DIM_JOIN}) n ON n.ReviewID = r.ReviewID""",
    *RUN_OVERALL,
)
PHRASE_ROWS = [
    *RUN_PHRASE,
    f"""PhraseRows AS (SELECT ReviewID, '{P.PHRASES[0]}' AS Phrase, PhraseFlag, d.SentimentID AS PhraseSentimentID FROM (
    SELECT ReviewID, PhraseFlag, CASE WHEN PhraseFlag = 0 THEN '-' ELSE {RAW} END AS Raw FROM PhraseScored) x {DIM_JOIN})""",
]
NEW_FLAGS = """EarlyFlags AS (SELECT * FROM Flags WHERE PhraseFlag = 0),
AllFlags AS (SELECT * FROM EarlyFlags UNION ALL
    SELECT CAST((SELECT max(PhraseSentimentFlagID) FROM EarlyFlags) + row_number() OVER (ORDER BY Phrase, PhraseFlag, PhraseSentimentID) AS INT),
        Phrase, PhraseFlag, PhraseSentimentID FROM (
        SELECT Phrase, PhraseFlag, PhraseSentimentID FROM PhraseRows EXCEPT SELECT Phrase, PhraseFlag, PhraseSentimentID FROM EarlyFlags))"""


def bridged(flags: str) -> str:
    return f"""SELECT * FROM Bridge UNION SELECT ReviewID, PhraseSentimentFlagID
    FROM PhraseRows JOIN {flags} USING (Phrase, PhraseFlag, PhraseSentimentID)"""


TWO_WORDS = [
    candidates(UNFLAGGED.replace(f"'{P.PHRASES[0]}'", f"'{P.TWO_WORDS}'")), FOUND_CLEAN, OVERALL, phrase_ctes("Overall", [P.TWO_WORDS]),
    PHRASE_ROWS[-1].replace(f"'{P.PHRASES[0]}'", f"'{P.TWO_WORDS}'"),
]
ORACLE["upsert_flags_two_words"] = sql(
    "SELECT * FROM AllFlags", *TWO_WORDS, NEW_FLAGS.replace("FROM Flags WHERE PhraseFlag = 0", "FROM Flags WHERE PhraseSentimentID <> 8")
)
ORACLE["upsert_phrase_flags"] = sql("SELECT * FROM AllFlags", *PHRASE_ROWS, NEW_FLAGS)
ORACLE["upsert_phrase_reviews"] = sql(bridged("Flags"), *PHRASE_ROWS)
ORACLE["writeback_phrase"] = sql(
    f"""SELECT x.ReviewID, x.PhraseSentimentFlagID, Phrase, PhraseFlag, PhraseSentimentID
    FROM ({bridged('AllFlags')}) x LEFT JOIN AllFlags USING (PhraseSentimentFlagID)""",
    *PHRASE_ROWS,
    NEW_FLAGS,
)
ORACLE["insert_if_absent"] = sql(
    """SELECT * FROM Summary_Venue UNION ALL
    SELECT CAST((SELECT max(VenueSummaryID) FROM Summary_Venue) + row_number() OVER (ORDER BY VenueID) AS INT), 'new', '-', '-', 1, VenueID, 0, 0
    FROM Venue ANTI JOIN (SELECT * FROM Summary_Venue WHERE DateRangeID = 1) USING (VenueID)"""
)
ORACLE["insert_sparse_keys"] = sql(
    """SELECT * FROM Summary_Venue UNION ALL
    SELECT CAST((SELECT max(VenueSummaryID) FROM Summary_Venue) + row_number() OVER (ORDER BY k) AS INT), 'new', '-', '-', 1, k, 0, 0
    FROM (SELECT (VenueID * 2654435761) % 1099511627776 AS k FROM Venue)
    WHERE k NOT IN (SELECT VenueID FROM Summary_Venue WHERE DateRangeID = 1)"""
)
ORACLE["insert_null_and_string_keys"] = sql(
    """SELECT 7 AS TextID, ReviewText FROM Texts WHERE ReviewText LIKE '%was%' UNION ALL
    SELECT CAST(7 + row_number() OVER (ORDER BY ReviewText NULLS FIRST) AS INT), ReviewText FROM Texts
    WHERE ReviewText IS NULL OR ReviewText NOT LIKE '%was%'""",
    "Texts AS (SELECT DISTINCT ReviewText FROM Review)",
)
WINDOWS = """Windows AS (SELECT DISTINCT strftime(ActualDate, '%b-%y') AS Label,
    CAST(strftime(last_day(date_trunc('month', ActualDate) - INTERVAL 12 MONTH), '%Y%m%d') AS INT) AS StartDateID,
    CAST(strftime(last_day(ActualDate), '%Y%m%d') AS INT) AS EndDateID FROM Dates)"""
ORACLE["reporting_window"] = sql("SELECT * FROM Windows", WINDOWS)
ORACLE["date_range_upsert"] = sql(
    """SELECT * FROM DateRange UNION ALL
    SELECT CAST(3 + row_number() OVER (ORDER BY StartDateID, EndDateID) AS INT), StartDateID, EndDateID, 12 FROM Windows
    ANTI JOIN DateRange USING (StartDateID, EndDateID)""",
    WINDOWS,
)
ORACLE["delete_by_text"] = sql(
    """SELECT ReviewID, ReviewText FROM Review WHERE ReviewText IS NULL OR ReviewText NOT IN (
    SELECT ReviewText FROM Review WHERE ReviewSentimentID = 2 AND ReviewText IS NOT NULL)"""
)

# ---- windows and summaries ------------------------------------------------


def open_reviews(start: int, end: int, summaries: str, ranges: str) -> str:
    wanted = f"SELECT DateRangeID FROM {ranges} WHERE StartDateID = {start} AND EndDateID = {end}"
    return f"""(SELECT * FROM Written SEMI JOIN Venue USING (VenueID)
    ANTI JOIN (SELECT VenueID FROM {summaries} WHERE DateRangeID IN ({wanted})) USING (VenueID)
    WHERE Review_DateID BETWEEN {start} AND {end} AND EXISTS ({wanted})) x"""


OPEN_REVIEWS = open_reviews(P.START, P.END, "Summary_Venue", "DateRange")
VENUE_TEXTS = "SELECT VenueID, ReviewText, max(Review_DateID) AS Review_DateID"
ORACLE["remaining_venues"] = sql(f"SELECT count(DISTINCT VenueID) AS Remaining FROM {OPEN_REVIEWS}")
ORACLE["venue_inputs"] = sql(f"{VENUE_TEXTS} FROM {OPEN_REVIEWS} GROUP BY VenueID, ReviewText")
ORACLE["venue_texts"] = sql(f"{VENUE_TEXTS} FROM Written GROUP BY VenueID, ReviewText")
OPERATOR_INPUTS = """OperatorInputs AS (SELECT DISTINCT VenueSummary, OperatorID, DateRangeID FROM Summary_Venue
    JOIN VenueOperator USING (VenueID) ANTI JOIN Summary_Operator USING (OperatorID, DateRangeID))"""
ORACLE["operator_inputs"] = sql("SELECT * FROM OperatorInputs", OPERATOR_INPUTS)
ORACLE["remaining_operators"] = sql(
    "SELECT count(DISTINCT OperatorID) AS Remaining FROM OperatorInputs", OPERATOR_INPUTS
)
ORACLE["remaining_regions"] = sql(
    "SELECT count(*) AS Remaining FROM (SELECT DISTINCT OperatorID, RegionID FROM RegionInputs)", REGION_INPUTS
)


def numbered(name: str, select: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER () AS rid FROM ({select}))"


ORACLE["top_aspects"] = sql(
    "SELECT * FROM A_pros",
    numbered("Src", "SELECT VenueID, ReviewText FROM Written GROUP BY VenueID, ReviewText"),
    aspect_ctes("A", "Src", "VenueID", "ReviewText"),
)
DOCUMENT_ROWS = "Src AS (SELECT source, text, doc_id AS rid FROM documents)"
ORACLE["top_aspects_by_source"] = sql(
    "SELECT * FROM A_pros", DOCUMENT_ROWS, aspect_ctes("A", "Src", "source", "text")
)
ORACLE["summarise_group"] = sql(
    "SELECT * FROM S",
    "Src AS (SELECT OperatorID, ReviewText, ReviewID AS rid FROM Written JOIN VenueOperator USING (VenueID))",
    summary_ctes("S", "Src", "OperatorID", "ReviewText"),
)
ORACLE["summarise_documents"] = sql("SELECT * FROM S", DOCUMENT_ROWS, summary_ctes("S", "Src", "source", "text"))


def staged_venues(start: int, end: int, ranges: str) -> list[str]:
    """``StagedVenue``: venue summaries with those of the window added."""
    source = open_reviews(start, end, "Summary_Venue", ranges)
    return [
        numbered("VenueSrc", f"SELECT VenueID, ReviewText FROM {source} GROUP BY VenueID, ReviewText"),
        summary_ctes("V", "VenueSrc", "VenueID", "ReviewText"),
        f"""StagedVenue AS (SELECT * FROM Summary_Venue UNION ALL
        SELECT CAST((SELECT max(VenueSummaryID) FROM Summary_Venue) + row_number() OVER (ORDER BY VenueID) AS INT), Summary, Pros, Cons,
            (SELECT DateRangeID FROM {ranges} WHERE StartDateID = {start} AND EndDateID = {end}), VenueID, 0, 0
        FROM V WHERE len(string_split(Summary, ' ')) <= 50)""",
    ]


def staged_operators(venues: str) -> list[str]:
    return [
        numbered(
            "OperatorSrc",
            f"""SELECT DISTINCT VenueSummary, OperatorID, DateRangeID FROM {venues} JOIN VenueOperator USING (VenueID)
            ANTI JOIN Summary_Operator USING (OperatorID, DateRangeID)""",
        ),
        summary_ctes("O", "OperatorSrc", "OperatorID, DateRangeID", "VenueSummary"),
        """StagedOperator AS (SELECT * FROM Summary_Operator UNION ALL
        SELECT CAST((SELECT max(OperatorSummaryID) FROM Summary_Operator) + row_number() OVER (ORDER BY OperatorID, DateRangeID) AS INT),
            Summary, Pros, Cons, DateRangeID, OperatorID FROM O WHERE len(string_split(Summary, ' ')) <= 50)""",
    ]


def staged_regions(venues: str) -> list[str]:
    return [
        numbered(
            "RegionAll",
            f"""SELECT VenueSummary, OperatorID, RegionID, DateRangeID FROM {venues} JOIN VenueOperator USING (VenueID)
            JOIN VenueRegion USING (VenueID) ANTI JOIN Summary_Region USING (OperatorID, RegionID, DateRangeID)""",
        ),
        "RegionSrc AS (SELECT * FROM RegionAll WHERE RegionID <> 99)",
        summary_ctes("R", "RegionSrc", "OperatorID, RegionID, DateRangeID", "VenueSummary"),
        """StagedRegion AS (SELECT * FROM Summary_Region UNION ALL
        SELECT CAST((SELECT max(RegionSummaryID) FROM Summary_Region) + row_number() OVER (ORDER BY OperatorID, RegionID, DateRangeID) AS INT),
            Summary, Pros, Cons, DateRangeID, RegionID, OperatorID FROM (
            SELECT * FROM R UNION ALL SELECT DISTINCT OperatorID, RegionID, DateRangeID, '-', '-', '-' FROM RegionAll WHERE RegionID = 99)
        WHERE len(string_split(Summary, ' ')) <= 50)""",
    ]


ORACLE["summarise_venues"] = sql("SELECT * FROM StagedVenue", *staged_venues(P.START, P.END, "DateRange"))
ORACLE["summarise_operators"] = sql("SELECT * FROM StagedOperator", *staged_operators("Summary_Venue"))
ORACLE["summarise_regions"] = sql("SELECT * FROM StagedRegion", *staged_regions("Summary_Venue"))

ALL_LEVELS = [
    f"AllRanges AS (SELECT * FROM DateRange UNION ALL SELECT 4, {P.NEW_START}, {P.NEW_END}, {P.MONTHS})",
    *staged_venues(P.NEW_START, P.NEW_END, "AllRanges"),
    *staged_operators("StagedVenue"),
    *staged_regions("StagedVenue"),
]


def published_venues(venues: str, regions: str, operators: str, existing: str) -> str:
    return f"""SELECT CAST(coalesce((SELECT max(VenueSummaryID) FROM {existing}), 0)
        + row_number() OVER (ORDER BY VenueID, DateRangeID) AS INT) AS VenueSummaryID,
        VenueSummary, VenuePros, VenueCons, DateRangeID, VenueID, r.RegionSummaryID, o.OperatorSummaryID
    FROM {venues} JOIN VenueOperator USING (VenueID) JOIN VenueRegion USING (VenueID)
    JOIN {regions} r USING (RegionID, OperatorID, DateRangeID) JOIN {operators} o USING (OperatorID, DateRangeID)
    ANTI JOIN {existing} USING (VenueID, DateRangeID)"""


ORACLE["summarise_all"] = sql(
    f"SELECT * FROM Summary_Venue UNION ALL {published_venues('StagedVenue', 'StagedRegion', 'StagedOperator', 'Summary_Venue')}",
    *ALL_LEVELS,
)
ORACLE["summarise_all_operators"] = sql("SELECT * FROM StagedOperator", *ALL_LEVELS)
ORACLE["summarise_all_regions"] = sql("SELECT * FROM StagedRegion", *ALL_LEVELS)
ORACLE["publish_summaries"] = sql(
    published_venues("Summary_Venue", "FreshRegion", "FreshOperator", "NoVenue"),
    """NoVenue AS (SELECT * FROM Summary_Venue WHERE FALSE),
    FreshOperator AS (SELECT * REPLACE (CAST(row_number() OVER (ORDER BY OperatorID, DateRangeID) AS INT) AS OperatorSummaryID) FROM Summary_Operator),
    FreshRegion AS (SELECT * REPLACE (CAST(row_number() OVER (ORDER BY OperatorID, RegionID, DateRangeID) AS INT) AS RegionSummaryID) FROM Summary_Region)""",
)

# The fixed summariser of checks/queries: by the number of texts, it raises, says too much, or counts.
COUNTED = f"""Counted AS (SELECT VenueID, count(*) AS n FROM (
    SELECT DISTINCT VenueID, {letters('ReviewText')} AS t FROM {OPEN_REVIEWS}) GROUP BY VenueID)"""
ORACLE["summary_rejects"] = sql(
    """SELECT 'Venue' AS Category, VenueID, CAST(NULL AS BIGINT) AS OperatorID, CAST(NULL AS BIGINT) AS RegionID,
    CAST(1 AS BIGINT) AS DateRangeID, CASE WHEN n % 3 = 1 THEN rtrim(repeat('word ', 51)) END AS Summary,
    CASE n % 3 WHEN 0 THEN 'summariser failed: ValueError: no answer' ELSE 'too long' END AS Reason FROM Counted WHERE n % 3 < 2""",
    COUNTED,
)
ORACLE["summary_metrics"] = sql(
    """SELECT 'Venue' AS Category, count(*) FILTER (WHERE n % 3 = 2) AS Completed, count(*) FILTER (WHERE n % 3 < 2) AS Failed,
    count(*) FILTER (WHERE n % 3 < 2) AS Remaining FROM Counted""",
    COUNTED,
)
ORACLE["summarise_with_parts"] = sql(
    """SELECT OperatorID, concat(count(DISTINCT ReviewText), ' texts') AS Summary, '-' AS Pros, '-' AS Cons, CAST(NULL AS VARCHAR) AS Reason
    FROM Written JOIN VenueOperator USING (VenueID) GROUP BY OperatorID"""
)
ORACLE["summarise_long_texts"] = sql(
    "SELECT * FROM S",
    "Src AS (SELECT source, regexp_replace(text, '[.!?\\n]+', ' ', 'g') AS text, doc_id AS rid FROM documents)",
    summary_ctes("S", "Src", "source", "text"),
)
FIELDS = ", ".join(f"""CASE WHEN {name} IS NOT NULL THEN concat('"{name}":', to_json({name})) END""" for name in ("doc_id", "text", "lang", "source", "n_chars"))
ORACLE["row_json"] = f"SELECT concat('{{', concat_ws(',', {FIELDS}), '}}') AS json FROM documents"
ORACLE["nth_group_far"] = sql(
    """SELECT ReviewID, VenueID, ReviewRating FROM (SELECT *, dense_rank() OVER (ORDER BY ReviewRating NULLS FIRST, VenueID NULLS FIRST) AS place FROM Review)
    WHERE place = 151"""
)
ORACLE["stop_words_csv"] = sql(
    f"""SELECT ReviewID, {clean('ReviewText').replace(quoted(W.stop_words()), quoted(W.stop_words(allowed=P.ALLOWED)))} AS CleanText FROM Review"""
)
ORACLE["save_and_snapshot"] = sql(
    """SELECT r.ReviewID, r.ReviewSentimentID AS Before, CASE WHEN r.ReviewSentimentID = 1 THEN 2 ELSE r.ReviewSentimentID END AS After
    FROM Review r"""
)

# Reviews that arrive bit by bit, or whose replies come from a journal, end up like those scored at once.
ORACLE["score_reviews_journaled"] = ORACLE["score_reviews_waves"] = ORACLE["score_stream"] = ORACLE["score_reviews"]
ORACLE["writeback_stream"] = ORACLE["writeback_partitions"] = ORACLE["writeback_overall"]


def with_suffix(suffix: str, *ctes: str) -> str:
    """The same CTEs under other names, for a statement that has them twice."""
    text = ",\n".join(ctes)
    names = set(re.findall(r"(?:^|,)\s*(\w+) AS \(", text))
    return re.sub(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b", rf"\g<1>{suffix}", text)


# After scores and then phrase flags were stored: the same questions, asked of the new tables.
STORED = [
    *RUN_OVERALL,
    f"""NewStates AS (SELECT ReviewID, d.SentimentID AS NewID FROM (SELECT ReviewID, {RAW} AS Raw FROM Overall) x {DIM_JOIN}),
NewReview AS (SELECT Review.* REPLACE (coalesce(NewID, ReviewSentimentID) AS ReviewSentimentID) FROM Review LEFT JOIN NewStates USING (ReviewID)),
NewWritten AS (SELECT * FROM NewReview WHERE ReviewText IS NOT NULL)""",
    with_suffix("2", *PHRASE_ROWS, NEW_FLAGS.replace("FROM Flags WHERE PhraseFlag = 0", "FROM Flags"), f"NewBridge AS ({bridged('AllFlags')})"),
]


def stored(name: str, *ctes: str) -> None:
    text = ORACLE[name]
    select = text[text.rindex(ctes[-1]) + len(ctes[-1]) :]
    later = [re.sub(r"\b(FROM|JOIN) (Written|Review)\b", r"\g<1> New\g<2>", cte) for cte in ctes]
    later = [re.sub(r"\b(FROM|JOIN) Bridge\b", r"\g<1> NewBridge2", re.sub(r"\b(FROM|JOIN) Flags\b", r"\g<1> AllFlags2", cte)) for cte in later]
    ORACLE[f"rollup_{name}"] = sql(select, *STORED, *later)


stored("operator_stats", STATS)
stored("rating_vs_sentiment", SCORED)
stored("sentiment_distribution", SCORED)
stored("rating_mix_by_year", MIX)
stored("rating_by_sentiment", SCORED)


def many_phrases(phrases: list[str]) -> list[str]:
    """``ManyScored``: the phrases of every text that needs them, found as sequences of cleaned words."""
    book = PhraseBook(phrases)
    synonyms = {phrase.lower(): terms for phrase, terms in W.PHRASE_SYNONYMS.items()}
    terms = ", ".join(
        f"({number}, '{' '.join(cleaned_words(term))}')"
        for number, label in enumerate(book.labels)
        for term in synonyms.get(label.lower(), [label])
    )
    labels = ", ".join(f"({number}, '{label.replace(chr(39), chr(39) * 2)}')" for number, label in enumerate(book.labels))
    return [
        RUNNING,
        f"""Listed AS (SELECT * FROM (VALUES {labels}) t(No, Label)),
Terms AS (SELECT * FROM (VALUES {terms}) t(No, Term)),
FlaggedPairs AS (SELECT DISTINCT ReviewID, No FROM Bridge JOIN Flags USING (PhraseSentimentFlagID) JOIN Listed ON lower(Label) = lower(Phrase)),
TextFlags AS (SELECT ReviewText, No, count(*) AS flagged FROM FlaggedPairs JOIN Written USING (ReviewID) GROUP BY ALL),
Copies AS (SELECT ReviewText, count(*) AS copies FROM Written GROUP BY ReviewText),
Needed AS (SELECT ReviewText, No, Label FROM Copies CROSS JOIN Listed LEFT JOIN TextFlags USING (ReviewText, No) WHERE coalesce(flagged, 0) < copies),
Found AS (SELECT ReviewID, ReviewText FROM Running WHERE RunningMax >= {P.MIN_DATE})""",
        FOUND_CLEAN,
        OVERALL,
        """TextScores AS (SELECT DISTINCT ReviewText, concat(' ', regexp_replace(CleanText, ' +', ' ', 'g'), ' ') AS Padded, Sentiment
    FROM Overall JOIN Written USING (ReviewID)),
Hits AS (SELECT DISTINCT ReviewText, No FROM TextScores JOIN Terms ON contains(Padded, concat(' ', Term, ' '))),
ManyScored AS (SELECT ReviewID, Label AS Phrase, CAST(Hits.No IS NOT NULL AS INT) AS PhraseFlag,
    CASE WHEN Hits.No IS NOT NULL THEN Sentiment ELSE -1 END AS Sentiment
    FROM Found JOIN Needed USING (ReviewText) JOIN TextScores USING (ReviewText) LEFT JOIN Hits USING (ReviewText, No))""",
    ]


ORACLE["score_many_phrases"] = sql(
    f"SELECT ReviewID, Phrase, PhraseFlag, CAST({RESCALED} AS DOUBLE) AS Sentiment FROM ManyScored", *many_phrases(P.SOME_PHRASES)
)
ORACLE["phrase_coverage"] = sql(
    f"""SELECT Phrase, count(*) AS Reviews, count(*) FILTER (WHERE PhraseFlag = 1) AS Flagged,
    CAST(sum(CASE WHEN Sentiment >= 0 THEN {RESCALED} END) AS DOUBLE) AS Total FROM ManyScored GROUP BY Phrase""",
    *many_phrases(P.MANY_PHRASES),
)
ORACLE["writeback_many_phrases"] = sql(
    f"""SELECT ReviewID, Phrase, PhraseFlag, PhraseSentimentID FROM Bridge LEFT JOIN Flags USING (PhraseSentimentFlagID)
    UNION ALL (SELECT ReviewID, Phrase, PhraseFlag, PhraseSentimentID FROM (
        SELECT ReviewID, coalesce((SELECT min(Phrase) FROM Flags WHERE lower(Flags.Phrase) = lower(x.Phrase)), x.Phrase) AS Phrase, PhraseFlag, d.SentimentID AS PhraseSentimentID
        FROM (SELECT ReviewID, Phrase, PhraseFlag, CASE WHEN PhraseFlag = 0 THEN '-' ELSE {RAW} END AS Raw FROM ManyScored) x {DIM_JOIN})
    EXCEPT SELECT ReviewID, Phrase, PhraseFlag, PhraseSentimentID FROM Bridge JOIN Flags USING (PhraseSentimentFlagID))""",
    *many_phrases(P.SOME_PHRASES),
)
