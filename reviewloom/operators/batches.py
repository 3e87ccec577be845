"""Scoring batches: cutting, serialising, parsing and checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom import schema
from reviewloom.functions.scores import is_valid_score
from reviewloom.operators.duplicates import ID_BLOCK, id_block

# Rows of one queue, which one task puts in order.
QUEUE_ROWS = 10_000


def queue_count(rows: DataFrame, queue_rows: int = QUEUE_ROWS) -> int:
    """Queues that hold ``queue_rows`` rows each; counts ``rows``, so keep them first."""
    return max(1, -(-rows.count() // queue_rows))


def assign_batches(
    rows: DataFrame, id_column: str = "ReviewID", size: int = schema.BATCH_ROWS, queues: int = 1
) -> DataFrame:
    """Cut rows with unique ids into batches of at most ``size``.

    Ids are dealt to queues by a hash, whatever steps they come in, and numbered inside
    each, so no task sees all rows and the same rows always give the same batches, also when
    a lost executor has its part done again.  With :func:`queue_count` queues all
    batches are full but one of each queue.
    """
    # The first 32 bits of MD5, which other engines have, too.
    number = F.conv(F.substr(F.md5(F.col(id_column).cast("string")), F.lit(1), F.lit(8)), 16, 10)
    queue = F.pmod(number.cast("long"), F.lit(queues))
    place = F.row_number().over(Window.partitionBy("Queue").orderBy(id_column)) - 1
    return (
        rows.withColumn("Queue", queue.cast("int"))
        .withColumn("Batch", F.floor(place / size).cast("int"))
    )


def batch_json(batched: DataFrame, columns: list[str]) -> DataFrame:
    """One row for a batch: its rows as an array and as JSON, in id order.

    ``columns`` starts with the id.  A batch is small by construction.
    """
    return (
        batched.groupBy("Queue", "Batch")
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("Items"))
        .withColumn("ItemsJson", F.to_json("Items"))
    )


def group_json(
    rows: DataFrame, keys: list[str], column: str, id_column: str, size: int,
    width: int = ID_BLOCK,
) -> DataFrame:
    """One column of every group as JSON arrays of at most ``size`` values.

    A group may be of any size, so it is cut by blocks of its unique ids, ``width``
    rows at most, before its values are put in order.
    """
    place = F.row_number().over(Window.partitionBy(*keys, "Block").orderBy(column, id_column)) - 1
    return (
        rows.withColumn("Block", id_block(id_column, width))
        .withColumn("Chunk", F.floor(place / size).cast("int"))
        .groupBy(*keys, "Block", "Chunk")
        .agg(
            F.count("*").alias("Values"),
            F.to_json(F.sort_array(F.collect_list(column))).alias("ValuesJson"),
        )
    )


def reply_records(reply: Column) -> Column:
    """The records under the first root key of a reply, as array<variant>; null if there are none.

    This is the only time that a reply is parsed: types and keys are read off the variants.  JSON that
    names a key of an object twice is no reply.
    """
    roots = F.from_json(reply, T.MapType(T.StringType(), T.VariantType()))
    return F.try_variant_get(F.get(F.map_values(roots), F.lit(0)), "$", "array<variant>")


# What a value has to be in the JSON to be read as this type: a number in quotes is no score, but may be an id.
_JSON_KINDS = {T.DoubleType: "BIGINT|DOUBLE|FLOAT|DECIMAL", T.DecimalType: "BIGINT|DOUBLE|FLOAT|DECIMAL|STRING", T.StringType: "."}


def typed_records(records: Column, item: T.StructType) -> Column:
    """The records with the fields of ``item``; null where a field is missing or of another kind."""

    def value(record: Column, field: T.StructField) -> Column:
        found = F.try_variant_get(record, f"$.{field.name}", "variant")
        fits = F.schema_of_variant(found).rlike(f"^({_JSON_KINDS[type(field.dataType)]})")
        return F.when(fits, F.try_variant_get(found, "$", field.dataType.simpleString())).alias(field.name)

    return F.transform(records, lambda record: F.struct(*[value(record, field) for field in item]))


def parse_scores(replies: DataFrame, reply: str, item: T.StructType) -> DataFrame:
    """One row for every record of every reply, with the other columns kept."""
    others = [name for name in replies.columns if name != reply]
    return replies.withColumn("_items", typed_records(reply_records(F.col(reply)), item)).select(
        *others, F.inline("_items")
    )


def strict_keys(records: Column, item: T.StructType) -> Column:
    """No record misses a key or brings one of its own."""
    names = F.array(*map(F.lit, item.fieldNames()))

    def exact(record: Column) -> Column:
        keys = F.map_keys(F.try_variant_get(record, "$", "map<string,variant>"))
        return F.coalesce((F.size(keys) == F.size(names)) & (F.size(F.array_except(keys, names)) == 0), F.lit(False))

    return F.coalesce(F.forall(records, exact), F.lit(False))


def check_batches(answered: DataFrame, item: T.StructType) -> DataFrame:
    """Judge every batch by its own reply, in place: no join and no shuffle.

    ``answered`` has Items (sent), Reply (received) and the Error of a failed call.  A batch is accepted when
    the ids come back complete and in order and every score is valid; otherwise
    Reason says why not.
    """
    received = F.col("Received")
    sent_ids = F.transform("Items", lambda sent: sent["ReviewID"].cast(schema.REPLY_ID))
    received_ids = F.transform(received, lambda got: got["ReviewID"])
    flag_ok = lambda got: F.lit(True)
    if "PhraseFlag" in item.fieldNames():
        flag_ok = lambda got: F.coalesce(got["PhraseFlag"].isin(0.0, 1.0), F.lit(False))
    if "Error" not in answered.columns:
        answered = answered.withColumn("Error", F.lit(None).cast("string"))
    return (
        answered.withColumn("_records", reply_records(F.col("Reply")))
        .withColumn("Received", typed_records(F.col("_records"), item))
        .withColumn("SameIds", F.coalesce(sent_ids == received_ids, F.lit(False)))
        .withColumn(
            "InvalidScores",
            F.array_distinct(
                F.transform(
                    F.filter(received, lambda got: ~is_valid_score(got["Sentiment"])),
                    lambda got: got["Sentiment"],
                )
            ),
        )
        .withColumn(
            "Reason",
            F.when(F.col("Error").isNotNull(), "scorer failed")
            .when(received.isNull() | (F.size(received) == 0), "empty reply")
            .when(~strict_keys(F.col("_records"), item), "unexpected keys")
            .when(~F.col("SameIds"), "ids differ")
            .when(F.size("InvalidScores") > 0, "invalid scores")
            .when(~F.forall(received, flag_ok), "invalid flags"),
        )
        .drop("_records")
    )


def accepted_scores(checked: DataFrame, item: T.StructType) -> DataFrame:
    """Records of the accepted batches beside the texts they answer.

    Ids came back in order, so sent and received records pair up by place.
    """

    def pair(sent: Column, got: Column) -> Column:
        numbers = [
            got[name].cast("int").alias(name) for name in item.fieldNames() if name != "ReviewID"
        ]
        return F.struct(sent["ReviewID"].alias("ReviewID"), sent["ReviewText"].alias("ReviewText"), *numbers)

    return checked.where(F.col("Reason").isNull()).select(
        F.inline(F.zip_with("Items", "Received", pair))
    )


def quarantine(checked: DataFrame) -> DataFrame:
    """Refused batches: what was sent, what came back and why it was refused."""
    return checked.where(F.col("Reason").isNotNull()).select(
        "Queue",
        "Batch",
        F.transform("Items", lambda sent: sent["ReviewID"]).alias("ReviewIDs"),
        "Reply",
        "Error",
        "InvalidScores",
        "SameIds",
        "Reason",
    )


def validate_scores(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Compare sent and received rows of (Queue, Batch, ReviewID), row by row.

    For scorers whose output arrives as a table instead of one reply for a batch.
    State is missing, extra, repeated, invalid, misplaced or ok; a row is accepted when its
    whole batch is ok.  Answers with a column Place (from 0, in each batch) have to come in the
    order of the ids.  Both sides meet in one union, dealt by batch, so it is one
    shuffle; a batch is small by construction.
    """
    keys = ["Queue", "Batch", "ReviewID"]
    placed = "Place" in received.columns
    place = F.col("Place").cast("long") if placed else F.lit(None).cast("long")
    both = sent.select(*keys, F.lit(0).alias("Answer"), F.lit(None).cast("int").alias("Sentiment"), F.lit(None).cast("long").alias("Place")).unionByName(
        received.select(*keys, F.lit(1).alias("Answer"), F.col("Sentiment"), place.alias("Place"))
    )
    answered = F.col("Answer") == 1
    batch = Window.partitionBy("Queue", "Batch")
    rows = (
        both.repartition("Queue", "Batch")
        .groupBy(*keys)
        .agg(
            F.count_if(answered).alias("Answers"),
            F.count_if(~answered).alias("Sent"),
            F.count_if(answered & ~is_valid_score(F.col("Sentiment"))).alias("Invalid"),
            F.max("Sentiment").alias("Sentiment"),
            F.max("Place").alias("Place"),
        )
    )
    due = F.row_number().over(batch.orderBy("ReviewID")) - 1
    state = (
        F.when(F.col("Answers") == 0, "missing")
        .when(F.col("Sent") == 0, "extra")
        .when(F.col("Answers") > 1, "repeated")
        .when(F.col("Invalid") > 0, "invalid")
        .when(F.col("Place") != F.col("Due"), "misplaced")
        .otherwise("ok")
    )
    judged = rows.withColumn("Due", due).withColumn("State", state)
    faults = F.count_if(F.col("State") != "ok").over(batch)
    return judged.select(*keys, "Sentiment", "State", (faults == 0).alias("Accepted"))
