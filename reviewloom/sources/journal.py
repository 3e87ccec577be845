"""A journal of replies: what a scorer once answered is never paid for again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.session import checkpoint_dir

ENTRY = "Name string, Reply string"
DISCARD = "Digest string, Attempt int"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class ReplyJournal:
    """Replies of one scorer by the digest of what it was asked, in a shared folder.

    ``scorer`` names what answers, a model and its prompt, say: another one has replies of its own.
    A task writes each reply to a file of its own as soon as it has it; the name comes from the
    digest, so a repeated task finds what the lost one has left, and a later run leaves out what
    is answered.  ``compact`` turns the files into a Parquet table.  A reply that was refused is
    ``discard``-ed: it stays, but the same question has a new name from then on and is asked again.

    The folder has to be one that ``pyarrow.fs`` opens on the executors.
    """

    folder: str
    scorer: str

    def open(self, spark: SparkSession) -> None:
        for name in ("replies", "table", "discarded"):
            path, store = _path(spark, f"{self.folder}/{name}")
            store.mkdirs(path)

    def named(self, batches: DataFrame, question: str) -> DataFrame:
        """``batches`` with Digest, Attempt and Name of the JSON in column ``question``."""
        spark = batches.sparkSession
        digest = F.sha2(F.concat(F.lit(f"{self.scorer}\n"), F.col(question)), 256)
        refused = spark.read.schema(DISCARD).parquet(f"{self.folder}/discarded").groupBy("Digest").agg(
            (F.max("Attempt") + 1).cast("int").alias("Attempt")
        )
        return (
            batches.withColumn("Digest", digest).join(refused, "Digest", "left")
            .withColumn("Attempt", F.coalesce("Attempt", F.lit(0)))
            .withColumn("Name", F.concat("Digest", F.lit("-"), F.col("Attempt").cast("string")))
        )

    def known(self, spark: SparkSession) -> DataFrame:
        """``Name, Reply`` of all replies, each once."""
        loose = spark.read.schema(ENTRY).option("recursiveFileLookup", True).json(f"{self.folder}/replies")
        table = spark.read.schema(ENTRY).parquet(f"{self.folder}/table")
        return loose.unionByName(table).groupBy("Name").agg(F.any_value("Reply").alias("Reply"))

    def answering(self, scorer: Callable[[str], str]) -> Callable[[str, str], str]:
        """``scorer`` for use in a task, given a name and a question; it is asked only if there is no reply of that name."""
        folder = self.folder

        def answer(name: str, question: str) -> str:
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(folder)
            home = f"{root}/replies/{name[:2]}"
            path = f"{home}/{name}.json"
            if store.get_file_info(path).type == fs.FileType.File:
                with store.open_input_stream(path) as found:
                    return json.loads(found.read())["Reply"]
            reply = scorer(question)
            store.create_dir(home, recursive=True)
            # Hidden until it is whole; of two attempts at a task either one may win.
            draft = f"{home}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(json.dumps({"Name": name, "Reply": reply}).encode() + b"\n")
            store.move(draft, path)
            return reply

        return answer

    def discard(self, judged: DataFrame) -> None:
        """Mark the refused replies among ``judged`` (Digest, Attempt, Reply, Reason), so that they are asked for again."""
        refused = judged.where(F.col("Reason").isNotNull() & F.col("Reply").isNotNull())
        refused.select("Digest", "Attempt").write.mode("append").parquet(f"{self.folder}/discarded")

    def compact(self, spark: SparkSession) -> None:
        """Move the single files into the table.  If it ends half-way, some replies stand twice, which does no harm."""
        path, store = _path(spark, f"{self.folder}/replies")
        files = spark.read.option("recursiveFileLookup", True).text(path.toString()).inputFiles()
        if not files:
            return
        spark.read.schema(ENTRY).json(list(files)).write.mode("append").parquet(f"{self.folder}/table")
        for file in files:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(file), False)


def reply_journal(spark: SparkSession, scorer: str, folder: str | None = None) -> ReplyJournal:
    """A journal in ``folder``, or in a new one below the checkpoint folder."""
    journal = ReplyJournal(folder or f"{checkpoint_dir(spark)}/replies-{uuid.uuid4().hex}", scorer)
    journal.open(spark)
    return journal
