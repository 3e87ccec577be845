"""Replies are paid for once, whatever happens to tasks and runs."""

import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from reviewloom.plans import scoring
from reviewloom.sources.journal import reply_journal


@pytest.fixture
def candidates(spark):
    words = ["great", "slow", "cold", "lovely", "terrible", "fine", "friendly"]
    rows = [(i, f"The staff was {words[i % 7]} at table {chr(97 + i // 7 % 26)}{chr(97 + i // 180)}x") for i in range(400)]
    return spark.createDataFrame(rows, "ReviewID long, ReviewText string")


def counting(folder, inner):
    """A scorer that leaves a file for every call."""

    def ask(batch):
        import hashlib
        import uuid

        with open(f"{folder}/{hashlib.sha256(batch.encode()).hexdigest()}.{uuid.uuid4().hex}", "w"):
            pass
        return inner(batch)

    return ask


def calls(folder):
    return [name.split(".")[0] for name in os.listdir(folder)]


def scores(run):
    return sorted(tuple(row) for row in run.scores.collect())


def test_second_run_asks_nothing(spark, candidates, tmp_path):
    journal = reply_journal(spark, "lexicon", f"file://{tmp_path}/journal")
    (tmp_path / "calls").mkdir()
    ask = counting(tmp_path / "calls", scoring.lexicon_scorer())
    plain = scoring.run_scorer(candidates, scoring.lexicon_scorer(), size=10)
    first = scoring.run_scorer(candidates, ask, size=10, journal=journal)
    made = calls(tmp_path / "calls")
    assert len(made) == len(set(made)) == 40
    again = scoring.run_scorer(candidates, ask, size=10, journal=journal)
    assert scores(first) == scores(again) == scores(plain) and len(calls(tmp_path / "calls")) == 40

    # Compacted, and beside another scorer's replies.
    journal.compact(spark)
    assert not list((tmp_path / "journal" / "replies").rglob("*.json")) and journal.known(spark).count() == 40
    assert scores(scoring.run_scorer(candidates, ask, size=10, journal=journal)) == scores(plain) and len(calls(tmp_path / "calls")) == 40
    other = reply_journal(spark, "another prompt", f"file://{tmp_path}/journal")
    scoring.run_scorer(candidates.limit(10), ask, size=10, journal=other)
    assert len(calls(tmp_path / "calls")) == 41
    journal.compact(spark)
    journal.compact(spark)
    assert journal.known(spark).count() == 41


def test_new_texts_alone_are_asked_for(spark, candidates, tmp_path):
    """A run that was stopped: the batches it had no reply for, and only those, are asked."""
    journal = reply_journal(spark, "lexicon", f"file://{tmp_path}/journal")
    (tmp_path / "calls").mkdir()
    inner = scoring.lexicon_scorer()
    failing = counting(tmp_path / "calls", lambda batch: inner(batch) if "terrible" not in batch else 1 / 0)
    run = scoring.run_scorer(candidates, failing, size=1, passes=1, journal=journal)
    assert run.metrics.first().asDict() == {"Completed": 343, "Failed": 57, "Remaining": 57}
    assert len(calls(tmp_path / "calls")) == 400
    run = scoring.run_scorer(candidates, counting(tmp_path / "calls", inner), size=1, passes=1, journal=journal)
    assert run.rejects.isEmpty() and len(calls(tmp_path / "calls")) == 457


def test_refused_replies_are_asked_for_again(spark, candidates, tmp_path):
    journal = reply_journal(spark, "moody", f"file://{tmp_path}/journal")
    (tmp_path / "calls").mkdir()
    inner = scoring.lexicon_scorer()
    nonsense = counting(tmp_path / "calls", lambda batch: '{"x": []}' if "cold" in batch else inner(batch))
    run = scoring.run_scorer(candidates, nonsense, size=1, passes=2, journal=journal)
    cold = candidates.where(F.col("ReviewText").contains("cold")).count()
    assert run.rejects.count() == cold and len(calls(tmp_path / "calls")) == 400 + cold
    run = scoring.run_scorer(candidates, counting(tmp_path / "calls", inner), size=1, passes=2, journal=journal)
    assert run.rejects.isEmpty() and len(calls(tmp_path / "calls")) == 400 + 2 * cold


def test_waves_bound_the_calls_of_a_task(spark, candidates, tmp_path):
    (tmp_path / "tasks").mkdir()
    folder, inner = str(tmp_path / "tasks"), scoring.lexicon_scorer()

    def ask(batch):
        import uuid

        from pyspark import TaskContext

        context = TaskContext.get()
        with open(f"{folder}/{context.stageId()}-{context.partitionId()}.{uuid.uuid4().hex}", "w"):
            pass
        return inner(batch)

    run = scoring.run_scorer(candidates, ask, size=2, calls=3, task_calls=8)
    made = calls(folder)
    stages = {name.split("-")[0] for name in made}
    assert len(made) == 200 and len(stages) > 4
    assert all(len({name for name in made if name.startswith(f"{stage}-")}) <= 3 for stage in stages)
    assert max(made.count(name) for name in set(made)) < 30
    assert run.scores.count() == 400


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from reviewloom.plans import scoring
from reviewloom.sources.journal import reply_journal

folder = {folder!r}
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", folder + "/shared").getOrCreate()
inner = scoring.lexicon_scorer()

def ask(batch):
    import hashlib, uuid
    name = hashlib.sha256(batch.encode()).hexdigest()
    if len(os.listdir(folder + "/calls")) >= 9 and not os.path.exists(folder + "/died"):
        open(folder + "/died", "w").close()
        os._exit(1)  # the task's worker is gone half-way
    open(f"{{folder}}/calls/{{name}}.{{uuid.uuid4().hex}}", "w").close()
    return inner(batch)

rows = [(i, f"The staff was great at table {{chr(97 + i % 26)}}{{chr(97 + i // 26)}}x") for i in range(200)]
journal = reply_journal(spark, "lexicon", "file://" + folder + "/journal")
run = scoring.run_scorer(spark.createDataFrame(rows, "ReviewID long, ReviewText string"), ask, size=5, calls=2, journal=journal)
print("SCORES", run.scores.count(), run.rejects.count())
"""


def test_repeated_task_asks_only_for_what_has_no_reply(tmp_path):
    (tmp_path / "calls").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = textwrap.dedent(KILLED).format(root=root, folder=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": root, "PYSPARK_PYTHON": sys.executable})
    assert "SCORES 200 0" in out.stdout, out.stderr[-2000:]
    made = calls(tmp_path / "calls")
    assert (tmp_path / "died").exists() and len(made) == len(set(made)) == 40


def test_reply_with_line_breaks(spark, tmp_path):
    journal = reply_journal(spark, "x", f"file://{tmp_path}/journal")
    ask = journal.answering(lambda question: f'{{"a":\n "é {question}"}}')
    assert ask("0a-0", "q") == ask("0a-0", "other") == '{"a":\n "é q"}'
    assert [row.Reply for row in journal.known(spark).collect()] == ['{"a":\n "é q"}']
    assert json.loads(ask("0a-0", "")) == {"a": "é q"}
