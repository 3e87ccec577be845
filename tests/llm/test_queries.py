"""The registered queries over the small tables, and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from checks import compare as checks
from reviewloom.llm import langid, mixing
from reviewloom.llm.common import keep
from reviewloom.llm.queries import ORACLE, QUERIES
from tests.llm.test_bpe import TIKTOKEN
from tests.llm.test_minhash import brute as near_classes


@pytest.fixture(scope="module")
def connection(folder):
    return checks.given_tables(folder)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, connection, folder, name, monkeypatch):
    monkeypatch.setattr(checks, "QUERIES", QUERIES)
    monkeypatch.setattr(checks, "ORACLE", ORACLE)
    count, faults = checks.compare(spark, connection, folder, name)
    assert not faults and count > 0


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in ORACLE and not name.startswith("op7_")])
def test_one_row_per_row(spark, folder, name):
    table = "embeddings" if name.startswith("op8_") else "documents"
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/{table}.parquet").count()
    assert len({row[0] for row in rows}) == len(rows)


def test_secrets_of_the_small_tables(spark, folder):
    rows = QUERIES["op7_secret_forest"](spark, folder).collect()
    assert rows and {"doc_id", "is_secret", "score"} <= set(rows[0].asDict())


def lines(df):
    return Counter(tuple(row) for row in df.collect())


def test_pipeline(spark, folder):
    """Stage by stage: the rows that each keeps of its own input, whole and unchanged, by brute force."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # A short text, a null one, nulls elsewhere, a long one, and rows that are there twice.
    odd = [(None, "No id, one text.", None, None, None), (90_001, None, "en", "web", 0), (90_002, "12 34", "en", "web", 5), (90_003, "", "en", None, 0),
           (90_004, "longword" * 5000 + " and more", "en", "web", 1), (90_005, "Twice the same row.", "de", "web", 19), (90_005, "Twice the same row.", "de", "web", 19)]
    docs = keep(docs.unionByName(spark.createDataFrame(odd, docs.schema)), "docs")
    stages = dict(corpus_pipeline.STAGES)

    # Language: texts without a letter go, and no others.
    spoken = keep(stages["language"](spark, docs, folder), "spoken")
    assert lines(spoken) == Counter({row: n for row, n in lines(docs).items() if row[1] and langid.has_letter(row[1])})

    # Exact: of equal texts one row of the largest id.
    once = keep(stages["exact"](spark, spoken, folder), "once")
    best = {}
    for row in lines(spoken):
        if row[1] not in best or (row[0] is not None and (best[row[1]][0] is None or row[0] > best[row[1]][0])):
            best[row[1]] = row
    found = lines(once)
    assert {(row[0], row[1]) for row in found} == {(row[0], row[1]) for row in best.values()} and set(found.values()) == {1}
    assert set(found) <= set(lines(spoken)) and 90_005 in {row[0] for row in found}

    # Near: one row of each class of near-equal texts, that of the smallest id.
    apart = keep(stages["near"](spark, once, folder), "apart")
    numbered = [(row[0], row[1]) for row in found if row[0] is not None]
    stay = {int(name) for _, name in near_classes(numbered)}
    got = lines(apart)
    assert {row[0] for row in got if row[0] is not None} == stay and set(got.values()) == {1} and set(got) <= set(found)
    assert any(row[0] is None for row in got)

    # Mix: every row as often as the mix takes it, three times at most; sources near their targets.
    mixed = keep(stages["mix"](spark, apart, folder), "mixed")
    copies = lines(mixed)
    assert set(copies) <= set(got) and max(copies.values()) <= 3
    size = lambda row: len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))
    sizes, taken = Counter(), Counter()
    for row in got:
        sizes[row[3]] += size(row)
        taken[row[3]] += size(row) * copies[row]
    targets = mixing.share_targets({k: sizes[k] for k in sorted(sizes, key=lambda k: (k is None, k or ""))}, (5, 2, 1), 3)
    for source, target in targets.items():
        shortest = min((size(row) for row in got if row[3] == source and size(row)), default=0)
        assert abs(taken[source] - target) <= max(shortest, 0.02 * target) + 5, source

    # Tokens: a line for each copy, with the ids that the tokenizer gives.
    coded = Counter((row.doc_id, row.n_tokens, row.ids_sha256, row.decoded_sha256) for row in stages["tokens"](spark, mixed, folder).collect())
    want = Counter()
    for row, n in copies.items():
        ids = TIKTOKEN.encode_ordinary(row[1])
        want[(row[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(row[1].encode()).hexdigest())] += n
    assert coded == want


def test_run_is_the_stages_in_a_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, folder), name)
    found = corpus_pipeline.run(spark, folder)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "tokens"]
    assert lines(found.select("doc_id")) == lines(docs.select("doc_id"))


def test_stages_carry_columns_of_any_name(spark, documents):
    docs = documents([(i, f"Some words of text number {i % 7} here.") for i in range(30)], extra="row id text_ n found rid key n_tokens")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = keep(stage(spark, docs, ""), "stage")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and set("row id n found rid key".split()) <= set(docs.columns)
    assert all(row.id == row.doc_id == row.rid for row in docs.collect())


def test_pipeline_of_no_documents(spark, documents):
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.collect() == []


def test_language_keeps_short_and_mixed_texts(spark, documents):
    """What has letters stays, even where no language is more likely than not."""
    rng = random.Random(5)
    letters = {"en": "abcd", "de": "efgh", "fr": "ijkl", "it": "mnop", "es": "qrst"}
    words = {lang: ["".join(rng.choice(own) for _ in range(5)) for _ in range(30)] for lang, own in letters.items()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, rng.randint(2, 30)), lang, "s") for i, lang in enumerate(list(words) * 40)]
    rows += [(1000 + i, " ".join(text(lang, 1 + i % 3) for lang in rng.sample(list(words), 5)), None, "s") for i in range(40)]
    rows += [(2000 + i, short, None, "s") for i, short in enumerate(["a", "zz", "vwx yz", "Ж", "ok 1"])]
    gone = [(3000, None, "en", "s"), (3001, "", "de", "s"), (3002, "12 34 ...", None, "s")]
    found = dict(corpus_pipeline.STAGES)["language"](spark, documents(rows + gone), "")
    assert sorted(row.doc_id for row in found.collect()) == [row[0] for row in rows]
