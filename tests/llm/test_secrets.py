import hashlib
import random

import public_tokenizers

from reviewloom.llm import secrets

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rows(n=120):
    rng = random.Random(4)
    out = []
    for i in range(n):
        value = hashlib.sha1(str(i).encode()).hexdigest()
        kind = rng.choice(["secret", "card", "mail", "words"])
        text = {
            "secret": f'the token = "{value}" here', "card": f"paid with {rng.randrange(10**15, 10**16)} today",
            "mail": f"write to someone{i}@mail{i}.example.com now", "words": f"see reviews_of_whatever_{i}_download there",
        }[kind]
        out.append((i, text, kind, f"src/{'tests' if i % 9 == 0 else 'app'}/file{i}.py"))
    return out


def judged(df, labels=None, sample=secrets.SAMPLE):
    found = secrets.find_candidates(df, RANKS)
    return secrets.judge(found, secrets.rule_labels(found) if labels is None else labels, sample)


def test_false_positives_go(spark, documents):
    data = [*rows(), (500, None, None, None), (501, "", None, "x"), (502, 'key: "' + "Ab3" * 30_000 + '"', "secret", None)]
    df = documents(data, "lo hi score")
    labels = spark.createDataFrame([(i, text.index('"') + 1 if kind == "secret" else None, int(kind == "secret")) for i, text, kind, _ in data[:60] if kind == "secret"], "id long, lo long, label int")
    found = secrets.find_candidates(df, RANKS)
    others = found.where("id < 60 AND candidate NOT RLIKE '^[0-9a-f]{40}$'").selectExpr("id", "lo", "0 AS label")
    result = {row.id: row.is_secret for row in secrets.judge(found, labels.unionByName(others)).collect()}
    truth = {i: kind == "secret" for i, _, kind, _ in data if 60 <= i < 500}
    assert sum(result[i] == truth[i] for i in truth) / len(truth) >= 0.95
    assert 500 not in result and 501 not in result and 502 in result


def test_labels_of_one_kind_or_none(spark, documents):
    df = documents(rows(12))
    none = spark.createDataFrame([], "id long, lo long, label int")
    assert {(row.score, row.is_secret) for row in judged(df, none).collect()} == {(None, True)}
    found = secrets.find_candidates(df, RANKS)
    assert {row.is_secret for row in secrets.judge(found, found.selectExpr("id", "lo", "0 AS label")).collect()} == {False}


def test_no_rows(documents):
    assert judged(documents([])).collect() == []


def test_redact(spark, documents):
    df = documents([(1, 'a token = "0123456789abcdef0123" b 0123456789abcdef0123', "en", "s"), (2, None), (3, "plain")])
    found = secrets.find_candidates(df, RANKS).selectExpr("*", "true AS is_secret")
    out = {row.doc_id: row.text for row in secrets.redact(df, found).collect()}
    assert out == {1: 'a token = "[SECRET]" b [SECRET]', 2: None, 3: "plain"}


def test_assigned_values_are_candidates_without_their_names(spark, documents):
    key = hashlib.sha1(b"k").hexdigest()
    truth = {
        f"API_KEY={key} end": key, "password=S3cretValue42xyz": "S3cretValue42xyz", 'password: "hunter2!Az"': "hunter2!Az",
        'secret = "QzXvLpWmKtRbNyHsJdGf"': "QzXvLpWmKtRbNyHsJdGf", "pwd=x7$Kq2, next": "x7$Kq2", "Authorization: Bearer aB3$dE6%gH9~": "aB3$dE6%gH9~",
        '{"db_password":"P@ss:w0rd#%","user":"bob"}': "P@ss:w0rd#%", "--auth-token='a\\'b!cD4e'": "a\\'b!cD4e", '\\"passwd\\": \\"Zk9!mQ2\\"': "Zk9!mQ2",
        "MY_SECRET_STRIPE_LIVE_PROD_EU=Vb8#tR5wQx": "Vb8#tR5wQx", "see QzXvLpWmKtRbNyHsJdGf": "QzXvLpWmKtRbNyHsJdGf", "a token=Ab1$xy&user=bob": "Ab1$xy",
    }
    found = secrets.find_candidates(documents(list(enumerate(truth))), RANKS)
    got = {row.id: (row.candidate, row.lo) for row in found.collect()}
    assert got == {i: (value, text.index(value)) for i, (text, value) in enumerate(truth.items())} and found.count() == len(truth)
    labels = {row.id: row.label for row in secrets.rule_labels(found).collect()}
    assert labels == {i: int(not text.startswith("see")) for i, text in enumerate(truth)}


def test_candidates_cut_from_runs():
    cut = lambda text: [text[lo:hi] for lo, hi in secrets.spans(text)]
    assert cut("user=john1234567") == ["john1234567"]
    assert cut("dXNlcjpwYXNzd29yZDEyMw==") == ["dXNlcjpwYXNzd29yZDEyMw=="]
    assert cut("dXNlcjpwYXNzd29yZDEyMw==@db.host.com") == ["dXNlcjpwYXNzd29yZDEyMw==", "@db.host.com"]
    assert cut("=" * 40) == [] and cut("plain words: here https://a.b/c") == []
    assert cut("x1y2z3x1y2z3x1y2z3/token=abcdef") == ["x1y2z3x1y2z3x1y2z3/token=", "abcdef"]
    for text in ("key" * 50_000, "key=" * 50_000, "key:\\" * 50_000, 'key="' * 50_000, "key:" + "\\" * 200_000, "key:" + ",a" * 100_000, "key " * 50_000):
        found = secrets.spans(text)
        assert all(a < b <= c for (a, b), (c, _) in zip(found, found[1:]))  # noqa: B905


def test_rule_leaves_words_and_the_forest_keeps_short_secrets(spark, documents):
    rng = random.Random(8)
    signs = "abcdefghkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ23456789!#$%~"
    data = [(i, f'password: "{"".join(rng.choice(signs) for _ in range(10))}"' if i % 2 else f"the key: {rng.choice(['understanding', 'important', 'something', 'education'])} of it") for i in range(200)]
    assert {(row.id % 2, row.is_secret) for row in judged(documents(data)).collect()} == {(0, False), (1, True)}


def test_ids_that_are_null_or_repeat(spark, documents):
    """Secrets of rows without an id go, and texts of one id keep to their own findings and labels."""
    value = "0123456789abcdef0123"
    data = [(None, f'a token = "{value}" b'), (None, f"see {value} of nothing"), (7, f'the key: "{value}"!'), (7, "no secret here at all"), (7, f'zz {value}')]
    df = documents(data)
    found = secrets.find_candidates(df, RANKS).cache()
    out = sorted(row.text for row in secrets.redact(df, found.selectExpr("*", "true AS is_secret")).collect())
    assert out == sorted(text.replace(value, "[SECRET]") for _, text in data)

    labels = secrets.rule_labels(found)
    assert labels.count() == found.count() == 4
    twice = labels.unionByName(labels)
    result = {(row.id, row.before): (row.score is not None, row.is_secret) for row in secrets.judge(found, twice).collect()}
    assert len(result) == 4
    # Labels by id and place only: those of one place that contradict each other are left out.
    torn = spark.createDataFrame([(7, 10, 1), (7, 10, 0), (None, None, 1)], "id long, lo long, label int")
    assert {(row.score, row.is_secret) for row in secrets.judge(found, torn).collect()} == {(None, True)}


def test_scores_agree_with_labels_by_hand(spark, documents):
    """Precision and recall on rows that the forest has no labels of."""
    data = rows(300)
    df = documents(data)
    found = secrets.find_candidates(df, RANKS).cache()
    truth = {i: kind == "secret" for i, _, kind, _ in data}
    hand = spark.createDataFrame([(row.id, row.lo, int(truth[row.id])) for row in found.collect() if row.id < 150], "id long, lo long, label int")
    judged_rows = [(truth[row.id], row.is_secret) for row in secrets.judge(found, hand).collect() if row.id >= 150]
    right = sum(a and b for a, b in judged_rows)
    assert right / max(1, sum(b for _, b in judged_rows)) >= 0.95 and right / max(1, sum(a for a, _ in judged_rows)) >= 0.95
