import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import langid

WORDS = {"en": "the of and that with this from where which".split(), "de": "der die und nicht auf sich auch über für".split(), "fr": "le la les des que qui très été pour".split()}


def rows(n=240):
    rng = random.Random(2)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang, "s"))
    return out


def predicted(spark, df, model=None):
    model = model or langid.train(df)
    found = df.select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"), langid.identify(model, spark, F.col("text")).alias("f"))
    return found.select("doc_id", "text", "lang", "held_out", "f.lang_pred", "f.score").collect()


def test_held_out_accuracy(spark, documents):
    data = [*rows(), (1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "12 34 ...", "de", "s"), (1003, "der und " * 40_000, None, "s"), (None, "les des que", "fr", "s")]
    found = predicted(spark, documents(data, "lang_pred score found"))
    by_id = {row.doc_id: row for row in found}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert by_id[1000].score == 0 and by_id[1003].score > 0.9
    known = [row for row in found if row.held_out and row.lang and row.lang_pred != "und"]
    assert len(known) > 30
    assert sum(row.lang == row.lang_pred for row in known) / len(known) >= 0.97
    assert all(0 <= row.score <= 1 for row in found)


def test_reruns_agree(spark, documents):
    df = documents(rows(120))
    one, two = (sorted((row.doc_id, row.lang_pred, round(row.score, 9)) for row in predicted(spark, df)) for _ in range(2))
    assert one == two


def test_held_out_rows_teach_nothing(spark, documents):
    data = [(i, text, "zz" if i in (0, 1, 2) else lang, s) for i, text, lang, s in rows(150)]
    aside = {row.doc_id for row in documents(data).where(langid.held_out(F.col("doc_id"))).collect()}
    data = [(i, text, "zz" if i in aside else lang, s) for i, text, lang, s in rows(150)]
    assert langid.train(documents(data)).languages == ["de", "en", "fr"]


def test_few_labels(spark, documents):
    unlabelled = [(i, text, None, s) for i, text, _, s in rows(20)]
    assert {row.lang_pred for row in predicted(spark, documents(unlabelled))} == {"und"}
    single = [(i, text, "en", s) for i, text, _, s in rows(20)]
    assert {(row.lang_pred, row.score) for row in predicted(spark, documents(single))} == {("en", 1.0)}
    assert predicted(spark, documents([])) == []


def test_pieces_cover_a_text_once(monkeypatch):
    text = " ".join(text for _, text, _, _ in rows(30))
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 57)
    for a, b in zip(whole, langid.counts(text), strict=True):
        assert np.array_equal(a, b)


def test_elastic_net_keeps_weights_sparse():
    z, n = np.array([[0.01], [-5.0], [5.0]]), np.array([[4.0], [4.0], [4.0]])
    found = langid._leader(z, n).ravel()
    assert found[0] == 0 and found[1] == pytest.approx(-found[2]) and found[1] > 0


def test_scores_are_chances(spark, documents):
    """Texts that mix two languages: a text's score is about as often right as it says."""
    rng = random.Random(9)
    data = []
    for i in range(2500):
        lang, other = rng.sample(["en", "de"], 2)
        data.append((i, " ".join(rng.choice(WORDS[lang if rng.random() < 0.6 else other]) for _ in range(7)), lang, "s"))
    df = documents(data)
    model = langid.train(df)
    found = [row for row in predicted(spark, df, model) if row.held_out]
    right = [row.lang == row.lang_pred for row in found]
    accuracy, mean = sum(right) / len(right), sum(row.score for row in found) / len(found)
    assert 0.6 < accuracy < 0.9 and abs(mean - accuracy) < 0.08

    def loss(temperature):
        total = 0.0
        for row in found:
            scaled = model.logits(row.text) / temperature
            scaled -= scaled.max()
            total += np.log(np.exp(scaled).sum()) - scaled[model.languages.index(row.lang)]
        return total / len(found)

    # On rows that took no part the chosen temperature does about as well as the best one.
    assert loss(model.temperature) < min(map(loss, langid.TEMPERATURES)) + 0.03


def test_ties_and_repeated_rows(spark, documents):
    """Equal texts get equal answers, whatever their labels; a word that says nothing gets either language."""
    data = [*rows(90), *rows(90), *((2000 + i, "zzz", lang, "s") for i, lang in enumerate(["en", "de"] * 20))]
    found = predicted(spark, documents(data))
    answers = {}
    for row in found:
        answers.setdefault(row.text, set()).add((row.lang_pred, row.score))
    assert len(found) == len(data) and all(len(held) == 1 for held in answers.values())
    assert {lang for lang, _ in answers["zzz"]} <= {"en", "de", "fr"}
