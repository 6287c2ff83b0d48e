"""Toxicity: the fit, held-out accuracy, located sentences, hard rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loftline.llm import toxicity
from loftline.llm.common import table

WORDS = [f"{a}{b}{c}" for a in ("ba", "ne", "to", "li", "sum") for b in ("r", "st", "m", "ll") for c in ("a", "en", "is", "oth", "ing")]
BAD = ("grunk", "vexo", "zibbl")


def made(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lines = [" ".join(r.choices(WORDS, k=r.randint(4, 15))) for _ in range(r.randint(1, 25))]
        toxic = i % 5 == 0
        if toxic:
            k = r.randrange(len(lines))
            lines[k] = f"{lines[k]} {r.choice(BAD).title()}{r.choice(('', 'a', 'ing', 'oth'))}"
        rows.append((i, ". ".join(lines) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_noisy_or_credits_the_sentence_that_explains():
    r = np.random.default_rng(0)
    bags, labels = [], []
    for k in range(400):
        sentences = [[1, int(r.integers(1, 6))] for _ in range(4)]
        if k % 3 == 0:
            sentences.append([2, 0, int(r.integers(1, 6))])
        bags.append(np.array([x for s in sentences for x in s]))
        labels.append(int(k % 3 == 0))
    weights, start, leak = toxicity.noisy_or(bags, np.array(labels), np.ones(400), np.zeros(6))
    assert weights[0] > 5 + weights[1:].max() and start + weights[0] > 1 and leak < 0.01


def test_planted_words_in_held_out_documents(spark):
    rows, labels = made(1500, 7)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.toxicity(docs, marks).where("held_out").toPandas().set_index("doc_id")
    want = dict(labels)
    assert len(found) > 400 and all(found["predicted"][i] == want[i] for i in found.index)
    text = dict(rows)
    for i in found.index:
        for o in found["offences"][i]:
            assert any(b in text[i][o["start"] : o["start"] + o["chars"]].lower() for b in BAD)
        assert bool(len(found["offences"][i])) == bool(want[i])


def test_document_is_the_noisy_or_of_its_sentences():
    model = toxicity.Model(["bad$", "awful$"], np.array([4.0, 6.0]), -5.0, 0.01)
    one = lambda z: 1 / (1 + np.exp(-z))
    score, found = model.judged("A bad thing. Fine! awful bad\nbad")
    assert [(lo, hi) for lo, hi, _ in found] == [(0, 11), (18, 28), (29, 32)]
    assert score == pytest.approx(1 - 0.99 * (1 - one(-1)) * (1 - one(5)) * (1 - one(-1)))
    assert model.judged("")[0] == pytest.approx(0.01)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = toxicity.op11_toxicity(spark, d).where("held_out").join(table(spark, d, "labels"), "doc_id").toPandas()
    right = found["predicted"] == found["toxic"]
    assert right.mean() > 0.93 and right[found["toxic"] == 0].mean() > 0.98


def test_hard_rows(spark):
    rows, labels = made(200, 1)
    hard = [(None, None), (9001, ""), (9001, ""), (9002, "Grunk " * 50_000), (9003, "x" * 2_000_000), (9004, ". ! ?\n\n")]
    docs = spark.createDataFrame(rows + hard, "doc_id long, text string").withColumns({c: F.lit("y") for c in ("score", "Toxic", "held_out", "feature", "bag")})
    marks = spark.createDataFrame([*labels, (0, 1), (None, 1), (3, None), (4, 7), (99_999, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, marks).toPandas()
    assert len(found) == len(rows) + len(hard) and found["score"].between(0, 1).all()
    assert found[found["doc_id"] == 9001]["score"].nunique() == 1 and found[found["doc_id"] == 9002]["predicted"].all()
    assert found[found["doc_id"].isna()]["held_out"].tolist() == [False]
    assert toxicity.toxicity(docs.where("false"), marks).count() == 0
    none = toxicity.toxicity(docs, marks.where("false"))
    assert {r["score"] for r in none.select("score").distinct().collect()} == {0.5}
    assert toxicity.toxicity(docs, marks.where("toxic = 0")).agg(F.max("score")).first()[0] < 0.01
