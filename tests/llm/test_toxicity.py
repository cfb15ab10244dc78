"""Voters, the label model and the classifier: by hand, by simulation and on held-out labels."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomlog.llm import toxicity

SCHEMA = "doc_id long, text string, score string, label string, own string, place string, held_out string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=900, seed=7, insult="zorkwit"):
    """Plain texts; every eighth is hostile, by listed insults and by an invented stem."""
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abdelmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    bad = ["idiot", "moron", "scum"] + [insult + e for e in ("", "s", "ted", "ful", "ly")]
    texts, toxic = [], []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        toxic.append(int(k % 8 == 3))
        for _ in range(toxic[-1] * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
    return texts, toxic


def frames(spark, texts, toxic, labelled=lambda k: True):
    docs = [(k, t, "x", "x", "x", "x", "x") for k, t in enumerate(texts)]
    labels = [(k, 1, y) for k, y in enumerate(toxic) if labelled(k)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)


def out_of(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def test_features_of_words():
    found, first, loud = toxicity.word_features(pa.array(["Idiot idiots été", None, "", "AB1ab"]))
    assert first.tolist() == [0, 3, 3, 3, 5] and loud.tolist() == pytest.approx([1 / 16, 0, 0, 0.5])  # of bytes
    # words share beginnings, not the whole; case of ASCII does not count
    assert found[0, 0] != found[0, 1] and (found[1:3, 0] == found[1:3, 1]).all()
    assert found[3, 0] == 0 and found[3, 1] != 0 and found[0, 3] == found[0, 4]
    assert (found[found > 0] & np.uint64(3)).max() == 3


def test_patterns_by_hand():
    voters = toxicity.Voters.of(np.zeros(0, np.uint64))
    texts = [
        "a fine day", "you moron", "moron " + "x " * 20 + "scum", "idiot", "WHAT A LOUD NOISE HERE", None,
        "x " * 60 + "basura " + "x " * 60,
    ]
    bits = [sorted(k for k in range(16) if v >> k & 1) for v in voters.patterns(pa.array(texts))]
    # idiot stands in three lists
    assert bits == [[], [8, 13, 14], [8, 13], [8, 9, 10, 13], [15], [], [11]]
    assert 12 in [k for k in range(16) if int(voters.patterns(pa.array(["scum a b scum"]))[0]) >> k & 1]


def test_label_model_finds_accuracies_and_correlations():
    """Votes are drawn from known rates; one voter copies another most of the time."""
    rng = np.random.default_rng(1)
    n = 40_000
    y = rng.random(n) < 0.15
    on = np.linspace(0.3, 0.9, toxicity.VOTERS)
    off = np.linspace(0.01, 0.12, toxicity.VOTERS)
    votes = rng.random((n, toxicity.VOTERS)) < np.where(y[:, None], on, off)
    copied = rng.random(n) < 0.9
    votes[copied, 4] = votes[copied, 11]
    patterns, counts = np.unique(votes @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    model = toxicity.fit_labels(patterns, counts.astype(float), np.full(len(patterns), -1))
    assert model.prior == pytest.approx(0.15, abs=0.01)
    assert model.parent[4] == 11 or model.parent[11] == 4
    rates = model.accuracies(patterns, counts)
    others = np.arange(toxicity.VOTERS) != 4
    assert np.abs(rates[1] - on)[others].max() < 0.03 and np.abs(rates[0] - off)[others].max() < 0.02
    guess = model.posterior(votes @ (1 << np.arange(toxicity.VOTERS))) >= 0.5
    assert (guess == y).mean() > 0.99


def test_anchors_hold():
    """Labelled patterns pull the class to what the labels say."""
    patterns, counts = np.array([0, 1, 1]), np.array([900.0, 50.0, 50.0])
    label = np.array([0, 0, -1])
    assert toxicity.fit_labels(patterns, counts, label).posterior(np.array([1]))[0] < 0.5
    label = np.array([0, 1, -1])
    assert toxicity.fit_labels(patterns, counts, label).posterior(np.array([1]))[0] > 0.9


def test_logistic_reaches_the_minimum():
    """The gradient of the stated loss is zero at the result."""
    rng = np.random.default_rng(2)
    lists = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(200)]
    target, weight = rng.random(200), rng.random(200) + 0.5
    w, bias = toxicity.logistic(lists, target, weight, 12, steps=3000)
    x = np.array([[k in row for k in range(12)] for row in lists], float)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    error = weight / weight.mean() * (p - target)
    assert np.abs(x.T @ error + toxicity.RIDGE * w).max() < 1e-6
    assert abs(error.sum() + 1e-3 * bias) < 1e-6


def test_scores_are_the_stated_sums(spark):
    """Every score by hand from the classifier's weights, whatever the text."""
    texts, toxic = corpus(300)
    texts += ["", None, "idiot " * 100_000, "Zorkwitted zorkwitted"]
    docs, labels = frames(spark, texts, toxic)
    classifier, _, _ = toxicity.fit(docs, labels)
    weight = dict(zip(classifier.keys.tolist(), classifier.weights))
    rows = toxicity.score(docs, classifier).collect()
    assert len(rows) == len(texts)
    for row in rows:
        words = sorted(set(re.findall("[A-Za-z]+", texts[row["doc_id"]] or "")))
        found, _, _ = toxicity.word_features(pa.array([" ".join(words)]))
        total = classifier.bias + sum(weight.get(f, 0.0) for f in set(found.ravel().tolist()))
        assert row["score"] == pytest.approx(1 / (1 + np.exp(-total)))
        assert row["predicted"] == int(row["score"] >= 0.7) and row["held_out"] == out_of(row["doc_id"])


def test_held_out_accuracy_and_no_leak(spark):
    """Held-out rows are judged rightly, and their labels change nothing."""
    texts, toxic = corpus()
    docs, labels = frames(spark, texts, toxic)
    rows = {r["doc_id"]: r for r in toxicity.scored_documents(docs, labels).collect()}
    held = [k for k in range(len(texts)) if out_of(k)]
    right = [rows[k]["predicted"] == toxic[k] for k in held]
    assert np.mean(right) > 0.97
    assert np.mean([rows[k]["predicted"] for k in held if toxic[k]]) > 0.9
    flipped = [1 - y if out_of(k) else y for k, y in enumerate(toxic)]
    again = toxicity.scored_documents(docs, frames(spark, texts, flipped)[1]).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {k: r["score"] for k, r in rows.items()}


def test_copies_do_not_make_words_toxic(spark):
    """One hostile text in a thousand copies tells no more than one."""
    texts, toxic = corpus(600)
    copied = "ordinary garden table window moron weather station"
    docs, labels = frames(spark, texts + [copied] * 400, toxic + [1] * 400)
    classifier, _, _ = toxicity.fit(docs, labels)
    low, high = classifier.scores(pa.array(["ordinary garden table window weather station", "moron"]))
    assert low < 0.5 < 0.7 <= high


@pytest.mark.parametrize("known", [(), ((1, 1, 1),), ((None, 1, 1), (2, None, None), (3, 1, 5), (4, 1, 0))])
def test_few_or_odd_labels(spark, known):
    texts = ["", None, "plain words", "you idiot moron scum"] * 3
    docs, _ = frames(spark, texts, [0] * 12)
    docs = docs.union(spark.createDataFrame([(None, "no id", *"xxxxx")], docs.schema))
    rows = toxicity.scored_documents(docs, spark.createDataFrame(list(known), LABELS)).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]


def test_empty(spark):
    out = toxicity.scored_documents(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS))
    assert out.collect() == [] and out.columns == ["doc_id", "held_out", "score", "predicted"]


def test_given_labels(spark, small):
    """On the given tables: no clean document is called toxic, most hostile held-out ones are."""
    tables = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored_documents(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) >= 0.6
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) <= 0.02
