"""Classifiers and mixing: held-out accuracy, closed forms, edges."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairload.llm import mixing, quality_gam, toxicity

PLAIN = ["the", "river", "runs", "over", "stones", "and", "birds", "sing", "in", "trees", "while", "wind", "moves"]
BAD = ["idiot", "scumbag", "worthless", "moronic"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = []
    for k in range(900):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(20, 120))]
        toxic, good = k % 6 == 0, k % 5 != 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if not good:
            words = [w.upper() + "!!" if k % 2 else w + "%%%" for w in words]
        rows.append((k, " ".join(words) + ".", int(toxic), int(good)))
    docs = spark.createDataFrame(
        [(i, t, "x", "y", 0.1) for i, t, _, _ in rows] + [(None, "river", "x", "y", 0.1), (5000, None, "x", "y", 0.1)],
        "doc_id long, text string, lang string, source string, score double",
    ).repartition(4)
    labels = spark.createDataFrame(
        [(i, q, x) for i, _, x, q in rows] + [(None, 1, 1), (5001, None, None)], "doc_id long, quality int, toxic int"
    )
    return docs, labels, {i: (x, q) for i, _, x, q in rows}


@pytest.mark.parametrize("kind, place, folds, fold", [(toxicity, 0, 3, 1), (quality_gam, 1, 4, 2)])
def test_held_out_rows_are_told_apart(corpus, kind, place, folds, fold):
    docs, labels, truth = corpus
    rows = {r["doc_id"]: r for r in kind.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i, r in rows.items() if r["held_out"] and i in truth]
    right = sum(rows[i]["predicted"] == truth[i][place] for i in held)
    assert len(held) > 150 and right >= 0.97 * len(held)


@pytest.mark.parametrize("kind", [toxicity, quality_gam])
def test_held_out_labels_are_never_read(corpus, kind):
    docs, labels, _ = corpus
    column = "toxic" if kind is toxicity else "quality"
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % kind.FOLDS == kind.FOLD
    turned = labels.withColumn(column, F.when(hidden, 1 - F.col(column)).otherwise(F.col(column)))
    scores = lambda found: {r["doc_id"]: r["score"] for r in found.collect()}
    assert scores(kind.classify(docs, labels)) == scores(kind.classify(docs, turned))


@pytest.mark.parametrize("kind", [toxicity, quality_gam])
def test_no_labels_one_class_and_no_documents(corpus, kind):
    docs, labels, _ = corpus
    none = kind.classify(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]
    ones = labels.where("toxic = 0 and quality = 1")
    (score,) = [r["score"] for r in kind.classify(docs, ones).select("score").distinct().collect()]
    assert score < 0.05 if kind is toxicity else score > 0.95
    assert kind.classify(docs.limit(0), labels).count() == 0


def test_toxic_documents_go_and_columns_stay(corpus):
    docs, labels, truth = corpus
    clean = toxicity.drop_toxic(docs, labels)
    assert clean.columns == docs.columns
    left = {r["doc_id"] for r in clean.collect()}
    assert {None, 5000} <= left
    wrong = [i for i, (toxic, _) in truth.items() if (i in left) == bool(toxic)]
    assert len(wrong) <= 0.03 * len(truth)


def test_label_model_finds_accuracies_and_the_correlated_pair():
    rng = np.random.default_rng(3)
    y = (rng.random(6000) < 0.3).astype(float)
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75]
    v = np.stack([np.where(rng.random(6000) < a, y, 1 - y) for a in accuracy], axis=1).astype(np.int8)
    v[rng.random(v.shape) < 0.1] = 2
    twin = v[:, 3].copy()
    flip = rng.random(6000) < 0.05
    twin[flip] = 2
    v = np.column_stack([v, twin])
    model = toxicity.LabelModel(prior_weight=0.1).fit(v, np.where(rng.random(6000) < 0.2, 1 - y, y))
    assert model.parent[5] == 3 or model.parent[3] == 5
    got = model.accuracies(v)
    assert np.abs(got[:5] - accuracy).max() < 0.04
    assert ((model.posterior(v) >= 0.5) == (y == 1)).mean() > 0.95


def test_additive_tables_learn_a_pair():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(quality_gam.MEASURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality_gam.fit_additive(x, y)
    assert (2, 7) in [(a, b) for a, b, _ in model.pairs]
    fresh = rng.random((2000, x.shape[1]))
    assert ((model.score(fresh) > 0.5) == ((fresh[:, 2] > 0.5) ^ (fresh[:, 7] > 0.5))).mean() > 0.97


def test_measures_of_edge_texts_are_finite():
    for text in ("", " ", "\n\n", "é", "a" * 100_000, "a " * 50_000, "😀!|#"):
        assert len(quality_gam.measure(text)) == len(quality_gam.MEASURES)
        assert all(map(math.isfinite, quality_gam.measure(text)))


# --- mixing ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(2)
    kinds = {"en": ["the", "with", "which", "that"], "fr": ["été", "què", "où", "leçon"], "junk": ["##", "%%", "|"]}
    rows = []
    for k in range(600):
        kind = rng.choices(list(kinds), [6, 3, 1])[0]
        rows.append((k, " ".join(rng.choice(kinds[kind]) for _ in range(rng.randint(1, 200))), f"s{k % 7}", kind))
    docs = spark.createDataFrame(
        [(i, t, s, 1.0) for i, t, s, _ in rows] + [(None, None, None, 1.0), (700, " \n", "s", 1.0), (3, rows[3][1], "s3", 1.0)],
        "doc_id long, text string, source string, p0 double",
    )
    labelled = spark.createDataFrame(
        [(i, d) for i, _, _, d in rows if i % 2] + [(None, "en"), (8, None), (9, "other")], "doc_id long, domain string"
    )
    return docs, labelled, {i: (len(t.split()), d) for i, t, _, d in rows}


@pytest.mark.parametrize("targets", [{"en": 0.5, "fr": 0.4, "junk": 0.1}, {"en": 0.05, "fr": 0.95, "junk": 0.0}])
def test_expected_tokens_meet_the_targets(sources, targets):
    docs, labelled, truth = sources
    rows = mixing.mix(docs, labelled, targets, ["doc_id", "source"]).collect()
    assert len(rows) == docs.count() and all(r["rate"] >= 0 for r in rows)
    total = sum(r["tokens"] for r in rows)
    for domain, share in targets.items():
        mass = sum(r["rate"] * r["tokens"] * r[f"p_{domain}"] for r in rows)
        assert mass / total == pytest.approx(share, abs=2e-3)
    known = [r for r in rows if r["doc_id"] in truth]
    assert all(r["tokens"] == truth[r["doc_id"]][0] for r in known)
    assert np.mean([r["domain"] == truth[r["doc_id"]][1] for r in known]) > 0.97
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in rows)
    assert {r["tokens"] for r in rows if r["doc_id"] in (None, 700)} == {0}


def test_rates_equal_a_plain_projected_gradient(sources):
    docs, labelled, _ = sources
    targets = {"en": 0.1, "fr": 0.8, "junk": 0.1}
    rows = mixing.mix(docs, labelled, targets, ["doc_id"]).collect()
    t = np.array([r["tokens"] for r in rows], float)
    p = np.array([[r[f"p_{d}"] for d in sorted(targets)] for r in rows])
    goal = np.array([targets[d] for d in sorted(targets)])
    inverse = np.linalg.inv((p * t[:, None]).T @ p / t.sum() + np.eye(3) * 1e-9)
    rate = np.ones(len(rows))
    for _ in range(mixing.MAX_STEPS):
        gap = goal - (rate * t) @ p / t.sum()
        if np.abs(gap).sum() < mixing.TOLERANCE:
            break
        rate = np.maximum(0, rate + p @ (inverse @ gap))
    assert np.allclose(rate, [r["rate"] for r in rows], atol=1e-6)


def test_mixing_without_labels_or_documents(sources):
    docs, labelled, _ = sources
    targets = {"en": 0.5, "fr": 0.5}
    assert mixing.mix(docs.limit(0), labelled, targets, ["doc_id"]).count() == 0
    rows = mixing.mix(docs, labelled.limit(0), targets, ["doc_id"]).collect()
    assert all(r["p_en"] == pytest.approx(0.5) for r in rows)


def test_text_domains(spark):
    docs = spark.createDataFrame([(1, "en"), (2, "fr"), (3, "de"), (None, "en")], "doc_id long, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, mixing.text_domains(docs, labels).collect())) == [(1, "en"), (2, "junk")]


def test_tokens_are_words_between_ascii_blanks(spark):
    texts = ["", " \t\n", "one", "  a\tb\x0b\x0cc\r\nd  ", "no\u00a0break\u2003here", "x" * 5000 + "\n\n\ny", "\x1cz z\x85z"]
    tokens = mixing._tokens(F.col("text"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", tokens.alias("n")).collect()
    assert [r["n"] for r in rows] == [len(r["text"].encode().split()) for r in rows] == [0, 0, 1, 4, 1, 2, 2]
    assert "translate" not in str(tokens)  # it looks up every character by itself
