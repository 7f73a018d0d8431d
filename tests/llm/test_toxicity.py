"""Toxicity: held-out accuracy on planted texts, the label model, edge cases."""

import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from climo.llm import toxicity

DOCS = "doc_id long, text string, score string, label long"


def corpus(rng, n):
    docs, labels = [], []
    for d in range(n):
        words = [rng.choice("the of and to in is that for".split()) + rng.choice(["", "er", "ing", "tion"]) + rng.choice("abcdefgh") for _ in range(rng.randrange(5, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                bad = rng.choice(["idiot", "scum", "blurgh" + rng.choice(["en", "s", "ig"]), "vexqa" + rng.choice("xyz")])
                words.insert(rng.randrange(len(words) + 1), bad)
        docs.append((d, " ".join(words), "x", int(not toxic)))
        if rng.random() < 0.8:
            labels.append((d, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus(random.Random(4), 1500)
    truth = {d: t for d, _, t in labels}
    extra = [(9000, None, "x", 1), (9001, "", "x", 1), (None, "you idiot scum", "x", 1), (9002, "the " * 30_000, "x", 1), (7, docs[7][1], "x", 1)]
    frame = spark.createDataFrame(docs + extra, DOCS)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (123456, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(frame, marks).collect()
    assert len(rows) == len(docs) + len(extra)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    found = sum(r.predicted and truth[r.doc_id] for r in held)
    assert found >= 0.95 * sum(truth[r.doc_id] for r in held)
    assert sum(r.predicted and not truth[r.doc_id] for r in held) <= 0.01 * len(held)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].predicted == 1 and not by_id[9000].predicted and not by_id[9001].predicted and not by_id[9002].predicted


def test_without_labels_and_without_documents(spark):
    frame = spark.createDataFrame([(1, "you are an idiot and a moron", "", 0), (2, "plain words", "", 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(frame, none).collect()}
    assert got[1] > got[2]
    assert toxicity.toxicity_scores(frame.limit(0), none).count() == 0


def test_held_out_labels_never_matter(spark):
    docs, labels = corpus(random.Random(5), 300)
    frame = spark.createDataFrame(docs, DOCS)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
              for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_label_model_recovers_rates():
    rng = np.random.default_rng(0)
    n = len(toxicity.VOTERS)
    y = rng.random(20_000) < 0.15
    rates = np.array([np.full(n, 0.02), np.linspace(0.3, 0.8, n)])
    votes = (rng.random((len(y), n)) < rates[y.astype(int)]).astype(int)
    votes[:, 1] = votes[:, 0]                               # a copied voter: counted once between the two
    counted = pd.DataFrame(votes).groupby(list(range(n))).size().reset_index(name="n")
    model = toxicity.LabelModel(counted[list(range(n))].to_numpy(), np.full(len(counted), -1), counted.n.to_numpy())
    assert abs(model.prior - 0.15) < 0.03
    assert np.abs(model.rates[1][2:] - rates[1][2:]).max() < 0.12
    assert model.weights[0] < 0.7 < model.weights[-1]


def test_every_term_with_evidence_is_mined(spark, monkeypatch):
    """Rare toxic words among many more frequent ones: 30,000 words that stand in toxic texts as well."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: "".join(letters[i // 26 ** k % 26] for k in range(4))
    common, bad = [name(i * 7 + 1) for i in range(30_000)], [f"zq{name(i)}" for i in range(700)]
    rows = []
    for d in range(160):
        toxic = d % 4 == 0
        rows.append((d, int(toxic), " ".join(rng.sample(common, 30_000) if d < 80 else rng.sample(common, 50)) + " " + (" ".join(rng.sample(bad, 700)) if d % 16 == 0 else "")))
    frame = spark.createDataFrame(rows, "id long, toxic int, text string")
    got = toxicity.mined_terms(frame.select("id", "text"), frame.select("id", "toxic"))
    assert set(bad) <= set(got) and not set(common) & set(got)


def test_only_near_copies_are_dropped(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    passage = " ".join(word() for _ in range(30))
    rows = [(i, i % 2, passage + " " + " ".join(word() for _ in range(70))) for i in range(60)]
    rows += [(100 + i, 1, rows[1][2]) for i in range(5)] + [(200, 0, rows[1][2])]
    frame = spark.createDataFrame(rows, "id long, toxic int, text string").withColumn("text_hash", F.xxhash64("text"))
    got = toxicity._counted_documents(frame.select("id", "text_hash", "text"), frame.select("id", "toxic"))
    assert sorted(r.id for r in got.collect()) == [*range(60), 200]


def test_linear_fit_equals_dense_newton():
    rng = np.random.default_rng(1)
    x = (rng.random((400, 30)) < 0.2).astype(float)
    x[:, 5] = x[:, 6]                                        # equal columns
    y = 1 / (1 + np.exp(-(x[:, :4].sum(axis=1) * 2 - 2)))
    row, column = np.nonzero(x)
    got = toxicity.fit_linear(column, np.cumsum([0, *np.bincount(row, minlength=400)]), 30, y)
    dense, shrink, want = np.hstack([x, np.ones((400, 1))]), np.append(np.full(30, 0.05), 1e-6), np.zeros(31)
    for _ in range(50):
        p = 1 / (1 + np.exp(-dense @ want))
        want -= np.linalg.solve((dense * (p * (1 - p))[:, None]).T @ dense + np.diag(shrink), dense.T @ (p - y) + shrink * want)
    assert np.abs(got - want).max() < 1e-5


def test_reruns_and_partitions_agree_with_several_texts_of_one_id(spark):
    docs, labels = corpus(random.Random(6), 300)
    docs += [(d, docs[(d + 1) % 300][1], "x", 0) for d in range(0, 60, 3)] + docs[:20]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(docs, DOCS)
    seen = [sorted((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity_scores(f, marks).collect())
            for f in (frame.repartition(3, "text"), frame.orderBy(F.desc("doc_id"), "text"))]
    assert len(seen[0]) == len(docs) and seen[0] == seen[1]
