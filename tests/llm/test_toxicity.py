"""Held-out results, the presence of every n-gram, and small or one-sided samples."""

from __future__ import annotations

import math
import zlib

import numpy as np

from fieldbook.llm import toxicity


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    caught = sum(r.predicted for r in held if r.toxic) / sum(r.toxic for r in held)
    wrong = sum(r.predicted for r in held if not r.toxic) / sum(1 - r.toxic for r in held)
    assert caught > 0.8 and wrong < 0.01


def plain_buckets(text):
    text = text.decode().lower()
    buckets = set()
    for gram in (text[k : k + n] for n in toxicity.ORDERS for k in range(len(text) - n + 1)):
        h = 0
        for order, c in enumerate(gram, 1):
            h = (h * 0x01000193 + ord(c) + order) & 0xFFFFFFFF
        buckets.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BUCKETS))
    return buckets


def plain_score(model, text):
    z = model.intercept + sum(float(model.weight[b]) for b in plain_buckets(text))
    return 1 / (1 + np.exp(-z))


TEXTS = [b"you IDIOT " * (k % 3) + "plain größe 日本語 %d".encode() % k for k in range(60)]
TOXIC = np.array([int(k % 3 > 0) for k in range(60)])


def test_scores_cover_every_n_gram(monkeypatch):
    model = toxicity.train(TEXTS, TOXIC)
    assert model.used.any()
    some = [*TEXTS, b"", b"ab", b"x idio", b"long " * 500 + b"you idiot", "É 日本".encode()]
    got = model.scores(some)
    assert np.allclose(got, [plain_score(model, t) for t in some], rtol=1e-5)
    monkeypatch.setattr(toxicity, "_WINDOW", 7)
    assert np.allclose(model.scores(some), got)
    assert all(set(toxicity.present(t).tolist()) == plain_buckets(t) for t in some)


def test_features_are_n_grams_of_characters():
    assert set(toxicity.present("GRÖßE 日本語x".encode()).tolist()) == plain_buckets("größe 日本語x".encode())
    assert len(plain_buckets("日本語".encode())) == 1 and toxicity.present("日本".encode()).size == 0


def test_training_against_plain():
    """Ratios from their definition, and a fit whose gradient vanishes."""
    held = [plain_buckets(t) for t in TEXTS]
    rows = np.bincount(TOXIC, minlength=2)
    counts = toxicity.class_counts(zip(TOXIC, TEXTS))
    got = toxicity.ratios(counts, rows)
    want = {}
    for b in set().union(*held):
        n = [sum(b in h for h, y in zip(held, TOXIC) if y == c) for c in (0, 1)]
        p = [(n[c] + 1) / (rows[c] + 2) for c in (0, 1)]
        error = math.sqrt(sum(1 / (n[c] + 1) - 1 / (rows[c] + 2) for c in (0, 1)))
        size = max(0.0, abs(math.log(p[1] / p[0])) - toxicity.EVIDENCE * error)
        want[b] = math.copysign(size, math.log(p[1] / p[0]))
    assert all(abs(got[b] - r) < 1e-12 for b, r in want.items()) and sum(r != 0 for r in want.values()) > 10
    model = toxicity.train(TEXTS, TOXIC)
    slopes, away = {b: 0.0 for b, r in want.items() if r}, 0.0
    for h, y in zip(held, TOXIC):
        z = model.intercept + sum(float(model.weight[b]) for b in h)
        gap = 1 / (1 + math.exp(-z)) - y
        away += gap
        for b in h & set(slopes):
            slopes[b] += gap * want[b]
    assert abs(away) < 2e-3 and all(abs(g + toxicity.PENALTY * float(model.weight[b]) / want[b]) < 2e-3 for b, g in slopes.items())


def test_fit_is_training_on_its_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t.decode(), "x") for k, t in enumerate(TEXTS)] + [(99, None, "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(y)) for k, y in enumerate(TOXIC)] + [(99, 1), (98, 1)], "doc_id long, toxic int")
    learned = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    some = [b"idiot", b"you are plain", b""]
    want = toxicity.train([TEXTS[k] for k in learned], TOXIC[learned]).scores(some)
    assert np.allclose(toxicity.fit(docs, labels).scores(some), want, rtol=1e-6)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 500)
    rows = toxicity.sample(docs, labels, "doc_id", "text", "toxic").collect()
    assert 5 < len(rows) < 30 and sum(len(r.text) for r in rows) <= 500
    scored = toxicity.score_texts(docs, toxicity.fit(docs, labels), added=("toxic_score", "toxic")).collect()
    assert {r.score for r in scored} == {"x", "y"} and all(0 <= r.toxic_score <= 1 for r in scored)


def test_hard_cases(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, none).collect()
    assert len(rows) == docs.count() and len({r.score for r in rows}) == 1
    one = spark.createDataFrame([(k, None, 0) for k in range(20)] + [(3, 1, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, one).collect()} == {0}
    assert toxicity.toxicity(no_docs, one).collect() == []
