import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, toxicity

WORDS = [f"plain{i}" for i in range(80)]
MILD, SEVERE = ["dolt", "dolty", "nitwit"], ["vileness", "vilest", "gore"]


def samples(n, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        grade = rng.choice([0, 0, 0, 1, 2])
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        words += [rng.choice([(), MILD, SEVERE][grade]) for _ in range(3)] if grade else []
        rng.shuffle(words)
        out.append((" ".join(words), grade))
    return out


def likelihood(model, rows):
    """By the definition: P(grade >= k) = logistic(score - threshold)."""
    total = 0.0
    known = toxicity.Features(len(model.weights))
    for text, g in rows:
        s = sum(float(model.weights[b]) for b in known.of([text])[0])
        above = [1.0, *(1 / (1 + math.exp(t - s)) for t in model.thresholds), 0.0]
        total += math.log(max(1e-15, above[g] - above[g + 1]))
    return total / len(rows)


def test_grades_share_weights_and_thresholds_are_ordered():
    model = toxicity.fit(samples(600), buckets=1 << 12)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    held = samples(300, 2)
    severity, p = model.judge([t for t, _ in held])
    for g in (0, 1, 2):
        assert abs(np.mean([s for s, (_, y) in zip(severity, held) if y == g]) - g) < 0.3
    assert likelihood(model, held) > -0.3


def test_fit_is_a_maximum():
    rows = samples(200, 3)
    model = toxicity.fit(rows, buckets=1 << 10, steps=300)
    best = likelihood(model, rows) - toxicity.PENALTY / 2 * float((model.weights.astype("float64") ** 2).sum())
    rng = np.random.default_rng(0)
    for _ in range(20):
        other = toxicity.Model(model.grades, model.weights + rng.normal(0, 0.05, len(model.weights)) * (model.weights != 0), np.sort(model.thresholds + rng.normal(0, 0.05, 2)))
        assert likelihood(other, rows) - toxicity.PENALTY / 2 * float((other.weights**2).sum()) <= best + 1e-4


def test_beginnings_of_unseen_words_count():
    model = toxicity.fit(samples(600), buckets=1 << 12)
    severity, _ = model.judge(["plain1 plain2 vilesome vilestars", "plain1 plain2"])
    assert severity[0] > severity[1] + 0.3


def test_shares_restore_the_priors():
    rows = [(f"w{i % 3}", int(i % 2)) for i in range(400)]
    model = toxicity.fit(rows, {0: 900, 1: 100}, buckets=64)
    assert model.judge([""])[1][0] == pytest.approx(0.1, abs=0.02)


def test_query_finds_the_labelled_texts(spark):
    folder = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in queries.op6_toxicity(spark, folder).collect()}
    assert len(out) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    assert np.mean([out[r["doc_id"]]["toxic"] == bool(r["toxic"]) for r in labels]) > 0.97


def test_held_out_labels(spark):
    """Trained on half of the labels of sf0.1, judged on the other half, where every insult is one of ten words."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("grade"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    out = toxicity.judge(docs.join(labels.filter(~half), "doc_id"), toxicity.train(docs, labels.filter(half)))
    insult = F.lower("text").rlike(r"\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b")
    mean = lambda rows: rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    assert mean(out.filter(insult)) >= 0.85
    assert mean(out.filter(~insult & (F.col("grade") == 0))) <= 0.01  # neither insult nor label


def test_very_long_texts_and_clashing_columns(spark):
    model = toxicity.fit(samples(600), buckets=1 << 12)
    docs = spark.createDataFrame([(1, "plain1 " * 200_000 + "vilesome", 7, 8, 9), (2, "plain1", 7, 8, 9)], "doc_id long, text string, p_toxic int, toxic int, _0 int")
    out = {r["doc_id"]: r for r in toxicity.judge(docs, model).collect()}
    assert out[1]["severity"] > out[2]["severity"] and out[1]["_0"] == 9 and out[1]["toxic"] in (True, False)


def test_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "dolt", 5), (2, None, 5), (3, "", 5), (None, "fine", 5), (1, "dolt", 5)], "doc_id long, text string, severity int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None), (9, 0)], "doc_id long, grade int")
    out = toxicity.judge(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 5 and {r["severity"] for r in out} == {1.0}
    assert toxicity.judge(docs, toxicity.train(docs, labels.limit(0))).collect()[0]["severity"] == 0.0
    model = toxicity.fit(samples(50))
    assert toxicity.judge(docs.limit(0), model).count() == 0
