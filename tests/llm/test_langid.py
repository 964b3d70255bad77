import zlib

import numpy as np
import pytest

from lodestone.llm import langid, queries

FOLDER = "/root/testdata/sf0.01"


def brute(e, moves, first):
    """Marginals by adding up all label sequences."""
    import itertools

    n, langs = e.shape
    out = np.zeros_like(e)
    for ys in itertools.product(range(langs), repeat=n):
        p = first[ys[0]] * e[0, ys[0]]
        for t in range(1, n):
            p *= moves[ys[t - 1], ys[t]] * e[t, ys[t]]
        for t, y in enumerate(ys):
            out[t, y] += p
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_against_all_sequences():
    rng = np.random.default_rng(1)
    lengths = np.array([6, 6, 4, 1])
    e = rng.random((4, 6, 3)) + 0.01
    moves, first = rng.random((3, 3)) + 0.05, rng.random(3)
    out = langid.marginals(e, lengths, moves, np.tile(first, (4, 1)), np.ones((4, 3)))
    for i, n in enumerate(lengths):
        assert np.allclose(out[i, :n], brute(e[i, :n], moves, first))


@pytest.mark.parametrize("chunk,tokens", [(3, 10), (4, 10**6), (256, 10**6)])
def test_chunks_pass_messages_exactly(chunk, tokens):
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], np.zeros((8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    rows = [rng.random((n, 3)) + 0.01 for n in (0, 1, 3, 4, 8, 7, 30, 2, 64)]
    sums = langid.document_sums(model, rows, chunk, tokens)
    for row, s in zip(rows, sums):
        want = np.zeros(3)
        if len(row):
            want = langid.marginals(row[None], np.array([len(row)]), np.exp(model.moves), np.exp(model.first)[None], np.ones((1, 3)))[0].sum(axis=0)
        assert np.allclose(s, want)


def test_gradient_learns_code_switching():
    samples = [("the house of the thing is with them", "en"), ("la casa de los que es con ellos", "es"), ("das haus der ding ist mit ihnen", "de")] * 20
    model = langid.fit(samples, buckets=1 << 14)
    labeller = langid.Labeller(model)
    assert [x for _, x in labeller.words("the house of 42 la casa de los das haus der")] == ["en"] * 3 + ["und"] + ["es"] * 4 + ["de"] * 3
    assert labeller.label(["la casa", None, "", "12 !!", "Das Haus."])[0][0] == "es"
    assert labeller.label([None, "", "12 !!"]) == [("und", 0.0)] * 3


def test_held_out_accuracy(spark):
    rows = queries.op10_language_id(spark, FOLDER).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edge_cases(spark, tmp_path):
    rows = [(1, "la casa de todos", "es"), (2, "the house of all", "en"), (3, None, "en"), (4, "", None), (5, "42 --", "en"), (None, "la casa", None), (1, "la casa de todos", "es"), (6, "casa " * 3000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op10_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and {r["lang_pred"] for r in out if r["doc_id"] in (3, 4, 5)} == {"und"}
    none = spark.createDataFrame([], "doc_id long, text string, lang string, score int")
    from pyspark.sql import functions as F

    assert langid.identify(none, F.lit(True)).count() == 0
    unlabelled = spark.createDataFrame([(1, "words", None, 3)], none.schema)
    r = langid.identify(unlabelled, F.lit(True)).collect()[0]
    assert r["lang_pred"] == "und" and r["score"] == 0.0
