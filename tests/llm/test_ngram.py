import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ngram, queries


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [None]  # None: the end


def brute(rows, training):
    """The model's formulas with dictionaries."""
    n_texts = len(training)
    word, pair = Counter(), Counter()
    for t in training:
        seq = ["<begin>", *tokens(t)]
        word.update(seq[1:])
        pair.update(zip(seq, seq[1:]))
    total, v = sum(word.values()), len(word)
    cc = Counter(pair.values())
    d = (0, *ngram.discounts(*(cc[k] for k in (1, 2, 3, 4))))
    follows, history = Counter(), defaultdict(lambda: [0, 0, 0])
    for (h, w), c in pair.items():
        follows[w] += 1
        history[h][min(c, 3) - 1] += 1
    fc = Counter(follows.values())
    e = (0, *ngram.discounts(*(fc[k] for k in (1, 2, 3, 4))))
    kinds = len(pair)
    left = sum(e[min(c, 3)] for c in follows.values()) / kinds if kinds else 1
    out = []
    for k, t in rows:
        seq = ["<begin>", *tokens(t)]
        base = score = 0.0
        for h, w in zip(seq, seq[1:]):
            base += math.log10((word[w] + 0.1) / (total + 0.1 * (v + 1)))
            low = (max(follows[w] - e[min(follows[w], 3)], 0) / kinds + left / (v + 1)) if kinds else 1.0
            seen = n_texts if h == "<begin>" else word[h]
            if seen:
                c = pair[h, w]
                low = max(c - d[min(c, 3)], 0) / seen + sum(x * y for x, y in zip(d[1:], history[h])) / seen * low
            score += math.log10(low)
        out.append((k, len(seq) - 1, sum(word[w] > 0 for w in seq[1:]), total, base, score))
    return out


def corpus(n=300):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 50, 200])]).upper() if rng.random() < 0.1 else rng.choice(vocabulary[:60]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (None, "w1 w2 never"), (3, rows[3][1]), (n + 2, "É é w1 w2")]


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 10 == 0
    want = sorted(brute(rows, [t for k, t in rows if not held(k)]), key=repr)
    out = queries.op9_lm_scoring(spark, str(tmp_path)).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])
    assert all(r["held_out"] == held(r["doc_id"]) for r in out)


def test_probabilities_add_up(spark, tmp_path):
    from lodestone.llm.shared import Workspace

    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram.train(docs.select("text"), Workspace(spark, "test"))
    words = sorted({w for _, t in rows for w in tokens(t) if w})
    for h in ("w1", "w7"):  # texts 'h w' and 'h' differ by p(w | h) p(end | w) / p(end | h)
        def p(text):
            return 10 ** ngram.score_texts(ngram.Reader(model), [text])["score"][0]

        ends = {w: p(f"{w}") for w in [*words, h, "unknown-word"]}
        begins = p(h)
        total = 0.0
        for w in [*words, "unknown-word"]:
            # p(h) p(w|h) p(end|w) over p(w) p(end|w) leaves p(w|h) up to first-word terms
            total += p(f"{h} {w}") / ends[w] * first(model, w) / first(model, h)
        total += begins / first(model, h)
        assert total == pytest.approx(1.0, abs=1e-9)


def first(model, w):
    """p(w | begin)"""
    reader = ngram.Reader(model)
    whole = 10 ** ngram.score_texts(reader, [w])["score"][0]
    # p(end | w) from a text with w doubled: p(w) p(w|w) p(end|w) and tripled
    a, b = (10 ** ngram.score_texts(reader, [t])["score"][0] for t in (f"{w} {w}", f"{w} {w} {w}"))
    step = b / a  # p(w | w)
    end = _end(model, reader, w)
    assert step > 0
    return whole / end


def _end(model, reader, w):
    hashes = np.array(sorted({int(x) for x in [*ngram.word_hashes(w), ngram.END]}), "uint64")
    places = reader.places(hashes)
    where = {int(h): i for i, h in enumerate(hashes)}
    i, j = where[int(ngram.word_hashes(w)[0])], where[int(ngram.END)]
    follows = reader.per_word("stat3_", places, "<u4").astype(float)
    taken = sum(d * n for d, n in zip(model.lower, model.lower_counts)) / model.pairs
    low = max(follows[j] - ngram._discount(follows, model.lower)[j], 0) / model.pairs + taken / (model.words + 1)
    if places[i] < 0:
        return low
    c = float(reader.pair_counts(np.array([places[i] << 32 | places[j]], "uint64"))[0])
    n = float(reader.per_word("word_counts", places, "<u8")[i])
    stats = [float(reader.per_word(f"stat{k}_", places, "<u4")[i]) for k in range(3)]
    return max(c - float(ngram._discount(np.array([c]), model.discounts)[0]), 0) / n + sum(d * x for d, x in zip(model.discounts, stats)) / n * low


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(0, 2**64 - 1, n, "uint64", endpoint=True))
        assert np.array_equal(ngram._sorted_back(ngram._sorted_block(x)), x)
        assert np.array_equal(ngram._wide(ngram._narrow(x)), x)


def test_small_gathers_and_empty(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram.train_and_score(none, F.lit(True))[1].count() == 0
    only = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model, out = ngram.train_and_score(only, F.lit(False))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert model.tokens == 0 and rows[1]["n_known"] == 0 and rows[1]["score"] == 0.0 and rows[2]["n_tokens"] == 1


def test_very_long_texts_and_few_maps(spark, monkeypatch):
    monkeypatch.setattr(ngram, "MAPS", 2)
    rows = [(1, "a b c " * 100_000), (2, "a b a"), (3, "c")]
    want = sorted(brute(rows, [t for _, t in rows]), key=repr)
    model, out = ngram.train_and_score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], model.tokens, r["base_score"], r["score"]) for r in out.collect()), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4:] for g in got], [w[4:] for w in want])
