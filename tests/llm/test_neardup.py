import random

import numpy as np
import pytest

from lodestone.llm import neardup, queries, shared
from lodestone.plans import workspace
from tests.llm.oracle import same


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent=80):
    """(id, size, least id reachable) of each row, by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    top[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        least[r] = k if r not in least or (k is not None and k < least[r]) else least[r]
    return sorted(((k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    texts = [None, "", " \t\n", "One", "one", "two words", "Two  words", "a b c d e", "a b c d e f", "É b", "é b"]
    for _ in range(n):
        base = [word() for _ in range(rng.randint(5, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice(["  ", " ", "\n"]).join(copy))
    group = [word() for _ in range(150)]
    for _ in range(150):  # near copies around the threshold: chains, not stars
        copy = list(group)
        for _ in range(rng.randint(2, 14)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    common = [word() for _ in range(40)]
    for _ in range(60):  # a passage that many share
        texts.append(" ".join(common + [word() for _ in range(rng.randint(20, 90))]))
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    return rows + [rows[20], (rows[30][0], "other text under the same id"), (None, texts[30]), (None, None)]


@pytest.mark.parametrize("width", [2, 5])
def test_components_against_all_pairs(spark, width):
    rows = corpus(width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = neardup.find(docs, width=width).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr)
    assert got == brute(rows, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("rounds,block", [(0, 16), (2, 8)])
def test_lists_in_blocks_find_the_same(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SET_BLOCK", 40)
    rows = corpus(7, 20)
    out = neardup.find(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr) == brute(rows, 2)


def test_agreeing_lanes(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63 - 1, (300, 20))
    y = np.where(rng.random((300, 20)) < 0.5, x, x + rng.integers(0, 300, (300, 20)))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "a array<long>, b array<long>")
    got = df.select(neardup._agreeing(neardup._packed(df["a"], 20), neardup._packed(df["b"], 20), 20)).collect()
    assert [r[0] for r in got] == [int(((a & 127) == (b & 127)).sum()) for a, b in zip(x, y)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 2000, "uint64"))
    y = np.concatenate([x[: int(len(x) * 0.8)], rng.integers(0, 2**63, 400, "uint64")])
    same = np.mean(neardup.signature(x, 512) == neardup.signature(y, 512))
    assert abs(same - 1600 / 2400) < 0.06
    assert neardup.least_matches(32, 0.8) == 11 or 10 <= neardup.least_matches(32, 0.8) <= 13


def test_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(11)
    for n, m, common in ((1, 1, 0), (3, 5, 2), (400, 380, 350), (3000, 2900, 1000), (9000, 9000, 8999)):
        pool = np.unique(rng.integers(0, 2**64, n + m, "uint64"))
        x, y = pool[:n], pool[n - common : n - common + m]
        apart = int(np.bitwise_count(neardup.parity(x) ^ neardup.parity(y)).sum())
        assert len(neardup.parity(x)) == neardup.FOLDS // 64
        assert apart <= len(np.setxor1d(x, y)) and (apart - len(np.setxor1d(x, y))) % 2 == 0
    assert not neardup.parity(np.empty(0, "uint64")).any()


def test_deduplicate_keeps_one_of_each_and_all_columns(spark):
    rows = corpus(5, 15)
    docs = spark.createDataFrame([(k, t, "x", i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, digest string, node int")
    out = neardup.deduplicate(docs)
    assert out.columns == docs.columns
    got = out.collect()
    want = {}
    for (k, size, least), _ in zip(brute(rows, 5), rows):
        want[k, size, least] = 1
    assert len(got) == len({w[2] for w in want if w[1] and w[0] is not None}) + sum(not shingles(t, 5) or k is None for k, t in rows)
    assert neardup.deduplicate(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = corpus(11, 10)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op5_minhash_neardup(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=repr) == brute(rows, 2)


def test_query_against_sql(spark):
    assert len(same(spark, queries.op5_minhash_neardup, queries.ORACLE_SQL["op5_minhash_neardup"], "/root/testdata/sf0.001")) == 200


def test_very_long_texts_ties_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(120_000)]
    near = words[:100_000] + [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f g"), (5, "q r s t u v")]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, component_id string, kept string")
    got = {(r["doc_id"], r["component_id"]) for r in neardup.find(docs.select("doc_id", "text"), width=1).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}
    assert sorted(r["doc_id"] for r in neardup.deduplicate(docs, width=1).collect()) == [1, 3, 5]


def test_tables_that_nothing_reads_any_more_are_dropped(spark, tmp_path, monkeypatch):
    """Only what the result reads stays in the shared folder, and the worker's functions give their memory back."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(20)]
    texts = [" ".join(t) for t in base] + [" ".join([*t[:-1], f"x{i}"]) for t in base for i in range(12)]
    monkeypatch.setattr(workspace, "LOCAL_CHECKPOINTS", str(tmp_path))
    found = neardup.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=2)
    assert found.filter("kept").count() == 20 and found.count() == len(texts)
    left = {p.name for p in tmp_path.glob("neardup-*/*")}
    assert not {n for n in left if n.startswith(("open_", "large")) or "_hook" in n or "_jump" in n}
    assert list(shared.giving_back(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3]


@pytest.mark.parametrize("limit", [0, 300, 10_000])
def test_few_edges_are_joined_without_steps_over_the_executors(spark, tmp_path, monkeypatch, limit):
    """A chain, a star, a cycle and pairs: the same components by the driver, by steps, and by steps until few are left."""
    monkeypatch.setattr(workspace, "LOCAL_CHECKPOINTS", str(tmp_path))
    monkeypatch.setattr(neardup, "DRIVER_EDGES", limit, raising=False)
    rng = random.Random(limit)
    node = rng.sample(range(2**40), 700)
    edges = [(i, i + 1) for i in range(299)] + [(300, i) for i in range(301, 400)] + [(400 + i, 400 + (i + 1) % 100) for i in range(100)] + [(i, i + 1) for i in range(500, 700, 2)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(node[i], node[j]) for i, j in edges], "a long, b long")
    work = shared.Workspace(spark, "components")
    kept, keep = [], work.keep
    monkeypatch.setattr(work, "keep", lambda df, name: kept.append(name) or keep(df, name))
    got = {}
    for r in neardup.components(df, work, "c").collect():
        got.setdefault(r["comp"], set()).add(r["node"])
    want = [set(node[:300]), set(node[300:400]), set(node[400:500]), *(set(node[i : i + 2]) for i in range(500, 700, 2))]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and all(c in nodes for c, nodes in got.items())
    assert len(kept) == 1 or limit < len(edges)


@pytest.mark.parametrize("limit", [0, 10_000])
def test_ids_are_sent_as_bits_and_labels_as_arrays(spark, tmp_path, monkeypatch, limit):
    """No wanted row is missed and few others pass; what is broadcast is a row of bits; labels come back whole and once."""
    monkeypatch.setattr(neardup, "SENT_IDS", limit)
    monkeypatch.setattr(neardup, "LABELS", 7)
    for kind, of in (("long", lambda i: i * 977 - 5000), ("string", lambda i: f"id{i}")):
        rows = spark.createDataFrame([(of(i),) for i in range(3000)] + [(None,)], f"k {kind}")
        ids = {of(i) for i in range(0, 3000, 3)}
        met = neardup._among(rows, "k", spark.createDataFrame([(i,) for i in ids], f"id {kind}"))
        got = [r["k"] for r in met.collect()]
        assert ids <= set(got) and len(got) == len(set(got)) and len(got) <= len(ids) * (1.3 if limit else 1)
        assert ("LocalRelation [_bits" in met._jdf.queryExecution().optimizedPlan().toString()) == bool(limit)
        assert neardup._among(rows, "k", spark.createDataFrame([], f"id {kind}")).count() <= 60
    monkeypatch.setattr(workspace, "LOCAL_CHECKPOINTS", str(tmp_path))
    edges = spark.createDataFrame([(5 * i, 5 * i + 1 + i % 2) for i in range(50)], "a long, b long").toArrow()
    labels = neardup._labelled(edges, shared.Workspace(spark, "labels"), "l")
    want = [(5 * i + j, 5 * i) for i in range(50) for j in (0, 1 + i % 2)]
    assert sorted((r["node"], r["comp"]) for r in labels.collect()) == want
    assert neardup._labelled(edges.slice(0, 0), shared.Workspace(spark, "labels"), "none").count() == 0
