"""Properties and edge cases of the library's operators."""

import itertools
import math
import random
import threading
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from lodestone.functions import hashing, text
from lodestone.operators import clustering, graph, itemsets, recommend, relational, similarity, sketches
from lodestone.sources import io


def test_primes():
    assert [n for n in range(60) if hashing.is_prime(n)] == [n for n in range(60) if n > 1 and all(n % d for d in range(2, n))]
    assert hashing.prime_after(100) == 101 and hashing.prime_after(0) == 2


def test_text_mod_and_zeros(spark):
    words = ["abc", "vxR_YV0atFxIxfOnF9uHjQ", "é", "", None]
    for p in (1_000_003, 10_000_019):
        got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(hashing.text_mod(F.col("w"), p)).collect()]
        assert got == [int.from_bytes(w.encode(), "big") % p if w is not None else None for w in words]
    got = [r[0] for r in spark.range(300).select(hashing.trailing_zeros(F.col("id"))).collect()]
    assert got == [len(f"{i:b}") - len(f"{i:b}".rstrip("0")) for i in range(300)] and got[0] == 1


def test_text_functions(spark):
    rows = spark.createDataFrame([("Café, Bars & Food",), ("barstools",), ("",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(text.clean(F.col("t")), text.first_keyword(text.clean(F.col("t")), ["food", "bars"])).collect()]
    assert got == [("café  bars   food", "food"), ("barstools", "bars"), (" ", "other"), (" ", "other")]
    maps = spark.createDataFrame([({"a": "1"},), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in maps.select(text.map_size(F.col("m"))).collect()] == [1, 0, 0]
    assert spark.range(1).select(text.year_of(F.lit("2011-05")), text.unquoted(F.lit('"12"'))).first()[:] == (2011, "12")


def test_relational_edge_cases(spark):
    none = spark.createDataFrame([], "user_id string, item_id string, date date")
    r = relational.exploration_report(none, 2018).first()
    assert r["n_review"] == 0 and r["top10_user"] == []
    cities = spark.createDataFrame([("a", 1.0), ("", 5.0), (None, 5.0), ("b", 1.0), ("b", 3.0)], "city string, stars double")
    assert [tuple(r) for r in relational.top_average(cities, "city", "stars").collect()] == [("b", 2.0), ("a", 1.0)]
    sizes = relational.partition_sizes(cities, "city", 7).collect()
    assert len(sizes) == 7 and sum(r["n_items"] for r in sizes) == 5
    report = relational.partition_report(cities, "city", 6)
    assert report["customized"]["n_partition"] == 6 and sum(report["default"]["n_items"]) == 5
    with pytest.raises(ValueError):
        relational.oriented(cities, 3, "city", "stars")
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert [r[0] for r in relational.minus_rows(a, b).collect()] == [1, 1]
    errors = spark.createDataFrame([(1.0, 1.5), (1.0, 9.0), (None, 1.0)], "t double, g double")
    assert [r["n"] for r in relational.error_histogram(errors, "t", "g").orderBy("error").collect()] == [1, 0, 0, 0, 1]


def brute_sets(baskets, support):
    out = {}
    items = sorted({x for b in baskets for x in b})
    for k in range(1, 6):
        for s in itertools.combinations(items, k):
            n = sum(set(s) <= set(b) for b in baskets)
            if n >= support:
                out[s] = n
    return out


def test_itemsets_against_brute_force(spark):
    rng = random.Random(4)
    baskets = [sorted({rng.choice("abcdefg") for _ in range(rng.randint(1, 6))}) for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b + b[:1]] + [(None, "a"), (1, None)], "basket long, item string")
    want = brute_sets(baskets, 9)
    got = {tuple(r["items"]): r["n"] for r in itemsets.frequent_itemsets(df, 9).collect()}
    assert got == want
    clean = df.filter("basket IS NOT NULL AND item IS NOT NULL")
    candidates, frequent = itemsets.son(clean, 9, 3)
    assert {tuple(r["items"]): r["n"] for r in frequent.collect()} == want
    assert {tuple(r["items"]) for r in candidates.collect()} >= set(want)
    assert set(itemsets.itemsets_of(baskets, 9)) == set(want)
    assert itemsets.frequent_itemsets(df.limit(0), 1).count() == 0
    report = io.itemset_report(candidates, frequent)
    assert report.startswith("Candidates:\n('a'),('b')") and "\n\nFrequent Itemsets:\n('a')" in report
    assert io.itemset_report(candidates.limit(0), frequent.limit(0)) == "Candidates:\n\n\nFrequent Itemsets:\n"


def test_retail_baskets(spark):
    rows = spark.createDataFrame([("1/1", 7, 10), ("1/1", 7, 10), ("1/1", 7, 9), ("1/2", 7, 10), ("1/1", 8, 1), ("1/1", 8, 2)], "date string, customer_id long, product_id long")
    out = itemsets.retail_baskets(rows, 1)
    assert sorted((r["basket"], r["item"]) for r in out.collect()) == [("1/1-7", "10"), ("1/1-7", "9"), ("1/1-8", "1"), ("1/1-8", "2")]
    assert itemsets.retail_baskets(rows, 2).count() == 0


def test_fp_growth_agrees(spark):
    from pyspark.ml.fpm import FPGrowth

    rng = random.Random(8)
    baskets = [(i, sorted({rng.choice("abcdefgh") for _ in range(4)})) for i in range(80)]
    df = spark.createDataFrame(baskets, "basket long, items array<string>")
    model = FPGrowth(minSupport=itemsets.minimum_share(12, 80)).fit(df)
    theirs = {tuple(sorted(r["items"])): r["freq"] for r in model.freqItemsets.collect() if r["freq"] >= 12}
    ours = itemsets.frequent_itemsets(df.select("basket", F.explode("items").alias("item")), 12)
    assert {tuple(r["items"]): r["n"] for r in ours.collect()} == theirs


def test_similar_pairs_and_recall(spark):
    rng = random.Random(2)
    sets = {}
    for i in range(60):
        base = {rng.randrange(500) for _ in range(20)} | {0, 1}
        sets[2 * i] = base
        sets[2 * i + 1] = {x for x in base if rng.random() > 0.2} | {rng.randrange(500) for _ in range(rng.randint(0, 8))}
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "key long, item long")
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df).collect()} == want
    near = {(r["a"], r["b"]) for r in similarity.similar_pairs_lsh(df, similarity.minhash_family(1009)).collect()}
    assert near <= want and len(near) >= 0.95 * len(want)
    shared = {(r["a"], r["b"]): r["common"] for r in similarity.overlapping_pairs(df, 12).collect()}
    assert shared == {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 12}


def test_bands_of_three_with_one_left_over(spark):
    signed = spark.createDataFrame([(1, list(range(100))), (2, [-1] * 99 + [99])], "key long, signature array<long>")
    assert [tuple(r) for r in similarity.lsh_pairs(signed).collect()] == [(1, 2)]  # by the 34th band alone


def test_predictions_by_definition(spark):
    rng = random.Random(3)
    rows = [(u, i, float(rng.randint(1, 5)), s) for s, (u, i) in enumerate((rng.randrange(8), rng.randrange(10)) for _ in range(60))]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, stars double, seq long")
    last, by_item, by_user = {}, defaultdict(list), defaultdict(list)
    for u, i, r, _ in rows:
        last[u, i] = r
        by_item[i].append(r)
        by_user[u].append(r)
    im, um = ({k: sum(v) / len(v) for k, v in d.items()} for d in (by_item, by_user))

    def w(i, j):
        users = [u for u in by_user if (u, i) in last and (u, j) in last]
        if len(users) <= 1:
            gap = abs(im[i] - im[j])
            return 1.0 if gap <= 1 else 0.5 if gap <= 2 else 0.0
        a, b = [last[u, i] - im[i] for u in users], [last[u, j] - im[j] for u in users]
        num = sum(x * y for x, y in zip(a, b))
        return 0.0 if abs(num) < 5e-10 else round(num / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(y * y for y in b)), 9)

    targets = [(u, i) for u in [*by_user, 99] for i in [*by_item, 77]]
    got = {(r["user_id"], r["item_id"]): r["prediction"] for r in recommend.predict_by_items(ratings, spark.createDataFrame(targets, "user_id long, item_id long"), neighbours=3).collect()}
    assert len(got) == len(targets)
    for u, i in targets:
        if u not in um or i not in im:
            want = um.get(u, im.get(i, recommend.FALLBACK))
        else:
            near = sorted(((-w(i, j), j, r) for (v, j), r in last.items() if v == u and w(i, j) > 0))[:3]
            want = sum(-a * r for a, _, r in near) / sum(-a for a, _, _ in near) if near else recommend.FALLBACK
        assert got[u, i] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("hot", [10**9, 60])
def test_predictions_item_by_item(spark, monkeypatch, hot):
    """No pair of ratings is shuffled but those of items with too many; steps of any size give the same predictions."""
    rng = random.Random(6)
    rows = [(u, i, float(rng.randint(1, 5)), s) for s, (u, i) in enumerate((rng.randrange(12), rng.randrange(-3, 12) ** 2) for _ in range(90))]
    ratings = spark.createDataFrame([*rows, (None, 4, 1.0, 98), (3, None, 2.0, 99), (50, None, 5.0, 100)], "user_id long, item_id long, stars double, seq long")
    asked = [(u, i) for u in (*range(10), 50, 99, None) for i in (0, 1, 4, 9, 77, -5, None)]
    targets = spark.createDataFrame(asked, "user_id long, item_id long")
    tidy = lambda df: sorted(((r["user_id"], r["item_id"], round(r["prediction"], 9)) for r in df.collect()), key=repr)
    want = tidy(recommend._predict_by_join(ratings, targets, 3, 2.5))
    assert len(want) == len(asked)
    asked_of, by_join = [], recommend._predict_by_join
    monkeypatch.setattr(recommend, "_predict_by_join", lambda *args: asked_of.append(args[1].count()) or by_join(*args))
    monkeypatch.setattr(recommend, "HOT", hot)
    monkeypatch.setattr(recommend, "TURN", 200)
    monkeypatch.setattr(recommend, "TASK", 100)
    for chunk in (1, 50, 10**6):
        monkeypatch.setattr(recommend, "CHUNK", chunk)
        assert tidy(recommend.predict_by_items(ratings, targets, 3, 2.5)) == want
    assert asked_of == [] if hot > 60 else all(0 < n < len(asked) for n in asked_of)


def test_models_and_blend(spark, tmp_path):
    rows = [(u, u % 7, float(u % 5), float(u % 3) if u % 4 else None, float(u % 5)) for u in range(200)]
    data = spark.createDataFrame(rows, "user_id long, item_id long, x double, y double, stars double")
    out = recommend.predict_by_model(data, data.drop("stars"), ["x", "y"], rounds=5, depth=3)
    assert relational.rmse(out.join(data.select("user_id", "stars"), "user_id"), "stars", "prediction").first()[0] < 0.3
    models = recommend.fit_folds(data, ["x", "y"], ["user_id"], folds=2, rounds=3, depth=2)
    io.save_model(models[0], f"{tmp_path}/model")
    again = io.load_model(f"{tmp_path}/model").transform(data).select("user_id", "prediction")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, models[0].transform(data).select("user_id", "prediction").collect()))
    assert recommend.predict_by_ensemble(models, data).columns == [*data.columns, "prediction"]
    mixed = recommend.blend(out, out).join(out.select("user_id", F.col("prediction").alias("p")), "user_id")
    assert mixed.filter(F.abs(F.col("prediction") - F.col("p")) > 1e-9).count() == 0


def test_rows_of_equal_bins_are_fitted_once(spark):
    """A row of each kind with its number as weight gives the trees of all rows, and is all that the trees are given."""
    rng = random.Random(8)
    rows = [(float(rng.randrange(6)), float(rng.randrange(5)) if rng.random() > 0.1 else None, float(rng.randint(1, 5))) for _ in range(900)]
    data = spark.createDataFrame(rows, "x double, y double, stars double")
    pipeline = recommend.boosted(["x", "y"], rounds=8, depth=3)
    whole, ours, seen = pipeline.fit(data), None, []
    fit = GBTRegressor.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(GBTRegressor, "fit", lambda self, df, *a: seen.append(df.count()) or fit(self, df, *a))
        ours = recommend._fitted(pipeline, data)
    assert 30 <= seen[0] <= 36
    assert " in {" not in ours.stages[-1].toDebugString  # bins are numbers, not categories
    tidy = lambda model: sorted(((r["x"], r["y"], round(r["prediction"], 6)) for r in model.transform(data).collect()), key=repr)
    assert tidy(ours) == tidy(whole)


def test_folds_are_fitted_at_the_same_time(spark, monkeypatch):
    data = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(300)], "id long, x double, stars double")
    want = recommend.fit_folds(data, ["x"], ["id"], folds=3, rounds=2, depth=2)
    meet, fitted = threading.Barrier(3, timeout=60), recommend._fitted
    monkeypatch.setattr(recommend, "_fitted", lambda *args: meet.wait() < 3 and fitted(*args))
    models = recommend.fit_folds(data, ["x"], ["id"], folds=3, rounds=2, depth=2)
    assert [m.stages[-1].toDebugString.split("\n", 1)[1] for m in models] == [m.stages[-1].toDebugString.split("\n", 1)[1] for m in want]


def random_graph(seed, n=14, p=0.2):
    rng = random.Random(seed)
    return [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]


def brute_betweenness(edges):
    """By listing all shortest paths."""
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    total, distances = Counter(), 0
    for s, t in itertools.combinations(sorted(near), 2):
        paths = [[s]]
        while paths and not any(p[-1] == t for p in paths):
            paths = [p + [w] for p in paths for w in near[p[-1]] if w not in p]
            ends = {p[-1] for p in paths}
            short = {e: min(len(p) for p in paths if p[-1] == e) for e in ends}
            paths = [p for p in paths if len(p) == short[p[-1]]][:200_000]
        hits = [p for p in paths if p[-1] == t]
        for p in hits:
            for a, b in zip(p, p[1:]):
                total[min(a, b), max(a, b)] += 1 / len(hits)
        distances += len(hits[0]) - 1 if hits else 0
    return total, distances


def test_betweenness_components_labels(spark):
    edges = random_graph(3) + [(20, 21), (21, 22)]
    df = spark.createDataFrame(edges, "u long, v long")
    want, distances = brute_betweenness(edges)
    got = {(r["u"], r["v"]): r["betweenness"] for r in graph.edge_betweenness(df, roots=3).collect()}
    assert got == pytest.approx(dict(want)) and sum(got.values()) == pytest.approx(distances)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    labels = {r["id"]: r["component"] for r in graph.components(df).collect()}
    assert labels == {v: part[0] for part in graph._split(near) for v in part}
    votes = {v: v for v in near}
    for _ in range(5):
        votes = {v: min(Counter(votes[w] for w in near[v]).items(), key=lambda x: (-x[1], x[0]))[0] for v in near}
    assert {r["id"]: r["label"] for r in graph.label_propagation(df).collect()} == votes
    assert graph.degrees(df).filter("id = 21").first()["degree"] == 2


def test_modularity_and_splits(spark):
    two = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]
    assert graph.split_by_betweenness(two) == [[0, 1, 2], [3, 4, 5]]
    df = spark.createDataFrame(two, "u long, v long")
    lines = [r[0] for r in io.community_lines(graph.girvan_newman(df).select(F.col("members").cast("array<string>"))).collect()]
    assert lines == ["'0', '1', '2'", "'3', '4', '5'"]
    assert graph.split_by_betweenness([]) == []
    degree = Counter(x for e in two for x in e)
    alone = graph.modularity([[v] for v in degree], {v: [] for v in degree}, degree, 7)
    assert alone == pytest.approx(-sum(k * k for k in degree.values()) / (4 * 49))
    shown = [r[0] for r in io.betweenness_lines(graph.edge_betweenness(df).select(F.col("u").cast("string"), F.col("v").cast("string"), "betweenness")).collect()]
    assert shown[0] == "('2', '3'),9.0"


def test_co_occurrence(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.randrange(9)) for _ in range(150)]
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    busy = {u for u, n in Counter(u for u, _ in rows).items() if n >= 5}
    items = {u: {i for v, i in rows if v == u} for u in busy}
    want = {(a, b): len(items[a] & items[b]) for a, b in itertools.combinations(sorted(busy), 2) if len(items[a] & items[b]) >= 5}
    assert {(r["u"], r["v"]): r["common"] for r in graph.co_occurrence_edges(df, 5).collect()} == want


@pytest.mark.parametrize("block", [512, 3])
def test_overlaps_are_counted_where_they_arrive(spark, monkeypatch, block):
    """Several tasks, keys beyond an int, null and repeated rows; short lists send every key once and shuffle no pair."""
    monkeypatch.setattr(similarity, "PAIRS", 40, raising=False)
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(8)
    for shift in (0, 1 << 40):
        sets = {shift - 20 + k: set(rng.sample(range(25), rng.randint(1, 12))) for k in range(40)}
        rows = [(k, x) for k, xs in sets.items() for x in xs] * 2 + [(None, 1), (shift, None)]
        df = spark.createDataFrame(rows, "key long, item long")
        found = similarity.overlapping_pairs(df, 4)
        want = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 4}
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
        assert dict(found.dtypes) == {"a": "bigint", "b": "bigint", "common": "bigint"}
        if block == 512:
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert plan.count("Exchange") == 1 and "Join" not in plan
    assert similarity.overlapping_pairs(df.limit(0), 4).count() == 0


def test_bloom_equals_a_sequential_filter(spark):
    rng = random.Random(7)
    hashes = hashing.family(3, 211, 1)
    rows = [(s, s // 20, rng.randrange(400)) for s in range(300)]
    bits, seen, want = set(), set(), {}
    for s, b, x in rows:
        places = {((x % h.p * h.a + h.b) % h.p) % h.m for h in hashes}
        want[s] = (x in seen, places <= bits)
        seen.add(x)
        bits |= places
    out = sketches.bloom_outcomes(spark.createDataFrame(rows, "seq long, batch_id long, id long"), hashes).collect()
    assert {r["seq"]: (r["seen"], r["positive"]) for r in out} == want
    assert all(r["positive"] for r in out if r["seen"])  # no false negatives
    again = spark.createDataFrame([(0, 0, 1), (1, 1, 1)], "seq long, batch_id long, id long")
    assert {r["batch_id"]: r["fpr"] for r in sketches.bloom_rates(again, hashes).collect()} == {0: 0.0, 1: None}


def test_estimate_and_sample(spark):
    stream = spark.range(300).select(F.col("id").alias("seq"), F.lit(0).cast("long").alias("batch_id"), (F.col("id") * 7919 + 13).alias("id"))
    hashes = sketches.fm_family()
    r = sketches.distinct_estimate(stream, hashes).first()
    assert 150 < r["estimate"] < 500
    zeros = [max(max(len(b) - len(b.rstrip("0")) for b in [f"{((x % h.p * h.a + h.b) % h.p) % h.m:b}"]) for x in range(13, 300 * 7919, 7919)) for h in hashes]
    means = sorted(np.mean([2**z for z in zeros[g * 50 : (g + 1) * 50]]) for g in range(4))
    assert r["estimate"] == int((means[1] + means[2]) / 2)
    assert sketches.uniform_sample(stream, 100).count() == 100 and sketches.uniform_sample(stream.limit(7), 100).count() == 7


def test_clusters(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 30, (3, 4))
    points = [(i, i % 3, (centres[i % 3] + rng.normal(0, 1, 4)).tolist()) for i in range(600)] + [(600, 0, [500.0] * 4), (601, 0, [-700.0] * 4)]
    df = spark.createDataFrame(points, "index long, label long, features array<double>")
    stats = clustering.summaries(df, "label")
    x = np.array([p[2] for p in points if p[1] == 1])
    assert np.allclose(stats[1].total, x.sum(axis=0)) and np.allclose(stats[1].squares, (x**2).sum(axis=0))
    assert clustering.mahalanobis(stats[1].centre, stats[1])[0] == pytest.approx(0)
    rounds, out = clustering.bfr(df, 3)
    table = rounds.orderBy("round").collect()
    assert len(table) == 5 and table[-1]["n_discard"] + table[-1]["n_compression_points"] + table[-1]["n_retained"] == 602
    labels = {r["index"]: r["cluster"] for r in out.collect()}
    assert len(labels) == 602 and labels[600] == labels[601] == -1
    same = Counter((labels[i] == labels[j]) == (i % 3 == j % 3) for i, j in itertools.combinations(range(0, 600, 7), 2))
    assert same[True] > 0.8 * sum(same.values())
    assert clustering.kmeans(df.limit(2), 5).count() == 2
    assert clustering.bfr(df.limit(0), 3)[1].count() == 0


def test_flat_clusters_divide_by_no_zero():
    s = clustering.Summary(3, np.array([6.0]), np.array([12.0 - 1e-12]))
    assert math.isfinite(clustering.mahalanobis(np.array([5.0]), s)[0])
    left, gone = clustering.merge_near({0: s, 1: clustering.Summary(3, np.array([6.0]), np.array([12.1])), 2: clustering.Summary(1, np.array([99.0]), np.array([9801.0]))}, 2.0)
    assert sorted(left) == [1, 2] and gone == {0: 1} and left[1].n == 6


@pytest.mark.parametrize("least", [0.3, 0.5, 0.55, 0.56, 0.8, 1.0])
def test_similar_pairs_in_whole_numbers(spark, monkeypatch, least):
    """Thresholds that doubles round up, items of many keys in blocks, equal sets, and 14 items inside 25."""
    monkeypatch.setattr(similarity, "BLOCK", 5)
    rng = random.Random(9)
    sets = {i: set(rng.sample(range(30), rng.randint(1, 20))) for i in range(60)} | {100: set(range(14)), 101: set(range(25)), 102: set(range(14))}
    df = spark.createDataFrame([(k, f"w{x}") for k, xs in sets.items() for x in xs] + [(100, "w0"), (None, "w0"), (103, None)], "key long, item string")
    share = lambda a, b: Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b]))
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if share(a, b) >= Fraction(str(least))}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df, least).collect()} == want
    assert least > 0.56 or (100, 101) in want
    want = {(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 6}
    assert {tuple(r) for r in similarity.overlapping_pairs(df, 6).collect()} == want
    assert similarity.similar_pairs(df.limit(0), least).count() == 0


def test_similar_pairs_in_blocks_and_turns(spark, monkeypatch):
    """Lists of postings are dealt to blocks, and candidates are verified a few at a time."""
    rng = random.Random(12)
    sets = {k: {rng.randrange(14) for _ in range(6)} for k in range(40)}
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s] * 2, "key long, item long")
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    monkeypatch.setattr(similarity, "POSTS", 5)
    monkeypatch.setattr(similarity, "CANDIDATES", 10)
    verified, asked = similarity._verified, []
    monkeypatch.setattr(similarity, "_verified", lambda c, w: asked.append(c.count()) or verified(c, w))
    found = similarity.similar_pairs(df).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)
    assert len(asked) > 1


def test_co_ratings_of_asked_items(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(12), rng.randrange(9), float(rng.randint(1, 5)), n) for n in range(90)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, stars double, seq long")
    tidy = lambda df: {tuple(round(x, 9) for x in r) for r in df.collect()}
    every = tidy(recommend.co_ratings(ratings))
    some = spark.createDataFrame([(2,), (5,), (5,), (77,)], "item_id long")
    assert tidy(recommend.co_ratings(ratings, some)) == {r for r in every if {r[0], r[1]} & {2, 5}}


def test_pearson_sums_where_ratings_arrive(spark, monkeypatch):
    """Negative and large items, many values of stars (paired as they are) and few (summed before they are centred)."""
    monkeypatch.setattr(recommend, "PAIRS", 30, raising=False)
    monkeypatch.setattr(recommend, "TURN", 200, raising=False)
    rng = random.Random(12)
    for values, shift in ((range(1, 6), 0), (range(1, 6), 1 << 40), (range(100), 0)):
        rows = [(rng.randrange(15), rng.randrange(-3, 9) + shift, float(rng.choice(values)), n) for n in range(150)]
        rows += [(None, 1, 5.0, 200), (1, None, 5.0, 201)]
        ratings = spark.createDataFrame(rows, "user_id long, item_id long, stars double, seq long")
        every = recommend.co_ratings(ratings).filter("i < j AND n >= 2")
        want = {(r["i"], r["j"], r["n"]): 0.0 if abs(r["num"]) < 5e-10 else r["num"] / math.sqrt(r["si"] * r["sj"]) for r in every.collect()}
        found = recommend.pearson_pairs(ratings)
        got = {(r["i"], r["j"], r["n"]): r["weight"] for r in found.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-9) for k in want)
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        if len(values) == 5 and not shift:
            assert "weights1" in plan and "Join" not in plan  # several turns


def test_itemsets_of_more_levels_than_most(spark):
    rows = [(b, f"i{x:02}") for b in range(3) for x in range(9)]
    found = itemsets.frequent_itemsets(spark.createDataFrame(rows, "basket long, item string"), 3)
    assert found.count() == 2**9 - 1 and found.filter(F.size("items") == 9).count() == 1


def test_ensemble_options_and_fold_errors(spark):
    rng = random.Random(4)
    rows = [(i, float(x := rng.random()), float(y := rng.random()), 3 * x - y + rng.gauss(0, 0.05)) for i in range(240)]
    train = spark.createDataFrame(rows, "id long, a double, b double, stars double").cache()
    trees = recommend.boosted(["a", "b"], **recommend.ENSEMBLE).getStages()[-1]
    assert (trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize(), trees.getSubsamplingRate(), trees.getFeatureSubsetStrategy()) == (512, 7, 0.05, 0.8, str(0.9 * 0.8))
    models = recommend.fit_folds(train, ["a", "b"], ["id"], folds=3, **recommend.ENSEMBLE | {"rounds": 6, "depth": 3, "rate": 0.3})
    out = recommend.fold_errors(models, train, ["id"]).collect()
    assert [r["fold"] for r in out] == [0, 1, 2] and all(0 < r["train_rmse"] < 1.2 and 0 < r["eval_rmse"] < 1.2 for r in out)


def test_broadcasts_are_checked_and_folders_shared(spark, monkeypatch):
    from lodestone.plans import workspace

    wide = spark.createDataFrame([(i, "x" * 1000, [1] * 50) for i in range(20)], "a long, b string, c array<int>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(workspace.size_checked(wide)) and not hinted(workspace.size_checked(wide, limit=19)) and not hinted(workspace.size_checked(wide, most_bytes=10_000))
    assert hinted(workspace.size_checked(wide.limit(0)))

    class Cluster:
        class sparkContext:
            master, environment = "spark://host:7077", {}

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        workspace.Workspace(Cluster, "x")


def _banded(spark, sets, hashes, key="long"):
    """What similar_pairs_lsh is to find: pairs with an equal band, by lsh_pairs, that are similar enough."""
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], f"key {key}, item long")
    met = {(r["a"], r["b"]) for r in similarity.lsh_pairs(similarity.signatures(df, hashes)).collect()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in met}
    return df, len(met), {(*ab, s) for ab, s in like.items() if s >= 0.5}


@pytest.mark.parametrize("key,limits", [("long", {}), ("string", {}), ("long", {"POSTS": 4, "HELD": 5, "STEP": 7, "HASHED": 40, "CANDIDATES": 100})])
def test_banded_pairs_with_copies_and_hot_bands(spark, monkeypatch, key, limits):
    """Every banded pair that is similar, with its similarity, whatever is dealt or cut; of unlike sets
    that share a band hardly any become candidates."""
    for name, value in limits.items():
        monkeypatch.setattr(similarity, name, value)
    rng, sets = random.Random(5), {}
    for i in range(40):
        base = {rng.randrange(-(1 << 59), 1 << 59) for _ in range(rng.choice((1, 5, 30, 300)))} | ({7} if i % 2 else set())
        for j in range(4):
            sets[4 * i + j] = base if j < 2 else {x for x in base if rng.random() > 0.15} | {rng.randrange(1 << 59)}
    if key == "string":
        sets = {f"k{k}": s for k, s in sets.items()}
    hashes, asked = similarity.minhash_family(101), []
    df, met, want = _banded(spark, sets, hashes, key)
    verified = similarity._verified_in_turns
    monkeypatch.setattr(similarity, "_verified_in_turns", lambda candidates, *rest: asked.append(candidates.count()) or verified(candidates, *rest))
    found = [tuple(r) for r in similarity.similar_pairs_lsh(df, hashes).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) >= 150
    assert met > 5 * asked[0]


def test_banded_pairs_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, 5), (3, 5), (4, 5), (4, None)], "key long, item long")
    hashes = similarity.minhash_family(1009)
    assert [tuple(r) for r in similarity.similar_pairs_lsh(df, hashes).collect()] == [(3, 4, 1.0)]
    assert similarity.similar_pairs_lsh(df.filter("key = 1"), hashes).collect() == []


def test_similar_pairs_meet_as_parities_in_turns(spark, monkeypatch):
    """Copies are compared once, postings are dealt in turns, and pairs that sizes, places or parities rule out never become candidates."""
    monkeypatch.setattr(similarity, "TURN_POSTS", 150, raising=False)
    rng = random.Random(5)
    base = {k: set(rng.sample(range(60), rng.randint(3, 25))) for k in range(40)}
    sets = base | {100 + k: {*list(s)[1:], 99} for k, s in base.items()} | {200 + k: s for k, s in base.items() if k < 20}
    df = spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "key long, item long")
    asked, verified = [], similarity._verified_in_turns
    monkeypatch.setattr(similarity, "_verified_in_turns", lambda c, w: asked.append(c.count()) or verified(c, w))
    share = lambda a, b: Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b]))
    for least in (0.5, 0.8):
        want = {(a, b): float(share(a, b)) for a, b in itertools.combinations(sorted(sets), 2) if share(a, b) >= Fraction(str(least))}
        found = similarity.similar_pairs(df, least).collect()
        assert {(r["a"], r["b"]): r["similarity"] for r in found} == want and len(found) == len(want)
        assert asked.pop() < len(want)
