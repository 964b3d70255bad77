import math
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import mixing, queries
from lodestone.llm.shared import hash_fraction
from tests.llm.oracle import same


def test_copies_against_sql(spark, tmp_path):
    rows = [(i, f"text {i}", "big" if i % 3 else f"s{i % 50}") for i in range(900)]
    rows += [(None, "no id", "big"), (5, "text 5", "big"), (5, "text 5", "big"), (1000, None, None), (1001, "", "rare")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = same(spark, queries.op4_poisson_mixing, queries.ORACLE_SQL["op4_poisson_mixing"], tmp_path)
    assert 700 < len(got) < 1200


def test_counts_invert_the_distribution(spark):
    for mean in (0.0, 0.3, 4.0, 16.0):
        out = spark.range(4000).select(mixing.poisson(F.lit(mean), F.col("id")).alias("k"), hash_fraction(F.col("id"), mixing.SEED).alias("u")).collect()
        for r in out[:300]:
            cdf, term, k = math.exp(-mean), math.exp(-mean), 0
            while cdf <= r["u"]:
                k += 1
                term *= mean / k
                cdf += term
            assert r["k"] == k
        assert abs(sum(r["k"] for r in out) / 4000 - mean) < 0.2


def test_large_means(spark):
    out = [r[0] for r in spark.range(2000).select(mixing.poisson(F.lit(900.0), F.col("id"))).collect()]
    m = sum(out) / 2000
    assert abs(m - 900) < 4 and abs(sum((x - m) ** 2 for x in out) / 2000 - 900) < 120


def test_weights_clashing_columns_and_empty(spark):
    docs = spark.createDataFrame([(i, "a" if i < 3000 else "b", i, "x") for i in range(4000)], "doc_id long, source string, copy int, _copies string")
    out = mixing.mix(docs, mixing.rates_by_weights(docs, {"a": 1.0, "b": 1.0}))
    assert out.columns == docs.columns
    shares = Counter(r["source"] for r in out.collect())
    assert abs(shares["a"] - shares["b"]) < 350
    assert "copies" in mixing.mix(docs, details=True).columns
    assert mixing.mix(docs.limit(0)).count() == 0
    only = mixing.mix(docs, mixing.rates_by_weights(docs, {"b": 2.0}))
    assert {r["source"] for r in only.collect()} == {"b"}


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(i, "s", "x" * 2_000_000 + str(i)) for i in range(4)], "doc_id long, source string, text string")
    out = mixing.mix(docs, mixing.rates_by_weights(docs, {"s": 1.0}, size=3.0)).collect()
    assert out and all(r["text"] == "x" * 2_000_000 + str(r["doc_id"]) for r in out)
