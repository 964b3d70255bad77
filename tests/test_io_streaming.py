"""Sources, sinks and stateful streams."""

import random

from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.sources import io
from lodestone.streaming import sketches


def test_readers(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"business_id": "x", "city": "", "stars": 4.0, "attributes": {"a": "1", "b": "{}"}, "more": 1}\n{"business_id": "y", "attributes": null}\n')
    rows = io.read_json(spark, f"{tmp_path}/b.json", io.BUSINESS).orderBy("business_id").collect()
    assert rows[0]["attributes"] == {"a": "1", "b": "{}"} and rows[1]["attributes"] is None
    for name in "pq":
        (tmp_path / f"{name}.csv").write_text('user_id,business_id,stars\n"u,1",b1,3.0\nu2,b2,\n')
    rows = io.read_csv(spark, f"{tmp_path}/*.csv", io.RATING).collect()
    assert len(rows) == 4 and {r["user_id"] for r in rows} == {"u,1", "u2"}
    (tmp_path / "r").mkdir()
    (tmp_path / "r/t.csv").write_text('"DATE","CUSTOMER_ID","A","B","C","PRODUCT_ID"\n"1/2/01","0007","x","y","z","0042"\n')
    r = io.read_retail(spark, f"{tmp_path}/r").first()
    assert (r["date"], r["customer_id"], r["product_id"]) == ("1/2/01", 7, 42)
    (tmp_path / "points.txt").write_text("0,3,1.5,2.5\n1,4,-1,0\n")
    assert [tuple(r) for r in io.read_points(spark, f"{tmp_path}/points.txt").collect()] == [(0, 3, [1.5, 2.5]), (1, 4, [-1.0, 0.0])]


def test_random_lines(spark):
    lines = spark.createDataFrame([(f"u{i:03d}",) for i in range(50)], "value string")
    out = io.random_lines(lines, 1000, 3).collect()
    assert len(out) == 1000 and len({r["value"] for r in out}) == 50
    assert out and io.random_lines(lines, 10, 3).orderBy("seq").collect() == sorted(io.random_lines(lines, 10, 3).collect())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    io.write_csv(df, f"{tmp_path}/c")
    assert io.read_csv(spark, f"{tmp_path}/c", "n int, s string").count() == 2
    io.write_json(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    io.write_lines(df.select(F.col("s").alias("value")), f"{tmp_path}/l")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/l").collect()) == ["a", "b"]
    assert io.report_json(df.limit(1)) == '{"n":1,"s":"a"}'
    sink = io.append_batch(f"{tmp_path}/a")
    sink(df, 0)
    sink(df, 1)
    sink(df, 1)
    assert spark.read.csv(f"{tmp_path}/a", header=True).count() == 4
    rounds = spark.createDataFrame([(2, 5, 1, 2, 3), (1, 4, 0, 0, 1)], "round int, n_discard long, n_compression_clusters long, n_compression_points long, n_retained long")
    lines = [r[0] for r in io.cluster_report(rounds, spark.createDataFrame([(1, -1), (0, 2)], "index long, cluster long")).collect()]
    assert lines == ["The intermediate results:", "Round 1:, 4, 0, 0, 1", "Round 2:, 5, 1, 2, 3", "", "The clustering results:", "0, 2", "1, -1"]
    assert io.empty(spark, "n int").count() == 0 and io.from_rows(spark, [(1,)], "n int").count() == 1


def run(spark, tmp_path, rows, build, name):
    """Feed rows as one file a batch through a streaming query; its output."""
    schema = "stream_id long, seq long, id long"
    folder = tmp_path / name
    for b, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{b:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    query = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}_at").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


def test_stateful_bloom(spark, tmp_path):
    rng = random.Random(2)
    hashes = hashing.family(3, 101, 4)
    rows = [[(1, b * 20 + i, rng.randrange(90)) for i in range(20)] for b in range(4)]
    out = sorted(run(spark, tmp_path, rows, lambda s: sketches.bloom_rates(s, hashes), "bloom"), key=lambda r: r["last_seq"])
    bits, seen, want = set(), set(), []
    for part in rows:
        fresh = wrong = 0
        for _, _, x in part:
            places = {((x % h.p * h.a + h.b) % h.p) % h.m for h in hashes}
            if x not in seen:
                fresh, wrong = fresh + 1, wrong + (places <= bits)
            seen.add(x)
            bits |= places
        want.append((fresh, wrong))
    assert [(r["fresh"], r["false_positives"]) for r in out] == want


def test_stateful_sample(spark, tmp_path):
    rows = [[(1, b * 30 + i, b * 30 + i) for i in range(30)] for b in range(4)]
    out = sorted(run(spark, tmp_path, rows, lambda s: sketches.samples(s, size=20, every=1), "sample"), key=lambda r: r["seqnum"])
    assert [r["seqnum"] for r in out] == [30, 60, 90, 120]
    assert all(len(r["slots"]) == 20 == len(set(r["slots"])) and max(r["slots"]) < r["seqnum"] for r in out)
    assert out[0]["slots"] != out[-1]["slots"]


def test_windowed_estimate_is_a_stream(spark, tmp_path):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id"))
    out = sketches.windowed_estimate(df, hashing.family(8, 600, 1), groups=4)
    assert out.count() == 1 and out.first()["estimate"] >= 1
