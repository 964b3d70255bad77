import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from lodestone.llm.queries import tokenizer_path
from tests.llm.test_neardup import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "secret_scan", "source_mixing", "best_fit_packing"]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    docs = docs.withColumn("comp", F.lit("extra")).withColumn("score", F.lit(1))
    extra = [(9001, None, "en", "src0", 0), (9002, "", None, None, 0), (9003, "12 34 !!", "en", "src1", 8), (9004, "the user=bob of the password=abcdefgh12 and the thing", None, "src1", 9)]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long").withColumn("comp", F.lit("x")).withColumn("score", F.lit(2))
    docs = docs.unionByName(more).unionByName(docs.limit(3))
    docs.write.parquet(f"{tmp_path}/0")
    docs = spark.read.parquet(f"{tmp_path}/0")
    kept = [docs]
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, kept[-1], FOLDER)
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{i + 1}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i + 1}"))
    before, spoken, unique, masked, mixed, packed = [k.collect() for k in kept]

    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in spoken} == {9001, 9002, 9003}
    want = {least for _, size, least in brute([(r["doc_id"], r["text"]) for r in spoken], 5)}
    assert sorted(r["doc_id"] for r in unique) == sorted(want)
    texts = {r["doc_id"]: r["text"] for r in unique}
    assert {r["doc_id"] for r in masked} == set(texts)
    by_id = {r["doc_id"]: r for r in masked}
    assert by_id[9004]["text"] == "the [SECRET] of the [SECRET] and the thing" and by_id[9004]["n_chars"] == len(by_id[9004]["text"])
    assert all(by_id[k]["text"] == t for k, t in texts.items() if not any(x in t.lower() for x in ("password", "token", "secret", "akia", "://", "user")))
    assert {r["doc_id"] for r in mixed} <= set(by_id) and all(r["text"] == by_id[r["doc_id"]]["text"] for r in mixed)
    exact = Tokenizer.from_file(tokenizer_path())
    pieces = []
    for r in mixed:
        ids = np.array([*exact.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024
        cuts = ([(0, first)] if first else []) + [(a, 1024) for a in range(first, len(ids), 1024)]
        pieces += [(r["doc_id"], j, a, n, zlib.crc32(ids[a : a + n].tobytes())) for j, (a, n) in enumerate(cuts)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(pieces)


def test_run_and_empty_table(spark, tmp_path):
    out = cp.run(spark, FOLDER)
    assert out.count() > 100
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = cp.identify_language(spark, docs, "")
    assert kept.count() >= 0.99 * docs.count()


def test_unlearned_languages_go_and_mixtures_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    parts = [r["t"] for r in docs.filter("length(text) > 2000").groupBy("lang").agg(F.min(F.substring("text", 1, 400)).alias("t")).orderBy("lang").collect()]
    assert len(parts) == 4
    rng = np.random.default_rng(3)
    gibberish = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10))) for _ in range(60))
    planted = {
        -1: "Il governo italiano ha annunciato ieri che la nuova legge sulla scuola sar\u00e0 discussa dal parlamento nelle prossime settimane",
        -2: "De regering heeft gisteren aangekondigd dat het nieuwe beleid voor het onderwijs in de komende weken wordt besproken met leraren",
        -3: "Hallitus ilmoitti eilen ett\u00e4 uusi koululaki k\u00e4sitell\u00e4\u00e4n eduskunnassa l\u00e4hiviikkoina",
        -4: "Rz\u0105d og\u0142osi\u0142 wczoraj \u017ce nowa ustawa o szko\u0142ach b\u0119dzie omawiana w parlamencie",
        -5: gibberish,
        -6: " ".join("".join(rng.permutation(list(w))) for w in parts[1].lower().split()),
        -7: " ".join(parts),
        -8: " ".join(parts[:2]),
    }
    more = spark.createDataFrame([(k, t, None) for k, t in planted.items()], docs.schema)
    kept = {r["doc_id"] for r in cp.identify_language(spark, docs.unionByName(more), "").collect()}
    assert {k for k in planted if k in kept} == {-7, -8}


def test_heaps_are_given_back_between_stages(spark, monkeypatch):
    """The stages after those that fill the heaps begin by collecting garbage in the executors."""
    from lodestone.plans import workspace

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collections = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = collections()
    workspace.rest_executors(spark)  # a local session's executor is this JVM
    assert collections() > before
    rested = []
    monkeypatch.setattr(workspace, "rest_executors", rested.append)
    docs = spark.createDataFrame([(1, "some words of a text that is long enough to have five words")], "doc_id long, text string")
    cp.drop_near_duplicates(spark, docs, "")
    cp.mask_secrets(spark, docs, "")
    assert rested == [spark, spark]
