import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestone.llm import packing, queries

PATH = queries.tokenizer_path()


def check_sequences(rows, capacity):
    """Gapless sequences within capacity; returns how many."""
    by = {}
    for size, seq, at in rows:
        by.setdefault(seq, []).append((at, size))
    for spots in by.values():
        spots.sort()
        end = 0
        for at, size in spots:
            assert at == end
            end += size
        assert end <= capacity
    return len(by)


@pytest.mark.parametrize("cell_items,fan_in", [(50, 3), (16384, 32)])
def test_pack_places_every_item_once(spark, cell_items, fan_in):
    rng = random.Random(3)
    sizes = [rng.choice([rng.randint(1, 1024), 600, 1024, 1]) for _ in range(2000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    rows = packing.pack(items, cell_items=cell_items, fan_in=fan_in).collect()
    assert sorted(r["item"] for r in rows) == list(range(2000))
    used = check_sequences([(sizes[r["item"]], r["sequence_id"], r["offset"]) for r in rows], 1024)
    assert used <= len(packing.best_fit(sizes, 1024)[2]) * (1.1 if cell_items == 50 else 1.0) + 1


def test_best_fit_against_a_plain_version():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        fills = []
        for s in sorted(sizes, reverse=True):
            fitting = [i for i, f in enumerate(fills) if f + s <= 40]
            if fitting:
                fills[max(fitting, key=lambda i: fills[i])] += s
            else:
                fills.append(s)
        assert sorted(packing.best_fit(sizes, 40)[2]) == sorted(fills)


def test_a_cell_passes_on_few_bins():
    fills = [600] * 1000 + [100] + [1020] * 5
    assert packing.passed_on(fills, 1024, 8) == {*range(8), 1000}


def test_encoder_equals_tokenizers():
    exact = Tokenizer.from_file(PATH)
    rng = random.Random(9)
    alphabet = [chr(c) for c in [*range(1, 0x250), 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x0301, 0xFEFF]]
    texts = ["", " ", "it's  a\n\n test x", "a" * 5000, " " * 900 + "b", "<|endoftext|> x", "l'été ça déjà 123abc !!  \t x"]
    texts += ["".join(rng.choice(alphabet) if rng.random() < 0.5 else rng.choice(" etaoin'\n") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    model = packing.encoder(PATH)
    assert model.fast is not None
    for t in texts:
        assert model.ids(t) == exact.encode(t, add_special_tokens=False).ids, repr(t)


def test_query_round_trip(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "short text", "word " * 3000, "x\n" * 511 + "x"] + [" ".join(rng.choice(["lorem", "ipsum", "été", "42"]) for _ in range(rng.randint(0, 900))) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "no id")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op3_best_fit_packing(spark, str(tmp_path)).collect()
    check_sequences([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 1024)
    exact = Tokenizer.from_file(PATH)
    want = []
    for k, t in docs:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = [(0, len(ids))] if len(ids) <= 1024 else packing.cut(len(ids), 1024)
        assert sum(n for _, n in pieces) == len(ids) and all(n == 1024 for _, n in pieces[1:])
        want += [(k, i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(pieces)]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    total = sum(w[3] for w in want)
    assert len({r["sequence_id"] for r in rows}) <= total / 1024 * 1.1 + 1


def test_empty_and_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PATH).count() == 0
    one = spark.createDataFrame([(1, "hello", 5)], "doc_id long, text string, length int")
    r = packing.pack_documents(one, PATH, keep_ids=True).collect()
    assert len(r) == 1 and r[0]["ids"][-1] == 2 and r[0]["length"] == len(r[0]["ids"])
