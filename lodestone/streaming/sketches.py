"""Stateful sketches over an unbounded stream (stream_id, seq, id), a state per stream_id.

Rows of a micro-batch are taken in the order of seq; a batch's rows must not come before those of an earlier one.
"""

from __future__ import annotations

import hashlib
import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import Hash, trailing_zeros

_STATE = "state binary"


def _in_order(batches) -> pd.DataFrame:
    frames = list(batches)
    return pd.concat(frames).sort_values("seq") if frames else pd.DataFrame({"seq": [], "id": []})


def bloom_rates(stream: DataFrame, hashes: list[Hash]) -> DataFrame:
    """stream_id, last_seq, fresh, false_positives, fpr of every micro-batch; the filter and the exact set of ids live on."""

    def step(key, batches, state):
        bits, seen = pickle.loads(state.get[0]) if state.exists else (bytearray(hashes[0].m), set())
        rows = _in_order(batches)
        fresh = wrong = 0
        for x in rows["id"]:
            places = [((x % h.p * h.a + h.b) % h.p) % h.m for h in hashes]
            if x not in seen:
                fresh += 1
                wrong += all(bits[p] for p in places)
                seen.add(x)
            for p in places:
                bits[p] = 1
        state.update((pickle.dumps((bits, seen)),))
        yield pd.DataFrame({"stream_id": [key[0]], "last_seq": [int(rows["seq"].max())], "fresh": [fresh], "false_positives": [wrong], "fpr": [wrong / fresh if fresh else None]})

    return stream.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, last_seq long, fresh long, false_positives long, fpr double", _STATE, "append", "NoTimeout")


def samples(stream: DataFrame, size: int = 100, every: int = 20, seed: int = 553) -> DataFrame:
    """stream_id, seqnum, slots of every micro-batch: a fixed-size uniform sample; the n-th row is taken with probability
    size / n and replaces a random slot. Choices come from a hash of seed and row number, so a retry repeats them."""

    def step(key, batches, state):
        n, slots = pickle.loads(state.get[0]) if state.exists else (0, [])
        for x in _in_order(batches)["id"]:
            n += 1
            if len(slots) < size:
                slots.append(int(x))
                continue
            draw = int.from_bytes(hashlib.md5(f"{seed}:{key[0]}:{n}".encode()).digest()[:8], "big") % n
            if draw < size:
                slots[draw] = int(x)
        state.update((pickle.dumps((n, slots)),))
        yield pd.DataFrame({"stream_id": [key[0]], "seqnum": [n], "slots": [slots[::every]]})

    return stream.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, seqnum long, slots array<long>", _STATE, "append", "NoTimeout")


def windowed_estimate(stream: DataFrame, hashes: list[Hash], groups: int = 4, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, estimate: the distinct estimate per event-time window, closed by a watermark."""
    zeros = stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(*[F.max(trailing_zeros(h.of(F.col("id")))).alias(f"z{i}") for i, h in enumerate(hashes)])
    size = len(hashes) // groups
    ranked = F.sort_array(F.array(*[sum(F.pow(F.lit(2.0), F.col(f"z{i}")) for i in range(g * size, (g + 1) * size)) / size for g in range(groups)]))
    return zeros.select("window", F.floor((F.element_at(ranked, (groups + 1) // 2) + F.element_at(ranked, groups // 2 + 1)) / 2).cast("long").alias("estimate"))
