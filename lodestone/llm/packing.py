"""Best-fit packing of token sequences: hierarchical residual packing.

Items (pieces of at most `capacity` tokens) are dealt into cells of about `cell_items`; each cell is packed by itself
with best fit, longest item first. A bin that is nearly full is final. Of the others a cell passes on those that later
rounds can use: as best fit leaves at most one bin that is half empty, and an item of over half a bin never joins
another such, a cell's more than half full bins can only receive the half empty ones of its `fan_in - 1` sisters. So at
most `fan_in` of them (the emptiest) and one half empty bin go up, the rest is final. These bins are the items of the
next round, in which `fan_in` cells are packed together, and so on up the tree to one cell. A cell therefore never holds
more than max(cell_items, (fan_in + 1) * fan_in) items or so, however many there are.

Defined results: null text is an empty document (only its end token). Repeated rows and repeated or null ids are packed
one by one. Zero items make zero bins. Lengths must lie between 1 and capacity; full items are bins of their own.
Items of one length are taken in the order of their key's hash and number; bins with equally little room in the order
in which they were opened. Texts of any length are encoded whole and cut into pieces only where they exceed a sequence.
Extra columns are not carried, whatever their names; join them by the item's key.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Workspace

CAPACITY, END_ID = 1024, 2
CELL_ITEMS, FAN_IN = 16384, 32
#: A bin with at most this share of its room left is nearly full.
NEARLY_FULL = 1 / 128

#: Fixed value: how byte-level BPE of this family splits a text into words.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The fast encoder takes texts of old, settled characters (Latin) without very long words; others go to tokenizers.
_SLOW = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]|\S{300}|\s{300}")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit, longest first: each item's bin and offset, and the bins' fills.

    Open bins are stacks by room left; a bit mask of the non-empty stacks finds the tightest one that fits.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, capacity - room
        fills[b] = capacity - room + size
        if room > size:
            stacks[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets, fills


def passed_on(fills: list[int], capacity: int, fan_in: int) -> set[int]:
    """The bins that go up to the next round."""
    loose = [b for b, f in enumerate(fills) if capacity - f > capacity * NEARLY_FULL]
    half = [b for b in loose if 2 * fills[b] <= capacity]
    return set(half) | set(sorted((b for b in loose if 2 * fills[b] > capacity), key=lambda b: (fills[b], b))[:fan_in])


def _bin_id(level: int, cell: int, number: int) -> int:
    return level << 58 | cell << 28 | number


def _round(level: int, capacity: int, fan_in: int):
    def pack(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "item"], ascending=False)  # one result however rows arrive
        bins, offsets, fills = best_fit(items["size"].tolist(), capacity)
        up = passed_on(fills, capacity, fan_in)
        cell = int(key[0])
        return pd.DataFrame(
            {
                "item": items["item"].to_numpy(),
                "bin": [_bin_id(level, cell, b) for b in bins],
                "offset": np.array(offsets, dtype="int64"),
                "fill": np.array([fills[b] for b in bins], dtype="int64"),
                "open": [b in up for b in bins],
                "cell": np.full(len(items), cell, dtype="int64"),
            }
        )

    return pack


_PACKED = "item long, bin long, offset long, fill long, open boolean, cell long"


def pack(items: DataFrame, capacity: int = CAPACITY, cell_items: int = CELL_ITEMS, fan_in: int = FAN_IN, work: Workspace | None = None) -> DataFrame:
    """item (a unique long), size -> item, sequence_id, offset. Sizes lie between 1 and capacity."""
    work = work or Workspace(items.sparkSession, "packing")
    whole = items.filter(F.col("size") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("size") < capacity)
    cells = max(1, -(-rest.count() // cell_items))
    dealt = rest.select("item", F.col("size").cast("int").alias("size"), F.pmod(F.xxhash64("item"), F.lit(cells)).alias("cell"))
    local = work.keep(dealt.groupBy("cell").applyInPandas(_round(0, capacity, fan_in), _PACKED), "level0")
    opened, moves, level = local, None, 0
    while cells > 1:
        level, cells = level + 1, -(-cells // fan_in)
        bins = opened.filter("open").groupBy("bin").agg(F.first("fill").cast("int").alias("size"), F.first("cell").alias("cell"))
        bins = bins.select(F.col("bin").alias("item"), "size", F.floor(F.col("cell") / fan_in).cast("long").alias("cell"))
        opened = work.keep(bins.groupBy("cell").applyInPandas(_round(level, capacity, fan_in), _PACKED), f"level{level}")
        step = opened.select(F.col("item").alias("_from"), F.col("bin").alias("_to"), F.col("offset").alias("_shift"))
        if moves is None:
            moves = step.select(F.col("_from").alias("bin"), "_to", "_shift")
        else:  # where a bin has gone, and then its bin
            then = step.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("_shift").alias("_more"))
            moves = moves.join(then, "_to", "left").select(
                "bin", F.coalesce("_next", "_to").alias("_to"), (F.col("_shift") + F.coalesce("_more", F.lit(0))).alias("_shift")
            )
    packed = local.select("item", "bin", "offset")
    if moves is None:
        packed = packed.select("item", F.col("bin").alias("sequence_id"), "offset")
    else:  # a bin has at most `capacity` items, so no key of this join is hot
        packed = packed.join(moves, "bin", "left").select(
            "item", F.coalesce("_to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset")
        )
    return whole.unionByName(packed)


class Encoder:
    """Token ids by a tokenizers file. Texts of plain Latin characters take an equal, faster encoder on the same vocabulary."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = None
        split = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer"):
            import tiktoken

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
            extra = {t["content"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in extra}
            self.fast = tiktoken.Encoding(path, pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.extra = tuple(extra)

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or _SLOW.search(text) or any(x in text for x in self.extra):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and before them the rest if there is one."""
    first = n % capacity
    starts = [0] * (first > 0) + list(range(first, n, capacity))
    return [(a, min(capacity, (first if a == 0 and first else capacity))) for a in starts]


def token_pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The documents' token sequences, each with its end token, in pieces of at most capacity: key, piece, start,
    length, ids_crc32, and with keep_ids the ids."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def encode(batches):
        import pyarrow as pa

        model = encoder(tokenizer)
        names = [x.split()[0].strip("`") for x in schema.split(", ")]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for k, t in zip(batch.column(0), batch.column(1)):
                ids = np.array([*model.ids(t.as_py() or ""), end_id], dtype="<u4")
                for number, (a, n) in enumerate(cut(len(ids), capacity)):
                    row = [k.as_py(), number, a, n, zlib.crc32(ids[a : a + n].tobytes())]
                    for column, value in zip(columns, [*row, ids[a : a + n].astype("int32")] if keep_ids else row):
                        column.append(value)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(encode, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, cell_items: int = CELL_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Every piece with its sequence_id and offset. Texts are encoded once; the shared folder holds the pieces
    (without ids unless they are asked for)."""
    work = Workspace(docs.sparkSession, "packing")
    pieces = token_pieces(docs, tokenizer, key=key, text=text, capacity=capacity, end_id=end_id, keep_ids=keep_ids)
    pieces = work.keep(pieces.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    packed = pack(pieces.select(F.col("_item").alias("item"), F.col("length").alias("size")), capacity, cell_items, fan_in, work)
    return pieces.join(packed, pieces["_item"] == packed["item"]).drop("_item", "item")
