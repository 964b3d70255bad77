"""Language-model scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Training counts words, then pairs of words. Tasks combine their counts before every shuffle and send them as compact
blocks, so that a frequent word is one entry of each task; the reducers own a hash range of words, or a hash class of
pairs, and write sorted arrays to the shared folder. Words are an array of 64-bit hashes, pairs an array of the two
words' places in it. Workers map these files into memory and look up the sorted queries of a batch by binary search.

    p(w | h) = max(c(h w) - D, 0) / c(h) + gamma(h) p(w),  D by c = 1, 2, 3 or more
    p(w)     = max(n(. w) - D', 0) / n(. .) + gamma' / (V + 1)

n(. w) counts the words that w has followed, gamma hands on what the discounts took; an unknown word has n = 0, an
unknown history leaves p(w). A text begins after a mark of its own and ends with an end token.

The model has order 2 for the disk that this operator may use, four times the input. Measured on tables of 0.10 and
0.51 GB: trigrams would lower the held-out perplexity from 4,182 to 1,550 and from 4,435 to 1,576, so they are worth
having; but 17.2 and 81.6 million distinct ones in the formats used here take 1.5 times the input as files and 1.5 times
again on their way through the shuffle, beside the 2.5 times that order 2 takes.

Defined results: null and empty text is the end token alone. Repeated rows count as often as they occur. Without
training texts every token is unknown and p = 1. Columns other than the named ones are not carried, whatever their
names. Texts of any length are read whole; equal counts need no order. Over 2**32 distinct words are an error, never a
wrong score.
"""

from __future__ import annotations

import math
import os
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.neardup import word_hashes
from lodestone.llm.shared import Workspace, by_length

#: Distinct entries that a task gathers before it combines them, documents to a shard of words, pairs to a shard.
GATHER, DOCS_PER_SHARD, TOKENS_PER_SHARD = 3_000_000, 32_768, 3_000_000
#: Arrays that a task keeps mapped; a process may map some 65,000.
MAPS = 8192
END = np.uint64(0x454E44)  # no text has a word of this hash but by a chance of 2**-64
_M = np.uint64(0x9E3779B97F4A7C15)
_IDS = np.uint64(32)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the greatest needs, behind one byte with that width."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8)[:, :width]).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    out = np.zeros(((len(raw) - 1) // raw[0], 8), "u1")
    out[:, : raw[0]] = np.frombuffer(raw, "u1", offset=1).reshape(-1, raw[0])
    return out.view("<u8").ravel()


def _sorted_block(x: np.ndarray) -> bytes:
    return _narrow(np.diff(x, prepend=np.uint64(0)))


def _sorted_back(raw: bytes) -> np.ndarray:
    return np.cumsum(_wide(raw), dtype="uint64")


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, "int64")
    return (keys[begins], *[np.add.reduceat(v[order], begins) if len(keys) else v for v in values])


def _hash(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _M
        return x ^ (x >> np.uint64(29))


class Files:
    """Arrays in a folder that all workers can open."""

    def __init__(self, local: str | None, uri: str):
        self.local, self.uri = local, uri

    def write(self, name: str, array: np.ndarray) -> None:
        """Put an array in place at once: an attempt that is lost or repeated leaves a whole file or none."""
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            part = f"{self.local}/.{name}.{uuid.uuid4().hex}"
            array.tofile(part)
            os.replace(part, f"{self.local}/{name}")
            return
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        with system.open_output_stream(f"{path}/{name}") as out:  # object stores show whole files only
            out.write(np.ascontiguousarray(array).data)

    def exists(self, name: str) -> bool:
        if self.local:
            return os.path.exists(f"{self.local}/{name}")
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        return system.get_file_info(f"{path}/{name}").type == fs.FileType.File

    def read(self, name: str, kind: str) -> np.ndarray:
        if self.local:
            path = f"{self.local}/{name}"
            return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        with system.open_input_file(f"{path}/{name}") as f:
            return np.frombuffer(f.read_buffer(), kind)


@dataclass
class Model:
    files: Files
    word_bits: int  # 2 ** word_bits shards of words, by their hashes' first bits
    begins: list[int]  # place of each shard's first word
    words: int = 0  # V
    tokens: int = 0  # N
    texts: int = 0
    pair_shards: int = 1
    pairs: int = 0  # n(. .)
    first: tuple = (0, 0, 0)  # n1, n2, n3+ of the beginning mark
    discounts: tuple = (0.5, 1.0, 1.5)
    lower: tuple = (0.5, 1.0, 1.5)
    lower_counts: tuple = (0, 0, 0)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 0.5, 1 and 1.5 where a count is 0."""
    if 0 in (n1, n2, n3, n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(float(k), max(0.0, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens, each text's end token included, and where each text begins."""
    rows = [word_hashes(t) for t in texts]
    lengths = np.array([len(r) + 1 for r in rows], "int64")
    begins = np.cumsum(lengths) - lengths
    out = np.full(int(lengths.sum()), END, "uint64")
    for a, r in zip(begins, rows):
        out[a : a + len(r)] = r
    return out, begins


class Reader:
    """A task's view of a model. It holds up to MAPS arrays, the latest ones."""

    def __init__(self, model: Model):
        self.model, self.held = model, {}

    def shard(self, kind: str, number: int, dtype: str) -> np.ndarray:
        name = f"{kind}{number}"
        if name not in self.held and len(self.held) >= MAPS:
            del self.held[next(iter(self.held))]
        self.held[name] = found = self.held.pop(name) if name in self.held else self.model.files.read(name, dtype)
        return found

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place, for sorted distinct hashes; -1 if unknown."""
        m, out = self.model, np.full(len(hashes), -1, "int64")
        edges = np.searchsorted(hashes >> np.uint64(64 - m.word_bits), np.arange(2**m.word_bits + 1, dtype="uint64"))
        for s in np.flatnonzero(np.diff(edges)):
            a, b = edges[s], edges[s + 1]
            known = self.shard("words", int(s), "<u8")
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == hashes[a:b], at + m.begins[s], -1)
        return out

    def per_word(self, kind: str, places: np.ndarray, dtype: str) -> np.ndarray:
        """An array's values at the places of sorted distinct words; 0 for unknown ones."""
        out = np.zeros(len(places), dtype)
        shard = np.searchsorted(self.model.begins, places, side="right") - 1
        for s in np.unique(shard[places >= 0]):
            own = (places >= 0) & (shard == s)
            out[own] = self.shard(kind, int(s), dtype)[places[own] - self.model.begins[s]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(keys), "int64")
        shard = _hash(keys) % np.uint64(self.model.pair_shards)
        order = np.argsort(shard, kind="stable")  # by shard, sorted inside
        found, begins = np.unique(shard[order], return_index=True)
        for s, own in zip(found, np.split(order, begins[1:])):
            known = self.shard("pairs", int(s), "<u8")
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                raw = self.shard("pair_counts", int(s), "u1")
                counts = raw.view(f"<u{len(raw) // len(known)}")
                out[own] = np.where(known[at] == keys[own], counts[at], 0)
        return out

    def pair_keys(self, places: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Key of (word before, word) for each token; texts begin after the mark, whose place is V."""
        before = np.empty_like(places)
        before[1:] = places[:-1]
        before[begins] = self.model.words
        return before.astype("uint64") << _IDS | places.astype("uint64")


def _emit_blocks(kind: str, keys: np.ndarray, shards: np.ndarray, counts: np.ndarray):
    """A record batch of (shard, keys, counts) blocks for sorted keys."""
    import pyarrow as pa

    order = np.argsort(shards, kind="stable")
    found, begins = np.unique(shards[order], return_index=True)
    parts = np.split(order, begins[1:]) if len(order) else []
    return pa.record_batch(
        [
            pa.array(found.astype("int64"), pa.int64()),
            pa.array([_sorted_block(keys[p]) for p in parts], pa.binary()),
            pa.array([_narrow(counts[p]) for p in parts], pa.binary()),
        ],
        names=["shard", "keys", "counts"],
    )


_BLOCKS = "shard long, keys binary, counts binary"


def _combined(batches, keys_of, shard_of, kind: str):
    """Blocks of a task's combined counts: keys are gathered up to GATHER entries, combined, and sent at the end or
    when too many have gathered."""
    loose, size = [], 0
    keys, counts = np.empty(0, "uint64"), np.empty(0, "uint64")
    for new in (keys_of(run) for batch in batches for run in by_length(batch.column(0).to_pylist())):
        loose.append(new)
        size += len(new)
        if size >= GATHER // 2:
            k, c = np.unique(np.concatenate(loose), return_counts=True)
            keys, counts = _sums(np.concatenate([keys, k]), np.concatenate([counts, c.astype("uint64")]))
            loose, size = [], 0
            if len(keys) >= GATHER:
                yield _emit_blocks(kind, keys, shard_of(keys), counts)
                keys, counts = np.empty(0, "uint64"), np.empty(0, "uint64")
    if loose:
        k, c = np.unique(np.concatenate(loose), return_counts=True)
        keys, counts = _sums(np.concatenate([keys, k]), np.concatenate([counts, c.astype("uint64")]))
    if len(keys):
        yield _emit_blocks(kind, keys, shard_of(keys), counts)


def _gathered(table) -> tuple[np.ndarray, np.ndarray]:
    keys = [_sorted_back(x.as_py()) for x in table.column("keys")]
    counts = [_wide(x.as_py()) for x in table.column("counts")]
    return _sums(np.concatenate(keys), np.concatenate(counts))


def train(texts: DataFrame, work: Workspace) -> Model:
    """Count the texts (one column) into a model in the work folder."""
    files = Files(work.local_path("model"), f"{work.path}/model")
    n_texts = texts.count()
    bits = max(3, math.ceil(math.log2(max(1, n_texts / DOCS_PER_SHARD))))

    def words(batches):
        return _combined(batches, lambda run: _tokens(run)[0], lambda k: k >> np.uint64(64 - bits), "words")

    def write_words(key, table):
        import pyarrow as pa

        shard = key[0].as_py()
        keys, counts = _gathered(table)
        files.write(f"words{shard}", keys.astype("<u8"))
        files.write(f"word_counts{shard}", counts.astype("<u8"))
        return pa.table({"shard": [shard], "words": [len(keys)], "tokens": [int(counts.sum())]})

    counted = texts.mapInArrow(words, _BLOCKS).groupBy("shard").applyInArrow(write_words, "shard long, words long, tokens long").collect()
    sizes = {r["shard"]: r for r in counted}
    begins, total = [], 0
    for s in range(2**bits):
        begins.append(total)
        total += sizes[s]["words"] if s in sizes else 0
    if total >= 2**32 - 1:
        raise ValueError(f"{total} distinct words; places are kept in 32 bits")
    for s in set(range(2**bits)) - set(sizes):
        files.write(f"words{s}", np.empty(0, "<u8"))
        files.write(f"word_counts{s}", np.empty(0, "<u8"))
    model = Model(files, bits, begins, total, sum(r["tokens"] for r in counted), n_texts)
    model.pair_shards = max(8, -(-model.tokens // TOKENS_PER_SHARD))
    count_by_word = [sizes[s]["words"] if s in sizes else 0 for s in range(2**bits)]

    def pairs(batches):
        reader = Reader(model)

        def keys_of(run):
            hashes, starts = _tokens(run)
            distinct, at = np.unique(hashes, return_inverse=True)
            return reader.pair_keys(reader.places(distinct)[at], starts)

        return _combined(batches, keys_of, lambda k: _hash(k) % np.uint64(model.pair_shards), "pairs")

    def write_pairs(key, table):
        """Write a shard of pairs; hand on what it holds about histories (h) and followers (w), by shard of words."""
        import pyarrow as pa

        shard = key[0].as_py()
        keys, counts = _gathered(table)
        kind = "<u1" if counts.max(initial=0) < 256 else "<u2" if counts.max() < 65536 else "<u8"
        files.write(f"pairs{shard}", keys.astype("<u8"))
        files.write(f"pair_counts{shard}", counts.astype(kind))
        rows = []
        ones = np.ones(len(keys), "uint64")
        classes = [(counts == 1).astype("uint64"), (counts == 2).astype("uint64"), (counts > 2).astype("uint64")]
        h, *by_h = _sums(keys >> _IDS, *classes)
        w, by_w = _sums(keys & np.uint64(2**32 - 1), ones)
        mark = h == model.words
        summary = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int(x[mark].sum()) for x in by_h] + [len(keys)]
        rows.append((-1, "s", _narrow(np.array(summary, "uint64")), b"", b"", b""))
        for what, ids, values in (("h", h[~mark], [x[~mark] for x in by_h]), ("w", w, [by_w])):
            owner = np.searchsorted(begins, ids.astype("int64"), side="right") - 1
            for s in np.unique(owner):
                own = owner == s
                rows.append((int(s), what, _sorted_block(ids[own] - np.uint64(begins[s])), *[_narrow(v[own]) for v in values], *[b""] * (3 - len(values))))
        return pa.table({n: [r[i] for r in rows] for i, n in enumerate(("owner", "what", "ids", "a", "b", "c"))}, schema=parts)

    import pyarrow as pa

    parts = pa.schema([("owner", pa.int64()), ("what", pa.string()), ("ids", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

    def write_stats(key, table):
        """Write what a shard of words needs for scoring: n1, n2, n3+ as a history and n(. w)."""
        import pyarrow as pa

        owner = key[0].as_py()
        rows = table.to_pylist()
        if owner < 0:
            sums = [int(x) for x in np.sum([_wide(r["ids"]) for r in rows], axis=0)]
            return pa.table({"owner": [owner], "sums": pa.array([sums], pa.list_(pa.int64()))})
        dense = np.zeros((4, count_by_word[owner]), "uint64")
        for r in rows:
            at = _sorted_back(r["ids"]).astype("int64")
            for i, name in enumerate(("a", "b", "c") if r["what"] == "h" else ("a",)):
                dense[i if r["what"] == "h" else 3, at] += _wide(r[name])
        for i in range(4):
            files.write(f"stat{i}_{owner}", dense[i].astype("<u4"))
        follows = dense[3]
        sums = [int((follows == k).sum()) for k in (1, 2, 3, 4)] + [int((follows > 2).sum())]
        return pa.table({"owner": [owner], "sums": pa.array([sums], pa.list_(pa.int64()))})

    schema = "owner long, what string, ids binary, a binary, b binary, c binary"
    counted = texts.mapInArrow(pairs, _BLOCKS).groupBy("shard").applyInArrow(write_pairs, schema)
    counted = counted.groupBy("owner").applyInArrow(write_stats, "owner long, sums array<long>").collect()  # a row per shard of words

    def write_missing(batches):
        """An empty file for every shard that got no pair, so that a file that is not there is an error."""
        for batch in batches:
            for s in batch.column(0).to_pylist():
                for name in (f"pairs{s}", f"pair_counts{s}"):
                    if not files.exists(name):
                        files.write(name, np.empty(0, "u1"))
            yield batch.slice(0, 0)

    texts.sparkSession.range(model.pair_shards).mapInArrow(write_missing, "id long").count()
    summary = next((r["sums"] for r in counted if r["owner"] == -1), [0] * 8)
    model.discounts, model.first, model.pairs = discounts(*summary[:4]), tuple(summary[4:7]), summary[7]
    below = [sum(r["sums"][i] for r in counted if r["owner"] >= 0) for i in range(5)]
    model.lower, model.lower_counts = discounts(*below[:4]), (below[0], below[1], below[4])
    return model


def _discount(counts: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype("int64")]


def score_texts(reader: Reader, texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of texts."""
    m = reader.model
    hashes, begins = _tokens(texts)
    distinct, at = np.unique(hashes, return_inverse=True)
    places = reader.places(distinct)
    count = reader.per_word("word_counts", places, "<u8").astype("float64")
    follows = reader.per_word("stat3_", places, "<u4").astype("float64")
    stats = [reader.per_word(f"stat{i}_", places, "<u4").astype("float64") for i in range(3)]
    base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
    if m.pairs:
        taken = sum(d * n for d, n in zip(m.lower, m.lower_counts)) / m.pairs
        lower = np.maximum(follows - _discount(follows, m.lower), 0) / m.pairs + taken / (m.words + 1)
    else:
        lower = np.ones(len(distinct))
    with np.errstate(divide="ignore", invalid="ignore"):
        gamma = np.where(count > 0, sum(d * n for d, n in zip(m.discounts, stats)) / count, 1.0)
    # by token: the history's count and gamma
    seen = np.empty(len(hashes))
    back = np.empty(len(hashes))
    seen[1:], back[1:] = count[at[:-1]], gamma[at[:-1]]
    seen[begins] = m.texts
    back[begins] = sum(d * n for d, n in zip(m.discounts, m.first)) / m.texts if m.texts else 1.0
    place = places[at]
    p = back * lower[at]
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[begins] = m.words
    both = np.flatnonzero((place >= 0) & (before >= 0))
    if len(both) and m.pairs:
        keys, where = np.unique(before[both].astype("uint64") << _IDS | place[both].astype("uint64"), return_inverse=True)
        c = reader.pair_counts(keys).astype("float64")
        p[both] += (np.maximum(c - _discount(c, m.discounts), 0))[where] / seen[both]
    known = (count > 0)[at]
    return {
        "n_tokens": np.diff(np.append(begins, len(hashes))),
        "n_known": np.add.reduceat(known.astype("int64"), begins) if len(begins) else begins,
        "base_score": np.add.reduceat(base[at], begins) if len(begins) else np.empty(0),
        "score": np.add.reduceat(np.log10(p), begins) if len(begins) else np.empty(0),
    }


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, base_score, score (log10), perplexity of every text."""
    schema = T.StructType([docs.schema[key], *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")], *[T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "perplexity")]])

    def run(batches):
        import pyarrow as pa

        reader = Reader(model)
        for batch in batches:
            runs = [score_texts(reader, run) for run in by_length(batch.column(1).to_pylist())] or [score_texts(reader, [])]
            found = {n: np.concatenate([r[n] for r in runs]) for n in runs[0]}
            found["perplexity"] = 10 ** np.minimum(-found["score"] / np.maximum(found["n_tokens"], 1), 300)
            yield pa.record_batch([batch.column(0), *[pa.array(found[f.name]) for f in schema.fields[1:]]], names=schema.names)

    return docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def train_and_score(docs: DataFrame, allowed: Column, *, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame]:
    """A model of the allowed documents and all documents' scores."""
    work = Workspace(docs.sparkSession, "ngram")
    model = train(docs.filter(allowed).select(F.col(text).cast("string").alias("_text")), work)
    return model, score(docs, model, key=key, text=text)
