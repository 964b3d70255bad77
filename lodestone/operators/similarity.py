"""Set similarity: exact joins by prefix, position and bitmap filters, MinHash signatures and banded candidates."""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import Hash, family
from lodestone.plans.workspace import Workspace, giving_back, size_checked

HASHES, BANDS, SIMILARITY = 100, 30, 0.5


#: Members of a list of postings in one block of its comparison; longs of a set's bitmap.
BLOCK, LONGS = 512, 8
#: The same where lists of postings are joined: a list is sent so many times as it has blocks.
POSTS = 8192
#: Candidate pairs whose sets are shuffled at once.
CANDIDATES = 500_000
#: Pairs that one task counts where pairs are counted without a shuffle.
PAIRS = 1_000_000
#: Where bands are compared: items hashed and pairs compared in one step of a worker, postings that it holds, postings
#: and pairs of a task, and the least bits of a set's parities.
HASHED, STEP, HELD, TASK_POSTS, TASK_PAIRS, PARITIES = 1 << 15, 250_000, 50_000, 50_000, 20_000_000, 512
#: Postings that are shuffled with their sets' parities at once.
TURN_POSTS = 4_000_000
_BITS = [f"b{w}" for w in range(LONGS)]


def _numbered(sets: DataFrame) -> DataFrame:
    """key, items (array of long, from the rarest item to the most common), n, and a bitmap of the items' hashes.

    Items are numbered in a written table, so that sets are compared as numbers. Nulls are no keys and no items. Every
    step is written, and its shuffle is released before the next.
    """
    work = Workspace(sets.sparkSession, "similarity")
    given = sets.select("key", "item").filter("key IS NOT NULL AND item IS NOT NULL")
    numbers = work.keep(given.groupBy("item").agg(F.count("*").alias("df")).withColumn("id", F.monotonically_increasing_id()), "numbers")
    work.release()
    pairs = work.keep(given.join(numbers, "item").select("key", "df", "id"), "pairs")
    work.release()
    work.drop("numbers")
    ranked = pairs.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("df", "id"))).alias("ranked"))
    whole = work.keep(ranked.select("key", F.transform("ranked", lambda x: x["id"]).alias("items"), F.size("ranked").cast("long").alias("n")), "lists")
    work.release()
    work.drop("pairs")
    places = whole.select("key", "items", "n", F.transform("items", lambda x: F.pmod(F.xxhash64(x), F.lit(64 * LONGS))).alias("places"))
    word = lambda w: F.aggregate(
        "places", F.lit(0).cast("long"), lambda acc, h: F.when(F.floor(h / 64) == w, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")))).otherwise(acc)
    )
    whole = work.keep(places.select("key", "items", "n", *[word(w).alias(b) for w, b in enumerate(_BITS)]), "sets")
    work.drop("lists")
    return whole


def _meeting(whole: DataFrame, prefix: Column, enough) -> DataFrame:
    """a < b, distinct: the keys that share one of their first `prefix` items and may be similar enough.

    enough(n, m, most) tells from two sets' sizes whether `most` shared items would do. How many they share at most
    follows from the places of the item at which they meet first, and from the bits in which their bitmaps differ.
    Lists of more than POSTS postings are dealt to the blocks of a triangle, so that no item is compared in one task.
    """
    posts = whole.select("key", "n", *_BITS, F.posexplode(F.slice("items", F.lit(1), prefix.cast("int"))).alias("pos", "id"))
    long = posts.groupBy("id").agg(F.count("*").alias("c")).filter(F.col("c") > POSTS).select("id", F.ceil(F.col("c") / POSTS).alias("blocks"))
    posts = posts.join(size_checked(long), "id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    posts = posts.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn("left", F.col("n") - F.col("pos"))
    a = posts.select("*", F.col("own").alias("x"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("y")).alias("a")
    b = posts.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))).alias("x"), F.col("own").alias("y")).alias("b")
    same = (F.col("a.id") == F.col("b.id")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    once = (F.col("a.x") < F.col("a.y")) | (F.col("a.key") < F.col("b.key"))
    apart = sum(F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in _BITS)
    n, m = F.col("a.n"), F.col("b.n")
    may = enough(n, m, F.least(n, m)) & enough(n, m, F.least("a.left", "b.left")) & enough(n, m, F.floor((n + m - apart) / 2))
    return a.join(b, same & once & may).select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct()


def _verified(candidates: DataFrame, whole: DataFrame) -> DataFrame:
    """a, b, common, united for candidate pairs. whole: key, items."""
    side = lambda c: whole.select(F.col("key").alias(c), F.col("items").alias(f"{c}_items"))
    met = candidates.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("a_items", "b_items")).cast("long"))
    return met.select("a", "b", "common", (F.size("a_items") + F.size("b_items") - F.col("common")).cast("long").alias("united"))


def _verified_in_turns(candidates: DataFrame, whole: DataFrame) -> DataFrame:
    """_verified, CANDIDATES or so at a time, since every candidate is shuffled with both of its sets."""
    work, out = Workspace(whole.sparkSession, "verified"), None
    candidates = work.keep(candidates, "candidates")
    work.release()
    turns = candidates.count() // CANDIDATES + 1
    for turn in range(turns):
        part = work.keep(_verified(candidates.filter(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn), whole), f"part{turn}")
        work.release()
        out = part if out is None else out.unionByName(part)
    work.drop("candidates")
    return out


def similar_pairs(sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """a < b, similarity: all pairs of keys with Jaccard similarity of at least `least` (above 0, taken as the decimal
    number that it is written as). Exact, in whole numbers.

    Items are ordered from rare to common; two sets that similar share one of the first n - ceil(least n) + 1 items of
    each, so only those meet, and what common items they have is counted for the few pairs that can be similar. They meet
    as in similar_sets_lsh, an item standing for a band.
    """
    return _similar_sets(_numbered(sets).select("key", "items"), least, [], 1)


def narrowed(df: DataFrame, *columns: str) -> list[Column]:
    """The columns, as int where they hold whole numbers and all of them fit: lists of ints are half as long."""
    whole = [c for c in columns if dict(df.dtypes)[c] in ("bigint", "smallint", "tinyint")]
    ends = df.agg(F.lit(0).alias("_"), *[f(c).alias(f"{f.__name__}_{c}") for c in whole for f in (F.min, F.max)]).first()
    fits = {c for c in whole if ends[f"max_{c}"] is not None and -(1 << 31) <= ends[f"min_{c}"] and ends[f"max_{c}"] < 1 << 31}
    return [F.col(c).cast("int") if c in fits else F.col(c) for c in columns]


def overlapping_pairs(sets: DataFrame, least: int) -> DataFrame:
    """a < b, common: all pairs of keys that share at least `least` items. Exact."""
    whole = sets.filter("key IS NOT NULL").groupBy("key").agg(F.collect_set("item").alias("items"))
    return overlapping_sets(whole, least)


def overlapping_sets(whole: DataFrame, least: int) -> DataFrame:
    """a < b, common: all pairs of keys that share at least `least` items. Exact. whole: key, items (array, distinct).

    Every key is sent the keys after it in its items' lists, and counts them where they arrive: no pair is shuffled, and a
    task counts PAIRS of them or so. Where a list has more than BLOCK keys, the common items are filtered first: the
    least - 1 most common items of a key then never form pairs.
    """
    work = Workspace(whole.sparkSession, "overlaps")
    whole = work.keep(whole.filter(F.size("items") >= least), "whole")
    work.release()
    (key,), kind = narrowed(whole, "key"), dict(whole.dtypes)["key"]
    posts = whole.select(key.alias("key"), F.explode("items").alias("item"))
    lists = work.keep(posts.groupBy("item").agg(F.sort_array(F.collect_list("key")).alias("keys")).filter(F.size("keys") > 1).select("keys"), "lists")
    size = F.size("keys").cast("long")
    longest, pairs = lists.agg(F.max(size), F.sum(size * (size - 1) / 2)).first()
    work.release()
    if (longest or 0) > BLOCK:
        return _overlapping_filtered(whole.select("key", F.explode("items").alias("item")), least)
    later = lists.select("keys", F.posexplode("keys").alias("pos", "a")).filter(F.col("pos") + 1 < F.size("keys"))
    dealt = later.select("a", F.slice("keys", F.col("pos") + 2, F.size("keys")).alias("bs")).repartition(int((pairs or 0) // PAIRS) + 1, "a")
    counted = dealt.select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("common"))
    return counted.filter(F.col("common") >= least).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "common")


def _overlapping_filtered(sets: DataFrame, least: int) -> DataFrame:
    """The same by prefix, position and bitmap filters."""
    whole = _numbered(sets).filter(F.col("n") >= least)
    found = _verified(_meeting(whole, F.col("n") - least + 1, lambda n, m, most: most >= least), whole)
    return found.filter(F.col("common") >= least).select("a", "b", "common")


def minhash_family(universe: int, hashes: int = HASHES, seed: int = 11) -> list[Hash]:
    return family(hashes, universe, seed)


def signatures(sets: DataFrame, hashes: list[Hash]) -> DataFrame:
    """key, signature: the least hash of a key's items under each function, all in one aggregate. item: long."""
    return sets.groupBy("key").agg(F.array(*[F.min(h.of(F.col("item"))) for h in hashes]).alias("signature"))


def lsh_pairs(signed: DataFrame, bands: int = BANDS) -> DataFrame:
    """a < b: pairs with an equal band. Bands have floor(hashes / bands) rows; what is left over makes further bands."""
    rows = F.greatest(F.floor(F.size("signature") / bands), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), F.size("signature") - 1, rows)
    cut = F.transform(starts, lambda s: F.struct(s.alias("band"), F.slice("signature", s + 1, rows).alias("part")))
    posted = signed.select("key", F.explode(cut).alias("s")).select("key", "s.*")
    a, b = posted.alias("a"), posted.alias("b")
    met = (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.key") < F.col("b.key"))
    return a.join(b, met).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()


def _least_hashes(items: np.ndarray, starts: np.ndarray, hashes: list[Hash]) -> np.ndarray:
    """The signatures of sets that lie in items (long) from starts on: what signatures() gives, a row a set."""
    out = np.empty((len(starts), len(hashes)), "int32")
    high, low = items >> 31, items & ((1 << 31) - 1)
    for k, h in enumerate(hashes):
        if h.p < 1 << 28:  # then two products stand for the one that would overflow
            a = h.a % h.p
            x = high * ((a << 31) % h.p) + low * a + h.b
        else:
            x = items % h.p * h.a + h.b
        x -= x // h.p * h.p  # faster than %
        x = x.astype("uint32")
        out[:, k] = np.minimum.reduceat(x - x // np.uint32(h.m) * np.uint32(h.m), starts)
    return out


def _parities(items: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of 64 bits that tell which places hold an odd number of a set's items, and how many words a set has: places
    for twice its items at least, in powers of two, so that longer ones can be folded to shorter ones."""
    words = np.maximum(1 << np.ceil(np.log2(2 * lengths)).astype("int64"), PARITIES) // 64
    begins = np.cumsum(words) - words
    mixed = (items ^ (items >> 29)).view("uint64") * np.uint64(0x9E3779B97F4A7C15)
    place = ((mixed >> np.uint64(20)) & (np.repeat(words, lengths) * 64 - 1).astype("uint64")).astype("int64")
    out = np.zeros(int(words.sum()), "uint64")
    np.bitwise_xor.at(out, np.repeat(begins, lengths) + (place >> 6), np.uint64(1) << (place & 63).astype("uint64"))
    return out, words


def _sketches(batches, hashes: list[Hash], rows: int):
    """key, n, digest, bands (the band's number and its values, as bytes) and parities of sets (key, items in order)."""
    import pyarrow as pa

    def binary(lengths, data):
        ends = np.append(0, np.cumsum(lengths)).astype("int32")
        return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])

    starts = range(0, len(hashes), rows)
    for batch in batches:
        offsets = batch["items"].offsets.to_numpy()
        every, lengths = batch["items"].flatten().to_numpy(), np.diff(offsets)
        offsets, begin = offsets - offsets[0], 0
        while begin < len(lengths):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + HASHED, "right")) - 1)
            items, n = every[offsets[begin] : offsets[end]], lengths[begin:end].astype("int64")
            signature = _least_hashes(items, offsets[begin:end] - offsets[begin], hashes)
            parts = np.full((len(n), len(starts), rows + 1), -1, "<i4")
            for band, s in enumerate(starts):
                part = signature[:, s : s + rows]
                parts[:, band, 0], parts[:, band, 1 : part.shape[1] + 1] = band, part
            bands = binary(np.full(len(n) * len(starts), 4 * (rows + 1)), parts)
            bits, words = _parities(items, n)
            digest = [hashlib.sha256(every[offsets[k] : offsets[k + 1]].tobytes()).digest() for k in range(begin, end)]
            of_sets = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype="int32") * np.int32(len(starts)), bands)
            columns = [batch["key"].slice(begin, end - begin), pa.array(n), pa.array(digest, pa.binary()), of_sets, binary(8 * words, bits)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "digest", "bands", "bits"])
            begin = end


def _cut(batches, names: tuple[str, ...], size_of, most: int):
    """Tables of whole runs of rows that are equal in the named columns, of `most` or so by size_of(batch)."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += size_of(batch)
        if size < most:
            continue
        rows = pa.Table.from_batches(held)
        marks = [rows[c].to_numpy() for c in names]
        cut = int(np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in marks])))[-1])  # the last run may go on
        if cut:
            yield rows.slice(0, cut).combine_chunks()
            held = rows.slice(cut).combine_chunks().to_batches()
            size = sum(map(size_of, held))
    rows = pa.Table.from_batches(held).combine_chunks() if held else None
    if rows is not None and rows.num_rows:
        yield rows


def _numbers(rows, *names: str) -> np.ndarray:
    """The number of every row's run of rows that are equal in the named columns."""
    marks = [rows[c].to_numpy() for c in names]
    return np.cumsum(np.append(False, np.logical_or.reduce([c[1:] != c[:-1] for c in marks])))


def _close(rows, p: int, q: int):
    """Numbers of two rows each (arrays) that lie in the same block of a bucket, whose sizes, numbers of items that are
    left where they meet, and parities leave room for a similarity of p / q. rows: bucket, x, y, own, n, left, bits,
    sorted by the first three and n."""
    column = lambda c: rows[c].to_numpy().astype("int64")
    x, y, own, n, left, group = *(column(c) for c in ("x", "y", "own", "n", "left")), _numbers(rows, "bucket", "x", "y")
    raw = rows["bits"].combine_chunks()
    raw = raw.chunk(0) if hasattr(raw, "chunks") else raw
    ends = np.frombuffer(raw.buffers()[1], "int32")[raw.offset : raw.offset + len(raw) + 1].astype("int64")
    flat = np.frombuffer(raw.buffers()[2], "uint8")[ends[0] : ends[-1]].view("uint64")
    begins, words = (ends[:-1] - ends[0]) // 8, np.diff(ends) // 8

    def folded(at, width):
        out = np.empty((len(at), width), "uint64")
        for w in np.unique(words[at]):
            sel = np.flatnonzero(words[at] == w)
            out[sel] = np.bitwise_xor.reduce(flat[begins[at[sel]][:, None] + np.arange(w)].reshape(len(sel), w // width, width), axis=1)
        return out

    def near(i, j, a, b):
        apart = np.bitwise_count(a ^ b).sum(1, dtype="int64")
        return apart * (p + q) <= (n[i] + n[j]) * (q - p)

    least = PARITIES // 64
    short = np.concatenate([folded(np.arange(k, min(k + HELD, len(n))), least) for k in range(0, len(n), HELD)])
    span = int(n.max()) + 1
    most = np.minimum(n * q // p, span - 1) if p else np.full(len(n), span - 1)
    count = np.searchsorted(group * span + n, group * span + most, "right") - np.arange(len(n)) - 1
    total, begin = np.cumsum(count), 0
    while begin < len(n):
        before = total[begin] - count[begin]
        end = max(begin + 1, int(np.searchsorted(total, before + STEP, "right")))
        here = count[begin:end]
        i = np.repeat(np.arange(begin, end), here)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[begin:end] - here - before, here)
        begin = end
        once = (x[i] == y[i]) | (own[i] != own[j])
        once &= np.minimum(left[i], left[j]) * (p + q) >= (n[i] + n[j]) * p
        i, j = i[once], j[once]
        ok = near(i, j, short[i], short[j])
        i, j = i[ok], j[ok]
        for w in np.unique(words[i]):
            sel = np.flatnonzero(words[i] == w)
            step = max(1, (1 << 22) // int(words[j[sel]].max()))
            for k in range(0, len(sel), step):
                one, two = i[sel[k : k + step]], j[sel[k : k + step]]
                ok = near(one, two, folded(one, w), folded(two, w)) if w > least else slice(None)
                yield one[ok], two[ok]


def _met(batches, p: int, q: int):
    """a, b: keys of the close pairs of postings that come sorted by bucket, block and size."""
    import pyarrow as pa

    for rows in _cut(batches, ("bucket", "x", "y"), lambda b: b.num_rows, HELD):
        keys = rows["key"].combine_chunks()
        for i, j in _close(rows, p, q):
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), keys.take(pa.array(j))], ["a", "b"])


def _close_in(posted: DataFrame, drawn: DataFrame, turn: int, work: Workspace, kind: str, p: int, q: int) -> DataFrame:
    """a < b, distinct: the pairs of postings (key, left, band) of a band that can be similar, as far as sketches tell."""
    size = F.size("posts").cast("long")
    buckets = posted.groupBy("band").agg(F.collect_list(F.struct("key", "left")).alias("posts")).filter(F.size("posts") > 1)
    buckets = work.keep(buckets.select(F.monotonically_increasing_id().alias("bucket"), "posts"), "buckets")
    posts, pairs = (int(c or 0) for c in buckets.agg(F.sum(size), F.sum(size * (size - 1) / 2)).first())
    work.release()
    met = buckets.select("bucket", F.ceil(size / POSTS).alias("blocks"), F.explode("posts").alias("post")).select("bucket", "blocks", "post.key", "post.left")
    met = met.join(drawn.select("key", "n", "bits"), "key").withColumn("own", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "n", "left", "bits")
    met = met.repartition(posts // TASK_POSTS + pairs // TASK_PAIRS + 1, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "n")
    close = met.mapInArrow(giving_back(lambda batches: _met(batches, p, q)), f"a {kind}, b {kind}")
    close = work.keep(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"close{turn}")
    work.release()
    work.drop("buckets")
    return close


def similar_pairs_lsh(sets: DataFrame, hashes: list[Hash], bands: int = BANDS, least: float = SIMILARITY) -> DataFrame:
    """a < b, similarity: the banded candidates that are similar on the full sets. item: long. Nulls are no keys and no items."""
    whole = sets.filter("key IS NOT NULL AND item IS NOT NULL").groupBy("key").agg(F.collect_set("item").alias("items"))
    return similar_sets_lsh(whole, hashes, bands, least)


def similar_sets_lsh(whole: DataFrame, hashes: list[Hash], bands: int = BANDS, least: float = SIMILARITY) -> DataFrame:
    """a < b, similarity: the pairs with an equal band (as in lsh_pairs) and a similarity of at least `least`. Every such
    pair is found. whole: key, items (array of long, distinct), a row a key.

    Equal sets are compared as one and expanded in the end. The sets that share a band meet in its bucket, sorted by
    size, and only as parities of their items; pairs that these rule out are never formed as rows. Buckets of over POSTS
    sets are dealt to the blocks of a triangle. What is left is counted on the full sets.
    """
    ordered = whole.filter("key IS NOT NULL AND size(items) > 0").select("key", F.sort_array("items").alias("items"))
    return _similar_sets(ordered, least, hashes, max(len(hashes) // bands, 1))


def _similar_sets(whole: DataFrame, least: float, hashes: list[Hash], rows: int) -> DataFrame:
    """a < b, similarity: the similar pairs with an equal band of `rows` hashes; without hashes, all similar pairs. whole:
    key, items (array of long, equal sets in the same order; without hashes, all in one order)."""
    work, kind = Workspace(whole.sparkSession, "bands"), dict(whole.dtypes)["key"]
    p, q = Fraction(repr(float(least))).as_integer_ratio()
    whole = work.keep(whole, "sets")
    work.release()
    sketch = giving_back(lambda batches: _sketches(batches, hashes, rows))
    drawn = work.keep(whole.mapInArrow(sketch, f"key {kind}, n long, digest binary, bands array<binary>, bits binary"), "sketches")
    # equal sets stand under their least key
    classes = drawn.groupBy("digest").agg(F.min("key").alias("rep"), F.collect_list("key").alias("keys")).filter(F.size("keys") > 1)
    copies = work.keep(classes.select("rep", F.explode("keys").alias("key")), "copies")
    work.release()
    others = size_checked(copies.filter("key <> rep").select("key"))
    n = F.size("items")
    if hashes:
        posted, turns = drawn.join(others, "key", "left_anti").select("key", F.lit(2**31 - 1).alias("left"), F.explode("bands").alias("band")), 1
    else:
        prefix = n - F.expr(f"(size(items) * {p}L + {q - 1}) DIV {q}").cast("int") + 1
        firsts = work.keep(whole.join(others, "key", "left_anti").select("key", n.alias("n"), F.slice("items", F.lit(1), prefix).alias("items")), "firsts")
        work.release()
        posted = firsts.select("key", "n", F.posexplode("items").alias("pos", "band")).select("key", (F.col("n") - F.col("pos")).alias("left"), "band")
        counts = posted.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
        turns = int(counts.agg(F.sum(F.col("c") * F.ceil(F.col("c") / POSTS))).first()[0] or 0) // TURN_POSTS + 1
        work.release()
    close = None
    for turn in range(turns):
        here = posted.filter(F.pmod(F.xxhash64("band"), F.lit(turns)) == turn) if turns > 1 else posted
        part = _close_in(here, drawn, turn, work, kind, p, q)
        close = part if close is None else close.unionByName(part)
    close = work.keep(close.distinct(), "close") if turns > 1 else close
    work.release()
    work.drop("sketches", "firsts", *[f"close{turn}" for turn in range(turns if turns > 1 else 0)])
    asked = close.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    involved = work.keep(whole.join(size_checked(asked), "key", "left_semi"), "involved")
    work.release()
    work.drop("sets")
    found = _verified_in_turns(close, involved).filter(F.col("common") * q >= F.col("united") * p)
    work.drop("close", "close0", "involved")
    found = found.select("a", "b", (F.col("common") / F.col("united")).alias("similarity"))
    small = size_checked(copies)
    for end in ("a", "b"):
        of_end = small.select(F.col("rep").alias(end), F.col("key").alias("_key"))
        found = found.join(of_end, end, "left").withColumn(end, F.coalesce("_key", end)).drop("_key")
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    equal = copies.select("rep", F.col("key").alias("a")).join(small.select("rep", F.col("key").alias("b")), "rep").filter("a < b")
    return found.unionByName(equal.select("a", "b", F.lit(1.0).alias("similarity")))
