"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set of word shingles gets a signature of `coordinates` minima. Documents are posted under each
coordinate-value pair; two sets of the wanted similarity agree in at least `matches` coordinates (but for a chance of
MISS), so only collisions of that many matter:

* pairs that only one document has cannot collide and are skipped; a document left with fewer than `matches` is done;
* of the m that are left a document is posted only under its m - matches + 1 rarest (prefix): any two documents with
  enough collisions still meet, and the long lists of common pairs are skipped;
* collisions over whole signatures are counted for the pairs which meet and whose sizes allow the similarity. Pairs above
  the threshold are confirmed on the full sets, unless their parities rule them out: FOLDS bits, each set if an odd
  number of a set's shingles fall on it, which differ in at most as many places as the sets in shingles.

Documents with equal sets are one class from the start, so that copies never form pairs. Lists do not form all pairs
either: first each member of a list meets the first member it collides with often enough, in lists over BLOCK members
one central member (the best of CANDIDATES) in each of ROUNDS rounds; confirmed links join components, and what a list
holds of one component is done, since further links inside it change nothing. Then every list compares its members of
different components. Lists over BLOCK members do so in blocks, the members outside the largest component against all:
signatures tell which members collide with another component at all, and workers compare the full sets of those, each
pair in the first list that both are in, and return links only. No partner is capped or dropped.

Whether a pair collides often enough is counted on 7 bits of each coordinate, which never miss a collision; the full
sets decide.

Defined results: null text, empty text and text without words have an empty set, linked with nothing. A text with fewer
words than a shingle has one shingle, the whole. Rows with a null id are linked with nothing and get a null component.
Rows that share an id are compared one by one. Shingles are compared by 64-bit hashes, sets by 128 bits. A similarity of
exactly the threshold is a link; of equal ids in a component the least digest of a text stays. Texts of any length give
whole sets. An empty table gives an empty one. Extra columns are carried where asked for, under any names, in
deduplicate() all of them.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import Workspace, giving_back

COORDINATES, MISS = 32, 1e-8
CANDIDATES, ROUNDS, BLOCK = 8, 2, 64
#: Members, and items of their sets, that a block of full sets holds on average at most.
SET_BLOCK, SET_ITEMS = 512, 1_000_000
#: Bits kept of a coordinate, and coordinates in one long.
BITS, LANES = 7, 8
#: Bits of a set's parity.
FOLDS = 1024
#: Ids that are looked for are sent as bits of a filter up to so many, ID_BITS of them for each id; more are joined.
SENT_IDS, ID_BITS = 4_000_000, 16
#: Rows of labels that one task writes.
LABELS = 50_000
#: Edges whose components the driver finds (16 bytes each); more are joined by steps over all executors.
DRIVER_EDGES = 500_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def least_matches(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """The greatest t such that sets of the similarity agree in fewer than t coordinates with probability under miss."""
    below = 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below >= miss:
            return max(1, k)
    return coordinates


class _Words(dict):
    """Hashes of words seen, forgotten when too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def _words() -> _Words:
    return _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and the six ASCII spaces
    return np.fromiter(map(_words().__getitem__, words), "uint64", len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    h = word_hashes(text)
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        span = min(width, len(h))
        n = len(h) - span + 1
        x = _mix(h[:n] * _A + np.uint64(span))
        for j in range(1, span):
            x = _mix(x * _B + h[j : j + n])
    return np.unique(x)


@functools.cache
def _coefficients(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 2**64, coordinates, "uint64"), rng.integers(0, 2**63, coordinates, "uint64") * np.uint64(2) + np.uint64(1)


def signature(x: np.ndarray, coordinates: int) -> np.ndarray:
    """The least hash of a set under each coordinate's hash function."""
    xor, odd = _coefficients(coordinates)
    least = np.full(coordinates, np.iinfo("uint64").max, "uint64")
    with np.errstate(over="ignore"):
        for a in range(0, len(x), 4096):
            h = (x[a : a + 4096, None] ^ xor) * odd
            least = np.minimum(least, (h ^ (h >> np.uint64(31))).min(axis=0))
    return least


def parity(x: np.ndarray) -> np.ndarray:
    """FOLDS bits as longs: whether an odd number of a set's hashes fall on each."""
    counts = np.bincount((x >> np.uint64(64 - FOLDS.bit_length() + 1)).astype("int64"), minlength=FOLDS)
    return np.packbits((counts & 1).astype("uint8")).view("int64")


def signatures(docs: DataFrame, carry: list[str], text: str, width: int, coordinates: int) -> DataFrame:
    """The carried columns with n_shingles, digest (of the set; null if empty), sig and parity (arrays of long)."""
    kept = [docs.schema[c] for c in carry]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*kept, T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", longs), T.StructField("parity", longs)])

    def sign(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sizes, digests, flat, folds = [], [], [], []
            for t in batch.column(len(kept)):
                x = shingle_set(t.as_py(), width)
                sizes.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                if len(x):
                    flat.append(signature(x, coordinates).view("int64"))
                    folds.append(parity(x))
            filled = np.cumsum([0, *(n > 0 for n in sizes)])
            arrays = [pa.ListArray.from_arrays(pa.array(filled * each, pa.int32()), pa.array(np.concatenate([np.empty(0, "int64"), *values]))) for each, values in ((coordinates, flat), (FOLDS // 64, folds))]
            yield pa.record_batch(
                [*batch.columns[: len(kept)], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *arrays],
                names=[*batch.schema.names[: len(kept)], "n_shingles", "digest", "sig", "parity"],
            )

    return docs.select(*carry, F.col(text).cast("string").alias("_text")).mapInArrow(giving_back(sign), schema)


def _among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is one of ids (one column, distinct), and a few others, which the caller's join drops. A
    table of ids takes the driver some hundred bytes each until it is sent, a filter 4 for the places and 4 at most for
    its bits."""
    import pyarrow as pa

    spark, (name,) = rows.sparkSession, ids.columns
    count = ids.count()
    if count > SENT_IDS:
        return rows.join(ids.select(F.col(name).alias("_id")), F.col(key) == F.col("_id"), "left_semi")
    size = 1 << max(6, (ID_BITS * count - 1).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    at = ids.select(place(name).alias("at")).toArrow().column("at").to_numpy()
    bits = np.zeros(size // 64, "uint64")
    np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype("uint64"))
    one = spark.createDataFrame(pa.table({"_bits": pa.ListArray.from_arrays(pa.array([0, len(bits)], pa.int32()), pa.array(bits.view("int64")))}), "_bits array<long>")
    word = F.get("_bits", F.shiftright(place(key), 6))
    return rows.join(F.broadcast(one), F.bit_get(word, F.pmod(place(key), F.lit(64))) == 1, "left_semi")


def _full_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """node, items (sorted array of long) of the wanted classes (node, rep, digest): their representatives' texts are
    read again, which takes far less than keeping every document's set."""
    schema = T.StructType([T.StructField("rep", docs.schema[key].dataType), T.StructField("_digest", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType()))])

    def collect(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [shingle_set(t.as_py(), width) for t in batch.column(1)]
            at = np.cumsum([0, *map(len, sets)]).astype("int32")
            values = np.concatenate([np.empty(0, "uint64"), *sets]).view("int64")
            digests = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            yield pa.record_batch([batch.column(0), digests, pa.ListArray.from_arrays(pa.array(at), pa.array(values))], names=["rep", "_digest", "items"])

    texts = docs.select(F.col(key).alias("rep"), F.col(text).cast("string").alias("_text"))
    sets = _among(texts, "rep", wanted.select("rep").distinct()).mapInArrow(giving_back(collect), schema)
    # the filter lets some others pass, and rows that share an id may hold other texts; id and digest tell
    found = sets.join(wanted.withColumnRenamed("rep", "_rep"), (F.col("rep") == F.col("_rep")) & (F.col("_digest") == F.col("digest")))
    return found.select("node", "items").dropDuplicates(["node"])


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of edges (a, b) and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    comp = np.arange(len(nodes))
    while (comp[x] != comp[y]).any():
        p, q = comp[x], comp[y]
        np.minimum.at(comp, np.maximum(p, q), np.minimum(p, q))
        while (comp[comp] != comp).any():
            comp = comp[comp]
    return nodes, nodes[comp]


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """node, comp for the nodes of edges (a, b): comp is one node of the component, the same for all.

    Up to DRIVER_EDGES edges are joined by the driver. While there are more, each step hooks every component to its
    least neighbour, shortens the paths, and carries on with the edges that still join different components.
    """
    labels, left, step = None, edges.select("a", "b"), 0
    while left.count() > DRIVER_EDGES:
        if labels is None:
            nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
            labels = nodes.withColumn("comp", F.col("node"))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = work.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), f"{name}_hook{step}")
        for _ in range(2):
            hook = hook.alias("h").join(hook.select(F.col("a").alias("m"), F.col("up").alias("top")), F.col("up") == F.col("m"), "left").select("a", F.coalesce("top", "up").alias("up"))
        hook = work.keep(hook, f"{name}_jump{step}")
        labels = work.keep(_renamed(labels, hook.withColumnRenamed("a", "comp")), f"{name}_labels{step}")
        ends = lambda c: hook.select(F.col("a").alias(c), F.col("up").alias(f"{c}_up"))
        left = left.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).filter("a <> b").distinct()
        left = work.keep(left, f"{name}_left{step}")
        work.drop(f"{name}_hook{step}", f"{name}_jump{step}")
        if step:
            work.drop(*[f"{name}_{x}{step - 1}" for x in ("labels", "left")])
        step += 1
    few = left.toArrow()
    if labels is not None and not few.num_rows:
        work.drop(f"{name}_left{step - 1}")
        return labels
    found = _labelled(few, work, f"{name}_labels")
    if labels is not None:
        labels = work.keep(_renamed(labels, found.toDF("comp", "up")), f"{name}_all")
        work.drop(f"{name}_labels", f"{name}_labels{step - 1}", f"{name}_left{step - 1}")
        return labels
    return found


def _renamed(labels: DataFrame, ups: DataFrame) -> DataFrame:
    """Labels (node, comp) with the components of ups (comp, up) under their new name."""
    return labels.join(ups, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))


def _labelled(edges, work: Workspace, name: str) -> DataFrame:
    """node, comp of an Arrow table of edges, as a table of the shared folder. The executors write it from plain arrays:
    as rows it would take the driver several times the memory."""
    nodes, comp = least_labels(*(edges.column(c).to_numpy() for c in ("a", "b")))
    sent, tasks = work.spark.sparkContext.broadcast((nodes, comp)), -(-len(nodes) // LABELS)

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.record_batch([pa.array(x[k * LABELS : (k + 1) * LABELS]) for x in sent.value], names=["node", "comp"])

    found = work.keep(work.spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(write, "node long, comp long"), name)
    sent.destroy()
    return found


def _packed(sig: Column, coordinates: int) -> Column:
    """The low bits of a signature's coordinates, LANES to a long."""
    low = (1 << BITS) - 1
    lane = lambda i: F.shiftleft(F.get(sig, F.lit(i)).bitwiseAND(F.lit(low)), BITS * (i % LANES))
    longs = [functools.reduce(Column.bitwiseOR, [lane(i) for i in range(a, min(a + LANES, coordinates))]) for a in range(0, coordinates, LANES)]
    return F.array(*longs)


def _agreeing(a: Column, b: Column, coordinates: int) -> Column:
    """Lanes that are equal in two packed signatures, counted by carrying every unequal lane into its top bit."""
    top = sum(1 << (BITS * i + BITS - 1) for i in range(LANES))
    low = sum(((1 << (BITS - 1)) - 1) << (BITS * i) for i in range(LANES))
    total = F.lit(0)
    for j in range(-(-coordinates // LANES)):
        x = a[j].bitwiseXOR(b[j])
        unequal = (x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(top))
        total = total + min(LANES, coordinates - j * LANES) - F.bit_count(unequal)
    return total


def _sized(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _posted(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings (v, node) with their component."""
    if labels is None:
        return lists.withColumn("comp", F.col("node"))
    return lists.join(labels, "node", "left").select("v", "node", F.coalesce("comp", "node").alias("comp"))


def _open_lists(posted: DataFrame) -> DataFrame:
    """Postings of the lists that still hold different components, with the number of members of their list (_n)."""
    spans = posted.groupBy("v").agg(F.min("comp").alias("_l"), F.max("comp").alias("_m"), F.count("*").alias("_n"))
    return posted.join(spans.filter("_l <> _m").select("v", "_n"), "v")


def _list_pairs(posted: DataFrame, packs: DataFrame, matches: int, coordinates: int, percent: int, first: bool) -> DataFrame:
    """Colliding pairs of different components in lists of at most BLOCK members; with first, each member's first only."""
    lists = posted.filter(F.col("_n") <= BLOCK).join(packs, "node").groupBy("v").agg(F.collect_list(F.struct("node", "comp", "n", "pack")).alias("ms"))

    def partners(x, i):
        met = F.filter(F.slice("ms", F.lit(1), i), lambda y: (y["comp"] != x["comp"]) & _sized(x["n"], y["n"], percent) & (_agreeing(x["pack"], y["pack"], coordinates) >= matches))
        met = F.transform(met, lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))
        return F.slice(met, 1, 1) if first else met

    return lists.select(F.explode(F.flatten(F.transform("ms", partners))).alias("p")).select("p.a", "p.b").distinct()


def _pivot_pairs(posted: DataFrame, packs: DataFrame, matches: int, coordinates: int, percent: int, seed: int) -> DataFrame:
    """Members of a list beside its pivot, if of another component and colliding often enough. The candidates are the
    least under hash functions that all lists share, so lists with much the same members take the same pivot: the one
    that agrees most with the other candidates."""
    rows = posted.join(packs, "node")
    picks = [F.min(F.struct(F.xxhash64(F.lit(seed * CANDIDATES + j), "node").alias("h"), "node", "comp", "n", "pack")).alias(f"_{j}") for j in range(CANDIDATES)]
    chosen = rows.groupBy("v").agg(*picks).select("v", F.array(*[f"_{j}" for j in range(CANDIDATES)]).alias("_c"))
    central = F.transform("_c", lambda x: F.struct(F.aggregate("_c", F.lit(0), lambda t, y: t + _agreeing(x["pack"], y["pack"], coordinates).cast("int")).alias("t"), x["node"].alias("p"), x["comp"].alias("pc"), x["n"].alias("pn"), x["pack"].alias("pp")))
    chosen = chosen.select("v", F.array_max(central).alias("_best")).select("v", "_best.p", "_best.pc", "_best.pn", "_best.pp")
    near = (F.col("comp") != F.col("pc")) & _sized(F.col("n"), F.col("pn"), percent) & (_agreeing(F.col("pack"), F.col("pp"), coordinates) >= matches)
    met = rows.withColumnRenamed("v", "_v").join(chosen, (F.col("_v") == F.col("v")) & near)
    return met.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def _large(posted: DataFrame) -> DataFrame:
    """Postings of the lists with more than BLOCK members."""
    return posted.filter(F.col("_n") > BLOCK).drop("_n")


def _split(posted: DataFrame) -> DataFrame:
    """Postings with whether a member is outside its list's largest component (_minor)."""
    sizes = posted.groupBy("v", "comp").count()
    largest = sizes.groupBy("v").agg(F.max_by("comp", F.struct("count", "comp")).alias("_big"), F.sum("count").alias("_all"))
    return posted.join(largest, "v").withColumn("_minor", F.col("comp") != F.col("_big"))


def _colliding(posted: DataFrame, packs: DataFrame, matches: int, coordinates: int, percent: int, work: Workspace) -> DataFrame:
    """The postings (v, node) of members that collide often enough with a member, of about their size, of another
    component of the list."""
    rows = work.keep(_split(posted), "sides").join(packs, "node")
    rows = rows.withColumn("_c", F.pmod(F.xxhash64("node"), F.ceil(F.col("_all") / BLOCK)))
    member = F.struct("node", "comp", "n", "pack")
    every = rows.groupBy("v", "_c").agg(F.collect_list(member).alias("right"))
    minor = rows.filter("_minor").withColumnRenamed("_c", "_d").groupBy("v", "_d").agg(F.collect_list(member).alias("left"))
    longs = -(-coordinates // LANES)
    low = np.int64(sum(((1 << (BITS - 1)) - 1) << (BITS * i) for i in range(LANES)))
    top = np.int64(sum(1 << (BITS * i + BITS - 1) for i in range(LANES)))

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            found: set[tuple[int, int]] = set()
            for v, left, right in zip(*(batch.column(i) for i in range(3))):
                sides = []
                for values in (left.values, right.values):
                    node, comp, size, pack = values.flatten()
                    sides.append((node.to_numpy(), comp.to_numpy(), size.to_numpy(), pack.flatten().to_numpy().reshape(len(node), longs)))
                (xn, xc, xz, xs), (yn, yc, yz, ys) = sides
                agree = np.full((len(xn), len(yn)), coordinates, "int64")
                for i in range(longs):
                    x = xs[:, i, None] ^ ys[None, :, i]
                    agree -= np.bitwise_count((((x & low) + low) | x) & top)
                hit = (agree >= matches) & (xc[:, None] != yc[None, :])
                hit &= 100 * np.minimum(xz[:, None], yz[None, :]) >= percent * np.maximum(xz[:, None], yz[None, :])
                found.update((v.as_py(), int(k)) for k in np.concatenate([xn[hit.any(axis=1)], yn[hit.any(axis=0)]]))
            yield pa.record_batch([pa.array([p[i] for p in found], pa.int64()) for i in range(2)], names=["v", "node"])

    return minor.join(every, "v").select("v", "left", "right").mapInArrow(compare, "v long, node long").distinct()


def _block_links(posted: DataFrame, sets: DataFrame, percent: int, work: Workspace) -> DataFrame:
    """Links (a, b) between the different components of each list, by comparing full sets in blocks."""
    rows = work.keep(_split(posted).join(sets.select("node", F.size("items").alias("_size")), "node"), "split")
    own = rows.groupBy("node").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most one per coordinate
    blocks = lambda count, items: F.ceil(F.greatest(count / SET_BLOCK, items / SET_ITEMS)).cast("long")
    number = rows.groupBy("v").agg(
        blocks(F.count("*"), F.sum("_size")).alias("_right"),
        F.greatest(blocks(F.count_if("_minor"), F.sum(F.when(F.col("_minor"), F.col("_size")))), F.lit(0).cast("long")).alias("_left"),
    )
    rows = rows.join(number.filter("_left > 0"), "v")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["v", "node", "comp"]
    left = rows.filter("_minor").select(*cols, F.lit(True).alias("l"), deal("_left").alias("_x"), every("_right").alias("_y"))
    right = rows.select(*cols, F.lit(False).alias("l"), every("_left").alias("_x"), deal("_right").alias("_y"))

    def verify(key, table):
        import pyarrow as pa

        v = key[0].as_py()
        left = table.column("l").to_numpy()
        nodes, comps = table.column("node").to_numpy(), table.column("comp").to_numpy()
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        sizes = table.column("items").combine_chunks().value_lengths().to_numpy()
        common = _shared(table.column("items"), x, y)
        linked = 100 * common >= percent * (sizes[x][:, None] + sizes[y][None, :] - common)
        linked &= comps[x][:, None] != comps[y][None, :]
        linked &= _shared(table.column("vs"), x, y, below=v) == 0  # else an earlier list has the pair
        i, j = np.nonzero(linked)
        a, b = nodes[x[i]], nodes[y[j]]
        return pa.table({"a": np.minimum(a, b).astype("int64"), "b": np.maximum(a, b).astype("int64")})

    placed = left.unionByName(right).join(sets.select("node", "items"), "node").join(own, "node")
    return placed.groupBy("v", "_x", "_y").applyInArrow(verify, "a long, b long").distinct()


def _shared(column, x: np.ndarray, y: np.ndarray, below: int | None = None, width: int = 8192) -> np.ndarray:
    """How many values (under `below`) the lists x of a column share with the lists y, by products of 0-1 matrices."""
    lists = column.combine_chunks()
    values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    if below is not None:
        owner, values = owner[values < below], values[values < below]
    side = np.full(len(lists), -1)
    side[x] = np.arange(len(x))
    in_x = side[owner] >= 0
    both = np.intersect1d(values[in_x], values[~in_x])
    keep = np.isin(values, both, assume_unique=False)
    values, owner, in_x = np.searchsorted(both, values[keep]), owner[keep], in_x[keep]
    place = np.empty(len(lists), "int64")
    place[x], place[y] = np.arange(len(x)), np.arange(len(y))
    out = np.zeros((len(x), len(y)), "int64")
    for a in range(0, len(both), width):
        here = (values >= a) & (values < a + width)
        p, q = np.zeros((len(x), width), "float32"), np.zeros((len(y), width), "float32")
        p[place[owner[here & in_x]], values[here & in_x] - a] = 1
        q[place[owner[here & ~in_x]], values[here & ~in_x] - a] = 1
        out += (p @ q.T).astype("int64")
    return out


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, coordinates: int = COORDINATES, carry: list[str] | None = None) -> DataFrame:
    """One row per document: key, the carried columns, n_shingles, digest, component_id (the least id reachable) and
    kept (whether that is its own). similarity is met by whole percents: 100 * shared >= percent * united."""
    percent = round(100 * similarity)
    matches = least_matches(coordinates, similarity)
    work = Workspace(docs.sparkSession, "neardup")
    carried = [key, *(carry or [])]
    signed = work.keep(signatures(docs, carried, text, width, coordinates), "signatures")
    named = signed.filter(F.col("digest").isNotNull() & F.col(key).isNotNull())
    classes = named.groupBy("digest").agg(F.min(key).alias("rep"), F.first("sig").alias("sig"), F.first("parity").alias("parity"), F.first("n_shingles").alias("n"))
    classes = work.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # skip: only coordinate-value pairs of two classes or more; prefix: the rarest of them
    posts = classes.select("node", F.explode("sig").alias("v"))
    shared = posts.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = posts.join(shared, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs")).filter(F.size("vs") >= matches)
    lists = ranked.select("node", F.explode(F.slice("vs", F.lit(1), F.size("vs") - matches + 1)).alias("s")).select(F.col("s.v").alias("v"), "node").distinct()
    lists = work.keep(lists, "posted")
    lists = work.keep(_open_lists(_posted(lists, None)).select("v", "node"), "lists")
    work.drop("posted")
    packs = work.keep(classes.join(lists.select("node").distinct(), "node").select("node", "n", _packed(F.col("sig"), coordinates).alias("pack")), "packs")
    work.release()
    rows = classes.select("node", "rep", "digest")
    state: dict = {"edges": None, "labels": None, "sets": None, "tested": None}

    def confirm(pairs: DataFrame, name: str) -> None:
        """Test the new pairs on full sets and join the components of those that are similar."""
        met = work.keep(pairs, f"met_{name}")
        ends = work.keep(met.select(F.col("a").alias("node")).union(met.select(F.col("b").alias("node"))).distinct(), f"sides_{name}")
        folds = _among(classes.select("node", "n", "parity"), "node", ends)
        side = lambda c: folds.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_parity"))
        pairs = met.join(side("a"), "a").join(side("b"), "b")
        apart = sum((F.bit_count(F.col("a_parity")[i].bitwiseXOR(F.col("b_parity")[i])) for i in range(FOLDS // 64)), F.lit(0))
        pairs = pairs.filter((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n"))).select("a", "b")
        if state["tested"] is not None:
            pairs = pairs.join(state["tested"], ["a", "b"], "left_anti")
        pairs = work.keep(pairs, f"pairs_{name}")
        work.drop(f"met_{name}", f"sides_{name}")
        work.release()
        if pairs.isEmpty():
            return
        state["tested"] = pairs if state["tested"] is None else state["tested"].union(pairs)
        ends = work.keep(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), f"ends_{name}")
        fetch(ends, name)
        sets = _among(state["sets"], "node", ends)
        items = lambda c: sets.select(F.col("node").alias(c), F.col("items").alias(f"{c}_items"))
        full = pairs.join(items("a"), "a").join(items("b"), "b")
        full = full.withColumn("_common", F.size(F.array_intersect("a_items", "b_items")))
        linked = full.filter(100 * F.col("_common") >= percent * (F.size("a_items") + F.size("b_items") - F.col("_common"))).select("a", "b")
        linked = work.keep(linked, f"edges_{name}")
        work.drop(f"ends_{name}")
        join(linked, name)

    def fetch(nodes: DataFrame, name: str) -> None:
        """Read the full sets of the nodes that have none yet."""
        if state["sets"] is not None:
            nodes = nodes.join(state["sets"].select("node"), "node", "left_anti")
        need = work.keep(nodes.join(rows, "node"), f"need_{name}")
        if not need.isEmpty():
            more = work.keep(_full_sets(docs, key, text, need, width), f"sets_{name}")
            state["sets"] = more if state["sets"] is None else state["sets"].union(more)

    def join(linked: DataFrame, name: str) -> None:
        """Join the components of linked pairs."""
        if not linked.isEmpty():
            state["edges"] = linked if state["edges"] is None else state["edges"].union(linked)
            state["labels"] = components(state["edges"], work, f"comp_{name}")
            work.release()

    def still_open(name: str) -> DataFrame:
        return work.keep(_open_lists(_posted(lists, state["labels"])), f"open_{name}")

    for turn in range(ROUNDS):
        posted = _large(still_open(f"pivots{turn}"))
        if posted.isEmpty():
            break
        confirm(_pivot_pairs(posted, packs, matches, coordinates, percent, turn), f"pivots{turn}")
        work.drop(f"open_pivots{turn}")
    confirm(_list_pairs(still_open("first"), packs, matches, coordinates, percent, True), "first")
    work.drop("open_first")
    posted = still_open("rest")
    confirm(_list_pairs(posted, packs, matches, coordinates, percent, False), "rest")
    work.drop("open_rest")
    posted = _large(still_open("blocks"))
    if not posted.isEmpty():
        colliding = work.keep(_colliding(posted, packs, matches, coordinates, percent, work), "colliding")
        if not colliding.isEmpty():
            fetch(colliding.select("node").distinct(), "blocks")
            met = work.keep(posted.join(colliding, ["v", "node"]).select("v", "node", "comp"), "met")
            join(work.keep(_block_links(met, state["sets"], percent, work), "edges_blocks"), "blocks")
    labels = state["labels"]

    named_by = classes.select("node", "digest", "rep")
    if labels is not None:
        inside = labels.join(classes.select("node", "rep"), "node")
        least = inside.groupBy("comp").agg(F.min("rep").alias("component_id"))
        inside = inside.join(least, "comp").select("node", "component_id")
        named_by = named_by.join(inside, "node", "left").select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    else:
        named_by = named_by.select("digest", F.col("rep").alias("component_id"))
    out = signed.drop("sig", "parity").join(named_by, "digest", "left")
    component = F.when(F.col(key).isNotNull(), F.coalesce("component_id", key))
    return out.select(*carried, "n_shingles", "digest", component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component: the least id, and of repeated rows of it one. Rows with null ids or without
    words stay, as they are linked with nothing."""
    names = docs.columns
    place = {c: f"_{i}" for i, c in enumerate(names)}
    inner = docs.toDF(*place.values()).withColumn("_sum", F.md5(F.coalesce(F.col(place[text]).cast("string"), F.lit("")).cast("binary")))
    found = find(inner, key=place[key], text=place[text], width=width, similarity=similarity, carry=["_sum"])
    linked = found.filter(F.col("digest").isNotNull() & F.col(place[key]).isNotNull())
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col(place[key]).alias("id"), F.col("_sum").alias("sum"))).alias("f"))
    first = first.select(F.col("f.id").alias("_id"), F.col("f.sum").alias("_fsum")).distinct()
    wordless = F.col(place[key]).isNull() | ~F.regexp_like(F.coalesce(F.col(place[text]).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    match = (F.col(place[key]) == F.col("_id")) & (F.col("_sum") == F.col("_fsum"))
    worded = inner.filter(~wordless).join(first, match, "left_semi").dropDuplicates([place[key], "_sum"])
    return inner.filter(wordless).unionByName(worded).select(*[F.col(p).alias(c) for c, p in place.items()])


def oracle(width: int = 2, percent: int = 80) -> str:
    """The same components in SQL, by comparing all documents that share a shingle."""
    upper, words = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x20\x09-\x0D]+"
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(width))
    return f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{words}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT row_id, doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: {gram}) END) AS g FROM texts
), sizes AS (SELECT row_id, count(*) AS n FROM shingles GROUP BY row_id),
shared AS (
  SELECT a.row_id AS x, b.row_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.row_id < b.row_id
  WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.row_id = x JOIN sizes q ON q.row_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT row_id AS x, row_id AS y FROM texts UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x
), least AS (SELECT reach.x AS row_id, min(t.doc_id) AS component_id FROM reach JOIN texts t ON t.row_id = reach.y GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, t.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM texts t JOIN least USING (row_id) LEFT JOIN sizes USING (row_id)
"""
