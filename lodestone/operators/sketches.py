"""Stream sketches over a bounded stream (seq, batch_id, id): Bloom filter, distinct estimates, uniform samples.

The sequential definitions are restated as aggregates, so that no row waits for the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.hashing import Hash, family, trailing_zeros

# Bits and functions of the Bloom filter; functions, range and groups of the distinct estimate; sample size.
BLOOM_BITS, BLOOM_HASHES = 69997, 10
FM_HASHES, FM_RANGE, FM_GROUPS = 200, 600, 4
SAMPLE = 100


def bloom_family(seed: int = 5) -> list[Hash]:
    return family(BLOOM_HASHES, BLOOM_BITS, seed)


def fm_family(seed: int = 17) -> list[Hash]:
    return family(FM_HASHES, FM_RANGE, seed)


def bloom_outcomes(stream: DataFrame, hashes: list[Hash], x: Column | None = None) -> DataFrame:
    """seq, batch_id, id, seen (the id came before), positive (the filter says so, asked before the id is put in).

    A bit is set from the first seq whose id maps to it. An id at seq is positive if the latest of its bits' firsts is
    before seq. The bits are at most as many as the filter has, so their table is broadcast.
    """
    x = F.col("id") if x is None else x
    bits = stream.select("seq", "batch_id", "id", F.explode(F.array_distinct(F.array(*[h.of(x) for h in hashes]))).alias("bit"))
    firsts = bits.groupBy("bit").agg(F.min("seq").alias("first"))  # at most BLOOM_BITS rows
    latest = bits.join(F.broadcast(firsts), "bit").groupBy("seq", "batch_id", "id").agg(F.max("first").alias("set_at"))
    met = stream.groupBy("id").agg(F.min("seq").alias("met"))
    return latest.join(met, "id").select("seq", "batch_id", "id", (F.col("met") < F.col("seq")).alias("seen"), (F.col("set_at") < F.col("seq")).alias("positive"))


def bloom_rates(stream: DataFrame, hashes: list[Hash], x: Column | None = None) -> DataFrame:
    """batch_id, fpr: false positives among the ids of a batch not seen before; null if there is none."""
    out = bloom_outcomes(stream, hashes, x)
    return out.groupBy("batch_id").agg(F.try_divide(F.count_if(~F.col("seen") & F.col("positive")).cast("double"), F.count_if(~F.col("seen")).cast("double")).alias("fpr"))


def distinct_truth(stream: DataFrame) -> DataFrame:
    """batch_id, truth."""
    return stream.groupBy("batch_id").agg(F.count_distinct("id").alias("truth"))


def distinct_estimate(stream: DataFrame, hashes: list[Hash], groups: int = FM_GROUPS, x: Column | None = None) -> DataFrame:
    """batch_id, estimate: two to the most trailing zeros per function, averaged in groups, the groups' median cut to a
    whole number. A batch's state is one number per function, combined before the shuffle; the functions are rows of a
    constant, so that the plan does not grow with them."""
    x = (F.col("id") if x is None else x).cast("long")
    number = lambda v: F.lit(v).cast("long")
    drawn = F.array(*[F.struct(number(i).alias("i"), number(h.a).alias("a"), number(h.b).alias("b"), number(h.p).alias("p"), number(h.m).alias("m")) for i, h in enumerate(hashes)])
    hashed = F.pmod(F.pmod(F.pmod(F.col("x"), F.col("f.p")) * F.col("f.a") + F.col("f.b"), F.col("f.p")), F.col("f.m"))
    zeros = stream.select("batch_id", x.alias("x"), F.explode(drawn).alias("f")).select("batch_id", F.col("f.i").alias("i"), trailing_zeros(hashed).alias("z"))
    most = zeros.groupBy("batch_id", "i").agg(F.max("z").alias("z"))
    size = len(hashes) // groups
    means = most.filter(F.col("i") < groups * size).groupBy("batch_id", F.floor(F.col("i") / size).alias("part")).agg((F.sum(F.pow(F.lit(2.0), F.col("z"))) / size).alias("mean"))
    ranked = means.groupBy("batch_id").agg(F.sort_array(F.collect_list("mean")).alias("r"))  # one number per group
    middle = (F.element_at("r", (groups + 1) // 2) + F.element_at("r", groups // 2 + 1)) / 2
    return ranked.select("batch_id", F.floor(middle).cast("long").alias("estimate"))


def priority(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def uniform_sample(stream: DataFrame, size: int = SAMPLE, seed: int = 553) -> DataFrame:
    """seq, id of the `size` rows of least priority: a uniform sample that can be merged, each task keeps `size` rows."""
    return stream.select("seq", "id", priority(seed, "id", "seq").alias("priority")).orderBy("priority", "seq").limit(size)
