"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output over its share of the input. A document's
number of copies is a Poisson variable of that mean, drawn by inverting the distribution at a hash of seed and id; the
document is exploded by its count and the copies are shuffled globally by a hash of seed, id and copy.

A mean over BLOCK is drawn as the sum of equal independent parts, each from its own hash, which has the same
distribution and keeps every inversion short and free of underflow.

Defined results: a null source is a source of its own; a null id draws as the text 'null'. Repeated rows draw the same
count and yield their copies side by side; ties in the shuffle key only leave their mutual order open. An empty table
gives an empty one. A source without a target weight gets rate 0. Extra columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Workspace, hash_fraction, size_checked

SEED, TEMPERATURE = "mix-1", 0.5
BLOCK = 16.0
#: Copies of one row that one array holds at most; more take several arrays.
COPIES = 1024


def rates_by_temperature(docs: DataFrame, source: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """source, n, rate: target weights n ** temperature, and as many documents expected as there are."""
    sizes = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"), F.sum(F.pow(F.col("n").cast("double"), F.lit(temperature))).alias("weights"))
    # weights are summed in an order that varies, so the rate is rounded to what all orders agree on
    rate = F.pow(F.col("n").cast("double"), F.lit(temperature)) / F.col("weights") * F.col("all") / F.col("n")
    return sizes.join(F.broadcast(total)).select("source", "n", F.round(rate, 9).alias("rate"))


def rates_by_weights(docs: DataFrame, weights: dict[str | None, float], source: str = "source", size: float = 1.0) -> DataFrame:
    """source, n, rate for given target weights; the output is expected to hold `size` times the documents."""
    sizes = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("n"))
    wanted = docs.sparkSession.createDataFrame([(k, float(v) / sum(weights.values())) for k, v in weights.items()], "source string, share double")
    total = sizes.agg(F.sum("n").alias("all"))
    met = sizes.alias("s").join(F.broadcast(wanted).alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left").join(F.broadcast(total))
    return met.select("s.source", "n", F.round(F.coalesce("share", F.lit(0.0)) * size * F.col("all") / F.col("n"), 9).alias("rate"))


def poisson(rate: Column, key: Column, seed: str = SEED) -> Column:
    """A Poisson count of mean rate: the least k whose distribution function exceeds the key's hash fraction."""
    parts = F.greatest(F.ceil(rate / BLOCK), F.lit(1)).cast("int")

    def invert(mean, u):
        # 53 bits of u meet at most mean + 12 deviations + 30 terms
        reach = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
        return F.aggregate(
            F.sequence(F.lit(1), reach),
            F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("term"), F.exp(-mean).alias("sum")),
            lambda a, i: F.when(
                a["sum"] <= u,
                F.struct(i.alias("k"), (a["term"] * mean / i).alias("term"), (a["sum"] + a["term"] * mean / i).alias("sum")),
            ).otherwise(a),
            lambda a: a["k"].cast("long"),
        )

    first = hash_fraction(key, seed)
    more = lambda j: hash_fraction(F.concat(j.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit("null"))), seed)
    mean = rate / parts
    rest = F.when(
        parts > 1,
        F.aggregate(F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))), F.lit(0).cast("long"), lambda a, j: a + invert(mean, more(j))),
    ).otherwise(F.lit(0).cast("long"))
    return invert(mean, first) + rest


def mix(docs: DataFrame, rates: DataFrame | None = None, *, key: str = "doc_id", source: str = "source", seed: str = SEED, details: bool = False) -> DataFrame:
    """docs with each row as often as its count says, shuffled globally.

    rates: source, rate; by default rates_by_temperature. details adds copy (from 0), copies, rate and shuffle_key, in
    place of input columns of these names. The rates (a row per source) meet the documents without a shuffle if few,
    and otherwise by a join whose hot sources Spark splits; the only shuffle of texts is the global one.
    """
    work = Workspace(docs.sparkSession, "mixing")
    rates = rates if rates is not None else rates_by_temperature(docs.select(F.col(source).alias("source")))
    rates = size_checked(work.keep(rates.select(F.col("source").alias("_s"), F.col("rate").alias("_rate")), "rates"))
    names = docs.columns
    place = {c: f"_{i}" for i, c in enumerate(names)}
    found = docs.toDF(*place.values())
    found = found.join(rates, F.col(place[source]).cast("string").eqNullSafe(F.col("_s")), "left").drop("_s")
    found = found.withColumn("_copies", poisson(F.coalesce("_rate", F.lit(0.0)), F.col(place[key]), seed)).filter("_copies > 0")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES))
    found = found.withColumn("_block", F.explode(F.transform(blocks, lambda b: b * COPIES)))
    found = found.withColumn("_copy", F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + COPIES, F.col("_copies")) - 1)))
    spread = F.concat(F.lit(f"{seed}:"), F.col("_copy").cast("string"), F.lit(":"), F.coalesce(F.col(place[key]).cast("string"), F.lit("null")))
    found = found.withColumn("_key", F.md5(spread)).repartition(F.col("_key")).sortWithinPartitions("_key")
    if not details:
        return found.select(*[F.col(p).alias(c) for c, p in place.items()])
    own = {"copy": "_copy", "copies": "_copies", "rate": "_rate", "shuffle_key": "_key"}
    return found.select(*[F.col(p).alias(c) for c, p in place.items() if c not in own], *[F.col(p).alias(c) for c, p in own.items()])


def oracle(seed: str = SEED, temperature: float = TEMPERATURE) -> str:
    """The same copies in SQL."""
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, n, round(pow(n::DOUBLE, {temperature!r}) / (SELECT sum(pow(n::DOUBLE, {temperature!r})) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n, 9) AS rate FROM sizes
), drawn AS (
  SELECT row_number() OVER () AS row_id, d.doc_id, d.source, d.text, r.rate, greatest(ceil(r.rate / {BLOCK!r}), 1)::INTEGER AS parts
  FROM documents d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source
), parts AS (
  SELECT row_id, part, rate / parts AS mean,
    ('0x' || substr(md5('{seed}:' || CASE WHEN part > 0 THEN part || ':' ELSE '' END || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, unnest(range(0, parts)) AS part FROM drawn)
), steps AS (
  SELECT row_id, part, mean, u, 0 AS k, exp(-mean) AS term, exp(-mean) AS total FROM parts
  UNION ALL
  SELECT row_id, part, mean, u, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) FROM steps WHERE total <= u AND k < ceil(mean + 12 * sqrt(mean) + 30)
), counts AS (
  SELECT row_id, sum(k)::BIGINT AS copies FROM (SELECT row_id, part, max(k) AS k FROM steps GROUP BY row_id, part) GROUP BY row_id
)
SELECT doc_id, source, text, copy, copies, rate, md5('{seed}:' || copy || ':' || coalesce(doc_id::VARCHAR, 'null')) AS shuffle_key
FROM (SELECT d.*, copies, unnest(range(0, copies)) AS copy FROM drawn d JOIN counts USING (row_id))
"""
