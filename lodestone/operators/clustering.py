"""Clustering: K-means, diagonal Mahalanobis distance, and bounded-memory clustering over chunks (BFR)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.workspace import Workspace

SEED, CHUNKS, SPREAD = 42, 5, 5
#: Added to variances, so that a cluster of equal values divides by no zero.
FLOOR = 1e-9


def kmeans(points: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """index, features, cluster. With fewer points than k every point is a cluster of its own."""
    if points.limit(k).count() < k:
        return points.select("index", "features", F.col("index").alias("cluster"))
    vectors = points.select("index", "features", array_to_vector("features").alias("vector"))
    model = KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).select("index", "features", F.col("cluster").cast("long").alias("cluster"))


def cluster_statistics(points: DataFrame, by: str) -> DataFrame:
    """by, dimension, n, total, squares: element-wise sums per cluster, combined before the shuffle."""
    long = points.select(by, F.posexplode("features").alias("dimension", "x"))
    return long.groupBy(by, "dimension").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") ** 2).alias("squares"))


@dataclass
class Summary:
    """A cluster without its points."""

    n: float
    total: np.ndarray
    squares: np.ndarray
    ids: tuple = field(default_factory=tuple)

    @property
    def centre(self) -> np.ndarray:
        return self.total / self.n

    @property
    def deviation(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares / self.n - self.centre**2, 0) + FLOOR)

    def merged(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.total + other.total, self.squares + other.squares, self.ids + other.ids)


def mahalanobis(x: np.ndarray, s: Summary) -> np.ndarray:
    """Distance of each row of x from a cluster, its dimensions taken as independent."""
    return np.sqrt((((np.atleast_2d(x) - s.centre) / s.deviation) ** 2).sum(axis=1))


def summaries(points: DataFrame, by: str = "cluster") -> dict[int, Summary]:
    """Summaries by cluster; the number of clusters is a parameter of what made them."""
    rows = cluster_statistics(points, by).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("dimension", "n", "total", "squares"))).alias("d")).collect()
    return {r[by]: Summary(r["d"][0]["n"], np.array([x["total"] for x in r["d"]]), np.array([x["squares"] for x in r["d"]])) for r in rows}


def nearest(points: DataFrame, clusters: dict[int, Summary], reach: float) -> DataFrame:
    """index, features, cluster: the nearest cluster within reach, null if none. The summaries go to the workers."""
    names = sorted(clusters)
    schema = "index long, features array<double>, cluster long"

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array(pdf["features"].tolist(), dtype="float64")
            out: list = [None] * len(x)
            if names:
                d = np.stack([mahalanobis(x, clusters[c]) for c in names], axis=1)
                at = d.argmin(axis=1)
                out = [names[j] if d[i, j] < reach else None for i, j in enumerate(at)]
            yield pd.DataFrame({"index": pdf["index"], "features": pdf["features"], "cluster": pd.array(out, dtype="Int64")})

    return points.select("index", "features").mapInPandas(assign, schema)


def merge_near(clusters: dict[int, Summary], reach: float) -> tuple[dict[int, Summary], dict[int, int]]:
    """Join the closest two clusters (by the mean of both distances, ties by number) until none are within reach; what
    is left, and where each cluster has gone."""
    clusters, gone = dict(clusters), {}
    while True:
        names = sorted(clusters)
        found = [((mahalanobis(clusters[a].centre, clusters[b])[0] + mahalanobis(clusters[b].centre, clusters[a])[0]) / 2, a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        d, a, b = min(found, default=(math.inf, 0, 0))
        if d >= reach:
            return clusters, {x: _last(gone, x) for x in gone}
        clusters[b] = clusters.pop(a).merged(clusters[b])
        gone[a] = b


def _last(gone: dict, x: int) -> int:
    while x in gone:
        x = gone[x]
    return x


def bfr(points: DataFrame, k: int, chunks: int = CHUNKS, spread: int = SPREAD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """rounds (round, n_discard, n_compression_clusters, n_compression_points, n_retained) and assignments (index, cluster;
    -1 for outliers).

    The points are dealt into chunks by a hash. The first chunk makes the discard set's k clusters from what `spread * k`
    clusters do not leave as single points; the rest is clustered into the compression set, single points are retained.
    Later chunks join the nearest discard cluster within 2 sqrt(d), else the nearest compression cluster, else are
    retained and clustered again; near compression clusters merge, in the end into discard clusters. Between chunks only
    summaries are on the driver, at most k and spread * k of each chunk; points stay in tables.
    """
    spark = points.sparkSession
    work = Workspace(spark, "bfr")
    dealt = work.keep(points.select(F.col("index").cast("long"), "features").withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "index"), F.lit(chunks))), "points")
    first = dealt.select(F.size("features").alias("d")).first()
    nothing = "index long, features array<double>, cluster long"
    if first is None:
        return spark.createDataFrame([], "round int, n_discard long, n_compression_clusters long, n_compression_points long, n_retained long"), spark.createDataFrame([], "index long, cluster long")
    reach = 2 * math.sqrt(first["d"])
    discard: dict[int, Summary] = {}
    compression: dict[int, Summary] = {}
    gone: dict[int, int] = {}
    held: list[DataFrame] = []  # index, set (D or C), cluster
    retained = spark.createDataFrame([], nothing).select("index", "features")
    fresh, rounds = 0, []

    def add(into: dict, found: dict) -> None:
        for c, s in found.items():
            into[c] = into[c].merged(s) if c in into else s

    def recluster(rows: DataFrame, name: str) -> DataFrame:
        """Retained points into compression clusters of two points or more; what stays single."""
        nonlocal fresh
        if rows.isEmpty():
            return rows
        grouped = work.keep(kmeans(rows, spread * k, seed), f"{name}_kmeans")
        sizes = grouped.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").orderBy("cluster").collect()  # at most spread * k rows
        if not sizes:
            return rows
        numbers = spark.createDataFrame([(r["cluster"], fresh + i) for i, r in enumerate(sizes)], "cluster long, number long")
        fresh += len(sizes)
        joined = work.keep(grouped.join(F.broadcast(numbers), "cluster").select("index", "features", F.col("number").alias("cluster")), f"{name}_joined")
        add(compression, summaries(joined))
        held.append(joined.select("index", F.lit("C").alias("set"), "cluster"))
        return work.keep(grouped.join(F.broadcast(numbers), "cluster", "left_anti").select("index", "features"), f"{name}_single")

    for turn in range(chunks):
        chunk = dealt.filter(F.col("chunk") == turn).select("index", "features")
        if chunk.isEmpty():
            left = None
        elif not discard:
            rough = work.keep(kmeans(chunk, spread * k, seed), f"rough{turn}")
            lone = rough.groupBy("cluster").agg(F.count("*").alias("n")).filter("n = 1").select("cluster")
            main = work.keep(rough.join(lone, "cluster", "left_anti").select("index", "features"), f"main{turn}")
            if main.isEmpty():
                left = chunk
            else:
                found = work.keep(kmeans(main, k, seed), f"discard{turn}")
                add(discard, summaries(found))
                held.append(found.select("index", F.lit("D").alias("set"), "cluster"))
                left = rough.join(lone, "cluster", "left_semi").select("index", "features")
        else:
            met = work.keep(nearest(chunk, discard, reach), f"near{turn}")
            inside = met.filter("cluster IS NOT NULL")
            other = work.keep(nearest(met.filter("cluster IS NULL"), compression, reach), f"other{turn}")
            near = other.filter("cluster IS NOT NULL")
            add(discard, summaries(inside))
            add(compression, summaries(near))
            held += [inside.select("index", F.lit("D").alias("set"), "cluster"), near.select("index", F.lit("C").alias("set"), "cluster")]
            left = other.filter("cluster IS NULL").select("index", "features")
        if left is not None:
            retained = work.keep(recluster(work.keep(retained.unionByName(left), f"left{turn}"), f"again{turn}"), f"retained{turn}")
        compression, moved = merge_near(compression, reach)
        gone |= moved
        if turn == chunks - 1 and discard:
            final = {}
            for c, s in sorted(compression.items()):
                d, at = min(((mahalanobis(s.centre, x)[0] + mahalanobis(x.centre, s)[0]) / 2, i) for i, x in discard.items())
                if d < reach:
                    final[c] = at
                    discard[at] = discard[at].merged(s)
            compression = {c: s for c, s in compression.items() if c not in final}
        rounds.append((turn + 1, int(sum(s.n for s in discard.values())), len(compression), int(sum(s.n for s in compression.values())), retained.count()))

    final = final if discard else {}
    lands = [(c, final.get(_last(gone, c), -1)) for c in range(fresh)]
    target = spark.createDataFrame(lands or [(-1, -1)], "cluster long, target long")
    placed = held[0]
    for df in held[1:]:
        placed = placed.unionByName(df)
    kept = placed.filter("set = 'D'").select("index", "cluster")
    moved = placed.filter("set = 'C'").join(F.broadcast(target), "cluster").select("index", F.col("target").alias("cluster"))
    out = kept.unionByName(moved).unionByName(retained.select("index", F.lit(-1).cast("long").alias("cluster")))
    table = spark.createDataFrame(rounds, "round int, n_discard long, n_compression_clusters long, n_compression_points long, n_retained long")
    return table, out
