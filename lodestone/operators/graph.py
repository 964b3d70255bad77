"""Graphs from co-occurrence: edges, degrees, components, label propagation, betweenness, splitting by modularity."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.similarity import overlapping_sets
from lodestone.plans.workspace import Workspace

#: Splitting by betweenness works on a graph of at most so many edges, in one process.
SPLIT_EDGES = 200_000
ROOTS = 64


def co_occurrence_edges(pairs: DataFrame, least: int) -> DataFrame:
    """u < v, common: users of at least `least` rows that share at least so many distinct items. pairs: user_id, item_id."""
    users = pairs.filter("user_id IS NOT NULL").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"), F.collect_set("item_id").alias("items"))
    return overlapping_sets(users.filter(F.col("n") >= least).select("key", "items"), least).select(F.col("a").alias("u"), F.col("b").alias("v"), "common")


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst in either direction, distinct, without loops."""
    one = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    return one.union(one.select(F.col("dst"), F.col("src"))).filter("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree."""
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """id, component: its least vertex.

    Each step hooks every component onto its least neighbour, shortens the paths and goes on with the edges that still
    join different ones, so the steps are logarithmic in practice; each is written, so lineage stays short.
    """
    work = Workspace(edges.sparkSession, "components")
    left = work.keep(both_ways(edges), "edges")
    labels = left.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    step = 0
    while True:
        hook = work.keep(left.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("up")), f"hook{step}")
        for _ in range(2):
            above = hook.select(F.col("src").alias("_m"), F.col("up").alias("_top"))
            hook = hook.join(above, F.col("up") == F.col("_m"), "left").select("src", F.coalesce("_top", "up").alias("up"))
        hook = work.keep(hook, f"jump{step}")
        labels = work.keep(labels.join(hook.withColumnRenamed("src", "component"), "component", "left").select("id", F.coalesce("up", "component").alias("component")), f"labels{step}")
        ends = lambda c: hook.select(F.col("src").alias(c), F.col("up").alias(f"{c}_up"))
        left = left.join(ends("src"), "src").join(ends("dst"), "dst").select(F.col("src_up").alias("src"), F.col("dst_up").alias("dst")).filter("src <> dst").distinct()
        left = work.keep(left, f"left{step}")
        if left.isEmpty():
            return labels
        step += 1


def communities(labels: DataFrame, label: str) -> DataFrame:
    """members: sorted arrays of the ids that share a label."""
    return labels.groupBy(label).agg(F.array_sort(F.collect_list("id")).alias("members")).select("members")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label after synchronous rounds in which every vertex takes its neighbours' most frequent label, the least of
    equally frequent ones."""
    work = Workspace(edges.sparkSession, "labels")
    links = work.keep(both_ways(edges), "edges")
    labels = links.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for i in range(rounds):
        votes = links.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
        labels = work.keep(best.select(F.col("src").alias("id"), "label"), f"round{i}")
    return labels


def credits(neighbours: dict, root) -> dict:
    """Each edge's share of the shortest paths from root: counted outwards, handed back inwards."""
    level, paths, order, before = {root: 0}, {root: 1}, [], defaultdict(list)
    queue = deque([root])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in neighbours[v]:
            if w not in level:
                level[w], paths[w] = level[v] + 1, 0
                queue.append(w)
            if level[w] == level[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    out, gained = {}, dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before[w]:
            share = paths[v] / paths[w] * (1 + gained[w])
            out[(v, w) if v < w else (w, v)] = share
            gained[v] += share
    return out


def edge_betweenness(edges: DataFrame, roots: int = ROOTS) -> DataFrame:
    """u < v, betweenness. Blocks of roots are spread over the cluster, each with the edges of its component; a
    component's edges must fit in a worker."""
    kind = dict(edges.dtypes)["u"]
    links = both_ways(edges)
    labels = components(edges)
    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / roots).alias("blocks"))
    placed = labels.join(sizes, "component")
    starts = placed.select(F.col("component").alias("c"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("k"), "id")
    inside = links.filter("src < dst").join(placed.withColumnRenamed("id", "src"), "src")
    inside = inside.select(F.col("component").alias("c2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k2"), "src", "dst")

    def walk(starts: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        neighbours = defaultdict(list)
        for a, b in sorted(zip(links["src"], links["dst"])):
            neighbours[a].append(b)
            neighbours[b].append(a)
        total: dict = defaultdict(float)
        for root in sorted(starts["id"]):
            for edge, share in credits(neighbours, root).items():
                total[edge] += share
        return pd.DataFrame([(a, b, x) for (a, b), x in total.items()], columns=["u", "v", "part"])

    parts = starts.groupBy("c", "k").cogroup(inside.groupBy("c2", "k2")).applyInPandas(walk, f"u {kind}, v {kind}, part double")
    return parts.groupBy("u", "v").agg((F.sum("part") / 2).alias("betweenness"))


def _split(neighbours: dict) -> list[list]:
    seen, out = set(), []
    for v in sorted(neighbours):
        if v not in seen:
            part, queue = {v}, [v]
            while queue:
                for w in neighbours[queue.pop()]:
                    if w not in part:
                        part.add(w)
                        queue.append(w)
            seen |= part
            out.append(sorted(part))
    return out


def modularity(parts: list[list], adjacency: dict, degree: dict, m: int) -> float:
    """Over all ordered pairs inside the parts, i = i included: adjacency minus the expected share."""
    inside = sum(len(adjacency[v]) for part in parts for v in part)  # neighbours lie in the same part
    return (inside - sum(sum(degree[v] for v in part) ** 2 for part in parts) / (2 * m)) / (2 * m)


def split_by_betweenness(edges: list[tuple], original: bool = False) -> list[list]:
    """Communities of a small graph: all edges of the greatest betweenness go, again and again; of the partitions on the
    way the last of the greatest modularity is taken. Modularity counts the edges that are left (original: the given
    ones) against the given degrees. The unsplit graph is not scored; no edges give no communities."""
    neighbours: dict = defaultdict(set)
    for a, b in edges:
        if a != b:
            neighbours[a].add(b)
            neighbours[b].add(a)
    given = {v: set(ws) for v, ws in neighbours.items()}
    degree, m = {v: len(ws) for v, ws in given.items()}, sum(map(len, given.values())) // 2
    best, found = -1.0, []
    shares: dict = {}
    stale = set(neighbours)
    while any(neighbours.values()):
        shares = {e: x for e, x in shares.items() if e[0] not in stale}
        again: dict = defaultdict(float)
        ordered = {v: sorted(neighbours[v]) for v in stale}
        for root in sorted(stale):
            for edge, share in credits(ordered, root).items():
                again[edge] += share / 2
        shares |= again
        top = max(shares.values())
        cut = [e for e, x in shares.items() if x >= top - 1e-9 * max(1.0, top)]
        touched = {v for e in cut for v in e}
        stale = {v for part in _split(neighbours) if touched & set(part) for v in part}
        for a, b in cut:
            neighbours[a].discard(b)
            neighbours[b].discard(a)
        parts = _split(neighbours)
        if original:
            at = {v: i for i, p in enumerate(parts) for v in p}
            adjacency = {v: [w for w in given[v] if at[w] == at[v]] for v in given}
        else:
            adjacency = neighbours
        q = modularity(parts, adjacency, degree, m)
        if q >= best - 1e-12:
            best, found = max(q, best), parts
    return found


def girvan_newman(edges: DataFrame, original: bool = False) -> DataFrame:
    """members: communities of a graph of at most SPLIT_EDGES edges (counted first)."""
    some = edges.select("u", "v").distinct().limit(SPLIT_EDGES + 1).collect()
    if len(some) > SPLIT_EDGES:
        raise ValueError(f"over {SPLIT_EDGES} edges; split components or use label_propagation")
    kind = dict(edges.dtypes)["u"]
    parts = split_by_betweenness([(r["u"], r["v"]) for r in some], original)
    return edges.sparkSession.createDataFrame([(p,) for p in parts], f"members array<{kind}>")
