"""Frequent itemsets over baskets: level-wise A-Priori by joins, and two-phase SON by partitions."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.workspace import Workspace

#: Baskets that one task of the first phase holds in memory, at most on average.
BASKETS = 200_000


def retail_baskets(rows: DataFrame, least: int) -> DataFrame:
    """basket (date-customer), item (product id as text) of baskets with more than `least` distinct products."""
    pairs = rows.select(F.concat_ws("-", "date", F.col("customer_id").cast("string")).alias("basket"), F.col("product_id").cast("string").alias("item")).distinct()
    return larger_than(pairs, least)


def larger_than(baskets: DataFrame, least: int) -> DataFrame:
    """Baskets with more than `least` distinct items."""
    large = baskets.groupBy("basket").agg(F.count_distinct("item").alias("n")).filter(F.col("n") > least).select("basket")
    return baskets.join(large, "basket", "left_semi")


def frequent_itemsets(baskets: DataFrame, support: float, most: int | None = None) -> DataFrame:
    """items (sorted array), n: all itemsets (of up to `most` items, if given) in at least `support` baskets. Exact.

    baskets: basket, item. Every level keeps where its frequent sets occur (basket, items). Two of them in one basket
    that agree but for their last item make a set of one more, so that only sets with two frequent subsets are formed,
    each where it occurs, and nothing is joined across baskets. The loop ends at the first empty level; a level's
    occurrences are a written table, dropped when the next one is.
    """
    work = Workspace(baskets.sparkSession, "itemsets")
    pairs = baskets.select("basket", "item").filter(F.col("basket").isNotNull() & F.col("item").isNotNull()).distinct()
    grown = pairs.select("basket", F.array("item").alias("items"))
    out, size = None, 1
    while True:
        grown = work.keep(grown, f"grown{size}")
        level = work.keep(grown.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= support), f"level{size}")
        if out is not None and level.isEmpty():
            return out
        out = level if out is None else out.unionByName(level)
        if size == most:
            return out
        held = grown.join(level.select("items"), "items", "left_semi")
        held = held.select("basket", F.slice("items", F.lit(1), F.lit(size - 1)).alias("head"), F.element_at("items", -1).alias("last"))
        held = work.keep(held, f"held{size}")
        work.drop(f"grown{size}", *([f"held{size - 1}"] if size > 1 else []))
        a, b = held.alias("a"), held.alias("b")
        met = (F.col("a.basket") == F.col("b.basket")) & (F.col("a.head") == F.col("b.head")) & (F.col("a.last") < F.col("b.last"))
        grown = a.join(b, met).select("a.basket", F.concat("a.head", F.array("a.last", "b.last")).alias("items"))
        size += 1


def itemsets_of(baskets: list[list], support: float) -> list[tuple]:
    """A-Priori over baskets in memory, by growing item lists of baskets; with support at or under 1, one basket is enough."""
    where: dict[tuple, set[int]] = defaultdict(set)
    for i, basket in enumerate(baskets):
        for x in set(basket):
            where[x,].add(i)
    level = {s: w for s, w in where.items() if len(w) >= support}
    found: list[tuple] = []
    while level:
        found += level
        names = sorted(level)
        heads: dict[tuple, list] = defaultdict(list)
        for s in names:
            heads[s[:-1]].append(s[-1])
        following = {}
        for head, lasts in heads.items():
            for a, b in combinations(lasts, 2):
                s = (*head, a, b)
                if all(s[:i] + s[i + 1 :] in level for i in range(len(s) - 2)):
                    both = level[(*head, a)] & level[(*head, b)]
                    if len(both) >= support:
                        following[s] = both
        level = following
    return found


def son_candidates(baskets: DataFrame, support: float, partitions: int) -> DataFrame:
    """items: the distinct sets that are frequent in some partition at the threshold scaled to its share of the baskets
    (not rounded). A superset of the frequent sets; which more there are depends on the partitions, of which there are
    `partitions` at least and more if one would hold over BASKETS baskets."""
    grouped = baskets.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))
    grouped = Workspace(baskets.sparkSession, "son").keep(grouped, "baskets")
    total = grouped.count()

    def local(batches):
        import pandas as pd

        mine = [list(x) for pdf in batches for x in pdf["items"]]
        if mine:
            yield pd.DataFrame({"items": [list(s) for s in itemsets_of(mine, support * len(mine) / total)]})

    return grouped.select("items").repartition(max(partitions, math.ceil(total / BASKETS))).mapInPandas(local, "items array<string>").distinct()


def son(baskets: DataFrame, support: float, partitions: int) -> tuple[DataFrame, DataFrame]:
    """Candidates and frequent itemsets (items, n), the candidates counted exactly over all baskets.

    Candidates meet the baskets on their rarest item and are kept if the rest is contained, so that an item that is in
    most baskets brings only the sets in which no other is rarer.
    """
    work = Workspace(baskets.sparkSession, "son")
    candidates = work.keep(son_candidates(baskets, support, partitions), "candidates")
    pairs = work.keep(baskets.select("basket", "item").distinct(), "pairs")
    often = pairs.groupBy("item").agg(F.count("*").alias("df"))
    rarest = candidates.select("items", F.explode("items").alias("item")).join(often, "item").groupBy("items").agg(F.min(F.struct("df", "item")).alias("r"))
    sets = rarest.select("items", F.col("r.item").alias("item"))
    grouped = pairs.groupBy("basket").agg(F.collect_set("item").alias("held")).select("held", F.explode("held").alias("item"))
    met = grouped.join(sets, "item").filter(F.size(F.array_except("items", "held")) == 0)
    return candidates, met.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= support)


def counts_by_size(itemsets: list[tuple]) -> dict[int, int]:
    return dict(Counter(map(len, itemsets)))


def minimum_share(support: int, baskets: int) -> float:
    """A support count as the share that FP-growth wants, a little lower so that rounding loses nothing."""
    return max(0.0, math.nextafter(support / max(1, baskets), 0))
