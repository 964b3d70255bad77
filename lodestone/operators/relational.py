"""Counts, distincts, averages, top-k, anti-joins, partition reports."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 10


def exploration_report(reviews: DataFrame, year: int, user: str = "user_id", item: str = "item_id", date: str = "date") -> DataFrame:
    """One row: n_review, n_review_year, n_user, n_business, top10_user, top10_business."""
    metrics = reviews.agg(F.count("*").alias("n_review"), F.count_if(F.year(date) == year).alias("n_review_year"), F.count_distinct(user).alias("n_user"), F.count_distinct(item).alias("n_business"))
    tops = [_top_array(reviews, c, name) for c, name in ((user, "top10_user"), (item, "top10_business"))]
    return metrics.join(F.broadcast(tops[0])).join(F.broadcast(tops[1]))  # one row each


def _top_array(df: DataFrame, key: str, name: str) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(key).alias("id"))))
    return top_groups(df, key).agg(F.transform(ranked, lambda x: F.struct(x["id"].alias("id"), (-x["minus"]).alias("count"))).alias(name))


def group_counts(df: DataFrame, key: str) -> DataFrame:
    """key, n. Counts are combined before the shuffle."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def top_groups(df: DataFrame, key: str, k: int = TOP) -> DataFrame:
    """The k largest groups, ties by key."""
    return group_counts(df, key).orderBy(F.desc("n"), key).limit(k)


def group_average(df: DataFrame, key: str, value: str, digits: int | None = None) -> DataFrame:
    """key, the value's average under its own name. Null and empty keys are dropped for text keys."""
    if dict(df.dtypes)[key] == "string":
        df = df.filter(F.length(key) > 0)
    mean = F.avg(value)
    return df.groupBy(key).agg((F.round(mean, digits) if digits is not None else mean).alias(value))


def top_average(df: DataFrame, key: str, value: str, k: int = TOP, digits: int | None = None) -> DataFrame:
    """The k groups with the greatest average, ties by key: a bounded heap in each task, no full sort."""
    return group_average(df, key, value, digits).orderBy(F.desc(value), key).limit(k)


def top_average_on_driver(df: DataFrame, key: str, value: str, k: int = TOP, digits: int | None = None) -> list[tuple]:
    """The same groups by sorting all averages on the driver; one row a group must fit there. For comparison."""
    rows = group_average(df, key, value, digits).collect()
    return sorted(((r[key], r[value]) for r in rows), key=lambda r: (-r[1], r[0]))[:k]


def timing_report(df: DataFrame, key: str, value: str, digits: int | None = 6) -> dict:
    """m1, m2: the top groups by a sort on the driver and on the cluster; m1_time, m2_time: seconds that each took."""
    on_driver, m1 = timed(lambda: top_average_on_driver(df, key, value, digits=digits))
    on_cluster, m2 = timed(lambda: [tuple(r) for r in top_average(df, key, value, digits=digits).collect()])
    return {"m1": on_driver, "m2": on_cluster, "m1_time": m1, "m2_time": m2}


def timed(action) -> tuple[object, float]:
    """What an action returns, and the seconds it took."""
    begun = time.perf_counter()
    out = action()
    return out, time.perf_counter() - begun


def partition_sizes(df: DataFrame, key: str | None = None, n: int | None = None) -> DataFrame:
    """partition, n_items for every partition, empty ones too; with key and n after dealing the rows out by key."""
    dealt = df.repartition(n, key) if key is not None else df
    count = n if key is not None else dealt.rdd.getNumPartitions()
    sizes = dealt.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))
    every = df.sparkSession.range(count).select(F.col("id").cast("int").alias("partition"))
    return every.join(sizes, "partition", "left").select("partition", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))


def partition_report(df: DataFrame, key: str, n: int) -> dict:
    """default and customized: number of partitions, their sizes, and the seconds that the top groups took on each."""
    out = {}
    for name, dealt in (("default", df), ("customized", df.repartition(n, key))):
        sizes = [r["n_items"] for r in partition_sizes(dealt).orderBy("partition").collect()]
        _, seconds = timed(lambda d=dealt: top_groups(d, key).collect())
        out[name] = {"n_partition": len(sizes), "n_items": sizes, "exe_time": seconds}
    return out


def oriented(df: DataFrame, case: int, first: str, second: str) -> DataFrame:
    """basket, item: case 1 groups second under first, case 2 the other way round."""
    if case not in (1, 2):
        raise ValueError(f"case is 1 or 2, not {case}")
    a, b = (first, second) if case == 1 else (second, first)
    return df.select(F.col(a).alias("basket"), F.col(b).alias("item"))


def with_activity(df: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys with at least so many rows, repeated ones counted."""
    busy = group_counts(df, key).filter(F.col("n") >= least).select(key)
    return df.join(busy, key, "left_semi")


def without_keys(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key other does not have."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def minus_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that other does not have as a whole; repeated rows of df stay repeated."""
    return df.join(other.distinct(), df.columns, "left_anti")


def cohort(user_known: Column, item_known: Column) -> Column:
    """known, no_user, no_item or neither."""
    return F.when(user_known & item_known, "known").when(item_known, "no_user").when(user_known, "no_item").otherwise("neither")


def rmse(df: DataFrame, truth: str, guess: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sqrt(F.avg((F.col(truth) - F.col(guess)) ** 2)).alias("rmse"))


def error_histogram(df: DataFrame, truth: str, guess: str, top: int = 4) -> DataFrame:
    """error (whole units, the last open-ended), n; every bin is listed."""
    bins = F.least(F.floor(F.abs(F.col(truth) - F.col(guess))), F.lit(top)).cast("long")
    counts = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(bins.alias("error")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(top + 1).select(F.col("id").alias("error"))
    return every.join(counts, "error", "left").select("error", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
