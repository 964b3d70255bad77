"""Readers with fixed schemas, writers of reports, and a source of random lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REVIEW = "user_id string, business_id string, stars double, date string"
BUSINESS = "business_id string, city string, stars double, review_count bigint, latitude double, longitude double, attributes map<string,string>, categories string"
_KINDS = ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos")
USER = "user_id string, average_stars double, review_count bigint, useful bigint, funny bigint, cool bigint, fans bigint, " + ", ".join(f"compliment_{k} bigint" for k in _KINDS) + ", yelping_since string"
RATING = "user_id string, business_id string, stars double"
BASKET = "user_id string, business_id string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header in every file; quoted commas stay in their field."""
    return spark.read.schema(schema).option("enforceSchema", "true").csv(path, header=True)


def read_retail(spark: SparkSession, path: str) -> DataFrame:
    """Quoted retail transactions: date, customer and product ids as numbers (their leading zeros go)."""
    rows = spark.read.csv(path, header=True, quote='"')
    return rows.select(F.col("DATE").alias("date"), F.col("CUSTOMER_ID").cast("bigint").alias("customer_id"), F.col("PRODUCT_ID").cast("bigint").alias("product_id"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points without a header: index, label, and as many features as there are."""
    parts = spark.read.text(path).select(F.split("value", ",").alias("p")).filter(F.size("p") > 2)
    features = F.transform(F.slice("p", F.lit(3), F.size("p")), lambda x: x.cast("double"))
    return parts.select(F.col("p")[0].cast("bigint").alias("index"), F.col("p")[1].cast("bigint").alias("label"), features.alias("features"))


def random_lines(lines: DataFrame, n: int, seed: int) -> DataFrame:
    """n lines (value) drawn uniformly with replacement, as (seq, value): the draws are made up and then looked up."""
    numbered = _numbered(lines, "value")
    total = numbered.count()
    draws = lines.sparkSession.range(n).select(F.col("id").alias("seq"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("at"))
    return draws.join(numbered, "at").select("seq", "value")


def _numbered(lines: DataFrame, order: str) -> DataFrame:
    """Rows numbered from 0 in a global order, without gathering them in one task: a range sort, and each partition's
    first number from the partitions' sizes."""
    dealt = lines.select(F.col(order).alias("value")).repartitionByRange("value").withColumn("part", F.spark_partition_id())
    sizes = dealt.groupBy("part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))  # a row per partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(starts), "part").select((F.col("start") + F.col("inside")).alias("at"), "value")


def quoted(items: Column) -> Column:
    """'a', 'b', 'c'"""
    return F.concat(F.lit("'"), F.array_join(items, "', '"), F.lit("'"))


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """One line per size: the sets of that size, sorted, as ('a', 'b'),('c', 'd'). itemsets: items (sorted array)."""
    shown = itemsets.select(F.size("items").alias("size"), F.struct("items", F.concat(F.lit("("), quoted(F.col("items")), F.lit(")")).alias("text")).alias("s"))
    return shown.groupBy("size").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["text"]), ",").alias("line")).orderBy("size")


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> str:
    """The two-block text report; blocks may be empty."""
    block = lambda df: "\n\n".join(r["line"] for r in itemset_lines(df).collect())
    return f"Candidates:\n{block(candidates)}\n\nFrequent Itemsets:\n{block(frequent)}"


def community_lines(communities: DataFrame) -> DataFrame:
    """Communities (members: sorted array) as lines of quoted ids, by size and members."""
    return communities.orderBy(F.size("members"), "members").select(quoted(F.col("members")).alias("value"))


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """Edges (u, v, betweenness) as ('u', 'v'),value with five digits, by value descending and pair."""
    line = F.concat(F.lit("("), quoted(F.array("u", "v")), F.lit("),"), F.round("betweenness", 5).cast("string"))
    return edges.orderBy(F.desc("betweenness"), "u", "v").select(line.alias("value"))


def cluster_report(rounds: DataFrame, assignments: DataFrame) -> DataFrame:
    """Lines (value, in the order of at): the rounds' counters, then index and cluster of every point by index."""
    row = lambda part, at, value: (F.lit(part).alias("part"), at.cast("long").alias("at"), value.alias("value"))
    spark = rounds.sparkSession
    heads = spark.createDataFrame([(0, -1, "The intermediate results:"), (1, -2, ""), (1, -1, "The clustering results:")], "part int, at long, value string")
    counters = [F.col(c).cast("string") for c in ("n_discard", "n_compression_clusters", "n_compression_points", "n_retained")]
    turns = rounds.select(*row(0, F.col("round"), F.concat_ws(", ", F.concat(F.lit("Round "), F.col("round").cast("string"), F.lit(":")), *counters)))
    points = assignments.select(*row(1, F.col("index"), F.concat_ws(", ", F.col("index").cast("string"), F.col("cluster").cast("string"))))
    return heads.unionByName(turns).unionByName(points).orderBy("part", "at").select("value")


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_json(df: DataFrame) -> str:
    """A one-row report as JSON text."""
    return df.toJSON().first()


def append_batch(path: str):
    """A foreachBatch sink that appends each batch as CSV files with a header; a batch that is run again replaces its own."""

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").csv(f"{path}/batch={batch}", header=True)

    return sink


def from_rows(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
