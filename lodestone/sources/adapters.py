"""The synthetic tables seen as reviews, baskets, streams and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, stars (1 to 5), date, and what tells repeated ratings apart: seq (a struct, later is greater)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("stars"),
        F.col("o_orderdate").alias("date"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"),
    )


REVIEWS_SQL = (
    "SELECT o_custkey AS user_id, l_partkey AS item_id, (floor((l_quantity - 1) / 10) + 1)::DOUBLE AS stars, o_orderdate AS date, "
    "l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basket (user and day), item (event type); distinct."""
    events = table(spark, sf_dir, "events")
    return events.select(F.concat_ws("-", F.date_format("ts", "yyyy-MM-dd"), F.col("user_id").cast("string")).alias("basket"), F.col("event_type").alias("item")).distinct()


BASKETS_SQL = "SELECT DISTINCT concat_ws('-', strftime(ts, '%Y-%m-%d'), user_id::VARCHAR) AS basket, event_type AS item FROM events"


def stream(spark: SparkSession, sf_dir: str, batch: int = 100) -> DataFrame:
    """seq, batch_id, id: orders in key order, a hundred a batch."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.floor(F.col("o_orderkey") / batch).cast("long").alias("batch_id"), F.col("o_custkey").alias("id"))


STREAM_SQL = "SELECT o_orderkey AS seq, floor(o_orderkey / 100)::BIGINT AS batch_id, o_custkey AS id FROM orders"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, label, features."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("index"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, words: the distinct lower-cased words of every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\r]+"), lambda w: w != "")).alias("words"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, word: the distinct lower-cased words of every document."""
    return word_lists(spark, sf_dir).select("doc_id", F.explode("words").alias("word"))


WORDS_SQL = r"SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r]+')) AS word FROM documents) WHERE word <> ''"
