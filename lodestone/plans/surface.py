"""Registered queries over sources, sinks and small functions: tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing, text
from lodestone.operators import clustering, graph, itemsets, relational
from lodestone.plans.registry import _CITY_SQL, _EDGES_SQL, _SETS_SQL, SUPPORT_SHARE, YEAR, _city_ratings, _edges, query
from lodestone.plans.workspace import Workspace
from lodestone.sources import adapters, io
from lodestone.sources.adapters import BASKETS_SQL, REVIEWS_SQL, STREAM_SQL, table

_DATED = "strftime(date, '%Y-%m-%d')"
PRIME = 1_000_003


def _folder(spark, label: str) -> str:
    return f"{Workspace(spark, label).path}/rows"


def _reviews_as_text(spark, sf_dir) -> DataFrame:
    kept = adapters.reviews(spark, sf_dir)
    return kept.select(F.col("user_id").cast("string").alias("user_id"), F.col("item_id").cast("string").alias("business_id"), "stars", F.date_format("date", "yyyy-MM-dd").alias("date"))


_AS_TEXT_SQL = f"SELECT user_id::VARCHAR AS user_id, item_id::VARCHAR AS business_id, stars, {_DATED} AS date FROM ({REVIEWS_SQL})"


@query(_AS_TEXT_SQL)
def json_scan(spark, sf_dir):
    """Reviews through JSON lines and a fixed schema."""
    path = _folder(spark, "json")
    io.write_json(_reviews_as_text(spark, sf_dir), path)
    return io.read_json(spark, path, io.REVIEW)


@query(f"SELECT user_id, business_id, stars FROM ({_AS_TEXT_SQL})")
def csv_scan(spark, sf_dir):
    """Ratings through CSV with a header, a quoted comma in another file's field notwithstanding."""
    path = _folder(spark, "csv")
    io.write_csv(_reviews_as_text(spark, sf_dir).select("user_id", "business_id", "stars"), path)
    return io.read_csv(spark, path, io.RATING)


@query(f"""WITH r AS (SELECT DISTINCT concat_ws('-', strftime(date, '%m/%d/%y'), user_id::VARCHAR) AS basket, item_id::VARCHAR AS item FROM ({REVIEWS_SQL}))
SELECT basket, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM r GROUP BY 1 HAVING count(*) > 3""")
def retail_baskets(spark, sf_dir):
    """Quoted transactions with zero-padded ids, read, cleaned and made into baskets of more than three products."""
    path = _folder(spark, "retail")
    rows = adapters.reviews(spark, sf_dir)
    padded = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    shown = rows.select(F.date_format("date", "MM/dd/yy").alias("DATE"), padded("user_id").alias("CUSTOMER_ID"), padded("item_id").alias("PRODUCT_ID"))
    shown.write.mode("overwrite").csv(path, header=True, quoteAll=True)
    large = itemsets.retail_baskets(io.read_retail(spark, path), 3)
    return large.groupBy("basket").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))


@query("""SELECT vec_id AS index, label::BIGINT AS label, len(embedding)::INTEGER AS n_features, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings""")
def points_scan(spark, sf_dir):
    """Points through lines of numbers without a header."""
    path = _folder(spark, "points")
    points = adapters.points(spark, sf_dir)
    numbers = F.concat(F.array(F.col("index").cast("string"), F.col("label").cast("string")), F.transform("features", lambda x: x.cast("string")))
    io.write_lines(points.select(F.array_join(numbers, ",").alias("value")), path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return io.read_points(spark, path).select("index", "label", F.size("features").alias("n_features"), F.round(total, 6).alias("total"))


@query("SELECT 500::BIGINT AS drawn, 0::BIGINT AS foreign_lines, 500::BIGINT AS numbers")
def random_lines(spark, sf_dir):
    """Draws with replacement from the nations' names: how many, how many that are no names, how many numbers."""
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"))
    drawn = io.random_lines(names, 500, 7)
    met = drawn.join(names.distinct().withColumn("known", F.lit(True)), "value", "left")
    return met.agg(F.count("*").alias("drawn"), F.count_if(F.col("known").isNull()).alias("foreign_lines"), F.count_distinct("seq").alias("numbers"))


@query("SELECT row_number() OVER (ORDER BY n_name) - 1 AS at, n_name AS value FROM nation")
def running_number(spark, sf_dir):
    """Rows numbered in a global order."""
    return io._numbered(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), "value")


@query("SELECT n_name AS city, n_nationkey::BIGINT AS n FROM nation WHERE false UNION ALL SELECT 'none', 0")
def empty_relation(spark, sf_dir):
    """An empty relation takes part in a union by name."""
    return io.empty(spark, "n long, city string").select("city", "n").unionByName(io.from_rows(spark, [("none", 0)], "city string, n long"))


@query(f"SELECT count(*) AS n_review, count_if(year(date) = {YEAR})::BIGINT AS n_review_year, (SELECT string_agg(user_id || ':' || n, ',' ORDER BY n DESC, user_id) FROM (SELECT user_id, count(*) AS n FROM ({REVIEWS_SQL}) GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10)) AS top10_user FROM ({REVIEWS_SQL})")
def json_report(spark, sf_dir):
    """The exploration report as one JSON text, read again."""
    report = io.report_json(relational.exploration_report(adapters.reviews(spark, sf_dir), YEAR))
    shape = "n_review long, n_review_year long, top10_user array<struct<id long, count long>>"
    read = io.from_rows(spark, [(report,)], "value string").select(F.from_json("value", shape).alias("r")).select("r.*")
    pairs = F.transform("top10_user", lambda x: F.concat_ws(":", x["id"].cast("string"), x["count"].cast("string")))
    return read.select("n_review", "n_review_year", F.array_join(pairs, ",").alias("top10_user"))


@query(f"SELECT size, string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' ORDER BY string_split(items, ',')) AS line FROM ({_SETS_SQL}) GROUP BY 1")
def itemset_report(spark, sf_dir):
    """Frequent itemsets as the lines of the text report."""
    baskets = adapters.baskets(spark, sf_dir)
    support = baskets.select("basket").distinct().count() * SUPPORT_SHARE
    return io.itemset_lines(itemsets.frequent_itemsets(baskets, support))


@query(f"""WITH RECURSIVE r AS ({REVIEWS_SQL}), {_EDGES_SQL}, links AS (SELECT u AS a, v AS b FROM edges UNION ALL SELECT v, u FROM edges),
reach AS (SELECT DISTINCT a AS id, a AS other FROM links UNION SELECT reach.id, b FROM reach JOIN links ON reach.other = links.a), least AS (SELECT id, min(other) AS c FROM reach GROUP BY 1)
SELECT '''' || string_agg(id::VARCHAR, ''', ''' ORDER BY id) || '''' AS value FROM least GROUP BY c""")
def community_report(spark, sf_dir):
    """Components as lines of quoted members, written as text and read again."""
    path = _folder(spark, "communities")
    found = graph.communities(graph.components(_edges(spark, sf_dir)), "component")
    io.write_lines(io.community_lines(found.select(F.col("members").cast("array<string>").alias("members"))), path)
    return spark.read.text(path)


@query(f"SELECT basket, count(DISTINCT item) AS n FROM (SELECT item_id AS basket, user_id AS item FROM ({REVIEWS_SQL})) GROUP BY 1")
def case_switch(spark, sf_dir):
    """Baskets the other way round: users under items."""
    return relational.oriented(adapters.reviews(spark, sf_dir), 2, "user_id", "item_id").groupBy("basket").agg(F.count_distinct("item").alias("n"))


@query(_CITY_SQL + " ORDER BY stars DESC, city LIMIT 10")
def top10_city_driver(spark, sf_dir):
    """The ten best cities by a sort on the driver, for the timing report: the averages are one row a city."""
    return io.from_rows(spark, relational.top_average_on_driver(_city_ratings(spark, sf_dir), "city", "stars", digits=6), "city string, stars double")


@query("SELECT 2::BIGINT AS ways, true AS same, true AS timed")
def timing_report(spark, sf_dir):
    """Both ways of taking the ten best cities: how many, whether they agree, whether both were timed."""
    report = relational.timing_report(_city_ratings(spark, sf_dir), "city", "stars")
    return io.from_rows(spark, [(2, report["m1"] == report["m2"], min(report["m1_time"], report["m2_time"]) > 0)], "ways long, same boolean, timed boolean")


@query(f"""SELECT n_name AS name, substr(n_name, 2, greatest(length(n_name) - 2, 0)) AS inner_text, substr('1998-05-06' || n_name, 1, 4)::INTEGER AS year,
  list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda a, c: (a * 256 + c) % {PRIME}) AS number,
  {hashing.prime_after(PRIME)}::BIGINT AS next_prime FROM nation""")
def text_functions(spark, sf_dir):
    """Ends stripped, a year's prefix, a text as a number modulo a prime, and the prime after that."""
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        name.alias("name"), text.unquoted(name).alias("inner_text"), text.year_of(F.concat(F.lit("1998-05-06"), name)).alias("year"),
        hashing.text_mod(name, PRIME).alias("number"), F.lit(hashing.prime_after(PRIME)).cast("long").alias("next_prime"),
    )


@query(f"""WITH p AS (SELECT vec_id, label::BIGINT AS label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS d FROM embeddings),
c AS (SELECT label AS cluster, d, avg(x) AS m, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0) + {clustering.FLOOR!r}) AS s FROM p GROUP BY 1, 2),
far AS (SELECT vec_id, cluster, sqrt(sum(((x - m) / s) ** 2)) AS distance FROM p JOIN c USING (d) GROUP BY 1, 2)
SELECT vec_id AS index, CASE WHEN min(distance) < {2 * 64 ** 0.5!r} THEN arg_min(cluster, distance) END AS cluster FROM far GROUP BY 1""")
def mahalanobis_nearest(spark, sf_dir):
    """Every point's nearest labelled cluster, if within twice the root of 64."""
    points = adapters.points(spark, sf_dir)
    return clustering.nearest(points, clustering.summaries(points, "label"), 2 * 64**0.5).select("index", "cluster")


@query(f"SELECT count(DISTINCT id) AS n_ids, count(*) AS n FROM ({STREAM_SQL}) WHERE seq % 2 = 0")
def append_sink(spark, sf_dir):
    """Batches appended as files with a header, one of them twice, as after a failure; all read again."""
    path = _folder(spark, "append")
    sink, rows = io.append_batch(path), adapters.stream(spark, sf_dir).filter("seq % 2 = 0")
    for batch in (0, 1, 1, 2):
        sink(rows.filter(F.pmod("batch_id", F.lit(3)) == batch), batch)
    read = spark.read.schema("seq long, batch_id long, id long").csv(path, header=True)
    return read.agg(F.count_distinct("id").alias("n_ids"), F.count("*").alias("n"))


@query(f"SELECT basket AS item, count(*) AS n FROM ({BASKETS_SQL}) GROUP BY 1 HAVING count(*) > 2")
def basket_sizes(spark, sf_dir):
    """Baskets with more than two items, by a semi-join on their counts."""
    return relational.group_counts(itemsets.larger_than(adapters.baskets(spark, sf_dir), 2), "basket").withColumnRenamed("basket", "item")
