"""The registered queries over the synthetic tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.hashing import family, key_long
from lodestone.functions.text import clean, first_keyword, map_size, year_of
from lodestone.operators import clustering, graph, itemsets, recommend, relational, similarity, sketches
from lodestone.plans.workspace import Workspace
from lodestone.sources import adapters
from lodestone.sources.adapters import BASKETS_SQL, REVIEWS_SQL, STREAM_SQL, WORDS_SQL, table

YEAR = 1998
OVERLAP, CROWD = 7, 7
SUPPORT_SHARE = 0.05
#: Words that take a part's name to a category, as descriptions do.
PART_WORDS = ["ring", "widget", "bolt", "gear", "red", "blue", "small", "hot"]
KINDS = ("hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos")
#: Features of the single model, and of the ensemble.
FEATURES = ["stars_business", "review_count_business", "review_count", "average_stars_user", "useful", "funny", "cool"]
ALL_FEATURES = FEATURES + ["fans", "review_count_user", "n_attributes", "latitude", "longitude", "yelping_since_year", *[f"compliment_{k}" for k in KINDS], "avg_star_category"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- exploration ---


@query(f"SELECT count(*) AS n_review, count_if(year(date) = {YEAR})::BIGINT AS n_review_year, count(DISTINCT user_id) AS n_user, count(DISTINCT item_id) AS n_business FROM ({REVIEWS_SQL})")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = relational.exploration_report(adapters.reviews(spark, sf_dir), YEAR, "user_id", "item_id")
    return report.select("n_review", "n_review_year", "n_user", "n_business")


@query(f"SELECT year(date)::INTEGER AS year, count(*) AS n FROM ({REVIEWS_SQL}) GROUP BY 1")
def review_count_year(spark, sf_dir):
    return relational.group_counts(adapters.reviews(spark, sf_dir).select(F.year("date").alias("year")), "year")


@query(f"SELECT count(DISTINCT user_id) AS n FROM ({REVIEWS_SQL})")
def distinct_users(spark, sf_dir):
    return adapters.reviews(spark, sf_dir).agg(F.count_distinct("user_id").alias("n"))


@query(f"SELECT count(DISTINCT item_id) AS n FROM ({REVIEWS_SQL})")
def distinct_items(spark, sf_dir):
    return adapters.reviews(spark, sf_dir).agg(F.count_distinct("item_id").alias("n"))


@query(f"SELECT user_id, count(*) AS n FROM ({REVIEWS_SQL}) GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top10_users(spark, sf_dir):
    return relational.top_groups(adapters.reviews(spark, sf_dir), "user_id")


@query(f"SELECT item_id, count(*) AS n FROM ({REVIEWS_SQL}) GROUP BY 1 ORDER BY n DESC, item_id LIMIT 10")
def top10_items(spark, sf_dir):
    return relational.top_groups(adapters.reviews(spark, sf_dir), "item_id")


_CITY_SQL = (
    "SELECT n_name AS city, round(avg(stars), 6) AS stars FROM (SELECT l_suppkey, (floor((l_quantity - 1) / 10) + 1)::DOUBLE AS stars FROM lineitem) "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE length(n_name) > 0 GROUP BY 1"
)


def _city_ratings(spark, sf_dir):
    """city, stars: lines' ratings by the nation of their supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("stars"))
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("city"))
    return lines.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select("city", "stars")


@query(_CITY_SQL + " ORDER BY stars DESC, city LIMIT 10")
def top10_city_avg(spark, sf_dir):
    return relational.top_average(_city_ratings(spark, sf_dir), "city", "stars", digits=6)


@query(_CITY_SQL)
def city_avg(spark, sf_dir):
    return relational.group_average(_city_ratings(spark, sf_dir), "city", "stars", digits=6)


@query()
def partition_sizes(spark, sf_dir):
    return relational.partition_sizes(adapters.reviews(spark, sf_dir).select("item_id"), "item_id", 16)


# --- features ---

_CATEGORY_SQL = "CASE " + " ".join(f"WHEN contains(lower(p_name), '{w}') THEN '{w}'" for w in PART_WORDS) + " ELSE 'other' END"
_ITEMS_SQL = f"SELECT p_partkey AS item_id, {_CATEGORY_SQL} AS category, p_retailprice, p_size FROM part"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), first_keyword(clean(F.col("p_name")), PART_WORDS).alias("category"), "p_retailprice", "p_size")


def _users(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")


def _strangers(spark):
    """Pairs with an unknown user, item, or both, beside those of the tables."""
    return spark.createDataFrame([(-1, 0), (0, -1), (-1, -1)], "user_id long, item_id long")


_PAIRS_SQL = f"SELECT DISTINCT user_id, item_id FROM ({REVIEWS_SQL}) UNION ALL VALUES (-1, 0), (0, -1), (-1, -1)"


def _pairs(spark, sf_dir):
    return adapters.reviews(spark, sf_dir).select("user_id", "item_id").distinct().unionByName(_strangers(spark))


@query(f"SELECT category, count(*) AS n FROM ({_ITEMS_SQL}) GROUP BY 1")
def text_category(spark, sf_dir):
    return relational.group_counts(_items(spark, sf_dir), "category")


@query(f"SELECT category, round(avg(stars), 6) AS stars FROM ({REVIEWS_SQL}) JOIN ({_ITEMS_SQL}) USING (item_id) GROUP BY 1")
def category_avg(spark, sf_dir):
    rated = adapters.reviews(spark, sf_dir).join(_items(spark, sf_dir), "item_id", "left")
    return relational.group_average(rated, "category", "stars", digits=6)


@query(f"SELECT user_id, count(*) AS n FROM ({REVIEWS_SQL}) GROUP BY 1")
def user_activity(spark, sf_dir):
    return relational.group_counts(adapters.reviews(spark, sf_dir), "user_id")


@query(f"""WITH pairs AS ({_PAIRS_SQL})
SELECT CASE WHEN u AND i THEN 'known' WHEN i THEN 'no_user' WHEN u THEN 'no_item' ELSE 'neither' END AS cohort, count(*) AS n
FROM (SELECT user_id IN (SELECT c_custkey FROM customer) AS u, item_id IN (SELECT p_partkey FROM part) AS i FROM pairs) GROUP BY 1""")
def cohort_unknowns(spark, sf_dir):
    """Cohorts by anti-joins and row differences, as separate sets."""
    pairs, items, users = _pairs(spark, sf_dir), _items(spark, sf_dir), _users(spark, sf_dir)
    no_item = relational.without_keys(pairs, items, "item_id")
    no_user = relational.without_keys(pairs, users, "user_id")
    neither = relational.without_keys(no_item, users, "user_id")
    known = relational.minus_rows(relational.minus_rows(pairs, no_item), no_user)
    named = [(known, "known"), (relational.minus_rows(no_user, neither), "no_user"), (relational.minus_rows(no_item, neither), "no_item"), (neither, "neither")]
    out = None
    for df, name in named:
        df = df.select(F.lit(name).alias("cohort"))
        out = df if out is None else out.unionByName(df)
    return relational.group_counts(out, "cohort")


_FEATURES_SQL = f"""WITH reviews AS ({REVIEWS_SQL}), items AS ({_ITEMS_SQL}), pairs AS ({_PAIRS_SQL}),
averages AS (SELECT category, round(avg(stars), 6) AS avg_star_category FROM reviews LEFT JOIN items USING (item_id) GROUP BY 1),
activity AS (SELECT user_id, count(*) AS review_count_user FROM reviews GROUP BY 1)
SELECT p.user_id, p.item_id, i.category, i.p_retailprice, i.p_size, c.c_acctbal, CASE WHEN i.item_id IS NOT NULL THEN avg_star_category END AS avg_star_category,
  CASE WHEN c.c_custkey IS NOT NULL THEN review_count_user END AS review_count_user,
  CASE WHEN c.c_custkey IS NOT NULL AND i.item_id IS NOT NULL THEN 'known' WHEN i.item_id IS NOT NULL THEN 'no_user' WHEN c.c_custkey IS NOT NULL THEN 'no_item' ELSE 'neither' END AS cohort
FROM pairs p LEFT JOIN items i ON p.item_id = i.item_id LEFT JOIN customer c ON c.c_custkey = p.user_id
LEFT JOIN averages a ON a.category IS NOT DISTINCT FROM i.category LEFT JOIN activity t ON t.user_id = p.user_id"""


@query(_FEATURES_SQL)
def feature_table(spark, sf_dir):
    out = recommend.feature_table(_pairs(spark, sf_dir), _items(spark, sf_dir), _users(spark, sf_dir), adapters.reviews(spark, sf_dir))
    return out.withColumn("avg_star_category", F.round("avg_star_category", 6))


_BUSINESSES_SQL = f"""SELECT p_partkey AS item_id, {_CATEGORY_SQL} AS category, stars_business, p_retailprice AS latitude, p_size AS longitude, review_count_business,
  ((p_brand IS NOT NULL)::INTEGER + (p_size > 25 AND p_type IS NOT NULL)::INTEGER + (p_retailprice > 1000)::INTEGER)::INTEGER AS n_attributes
FROM part LEFT JOIN (SELECT item_id, round(avg(stars), 6) AS stars_business, count(*) AS review_count_business FROM reviews GROUP BY 1) r ON r.item_id = p_partkey"""
_PEOPLE_SQL = f"""SELECT c_custkey AS user_id, review_count, average_stars_user, useful, funny, cool, fans, {", ".join(f"compliment_{k}" for k in KINDS)}, yelping_since_year
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS review_count, count_if(o_orderstatus = 'O')::BIGINT AS useful, count_if(o_orderstatus = 'F')::BIGINT AS funny, count_if(o_orderstatus = 'P')::BIGINT AS cool,
  count_if(month(o_orderdate) = 12)::BIGINT AS fans, {", ".join(f"count_if(month(o_orderdate) = {i + 1})::BIGINT AS compliment_{k}" for i, k in enumerate(KINDS))}, min(year(o_orderdate))::INTEGER AS yelping_since_year FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, round(avg(stars), 6) AS average_stars_user FROM reviews GROUP BY 1) r ON r.user_id = c_custkey"""


def _businesses(spark, sf_dir, ratings):
    """Items as businesses: rating, place, number of ratings, and how many attributes are in their nested map."""
    parts = table(spark, sf_dir, "part")
    rated = ratings.groupBy("item_id").agg(F.round(F.avg("stars"), 6).alias("stars_business"), F.count("*").alias("review_count_business"))
    held = {"brand": F.col("p_brand"), "type": F.when(F.col("p_size") > 25, F.col("p_type")), "dear": F.when(F.col("p_retailprice") > 1000, F.lit("True"))}
    attributes = F.map_filter(F.create_map(*[x for k, v in held.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    items = parts.select(F.col("p_partkey").alias("item_id"), first_keyword(clean(F.col("p_name")), PART_WORDS).alias("category"), F.col("p_retailprice").alias("latitude"), F.col("p_size").alias("longitude"), map_size(attributes).alias("n_attributes"))
    return items.join(rated, "item_id", "left")


def _people(spark, sf_dir, ratings):
    """Customers as users with seventeen metrics of their orders."""
    orders = table(spark, sf_dir, "orders")
    month = lambda m: F.count_if(F.month("o_orderdate") == m)
    status = lambda x: F.count_if(F.col("o_orderstatus") == x)
    metrics = orders.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.count("*").alias("review_count"), status("O").alias("useful"), status("F").alias("funny"), status("P").alias("cool"), month(12).alias("fans"),
        *[month(i + 1).alias(f"compliment_{k}") for i, k in enumerate(KINDS)], year_of(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd")).alias("yelping_since_year"),
    )
    rated = ratings.groupBy("user_id").agg(F.round(F.avg("stars"), 6).alias("average_stars_user"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(metrics, "user_id", "left").join(rated, "user_id", "left")


@query(f"""WITH reviews AS ({REVIEWS_SQL}), items AS ({_BUSINESSES_SQL}), users AS ({_PEOPLE_SQL}), pairs AS ({_PAIRS_SQL}),
averages AS (SELECT category, round(avg(stars), 6) AS avg_star_category FROM reviews LEFT JOIN items USING (item_id) GROUP BY 1),
activity AS (SELECT user_id, count(*) AS review_count_user FROM reviews GROUP BY 1)
SELECT p.user_id, p.item_id, CASE WHEN u.user_id IS NOT NULL AND i.item_id IS NOT NULL THEN 'known' WHEN i.item_id IS NOT NULL THEN 'no_user' WHEN u.user_id IS NOT NULL THEN 'no_item' ELSE 'neither' END AS cohort, i.category,
  {", ".join(c for c in ALL_FEATURES if c not in ("avg_star_category", "review_count_user"))},
  CASE WHEN i.item_id IS NOT NULL THEN avg_star_category END AS avg_star_category, CASE WHEN u.user_id IS NOT NULL THEN review_count_user END AS review_count_user
FROM pairs p LEFT JOIN items i ON p.item_id = i.item_id LEFT JOIN users u ON u.user_id = p.user_id
LEFT JOIN averages a ON a.category IS NOT DISTINCT FROM i.category LEFT JOIN activity t ON t.user_id = p.user_id""")
def feature_pipeline(spark, sf_dir):
    """The rating pipeline's table of 25 features for every pair, known or not."""
    return _features(spark, sf_dir, _pairs(spark, sf_dir), adapters.reviews(spark, sf_dir))


def _features(spark, sf_dir, pairs, ratings):
    out = recommend.feature_table(pairs, _businesses(spark, sf_dir, ratings), _people(spark, sf_dir, ratings), ratings)
    return out.withColumn("avg_star_category", F.round("avg_star_category", 6))


# --- itemsets ---


@query(f"SELECT basket, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM ({BASKETS_SQL}) GROUP BY 1 HAVING count(*) > 1")
def basket_build(spark, sf_dir):
    large = itemsets.larger_than(adapters.baskets(spark, sf_dir), 1)
    return large.groupBy("basket").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))


def _support(baskets: DataFrame) -> float:
    """The share SUPPORT_SHARE of the baskets."""
    return baskets.select("basket").distinct().count() * SUPPORT_SHARE


_SETS_SQL = f"""WITH b AS ({BASKETS_SQL}), s AS (SELECT count(DISTINCT basket) * {SUPPORT_SHARE} AS least FROM b),
one AS (SELECT item AS items, count(*) AS n, 1 AS size FROM b GROUP BY item),
two AS (SELECT x.item || ',' || y.item AS items, count(*) AS n, 2 AS size FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1),
three AS (SELECT x.item || ',' || y.item || ',' || z.item AS items, count(*) AS n, 3 AS size FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item JOIN b z ON z.basket = x.basket AND y.item < z.item GROUP BY 1),
four AS (SELECT concat_ws(',', x.item, y.item, z.item, w.item) AS items, count(*) AS n, 4 AS size FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item JOIN b z ON z.basket = x.basket AND y.item < z.item JOIN b w ON w.basket = x.basket AND z.item < w.item GROUP BY 1),
five AS (SELECT string_agg(item, ',' ORDER BY item) AS items, 5 AS size, basket FROM b GROUP BY basket HAVING count(*) = 5),
every AS (SELECT items, n, size FROM one UNION ALL SELECT items, n, size FROM two UNION ALL SELECT items, n, size FROM three UNION ALL SELECT items, n, size FROM four UNION ALL SELECT items, count(*), 5 FROM five GROUP BY items)
SELECT items, n::BIGINT AS n, size::INTEGER AS size FROM every, s WHERE n >= least"""


def _frequent(spark, sf_dir, most):
    baskets = adapters.baskets(spark, sf_dir)
    found = itemsets.frequent_itemsets(baskets, _support(baskets), most)
    return found.select(F.array_join("items", ",").alias("items"), "n", F.size("items").alias("size"))


@query(_SETS_SQL + " AND size = 1")
def freq_items_1(spark, sf_dir):
    return _frequent(spark, sf_dir, 1)


@query(_SETS_SQL + " AND size = 2")
def freq_items_2(spark, sf_dir):
    return _frequent(spark, sf_dir, 2).filter("size = 2")


@query(_SETS_SQL + " AND size = 3")
def freq_items_3(spark, sf_dir):
    return _frequent(spark, sf_dir, 3).filter("size = 3")


@query(_SETS_SQL)
def freq_itemsets_all(spark, sf_dir):
    return _frequent(spark, sf_dir, None)


@query()
def son_candidates(spark, sf_dir):
    baskets = adapters.baskets(spark, sf_dir)
    return itemsets.son_candidates(baskets, _support(baskets), 4).select(F.array_join("items", ",").alias("items"))


@query(_SETS_SQL)
def son_frequent(spark, sf_dir):
    baskets = adapters.baskets(spark, sf_dir)
    return itemsets.son(baskets, _support(baskets), 4)[1].select(F.array_join("items", ",").alias("items"), "n", F.size("items").alias("size"))


# --- similarity ---

_HASHES = similarity.minhash_family(100_003)
_WORD_X = "('0x' || substr(md5(word), 1, 15))::BIGINT"
_FAMILY_SQL = "(VALUES " + ", ".join(f"({i}, {h.a}::BIGINT, {h.b}::BIGINT, {h.p}::BIGINT, {h.m}::BIGINT)" for i, h in enumerate(_HASHES)) + ") AS f(number, a, b, p, m)"
_SIGNATURES_SQL = f"SELECT doc_id, number, min(((x % p * a + b) % p) % m) AS value FROM (SELECT doc_id, {_WORD_X} AS x FROM ({WORDS_SQL})), {_FAMILY_SQL} GROUP BY 1, 2"
_JACCARD_SQL = f"""WITH w AS ({WORDS_SQL}), sizes AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM w x JOIN w y ON x.word = y.word AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b, c::DOUBLE / (p.n + q.n - c) AS similarity FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE c::DOUBLE / (p.n + q.n - c) >= 0.5)"""


def _word_sets(spark, sf_dir):
    return adapters.words(spark, sf_dir).select(F.col("doc_id").alias("key"), F.col("word").alias("item"))


def _number_sets(spark, sf_dir):
    return adapters.words(spark, sf_dir).select(F.col("doc_id").alias("key"), key_long(F.col("word")).alias("item"))


def _number_lists(spark, sf_dir):
    """The same with a row a key: items (array). Rows of one doc_id are one document."""
    lists = adapters.word_lists(spark, sf_dir).select(F.col("doc_id").alias("key"), F.transform("words", key_long).alias("items"))
    return lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


@query(_JACCARD_SQL + " SELECT a, b, similarity FROM pairs")
def jaccard_exact(spark, sf_dir):
    return similarity.similar_pairs(_word_sets(spark, sf_dir))


@query(_SIGNATURES_SQL.replace("SELECT doc_id, number, min(", "SELECT doc_id, number::INTEGER AS number, min("))
def minhash_signatures(spark, sf_dir):
    signed = similarity.signatures(_number_sets(spark, sf_dir), _HASHES)
    return signed.select(F.col("key").alias("doc_id"), F.posexplode("signature").alias("number", "value"))


@query(_JACCARD_SQL + f""", signed AS ({_SIGNATURES_SQL}), bands AS (SELECT doc_id, number // 3 AS band, string_agg(value::VARCHAR, ',' ORDER BY number) AS part FROM signed GROUP BY 1, 2),
met AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.part = y.part AND x.doc_id < y.doc_id)
SELECT a, b, similarity FROM pairs JOIN met USING (a, b)""")
def jaccard_lsh(spark, sf_dir):
    return similarity.similar_sets_lsh(_number_lists(spark, sf_dir), _HASHES)


# --- recommendation ---

_CF_SQL = f"""WITH r AS ({REVIEWS_SQL}),
last AS (SELECT user_id, item_id, arg_max(stars, (l_orderkey, l_linenumber, l_suppkey, stars)) AS stars FROM r GROUP BY 1, 2),
im AS (SELECT item_id, avg(stars) AS mean FROM r GROUP BY 1), um AS (SELECT user_id, avg(stars) AS mean FROM r GROUP BY 1),
d AS (SELECT user_id, item_id, stars - mean AS d FROM last JOIN im USING (item_id)),
co AS (SELECT x.item_id AS i, y.item_id AS j, count(*) AS n, sum(x.d * y.d) AS num, sum(x.d * x.d) AS si, sum(y.d * y.d) AS sj FROM d x JOIN d y ON x.user_id = y.user_id AND x.item_id <= y.item_id GROUP BY 1, 2)"""
_W_SQL = "round(CASE WHEN coalesce(n, 0) <= 1 THEN CASE WHEN abs(gap) <= 1 THEN 1.0 WHEN abs(gap) <= 2 THEN 0.5 ELSE 0.0 END WHEN round(num, 9) = 0 THEN 0.0 ELSE num / (sqrt(si) * sqrt(sj)) END::DOUBLE, 9)"


@query(f"SELECT item_id, round(avg(stars), 6) AS mean FROM ({REVIEWS_SQL}) GROUP BY 1")
def item_means(spark, sf_dir):
    return recommend.means(adapters.reviews(spark, sf_dir), "item_id").withColumn("mean", F.round("mean", 6))


@query(f"SELECT user_id, round(avg(stars), 6) AS mean FROM ({REVIEWS_SQL}) GROUP BY 1")
def user_means(spark, sf_dir):
    return recommend.means(adapters.reviews(spark, sf_dir), "user_id").withColumn("mean", F.round("mean", 6))


@query(_CF_SQL + f" SELECT i, j, n, {_W_SQL.replace('gap', '0')} AS weight FROM co WHERE i < j AND n >= 2")
def pearson_pairs(spark, sf_dir):
    return recommend.pearson_pairs(adapters.reviews(spark, sf_dir))


def _by_items(spark, sf_dir):
    return recommend.predict_by_items(adapters.reviews(spark, sf_dir), _pairs(spark, sf_dir))


@query(_CF_SQL + f""", targets AS ({_PAIRS_SQL}), known AS (SELECT t.user_id, t.item_id, im.mean AS im, um.mean AS um FROM targets t LEFT JOIN im ON im.item_id = t.item_id LEFT JOIN um ON um.user_id = t.user_id),
weighed AS (SELECT k.user_id, k.item_id, l.item_id AS other, l.stars, {_W_SQL} AS w FROM (SELECT *, 0 AS z FROM known WHERE im IS NOT NULL AND um IS NOT NULL) k JOIN last l ON l.user_id = k.user_id
  JOIN im o ON o.item_id = l.item_id LEFT JOIN co ON co.i = least(k.item_id, l.item_id) AND co.j = greatest(k.item_id, l.item_id), LATERAL (SELECT k.im - o.mean AS gap)),
near AS (SELECT * FROM weighed WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY w DESC, other) <= {recommend.NEIGHBOURS}),
guessed AS (SELECT user_id, item_id, sum(w * stars) / sum(w) AS guess FROM near GROUP BY 1, 2)
SELECT user_id, item_id, round(CASE WHEN im IS NULL AND um IS NULL THEN {recommend.FALLBACK} WHEN im IS NULL THEN um WHEN um IS NULL THEN im ELSE coalesce(guess, {recommend.FALLBACK}) END::DOUBLE, 6) AS prediction
FROM known LEFT JOIN guessed USING (user_id, item_id)""")
def cf_predict(spark, sf_dir):
    return _by_items(spark, sf_dir).withColumn("prediction", F.round("prediction", 6))


def _model_rows(spark, sf_dir, names, ratings=None, last=None):
    """Training rows (pairs with their last rating and features) and targets (all known pairs with features). ratings
    and last: the reviews and their last ratings, where the caller has written them."""
    work = Workspace(spark, "features")
    if ratings is None:
        ratings = work.keep(adapters.reviews(spark, sf_dir), "ratings")
        work.release()
        last = work.keep(recommend.last_ratings(ratings), "last")
        work.release()
    pairs = last.withColumn("rated", F.lit(True)).unionByName(_strangers(spark).withColumns({"stars": F.lit(None).cast("double"), "rated": F.lit(False)}))
    features = _features(spark, sf_dir, pairs, ratings).filter("cohort = 'known'")
    features = work.keep(features.select("user_id", "item_id", "stars", "rated", *[F.col(c).cast("double").alias(c) for c in names]), "known")
    work.release()
    work.drop("ratings", "last")
    return features.filter("rated").drop("rated"), features.drop("stars", "rated")


def _by_model(spark, sf_dir):
    train, targets = _model_rows(spark, sf_dir, FEATURES)
    return recommend.predict_by_model(train, targets, FEATURES).select("user_id", "item_id", "prediction")


@query()
def gbt_predict(spark, sf_dir):
    return _by_model(spark, sf_dir)


@query()
def hybrid_predict(spark, sf_dir):
    """Both parts from one reading of the reviews. Strangers are not asked for: the model does not predict them."""
    work = Workspace(spark, "hybrid")
    ratings = work.keep(adapters.reviews(spark, sf_dir), "ratings")
    work.release()
    every = work.keep(recommend.rated_pairs(ratings), "every")
    work.release()
    train, targets = _model_rows(spark, sf_dir, FEATURES, ratings, every.select("user_id", "item_id", "stars"))
    by_model = recommend.predict_by_model(train, targets, FEATURES)
    by_items = recommend.predict_by_items(ratings, every.select("user_id", "item_id"), every=every)
    work.drop("every")
    return recommend.blend(by_items, by_model)


@query()
def kfold_ensemble(spark, sf_dir):
    train, targets = _model_rows(spark, sf_dir, ALL_FEATURES)
    models = recommend.fit_folds(train, ALL_FEATURES, ["user_id", "item_id"])
    return recommend.predict_by_ensemble(models, targets).select("user_id", "item_id", "prediction")


def _item_mean_errors(spark, sf_dir):
    ratings = adapters.reviews(spark, sf_dir)
    user, item = recommend.means(ratings, "user_id").withColumnRenamed("mean", "um"), recommend.means(ratings, "item_id").withColumnRenamed("mean", "im")
    return ratings.join(user, "user_id").join(item, "item_id").select("stars", F.explode(F.create_map(F.lit("user_mean"), "um", F.lit("item_mean"), "im")).alias("model", "prediction"))


_ERRORS_SQL = f"""WITH r AS ({REVIEWS_SQL}), e AS (SELECT stars, 'user_mean' AS model, avg(stars) OVER (PARTITION BY user_id) AS prediction FROM r UNION ALL
SELECT stars, 'item_mean', avg(stars) OVER (PARTITION BY item_id) FROM r)"""


@query(_ERRORS_SQL + " SELECT model, round(sqrt(avg((stars - prediction) * (stars - prediction))), 6) AS rmse FROM e GROUP BY 1")
def rmse_by_model(spark, sf_dir):
    return relational.rmse(_item_mean_errors(spark, sf_dir), "stars", "prediction", "model").withColumn("rmse", F.round("rmse", 6))


@query(_ERRORS_SQL + """, bins AS (SELECT least(floor(round(abs(stars - prediction), 9)), 4)::BIGINT AS error, count(*) AS n FROM e WHERE model = 'item_mean' GROUP BY 1)
SELECT error, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 5)) AS error) LEFT JOIN bins USING (error)""")
def error_histogram(spark, sf_dir):
    errors = _item_mean_errors(spark, sf_dir).filter("model = 'item_mean'")
    return relational.error_histogram(errors.select(F.lit(0.0).alias("stars"), F.round(F.abs(F.col("stars") - F.col("prediction")), 9).alias("prediction")), "stars", "prediction")


# --- graphs ---

_EDGES_SQL = f"""busy AS (SELECT DISTINCT user_id, item_id FROM r WHERE user_id IN (SELECT user_id FROM r GROUP BY 1 HAVING count(*) >= {CROWD})),
edges AS (SELECT x.user_id AS u, y.user_id AS v, count(*) AS common FROM busy x JOIN busy y ON x.item_id = y.item_id AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= {OVERLAP})"""


def _edges(spark, sf_dir):
    edges = graph.co_occurrence_edges(adapters.reviews(spark, sf_dir).select("user_id", "item_id"), OVERLAP)
    return Workspace(spark, "edges").keep(edges, "edges")


@query(f"WITH r AS ({REVIEWS_SQL}), {_EDGES_SQL} SELECT u, v, common FROM edges")
def graph_edges(spark, sf_dir):
    return graph.co_occurrence_edges(adapters.reviews(spark, sf_dir).select("user_id", "item_id"), OVERLAP)


@query(f"WITH r AS ({REVIEWS_SQL}), {_EDGES_SQL} SELECT id, count(*) AS degree FROM (SELECT u AS id FROM edges UNION ALL SELECT v FROM edges) GROUP BY 1")
def graph_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE r AS ({REVIEWS_SQL}), {_EDGES_SQL}, links AS (SELECT u AS a, v AS b FROM edges UNION ALL SELECT v, u FROM edges),
reach AS (SELECT DISTINCT a AS id, a AS other FROM links UNION SELECT reach.id, b FROM reach JOIN links ON reach.other = links.a)
SELECT id, min(other) AS component FROM reach GROUP BY 1""")
def components(spark, sf_dir):
    return graph.components(_edges(spark, sf_dir))


_LABELS_SQL = f"WITH r AS ({REVIEWS_SQL}), {_EDGES_SQL}, links AS (SELECT u AS a, v AS b FROM edges UNION ALL SELECT v, u FROM edges), l0 AS (SELECT DISTINCT a AS id, a AS label FROM links)" + "".join(
    f", l{i + 1} AS (SELECT a AS id, label FROM (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, label) AS place FROM links JOIN l{i} ON b = id GROUP BY a, label) WHERE place = 1)" for i in range(5)
)


@query(_LABELS_SQL + " SELECT id, label FROM l5")
def label_propagation(spark, sf_dir):
    return graph.label_propagation(_edges(spark, sf_dir))


@query()
def edge_betweenness(spark, sf_dir):
    return graph.edge_betweenness(_edges(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 5))


@query()
def girvan_newman(spark, sf_dir):
    found = graph.girvan_newman(_edges(spark, sf_dir))
    return found.select(F.size("members").alias("size"), F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


# --- streams ---

_BLOOM, _FM = sketches.bloom_family(), sketches.fm_family()


@query(f"""WITH s AS ({STREAM_SQL}), f AS (SELECT * FROM (VALUES {", ".join(f"({h.a}::BIGINT, {h.b}::BIGINT, {h.p}::BIGINT, {h.m}::BIGINT)" for h in _BLOOM)}) AS t(a, b, p, m)),
bits AS (SELECT DISTINCT seq, batch_id, id, ((id % p * a + b) % p) % m AS bit FROM s, f), firsts AS (SELECT bit, min(seq) AS first FROM bits GROUP BY 1),
told AS (SELECT seq, batch_id, id, max(first) < seq AS positive FROM bits JOIN firsts USING (bit) GROUP BY 1, 2, 3), met AS (SELECT id, min(seq) AS met FROM s GROUP BY 1)
SELECT batch_id, CASE WHEN count_if(met >= seq) > 0 THEN round(count_if(met >= seq AND positive)::DOUBLE / count_if(met >= seq), 9) END AS fpr FROM told JOIN met USING (id) GROUP BY 1""")
def bloom_fpr(spark, sf_dir):
    return sketches.bloom_rates(adapters.stream(spark, sf_dir), _BLOOM).withColumn("fpr", F.round("fpr", 9))


@query(f"SELECT batch_id, count(DISTINCT id) AS truth FROM ({STREAM_SQL}) GROUP BY 1")
def fm_truth(spark, sf_dir):
    return sketches.distinct_truth(adapters.stream(spark, sf_dir))


@query(f"""WITH s AS ({STREAM_SQL}), f AS (SELECT * FROM (VALUES {", ".join(f"({i}, {h.a}::BIGINT, {h.b}::BIGINT, {h.p}::BIGINT, {h.m}::BIGINT)" for i, h in enumerate(_FM))}) AS t(i, a, b, p, m)),
h AS (SELECT batch_id, i, bin(((id % p * a + b) % p) % m) AS digits FROM s, f), z AS (SELECT batch_id, i, max(length(digits) - length(rtrim(digits, '0'))) AS zeros FROM h GROUP BY 1, 2),
g AS (SELECT batch_id, i // {sketches.FM_HASHES // sketches.FM_GROUPS} AS part, avg(pow(2.0, zeros)) AS mean FROM z GROUP BY 1, 2)
SELECT batch_id, floor(median(mean))::BIGINT AS estimate FROM g GROUP BY 1""")
def fm_estimate(spark, sf_dir):
    return sketches.distinct_estimate(adapters.stream(spark, sf_dir), _FM)


@query(f"SELECT seq, id, md5(concat_ws(':', '553', id::VARCHAR, seq::VARCHAR)) AS priority FROM ({STREAM_SQL}) ORDER BY priority, seq LIMIT 100")
def reservoir_priority(spark, sf_dir):
    return sketches.uniform_sample(adapters.stream(spark, sf_dir))


# --- clusters ---


@query("""WITH p AS (SELECT label::BIGINT AS label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dimension FROM embeddings)
SELECT label, dimension::INTEGER AS dimension, count(*) AS n, round(sum(x), 6) AS total, round(sum(x * x), 6) AS squares FROM p GROUP BY 1, 2""")
def cluster_stats(spark, sf_dir):
    found = clustering.cluster_statistics(adapters.points(spark, sf_dir), "label")
    return found.select("label", "dimension", "n", F.round("total", 6).alias("total"), F.round("squares", 6).alias("squares"))


@query()
def kmeans_assign(spark, sf_dir):
    return clustering.kmeans(adapters.points(spark, sf_dir), 10).select("index", "cluster")


@query()
def bfr_rounds(spark, sf_dir):
    return clustering.bfr(adapters.points(spark, sf_dir), 10)[0]


@query()
def bfr_assign(spark, sf_dir):
    return clustering.bfr(adapters.points(spark, sf_dir), 10)[1]
