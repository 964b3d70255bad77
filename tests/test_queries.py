"""Every registered query with SQL gives the SQL's rows."""

import pytest

from lodestone.operators import recommend
from lodestone.plans import registry, surface  # noqa: F401  (surface registers its queries)
from lodestone.plans.registry import ORACLE_SQL, QUERIES
from lodestone.sources import adapters
from tests.oracle import same

FOLDER = "/root/testdata/sf0.001"
SLOW = {"girvan_newman", "kfold_ensemble", "hybrid_predict", "gbt_predict", "bfr_rounds", "bfr_assign"}  # have tests of their own


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert same(spark, QUERIES[name], ORACLE_SQL[name], FOLDER) is not None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name,fits", [("gbt_predict", 1), ("hybrid_predict", 1), ("kfold_ensemble", 10)])
def test_boosted_queries_fit_whole_models(spark, monkeypatch, name, fits):
    """Registered with the operators' own rounds, depth and folds; the fits themselves are cut short here."""
    asked, boosted = [], recommend.boosted

    def short(*args, **options):
        pipeline = boosted(*args, **options)
        trees = pipeline.getStages()[-1]
        asked.append((trees.getMaxIter(), trees.getMaxDepth()))
        trees.setMaxIter(1).setMaxDepth(1)
        return pipeline

    monkeypatch.setattr(recommend, "boosted", short)
    assert QUERIES[name](spark, FOLDER).count() > 0
    assert asked == [(100, 6)] * fits


def test_model_rows_read_the_reviews_once(spark, monkeypatch):
    """Training rows and targets are the feature pipeline's known pairs, from one reading of the reviews."""
    features = QUERIES["feature_pipeline"](spark, FOLDER).filter("cohort = 'known'").select("user_id", "item_id", *registry.FEATURES)
    last = recommend.last_ratings(adapters.reviews(spark, FOLDER))
    asked, reviews = [], adapters.reviews
    monkeypatch.setattr(adapters, "reviews", lambda *args: asked.append(args) or reviews(*args))
    train, targets = registry._model_rows(spark, FOLDER, registry.FEATURES)
    assert len(asked) == 1
    rows = lambda df: sorted(tuple(float(v) if v is not None else -1.0 for v in r) for r in df.select(*sorted(df.columns)).collect())
    assert rows(targets) == rows(features) != []
    assert rows(train) == rows(features.join(last, ["user_id", "item_id"]))


def test_hybrid_reads_the_reviews_once(spark, monkeypatch):
    """The blend of the two registered parts, from one reading of the reviews."""
    boosted, asked, reviews = recommend.boosted, [], adapters.reviews

    def short(*args, **options):
        pipeline = boosted(*args, **options)
        pipeline.getStages()[-1].setMaxIter(2).setMaxDepth(2)
        return pipeline

    monkeypatch.setattr(recommend, "boosted", short)
    rows = lambda df: sorted((r["user_id"], r["item_id"], round(r["prediction"], 9)) for r in df.collect())
    want = rows(recommend.blend(registry._by_items(spark, FOLDER), registry._by_model(spark, FOLDER)))
    monkeypatch.setattr(adapters, "reviews", lambda *args: asked.append(args) or reviews(*args))
    assert rows(QUERIES["hybrid_predict"](spark, FOLDER)) == want != []
    assert len(asked) == 1
