"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, packing - each stage on all that the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs; the last returns the packed pieces.

Defined results: a stage keeps rows with nulls as its operator defines them (a null id is linked with nothing and draws
as 'null', null text has no language and goes in the first stage); an empty table passes as an empty table; extra
columns pass through every stage but the last. Repeated rows are judged alike in the first stage and are one row after
the second; ties are broken as the operators state. Texts of any length pass whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, neardup, packing, secrets
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.shared import Workspace, table
from lodestone.plans import workspace

#: A document is rejected if a smaller share of its words' features was met in training, as is one without letters.
#: The score is not asked: it compares the learned languages with each other, and texts may switch between them.
LEAST_KNOWN = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language: without a letter, or with words that no language explains."""
    names = docs.columns
    place = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, place))
    found = langid.identify(docs.toDF(*place), F.lit(True), key=at["doc_id"], text=at["text"], lang=at["lang"], evidence=True)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("known") >= LEAST_KNOWN)).select(*place).toDF(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    workspace.rest_executors(spark)
    return neardup.deduplicate(docs, width=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts and counts n_chars anew; no document goes."""
    workspace.rest_executors(spark)
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources weigh the square root of their size."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of at most 1024."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A learned model and a tokenizer stand in the way of SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
