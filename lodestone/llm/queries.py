"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import html, langid, mixing, mpeg, neardup, ngram, packing, quality, secrets, toxicity
from lodestone.llm.shared import table, text_crc32


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document; the shared folder holds ids and spans only, never texts."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter(F.col("_base"), lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("_spans")).alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict; strata are languages, the holdout is the labels table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 1024 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed towards the square root of their sources' sizes, every copy with its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, details=True)


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 2-word shingles."""
    found = neardup.find(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's severity; the grades are the labels' toxic column."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return toxicity.judge(docs, toxicity.train(docs, labels), keep=["doc_id"])


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as MPEG audio, read back and indexed."""
    stored = mpeg.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = mpeg.index_media(stored)
    seek = F.hex(F.crc32(F.array_join(F.col("seek_offsets").cast("array<string>"), ",").cast("binary")))
    feature = F.format_string(
        "mpeg%s layer%d %dHz %dch frames=%d samples=%d us=%d kbps=%d-%d crc=%d/%d table=%s:%s seek=%s",
        "version", "layer", "sample_rate", "channels", "n_frames", "samples", "duration_us", "kbps_min", "kbps_max",
        F.col("crc_checked") - F.col("crc_failed"), "crc_checked", "table", "table_ok", seek,
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, without its site's template."""
    found = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = text_crc32(F.col("doc_id")) % 10 == 0
    model, found = ngram.train_and_score(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = text_crc32(F.col("doc_id")) % 5 == 0
    found = langid.identify(docs, ~held_out, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_poisson_mixing": op4_poisson_mixing,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_toxicity": op6_toxicity,
    "op7_mpeg_audio": op7_mpeg_audio,
    "op8_html_extraction": op8_html_extraction,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality.oracle(),
    "op4_poisson_mixing": mixing.oracle(),
    "op5_minhash_neardup": neardup.oracle(),
}
