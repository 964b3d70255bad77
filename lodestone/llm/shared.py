"""Helpers that the corpus operators share: tables in the shared folder, row identities, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.workspace import Workspace, give_back, giving_back, size_checked

__all__ = ["Workspace", "by_length", "give_back", "giving_back", "hash_fraction", "size_checked", "table", "text_crc32"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_fraction(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 random bits from a seed and the key's text; the same in any engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def text_crc32(key: Column) -> Column:
    """crc32 of a key as text; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def by_length(texts: list[str | None], chars: int = 2_000_000):
    """A batch of texts in runs of about so many characters, so that what is made of a run stays small."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run
