"""Labelled rows that models may learn from, as a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Remainders of crc32(doc_id as text) by this number; rows with remainder 0 are held out.
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is held out of training; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id``, ``text`` and ``label`` (0.0 or 1.0) of at most ``rows`` labelled ids, none of them held out.

    Ids are chosen by their hash, so the sample does not depend on how the tables are split. Ids that the
    labels repeat count once, with the larger label; null labels are left out.
    """
    ids = (
        labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
