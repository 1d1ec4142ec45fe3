"""A corpus pipeline over ``documents``: five stages, each one of the operators of :mod:`prlens.llm`.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as Parquet in
the shared folder and reads it again as the next stage's ``docs``. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prlens.llm import stages

STAGES = [
    ("quality classifier", stages.quality),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("benchmark decontamination", stages.decontaminate),
    ("mixing to target weights", stages.mix),
    ("sharding", stages.shard),
]

#: The classifier, the decontamination's retrieval and the mixing's fitted weights have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, one after another."""
    from prlens.llm._arrow import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
