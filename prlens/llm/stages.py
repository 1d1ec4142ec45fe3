"""The stages of the corpus pipeline: operators applied so that their decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more); trained on the labelled rows of ``docs``.

    A null or empty text is scored like any other; repeated rows stay or go together; an empty table gives an empty one.
    """
    from prlens.llm.quality import QualityModel

    model = QualityModel.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(model.score_of(docs, docs["text"]) >= 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more; the smallest doc_id stays.

    Rows without words stay; rows equal in id and text count once; an empty table gives an empty one.
    """
    from prlens.llm.jaccard import near_duplicate_groups, one_of_each

    return one_of_each(docs, near_duplicate_groups(docs, shingle=5, threshold=(80, 100)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts stay; repeated rows stay or go together; without items or documents nothing is found.
    """
    from prlens.llm.decontaminate import find_contaminated

    found = find_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns), prefix="_b_")
    return found.where("NOT _b_contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by the probabilities of the raked source, language and topic weights.

    Null sources and languages are categories of their own; repeated rows share their fate; an empty table gives an empty one.
    """
    from prlens.llm.mixing import mix_documents, with_topic

    return mix_documents(with_topic(docs), prefix="_m_").where("_m_selected").select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard of 40 and their place in it.

    Columns named like those that the operator adds give way. A null id has a shard too; repeated rows take
    neighbouring places; an empty table gives an empty one.
    """
    from prlens.llm.sharding import shard_documents

    added = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}  # these replace columns of their names
    return shard_documents(docs, 40, keep=tuple(c for c in docs.columns if c not in added))
