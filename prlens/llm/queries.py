"""The registered queries of the training-data operators, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prlens.llm import oracles


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from prlens.llm.html_extract import extract_main_text

    return extract_main_text(_read(spark, sf_dir, "pages"))


def op7_jump_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by jump consistent hashing of doc_id."""
    from prlens.llm.sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"), 40)


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    from prlens.llm.quality import QualityModel

    docs = _read(spark, sf_dir, "documents")
    return QualityModel.fit(docs, _read(spark, sf_dir, "labels")).score(docs)


def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    from prlens.llm.toxicity import ToxicityModel

    docs = _read(spark, sf_dir, "documents")
    return ToxicityModel.fit(docs, _read(spark, sf_dir, "labels")).score(docs)


def op9_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base spans, and the terms that disclose them."""
    from prlens.llm.pii import find_private, span_digest

    return span_digest(find_private(_read(spark, sf_dir, "documents")))


def op10_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weights, inclusion probabilities and the sample, for all documents."""
    from prlens.llm.mixing import mix_documents, with_topic

    out = mix_documents(with_topic(_read(spark, sf_dir, "documents")))
    return out.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), "n_tokens", "weight", "probability", "selected")


def op4_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of every fiftieth vector."""
    from prlens.llm.knn import voronoi_topk

    return voronoi_topk(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document."""
    from prlens.llm.decontaminate import find_contaminated

    return find_contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 50 bytes that documents with smaller ids hold."""
    from prlens.llm.suffix_dedup import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


def op8_prefix_tree_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are similar to 85 per cent."""
    from prlens.llm.jaccard import near_duplicate_groups

    return near_duplicate_groups(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_line_block_extraction, op7_jump_hash_sharding, op2_attention_quality, op5_noisy_channel_toxicity, op9_disclosure_sanitisation, op10_raked_mixing, op4_voronoi_topk, op3_bm25_decontamination, op6_suffix_dedup, op8_prefix_tree_jaccard)}
ORACLES: dict[str, str] = {"op4_voronoi_topk": oracles.OP4, "op7_jump_hash_sharding": oracles.OP7, "op8_prefix_tree_jaccard": oracles.OP8}
