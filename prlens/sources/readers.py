"""Sources: Parquet, CSV, the newest file of a pattern, source trees, and id columns under either name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; floating columns have NaN turned to null, so that comparisons with it are false."""
    return nan_to_null(spark.read.parquet(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in float and double columns; types stay."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(dict(df.dtypes)[c])) for c in floats}) if floats else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line ends and doubled quotes, fields of any length; header names lose blanks and a byte-order mark.

    Without a schema all columns are strings.
    """
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).option("encoding", "UTF-8")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def latest(spark: SparkSession, pattern: str) -> str:
    """The last path, in the order of names, that matches a pattern on any Hadoop file system; an error if none does."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(x.getPath()) for x in (found or []))
    if not names:
        raise FileNotFoundError(f"no file matches {pattern}")
    return names[-1]


def read_ids(df: DataFrame) -> DataFrame:
    """The id column of a table, named ``id`` or ``pr_id``, as bigint ``id``; other text becomes null."""
    names = {c.strip(): c for c in df.columns}
    if "id" not in names and "pr_id" not in names:
        raise KeyError("neither id nor pr_id is a column")
    return df.select(F.expr(f"try_cast(`{names.get('id', names.get('pr_id'))}` AS BIGINT)").alias("id"))


def read_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """Source files under a folder: ``path``, ``text``, ``size`` and ``modified``."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return df.select("path", F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def with_lineage(df: DataFrame) -> DataFrame:
    """Adds each row's file and its modification time."""
    return df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("source_modified"))


def read_findings(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """An analyser's output under a declared schema; malformed rows are kept in ``_corrupt_record``."""
    full = f"{schema}, _corrupt_record string"
    reader = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.option("multiLine", True).json(path) if form == "json" else reader.option("header", True).csv(path)


def dataset_version(df: DataFrame) -> DataFrame:
    """Files of a table, their newest change and their bytes, for a version log."""
    meta = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_size").alias("s")).distinct()
    return meta.agg(F.count(F.lit(1)).alias("files"), F.max("t").alias("last_modified"), F.sum("s").alias("bytes"), F.bit_xor(F.xxhash64("p", "s", "t")).alias("fingerprint"))
