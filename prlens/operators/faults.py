"""Row-wise work that may fail: errors become data, languages choose the analyser, runs can be rehearsed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def guarded(df: DataFrame, keys: list[str], work: Callable[[dict], str], dry_run: bool = False) -> DataFrame:
    """``keys``, ``status`` (ok, error or dry_run), ``value`` and ``error`` of ``work(row)`` for every row."""
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    if dry_run:
        return df.select(*keys, F.lit("dry_run").alias("status"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            got = []
            for row in b.to_dict("records"):
                try:
                    got.append(("ok", str(work(row)), None))
                except Exception as e:  # the row's failure is its result
                    got.append(("error", None, f"{type(e).__name__}: {e}"))
            for i, c in enumerate(("status", "value", "error")):
                out[c] = pd.Series([g[i] for g in got], index=out.index, dtype=object)
            yield out

    return df.mapInPandas(run, f"{fields}, status string, value string, error string")


def dispatched(df: DataFrame, tools: dict[str, str], language: str = "language") -> DataFrame:
    """Adds the language's ``tool``, and an ``error`` for rows whose language has none."""
    pairs = [x for k, v in tools.items() for x in (F.lit(k), F.lit(v))]
    tool = F.element_at(F.create_map(*pairs), F.col(language)) if pairs else F.lit(None).cast("string")
    return df.withColumn("tool", tool).withColumn("error", F.when(F.col("tool").isNull(), F.concat(F.lit("no analyser for "), F.coalesce(F.col(language), F.lit("null")))))


def require_present(df: DataFrame, present: DataFrame, key: str, message: str) -> DataFrame:
    """Adds an ``error`` to rows whose key is not in ``present``."""
    have = present.select(key).distinct().withColumn("_have", F.lit(True))
    return df.join(have, key, "left").withColumn("error", F.when(F.col("_have").isNull(), F.lit(message))).drop("_have")
