"""Jump consistent hashing of stable keys to shards, in built-in expressions only.

``shard`` depends on the key and the number of shards alone: there is no ring
table, and appending a shard moves only the rows that land in the new one.

Defined results: a null key is hashed as 0; a null text has no bytes; rows that
repeat (same key, same text) share their shard and take neighbouring slots; an
empty table gives an empty table; other columns of the input are ignored unless
named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the published algorithm: the 64-bit linear congruential step.
MULTIPLIER = 2862933555777941757
_M22, _M20 = (1 << 22) - 1, (1 << 20) - 1
#: Rows of a shard are numbered inside this many sub-shards, so that no task sorts a whole shard.
SUBSHARDS = 256


def jump_state(key: Column, n_shards: int) -> Column:
    """``struct(b, j)``: the shard among ``n_shards``, and the first shard count index at which the key moves next.

    The 64-bit state is held as limbs of 22, 22 and 20 bits, so that no product or sum overflows a long.
    """
    m0, m1, m2 = MULTIPLIER & _M22, (MULTIPLIER >> 22) & _M22, MULTIPLIER >> 44
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
        key.bitwiseAND(F.lit(_M22)).alias("k0"),
        F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(_M22)).alias("k1"),
        F.shiftrightunsigned(key, 44).bitwiseAND(F.lit(_M20)).alias("k2"),
    )

    def step(s: Column, _: Column) -> Column:
        t0 = s["k0"] * m0 + 1
        t1 = s["k0"] * m1 + s["k1"] * m0 + F.shiftright(t0, 22)
        t2 = s["k0"] * m2 + s["k1"] * m1 + s["k2"] * m0 + F.shiftright(t1, 22)
        k1, k2 = t1.bitwiseAND(F.lit(_M22)), t2.bitwiseAND(F.lit(_M20))
        high31 = F.shiftleft(k2, 11) + F.shiftright(k1, 11)
        j = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (high31 + 1).cast("double")))
        moved = F.struct(s["j"].alias("b"), j.cast("long").alias("j"), t0.bitwiseAND(F.lit(_M22)).alias("k0"), k1.alias("k1"), k2.alias("k2"))
        return F.when(s["j"] < n_shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, step)


def _sub_shard(key: Column) -> Column:
    """The sum of a key's bytes modulo ``SUBSHARDS``: also spreads keys that are equal in their low bits."""
    parts = [F.shiftrightunsigned(key, 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    return F.pmod(sum(parts[1:], parts[0]), F.lit(SUBSHARDS)).cast("int")


def shard_documents(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` and the columns in ``keep``.

    ``size`` is the text's UTF-8 bytes plus 16. ``slot`` numbers the rows of a shard from 0 without gaps:
    rows are counted by (shard, sub-shard), which is at most ``n_shards * SUBSHARDS`` counts, and numbered
    inside their sub-shard; only ids, sizes and checksums are shuffled when ``keep`` is empty.
    """
    state = jump_state(F.col(key), n_shards)
    slim = df.select(
        F.col(key), *[F.col(c) for c in keep if c != key],
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        state.alias("_s"),
        _sub_shard(F.coalesce(F.col(key).cast("long"), F.lit(0))).alias("_sub"),
    ).select("*", F.col("_s.b").cast("int").alias("shard"), F.when(F.col("_s.j") == n_shards, n_shards).otherwise(F.col("_s.b")).cast("int").alias("grown_shard")).drop("_s")
    counts = slim.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_sub").orderBy(key, "text_crc32", "size")
    out = slim.withColumn("_r", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["shard", "_sub"])
    return out.select(
        key, *[c for c in keep if c != key], "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.col("_r")).cast("long").alias("slot"), "grown_shard",
    )
