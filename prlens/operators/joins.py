"""Joins over time: as-of, intervals, history before an instant, events around an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prlens.functions.timing import DAY, micros


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the last row of ``right`` of the same key at or before its time; nulls where none is.

    Both sides are put into one sequence per key and day and carried forward; the last row of each day is carried over
    days in a table of one row a key and day. So cost is a shuffle and sort by key, day and time, not grid points times
    history, and no task sorts all of a key's history. Of right rows at one instant the one with the largest values
    counts. Rows of ``left`` without key or time stay, with nulls.
    """
    payload = F.struct(F.col(right_ts).alias("_rt"), *[F.col(v).alias(f"_r_{v}") for v in values])
    day = lambda c: F.floor(micros(F.col(c)) / DAY).cast("long").alias("_d")
    whole = F.struct(*left.columns).alias("_l")
    kind = right.select(payload).schema[0].dataType
    outside = F.col(key).isNull() | F.col(left_ts).isNull()
    rows = left.where(~outside).select(F.col(key).alias("_k"), day(left_ts), F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), whole, F.lit(None).cast(kind).alias("_r"))
    events = right.where(F.col(right_ts).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), day(right_ts), F.col(right_ts).alias("_t"), payload.alias("_r"))
    inside = Window.partitionBy("_k", "_d").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(events.select("_k", "_d", "_t", F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), "_r"))
    today = both.withColumn("_r", F.last("_r", ignorenulls=True).over(inside)).where("_side = 1")
    days = rows.select("_k", "_d", "_r", F.lit(None).cast(rows.schema["_t"].dataType).alias("_t")).unionByName(events).groupBy("_k", "_d").agg(F.max(F.struct("_t", "_r")).alias("_m"))
    past = Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("_k", "_d", F.last(F.col("_m._r"), ignorenulls=True).over(past).alias("_b"))
    found = today.join(before, ["_k", "_d"], "left").select("_l", F.coalesce("_r", "_b").alias("_r"))
    found = found.unionByName(left.where(outside).select(whole, F.lit(None).cast(kind).alias("_r")))
    name = lambda c: c if c not in left.columns else c + "_right"
    return found.select("_l.*", F.col("_r._rt").alias(name(right_ts)), *[F.col(f"_r._r_{v}").alias(name(v)) for v in values])


def running_before(df: DataFrame, key: str, ts: str, sums: dict[str, Column], late: Column | None = None) -> DataFrame:
    """``df`` with running sums over rows of the same key at earlier times.

    At one time, rows with a true ``late`` come after the others, which count for them. Rows without key or time stay and
    get sums of 0; they count for no other. Sums run per day first and within a day after, so that a hot key's rows are
    spread over its days.
    """
    outside = F.col(key).isNull() | F.col(ts).isNull()
    place = micros(F.col(ts)) * 2 + (late.cast("long") if late is not None else F.lit(0))
    work = df.where(~outside).withColumn("_us", place).withColumn("_day", F.floor(F.col("_us") / (2 * DAY)).cast("long")).withColumns({f"_v_{k}": v for k, v in sums.items()})
    days = work.groupBy(key, "_day").agg(*[F.sum(f"_v_{k}").alias(f"_d_{k}") for k in sums])
    past = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(key, "_day", *[F.coalesce(F.sum(f"_d_{k}").over(past), F.lit(0)).alias(f"_p_{k}") for k in sums])
    inside = Window.partitionBy(key, "_day").orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    work = work.withColumns({f"_w_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums}).join(days, [key, "_day"])
    out = work.select(*df.columns, *[(F.col(f"_p_{k}") + F.col(f"_w_{k}")).alias(k) for k in sums])
    kinds = dict(out.dtypes)
    return out.unionByName(df.where(outside).select(*df.columns, *[F.lit(0).cast(kinds[k]).alias(k) for k in sums]))


def prior_count(df: DataFrame, key: str, ts: str, name: str = "prior_count") -> DataFrame:
    """``df`` with the number of rows of the same key strictly earlier."""
    return running_before(df, key, ts, {name: F.lit(1).cast("long")})


def open_at(df: DataFrame, key: str, start: str, end: str, name: str = "open_count") -> DataFrame:
    """``df`` with the number of intervals of the same key that are open at each row's start.

    An interval counts if it started strictly earlier and has no end or ends later. Starts count +1 and ends -1, in one
    running sum in which ends come before starts of their time; no pairs of intervals are made. Intervals that end when
    they start are never open. A row without key or start counts 0.
    """
    real = F.col(end).isNull() | (F.col(end) > F.col(start))
    begin = df.select("*", F.lit(True).alias("_own"), F.col(start).alias("_at"), F.when(real, 1).otherwise(0).cast("long").alias("_plus"))
    ends = df.where(F.col(end).isNotNull() & real).select("*", F.lit(False).alias("_own"), F.col(end).alias("_at"), F.lit(-1).cast("long").alias("_plus"))
    run = running_before(begin.unionByName(ends), key, "_at", {name: F.col("_plus")}, late=F.col("_own"))
    return run.where("_own").select(*df.columns, name)


def success_before(df: DataFrame, key: str, start: str, end: str, won: Column, name: str = "success_rate") -> DataFrame:
    """``df`` with the share of wins among rows of the same key that ended strictly before each row's start; null if none did."""
    begin = df.select("*", F.lit(1).alias("_own"), F.col(start).alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_won"))
    ends = df.where(F.col(end).isNotNull()).select("*", F.lit(0).alias("_own"), F.col(end).alias("_at"), F.lit(1).cast("long").alias("_n"), F.when(won, 1).otherwise(0).cast("long").alias("_won"))
    run = running_before(begin.unionByName(ends), key, "_at", {"_ended": F.col("_n"), "_wins": F.col("_won")})
    return run.where("_own = 1").withColumn(name, F.try_divide("_wins", "_ended")).select(*df.columns, name)


def rolling_distinct(events: DataFrame, points: DataFrame, key: str, ts: str, at: str, value: str, days: int = 90, name: str = "distinct_count") -> DataFrame:
    """``points`` with the distinct values of the events of the same key in ``[at - days, at)``.

    An event at t counts for points in (t, t + days]. Overlapping stretches of one key and value are joined, then each
    adds 1 at its beginning and takes 1 away after its end, in one running sum: events and points are never paired.
    """
    span = days * DAY
    e = events.where(F.col(value).isNotNull() & F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), micros(F.col(ts)).alias("_t"))
    w = Window.partitionBy("_k", "_v").orderBy("_t")
    e = e.withColumns({"_first": F.coalesce(F.col("_t") > F.lag("_t").over(w) + span, F.lit(True)), "_last": F.coalesce(F.col("_t") + span < F.lead("_t").over(w), F.lit(True))})
    edges = F.concat(F.when(F.col("_first"), F.array(F.struct(F.col("_t").alias("t"), F.lit(1).cast("long").alias("n")))).otherwise(F.array().cast("array<struct<t:bigint,n:bigint>>")),
                     F.when(F.col("_last"), F.array(F.struct((F.col("_t") + span).alias("t"), F.lit(-1).cast("long").alias("n")))).otherwise(F.array().cast("array<struct<t:bigint,n:bigint>>")))
    e = e.select("_k", F.explode(edges).alias("_e")).groupBy("_k", "_e.t").agg(F.sum("_e.n").alias("_step"))
    whole = F.struct(*points.columns).alias("_p")
    p = points.select(whole, F.col(key).alias("_k"), micros(F.col(at)).alias("_t"), F.lit(0).cast("long").alias("_step"))
    e = e.select(F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), "_k", F.col("t").alias("_t"), "_step")
    both = p.withColumn("_own", F.lit(True)).unionByName(e.withColumn("_own", F.lit(False))).withColumn("_t", F.timestamp_micros("_t"))
    return running_before(both, "_k", "_t", {name: F.col("_step")}).where("_own").select("_p.*", name)


def neighbours(df: DataFrame, key: str, order: list[str], is_event: Column, k: int = 10) -> DataFrame:
    """Rows up to ``k`` places before or after the first event row of their key, with their ``offset``."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(w)).withColumn("_hit", F.when(is_event, F.col("_rn")))
    at = F.min("_hit").over(Window.partitionBy(key))
    return numbered.withColumn("offset", (F.col("_rn") - at).cast("long")).where(F.col("offset").between(-k, k)).drop("_rn", "_hit")


def channel_union(*channels: DataFrame) -> DataFrame:
    """Distinct rows of several channels with the same columns."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    return out.distinct()


def line_overlap(findings: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Findings (``start_line``, ``end_line``) that touch an added range (``from_line``, ``to_line``) of the same file."""
    a = added.select(*keys, "from_line", "to_line")
    return findings.join(a, keys).where((F.col("from_line") <= F.col("end_line")) & (F.col("start_line") <= F.col("to_line"))).select(*findings.columns).distinct()


def match_snapshots(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with ``status`` kept, introduced or removed between two snapshots."""
    b, a = before.select(*keys).distinct().withColumn("_b", F.lit(True)), after.select(*keys).distinct().withColumn("_a", F.lit(True))
    status = F.when(F.col("_b").isNull(), "introduced").when(F.col("_a").isNull(), "removed").otherwise("kept")
    return b.join(a, keys, "full_outer").select(*keys, status.alias("status"))
