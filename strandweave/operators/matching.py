"""Joins by content and by place: votes, locate, as-of, range and band joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.operators.ordered import _back


def hash_frequency(df: DataFrame, h: str = "h", capture: str = "capture") -> DataFrame:
    """How often each hash occurs, and in how many captures."""
    return df.groupBy(h).agg(F.count("*").alias("n"), F.count_distinct(capture).alias("n_captures"))


def unambiguous(df: DataFrame, most: int = 4, h: str = "h") -> DataFrame:
    """Rows whose hash occurs at most `most` times in all.

    The count is an aggregation and a join: a hash that a third of the rows share
    is no task's own, as it would be in a window.
    """
    few = df.groupBy(h).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).select(h)
    return df.join(few, h, "left_semi")


def pair_votes(df: DataFrame, most: int = 4, both_ways: bool = False) -> DataFrame:
    """Votes for shifts: p, s, delta = j_p - j_s, votes, min_j (of s), from rows (capture, j, h).

    The ambiguity cut comes before the join, so each row meets at most most - 1 others.
    """
    rows = unambiguous(df, most).select("capture", "j", "h")
    p, s = rows.select(F.col("capture").alias("p"), F.col("j").alias("j_p"), "h"), rows.select(F.col("capture").alias("s"), F.col("j").alias("j_s"), "h")
    pairs = p.join(s, "h").where(F.col("p") != F.col("s") if both_ways else F.col("p") < F.col("s"))
    return pairs.groupBy("p", "s", (F.col("j_p") - F.col("j_s")).alias("delta")).agg(F.count("*").alias("votes"), F.min("j_s").alias("min_j"))


def top_votes(votes: DataFrame) -> DataFrame:
    """The shift of each pair with the most votes; the earliest seen of equal ones."""
    best = F.min_by(F.struct("delta", "votes", "min_j"), F.struct(-F.col("votes"), F.col("min_j"), F.col("delta")))
    return votes.groupBy("p", "s").agg(best.alias("b")).select("p", "s", "b.*")


def locate(df: DataFrame) -> DataFrame:
    """Each row's place in every other capture that has its hash: t, j, q, c.

    Of several places, one whose row before has the same hash as the row before the
    probe comes first, then the nearest, then the lowest. A first row has no context.
    """
    back = F.lag("h").over(W.partitionBy("capture").orderBy("j"))
    rows = df.select("capture", "j", "h", back.alias("ph"))
    probe = rows.select(F.col("capture").alias("t"), "j", "h", F.col("ph").alias("tp"))
    build = rows.select(F.col("capture").alias("q"), F.col("j").alias("c"), "h", F.col("ph").alias("qp"))
    met = probe.join(build, "h").where("t <> q")
    rank = F.struct(F.when(F.coalesce(F.col("tp") == F.col("qp"), F.lit(False)), 0).otherwise(1), F.abs(F.col("c") - F.col("j")), F.col("c"))
    return met.groupBy("t", "j", "q").agg(F.min_by("c", rank).alias("c"))


def clean_twin(df: DataFrame, transport: Column, decode: Column, h: str = "h") -> DataFrame:
    """Adds bad: damage in transport, or a decode error that no clean row of the same hash refutes."""
    rows = df.withColumn("_t", transport).withColumn("_d", decode)
    clean = rows.where("not _t and not _d").select(F.col(h).alias("_h")).distinct()
    joined = rows.join(clean, F.col(h) == F.col("_h"), "left")
    return joined.withColumn("bad", F.col("_t") | (F.col("_d") & F.col("_h").isNull())).drop("_t", "_d", "_h")


def asof_nearest(left: DataFrame, right: DataFrame, part: Sequence[str], at: str, value: str) -> DataFrame:
    """The right row nearest to each left row (left columns, value, distance); the earlier of two as near.

    Both sides are one union, ordered by place; each row looks back and ahead. An
    exact match sorts after the left row, so it is found ahead.
    """
    cols = [c for c in left.columns if c not in (*part, at)]
    a = left.select(*part, at, F.struct(*cols).alias("_l"), F.lit(0).alias("_k"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*part, at, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.lit(1).alias("_k"), F.col(value).alias("_v"))
    both = a.unionByName(b)
    w, back = (x.rowsBetween(W.unboundedPreceding, -1) for x in (W.partitionBy(*part).orderBy(at, "_k", "_v"), _back(part, at, "_k", "_v")))
    seen = F.when(F.col("_k") == 1, F.struct(F.col(at).alias("x"), F.col("_v").alias("v")))
    both = both.withColumn("_b", F.last(seen, True).over(w)).withColumn("_f", F.last(seen, True).over(back))
    behind, ahead = F.col(at) - F.col("_b.x"), F.col("_f.x") - F.col(at)
    pick = ahead.isNull() | (behind <= ahead)
    out = both.where("_k = 0").withColumn("_p", F.when(behind.isNotNull() & pick, F.col("_b")).otherwise(F.col("_f")))
    return out.select(*part, at, "_l.*", F.col("_p.v").alias(value), F.abs(F.col("_p.x") - F.col(at)).alias("distance"))


def asof_truncated(probes: DataFrame, rows: DataFrame, part: Sequence[str], at: str, clock: str, order: str) -> DataFrame:
    """For each probe the last row before the first whose clock exceeds it; row 0 if there is none.

    Looking by the running maximum of the clock stops at that first row. Both sides are
    one union in the order of (running maximum, rows first), so no pairs are made.
    """
    reach = F.max(clock).over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    known = rows.withColumn("_m", reach).where(F.col(clock).isNotNull())
    cols = [c for c in probes.columns if c not in (*part, at)]
    b = probes.select(*part, F.col(at).alias("_m"), F.lit(1).alias("_k"), F.lit(None).cast(rows.schema[order].dataType).alias("_o"), F.struct(at, *cols).alias("_l"))
    a = known.select(*part, "_m", F.lit(0).alias("_k"), F.col(order).alias("_o"), F.lit(None).cast(b.schema["_l"].dataType).alias("_l"))
    w = W.partitionBy(*part).orderBy("_m", "_k", "_o").rowsBetween(W.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_x", F.max("_o").over(w))
    return found.where("_k = 1").select(*part, "_l.*", F.coalesce("_x", F.lit(0)).alias(order))


def next_observation(df: DataFrame, part: Sequence[str], order: Sequence[str], event: Column, observed: Column, value: str, name: str) -> DataFrame:
    """Rows of `event` with the value of the next row that is observed; rows after the last are dropped."""
    after = _back(part, *order).rowsBetween(W.unboundedPreceding, -1)
    found = df.withColumn("_e", event).withColumn(name, F.last(F.when(observed, F.col(value)), ignorenulls=True).over(after))
    return found.where(F.col("_e") & F.col(name).isNotNull()).drop("_e")


def range_join(points: DataFrame, ranges: DataFrame, part: Sequence[str], at: str, start: str, end: str, carry: Sequence[str]) -> DataFrame:
    """The range start <= at < end that holds each point; ranges of a partition don't overlap.

    A point's range is the last that starts at or before it: one ordered union, no
    inequality join.
    """
    cols = [c for c in points.columns if c not in (*part, at)]
    held = F.struct(F.col(end).alias("_end"), *carry)
    a = ranges.select(*part, F.col(start).alias("_x"), F.lit(0).alias("_k"), held.alias("_r"))
    b = points.select(*part, F.col(at).alias("_x"), F.lit(1).alias("_k"), F.struct(at, *cols).alias("_l"))
    both = a.withColumn("_l", F.lit(None).cast(b.schema["_l"].dataType)).unionByName(b.withColumn("_r", F.lit(None).cast(a.schema["_r"].dataType)))
    w = W.partitionBy(*part).orderBy("_x", "_k").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_f", F.last("_r", True).over(w)).where("_k = 1")
    return found.where(F.col(f"_l.{at}") < F.col("_f._end")).select(*part, "_l.*", *(F.col(f"_f.{c}").alias(c) for c in carry))


def band_causes(errors: DataFrame, causes: DataFrame, part: Sequence[str], at: str, reach: int = 5, priority: str = "priority") -> DataFrame:
    """errors with the least priority of a cause at most `reach` places away, null if there is none.

    Causes are spread over their 2 * reach + 1 places and reduced to one row per
    place, so the join is an equi-join without copies.
    """
    spread = causes.select(*part, F.explode(F.sequence(F.col(at) - reach, F.col(at) + reach)).alias(at), priority)
    least = spread.groupBy(*part, at).agg(F.min(priority).alias("cause"))
    return errors.join(least, [*part, at], "left")


def carriers(df: DataFrame, segment: str, length: str, moment: str) -> DataFrame:
    """Segments that are the longest carrier of some moment (ties: the lowest segment)."""
    own = df.groupBy(moment).agg(F.min_by(segment, F.struct(-F.col(length), F.col(segment))).alias(segment))
    return own.select(segment).distinct()


def duplicate_moments(df: DataFrame, part: Sequence[str], moment: Sequence[str], position: str) -> DataFrame:
    """Moments at positions that don't follow each other: first, last, n."""
    spans = df.groupBy(*part, *moment).agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))
    return spans.where("last - first + 1 > n")


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the place of their first occurrence."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def work_list(found: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the cache doesn't have with the same fingerprint and version."""
    return found.join(cached, list(keys), "left_anti")


def majority(candidates: DataFrame, part: Sequence[str], h: str = "h", order: str = "ord") -> DataFrame:
    """The most common hash of each group (the first seen of equal ones) and how often it is there."""
    counts = candidates.groupBy(*part, h).agg(F.count("*").alias("n"), F.min(order).alias("_o"))
    best = F.min_by(F.struct(h, "n"), F.struct(-F.col("n"), F.col("_o")))
    return counts.groupBy(*part).agg(best.alias("b")).select(*part, F.col(f"b.{h}").alias(h), F.col("b.n").alias("n"))


def divergences(candidates: DataFrame, part: Sequence[str], label: Column, h: str = "h", order: str = "ord") -> DataFrame:
    """Groups whose copies differ: how many hashes, and all copies in order."""
    grouped = candidates.groupBy(*part).agg(F.count_distinct(h).alias("n_hashes"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), label.alias("copy")))).alias("_c"))
    return grouped.where("n_hashes > 1").select(*part, "n_hashes", F.concat_ws(",", F.transform("_c", lambda x: x["copy"])).alias("copies"))
