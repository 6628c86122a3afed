"""Ordered-analytic operators: runs, sessions, prefix sums, resets, samples.

Every operator takes the columns that play its roles, so the same code serves
units of captures and any ordered table. `part` names the columns within which
order holds; windows are partitioned by them, and only operators over one output
order (a merged file, at most some thousand rows an hour) may go without.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.session import written


def _by(part: Sequence[str], *order: str | Column):
    return W.partitionBy(*part).orderBy(*order)


def _upto(part: Sequence[str], *order: str | Column):
    return _by(part, *order).rowsBetween(W.unboundedPreceding, 0)


def _before(part: Sequence[str], *order: str | Column):
    return _by(part, *order).rowsBetween(W.unboundedPreceding, -1)


def _back(part: Sequence[str], *order: str | Column):
    """The order from its end. Rows from one on are looked at so: a frame that has no end is gone through anew for every row."""
    return _by(part, *(F.desc(c) for c in order))


def islands(df: DataFrame, part: Sequence[str], order: Sequence[str], change: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: `change` is true where a row starts a new one."""
    return df.withColumn(name, F.sum(F.when(change, 1).otherwise(0)).over(_upto(part, *order)))


def flag_runs(df: DataFrame, part: Sequence[str], order: str, flag: Column) -> DataFrame:
    """Runs of consecutive rows for which flag holds: first and last position, length (gaps and islands)."""
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    lag = F.lag("_f").over(_by(part, order))
    numbered = islands(marked, part, [order], lag.isNull() | (lag != F.col("_f")), "_run")
    runs = numbered.where("_f").groupBy(*part, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    return runs.drop("_run")


def longest_run(runs: DataFrame, part: Sequence[str]) -> DataFrame:
    """The longest run of each partition; the first of equal ones."""
    best = F.row_number().over(_by(part, F.desc("length"), "first"))
    return runs.withColumn("_r", best).where("_r = 1").drop("_r")


def clean_run_ahead(df: DataFrame, part: Sequence[str], order: str, bad: Column, cap: int = 120, name: str = "clean_run") -> DataFrame:
    """How many rows from this one on are clean, at most cap; positions are dense from 0."""
    ahead = _back(part, order).rowsBetween(W.unboundedPreceding, 0)
    size = F.count("*").over(W.partitionBy(*part))
    return df.withColumn(name, F.least(F.coalesce(F.min(F.when(bad, F.col(order))).over(ahead), size) - F.col(order), F.lit(cap)))


def sessions(df: DataFrame, part: Sequence[str], order: Sequence[str], value: str, up: float, down: float, name: str = "session") -> DataFrame:
    """Number sessions: a new one starts where value jumps by more than up or falls by more than down.

    Rows without a value are left out, so a jump is always seen against the last known value.
    """
    known = df.where(F.col(value).isNotNull())
    step = F.col(value) - F.lag(value).over(_by(part, *order))
    return islands(known, part, order, (step > F.lit(up)) | (step < F.lit(-down)), name)


def near_groups(df: DataFrame, part: Sequence[str], order: Sequence[str], place: str, reach: int | float, name: str = "near") -> DataFrame:
    """Number groups of rows whose place is at most reach after the row before."""
    gap = F.col(place) - F.lag(place).over(_by(part, *order))
    return islands(df, part, order, gap > F.lit(reach), name)


def coalesce_runs(df: DataFrame, part: Sequence[str], order: Sequence[str], position: str, carry: Sequence[str] = ()) -> DataFrame:
    """Merge consecutive rows with rising positions into segments j0..j1 (inclusive)."""
    step = F.col(position) - F.lag(position).over(_by(part, *order))
    numbered = islands(df, part, order, step != 1, "seg")
    first = [F.min_by(c, position).alias(c) for c in carry] + [F.max_by(c, position).alias(f"{c}_end") for c in carry]
    return numbered.groupBy(*part, "seg").agg(F.min(position).alias("j0"), F.max(position).alias("j1"), F.count("*").alias("n"), *first)


def prefix_sum(df: DataFrame, part: Sequence[str], order: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Sum of the weights of the rows before."""
    return df.withColumn(name, F.coalesce(F.sum(weight).over(_before(part, *order)), F.lit(0)))


def lead_end(df: DataFrame, part: Sequence[str], order: str, size: Column, name: str = "end") -> DataFrame:
    """The next row's offset; the last row ends at the size."""
    return df.withColumn(name, F.coalesce(F.lead(order).over(_by(part, order)), size))


def resets(df: DataFrame, part: Sequence[str], order: Sequence[str], value: str, drop: float = 2.0, name: str = "seam") -> DataFrame:
    """Whether the value lies more than drop below the last known one."""
    last = F.last(value, ignorenulls=True).over(_before(part, *order))
    return df.withColumn(name, F.coalesce(F.col(value) < last - F.lit(drop), F.lit(False)))


def lost_spans(df: DataFrame, part: Sequence[str], order: Sequence[str], clock: str, wall: str, fps: float = 25.0, jump: float = 1.5, slack: float = 1.0, share: float = 0.34) -> DataFrame:
    """Neighbouring rows between which the clock runs on, wall time agrees, and no row lies.

    clock and wall are seconds. A pair counts if the clock gains more than `jump`,
    wall time gains as well, the clock's lead on it is at most
    max(slack, share * gain), and the left row is within `slack` of the highest clock so
    far (a pair behind that was seen before). Adds `gain` and `frames` to the left rows.
    """
    w = _by(part, *order)
    gain, passed = F.lead(clock).over(w) - F.col(clock), F.lead(wall).over(w) - F.col(wall)
    front = F.max(clock).over(_upto(part, *order))
    found = df.withColumn("gain", gain).withColumn("_wall", passed).withColumn("_front", front)
    ok = (F.col("gain") > F.lit(jump)) & (F.col("_wall") > 0) & (F.col("gain") - F.col("_wall") <= F.greatest(F.lit(slack), F.lit(share) * F.col("gain"))) & (F.col(clock) >= F.col("_front") - F.lit(slack))
    frames = F.greatest(F.lit(1.0), F.rint(F.col("gain") * F.lit(fps)) - 1).cast("long")
    return found.where(ok).withColumn("frames", frames).drop("_wall", "_front")


def downsample(df: DataFrame, part: Sequence[str], order: Sequence[str], target: int = 600, also: Column | None = None, keep_last: bool = True) -> DataFrame:
    """Every n-th row, so that about target stay, with the last one and those of `also`."""
    numbered = df.withColumn("_i", F.row_number().over(_by(part, *order)) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*part)))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(target)))
    keep = (F.col("_i") % step == 0) | (also if also is not None else F.lit(False))
    if keep_last:
        keep = keep | (F.col("_i") == F.col("_n") - 1)
    return numbered.where(keep).drop("_i", "_n")


def counter_breaks(df: DataFrame, part: Sequence[str], order: Sequence[str], counter: str, payload: Column, signalled: Column, modulus: int = 16) -> DataFrame:
    """Rows with payload and whether their counter breaks the sequence.

    The counter must follow that of the payload row before, unless a discontinuity is
    signalled on this row or on a row without payload in between.
    """
    rows = df.withColumn("_p", payload).withColumn("_s", signalled)
    group = F.coalesce(F.sum(F.col("_p").cast("int")).over(_before(part, *order)), F.lit(0))
    rows = rows.withColumn("_g", group)
    excused = F.max("_s").over(W.partitionBy(*part, "_g"))
    payloads = rows.withColumn("_x", excused).where("_p")
    last = F.lag(counter).over(_by(part, *order))
    breaks = last.isNotNull() & (F.col(counter) != F.pmod(last + 1, F.lit(modulus))) & ~F.col("_x")
    return payloads.withColumn("cc_break", breaks.cast("int")).drop("_p", "_s", "_g", "_x")


def rephase(edges: DataFrame, part: Sequence[str], order: str, modulus: int = 16) -> DataFrame:
    """Offsets that make counters run on over segments: a prefix sum modulo 16.

    One row per segment and stream: first_cc, payload (of the first packet, 0 or 1), last_cc.
    """
    step = F.lag("last_cc").over(_by(part, order)) + F.col("payload") - F.col("first_cc")
    with_step = edges.withColumn("_step", F.coalesce(step, F.lit(0)))
    return with_step.withColumn("offset", F.pmod(F.sum("_step").over(_upto(part, order)), F.lit(modulus)).cast("int")).drop("_step")


def previous(df: DataFrame, order: str, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Adds prev_<column>: the values of the row before in one order of all rows.

    Rows go to buckets between quantiles of `order` (unique numbers), and each bucket
    looks at its own rows; the first of a bucket gets the last row of the bucket
    before. Only one row per bucket meets in one task.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order, [k / n for k in range(1, n)] or [1.0]).alias("_cuts"))
    placed = df.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")
    own = placed.withColumn("_own", F.lag(F.struct(*columns)).over(_by(["_b"], order)))
    edges = placed.groupBy("_b").agg(F.max_by(F.struct(*columns), F.col(order)).alias("_last"))
    edges = edges.select("_b", F.lag("_last").over(W.orderBy("_b")).alias("_edge"))
    found = own.join(F.broadcast(edges), "_b").withColumn("_own", F.coalesce("_own", "_edge"))
    return found.select(*df.columns, *(F.col(f"_own.{c}").alias(f"prev_{c}") for c in columns))


def missing_ranges(intervals: DataFrame, part: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Ranges of whole numbers between the least and greatest that no interval covers."""
    reach = F.max(hi).over(_before(part, lo, hi))
    return intervals.withColumn("_r", reach).where(F.col(lo) > F.col("_r") + 1).select(*part, (F.col("_r") + 1).alias("gap_from"), (F.col(lo) - 1).alias("gap_to"))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """Number rows from 0 in one order of all rows, and give the bucket that each is in.

    Rows are written in buckets that are ranges of the order; each bucket numbers its
    own rows, and only a count for each bucket meets in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).withColumn("_b", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", F.coalesce(F.sum("_n").over(_before([], "_b")), F.lit(0)).alias("_n"))
    own = F.row_number().over(_by(["_b"], *order)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(before), "_b").withColumn(name, (F.col("_n") + F.col("_own")).cast("long")).drop("_n", "_own")


def kway_merge(df: DataFrame, run: str, position: str, key: Column, gap: str = "gap_before") -> DataFrame:
    """Merge runs by the key of their heads, ties to the lower run; gap is true where the run changes.

    Taking the least head again and again is the order of the running maximum of the
    key within each run, so the result's places are numbers in that order.
    """
    reached = F.max(key).over(W.partitionBy(run).orderBy(position).rowsBetween(W.unboundedPreceding, 0))
    placed = written(numbered(df.withColumn("_m", reached), ["_m", run, position], "out_pos"), "merged")
    lasts = placed.groupBy("_b").agg(F.max_by(run, "out_pos").alias("_last")).withColumn("_edge", F.lag("_last").over(_by([], "_b")))
    last = F.coalesce(F.lag(run).over(_by(["_b"], "out_pos")), F.col("_edge"))
    found = placed.join(F.broadcast(lasts.select("_b", "_edge")), "_b").withColumn(gap, F.coalesce(last != F.col(run), F.lit(False)))
    return found.drop("_m", "_b", "_edge")


def chain_rank(shifts: DataFrame, shift: str = "shift", tag: str = "tag") -> DataFrame:
    """Shifts from 0 on, and the order of captures by shift, then tag."""
    moved = shifts.withColumn(shift, F.col(shift) - F.min(shift).over(W.partitionBy()))
    return moved.withColumn("chain_pos", (F.row_number().over(W.orderBy(shift, tag)) - 1).cast("long"))
