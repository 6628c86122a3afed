"""Checks of a built file: counters, labels at both ends, duplicate moments, decoder log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions import text
from strandweave.operators import matching, ordered
from strandweave.plans.merge_plan import MergePlan
from strandweave.sources.bytesio import read_range, size_of
from strandweave.sources.captures import scan, units
from strandweave.sources.transport import HEAD_BYTES, PACKET, SYNC, find_streams, parse_aux_packet

REACH = 5
PROBE = 8 << 20


class NotATransportStream(ValueError):
    pass


class NoLabels(ValueError):
    pass


def label_near(path: str, stride: int, aux: int, target: int, window: int = PROBE) -> tuple[str | None, str | None]:
    """The first readable AUX label in a window around a place of the file."""
    data = read_range(path, max(0, target - window // 2), window)
    pos = data.find(SYNC)
    while 0 <= pos <= len(data) - PACKET:
        if data[pos] != SYNC:
            pos = data.find(SYNC, pos)
            continue
        if (data[pos + 1] & 31) << 8 | data[pos + 2] == aux:
            rec, tc = parse_aux_packet(data[pos : pos + PACKET])
            if rec:
                return rec, tc
        pos += stride
    return None, None


def verify(path: str) -> tuple[bool, dict]:
    """Whether labels can be read near both ends of a file."""
    found = find_streams(read_range(path, 0, HEAD_BYTES))
    if found is None or found.video is None:
        raise NotATransportStream(path)
    if found.aux is None:
        raise NoLabels(path)
    size = size_of(path)
    head, tail = (label_near(path, found.stride, found.aux, int(size * share)) for share in (0.02, 0.98))
    info = {"video_pid": found.video, "aux_pid": found.aux, "framing": found.stride, "rec_head": head[0], "rec_tail": tail[0], "tc_head": head[1], "tc_tail": tail[1]}
    return bool(head[0] and tail[0]), info


def duplicate_frames(rows: DataFrame) -> DataFrame:
    """tc, rec, copies of moments that come again after others."""
    known = rows.where("coalesce(tc, '') <> '' and coalesce(rec, '') <> ''")
    return matching.duplicate_moments(known, [], ["tc", "rec"], "j").select("tc", "rec", F.col("n").alias("copies")).orderBy("tc", "rec")


def find_duplicate_frames(spark: SparkSession, path: str) -> list[dict]:
    return [r.asDict() for r in duplicate_frames(units(scan(spark, [path]))).collect()]


def decode_errors(log: DataFrame, rows: DataFrame, line: str = "line", number: str = "n", part: Sequence[str] = ()) -> DataFrame:
    """kind, j, errors of a decoder's log: each error belongs to the unit of the next frame line.

    log: lines in order (number, line); frame lines carry a presentation time in
    seconds. Errors after the last frame line are dropped. rows: j, pts. part names
    columns of both that tell the logs of several captures apart.
    """
    known = log.withColumn("kind", text.log_class(F.col(line)))
    frames = F.when(F.col("kind") == "frame", text.frame_ticks(F.col(line)))
    after = ordered._back(part, number).rowsBetween(W.unboundedPreceding, -1)
    found = known.withColumn("ticks", F.last(frames, ignorenulls=True).over(after)).where("kind in ('error', 'container') and ticks is not null")
    probes = found.groupBy(*part, "ticks", "kind").agg(F.count("*").alias("errors"))
    at = matching.asof_truncated(probes, rows.select(*part, "j", "pts"), part, "ticks", "pts", "j")
    return at.groupBy(*part, "kind", "j").agg(F.sum("errors").alias("errors"))


def with_decode(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Units with the decode errors of their log."""
    own = errors.where("kind = 'error'").select("j", F.col("errors").cast("int").alias("_e"))
    return rows.drop("dec").join(own, "j", "left").withColumn("dec", F.coalesce("_e", F.lit(0))).drop("_e")


def decode_spots(rows: DataFrame, errors: DataFrame, residual_frames: Sequence[int], island_frames: Sequence[int]) -> DataFrame:
    """Decode errors by cause, neighbours of one cause as one spot: frame, tc, rec, kind, count.

    A cause counts within REACH units: a residual of the plan first, then a break in
    transport, then a stitched island; else the error is unexplained.
    """
    spark = rows.sparkSession
    placed = ordered.prefix_sum(rows, [], ["j"], F.col("npic"), "frame")
    starts = placed.select("j", F.col("frame").cast("long").alias("a"), (F.col("frame") + F.col("npic")).cast("long").alias("b"))
    marked = [(int(f), 0) for f in residual_frames] + [(int(f), 2) for f in island_frames]
    points = spark.createDataFrame(marked, "f long, priority int")
    planned = matching.range_join(points, starts.where("b > a"), [], "f", "a", "b", ["j"]).select("j", "priority")
    causes = planned.unionByName(rows.where("cc > 0 or tei > 0").select("j", F.lit(1).alias("priority")))
    found = matching.band_causes(errors.where("kind = 'error'"), causes, [], "j", REACH)
    names = F.array(*map(F.lit, ("residual", "transport", "stitch", "unexplained")))
    found = found.withColumn("cause", F.element_at(names, F.coalesce("cause", F.lit(3)) + 1))
    order = W.orderBy("j")
    new = (F.col("cause") != F.lag("cause").over(order)) | (F.col("j") - F.lag("j").over(order) > REACH)
    spots = ordered.islands(found, [], ["j"], new, "spot").groupBy("spot").agg(F.min("j").alias("j"), F.first("cause").alias("kind"), F.sum("errors").alias("count"))
    return spots.join(placed.select("j", "frame", "tc", "rec"), "j").select("frame", "tc", "rec", "kind", "count").orderBy("frame")


def verify_build(spark: SparkSession, path: str, plan: MergePlan, log: DataFrame | None = None) -> tuple[bool, dict]:
    """Whether a built file is what the plan says; with a decoder's log, whether its errors are explained."""
    rows = units(scan(spark, [path])).cache()
    sums = rows.agg(F.sum("cc").alias("cc"), F.sum("tei").alias("tei")).first()
    ok, info = verify(path)
    again = [r.asDict() for r in duplicate_frames(rows).collect()]
    cc, tei = int(sums["cc"] or 0), int(sums["tei"] or 0)
    info |= {"cc": cc, "expected_cc": plan.emitted_cc, "tei": tei, "expected_tei": plan.emitted_tei, "duplicate_frames": again}
    ok = ok and cc == plan.emitted_cc and tei == plan.emitted_tei and not again
    if log is not None:
        errors = decode_errors(log, rows)
        spots = [r.asDict() for r in decode_spots(rows, errors, [r["frame"] for r in plan.residuals], [s.frame0 for s in plan.segments if s.gap_before]).collect()]
        counts = {r["kind"]: r["n"] for r in errors.groupBy("kind").agg(F.sum("errors").alias("n")).collect()}
        unexplained = sum(s["count"] for s in spots if s["kind"] == "unexplained")
        info |= {"decode_errors": counts.get("error", 0), "unexplained_decode": unexplained, "seam_discontinuities": counts.get("container", 0), "decode_error_spots": spots, "decode_gate": not plan.residuals}
        ok = ok and (bool(plan.residuals) or unexplained == 0)
    rows.unpersist()
    return ok, info
