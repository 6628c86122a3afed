"""The whole analysis as one JSON object, from operators over the unit table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions import clocks
from strandweave.operators import ordered
from strandweave.plans.merge_plan import MergePlan

SCHEMA = "strandweave.analysis/1"
VERSION = "0.1.0"
POINTS = 600


def damage_runs(units: DataFrame) -> DataFrame:
    """Per capture, runs of damaged units: tc0, tc1, cc, tei, dec, ngops."""
    bad = (F.col("cc") > 0) | (F.col("tei") > 0) | (F.col("dec") > 0)
    w = W.partitionBy("capture").orderBy("j")
    marked = ordered.islands(units.withColumn("_b", bad), ["capture"], ["j"], F.lag("_b").over(w).isNull() | (F.lag("_b").over(w) != F.col("_b")), "run")
    sums = [F.sum(c).alias(c) for c in ("cc", "tei", "dec")]
    runs = marked.where("_b").groupBy("capture", "run").agg(F.min("j").alias("j0"), F.min_by("tc", "j").alias("tc0"), F.max_by("tc", "j").alias("tc1"), *sums, F.count("*").alias("ngops"))
    return runs.drop("run")


def coverage_runs(units: DataFrame, fps: float = 25.0) -> DataFrame:
    """Per capture, stretches of running timecode: tc0, tc1, j0, j1 (exclusive)."""
    known = units.withColumn("_t", clocks.timecode_seconds(F.col("tc"), fps))
    runs = ordered.sessions(known, ["capture"], ["j"], "_t", 1.0, 0.2).groupBy("capture", "session")
    return runs.agg(F.min_by("tc", "j").alias("tc0"), F.max_by("tc", "j").alias("tc1"), F.min("j").alias("j0"), (F.max("j") + 1).alias("j1")).drop("session")


def summaries(units: DataFrame) -> DataFrame:
    """One row per capture: counts, damage, first and last labels."""
    has = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("j"))
    ends = [f(c, has(c)).alias(f"{c}{k}") for c in ("rec", "tc") for k, f in ((0, F.min_by), (1, F.max_by))]
    first = [F.first(c).alias(c) for c in ("video_pid", "aux_pid", "fps", "decoded")]
    return units.groupBy("capture").agg(F.count("*").alias("ngops"), *first, *(F.sum(c).alias(c) for c in ("cc", "tei", "dec")), *ends)


def output_units(units: DataFrame, plan: MergePlan, inclusive_end: bool = False) -> DataFrame:
    """Units in output order with their frame; the last of each segment is left out unless inclusive_end."""
    spark = units.sparkSession
    rows = [(k, s.tag, s.j0, s.j1 + inclusive_end, s.frame0) for k, s in enumerate(plan.segments)]
    segments = spark.createDataFrame(rows, "seg long, capture string, j0 long, j1 long, frame0 long")
    each = segments.where("j1 > j0").withColumn("j", F.explode(F.sequence(F.col("j0"), F.col("j1") - 1)))
    placed = each.join(units.select("capture", "j", "tc", "rec", "npic"), ["capture", "j"])
    return ordered.prefix_sum(placed, ["seg"], ["j"], F.col("npic"), "_f").withColumn("frame", F.col("frame0") + F.col("_f"))


def rec_curve(out: DataFrame, target: int = POINTS) -> list[dict]:
    """Timecode and wall clock along the output, sampled."""
    both = out.where("coalesce(tc, '') <> '' and coalesce(rec, '') <> ''")
    return [{"tc": r["tc"], "rec": r["rec"]} for r in ordered.downsample(both, [], ["seg", "j"], target).orderBy("seg", "j").collect()]


def anchors(out: DataFrame, fps: float, target: int = POINTS) -> tuple[list[dict], list[int]]:
    """(frame, tc, rec) along the output, sampled, and the frames where a session's timecode starts again."""
    timed = out.withColumn("_t", clocks.timecode_seconds(F.col("tc"), fps))
    seamed = ordered.resets(timed, [], ["seg", "j"], "_t", 2.0).where("tc is not null and rec is not null")
    picked = ordered.downsample(seamed, [], ["seg", "j"], target, also=F.col("seam")).orderBy("seg", "j").collect()
    return [{"frame": r["frame"], "tc": r["tc"], "rec": r["rec"]} for r in picked], [r["frame"] for r in picked if r["seam"]]


def _nested(df: DataFrame) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in df.orderBy("capture", "j0").collect():
        own = r.asDict()
        out.setdefault(own.pop("capture"), []).append(own)
    return out


def analysis(units: DataFrame, plan: MergePlan, inclusive_end: bool = False) -> dict:
    """Everything a consumer needs: axis, sources, segments, curves and findings."""
    chain = plan.alignment.chain
    facts = {r["capture"]: r.asDict() for r in summaries(units).collect()}
    damage, coverage = _nested(damage_runs(units)), _nested(coverage_runs(units, plan.fps))
    sources = []
    for t in chain:
        own = facts[t]
        own["tag"] = own.pop("capture")
        runs = [{k: v for k, v in d.items() if k != "j0"} for d in damage.get(t, [])]
        sources.append(own | {"shift": plan.alignment.shifts.get(t, 0), "damage": runs, "coverage": coverage.get(t, [])})
    curve, points, seams = [], [], []
    if plan.segments:
        out = output_units(units, plan, inclusive_end)
        curve = rec_curve(out)
        points, seams = anchors(out, plan.fps)
    keys = ("tag", "j0", "j1", "ngops", "nbytes", "off", "end", "frame0", "gap_before", "rec", "rec_end", "tc", "tc_end")
    return {
        "schema": SCHEMA, "version": VERSION, "fps": plan.fps, "total_frames": plan.total_frames, "bad_seams": plan.bad_seams, "complete": plan.complete,
        "chain": list(chain), "sources": sources, "segments": [{k: getattr(s, k) for k in keys} for s in plan.segments],
        "rec_curve": curve, "anchors": points, "seams": seams, "multi_session": bool(seams),
        "residuals": plan.residuals, "divergences": plan.divergences, "gaps": [[g["from"], g["to"]] for g in plan.gaps], "lost": plan.lost, "unused_sources": plan.unused_sources,
    }
