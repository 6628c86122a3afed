"""The merged file: byte ranges of the plan, counters made to run on, written in parallel.

Offsets of counters are known before a byte is written: they follow from each
segment's first and last packet of each stream; so is where each segment begins in
the output. So the rewrite is a map over segments. In a file system that all machines
mount, each task writes its segment's bytes to their place in one file; in another
one, tasks write part files that the driver joins in order. Either way a task that
runs again writes the same bytes, and the file takes its name when it is whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.bits import marker
from strandweave.operators.ordered import rephase
from strandweave.plans.merge_plan import MergePlan
from strandweave.session import ship
from strandweave.sources.bytesio import file_system, local_path, opened, read_range
from strandweave.sources.transport import PACKET, SYNC, detect_framing


class CannotBuild(ValueError):
    """The plan is empty, has broken seams, or its segments are not whole packets of one framing."""


READ = 65_536  # packets


def _grids(path: str, off: int, end: int, stride: int) -> Iterator[np.ndarray]:
    """Packets of a byte range, some at a time: rows of stride bytes."""
    with opened(path) as f:
        f.seek(off)
        left = end - off
        while left:
            data = f.read(min(left, stride * READ))
            if not data:
                raise CannotBuild(f"{path} ends before its segment")
            left -= len(data)
            rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, stride)
            if (rows[:, 0] != SYNC).any():
                raise CannotBuild(f"packets of {path} are not aligned")
            yield rows


def _pids(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 1].astype(np.int32) & 31) << 8 | rows[:, 2]


EDGES = "island long, seg long, pid int, first_cc int, payload int, last_cc int"


def _edges(stride: int):
    """First and last packet of each stream in each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first: dict[int, tuple[int, int]] = {}
                last: dict[int, int] = {}
                for rows in _grids(r["src"], r["off"], r["end"], stride):
                    pid = _pids(rows)
                    for p, k in zip(*np.unique(pid, return_index=True), strict=True):
                        first.setdefault(int(p), (int(rows[k, 3] & 15), int(rows[k, 3] >> 4 & 1)))
                    for p, k in zip(*np.unique(pid[::-1], return_index=True), strict=True):
                        last[int(p)] = int(rows[len(rows) - 1 - k, 3] & 15)
                n = len(first)
                yield pa.record_batch(
                    [pa.array([r["island"]] * n, pa.int64()), pa.array([r["seg"]] * n, pa.int64()), pa.array(list(first), pa.int32()), pa.array([v[0] for v in first.values()], pa.int32()), pa.array([v[1] for v in first.values()], pa.int32()), pa.array([last[p] for p in first], pa.int32())],
                    names=[x.split()[0] for x in EDGES.split(", ")],
                )

    return run


def _rewritten(r: dict, mark: bytes, stride: int) -> Iterator[bytes]:
    """The bytes that a segment has in the output."""
    shift = np.zeros(1 << 13, dtype=np.uint8)
    for x in r["offsets"] or ():
        shift[x["pid"]] = x["offset"]
    if r["gap_before"]:
        yield mark
    for rows in _grids(r["src"], r["off"], r["end"], stride):
        rows = rows.copy()
        rows[:, 3] = rows[:, 3] & 0xF0 | (rows[:, 3] + shift[_pids(rows)]) & 15
        yield rows.tobytes()


def _write(whole: str | None, folder: str, mark: bytes, stride: int):
    """Write segments: into the file `whole` where each begins, or to parts in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if whole is not None:
                    with open(whole, "r+b") as out:
                        out.seek(r["begin"])
                        for data in _rewritten(r, mark, stride):
                            out.write(data)
                        n = out.tell() - r["begin"]
                        out.flush()
                        os.fsync(out.fileno())
                else:
                    system, inner = file_system(f"{folder}/{r['seg']:09d}")
                    n = 0
                    with system.open_output_stream(inner) as out:
                        for data in _rewritten(r, mark, stride):
                            n += out.write(data)
                yield pa.record_batch([pa.array([r["seg"]], pa.int64()), pa.array([n], pa.int64())], names=["seg", "n"])

    return run


def segment_rows(spark: SparkSession, plan: MergePlan, mark: bytes = b"") -> DataFrame:
    """Segments with their island (stretch without a gap) and where they begin in the output."""
    island, begin, rows = 0, 0, []
    for k, s in enumerate(plan.segments):
        island += s.gap_before
        rows.append((island, k, s.src, s.off, s.end, s.gap_before, begin))
        begin += s.nbytes + len(mark) * s.gap_before
    return spark.createDataFrame(rows, "island long, seg long, src string, off long, end long, gap_before boolean, begin long")


def counter_offsets(spark: SparkSession, plan: MergePlan, stride: int = PACKET) -> DataFrame:
    """seg, pid, offset: what each segment adds to the counters of each stream."""
    rows = segment_rows(spark, plan).repartition(max(len(plan.segments), 1), "seg")
    return rephase(rows.mapInArrow(_edges(stride), EDGES), ["island", "pid"], "seg").select("seg", "pid", "offset")


def build(spark: SparkSession, plan: MergePlan, to: str) -> int:
    """Write the merged file; returns its size.

    `to` (a path or a URI) must be reachable by all executors. The packets' stride is
    that of the first capture; a gap's marker is filled up to it. The file appears
    whole or not at all.
    """
    ship(spark)
    if not plan.segments:
        raise CannotBuild("the plan has no segments")
    if plan.bad_seams:
        raise CannotBuild(f"{plan.bad_seams} seams of the plan do not join")
    if any(s.gap_before for s in plan.segments) and plan.video_pid is None:
        raise CannotBuild("a gap cannot be marked without a video stream")
    framing = detect_framing(read_range(plan.segments[0].src, 0, 2 << 20))
    stride = framing[0] if framing else 0
    if not stride or any(s.nbytes % stride or s.nbytes <= 0 for s in plan.segments):
        raise CannotBuild("segments are not whole packets of the first capture's framing")
    mark = marker(plan.video_pid or 0) + b"\0" * (stride - PACKET)
    offsets = counter_offsets(spark, plan, stride).groupBy("seg").agg(F.collect_list(F.struct("pid", "offset")).alias("offsets"))
    rows = segment_rows(spark, plan, mark).join(offsets, "seg", "left").repartition(len(plan.segments), "seg")
    size = sum(s.nbytes + len(mark) * s.gap_before for s in plan.segments)
    system, inner = file_system(to)
    local = local_path(to)
    whole = f"{local}.part" if local else None
    if whole:
        with open(whole, "wb") as out:
            out.truncate(size)
    else:
        system.create_dir(f"{inner}.parts", recursive=True)
    sizes = {r["seg"]: r["n"] for r in rows.mapInArrow(_write(whole, f"{to}.parts", mark, stride), "seg long, n long").collect()}
    if sum(sizes.values()) != size:
        raise CannotBuild(f"{sum(sizes.values())} bytes were written and {size} planned")
    if not whole:
        with system.open_output_stream(f"{inner}.part") as out:
            for k in sorted(sizes):
                with system.open_input_stream(f"{inner}.parts/{k:09d}") as f:
                    while data := f.read(16 << 20):
                        out.write(data)
        system.delete_dir(f"{inner}.parts")
    system.move(f"{inner}.part", inner)
    return size
