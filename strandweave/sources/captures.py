"""Captures as DataFrames: discovery, scan, cache, packets.

The unit table holds one row per group of pictures. It is scanned once for each
fingerprint, kept as Parquet, and everything after works on it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from strandweave.operators.matching import asof_nearest, work_list
from strandweave.operators.ordered import _back, _before, lead_end
from strandweave.session import _in_hadoop, ship, written
from strandweave.sources import transport
from strandweave.sources.bytesio import opened, read_range, size_of
from strandweave.sources.decoder import decoded

EXTENSIONS = (".m2t", ".ts", ".m2ts", ".mts", ".mpg", ".mpeg", ".trp", ".tp", ".hdv")
VERSION = 6
UNITS = (
    "path string, tag string, fingerprint string, v int, size long, video_pid int, aux_pid int, stride int, fps double, decoded boolean, "
    "i int, off long, end long, nbytes long, npic int, closed int, broken int, pts long, h string, cc int, tei int, dec int, rec string, tc string"
)


class SameTag(ValueError):
    """Two captures have one name."""


def discover(inputs: Sequence[str]) -> list[str]:
    """Files as given, and the captures of directories in order of name; each once."""
    out: list[str] = []
    for given in inputs:
        if os.path.isdir(given):
            out += [os.path.join(given, x) for x in sorted(os.listdir(given)) if x.lower().endswith(EXTENSIONS)]
        elif not given.endswith(".idx.jsonl"):
            out.append(given)
    return list({os.path.abspath(p) if "://" not in p else p: None for p in out})


def tag_of(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def fingerprint_of(path: str) -> str:
    size, part = size_of(path), 4 << 20
    return transport.fingerprint(size, read_range(path, 0, part), read_range(path, size - part, part) if size > 2 * part else None)


RANGE = 256 << 20  # bytes of a capture that one task scans
ORDERED = 64 << 20  # and that one task numbers and labels
HEADS = "path string, fingerprint string, size long, video_pid int, aux_pid int, stride int, first long"
FOUND = "path string, at long, off long, npic int, closed int, broken int, pts long, h string, cc int, tei int, rec string, tc string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], _ARROW[kind]) for k, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Framing and streams of captures that have video."""
    for batch in batches:
        rows = []
        for path, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = transport.find_streams(read_range(path, 0, transport.HEAD_BYTES))
            if found is not None and found.video is not None:
                rows.append((path, mark, size_of(path), found.video, found.aux, found.stride, found.first))
        yield _batch(rows, HEADS)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units, and labels (without a hash), of ranges of captures."""
    for batch in batches:
        for r in batch.to_pylist():
            streams = transport.Streams(r["stride"], r["first"], r["video_pid"], r["aux_pid"])
            with opened(r["path"]) as f:
                found, labels = transport.units_between(f, streams, r["a"], r["b"], r["size"])
            yield _batch([(r["path"], u.at, u.off, u.npic, u.closed, u.broken, u.pts, u.h, u.cc, u.tei, None, None) for u in found], FOUND)
            yield _batch([(r["path"], at, at, *[None] * 7, rec, tc) for at, rec, tc in labels], FOUND)


def _paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1), "path")


def _marks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, fingerprint and v of captures, each read by a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(p, fingerprint_of(p), VERSION) for p in batch.column(0).to_pylist()], "path string, fingerprint string, v int")

    ship(spark)
    return written(_paths(spark, paths).mapInArrow(run, "path string, fingerprint string, v int"), "marks")


def _edges(found: DataFrame) -> DataFrame:
    """What a range of a capture needs of the others: path, range, units before it, where the next unit starts, the labels next to it."""
    unit = F.col("h").isNotNull()
    label = F.when(~unit, F.struct("off", F.struct("rec", "tc").alias("label")))
    each = found.groupBy("path", "range").agg(F.count_if(unit).alias("n"), F.min(F.when(unit, F.col("off"))).alias("first"), F.min(label).alias("low"), F.max(label).alias("high"))
    before, after = _before(["path"], "range"), _back(["path"], "range").rowsBetween(W.unboundedPreceding, -1)
    return each.select("path", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), *(F.last(c, True).over(w).alias(name) for c, w, name in (("first", after, "next"), ("high", before, "behind"), ("low", after, "ahead"))))


def scan(spark: SparkSession, paths: Sequence[str], range_bytes: int = RANGE) -> DataFrame:
    """Head and unit rows of captures; a task reads one range of one capture.

    Numbers, ends and labels follow from the order of a capture's units: they are the
    ordered operators' work, again a range at a time. A row for each range, broadcast,
    says what it needs of the others.
    """
    heads = written(_marks(spark, paths).select("path", "fingerprint").repartition(max(len(paths), 1), "path").mapInArrow(_heads, HEADS), "heads")
    starts = F.sequence(F.col("first"), F.greatest("first", F.col("size") - 1), F.lit(range_bytes))
    ranges = heads.withColumn("a", F.explode(starts)).withColumn("b", F.least(F.col("a") + range_bytes, "size"))
    n = max(1, sum(-(-r["size"] // range_bytes) for r in heads.select("size").collect()))
    found = written(ranges.repartition(n, "path", "a").mapInArrow(_ranges, FOUND), "found")
    found = found.withColumn("range", F.col("off") - F.pmod("off", F.lit(min(range_bytes, ORDERED))))
    edges = _edges(found)
    labels = found.where("h is null").select("path", "range", "off", F.struct("rec", "tc").alias("label"))
    for side in ("behind", "ahead"):
        labels = labels.unionByName(edges.where(F.col(side).isNotNull()).select("path", "range", f"{side}.*"))
    labelled = asof_nearest(found.where("h is not null").drop("rec", "tc"), labels, ["path", "range"], "off", "label")
    facts = heads.select("path", tag_column(F.col("path")).alias("tag"), "fingerprint", F.lit(VERSION).alias("v"), "size", "video_pid", "aux_pid", "stride", F.lit(25.0).alias("fps"), F.lit(False).alias("decoded"))
    # Dealt by path alone, a capture would be one task's.
    labelled = labelled.join(F.broadcast(facts), "path").join(F.broadcast(edges.select("path", "range", "before", "next")), ["path", "range"])
    ended = lead_end(labelled, ["path", "range"], "off", F.coalesce("next", "size"))
    units = ended.withColumn("i", (F.col("before") + F.row_number().over(W.partitionBy("path", "range").orderBy("off", "at")) - 1).cast("int"))
    units = units.withColumn("nbytes", F.col("end") - F.col("off")).withColumn("dec", F.lit(0)).select("*", "label.rec", "label.tc")
    schema = T._parse_datatype_string(UNITS)
    first = facts.withColumn("i", F.lit(-1)).select(*(F.col(x.name) if x.name in (*facts.columns, "i") else F.lit(None).cast(x.dataType).alias(x.name) for x in schema))
    return first.unionByName(units.select(*(F.col(x.name).cast(x.dataType).alias(x.name) for x in schema)))


def tag_column(path: Column) -> Column:
    """What tag_of says, as a column: the file's name without its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def _kept(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none where there is no cache yet."""
    system, there = _in_hadoop(spark, cache)
    return spark.read.schema(UNITS).parquet(cache) if system.exists(there) else spark.createDataFrame([], UNITS)


def _due(marks: DataFrame, kept: DataFrame, decode: bool) -> tuple[list[str], list[str]]:
    """Captures to scan, and captures that were scanned and are still to be decoded."""
    keys = ["path", "fingerprint", "v"]
    heads = kept.where("i = -1").select(*keys, "decoded")
    scan_these = [r["path"] for r in work_list(marks, heads, keys).collect()]
    done = heads.where("decoded")
    owed = [r["path"] for r in work_list(marks, done, keys).collect()] if decode else []
    return scan_these, [p for p in owed if p not in set(scan_these)]


def index(spark: SparkSession, paths: Sequence[str], cache: str | None = None, force: bool = False, decoder: Sequence[str] | None = None) -> DataFrame:
    """Units of captures, from the cache where path, fingerprint and version agree.

    With a decoder's command, captures that were not decoded yet are, and keep it in
    the cache. A capture's rows are one partition of the cache, which is replaced
    whole when its work is done.
    """
    if cache is None:
        fresh = scan(spark, paths)
        return decoded(written(fresh, "scan"), decoder) if decoder else fresh
    marks = _marks(spark, paths)
    kept = _kept(spark, cache)
    todo, owed = _due(marks, kept, decoder is not None)
    todo, owed = (list(paths), []) if force else (todo, owed)
    if todo or owed:
        fresh = scan(spark, todo) if todo else spark.createDataFrame([], UNITS)
        if owed:
            fresh = fresh.unionByName(kept.join(marks.drop("v"), ["path", "fingerprint"], "left_semi").where(F.col("path").isin(owed) & (F.col("v") == VERSION)).select(fresh.columns))
        fresh = written(fresh, "scan")
        done = written(decoded(fresh, decoder), "decoded") if decoder else fresh
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("path").parquet(cache)
    return _kept(spark, cache).join(marks.drop("v"), ["path", "fingerprint"], "left_semi").where(F.col("v") == VERSION)


def needs_work(spark: SparkSession, paths: Sequence[str], cache: str, decode: bool = False) -> list[str]:
    """Captures that index() would scan or, if decode, decode."""
    todo, owed = _due(_marks(spark, paths), _kept(spark, cache), decode)
    return [p for p in paths if p in {*todo, *owed}]


def units(table: DataFrame) -> DataFrame:
    """Unit rows with the capture's tag as `capture`; two captures of one tag are refused."""
    twice = table.where("i = -1").groupBy("tag").agg(F.count_distinct("path").alias("n")).where("n > 1").select("tag").limit(5).collect()
    if twice:
        raise SameTag(f"captures share a name: {', '.join(r['tag'] for r in twice)}")
    return table.where("i >= 0").withColumn("capture", F.col("tag")).withColumn("j", F.col("i").cast("long"))


def save_jsonl(table: DataFrame, path: str, to: str) -> None:
    """One capture's index as JSON lines: the head, then a unit a line; keys in order."""
    rows = [r.asDict() for r in table.where(F.col("path") == path).orderBy("i").collect()]
    head = {k: rows[0][k] for k in ("tag", "fingerprint", "v", "size", "video_pid", "aux_pid", "fps", "decoded")}
    own = ("i", "off", "end", "nbytes", "npic", "closed", "broken", "pts", "h", "cc", "tei", "dec", "rec", "tc")
    part = f"{to}.part"
    with open(part, "w") as f:
        for r in [head, *({k: x[k] for k in own} for x in rows[1:])]:
            f.write(json.dumps(r, sort_keys=True) + "\n")
    os.replace(part, to)


def save_index(table: DataFrame, path: str, to: str) -> bool:
    """Write a capture's index file unless one of the same content, version and decode pass is there; whether it was written."""
    head = table.where((F.col("path") == path) & (F.col("i") == -1)).select("fingerprint", "v", "decoded").first()
    if os.path.exists(to):
        with open(to) as f:
            first = f.readline()
        known = json.loads(first) if first.startswith("{") else {}
        if [known.get(k) for k in ("fingerprint", "v", "decoded")] == list(head):
            return False
    save_jsonl(table, path, to)
    return True


def load_jsonl(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(head, units) of an index in JSON lines; a missing version is 1, a missing dec 0."""
    lines = spark.read.text(path)
    head = json.loads(lines.first()[0])
    schema = "i int, off long, end long, nbytes long, npic int, closed int, broken int, pts long, h string, cc int, tei int, dec int, rec string, tc string"
    rows = lines.select(F.from_json("value", schema).alias("u")).select("u.*").where("i is not null")
    return head | {"v": head.get("v", 1)}, rows.withColumn("dec", F.coalesce("dec", F.lit(0)))


def index_path(source: str, cache_dir: str | None = None) -> str:
    return os.path.join(cache_dir, os.path.basename(source) + ".idx.jsonl") if cache_dir else source + ".idx.jsonl"


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, stride: int):
        self.path, self.start, self.end, self.stride = path, start, end, stride


PACKETS = "path string, off long, pid int, unit_start boolean, tei boolean, afc int, cc int, disc boolean, packet binary"


class CaptureSource(DataSource):
    """spark.read.format("tscapture"): packets of captures, read in packet-aligned ranges.

    Option path may name several files, divided by commas; packets_per_partition sets
    the ranges. Equality filters on pid are applied while reading. Packets out of step
    with the first sync are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "tscapture"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema: T.StructType) -> "CaptureReader":
        return CaptureReader(self.options)


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.each = int(options.get("packets_per_partition", transport.PACKETS_PER_READ * 8))
        self.pids: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("pid",):
                self.pids = {f.value} if self.pids is None else self.pids & {f.value}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            size, found = size_of(path), transport.detect_framing(read_range(path, 0, transport.HEAD_BYTES))
            if found:
                stride, first = found
                out += [_Range(path, at, min(at + self.each * stride, size), stride) for at in range(first, size, self.each * stride)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as f:
            f.seek(part.start)
            at = part.start
            while at < part.end:
                data = f.read(min(part.stride * 8192, part.end - at))
                n = len(data) // part.stride
                n += len(data) - n * part.stride >= transport.PACKET
                if not n:
                    return
                rows = np.frombuffer(data + b"\0" * max(n * part.stride - len(data), 0), dtype=np.uint8)[: n * part.stride].reshape(n, part.stride)
                pid = (rows[:, 1].astype(np.int32) & 31) << 8 | rows[:, 2]
                keep = rows[:, 0] == transport.SYNC
                if self.pids is not None:
                    keep &= np.isin(pid, list(self.pids))
                k = np.flatnonzero(keep)
                own, afc = rows[k], rows[k, 3] >> 4 & 3
                body = np.ascontiguousarray(own[:, : transport.PACKET])
                yield pa.record_batch(
                    [
                        pa.array([part.path] * len(k), pa.string()),
                        pa.array(at + k * part.stride, pa.int64()),
                        pa.array(pid[k], pa.int32()),
                        pa.array(own[:, 1] & 64 > 0),
                        pa.array(own[:, 1] & 128 > 0),
                        pa.array(afc.astype(np.int32)),
                        pa.array((own[:, 3] & 15).astype(np.int32)),
                        pa.array((afc >= 2) & (own[:, 4] > 0) & (own[:, 5] & 128 > 0)),
                        pa.array([x.tobytes() for x in body], pa.binary()),
                    ],
                    names=[x.split()[0] for x in PACKETS.split(", ")],
                )
                at += len(data)


def packets(spark: SparkSession, paths: Sequence[str], per_partition: int | None = None) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)
    reader = spark.read.format("tscapture").option("path", ",".join(paths))
    return (reader.option("packets_per_partition", per_partition) if per_partition else reader).load()
