"""A decoder that looks at captures: its log tells of damage that packets do not show.

The decoder is a command of the machine; it writes nothing. Captures are decoded side
by side, one task each, and the log's lines are rows. What they mean is decided in
functions.text and plans.verify.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.session import ship
from strandweave.sources.bytesio import local_path

#: A command whose log has the frame lines and messages that log_class knows.
COMMAND = ("ffmpeg", "-loglevel", "info", "-i", "{path}", "-map", "0:v:0", "-vf", "showinfo", "-f", "null", "-")
LINES = 4096


def available(command: Sequence[str] = COMMAND) -> bool:
    return shutil.which(command[0]) is not None


def logs(spark: SparkSession, paths: Sequence[str], command: Sequence[str] = COMMAND) -> DataFrame:
    """path, n, line: what the decoder says of each capture, on its error stream, in order."""
    ship(spark)
    command = tuple(command)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own = [part.replace("{path}", local_path(path) or path) for part in command]
                with subprocess.Popen(own, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True, errors="replace") as process:
                    lines: list[str] = []
                    n = 0
                    for line in process.stderr:
                        lines.append(line.rstrip("\n"))
                        if len(lines) == LINES:
                            yield _rows(path, n, lines)
                            n, lines = n + LINES, []
                    yield _rows(path, n, lines)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1), "path").mapInArrow(run, "path string, n long, line string")


def _rows(path: str, n: int, lines: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([path] * len(lines), pa.string()), pa.array(range(n, n + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["path", "n", "line"])


def decoded(table: DataFrame, command: Sequence[str] = COMMAND) -> DataFrame:
    """Head and unit rows of captures, with dec counted by the decoder."""
    from strandweave.plans.verify import decode_errors

    paths = sorted(r["path"] for r in table.where("i = -1").select("path").collect())
    rows = table.where("i >= 0").select("path", F.col("i").cast("long").alias("j"), "pts")
    errors = decode_errors(logs(table.sparkSession, paths, command), rows, part=["path"]).where("kind = 'error'")
    found = errors.select("path", F.col("j").cast("int").alias("i"), F.col("errors").cast("int").alias("_dec"))
    dec = F.when(F.col("i") >= 0, F.coalesce("_dec", F.lit(0)))
    return table.join(found, ["path", "i"], "left").withColumn("dec", dec).withColumn("decoded", F.lit(True)).select(table.columns)
