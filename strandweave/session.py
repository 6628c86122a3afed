"""Helpers that read the session: shared folders, input size, partition counts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """A cluster whose session does not say which folder all its machines share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only where the session names none and runs on one machine (master local),
    a temporary folder is made and set for the session; on a cluster that would
    be another folder on each machine, so NoSharedFolder is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _in_hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), there


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage and survives the loss of executors. zstd keeps the
    copy small; the schema is passed on so that empty tables can be read. The
    tables of an application stand in one folder, which goes when it ends;
    discard() removes one before.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/strandweave/{spark.sparkContext.applicationId}"
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, there = _in_hadoop(spark, home)
    system.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandweave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written() tables that no plan needs any more."""
    for table in tables:
        system, there = _in_hadoop(table.sparkSession, table._strandweave_path)
        system.delete(there, True)


UNKNOWN = 1 << 53  # what the optimizer says of tables it knows nothing of is more than this


def input_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of df's size in bytes (file sizes for scans); None if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN else None


def parts_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Partitions for df's data: by its size, at least the session's setting."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, (input_bytes(df) or 0) // bytes_each)


ROWS_EACH = 250_000  # narrow rows that one task sorts and groups


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as its rows need, at least the session's setting; of a file's columns the count reads footers only."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // ROWS_EACH)), *keys)


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows and 2 MB at most: texts are long, and a batch is copied a few times."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20)):
        set_to = spark.conf.get(name, None)
        if set_to is None or not 0 < int(set_to.rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once a session.

    A cluster that installs the package or names it in --py-files needs nothing
    more; this makes the queries work where neither was done.
    """
    _small_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_strandweave_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandweave-")) / "strandweave-package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._strandweave_shipped = True
