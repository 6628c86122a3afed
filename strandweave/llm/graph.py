"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.session import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The component of every node that some link names.

    links has two long columns. Returns node and root, one row per node; root is
    a node of its component, the same for all. Each round every node follows its
    neighbour of the least rank (a hash, so that no order in the values makes long
    chains) two steps, and links are renamed; the links that are left fall
    geometrically. Every round is written to the shared
    folder; what later rounds don't read is removed. Links with a null
    end or both ends alike are ignored; repeated links do no harm; an empty table
    gives an empty one.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    left = written(left, "links")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        up = up.select(F.col("a").alias("node"), F.least(rank("a"), "m")["v"].alias("root"))
        up = written(up, "parents")
        over = up.select(F.col("node").alias("root"), F.col("root").alias("over"))
        step = written(up.join(over, "root").select("node", F.col("over").alias("root")), "roots")
        steps.append(step)
        to = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"{c}2"))  # noqa: E731, B023
        renamed = left.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2")
        before, left = left, written(renamed.select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "links")
        discard(before, up)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out
