"""The successor of every position, chosen among its candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.matching import majority
from strandweave.session import written

EDGE = 12


def choose(candidates: DataFrame, edge: int = EDGE) -> DataFrame:
    """One row per (t, j): the candidate that follows.

    candidates: t, j, ord (0: the same capture's next row), q, cj, h, bad, n (rows of
    q), clean_run. The true hash is the own next row's if that is clean, unless inner
    clean copies agree on another that strictly more of them have; else the most
    common among the clean, or among all if none is clean. Of the candidates that
    have it the choice is by (bad, near an edge, another capture, shorter clean run,
    order). As a bad candidate is never better than a clean one of its hash, this
    needs no separate cut. Candidates are written unless they are already, as every
    count below reads them.
    """
    if not hasattr(candidates, "_strandweave_path"):
        candidates = written(candidates, "candidates")
    x = candidates.withColumn("near_edge", F.least(F.col("cj"), F.col("n") - 1 - F.col("cj")) < edge)
    inner = x.where("not bad and not near_edge")
    inner_top = majority(inner, ["t", "j"]).select("t", "j", F.col("h").alias("mh"), F.col("n").alias("mn"))
    counts = inner.groupBy("t", "j", F.col("h").alias("oh")).agg(F.count("*").alias("oc"))
    any_clean = x.groupBy("t", "j").agg(F.max(~F.col("bad")).alias("some"))
    pool = x.join(any_clean, ["t", "j"]).where("not bad or not some")
    top = majority(pool, ["t", "j"]).select("t", "j", F.col("h").alias("ph"))
    own = x.where("ord = 0 and not bad").select("t", "j", F.col("h").alias("oh"))
    known = top.join(own, ["t", "j"], "left").join(inner_top, ["t", "j"], "left").join(counts, ["t", "j", "oh"], "left")
    outvoted = F.col("mh").isNotNull() & (F.col("mh") != F.col("oh")) & (F.coalesce("oc", F.lit(0)) < F.col("mn"))
    true = known.select("t", "j", F.when(F.col("oh").isNull(), F.col("ph")).when(outvoted, F.col("mh")).otherwise(F.col("oh")).alias("h"))
    group = x.join(true, ["t", "j", "h"])
    rank = F.struct("bad", "near_edge", F.col("q") != F.col("t"), -F.col("clean_run"), "ord")
    best = group.groupBy("t", "j").agg(F.min_by(F.struct("q", "cj", "h", "bad"), rank).alias("b"))
    return best.select("t", "j", "b.*")
