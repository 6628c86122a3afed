"""Mixing of sources to target weights by entropy balancing, in DataFrame operations alone.

Targets: sources, by code point with null last, have weights that repeat a
pattern; they share `share` of all words, none above `most` times its own words,
and what a source cannot take is shared again by weight (water filling).

Rates: of all ways to give the documents of a source rates between 0 and `most`
whose words meet the target, the one nearest to equal rates (least relative
entropy) is an exponential tilt, rate = most / (1 + odds * exp(-t * x)) with x the
document's size in mean sizes. The tilt t solves a convex one-dimensional dual
for each source; all are found at once by safeguarded Newton steps, each an
aggregation over (source, size) counts. Sums are of decimals, so that reruns agree
to the last digit.

Copies: the rate's whole part is taken. For the rest, documents stand in the order
of hash / fraction, which takes each with about its probability, until the
source's missing words are reached; the one at the boundary gives only the words
that are still missing. The boundary is found from a histogram of that order and
a finer one within its bucket, and only the last bucket is sorted, so that no
task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.session import discard, written

BINS = 1 << 8
STEPS = 30
UNIT = 1 << 30  # decimals of sums are whole numbers of 1/UNIT
FEW = 10_000  # sources that are broadcast at most, some 100 bytes each
ALIKE = 1 << 16  # rows alike in all that one task makes out of one
CLOSE = 1e-6  # of the target's share of a source; rounding into copies meets what is left


def n_words(text: Column) -> Column:
    """Number of words: of the places where a word ends."""
    spaces = "\x09\x0a\x0b\x0c\x0d"
    plain = F.concat(F.translate(F.coalesce(text, F.lit("")), spaces, " " * len(spaces)), F.lit(" "))
    return F.regexp_count(plain, F.lit("[^ ] ")).cast("long")


def _is_small(table: DataFrame) -> bool:
    """Whether a table with a row for each source may be broadcast, and ordered by one task."""
    return table.limit(FEW + 1).count() <= FEW


def _beside(rows: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with what `sources` has of their source, under its own names apart from the source's."""
    named = sources.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def running(table: DataFrame, order: list[Column], sums: dict[str, Column], few: bool) -> DataFrame:
    """table with sums over the rows before each one in an order of all rows.

    A table that is not small is dealt out in ranges of that order; the ranges' own
    sums, a row for each partition, are all that one task adds up.
    """
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    if few:
        return table.withColumns({name: F.coalesce(F.sum(x).over(before), F.lit(0)) for name, x in sums.items()})
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(table.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(*(F.sum(x).alias(f"_{name}") for name, x in sums.items()))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_{name}").over(ahead), F.lit(0)).alias(f"_{name}") for name in sums))
    both = placed.join(F.broadcast(parts), "_part")  # a row for each partition
    return both.withColumns({name: F.coalesce(F.sum(x).over(within), F.lit(0)) + F.col(f"_{name}") for name, x in sums.items()}).drop("_part", *(f"_{name}" for name in sums))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, few: bool = True) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    The water level is found in closed form: sources fill up in the order of
    capacity per weight, and the level fits those that are not full.
    """
    ranked = running(sizes, [F.col("source").asc_nulls_last()], {"_k": F.lit(1)}, few)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_k", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    filled = running(ranked, [(F.col("_cap") / F.col("_w")).asc(), F.col("_k").asc()], {"_full": F.col("_cap"), "_wfull": F.col("_w")}, few)
    totals = ranked.agg((share * F.sum("source_size")).alias("_all"), F.sum("_w").alias("_weights"))
    level = (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_wfull"))
    # The level with the sources before this one full; the first that is not full has the true one.
    filled = filled.crossJoin(F.broadcast(totals)).withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))  # one row
    true = filled.agg(F.max("_level").alias("_true"))
    # share <= most, so a level exists unless all are full
    return filled.crossJoin(F.broadcast(true)).select("source", "source_size", F.coalesce(F.least("_cap", F.col("_true") * F.col("_w")), F.col("_cap")).alias("target"))


def _exact(x: Column) -> Column:
    """A number whose sums do not depend on their order."""
    return F.round(x * UNIT).cast("decimal(38,0)")


def _sum(x: Column) -> Column:
    return F.sum(_exact(x)).cast("double") / UNIT


def rates(counts: DataFrame, goals: DataFrame, most: float = 2.0, few: bool = True) -> DataFrame:
    """The tilt of each source: source, mean, tilt, from (source, size, n) and targets.

    Each step is one job, an aggregation and a join of as many rows as there are
    sources; it tells the largest gap as it writes. Newton's step is taken where it
    stays within the bracket of the root, else half of the bracket. A target at 0 or
    at the bound has no finite tilt; the bracket's end then gives it.
    """
    mean = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    base = _beside(goals, mean, few).where("mean > 0").select("source", "mean", (F.col("target") / F.col("source_size")).alias("want"))
    state = written(base.select("source", "mean", "want", F.lit(0.0).alias("tilt"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high")), "tilts")
    cells = counts.where("size > 0")
    for _ in range(STEPS):
        at = _beside(cells, state, few)
        x = F.col("size") / F.col("mean")
        rate = rate_of(F.col("tilt"), x, most)
        sums = at.groupBy("source", "mean", "want", "tilt", "low", "high").agg(
            _sum(F.col("n") * x * rate).alias("got"), _sum(F.col("n") * x).alias("all"), _sum(F.col("n") * x * x * rate * (1 - rate / most)).alias("slope")
        )
        gap = F.col("got") / F.col("all") - F.col("want")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap * F.col("all") / F.greatest("slope", F.lit(1e-12))
        step = sums.withColumn("_gap", gap).withColumn("_low", low).withColumn("_high", high).withColumn("_newton", newton)
        inside = (F.col("_newton") > F.col("_low")) & (F.col("_newton") < F.col("_high"))
        new = F.when(F.abs("_gap") < CLOSE, F.col("tilt")).when(inside, F.col("_newton")).otherwise((F.col("_low") + F.col("_high")) / 2)
        after = step.select("source", "mean", "want", F.round(new, 12).alias("tilt"), F.col("_low").alias("low"), F.col("_high").alias("high"), F.abs("_gap").alias("gap"))
        told = Observation()
        reachable = (F.col("want") > 1e-9) & (F.col("want") < most - 1e-9)
        before, state = state, written(after.observe(told, F.max(F.when(reachable, F.col("gap"))).alias("worst")), "tilts")
        discard(before)
        worst = told.get["worst"]
        if worst is None or worst < CLOSE:
            break
    return state.select("source", "mean", "tilt")


def rate_of(tilt: Column, x: Column, most: float) -> Column:
    """Rate 1 without a tilt, 0 to most with one."""
    return most / (1 + (most - 1) * F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * x))))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words the mix takes of every document.

    Returns the id column, size (words), source_size, target (of its source), rate,
    taken (words taken, repeats counted; at most `most` times the size) and the source. The
    words taken of a source are its target, rounded, where that can be. A null
    source is a source of its own, the last; null and empty texts have size 0 and
    give 0; null ids are told apart by their text, ids of any type are; repeated
    rows count as often as they come, and those at a source's boundary may be taken
    differently. An empty table gives an empty one; other columns are not looked at.
    Up to FEW sources are broadcast; more of them meet the rows in joins.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_mark"))
    rows = written(rows, "sizes")
    counts = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sizes = written(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    few = _is_small(sizes)
    goals = written(targets(sizes, weights, share, most, few), "targets")
    table = written(_beside(goals, rates(counts, goals, most, few), few, "left"), "mix")
    each = _beside(rows, table, few)
    rate = F.coalesce(rate_of(F.col("tilt"), F.col("size") / F.col("mean"), most), F.lit(0.0))
    each = each.withColumn("rate", F.round(F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(rate), 9))
    each = each.withColumn("_whole", F.floor("rate").cast("long")).withColumn("_frac", F.col("rate") - F.floor("rate"))
    # Priority: a uniform hash over the fraction; equal documents get equal ones.
    uniform = (F.pmod(F.xxhash64("_id", "size", "_mark"), F.lit(1 << 40)).cast("double") + 1) / float(1 << 40)
    each = each.withColumn("_key", F.when((F.col("_frac") > 0) & (F.col("size") > 0), F.round(uniform / F.col("_frac"), 12)))
    each = each.withColumn("_at", F.log1p("_key") * (BINS / 8)).withColumn("_bin", F.least(F.floor("_at"), F.lit(BINS - 1)).cast("int"))
    each = each.withColumn("_sub", F.least(F.floor((F.col("_at") - F.col("_bin")) * BINS), F.lit(BINS - 1)).cast("int"))
    bins = each.groupBy("source", "target", "_bin").agg(F.sum(F.when(F.col("_bin").isNotNull(), F.col("size")).otherwise(0)).alias("size"), F.sum(F.col("size") * F.col("_whole")).alias("whole"))
    by = W.partitionBy("source")
    missing = F.round(F.col("target")) - F.sum("whole").over(by)
    before = F.sum("size").over(by.orderBy(F.col("_bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    bins = bins.withColumn("_missing", missing.cast("long")).withColumn("_before", before)
    edge = bins.where("_bin is not null and _before < _missing").groupBy("source").agg(F.max(F.struct("_bin", "_before", "_missing")).alias("e"))
    edge = written(edge.select("source", F.col("e._bin").alias("_edge"), F.col("e._before").alias("_before"), F.col("e._missing").alias("_missing")), "edges")
    each = _beside(each, edge, few, "left")
    inner = each.where("_bin = _edge").groupBy("source", "_before", "_missing", "_sub").agg(F.sum("size").alias("size"))
    inner = inner.withColumn("_before", F.col("_before") + F.sum("size").over(by.orderBy("_sub").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    last = inner.where("_before < _missing").groupBy("source").agg(F.max(F.struct("_sub", "_before")).alias("e"))
    last = written(last.select("source", F.col("e._sub").alias("_last"), F.col("e._before").alias("_before")), "edges")
    each = _beside(each.drop("_before"), last, few, "left")
    inside = (F.col("_bin") < F.col("_edge")) | ((F.col("_bin") == F.col("_edge")) & (F.col("_sub") < F.col("_last")))
    sure = F.col("_whole") * F.col("size") + F.when(inside, F.col("size")).otherwise(0)
    here = F.coalesce((F.col("_bin") == F.col("_edge")) & (F.col("_sub") == F.col("_last")), F.lit(False))
    others = each.where(~here).withColumn("taken", sure)
    # The rows of the last bin in order; rows alike in all stand there once, with their number, and become rows again after.
    own = ["_id", "source", "size", "source_size", "target", "rate", "_whole", "_key", "_mark", "_before", "_missing"]
    alike = each.where(here).groupBy(*own).agg(F.count("*").alias("_n"))
    within = W.partitionBy("source").orderBy("_key", "_id", "size", "_mark").rowsBetween(W.unboundedPreceding, 0)
    alike = alike.withColumn("_room", F.col("_missing") - F.col("_before") - (F.sum(F.col("size") * F.col("_n")).over(within) - F.col("size") * F.col("_n")))
    some = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {ALIKE}"))).alias("_some"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = some.repartition(parts, "_key", "_mark", "_some")
    copies = some.withColumn("_copy", F.explode(F.sequence(F.col("_some") * ALIKE, F.least(F.col("_n"), (F.col("_some") + 1) * ALIKE) - 1)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_room") - F.col("_copy") * F.col("size")))
    at_edge = copies.withColumn("taken", F.col("_whole") * F.col("size") + extra)
    out = ["_id", "source", "size", "source_size", "target", "rate", "taken"]
    both = others.select(out).unionByName(at_edge.select(out))
    return both.select(F.col("_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"), "rate", F.col("source").alias(source_col))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs with each row as often as mix() takes it.

    All columns stay. A document taken 1.4 times is there once whole and once with
    the first 0.4 of its words, joined by blanks; one taken 0 times, such as one
    without words, isn't there. Rows are told apart by id, source and text; repeated
    rows are one row with the sum of their words. An empty table gives an empty one.
    """
    row, text = "_mix_row", F.col(text_col)
    key = F.struct(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    plan = mix(docs.select(key.alias("k"), text_col, source_col), weights, share, most, "k", text_col, source_col)
    plan = plan.groupBy("k").agg(F.sum("taken").alias("_mix_taken"), F.max("size").alias("_mix_size")).where("_mix_taken > 0")
    # Repeated rows become one before the shuffle that the join needs anyway.
    own = docs.select(key.alias("k"), F.struct(*map(F.col, docs.columns)).alias(row)).groupBy("k").agg(F.first(row).alias(row))
    both = own.join(plan, "k")
    size, taken, text = F.col("_mix_size"), F.col("_mix_taken"), F.col(f"{row}.{text_col}")
    each = both.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(taken / size))))
    words = F.least(size, taken - (F.col("_mix_copy") - 1) * size).cast("int")
    part = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")), " "), F.lit(1), words), " ")
    return each.withColumn(row, F.col(row).withField(text_col, F.when(words < size, part).otherwise(text))).select(f"{row}.*")
