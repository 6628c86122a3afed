"""Line dedup within one word edit, by a deletion-neighbourhood join.

A line is its sequence of words. An occurrence goes if the corpus has an earlier
one (by document id, then line) of the same line, or of a line within one word
edit (insertion, deletion or substitution) that leaves at least SIMILARITY of its
words. One rule for all lines: where a line is so short that an edit leaves less,
there is no edit that it may have, and an equal line alone goes.

Every line emits the hash of each of its one-word deletions: with the position
and the length, which lines that differ in that word alone share; and without,
which a line shares with the line that has this word more. Equal keys are joined
through the earliest line of each key, so a key that thousands of lines share
gives as many pairs and not their square, and every pair is verified on its
words.

Before that, most lines are known to have no partner: within one edit, two lines
share the first or the last half of their words. One shuffle of these halves
finds those that several lines have, and a Bloom filter of them, of bounded size,
tells the scan which lines take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import bloom
from strandweave.llm.words import WORD_BASES, Texts, Words, _word_powers, mixed, sliced, span_hashes, texts_of
from strandweave.session import discard, written

SIMILARITY = 0.8
LEAST = math.ceil(round(1 / (1 - SIMILARITY), 9))  # words of the shortest line of which one edit leaves that
_LAST = (1 << 63) - 1


def _lines(texts: Texts) -> tuple[Texts, np.ndarray]:
    """The same bytes with lines as rows, and where each text's lines start."""
    ends = np.flatnonzero(texts.data == 0x0A) + 1
    # A text of k line ends has k + 1 lines; empty ones are rows as well.
    at_start = np.searchsorted(ends, texts.offsets[:-1], side="right")
    first = np.concatenate([at_start + np.arange(len(texts)), [len(ends) + len(texts)]])
    out = np.empty(len(ends) + len(texts) + 1, dtype=np.int64)
    out[-1] = texts.offsets[-1]
    own = np.ones(len(out) - 1, dtype=bool)
    own[first[:-1]] = False
    out[:-1][first[:-1]] = texts.offsets[:-1]
    out[:-1][own] = ends
    return Texts(texts.data, out), first


def _spans(words: Words, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int, salt: int) -> np.ndarray:
    return mixed(span_hashes(hashes, starts, ends, _word_powers[WORD_BASES[which]]), salt)


def _line_keys(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = words.offsets[:-1], words.offsets[1:]
    return _spans(words, hashes, s, e, 0, 21), _spans(words, hashes, s, e, 1, 22)


def _halves(words: Words, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of the rows, hashes of its first and last halves, of both ways to halve an odd length."""
    s, e = words.offsets[:-1][rows], words.offsets[1:][rows]
    n = e - s
    out = []
    for c in (n // 2, (n + 1) // 2):
        size = mixed(c.astype(np.uint64), 5)
        out += [_spans(words, hashes, s, s + c, 0, 23) ^ size, mixed(_spans(words, hashes, e - c, e, 0, 24) ^ size)]
    return np.stack(out, axis=1)


def _where(batch: pa.RecordBatch, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.array([xxhash.xxh64_intdigest(texts.bytes_of(k), 42) for k in range(len(texts))], dtype=np.uint64).view(np.int64)


OCCURS = "hi long, lo long, doc long, mark long, line int, halves array<long>"


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = texts_of(batch.column(1))
            ids, marks = _where(batch, texts)
            lines, first = _lines(texts)
            words = lines.words()
            hashes = words.hashes()
            hi, lo = _line_keys(words, hashes)
            n = np.diff(words.offsets)
            solid = np.flatnonzero(n)
            of = np.searchsorted(first, solid, side="right") - 1
            halves = np.zeros((len(solid), 4), dtype=np.uint64)
            long = n[solid] >= least
            halves[long] = _halves(words, hashes, solid[long])
            # Halves once for each line of a slice; twice the same where the length is even.
            seen = np.zeros(len(solid), dtype=bool)
            seen[np.unique(hi[solid], return_index=True)[1]] = True
            count = np.where(long & seen, np.where(n[solid] % 2, 4, 2), 0)
            flat = halves[np.arange(4)[None, :] < count[:, None]].view(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hi[solid].view(np.int64)),
                    pa.array(lo[solid].view(np.int64)),
                    pa.array(ids[of]),
                    pa.array(marks[of]),
                    pa.array((solid - first[of]).astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(flat)),
                ],
                names=["hi", "lo", "doc", "mark", "line", "halves"],
            )

    return run


def _taking_part(least: int, bits: int, table: np.ndarray):
    """Lines that share a half with another line, once for each slice, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = texts_of(batch.column(1))
            lines, _ = _lines(texts)
            words = lines.words()
            hashes = words.hashes()
            hi, lo = _line_keys(words, hashes)
            rows = np.flatnonzero(np.diff(words.offsets) >= least)
            rows = rows[np.unique(hi[rows], return_index=True)[1]]
            rows = rows[bloom.has(_halves(words, hashes, rows).ravel().view(np.int64), bits, table).reshape(-1, 4).any(axis=1)]
            body = [b" ".join(lines.bytes_of(r).split()).decode("utf-8", "replace") for r in rows]
            yield pa.record_batch([pa.array(hi[rows].view(np.int64)), pa.array(lo[rows].view(np.int64)), pa.array(body, pa.string())], names=["hi", "lo", "words"])

    return run


VARIANTS = "v long, id long"
SAME, MORE, BASE = range(3)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "words", 1 << 20):
        words = texts_of(batch.column(batch.schema.get_field_index("words"))).words()
        hashes = words.hashes()
        up, down = _word_powers[WORD_BASES[0]](len(hashes) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[:-1])])
        n = np.diff(words.offsets)
        row = words.rows()
        s, e, i = words.offsets[:-1][row], words.offsets[1:][row], np.arange(len(hashes))
        left = ((sums[i] - sums[s]) + (sums[e] - sums[i + 1]) * down[1]) * down[s]
        whole = (sums[words.offsets[1:]] - sums[words.offsets[:-1]]) * down[words.offsets[:-1]]
        place = ((i - s).astype(np.uint64) << np.uint64(32)) + n[row].astype(np.uint64)
        keys = np.concatenate([mixed(mixed(left, 31) ^ mixed(place, 32)), mixed(left, 33), mixed(whole, 33)])
        role = np.repeat(np.array([SAME, MORE, BASE], dtype=np.int32), [len(left), len(left), len(whole)])
        take = np.concatenate([row, row, np.arange(len(n))])
        # A line has one deletion key only once, though equal neighbours give it twice.
        order = np.lexsort((keys, take))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (take[order][1:] != take[order][:-1])
        order = order[fresh]
        hi = batch.column(batch.schema.get_field_index("hi")).to_numpy()
        yield pa.record_batch([pa.array(keys[order].view(np.int64)), pa.array(hi[take[order]] << 2 | role[order])], names=["v", "id"])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word edit at most makes a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    return max(len(a), len(b)) - p - q <= 1


@F.pandas_udf(T.BooleanType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([within_one(x.split(" "), y.split(" ")) for x, y in zip(a, b, strict=True)], dtype=bool)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The lines that go: doc (the id; the largest long for null), mark (XXH64 of the text), gone (line numbers from 0)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    occurs = written(rows.mapInArrow(_occurrences(least), OCCURS), "lines")
    order = F.struct("doc", "mark", "line")
    firsts = occurs.groupBy("hi", "lo").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    halves = occurs.where(F.size("halves") > 0).select(F.explode("halves").alias("h"), "hi")
    shared = written(halves.groupBy("h").agg(F.min("hi").alias("a"), F.max("hi").alias("b")).where("a <> b").select("h"), "halves")
    bits, table = bloom.build(shared, shared.count())
    part = rows.select("_id", "text").mapInArrow(_taking_part(least, bits, table), "hi long, lo long, words string")
    part = part.groupBy("hi", "lo").agg(F.min("words").alias("words"))
    part = written(part.join(firsts, ["hi", "lo"]).select("hi", "lo", "words", "first.*"), "taking-part")
    # What is shuffled for every variant is its key and the line's id (62 bits of its hash, and the role); few keys
    # come twice, and only for those the lines are looked up.
    variants = part.select("hi", "words").mapInArrow(_variants, VARIANTS)
    # Written, as a very common key must not meet its count, or the lines that it may join, in one task's partition.
    again = written(variants.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"), "again")
    met = variants.join(again, "v").select("v", F.col("id").bitwiseAND(3).cast("int").alias("role"), F.shiftright("id", 2).alias("key"))
    named = part.select(F.shiftright(F.shiftleft("hi", 2), 2).alias("key"), "hi", "lo", "doc", "mark", "line")
    met = met_table = written(met.join(named, "key").drop("key"), "variants")
    line = F.struct("doc", "mark", "line", "hi", "lo")
    pick = lambda role: F.min(F.when(F.col("role") == role, line))
    keyed = written(met.groupBy("v").agg(pick(SAME).alias("same"), pick(MORE).alias("more"), pick(BASE).alias("base")), "keyed")
    met = met.join(keyed, "v").withColumn("to", F.when(F.col("role") == SAME, F.col("same")).when(F.col("role") == MORE, F.col("base")).otherwise(F.col("more")))
    own = F.struct("doc", "mark", "line")
    pairs = met.where(F.col("to").isNotNull() & (F.struct("to.doc", "to.mark", "to.line") < own)).select("hi", "lo", F.col("to.hi").alias("to_hi"), F.col("to.lo").alias("to_lo")).distinct()
    texts = part.select("hi", "lo", "words")
    theirs = texts.select(F.col("hi").alias("to_hi"), F.col("lo").alias("to_lo"), F.col("words").alias("to_words"))
    near = pairs.join(texts, ["hi", "lo"]).join(theirs, ["to_hi", "to_lo"]).where(_verified("words", "to_words")).select("hi", "lo").distinct()
    near = written(near, "near")
    discard(shared, part, again, met_table, keyed)
    every = near.select("hi", "lo", F.lit(True).alias("all"), F.lit(None).cast(firsts.schema["first"].dataType).alias("first"))
    copies = firsts.where("n > 1").select("hi", "lo", F.lit(False).alias("all"), "first")
    rules = every.unionByName(copies).groupBy("hi", "lo").agg(F.max("all").alias("all"), F.min("first").alias("first"))
    # Written: Spark can split the partitions of a very common line in a join whose sides are plain shuffles.
    rules = written(rules, "rules")
    gone = occurs.drop("halves").join(rules, ["hi", "lo"]).where(F.col("all") | (order > F.col("first")))
    # Written, as a text that very many rows have is a key of the join with the documents.
    gone = written(gone.groupBy("doc", "mark").agg(F.collect_set("line").alias("gone")), "gone")
    discard(occurs, near, rules)
    return gone


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for t, g in zip(text, gone, strict=True):
        if g is not None:
            drop = set(g)
            t = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in drop)
        out.append(t)
    return pd.Series(out)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """docs with the text without lines that an earlier line of the corpus equals or nearly equals.

    All columns stay, in their order. Lines without a word stay; a null text stays
    null; a text all of whose lines go is empty. Ids are whole numbers. Rows are ordered by id, null ids
    last, then by the hash of the text; rows alike in both (repeated rows) are one
    row for this purpose and keep or lose the same lines. An empty table gives an
    empty one.
    """
    key, mark = "_line_dedup_doc", "_line_dedup_mark"
    gone = removed_lines(docs, id_col, text_col, least).select(F.col("doc").alias(key), F.col("mark").alias(mark), F.col("gone").alias("_line_dedup_gone"))
    own = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))).withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    both = own.join(gone, [key, mark], "left")
    return both.withColumn(text_col, _without(F.col(text_col), F.col("_line_dedup_gone"))).select(docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per document: the id column, n_lines, n_kept and kept_sha256 of the text that stays (null counts as empty)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1
    before = rows.withColumn("n_lines", lines(F.col("text")))
    kept = dedup_lines(before, "_id", "text", least)
    n_kept = F.when(F.col("text") == "", F.lit(0)).otherwise(lines(F.col("text")))
    return kept.select(F.col("_id").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), n_kept.cast("long").alias("n_kept"), F.sha2("text", 256).alias("kept_sha256"))
