"""Language identification by interpolated Kneser-Ney character models.

One model of order N for each language. The log-probabilities of an n-gram, in the
languages that have it, stand side by side in a table sorted by the n-gram's hash, so
a text needs one look-up per order and character for all languages together. Where a
language does not have an n-gram, the log-probability is that of the shorter n-gram
plus the context's back-off weight: interpolation makes both exact.

A text goes to the language of the lowest cross-entropy per character. It is
rejected where that cross-entropy lies above the language's limit, which
calibration sets from texts that were not counted.

Texts are normalised (lower case; each run of characters that are no letters
counts as one blank), so junk marks between words don't hide the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm.words import give_back, mixed, sliced
from strandweave.session import discard, written

ORDER = 4
#: The documented bound of the fit: so many distinct texts of each language, those of
#: the least hash of their content, are counted, and as many again calibrate.
SAMPLE = 400
KEPT_BITS = 20  # of numbers that are kept, a power of two, for n-grams times languages
MISSES = 1 << 15  # positions whose numbers are looked up at a time
UNDECIDED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = regex.compile(r"[^\p{L}]+")


def _normalised(text: str) -> str:
    """One text as _clean_points has it, apart from a blank at the end."""
    return " " + _BLANK.sub(" ", text.lower()).strip() + " "


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    out = np.zeros(0x110000, dtype=bool)
    at = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    for found in regex.finditer(r"\p{L}+", "".join(map(chr, at))):
        out[at[found.start() : found.end()]] = True
    return out


def _clean_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all normalised texts, how many each has, and how many of them are letters."""
    if not texts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    low = [f" {t.lower()} " for t in texts]
    sizes = np.array([len(t) for t in low])
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), dtype="<u4")
    starts = np.cumsum(sizes) - sizes
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    out = np.where(letter, points, np.uint32(0x20))[keep].astype(np.uint64)
    return out, np.add.reduceat(keep, starts, dtype=np.int64), np.add.reduceat(letter, starts, dtype=np.int64)


def _key_of(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram in each row."""
    out = np.zeros(len(chars), dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + chars[:, k]
    return mixed(out, n)


def _keys(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position (the first n-1 are of no use)."""
    out = np.zeros(len(points), dtype=np.uint64)
    for k in range(n):
        out[n - 1 :] = out[n - 1 :] * _BASE + points[k : len(points) - n + 1 + k]
    return mixed(out, n)


@dataclass
class Values:
    """A number for some languages of each n-gram: those of the k-th stand from start[k] to start[k + 1]."""

    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, keys: list[np.ndarray], values: list[np.ndarray]) -> "Values":
        """From each language's n-grams (all of them in hashes) and numbers."""
        at = np.searchsorted(hashes, np.concatenate(keys))
        lang = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(at, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(hashes)))])
        return cls(start, lang[order].astype(np.int32), np.concatenate(values)[order].astype(np.float32))

    def at(self, rows: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, language, number) of all that is known of the rows' n-grams."""
        counts = self.start[grams + 1] - self.start[grams]
        flat = np.repeat(self.start[grams] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.repeat(rows, counts), self.lang[flat], self.value[flat]


@dataclass
class Order:
    """Sorted hashes of n-grams; by language their log-probability, and their back-off weight as a context."""

    hashes: np.ndarray
    log_p: Values
    log_back: Values
    first: np.ndarray  # where hashes with the same top bits start

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; len(hashes) where there is none. Few steps: hashes are evenly spread."""
        if not len(self.hashes):
            return np.zeros(len(keys), dtype=np.int64)
        bits = np.uint64(64 - int(len(self.first) - 1).bit_length() + 1)
        top = (keys >> bits).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(keys), len(self.hashes), dtype=np.int64)
        live = np.flatnonzero(at < end)
        at = at[live]
        while len(live):
            hit = self.hashes[at] == keys[live]
            out[live[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end[live])
            live, at = live[more], at[more]
        return out


def _top(hashes: np.ndarray) -> np.ndarray:
    bits = max(1, int(len(hashes)).bit_length())
    return np.searchsorted(hashes >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


@dataclass
class Model:
    languages: list[str]
    floor: np.ndarray  # log-probability of a character never seen
    orders: list[Order]
    limits: np.ndarray  # highest cross-entropy that is accepted
    kept: tuple[np.ndarray, np.ndarray] | None = None  # n-grams seen of late

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": None}

    def log_probabilities(self, chars: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Of the last character of each row of chars after those before it, by language.

        known: how many characters before the last belong to the same text.
        """
        size = chars.shape[1]
        total = np.tile(self.floor, (len(chars), 1))
        for n, order in enumerate(self.orders, 1):
            may = np.flatnonzero(known >= n - 1)
            if n > 1:
                shorter = self.orders[n - 2]
                context = shorter.find(_key_of(chars[may, size - n : size - 1], n - 1))
                some = context < len(shorter.hashes)
                row, lang, back = shorter.log_back.at(may[some], context[some])
                total[row, lang] += back
            at = order.find(_key_of(chars[may, size - n :], n))
            some = at < len(order.hashes)
            row, lang, log_p = order.log_p.at(may[some], at[some])
            total[row, lang] = log_p
        return total

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of every text in every language; how many letters it has.

        What was worked out for an n-gram is kept in a table of fixed size that its
        hash addresses, so that frequent ones cost one look-up.
        """
        points, sizes, letters = _clean_points(texts)
        n, starts = len(self.orders), np.cumsum(sizes) - sizes
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        keys = _keys(points, n) if len(points) >= n else np.zeros(len(points), dtype=np.uint64)
        bits = max(8, KEPT_BITS - max(0, len(self.languages) - 1).bit_length())
        if self.kept is None:
            self.kept = np.zeros(1 << bits, dtype=np.uint64), np.zeros((1 << bits, len(self.languages)), dtype=np.float32)
        names, values = self.kept
        slot = (keys >> np.uint64(64 - bits)).astype(np.int64)
        miss = np.flatnonzero((names[slot] != keys) | (place < n - 1))
        total = values[slot]  # before others take the slots
        for part in range(0, len(miss), MISSES):
            some = miss[part : part + MISSES]
            chars = np.stack([points[np.maximum(some - k, 0)] for k in range(n - 1, -1, -1)], axis=1)
            found = self.log_probabilities(chars, place[some]).astype(np.float32)
            whole = place[some] >= n - 1
            names[slot[some[whole]]] = keys[some[whole]]
            values[slot[some[whole]]] = found[whole]
            total[some] = found
        total[place == 0] = 0
        sums = np.add.reduceat(total, starts, axis=0, dtype=np.float64) if len(points) else np.zeros((len(texts), len(self.languages)))
        return -sums / np.maximum(sizes - 1, 1)[:, None], letters

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score, rejected of every text.

        The text is judged whole. No text, or one without a letter: und, score 0, rejected.
        """
        out = pd.DataFrame({"lang_pred": UNDECIDED, "score": 0.0, "rejected": True}, index=range(len(texts)))
        size, held = 0, []
        groups = []
        for k, t in enumerate(texts):  # bounded batches of characters
            held.append(k)
            size += len(t or "")
            if size * max(4, len(self.languages)) > 1 << 20:
                groups, held, size = [*groups, held], [], 0
        for rows in [*groups, *([held] if held else [])]:
            cross, letters = self.entropies([texts[k] or "" for k in rows])
            best = cross.argmin(axis=1)
            low = cross[np.arange(len(rows)), best]
            n = np.maximum(letters, 1)
            # Posterior of the language, from evidence that is not independent between characters.
            weight = np.exp(-(cross - low[:, None]) * np.minimum(n, 200)[:, None])
            score = 1 / weight.sum(axis=1)
            slack = 6.0 / np.sqrt(n)  # short texts vary more
            for k, r in enumerate(rows):
                if letters[k]:
                    out.iat[r, 0] = self.languages[best[k]]
                    out.iat[r, 1] = float(score[k])
                    out.iat[r, 2] = bool(low[k] > self.limits[best[k]] + slack[k])
        return out


@dataclass
class Grams:
    """Distinct n-grams of one length in one language: hashes of each, of it without its last and without its first character, and counts."""

    key: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    count: np.ndarray


def _counted(points: np.ndarray, sizes: np.ndarray, n: int) -> Grams:
    """The n-grams of some normalised texts."""
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(place >= n - 1)
    key, first, count = np.unique(_keys(points, n)[at] if len(at) else np.zeros(0, dtype=np.uint64), return_index=True, return_counts=True)
    if n == 1:
        return Grams(key, np.zeros(len(key), dtype=np.uint64), np.zeros(len(key), dtype=np.uint64), count)
    shorter = _keys(points, n - 1)
    return Grams(key, shorter[at[first] - 1], shorter[at[first]], count)


def _kneser_ney(texts: list[list[str]], order: int) -> tuple[np.ndarray, list[Order]]:
    """Interpolated Kneser-Ney tables of texts that are here; texts: of each language."""
    clean = [_clean_points(own or [""]) for own in texts]
    return _tables([[_counted(p, sizes, n) for n in range(1, order + 1)] for p, sizes, _ in clean])


def _tables(grams: list[list[Grams]]) -> tuple[np.ndarray, list[Order]]:
    """Interpolated Kneser-Ney tables from the n-grams of each language, shortest first."""
    langs, order = len(grams), len(grams[0])
    spread = 1 / (len(np.unique(np.concatenate([own[0].key for own in grams]))) + 1000)  # a share for characters of no training text
    floor = np.full(langs, np.log(spread))
    log_p: list[list[np.ndarray]] = [[] for _ in range(order)]
    contexts: list[list[np.ndarray]] = [[] for _ in range(order)]
    log_back: list[list[np.ndarray]] = [[] for _ in range(order)]
    for x, own in enumerate(grams):
        lower = np.zeros(0)
        for n, g in enumerate(own):
            # Lower orders count in how many contexts an n-gram occurs; what only begins texts counts once.
            counts = np.maximum(np.bincount(np.searchsorted(g.key, own[n + 1].suffix), minlength=len(g.key)), 1) if n + 1 < order else g.count
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context, of = np.unique(g.prefix, return_inverse=True)
            total, kinds = np.bincount(of, counts, len(context)), np.bincount(of, minlength=len(context))
            back = discount * kinds / np.maximum(total, 1)
            if n:
                short = lower[np.searchsorted(own[n - 1].key, g.suffix)]
                contexts[n - 1].append(context)
                log_back[n - 1].append(np.log(back))
            else:
                short = spread
                floor[x] += np.log(back[0]) if len(back) else 0.0
            lower = np.maximum(counts - discount, 0) / total[of] + back[of] * short
            log_p[n].append(np.log(lower))
    contexts[-1], log_back[-1] = [np.zeros(0, dtype=np.uint64)] * langs, [np.zeros(0)] * langs
    tables = []
    for n in range(order):
        keys = [own[n].key for own in grams]
        hashes = np.unique(np.concatenate(keys))
        tables.append(Order(hashes, Values.of(hashes, keys, log_p[n]), Values.of(hashes, contexts[n], log_back[n]), _top(hashes)))
    return floor, tables


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from the fit: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sampled(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The sample of the fit: lang, text, rank (from 1 in its language) and n (texts of the language in the sample).

    Of each language the 2 * sample distinct texts of the least content hash; rows with
    a null language or text don't count, and copies of a text count once.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("u", F.pmod("h", F.lit(1 << 30)))
    # The share of hashes that some 3 * sample distinct texts (counted within 5 %) pass, so that no task sorts all rows.
    picked = rows.groupBy("lang").agg((F.lit(3.0 * sample) / F.approx_count_distinct("h")).alias("share"))
    picked = written(picked, "shares")
    likely = rows.join(picked, "lang").where(F.col("u") <= F.col("share") * float(1 << 30))
    order = W.partitionBy("lang").orderBy("u", "h")
    ranked = likely.select("lang", "u", "h").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * sample)
    ranked = written(ranked.select("lang", "h", "rank", F.count("*").over(W.partitionBy("lang")).alias("n")), "ranks")
    once = likely.groupBy("lang", "h").agg(F.first("text").alias("text"))
    return written(once.join(ranked, ["lang", "h"]).select("lang", "text", "rank", "n"), "sample")


GRAMS = "lang int, n int, key long, prefix long, suffix long, c long"


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            of, texts = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), dtype=object)
            for x in np.unique(of):
                points, sizes, _ = _clean_points(texts[of == x].tolist())
                for n in range(1, order + 1):
                    g = _counted(points, sizes, n)
                    size = len(g.key)
                    yield pa.record_batch([pa.array(np.full(size, x, dtype=np.int32)), pa.array(np.full(size, n, dtype=np.int32)), *(pa.array(c.view(np.int64)) for c in (g.key, g.prefix, g.suffix)), pa.array(g.count)], names=["lang", "n", "key", "prefix", "suffix", "c"])

    return run


def _own_entropy(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            of = batch.column(0).to_numpy()
            cross, letters = model.entropies(batch.column(1).to_pylist())
            some = letters > 0
            yield pa.record_batch([pa.array(of[some]), pa.array(cross[np.arange(len(of)), of][some])], names=["lang", "cross"])

    return run


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample: int = SAMPLE) -> Model:
    """Fit the models on the sample of the labelled texts (sampled()).

    Odd ranks are counted, each text whole, even ranks calibrate; a language of one
    text uses it for both. Executors count; the driver gets the distinct n-grams of the
    sample and one number for each text that calibrates. The model has 14 bytes for
    each n-gram of each language's sample, and 10 for each distinct one.
    """
    texts = sampled(labelled, text_col, lang_col, sample)
    langs = sorted(r["lang"] for r in texts.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros(0), [], np.zeros(0))
    numbered = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    rows = texts.select(numbered.alias("x"), "text", "rank", "n")
    counts = rows.where("rank % 2 = 1").select("x", "text").mapInArrow(_count(order), GRAMS)
    summed = counts.groupBy("lang", "n", "key").agg(F.min("prefix").alias("prefix"), F.min("suffix").alias("suffix"), F.sum("c").alias("c")).toArrow()
    of, size = (summed.column(c).to_numpy() for c in ("lang", "n"))
    key, prefix, suffix = (summed.column(c).to_numpy().view(np.uint64) for c in ("key", "prefix", "suffix"))
    count = summed.column("c").to_numpy()
    grams = []
    for x in range(len(langs)):
        grams.append([])
        for n in range(1, order + 1):
            at = np.flatnonzero((of == x) & (size == n))
            at = at[np.argsort(key[at])]
            grams[-1].append(Grams(key[at], prefix[at], suffix[at], count[at]))
    floor, tables = _tables(grams)
    model = Model(langs, floor, tables, np.full(len(langs), np.inf))
    right: list[list[float]] = [[] for _ in langs]
    for x, cross in rows.where("rank % 2 = 0 or n = 1").select("x", "text").mapInArrow(_own_entropy(model), "lang int, cross double").collect():
        right[x].append(cross)
    for x, own in enumerate(right):
        if own:
            middle = float(np.median(own))
            model.limits[x] = middle + max(1.2, 8 * float(np.median(np.abs(np.array(own) - middle))))
    discard(texts)
    return model


def predictor(model: Model):
    """A column function: text -> struct(lang_pred, score, rejected)."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield model.predict(part.tolist())
        give_back()

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict the language of every text, from models fit on the rows that aren't held out.

    Returns the id column, held_out, lang_pred, score (0 to 1) and rejected. A
    null or empty text, or one without a letter, is `und` with score 0. Null ids
    are not held out. Ties between languages go to the first by name; repeated
    rows get the same values. Without a labelled text every prediction is `und`,
    the score 0, and nothing is rejected, as nothing is known. An empty table gives
    an empty one; other columns are not looked at.
    """
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    if not model.languages:
        return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    found = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held"), predictor(model)(F.col(text_col)).alias("_p"))
    return found.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "_p.lang_pred", "_p.score", "_p.rejected")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the texts that identify() rejects; all columns stay. Without a labelled text all rows stay."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col)
    if not model.languages:
        return docs
    return docs.where(~predictor(model)(F.col(text_col))["rejected"])
