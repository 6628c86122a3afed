"""Document fingerprints: invertible Bloom look-up sketches of paragraph digests.

A text is cut into paragraphs: its lines, and within a line, pieces that end at
words whose hash says so, so that an edit changes the pieces it touches and no
others. Each distinct paragraph digest goes into one cell of each of three
thirds of a sketch: a count, the xor of the digests and the xor of their check
values. Subtracting two sketches leaves what differs; peeling cells that hold a
single digest recovers both sides' own digests. Where peeling stops early, both
sketches are built again, larger, until it ends. The likeness of two
texts is the share of paragraphs they have in common.

All sketches of a batch are one flat array: insertion, subtraction and each
peeling round are numpy operations over all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.words import Texts, _byte_powers, mixed, span_hashes, texts_of
from strandweave.session import parts_for

CELLS = 24  # of a fingerprint: three thirds of 8
LONG = 3  # a paragraph ends at one word in 2^LONG
WAYS = 3
GROWTH = 4  # of a sketch that could not be peeled


def digests(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paragraph digests of every row, and where each row's start."""
    words = texts.words()
    n = len(words.starts)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    hashes = words.hashes()
    rows = words.rows()
    ends = (hashes >> np.uint64(64 - LONG)) == 0
    ends[words.offsets[1:][words.offsets[1:] > words.offsets[:-1]] - 1] = True
    lines = np.concatenate([[0], np.cumsum(texts.data == 0x0A)])
    ends[:-1] |= lines[words.ends[:-1]] != lines[words.starts[1:]]
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    own = mixed(span_hashes(hashes, first, last + 1, _byte_powers), 3)
    of = rows[first]
    order = np.lexsort((own, of))
    own, of = own[order], of[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
    own, of = own[new], of[new]
    return own, np.searchsorted(of, np.arange(len(texts) + 1))


def _check(keys: np.ndarray) -> np.ndarray:
    return mixed(keys, 9) & np.uint64(0xFFFFFFFF)


def _cells(keys: np.ndarray, size: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The WAYS cells of each key, one in each part of its sketch (size cells from base)."""
    part = size // WAYS
    return np.stack([base + k * part + (mixed(keys, 11 + k) % part.astype(np.uint64)).astype(np.int64) for k in range(WAYS)])


def sketches(keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray, sign: int = 1, into: tuple | None = None) -> tuple:
    """Counts, key xors and check xors of all rows' sketches; rows: of each key; sizes: cells of each row."""
    base = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    count, xor, check = into or (np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.uint64))
    if len(keys):
        at = _cells(keys, sizes[rows], base[rows]).ravel()
        value = np.tile(keys, WAYS)
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        cell = at[first]
        count[cell] += sign * np.diff(np.append(first, len(at)))
        xor[cell] ^= np.bitwise_xor.reduceat(value, first)
        check[cell] ^= np.bitwise_xor.reduceat(_check(value), first)
    return count, xor, check


def peeled(count: np.ndarray, xor: np.ndarray, check: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many digests are the first's own, how many the second's, by row; whether peeling ended."""
    n = len(sizes)
    of = np.repeat(np.arange(n), sizes)
    base = np.cumsum(sizes) - sizes
    plus, minus = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for _ in range(200):
        pure = np.flatnonzero((np.abs(count) == 1) & (_check(xor) == check))
        if not len(pure):
            break
        keys, rows, sign = xor[pure], of[pure], count[pure]
        order = np.lexsort((keys, rows))
        keys, rows, sign = keys[order], rows[order], sign[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        keys, rows, sign = keys[new], rows[new], sign[new]
        plus += np.bincount(rows[sign > 0], minlength=n)
        minus += np.bincount(rows[sign < 0], minlength=n)
        for s in (1, -1):
            own = sign == s
            at = _cells(keys[own], sizes[rows[own]], base[rows[own]])
            for k in range(WAYS):
                np.subtract.at(count, at[k], s)
                np.bitwise_xor.at(xor, at[k], keys[own])
                np.bitwise_xor.at(check, at[k], _check(keys[own]))
    bad = np.zeros(n, dtype=bool)
    bad[of[(count != 0) | (xor != 0)]] = True
    return plus, minus, ~bad


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Of row k of a to row k of b: common paragraphs over all paragraphs; 1 if neither has any."""
    n = len(a[1]) - 1
    na, nb = np.diff(a[1]), np.diff(b[1])
    out = np.ones(n)
    # At least this many digests differ: no sketch too small for them is tried.
    size = np.maximum(cells, (np.abs(na - nb) * 3 // 2 + WAYS - 1) // WAYS * WAYS)
    todo = np.arange(n)
    while len(todo):
        sizes = size[todo]
        keys = []
        for own, at in (a, b):
            num = (at[1:] - at[:-1])[todo]
            take = np.repeat(at[:-1][todo] - (np.cumsum(num) - num), num) + np.arange(num.sum())
            keys.append((own[take], np.repeat(np.arange(len(todo)), num)))
        cell = sketches(*keys[0], sizes)
        cell = sketches(*keys[1], sizes, -1, cell)
        plus, minus, done = peeled(*cell, sizes)
        good = todo[done]
        common = np.minimum(na[good] - plus[done], nb[good] - minus[done])
        union = na[good] + nb[good] - common
        out[good] = np.where(union > 0, common / np.maximum(union, 1), 1.0)
        todo = todo[~done]
        size[todo] *= GROWTH
    return np.clip(out, 0.0, 1.0)


def _hex_fingerprints(d: tuple[np.ndarray, np.ndarray], cells: int) -> list[str]:
    n = len(d[1]) - 1
    count, xor, check = sketches(d[0], np.repeat(np.arange(n), np.diff(d[1])), np.full(n, cells))
    body = np.zeros((n, cells, 16), dtype=np.uint8)
    body[:, :, :4] = count.astype("<u4").view(np.uint8).reshape(n, cells, 4)
    body[:, :, 4:12] = xor.astype("<u8").view(np.uint8).reshape(n, cells, 8)
    body[:, :, 12:] = check.astype("<u4").view(np.uint8).reshape(n, cells, 4)
    return [row.tobytes().hex() for row in body]


def _edited(text: str, after: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _compare(cells: int, batch_chars: int = 1 << 20):
    def finish(rows: list[tuple], after: str | None) -> pa.RecordBatch:
        """rows: (id, text); the last one's next text is after."""
        own = [t for _, t in rows]
        following = [*own[1:], after if after is not None else own[-1]]
        new = [_edited(t, f) for t, f in zip(own, following, strict=True)]
        a, b, c = (digests(texts_of(pa.array(x, pa.large_string()))) for x in (own, new, [following[-1]]))
        # The next text of all rows but the last is the next row's.
        heads = a[1][1:]
        nxt = (np.concatenate([a[0][heads[0] :], c[0]]), np.concatenate([heads, [heads[-1] + c[1][1]]]) - heads[0])
        prints, changed = _hex_fingerprints(a, cells), _hex_fingerprints(b, cells)
        return pa.record_batch(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
                pa.array(prints, pa.string()),
                pa.array(changed, pa.string()),
                pa.array(likeness(a, b, cells), pa.float64()),
                pa.array(likeness(a, nxt, cells), pa.float64()),
            ],
            names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows, size, guest = None, [], 0, False
        for batch in batches:
            for place, is_guest, key, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if place != own:
                    if rows:
                        yield finish(rows, None)
                    own, rows, size, guest = place, [], 0, False
                if is_guest:
                    # What follows the last row of the range; it comes last, maybe from several tasks.
                    if not guest and rows:
                        yield finish(rows, text)
                        rows = []
                    guest = True
                    continue
                if size > batch_chars:
                    yield finish(rows, text)
                    rows, size = [], 0
                rows.append((key, text))
                size += len(text)
        if rows:
            yield finish(rows, None)

    return run


MOST_RANGES = 1 << 17  # their bounds, 17 bytes each, travel with the code: 2.2 MB at most
SAMPLED = 16  # rows for each bound


def _order(id_col: str, mark: str) -> tuple[Column, Column, Column]:
    """Ascending in these three: descending id, null last, then the text's hash."""
    return F.col(id_col).isNull(), F.coalesce(F.bitwise_not(F.col(id_col)), F.lit(0)), F.col(mark)


class Ranges:
    """Bounds of ranges of rows in the order of _order; a bound is the first row of its range.

    A row that is its own bound several times over (copies of one row are a large share of
    all) has several ranges in which nothing but copies stand, and a last one where other
    rows follow. Copies are dealt to these in turn, the first of each task to the last
    range, so that the last copy is followed by what follows them.
    """

    def __init__(self, none: np.ndarray, down: np.ndarray, mark: np.ndarray):
        by = np.lexsort((mark, down, none))
        self.none, self.down, self.mark = none[by], down[by], mark[by]

    def __len__(self) -> int:
        return len(self.none)

    def _span(self, down: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 bound with the id of each row."""
        known = int(np.searchsorted(self.none, True))
        left = np.where(none, known, np.searchsorted(self.down[:known], down))
        right = np.where(none, len(self.none), np.searchsorted(self.down[:known], down, side="right"))
        return left, right

    def deal(self, down: np.ndarray, none: np.ndarray, mark: np.ndarray, seen: dict[int, int], salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, range, is guest) of every row and of the first rows of ranges, which are guests in the range before.

        seen: how many copies of each many-fold bound the task has dealt.
        """
        left, right = self._span(down, none)
        home = left - 1
        guests: list[tuple[int, int]] = []
        for k in np.flatnonzero(left < right):
            own = self.mark[left[k] : right[k]]
            a, b = left[k] + int(np.searchsorted(own, mark[k])), left[k] + int(np.searchsorted(own, mark[k], side="right"))
            home[k] = b - 1
            if a < b:
                n = seen.get(a, 0)
                seen[a] = n + 1
                if not n:
                    guests.append((k, (a - 1) % len(self)))
                elif b - a > 1:
                    home[k] = a + (n + salt) % (b - a)
        row = np.concatenate([np.arange(len(down)), np.array([k for k, _ in guests], dtype=np.int64)])
        place = np.concatenate([home, np.array([r for _, r in guests], dtype=np.int64)])
        return row, place, np.arange(len(row)) >= len(down)


def _bounds(rows: DataFrame, ranges: int) -> Ranges:
    """About as many ranges of equal size, from a sample of the rows; the first row of all is a bound."""
    keys = rows.select(*(c.alias(n) for n, c in zip(("none", "down", "mark"), _order("_id", "_mark"), strict=True)))
    first = keys.agg(F.min(F.struct("none", "down", "mark")).alias("x"), F.count("*").alias("n")).first()
    if not first["n"]:
        return Ranges(np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    step = SAMPLED
    share = min(1.0, step * ranges / first["n"])
    some = (keys.sample(share, 7) if share < 1 else keys).orderBy("none", "down", "mark")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = step // 2
        for batch in batches:
            yield batch.take(pa.array(range(at, batch.num_rows, step), pa.int64()))
            at = (at - batch.num_rows) % step

    got = some.mapInArrow(every, "none boolean, down long, mark long").toArrow() if share < 1 or first["n"] > step else None
    columns = [first["x"][c] for c in ("none", "down", "mark")]
    merged = [np.array([x, *([] if got is None else got.column(k).to_pylist())]) for k, x in enumerate(columns)]
    return Ranges(merged[0].astype(bool), merged[1].astype(np.int64), merged[2].astype(np.int64))


def _homes(ranges: Ranges):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        salt, seen = context.partitionId() if context else 0, {}
        for batch in batches:
            ids = batch.column(0)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            down = np.where(none, 0, ~ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            row, place, guest = ranges.deal(down, none, batch.column(2).to_numpy(), seen, salt)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(guest), ids.take(take), batch.column(1).take(take), batch.column(2).take(take)], names=["_own", "_guest", "_id", "text", "_mark"])

    return run


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Fingerprint every text, its edited text, and how like they and the next text are.

    The edited text is the text with its last third (of its code points) replaced
    by the first as many of the next document, in descending order of id; after
    the last document comes the first. Returns the id column (whole numbers),
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next. Null texts are empty; two texts without a word are alike (1). Rows
    with equal ids follow each other by the hash of their text; rows with a null id
    come last; repeated rows follow each other. A single row follows itself; an
    empty table gives an empty one; other columns are not looked at.

    The order needs no global sort: rows go to ranges between bounds that a sample
    gives, each range to a task of its own, and the first row of a range also, as a
    guest, to the range before it. There are at most MOST_RANGES; a task reads its
    range as a stream, so that larger ranges only take longer.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_mark", F.xxhash64("text"))
    ranges = _bounds(rows.select("_id", "_mark"), min(parts_for(docs, 16 << 20), MOST_RANGES))
    schema = "_own int, _guest boolean, _id long, text string, _mark long"
    dealt = rows.mapInArrow(_homes(ranges), schema).repartitionById(max(len(ranges), 1), "_own").sortWithinPartitions("_own", "_guest", F.desc_nulls_last("_id"), "_mark", "text")
    out = dealt.mapInArrow(_compare(cells), "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("_id", id_col)
