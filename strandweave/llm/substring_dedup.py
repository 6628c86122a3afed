"""Removal of repeated word windows (exact substring dedup).

Rabin-Karp hashes of every window of `size` words are counted over the whole
corpus; words covered by a window that starts more than once go. Windows are
judged on the input, so every copy of a passage goes, the first too.

The plan moves each window once, as a few bytes:

1. A map step hashes all windows of a slice of texts, counts them within the
   slice (so a passage that a third of the rows share leaves a slice once) and
   sends the rest, packed by hash range, to their bucket.
2. Each bucket finds the hashes that came more than once and tells the slices.
3. Each slice turns window starts into covered words, one row per document.
4. A join by document gives the words that stay.

Where the first step's buckets would be larger than RANGE_BYTES, a step between the
first two deals them out again: tasks that hold a bucket's windows of some slices
tell at once what is repeated among these, and send one of each hash on to a finer
bucket. So a task holds about one RANGE_BYTES at a time, whatever the input, and a
passage that a third of the rows share goes on once from each such chunk.

The hash width follows the input's size, so that the expected number of false
matches stays under 1 %.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.words import Texts, sliced, texts_of
from strandweave.session import input_bytes, parts_for

SLICE_BYTES = 4 << 20
RANGE_BYTES = 16 << 20  # of packed windows in a bucket
WINDOW_BYTES = 2.2  # packed windows to a byte of the input, as measured
CHUNK = 1_500_000  # windows that are dealt out again at a time
#: One row of pieces: n > 0, windows of one slice (owners is null) or of the slices in owners; n < 0, a slice's
#: table of -n documents (in hashes); n = 0, places (in hashes) that the slice is told.
PIECES = "bucket int, slice long, n int, hashes binary, places binary, owners binary"
_PIECES = [x.split()[0] for x in PIECES.split(", ")]
_PIECE_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
FOUND = "slice long, kind int, body binary"


def _widths(total: int | None) -> tuple[int, int]:
    """Hash buckets, and bytes of hash kept within one, for an input of so many bytes; wide ones if that is unknown."""
    total = 1 << 53 if total is None else total
    buckets = 1 << min(12, max(8, math.ceil(math.log2(max(total, 1) / (1 << 19) + 1))))
    bits = 2 * math.log2(max(total, 1 << 20)) + 7
    return buckets, min(16, max(7, math.ceil((bits - math.log2(buckets)) / 8)))


def _finer(total: int, buckets: int) -> tuple[int, int]:
    """Bits by which buckets are divided again (0: large enough as they are), and groups of slices of a bucket on the way."""
    each = total * WINDOW_BYTES / buckets
    return max(0, math.ceil(math.log2(max(each, 1) / RANGE_BYTES))), max(1, math.ceil(each / (8 * RANGE_BYTES)))


def _rest(high: np.ndarray, low: np.ndarray, taken: int, width: int) -> np.ndarray:
    """The 128 bits of both hashes without the first `taken` ones, cut to `width` bytes."""
    out = np.empty((len(high), 2), dtype=">u8")
    out[:, 0] = (high << np.uint64(taken)) | (low >> np.uint64(64 - taken))
    out[:, 1] = low << np.uint64(taken)
    return np.ascontiguousarray(out.view(np.uint8).reshape(-1, 16)[:, :width])


def _packed(values: np.ndarray) -> bytes:
    """Rising numbers as differences, in two bytes each where that is enough."""
    gaps = np.diff(values, prepend=0)
    return (b"\2" + gaps.astype("<u2").tobytes()) if not len(gaps) or gaps.max() < 1 << 16 else (b"\4" + gaps.astype("<u4").tobytes())


def _unpacked(body: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(body, dtype="<u2" if body[:1] == b"\2" else "<u4", offset=1).astype(np.int64))


def _hash_windows(size: int, buckets: int, width: int):
    shift = np.uint64(64 - int(math.log2(buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            texts = texts_of(batch.column(1))
            words = texts.words()
            hashes = words.hashes()
            at, high = words.windows(size, hashes)
            low = words.windows(size, hashes, 1)[1]
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            marks = np.array([xxhash.xxh64_intdigest(texts.bytes_of(k), 42) for k in range(len(texts))], dtype=np.uint64)
            own = xxhash.xxh64_intdigest(ids.tobytes() + marks.tobytes()) >> 1
            order = np.lexsort((at, low, high))
            sorted_high, sorted_low = high[order], low[order]
            first = np.ones(len(order), dtype=bool)
            first[1:] = (sorted_high[1:] != sorted_high[:-1]) | (sorted_low[1:] != sorted_low[:-1])
            last = np.ones(len(order), dtype=bool)
            last[:-1] = first[1:]
            again = np.zeros(len(hashes), dtype=bool)
            again[at[order[~(first & last)]]] = True
            sent = order[first]
            by = (high[sent] >> shift).astype(np.int64)
            sent = sent[np.lexsort((at[sent], by))]
            by = (high[sent] >> shift).astype(np.int64)
            cut = np.searchsorted(by, np.arange(buckets + 1))
            # The bucket is the hash's top bits; the rest of it, then the second hash, follow in `width` bytes.
            rest = _rest(high[sent], low[sent], int(math.log2(buckets)), width)
            place = at[sent]
            table = ids.tobytes() + marks.tobytes() + words.offsets.astype(np.int64).tobytes() + np.packbits(again).tobytes()
            rows: list[tuple[int, int, bytes, bytes]] = [(own % buckets, -len(ids), table, b"")]
            for b in np.flatnonzero(cut[1:] > cut[:-1]):
                s, e = cut[b], cut[b + 1]
                rows.append((int(b), int(e - s), rest[s:e].tobytes(), _packed(place[s:e]) + np.packbits(again[place[s:e]]).tobytes()))
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([own] * len(rows), pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.binary()),
                    pa.array([r[3] for r in rows], pa.binary()),
                    pa.nulls(len(rows), pa.binary()),
                ],
                names=_PIECES,
            )

    return run


Piece = tuple[int, int, bytes, bytes, bytes | None]  # slice, n, hashes, places, owners


def _unpacked_pieces(width: int, group: list[Piece]) -> tuple[np.ndarray, ...]:
    """Of all windows of some pieces, ordered by hash: both halves of the hash, slice, place, known as repeated, and run of equal hashes."""
    counts = [g[1] for g in group]
    keys = np.zeros((sum(counts), 16), dtype=np.uint8)
    keys[:, :width] = np.concatenate([np.frombuffer(g[2], dtype=np.uint8).reshape(-1, width) for g in group])
    known, places, owners = [], [], []
    for own, n, _, body, many in group:
        w = body[0]
        places.append(_unpacked(body[: 1 + w * n]) if many is None else np.frombuffer(body, dtype="<u4", count=n, offset=1).astype(np.int64))
        known.append(np.unpackbits(np.frombuffer(body, dtype=np.uint8, offset=1 + w * n), count=n).astype(bool))
        owners.append(np.full(n, own, dtype=np.int64) if many is None else np.frombuffer(many, dtype="<i8"))
    high, low = keys.view(">u8").astype(np.uint64).T
    order = np.lexsort((low, high)) if width > 8 else np.argsort(high, kind="stable")
    high, low = high[order], low[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return high, low, np.concatenate(owners)[order], np.concatenate(places)[order], np.concatenate(known)[order], np.cumsum(first) - 1


def _told(owners: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """What each slice must learn: its windows that are repeated."""
    if not len(owners):
        return
    order = np.lexsort((places, owners))
    owners, places = owners[order], places[order]
    heads = np.flatnonzero(np.diff(owners, prepend=owners[0] - 1))
    for a, b in zip(heads, [*heads[1:], len(owners)], strict=True):
        yield int(owners[a]), _packed(places[a:b])


def _repeats(width: int, group: list[Piece]) -> Iterator[tuple[int, int, bytes]]:
    """For one bucket: what each slice must learn."""
    if not group:
        return
    _, _, owners, places, known, run = _unpacked_pieces(width, group)
    told = (np.bincount(run) > 1)[run] & ~known
    for own, body in _told(owners[told], places[told]):
        yield own, 1, body


def _deal_again(width: int, bits: int, chunk: int):
    """Pieces of coarse buckets to pieces of finer ones; what is repeated within a chunk is told."""

    def finer(bucket: int, group: list[Piece]) -> Iterator[tuple]:
        high, low, owners, places, known, run = _unpacked_pieces(width, group)
        many = (np.bincount(run) > 1)[run]
        told = many & ~known
        for own, body in _told(owners[told], places[told]):
            yield own & 0xFFFF, own, 0, body, b"", None
        # One window of each hash goes on, marked if its slice knows already.
        sent = np.flatnonzero(np.diff(run, prepend=-1))
        known = known | many
        fine = (high[sent] >> np.uint64(64 - bits)).astype(np.int64)
        keys = np.stack([high[sent], low[sent]], axis=1).astype(">u8").view(np.uint8).reshape(-1, 16)[:, :width]
        cut = np.searchsorted(fine, np.arange((1 << bits) + 1))
        for b in np.flatnonzero(cut[1:] > cut[:-1]):
            at = slice(cut[b], cut[b + 1])
            own = sent[at]
            yield bucket << bits | int(b), 0, len(own), keys[at].tobytes(), b"\4" + places[own].astype("<u4").tobytes() + np.packbits(known[own]).tobytes(), owners[own].astype("<i8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Piece] = []
        bucket, size, out = None, 0, []
        for b in batches:
            for own, *piece in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if piece[1] <= 0:
                    out.append((own, *piece))
                else:
                    if held and (own != bucket or size >= chunk):
                        out += finer(bucket, held)
                        held, size = [], 0
                    bucket, size = own, size + piece[1]
                    held.append(tuple(piece))
                if len(out) >= 256:
                    for k in range(0, len(out), 256):
                        yield _batch(out[k : k + 256], _PIECES, _PIECE_TYPES)
                    out = []
        out += finer(bucket, held) if held else []
        for k in range(0, len(out), 256):
            yield _batch(out[k : k + 256], _PIECES, _PIECE_TYPES)

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _count_buckets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            windows, out = [], []
            for _, own, n, body, places, owners in group:
                if n <= 0:
                    out.append((own, n or 1, body))
                else:
                    windows.append((own, n, body, places, owners))
            out += _repeats(width, windows)
            for k in range(0, len(out), 256):
                yield _batch(out[k : k + 256], ["slice", "kind", "body"], [pa.int64(), pa.int32(), pa.binary()])

    return run


def _cover(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            table, starts = None, []
            for _, kind, body in group:
                if kind <= 0:
                    n, table = -kind, body
                else:
                    starts.append(_unpacked(body))
            ids, marks = np.frombuffer(table, dtype=np.int64, count=n), np.frombuffer(table, dtype=np.int64, count=n, offset=8 * n)
            offsets = np.frombuffer(table, dtype=np.int64, count=n + 1, offset=16 * n)
            total = int(offsets[-1])
            again = np.unpackbits(np.frombuffer(table, dtype=np.uint8, offset=24 * n + 8), count=total).astype(bool)
            for s in starts:
                again[s] = True
            at = np.flatnonzero(again)
            edge = np.zeros(total + 1, dtype=np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            gone = np.cumsum(edge[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            removed = sums[offsets[1:]] - sums[offsets[:-1]]
            body = [np.packbits(gone[offsets[k] : offsets[k + 1]]).tobytes() if removed[k] else None for k in range(n)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(body, pa.binary())], names=["_id", "_mark", "n_words", "n_removed", "gone"])

    return run


def covered_words(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which words of each text a repeated window covers.

    Returns _id, _mark (XXH64 of the text), n_words, n_removed and gone, a bit
    for each word (null where none goes). A null id counts as -1 here; null
    texts have no words. Repeated rows give equal rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = input_bytes(docs)
    buckets, width = _widths(total)
    bits, groups = _finer(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0 if total is None else total, buckets)
    parts = parts_for(docs, 16 << 20)
    pieces = rows.mapInArrow(_hash_windows(size, buckets, width), PIECES)
    if bits:
        group = F.pmod(F.col("slice"), F.lit(groups))
        pieces = pieces.repartition(parts, F.col("bucket"), group).sortWithinPartitions("bucket", group).mapInArrow(_deal_again(width, bits, CHUNK), PIECES)
    found = pieces.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_count_buckets(width), FOUND)
    by_slice = found.repartition(parts, "slice").sortWithinPartitions("slice")
    return by_slice.mapInArrow(_cover(size), "_id long, _mark long, n_words long, n_removed long, gone binary")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", SLICE_BYTES):
        texts: Texts = texts_of(batch.column(0))
        out = []
        for k, (n, gone) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            words = texts.bytes_of(k).split()
            if gone is not None:
                words = list(itertools.compress(words, 1 - np.unpackbits(np.frombuffer(gone, dtype=np.uint8), count=n)))
            out.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x.decode() for x in out], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())], names=[*batch.schema.names[1:], "kept", "kept_sha256"])


def drop_repeats(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Each document without the words of repeated windows.

    Returns the id column, n_words, n_removed, kept (if with_text: the words that
    stay, joined by one space) and kept_sha256. Null and empty texts, and texts of
    fewer than `size` words, lose nothing; a null text counts as empty; ids are whole
    numbers, a null id stays null. Repeated rows, with one id or several, are repeats of each other.
    An empty table gives an empty table. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("_own"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_mark", F.xxhash64("text"))
    covered = covered_words(docs, size, id_col, text_col).dropDuplicates(["_id", "_mark"])
    both = rows.join(covered, ["_id", "_mark"]).select("text", "n_words", "gone", "_own", "n_removed")
    kind = docs.schema[id_col].dataType.simpleString()
    out = both.mapInArrow(_keep, f"n_words long, gone binary, _own {kind}, n_removed long, kept string, kept_sha256 string")
    return out.select(F.col("_own").alias(id_col), "n_words", "n_removed", *(["kept"] if with_text else []), "kept_sha256")
