"""Media columns: payloads as 8-bit images in a store of content-defined chunks.

A payload is kept as a binary grey map (PGM) of 576 samples a row. A rolling
gear hash cuts it into chunks, so that equal passages give equal chunks wherever
they stand; a chunk's name is its digest.

1. One pass counts the chunk digests of the corpus. Those that came more than
   once are marked in a Bloom filter of bounded size.
2. A second pass writes the store, one Parquet table in the shared folder: for
   each row its ordered chunk list, with the bytes of chunks that nothing else
   holds beside it, and the bytes of marked chunks as rows of their own. (A
   false mark only makes a chunk a row of its own; where the filter is full, all
   chunks are.)
3. Reading back, rows without marked chunks are whole at once. The others are
   made distinct by payload digest, and joins by chunk digest bring their bytes.
   Every medium is checked against its digest before anything is computed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.bloom import build, has
from strandweave.llm.words import sliced, texts_of
from strandweave.session import parts_for, written

ROW = 576
LEAST, MASK_BITS, MOST = 256, 10, 4096  # chunk sizes: 256 + about 1024, 4096 at most
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32) * np.uint32(0x85EBCA6B)


class BrokenMedia(RuntimeError):
    """Stored chunks do not give the payload that was stored."""


def payload_of(text: bytes) -> bytes:
    """The text's bytes, with bytes 255 up to a positive multiple of the row."""
    return text + b"\xff" * (-len(text) % ROW or (0 if text else ROW))


def media_of(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of the last 32 bytes' values, each shifted by its distance."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def chunks(payloads: list[bytes]) -> list[list[bytes]]:
    """Each payload cut where the rolling hash has MASK_BITS zero top bits, between LEAST and MOST bytes."""
    marks = np.flatnonzero(gear(np.frombuffer(b"".join(payloads), dtype=np.uint8)) >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, start = [], 0
    for p in payloads:
        own = marks[np.searchsorted(marks, start + LEAST) : np.searchsorted(marks, start + len(p))] - start
        cut, parts = 0, []
        for m in [*own.tolist(), len(p)]:
            while m - cut > MOST:
                parts.append(p[cut : cut + MOST])
                cut += MOST
            if m - cut >= LEAST or m == len(p) and m > cut:
                parts.append(p[cut:m])
                cut = m
        out.append(parts)
        start += len(p)
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _payloads(batch: pa.RecordBatch, column: int) -> tuple[list[int], list[bytes]]:
    texts = texts_of(batch.column(column))
    return np.diff(texts.offsets).tolist(), [payload_of(texts.bytes_of(k)) for k in range(len(texts))]


def _chunk_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        _, payloads = _payloads(batch, 0)
        yield pa.record_batch([pa.array([_short(_digest(c)) for parts in chunks(payloads) for c in parts], pa.int64())], names=["h"])


def repeated_filter(names: DataFrame) -> tuple[int, np.ndarray]:
    """Bloom filter (bits as a power of two, 64-bit words) of the names that occur more than once."""
    again = names.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = written(again, "repeated")
    return build(again, again.count())


STORED = "kind int, _id {kind}, n_bytes long, digest binary, sizes binary, refs array<binary>, body binary"


def _store(bits: int, table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sizes, payloads = _payloads(batch, 1)
            cut = chunks(payloads)
            names = [[_digest(c) for c in parts] for parts in cut]
            h = np.array([_short(d) for own in names for d in own], dtype=np.int64)
            marked = has(h, bits, table).tolist()
            shared: dict[bytes, bytes] = {}
            lists, refs, body, k = [], [], [], 0
            for parts, own in zip(cut, names, strict=True):
                lens, ref, inline = [], [], []
                for c, d in zip(parts, own, strict=True):
                    lens.append(len(c) | marked[k] << 15)
                    if marked[k]:
                        ref.append(d)
                        shared[d] = c
                    else:
                        inline.append(c)
                    k += 1
                lists.append(np.array(lens, dtype="<u2").tobytes())
                refs.append(ref)
                body.append(b"".join(inline))
            n, m = len(payloads), len(shared)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * n + [1] * m, pa.int32()),
                    pa.chunked_array([batch.column(0), pa.nulls(m, batch.column(0).type)]).combine_chunks() if m else batch.column(0),
                    pa.array(sizes + [None] * m, pa.int64()),
                    pa.array([_digest(p) for p in payloads] + list(shared), pa.binary()),
                    pa.array(lists + [None] * m, pa.binary()),
                    pa.array(refs + [None] * m, pa.list_(pa.binary())),
                    pa.array(body + list(shared.values()), pa.binary()),
                ],
                names=["kind", "_id", "n_bytes", "digest", "sizes", "refs", "body"],
            )

    return run


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a histogram of 16 bins (share of samples in 1/255) of 8-bit samples."""
    counts = np.bincount(samples >> 4, minlength=16)
    return f"{samples.mean():.4f}:{samples.std():.4f}:" + (counts * 255 // len(samples)).astype(np.uint8).tobytes().hex()


def _assembled(digest: bytes, sizes: bytes, body: bytes, fetched: dict[int, bytes]) -> bytes:
    parts, at, k = [], 0, 0
    for size in np.frombuffer(sizes, dtype="<u2").tolist():
        if size >> 15:
            parts.append(fetched.get(k, b""))
            k += 1
        else:
            parts.append(body[at : at + size])
            at += size
    payload = b"".join(parts)
    if _digest(payload) != digest:
        raise BrokenMedia(f"payload {digest.hex()} cannot be put together again")
    return media_of(payload)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_NAMES = [x.split()[0] for x in READ.split(", ")]


def _read(media: bytes) -> tuple:
    head, payload = media[: media.index(b"\n255\n") + 5], media[media.index(b"\n255\n") + 5 :]
    width, height = map(int, head.split()[1:3])
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(height, width)
    raw = samples.tobytes()
    return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples.ravel())


def _read_rows(with_media: bool):
    """Rows (key, n_bytes, digest, sizes, body, fetched) -> key, n_bytes, what is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                digests, sizes, body, fetched = (part.column(k).to_pylist() for k in range(2, 6))
                media = [_assembled(d, s, b, {x["k"]: x["body"] for x in f or ()}) for d, s, b, f in zip(digests, sizes, body, fetched, strict=True)]
                got = [_read(m) for m in media]
                columns = [pa.array([g[k] for g in got], pa.int64() if k in (0, 2, 3) else pa.string()) for k in range(len(_NAMES))]
                more = [pa.array(media, pa.binary())] if with_media else []
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns, *more], names=["key", "n_bytes", *_NAMES, *(["media"] if with_media else [])])

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written store: rows of kind 0 (media: chunk lists and own bytes) and 1 (chunks with marks)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits, table = repeated_filter(rows.select("text").mapInArrow(_chunk_names, "h long"))
    return written(rows.mapInArrow(_store(bits, table), STORED.format(kind=docs.schema[id_col].dataType.simpleString())), "media")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store every text as media and read it back.

    Returns the id column, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, and media (the bytes) if with_media. A null
    text is empty and gives one row of samples 255. Equal texts have equal values;
    every row gives a row, whatever its id; an empty table gives an empty one;
    other columns are not looked at. BrokenMedia is raised if a chunk is wrong.
    """
    table = store(docs, id_col, text_col)
    media = table.where("kind = 0")
    kind = docs.schema[id_col].dataType.simpleString()
    more = ", media binary" if with_media else ""
    none = F.lit(None).cast("array<struct<k:int,body:binary>>")
    alone = media.where(F.size("refs") == 0).select("_id", "n_bytes", "digest", "sizes", "body", none.alias("fetched"))
    out = alone.mapInArrow(_read_rows(with_media), f"key {kind}, n_bytes long, {READ}{more}").withColumnRenamed("key", id_col)
    linked = media.where(F.size("refs") > 0)
    # Written: a chunk that very many payloads have is a key whose partition Spark can split in a join of plain shuffles.
    held = written(table.where("kind = 1").groupBy("digest").agg(F.first("body").alias("chunk")).withColumnRenamed("digest", "name"), "chunks")
    distinct = linked.groupBy("digest").agg(F.first("sizes").alias("sizes"), F.first("refs").alias("refs"), F.first("body").alias("body"))
    wanted = linked.select("digest", "refs").dropDuplicates(["digest"]).select("digest", F.posexplode("refs").alias("k", "name"))
    brought = wanted.join(held, "name").groupBy("digest").agg(F.collect_list(F.struct("k", F.col("chunk").alias("body"))).alias("fetched"))
    whole = distinct.join(brought, "digest").select(F.col("digest").alias("key"), F.lit(0).cast("long").alias("n"), "digest", "sizes", "body", "fetched")
    read = whole.repartition(parts_for(docs, 16 << 20), "key").mapInArrow(_read_rows(with_media), f"key binary, n_bytes long, {READ}{more}").drop("n_bytes")
    back = linked.select("_id", "n_bytes", F.col("digest").alias("key")).join(read, "key").drop("key").withColumnRenamed("_id", id_col)
    return out.unionByName(back)
