import hashlib
import re
from collections import Counter

import messy
import numpy as np
import pyarrow as pa

from strandweave.llm import substring_dedup as D
from strandweave.llm.words import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i is None, i or 0, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, docs, size):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in D.drop_repeats(docs, size).collect())


def test_messy_rows(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in messy.rows()]
    docs = messy.frame(spark)
    for size in (35, 3):
        assert run(spark, docs, size) == brute(rows, size)
    monkeypatch.setattr(D, "SLICE_BYTES", 500)
    monkeypatch.setattr(D, "_widths", lambda total: (16, 7))
    assert run(spark, docs, 5) == brute(rows, 5)
    assert D.drop_repeats(messy.empty(spark)).count() == 0


def test_words_are_the_patterns():
    texts = [t for t in messy.texts()]
    words = texts_of(pa.array(texts)).words()
    got = [[words.texts.data[s:e].tobytes().decode() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
    assert got == [WORD.findall(t or "") for t in texts]


def test_widths_follow_the_size():
    for total in (0, 1 << 20, 1 << 30, 100 << 40, None):
        buckets, width = D._widths(total)
        windows = float(1 << 53 if total is None else total)
        bits = np.log2(buckets) + 8 * width
        assert windows**2 / 2 ** (bits + 1) < 0.01 and 7 <= width <= 16


def test_all_kept_bits_come_from_the_hashes():
    rnd = np.random.default_rng(3)
    high, low = rnd.integers(0, 1 << 64, (2, 50), dtype=np.uint64)
    for taken in (8, 10, 12):
        for width in range(7, 16):
            want = [((int(h) << 64 | int(x)) << taken & (1 << 128) - 1).to_bytes(16)[:width] for h, x in zip(high, low, strict=True)]
            assert [bytes(r) for r in D._rest(high, low, taken, width)] == want
    # One first hash, 4,096 second ones: 8 bytes after 12 bits of bucket tell them apart.
    first, second = np.full(4096, 7, dtype=np.uint64), np.arange(4096, dtype=np.uint64) << np.uint64(52)
    assert len(np.unique(D._rest(first, second, 12, 8), axis=0)) == 4096


def test_buckets_divided_again(spark, monkeypatch):
    rows = [(r[0], r[1]) for r in messy.rows()] + [(1000 + k, messy.texts()[5][: 300 + 7 * k]) for k in range(30)]
    docs = messy.simple(spark, rows).repartition(6)
    monkeypatch.setattr(D, "SLICE_BYTES", 500)
    monkeypatch.setattr(D, "CHUNK", 40)
    monkeypatch.setattr(D, "_widths", lambda total: (16, 8))
    monkeypatch.setattr(D, "_finer", lambda total, buckets: (5, 3))
    assert run(spark, docs, 5) == brute(rows, 5)


def test_a_passage_of_all_rows_goes_on_once_from_a_chunk():
    rnd = np.random.default_rng(2)
    hot = rnd.integers(0, 256, (50, 8), dtype=np.uint8)
    pieces = [(own, 50, hot.tobytes(), D._packed(np.arange(50)) + np.packbits(np.zeros(50, dtype=bool)).tobytes(), None) for own in range(200)]
    batch = D._batch([(3, *p) for p in pieces], D._PIECES, D._PIECE_TYPES)
    out = [r for b in D._deal_again(8, 4, 5000)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in out if r["n"] > 0) == 2 * 50  # two chunks
    told = [r["slice"] for r in out if r["n"] == 0]
    assert sorted(told) == list(range(200)) and all(r["bucket"] >> 4 == 3 for r in out if r["n"] > 0)


def test_what_a_bucket_holds_does_not_grow_with_the_input():
    for total in (1 << 30, 1 << 35, 1 << 40, 100 << 40, 1 << 50):
        buckets, _ = D._widths(total)
        bits, groups = D._finer(total, buckets)
        assert total * D.WINDOW_BYTES / buckets / 2**bits <= D.RANGE_BYTES
        assert total * D.WINDOW_BYTES / buckets / groups <= 8 * D.RANGE_BYTES and buckets << bits < 1 << 31
    assert D._finer(1 << 30, D._widths(1 << 30)[0]) == (0, 1)
