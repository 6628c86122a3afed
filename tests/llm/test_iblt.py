import hashlib
import random

import messy
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandweave.llm import iblt as B
from strandweave.llm.words import texts_of


def sets(texts):
    d, at = B.digests(texts_of(pa.array(texts)))
    return [set(d[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_likeness_is_that_of_the_sets():
    rnd = random.Random(3)
    a = ["", "one", *(messy.sentence(rnd, rnd.randint(1, 900)) for _ in range(60))]
    b = [x if rnd.random() < 0.2 else x[: rnd.randrange(len(x) + 1)] + messy.sentence(rnd, rnd.randint(0, 300)) for x in a]
    da, db = (B.digests(texts_of(pa.array(x))) for x in (a, b))
    got = B.likeness(da, db)
    assert np.allclose(got, [jaccard(x, y) for x, y in zip(sets(a), sets(b), strict=True)])


def test_peeling_recovers_both_sides():
    rnd = random.Random(4)
    common, mine, yours = ([rnd.getrandbits(64) for _ in range(n)] for n in (500, 20, 9))
    sizes = np.array([120])
    key = lambda x: np.array(x, dtype=np.uint64)
    rows = lambda x: np.zeros(len(x), dtype=np.int64)
    cells = B.sketches(key(common + mine), rows(common + mine), sizes)
    cells = B.sketches(key(common + yours), rows(common + yours), sizes, -1, cells)
    plus, minus, done = B.peeled(*cells, sizes)
    assert done.all() and plus[0] == 20 and minus[0] == 9
    small = B.sketches(key(mine * 9), rows(mine * 9), np.array([6]))
    assert not B.peeled(*small, np.array([6]))[2].all()


def mark(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), mark(r[1])))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        a, b, c = sets([t, e, nxt])
        out.append((i is None, i or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    return sorted(out)


def test_messy_rows(spark):
    docs = messy.frame(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = B.compare_versions(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == expected(rows)
    prints = {}
    for r in got:
        prints.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert B.compare_versions(messy.empty(spark)).count() == 0
    one = B.compare_versions(messy.simple(spark, [(5, "abc def")])).first()
    assert one.near_next == 1.0 and one.n_chars == 7


def test_equal_texts_have_equal_fingerprints():
    a = B._hex_fingerprints(B.digests(texts_of(pa.array(["x y z w", "other", "x y z w"]))), 24)
    assert a[0] == a[2] != a[1]


def plain(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = B.compare_versions(docs).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_many_ranges_with_copies_and_null_ids(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(B, "SAMPLED", 2)
    monkeypatch.setattr(B, "parts_for", lambda *_: 30)
    rows = [(rnd.randrange(40), messy.sentence(rnd, rnd.randint(0, 60))) for _ in range(60)]
    hot = (rnd.choice([None, 0, 20, 39]), messy.sentence(rnd, 30))
    rows += [hot] * 60 + [(None, messy.sentence(rnd, rnd.randint(1, 40))) for _ in range(40)] + [(7, "")] * 9
    assert plain(spark, rows) == expected(rows)
    alike = [(3, "a b c d e f g")] * 50
    assert plain(spark, alike) == expected(alike)


def test_ranges_are_even_and_bounds_bounded():
    n = 40_000
    ids = np.arange(n)
    rnd = np.random.default_rng(1)
    marks = rnd.integers(-(1 << 62), 1 << 62, n)
    marks[: n // 3] = 5  # a third of the rows are copies of one
    ids[: n // 3] = 9
    picked = rnd.choice(n, 400, replace=False)
    none = np.zeros(n, dtype=bool)
    ranges = B.Ranges(none[picked], ~ids[picked], marks[picked])
    row, place, guest = ranges.deal(~ids, none, marks, {}, 0)
    sizes = np.bincount(place[~guest] % len(ranges), minlength=len(ranges))
    assert sizes.max() < 12 * n / len(ranges) and (row[: n] == np.arange(n)).all()


def test_digests_by_another_way():
    """Paragraphs cut by plain code: lines, and within them at words whose hash ends with no top bits."""
    rnd = random.Random(9)
    texts = ["", "one", "a b\n\nc d", *("\n".join(messy.sentence(rnd, rnd.randint(0, 40)) for _ in range(4)) for _ in range(20))]

    def hashed(values, base):
        total = 0
        for k, v in enumerate(values):
            total += v * pow(base, k, 1 << 64)
        return total % (1 << 64)

    def fin(h, salt=0):
        h = (h + salt * 0x9E3779B97F4A7C15) % (1 << 64)
        for _ in range(2):
            h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) % (1 << 64)
        return h ^ h >> 32

    for text, got in zip(texts, sets(texts), strict=True):
        want = set()
        for line in text.split("\n"):
            part = []
            for word in line.split():
                part.append(fin(hashed([b + 1 for b in word.encode()], 0x9E3779B97F4A7C15)))
                if part[-1] >> 61 == 0:
                    want.add(fin(hashed(part, 0x9E3779B97F4A7C15), 3))
                    part = []
            if part:
                want.add(fin(hashed(part, 0x9E3779B97F4A7C15), 3))
        assert got == want
