import hashlib
import random
import zlib

import messy
import pytest

from strandweave.llm import media as M


def test_chunks_are_whole_and_local():
    rnd = random.Random(1)
    a = bytes(rnd.randrange(97, 123) for _ in range(40000))
    b = a[:15000] + b"INSERTED" + a[15000:]
    ca, cb = M.chunks([a, b])
    assert b"".join(ca) == a and b"".join(cb) == b
    assert all(M.LEAST <= len(c) <= M.MOST for c in ca[:-1])
    assert len(set(ca) & set(cb)) > 0.8 * len(ca)
    assert M.chunks([b])[0] == cb and M.chunks([b"x"])[0] == [b"x"]


def test_gear_is_the_rolling_hash():
    import numpy as np

    data = np.frombuffer(bytes(range(200)), dtype=np.uint8)
    h, want = 0, []
    for x in data:
        h = ((h << 1) + int(M._GEAR[x])) & 0xFFFFFFFF
        want.append(h)
    assert M.gear(data)[31:].tolist() == want[31:]


def test_messy_rows(spark):
    docs = messy.frame(spark)
    got = M.media_columns(docs, with_media=True).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        m = b"P5\n576 %d\n255\n" % (len(p) // 576) + p
        want.append((r.doc_id is None, r.doc_id or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), m))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, bytes(r.media)) for r in got) == sorted(want)
    by_payload = {}
    for r in got:
        by_payload.setdefault(r.payload_sha256, set()).add(r.feature)
    assert all(len(v) == 1 for v in by_payload.values())
    assert M.media_columns(messy.empty(spark)).count() == 0


def test_shared_chunks_are_stored_once(spark):
    rnd = random.Random(2)
    passage = messy.sentence(rnd, 4000)
    docs = messy.simple(spark, [(k, messy.sentence(rnd, 300) + passage) for k in range(6)])
    table = M.store(docs)
    stored = sum(len(r.body) for r in table.where("kind = 0").collect()) + sum(len(r.chunk) for r in table.where("kind = 1").groupBy("digest").agg({"body": "first"}).toDF("digest", "chunk").collect())
    assert stored < 0.45 * sum(len(r.text) for r in docs.collect())
    assert M.media_columns(docs).count() == 6


def test_broken_chunks_are_found():
    p = M.payload_of(b"abc")
    good = M._digest(p)
    sizes = (576).to_bytes(2, "little")
    assert M._assembled(good, sizes, p, {}) == M.media_of(p)
    with pytest.raises(M.BrokenMedia):
        M._assembled(good, sizes, p[:-1] + b"x", {})
