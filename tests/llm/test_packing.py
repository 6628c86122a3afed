import random
import zlib

import messy
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandweave.llm import packing as P
from strandweave.llm import tokens
from strandweave.llm.queries import tokenizer_path
from strandweave.llm.words import texts_of

PATH = tokenizer_path()


def encoded(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    rnd = random.Random(1)
    marks = [*"ab'stmdrevlL  \n\t12!é. 中 　\U0001f600", "'s", "'re", " '", "'ll", "\r\n"]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(4000)] + [t or "" for t in messy.texts()]
    coder = tokens.Encoder(PATH)
    for k in range(0, len(texts), 500):
        ids, rows = coder.encode(texts_of(pa.array(texts[k : k + 500])))
        want = [e.ids for e in coder.tokenizer.encode_batch(texts[k : k + 500], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)] == want


def test_cache_that_is_full_starts_again(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CACHED", 50)
    coder = tokens.Encoder(PATH)
    for k in range(5):
        text = " ".join(f"w{k}x{j}" for j in range(30))
        ids, _ = coder.encode(texts_of(pa.array([text])))
        assert ids.tolist() == encoded(text)


def check(runs, used, counts, capacity):
    bins = {}
    seen = {s: [] for s in counts}
    for size, rank, n, first, offset in runs.tolist():
        seen[size] += range(rank, rank + n)
        for k in range(n):
            bins.setdefault(first + k, []).append((offset, size))
    assert all(sorted(seen[s]) == list(range(n)) for s, n in counts.items())
    assert len(bins) == used
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity


@pytest.mark.parametrize("large", P.LARGE)
def test_plans_are_whole_and_near_the_bound(large):
    for seed in range(6):
        rnd = random.Random(seed)
        counts = {}
        for _ in range(4000):
            s = rnd.choice((rnd.randint(1, 100), int(100 * rnd.paretovariate(1.2)) % 100 + 1, 100))
            counts[s] = counts.get(s, 0) + 1
        runs, used = P.plan(counts, 100, large_over=large)
        check(runs, used, counts, 100)
        assert used <= -(-sum(s * n for s, n in counts.items()) // 100) * 1.03 + 3


def test_column_generation_reaches_the_optimum():
    got = P.configurations([60, 40, 35], [10, 10, 12], 100)
    used = sum(x for _, x in got)
    assert all(sum(c * s for c, s in zip(p, [60, 40, 35], strict=True)) <= 100 for p, x in got if x > 1e-9)
    assert abs(used - 16) < 1e-6 or used < 16


def test_messy_rows(spark):
    docs = messy.frame(spark)
    got = P.pack(docs, PATH, 64, 2, with_ids=True).collect()
    texts = sorted((t or "") for (t,) in docs.select("text").collect())
    per_doc, bins = {}, {}
    for r in got:
        assert len(r.ids) == r.length <= 64 and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    assert sum(r.length for r in got) == sum(len(encoded(t)) + 1 for t in texts)
    for r in got:
        per_doc.setdefault(r.doc_id, []).append(r)
    own = [r for r in per_doc[3 * 5]]
    assert [r.piece for r in sorted(own, key=lambda r: r.start)] == list(range(len(own)))
    whole = [x for r in sorted(own, key=lambda r: r.start) for x in r.ids]
    assert whole == [*encoded(messy.texts()[5]), 2] and all(r.length == 64 for r in own if r.piece)
    assert P.pack(messy.empty(spark), PATH, 64, 2).count() == 0


def test_other_tokenizers_get_their_own_ids(monkeypatch):
    import public_tokenizers

    texts = [t or "" for t in messy.texts()]
    column = pa.array(texts)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        ids, rows = tokens.Encoder(path).encode(texts_of(column))
        assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)] == want
        # Hashes that meet too often cost time, and no id.
        coder = tokens.Encoder(path)
        monkeypatch.setattr(tokens, "mixed", lambda h, salt=0, own=tokens.mixed: own(h, salt) if salt else own(h, salt) & np.uint64(7))
        for part in (texts[5:9], texts):
            ids, rows = coder.encode(texts_of(pa.array(part)))
            assert ids.tolist() == [x for t in part for x in Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids]
        monkeypatch.undo()
