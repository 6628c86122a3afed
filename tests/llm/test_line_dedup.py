import random
import re

import messy
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import line_dedup as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_within_one(a, b):
    assert L.within_one(a, b) == (distance(a, b) <= 1)


def brute_lines(rows):
    import xxhash

    def mark(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    seen, out = [], {}
    for i, _, t in sorted({(i if i is not None else (1 << 63) - 1, mark(t or ""), t or "") for i, t in rows}):
        keep = []
        for line in t.split("\n"):
            w = WORD.findall(line)
            if w and any(w == s or (len(w) >= 5 and len(s) >= 5 and L.within_one(w, s)) for s in seen):
                seen.append(w)
                continue
            if w:
                seen.append(w)
            keep.append(line)
        out[i, t] = "\n".join(keep)
    return out


def some(seed, n=60):
    rnd = random.Random(seed)
    pool = [[rnd.choice("pqrstuvw") for _ in range(rnd.randint(1, 9))] for _ in range(25)]
    rows = []
    for k in range(n):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            w = list(rnd.choice(pool))
            edit, at = rnd.random(), rnd.randrange(len(w))
            if edit < 0.3:
                w[at] = rnd.choice("pqrsxyz")
            elif edit < 0.5:
                w.insert(at, rnd.choice("pqxyz"))
            elif edit < 0.7 and len(w) > 1:
                del w[at]
            lines.append(rnd.choice((" ", "  ")).join(w))
        rows.append((k, "\n".join(lines)))
    return rows + [rows[3], rows[4]]


def check(spark, rows):
    docs = messy.simple(spark, rows)
    want = brute_lines(rows)
    got = L.dedup_lines(docs)
    assert got.columns == docs.columns
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    result = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in got.collect())
    key = lambda i: (1 << 63) - 1 if i is None else i
    assert result == sorted((i is None, i or 0, t is None, "" if t is None else want[key(i), t]) for i, t in rows)


def test_random_lines(spark):
    check(spark, some(1))
    check(spark, some(2))


def test_many_lines_that_differ_in_one_word(spark):
    check(spark, [(k, f"page {k} of this very long report\nunique {k * 7} words {k * 11} in {k * 13} here {k}") for k in range(150)])


def test_messy_rows(spark):
    own = [(r[0], r[1]) for r in messy.rows()]
    check(spark, own)
    assert L.dedup_lines(messy.empty(spark)).count() == 0
    report = L.line_report(messy.frame(spark))
    assert report.count() == len(own) and report.columns == ["doc_id", "n_lines", "n_kept", "kept_sha256"]
