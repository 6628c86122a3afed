import re
from collections import defaultdict

import messy

from strandweave.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while len(full) < len(names):
        level = (total - sum(most * sizes[s] for s in full)) / sum(w[s] for s in names if s not in full)
        new = {s for s in names if s not in full and level * w[s] > most * sizes[s]}
        if not new:
            break
        full |= new
    return {s: most * sizes[s] if s in full else level * w[s] for s in names}


def check(spark, docs, again=False):
    rows = docs.select("doc_id", "text", "source").collect()
    got = M.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    assert sorted(r.size for r in got) == sorted(len(WORD.findall(r.text or "")) for r in rows)
    want, taken = expected_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)
    if again:
        assert sorted(map(str, got)) == sorted(map(str, M.mix(docs).collect()))
    return got


def test_random_sources(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for k in range(400):
        source = rnd.choice(["hot"] * 5 + ["a", "b", "é", "z", None])
        rows.append((k, messy.sentence(rnd, int(rnd.paretovariate(0.9)) % 500), None, source, 0, *[None] * 16))
    check(spark, messy.frame(spark, rows), again=True)


def test_messy_rows(spark):
    docs = messy.frame(spark)
    got = check(spark, docs)
    assert M.mix(messy.empty(spark)).count() == 0 and M.mix_documents(messy.empty(spark)).count() == 0
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in mixed.select("text").collect())
    assert words == sum(r.taken for r in got)


def test_rates_meet_the_target_with_least_tilt(spark):
    counts = spark.createDataFrame([("a", 10, 50), ("a", 40, 20), ("a", 200, 3)], "source string, size long, n long")
    total = 50 * 10 + 20 * 40 + 600
    goals = spark.createDataFrame([("a", total, 1.3 * total)], "source string, source_size long, target double")
    tilt = M.rates(counts, goals).first()
    import math

    mean = total / 73
    got = sum(n * s * 2 / (1 + math.exp(-tilt.tilt * s / mean)) for s, n in ((10, 50), (40, 20), (200, 3)))
    assert abs(got - 1.3 * total) < 1e-5 * total


def test_sources_without_words(spark):
    blank = messy.simple(spark, [(1, None), (2, "")])
    assert [r.taken for r in M.mix(blank).collect()] == [0, 0]


def test_word_counts(spark):
    from pyspark.sql import functions as F

    rows = messy.simple(spark, list(enumerate(messy.texts())))
    got = {r[0]: r[1] for r in rows.select("doc_id", M.n_words(F.col("text"))).collect()}
    assert got == {k: len(WORD.findall(t or "")) for k, t in enumerate(messy.texts())}


def test_many_sources_meet_in_joins(spark, monkeypatch):
    import random

    rnd = random.Random(6)
    rows = [(k, messy.sentence(rnd, rnd.randint(0, 60)), None, rnd.choice([f"s{rnd.randrange(40)}", "hot", "hot", None]), 0, *[None] * 16) for k in range(500)]
    docs = messy.frame(spark, rows)
    want = sorted(map(str, M.mix(docs).collect()))
    monkeypatch.setattr(M, "FEW", 5)
    assert sorted(map(str, check(spark, docs))) == want


def test_rows_alike_at_the_boundary(spark, monkeypatch):
    monkeypatch.setattr(M, "ALIKE", 7)
    rows = [(None, "same words here", None, "a", 0, *[None] * 16)] * 60 + [(5, "one two", None, "a", 0, *[None] * 16)] * 40 + [(k, "b c d e", None, "b", 0, *[None] * 16) for k in range(30)]
    check(spark, messy.frame(spark, rows), again=True)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x", "a b c", "s"), ("y", "d e", None), (None, "f", "s")], "doc_id string, text string, source string")
    assert sorted(str(r.doc_id) for r in M.mix(docs).collect()) == ["None", "x", "y"]
    assert M.mix_documents(docs).columns == docs.columns and M.mix_documents(docs).count() >= 3
