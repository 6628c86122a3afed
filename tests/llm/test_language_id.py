import random
import zlib

import messy
import numpy as np

from strandweave.llm import language_id as L

VOICES = {"en": "the and of to in is that it was for on are with as his they at be this from".split(), "de": "der die und das ist nicht ein ich sie mit sich auf für von dem eine zu auch es".split(), "fr": "le la les et des est une que pour dans qui sur pas au par plus ce avec être était".split()}


def corpus(seed=1, n=240):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        lang = list(VOICES)[k % 3]
        out.append((k, " ".join(rnd.choice(VOICES[lang]) for _ in range(rnd.randint(3, 60))), lang, "s", 0, *[None] * 16))
    return out


def test_probabilities_sum_to_one_and_match_the_recursion():
    texts = [[r[1] for r in corpus() if r[2] == g] for g in VOICES]
    floor, orders = L._kneser_ney(texts, 4)
    model = L.Model(list(VOICES), floor, orders, np.zeros(3))
    alphabet = sorted({c for own in texts for t in own for c in L._normalised(t)})
    for context in (" th", "der", "zzz"):
        chars = np.array([[ord(c) for c in context + x] for x in alphabet], dtype=np.uint64)
        total = np.exp(model.log_probabilities(chars, np.full(len(alphabet), 3))).sum(axis=0)
        # The share of the 1,000 characters that no text has.
        other = np.exp(model.log_probabilities(np.array([[ord(c) for c in context + "Ж"]], dtype=np.uint64), np.array([3])))[0]
        assert np.allclose(total + 1000 * other, 1)


def test_cache_gives_the_same_entropies():
    texts = [[r[1] for r in corpus() if r[2] == g] for g in VOICES]
    model = L.Model(list(VOICES), *L._kneser_ney(texts, 4), np.zeros(3))
    some = [r[1] for r in corpus(2)][:40] + ["", "é", "ABC, def!"]
    together = model.entropies(some)[0]
    again = model.entropies(some)[0]
    alone = np.concatenate([L.Model(list(VOICES), model.floor, model.orders, np.zeros(3)).entropies([t])[0] for t in some])
    assert np.allclose(together, alone, atol=1e-5) and np.allclose(together, again, atol=1e-6)


def test_held_out_accuracy_and_rejection(spark):
    docs = messy.frame(spark, corpus())
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    truth = {r[0]: r[2] for r in corpus()}
    held = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and not any(r.rejected for r in held)
    rnd = random.Random(3)
    junk = ["".join(rnd.choice("qxzjkwvpbg") for _ in range(400)), "ΨЖЩЪ" * 50, None, "", "123 !!"]
    both = docs.unionByName(messy.simple(spark, [(1000 + k, t) for k, t in enumerate(junk)]))
    bad = {r.doc_id: r for r in L.identify(both).where("doc_id >= 1000").collect()}
    assert all(r.rejected for r in bad.values())
    assert [bad[1000 + k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and bad[1002].score == 0
    kept = L.drop_rejected(both)
    assert kept.columns == both.columns and kept.count() == len(truth)


def test_messy_rows(spark):
    docs = messy.frame(spark)
    got = L.identify(docs).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got} <= {"de", "en", "und"}
    assert L.identify(messy.empty(spark)).count() == 0 and L.drop_rejected(messy.empty(spark)).count() == 0
    unlabelled = messy.simple(spark, [(1, "alpha"), (None, None)])
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}


def test_copies_dont_shrink_the_sample(spark):
    from pyspark.sql import functions as F

    k = F.col("id")
    rows = spark.range(40000).select(F.when(k % 2 == 0, "de").otherwise("en").alias("lang"), F.when(k < 4000, F.concat(F.lit("some text "), F.md5(k.cast("string")))).otherwise(F.lit("a copy")).alias("text"))
    got = L.sampled(rows).collect()
    sizes = {g: [sum(r.lang == g and r["rank"] % 2 == odd for r in got) for odd in (1, 0)] for g in ("de", "en")}
    assert sizes == {g: [L.SAMPLE, L.SAMPLE] for g in ("de", "en")}
    # The least hashes of the distinct texts, and no others.
    own = {(r.u, r.h): r.text for r in rows.where("lang = 'de'").select("text", F.xxhash64("text").alias("h")).withColumn("u", F.pmod("h", F.lit(1 << 30))).distinct().collect()}
    assert {r.text for r in got if r.lang == "de"} == {own[x] for x in sorted(own)[: 2 * L.SAMPLE]}


def test_a_language_of_one_text_many_times(spark):
    rows = [(k, "une seule phrase en boucle", "xx") for k in range(6000)] + [(6000 + k, f"the and of to number {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}", "yy") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(docs).collect()
    assert len(got) == 6050 and all(r.lang_pred == ("xx" if r.doc_id < 6000 else "yy") for r in got)
    assert L.drop_rejected(docs).count() == 6050
    junk = spark.createDataFrame([(1, "123", "xx"), (2, "", "yy"), (3, "words", None)], docs.schema)
    assert len(L.identify(junk).collect()) == 3


def test_an_unlabelled_corpus_stays(spark):
    docs = messy.simple(spark, [(1, "alpha"), (2, "beta gamma"), (None, None)])
    assert sorted(map(str, L.drop_rejected(docs).collect())) == sorted(map(str, docs.collect()))
    assert not any(r.rejected for r in L.identify(docs).collect())


def test_kneser_ney_as_a_plain_recursion():
    texts = [["abra cadabra", "a bar", "abracadabra barb"], ["cab bac", "dab"]]
    floor, orders = L._kneser_ney(texts, 3)
    model = L.Model(["x", "y"], floor, orders, np.zeros(2))
    clean = [[" " + t + " " for t in own] for own in texts]
    alphabet = {c for own in clean for t in own for c in t}
    for x, own in enumerate(clean):
        raw = [{}, {}, {}]
        for t in own:
            for n in (1, 2, 3):
                for k in range(len(t) - n + 1):
                    raw[n - 1][t[k : k + n]] = raw[n - 1].get(t[k : k + n], 0) + 1
        counts = [{g: max(1, sum(h[1:] == g for h in raw[n + 1])) for g in raw[n]} for n in (0, 1)] + [raw[2]]

        def prob(g, counts=counts):
            own = counts[len(g) - 1]
            values = list(own.values())
            ones, twos = values.count(1), values.count(2)
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            below = prob(g[1:]) if len(g) > 1 else 1 / (len(alphabet) + 1000)
            mates = [v for h, v in own.items() if h[:-1] == g[:-1]]
            if not mates:
                return below
            return max(own.get(g, 0) - d, 0) / sum(mates) + d * len(mates) / sum(mates) * below

        for g in ("abr", "bra", "cab", "zab", "abz", " ba", "b b", "ddd", "da "):
            got = model.log_probabilities(np.array([[ord(c) for c in g]], dtype=np.uint64), np.array([2]))[0, x]
            assert np.isclose(np.exp(got), prob(g), rtol=1e-5), (x, g)


def test_counts_in_spark_are_those_of_one_machine(spark):
    texts = [r[1] for r in corpus(3, 60)]
    rows = spark.createDataFrame([(k % 3, t) for k, t in enumerate(texts)], "x int, text string").repartition(5)
    got = {(r.lang, r.n, r.key): r.c for r in rows.mapInArrow(L._count(3), L.GRAMS).groupBy("lang", "n", "key").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c").collect()}
    for x in range(3):
        points, sizes, _ = L._clean_points(texts[x::3])
        for n in (1, 2, 3):
            g = L._counted(points, sizes, n)
            assert {k: c for (lang, size, k), c in got.items() if (lang, size) == (x, n)} == dict(zip(g.key.view(np.int64).tolist(), g.count.tolist(), strict=True))
