import re

import messy

import corpus_pipeline as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    from test_language_id import corpus

    rows = corpus(7, 90)
    rows = [(i, t, g, ("x", "y")[i % 2], len(t), *rest) for i, t, g, _, _, *rest in rows]
    rows += [(500, rows[0][1], "en", "x", 0, *[None] * 16), (501, "qxzj" * 80, None, "y", 0, *[None] * 16), (502, None, None, None, None, *[None] * 16)]
    docs = messy.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in C.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    before = docs
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns
        path = str(tmp_path / name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        ids = {r.doc_id for r in after.collect()}
        if name == "language_id":
            assert ids == set(range(90)) | {500}
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in after.collect()}[500] == ""
            assert all(r.n_chars == len(r.text) for r in after.collect())
        before = after
    packed = C.STAGES[-1][1](spark, before, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}


def test_empty_table(spark, tmp_path):
    docs = messy.empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_each_stage_against_brute_force(spark, tmp_path):
    import random
    import zlib
    from collections import Counter, defaultdict

    import xxhash
    from test_language_id import corpus
    from test_line_dedup import brute_lines
    from test_mixing import expected_targets
    from test_packing import encoded
    from test_simhash import brute, fingerprint

    from strandweave.llm import language_id

    rnd = random.Random(11)
    rows = []
    for i, text, lang, *_ in corpus(5, 150):
        words = text.split()
        lines = "\n".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8))
        rows.append((i, lines, lang, rnd.choice(["a", "b", "hot", "hot", None])))
    for k in range(20):  # copies, near copies, shared lines, one id with two texts
        i, text, lang, source = rows[rnd.randrange(100)]
        rows.append((200 + k, text if k % 3 else text + " the", lang, source))
    rows += [(7, "the and of to in is that it was for on are with as his they at be", "en", "b"), (None, rows[3][1], "en", None), (None, None, None, "a"), (300, "", "en", "a"), (301, "qxzj " * 60, "en", "b")]
    rows += [(302, " ".join(rnd.choice("der die und das ist nicht ein ich".split()) for _ in range(3000)), "de", "hot")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def mark(t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    def stage(n, before):
        path = str(tmp_path / C.STAGES[n][0])
        C.STAGES[n][1](spark, before, str(tmp_path)).write.parquet(path)
        return spark.read.parquet(path)

    key = lambda r: (r[0] is None, r[0] or 0, mark(r[1]), str(r[1]), str(r[3]))
    plain = lambda df: sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=key)

    after = stage(0, docs)
    out = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs).where("rejected").collect()}
    kept = plain(after)
    assert kept == sorted((r for r in rows if r[0] not in {i for i, *_ in out} or r[0] is None and r[1]), key=key)
    assert {r[0] for r in rows} - {r[0] for r in kept} == {300, 301}

    before, after = kept, stage(1, after)
    gone = brute_lines([(r[0], r[1]) for r in before])
    kept = plain(after)
    assert kept == sorted(((i, None if t is None else gone[(1 << 63) - 1 if i is None else i, t], g, s) for i, t, g, s in before), key=key)

    before, after = kept, stage(2, after)
    prints = {r[1]: fingerprint(r[1]) for r in before}
    groups = brute(prints.values())
    first = {}
    for r in before:
        g = groups[prints[r[1]]]
        first[g] = min(first.get(g, r), r, key=lambda r: key(r)[:3])
    kept = plain(after)
    assert kept == sorted(first.values(), key=key)

    before, after = kept, stage(3, after)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in before:
        sizes[s] += len(WORD.findall(t or ""))
    copies = Counter((r.doc_id, r.source, r.text) for r in after.collect())
    whole = defaultdict(list)
    for i, t, _, s in before:
        whole[i, s].append(t or "")
    for (i, s, t), n in copies.items():
        taken[s] += n * len(WORD.findall(t))
        assert t in whole[i, s] or n == 1 and any(" ".join(WORD.findall(x)).startswith(t) for x in whole[i, s])
    assert all(abs(taken[s] - goal) <= 1 for s, goal in expected_targets(sizes).items())
    assert all(sum(n for (i, s, _), n in copies.items() if (i, s) == own) <= 2 * len(texts) for own, texts in whole.items())

    packed = stage(4, after).collect()
    want = Counter()
    for r in after.collect():
        ids = [*encoded(r.text or ""), 2]
        cut = len(ids) % 1024 or 1024
        ends = [0, *range(cut, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            want[r.doc_id, p, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
