import random

import messy
import numpy as np
import xxhash

from strandweave.llm import simhash as S
from strandweave.llm.graph import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(values):
    """Component of each value: the smallest value reachable."""
    values = np.array(sorted(set(values)), dtype=np.uint64)
    up = {int(v): int(v) for v in values}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, v in enumerate(values):
        for w in values[k + 1 :][np.bitwise_count(values[k + 1 :] ^ v) <= 3]:
            a, b = sorted((top(int(v)), top(int(w))))
            up[b] = a
    return {int(v): top(int(v)) for v in values}


def cloud(rnd, n):
    """Chains and balls of values a few bits apart, and values alone."""
    out = [rnd.getrandbits(64) for _ in range(n)]
    for _ in range(4):
        x = rnd.getrandbits(64)
        for _ in range(n):
            out.append(x)
            y = x
            for _ in range(rnd.randint(1, 3)):
                y ^= 1 << rnd.randrange(64)
            out.append(y)
            if rnd.random() < 0.1:
                x = y
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def linked(spark, values):
    nodes = spark.createDataFrame([(signed(v), k) for k, v in enumerate(sorted(set(values)))], "_fp long, first long")
    roots = {r.node: r.root for r in components(S.links(nodes)).collect()}
    return {v: roots.get(signed(v), signed(v)) for v in set(values)}


def same_groups(a, b):
    pairs = {(a[v], b[v]) for v in a}
    return len(pairs) == len(set(a.values())) == len(set(b.values()))


def test_links_hold_all_components(spark):
    values = cloud(random.Random(1), 60)
    assert same_groups(linked(spark, values), brute(values))


def test_big_buckets_and_few_bits(spark, monkeypatch):
    monkeypatch.setattr(S, "BIG", 4)
    monkeypatch.setattr(S, "BLOCK", 8)
    rnd = random.Random(2)
    values = cloud(rnd, 20) + [rnd.getrandbits(9) for _ in range(60)]
    assert same_groups(linked(spark, values), brute(values))


def test_every_pair_meets_in_some_part():
    rnd = random.Random(4)
    sample = np.array(cloud(rnd, 30), dtype=np.uint64)
    for n in (10, 10**6, 10**11):
        parts = S.plan_parts(np.eye(64), sample, n, 3)
        for _ in range(300):
            flips = sum(1 << b for b in rnd.sample(range(64), 3))
            assert any((flips & mask).bit_count() <= r for mask, r in parts)


def test_allocation_is_the_cheapest():
    import itertools

    rnd = random.Random(5)
    costs = [[0.0, *sorted(rnd.random() * 9 for _ in range(4))] for _ in range(3)]
    best = min((sum(c[r + 1] for c, r in zip(costs, rs, strict=True)), list(rs)) for rs in itertools.product(range(-1, 4), repeat=3) if sum(rs) == 1)
    assert S.allocate(costs, 1)[1] == best[1]


def test_messy_rows(spark):
    docs = messy.frame(spark)
    got = S.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = {t: fingerprint(t) for _, t in own}
    groups = brute(prints.values())
    least = {}
    for i, t in own:
        if i is not None:
            g = groups[prints[t]]
            least[g] = min(least.get(g, i), i)
    want = sorted((i is None, i or 0, f"{prints[t]:016x}", least.get(groups[prints[t]], -1)) for i, t in own)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == want
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    # One row for each group; id 9 has two texts of two groups.
    assert ids == sorted(least.values()) and kept.count() == len({groups[p] for p in prints.values()})
    assert S.near_duplicates(messy.empty(spark)).count() == 0
    assert S.drop_near_duplicates(messy.empty(spark)).count() == 0


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(None, 3), (5, 5), (1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert len(got) == 303 and len({got[k] for k in range(301)}) == 1 and got[1000] == got[1001] != got[0]


def test_one_id_with_two_texts(spark):
    a, b = "one two three four five six seven", "completely different words stand in this other line"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (5, b), (None, a), (None, "alone here"), (None, "alone here")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in S.drop_near_duplicates(docs).collect()) == [(0, "alone here"), (3, a), (5, b)]


def test_clashing_names_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4, "x"), (2, "a b c", 5, 6, 7, 8, "y")], "doc_id long, text string, _fp long, root long, least long, _mark long, id string")
    assert [r.asDict() for r in S.drop_near_duplicates(docs).collect()] == [docs.first().asDict()]
