import messy
import numpy as np
import pyarrow as pa

from strandweave.llm import license_scan as L
from strandweave.llm.words import texts_of


def brute(text, scanner):
    """Best containment of every license over all windows of the classes' grids."""
    h, _ = L._shingles(L._folded(texts_of(pa.array([text or ""]))), scanner.shingle)
    best = {}
    for c in scanner.classes:
        for k in c.templates:
            t = scanner.templates[k]
            for s in range(0, len(h), c.block):
                share = len(np.intersect1d(h[s : s + 2 * c.block], t.shingles)) / len(t.shingles)
                if share >= scanner.containment:
                    best[t.license] = max(best.get(t.license, 0), share)
    return best


def cases():
    full = L.TEMPLATES["MIT"][2]
    words = full.split()
    mangled = " ".join(w if k % 40 else "changed" for k, w in enumerate(words))
    pad = "lorem ipsum dolor sit amet " * 30
    return [pad + full + pad, pad + mangled, pad + " ".join(words[: len(words) // 2]), "Licensed under the Apache License, Version 2.0.", f"{pad}\nReleased under the MIT License.\n", "free software license", *messy.texts()]


def test_finds_what_brute_force_finds():
    scanner = L.Scanner(L.TEMPLATES)
    got = {}
    for row, name, share, _, _ in scanner.scan(texts_of(pa.array(cases()))):
        got.setdefault(row, {})[name] = share
    want = {k: b for k, t in enumerate(cases()) if (b := brute(t, scanner))}
    assert got == want
    assert set(want) >= {0, 1, 3, 4} and 2 not in want and 5 not in want


def test_bands_guarantee_retrieval():
    floor, bands = L.likeness_floor(0.8), L.bands_for(0.8)
    assert (1 - floor**L.ROWS) ** bands < L.MISS <= (1 - floor**L.ROWS) ** (bands - 1)


def test_messy_rows(spark):
    docs = messy.frame(spark)
    assert L.scan_licenses(docs).columns == ["doc_id", "license", "containment", "first_shingle", "n_windows"]
    assert L.scan_licenses(docs).count() == 0
    assert L.scan_licenses(messy.empty(spark)).count() == 0
    text = "Licensed under the Apache License, Version 2.0."
    got = L.scan_licenses(messy.simple(spark, [(1, text), (1, text), (None, text), (2, None)])).collect()
    assert sorted((r.doc_id is None, r.license) for r in got) == [(False, "Apache-2.0")] * 2 + [(True, "Apache-2.0")]
    assert L.scan_licenses(docs, templates={}).count() == 0


def test_short_notices_inside_texts():
    pad = "lorem ipsum dolor sit amet " * 30
    texts = [f"{pad}\nAll rights reserved.\n{pad}", f"{pad} MIT License {pad} (mit license)", "all rights\nreserved", "rights reserved", "All rights", "x MIT", f"{pad}SPDX-License-Identifier: Apache-2.0", None, "", "License MIT"]
    got = L.Scanner(L.TEMPLATES).scan(texts_of(pa.array([t or "" for t in texts])))
    assert got == [(0, "LicenseRef-All-Rights-Reserved", 1.0, 150, 1), (1, "MIT", 1.0, 150, 2), (2, "LicenseRef-All-Rights-Reserved", 1.0, 0, 1), (6, "Apache-2.0", 1.0, 150, 1)]
    own = L.Scanner({"A": ["one", "two words"], "B": ["two words"], "C": ["", "a b c d e"]})
    assert [x[:2] for x in own.scan(texts_of(pa.array(["say one", "some two words here", "a b c d e", "b"])))] == [(0, "A"), (1, "A"), (1, "B"), (2, "C")]


def shingled(text):
    """Shingles by plain code: lower case, punctuation as blanks but for full stops and hyphens inside words."""
    import re

    words = re.sub(r"[.-](?=[\x20\x09-\x0d]|$)", " ", re.sub(r"[!-,/:-@\[-`{-~]", " ", text.lower())).split()
    return [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]


def share_of_best_stretch(text, template):
    """The largest share of the template's shingles in any stretch of at most STRETCH times its length."""
    own, wanted = shingled(text), set(shingled(template))
    n = int(len(shingled(template)) * L.STRETCH)
    return max((len(wanted & set(own[k : k + n])) / len(wanted) for k in range(max(1, len(own) - n + 1))), default=0)


def test_inserted_and_changed_words_lose_no_notice():
    import random

    rnd = random.Random(8)
    scanner = L.Scanner(L.TEMPLATES)
    texts, must = [], []
    for name, templates in L.TEMPLATES.items():
        for template in templates:
            if len(shingled(template)) < 10:
                continue
            for _ in range(40):
                words = template.split()
                at = rnd.randrange(len(words))
                words[at:at] = ["inserted"] * rnd.randint(0, len(words) // 2)
                if rnd.random() < 0.5:
                    words[rnd.randrange(len(words))] = "changed"
                text = messy.sentence(rnd, rnd.randint(0, 300)) + " " + " ".join(words) + " " + messy.sentence(rnd, rnd.randint(0, 300))
                texts.append(text)
                must.append(name if share_of_best_stretch(text, template) >= 0.8 else None)
    got = {}
    for row, name, *_ in scanner.scan(texts_of(pa.array(texts))):
        got.setdefault(row, set()).add(name)
    assert sum(m is not None for m in must) > 300
    assert [k for k, m in enumerate(must) if m is not None and m not in got.get(k, ())] == []


def test_full_texts_are_found_and_told_apart():
    texts = [L.TEMPLATES["BSD-2-Clause"][0], L.TEMPLATES["ISC"][0], L.TEMPLATES["Zlib"][0]]
    got = {}
    for row, name, share, *_ in L.Scanner(L.TEMPLATES).scan(texts_of(pa.array(texts))):
        got.setdefault(row, {})[name] = share
    assert got[0]["BSD-2-Clause"] == 1.0 and got[1] == {"ISC": 1.0} and got[2] == {"Zlib": 1.0}
