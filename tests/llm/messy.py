"""Rows that operators must stand: nulls, empty and long texts, repeats, names that clash."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, taken long, _id long, _fp long, text2 string, length long, piece int, k string, gone string, doc long, mark long, line int, key binary, digest binary, kind int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def texts(seed: int = 5) -> list[str | None]:
    rnd = random.Random(seed)
    shared = sentence(rnd, 60)
    long = "\n".join(sentence(rnd, 25) for _ in range(1200))
    base = [sentence(rnd, 40) + "\n" + sentence(rnd, 30) for _ in range(12)]
    near = [b.replace("alpha", "beta", 1) for b in base[:3]]
    return [None, "", " \t\n ", "alpha", "alpha beta", long, long + " omega", f"{base[0]}\n{shared}", f"{shared} {base[1]}", *base, *near, base[0], base[0], "é 中文 \U0001f600 ñ", "\n\n\n", "a\r\nb\x0bc", "x" * 5000, "12 34 --", "<|endoftext|> alpha"]


def rows(seed: int = 5) -> list[tuple]:
    out = []
    for k, t in enumerate(texts(seed)):
        lang = (None, "de", "en")[k % 3]
        source = (None, "a", "b", "", "hot", "hot")[k % 6]
        out.append((k * 3, t, lang, source, len(t or "")))
    out.append(out[12])
    out.append(out[12])
    out += [(None, out[13][1], None, None, None), (None, None, None, None, None), (None, None, None, None, None), (9, out[14][1], "en", "a", 3)]
    return [(*r, 7, 0.5, 3, 4, 5, "x", 6, 1, "k", "g", 8, 9, 2, b"k", b"d", 1) for r in out]


def frame(spark, own: list[tuple] | None = None):
    return spark.createDataFrame(rows() if own is None else own, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def simple(spark, values: list[tuple]):
    return spark.createDataFrame([(i, t, None, "s", 0, *[None] * 16) for i, t in values], SCHEMA)
