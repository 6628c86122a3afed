"""Byte-level BPE ids of many texts at once, equal to the tokenizer's own.

The tokenizer cuts a text into pretokens and encodes each alone, so equal
pretokens have equal ids. Here numpy finds the pretokens of a whole batch, and
the tokenizer encodes each distinct one once; a cache of bounded size keeps its
ids. A pretoken is known by two independent 64-bit hashes. Given whole to the
tokenizer are texts that hold one of its special strings, texts of a batch in which
two pretokens share the first hash, and all texts of a tokenizer that does not cut as
`pretokens` does.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex
from tokenizers import Tokenizer

from strandweave.llm.words import BYTE_BASE, Texts, _Powers, mixed, span_hashes

MOST_CACHED = 1_000_000
LETTER, NUMBER, OTHER, SPACE = range(4)
_loaded: dict[str, "Encoder"] = {}


def _classes() -> np.ndarray:
    """Of each code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    at = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, text):
            out[at[found.start() : found.end()]] = kind
    return out


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file, one for each process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        cut = parts["pre_tokenizer"] or {}
        self.cuts_alike = parts["normalizer"] is None and parts["post_processor"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") is True and not cut.get("add_prefix_space")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.powers = _Powers(BYTE_BASE)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)  # sorted
        self.checks = np.zeros(0, dtype=np.uint64)  # of each hash, the second one
        self.slots = np.zeros(0, dtype=np.int64)  # of each hash, its place in starts
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def pretokens(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pretokens start; rows: where texts start, and the end.

        Runs of letters, numbers or other characters, each with one blank before
        it if there is one; of a run of white space before such a run, all but
        the last character; and 's 't 'm 'd 're 've 'll where a run starts.
        """
        n = len(points)
        kind = self.classes[points]
        edge = np.zeros(n + 1, dtype=bool)
        edge[rows] = True
        own = edge[:-1]
        change = own.copy()
        change[1:] |= kind[1:] != kind[:-1]
        start = change.copy()
        space = kind == SPACE
        # The last white space of a run, if more text follows in this row.
        last = np.zeros(n, dtype=bool)
        last[:-1] = space[:-1] & ~space[1:] & ~own[1:]
        start |= last
        joined = last & (points == 0x20)
        start[1:][joined[:-1]] = False
        quotes = np.flatnonzero((points == 0x27) & start)
        if len(quotes):
            end = np.searchsorted(rows, quotes, side="right")
            room = rows[np.minimum(end, len(rows) - 1)] - quotes
            padded = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
            one, two = padded[quotes + 1], padded[quotes + 2]
            short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
            long = (room > 2) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
            for found, size in ((quotes[short], 2), (quotes[long], 3)):
                start[found + 1] = False
                after = found + size
                after = after[after < n]
                start[after] |= kind[after] == LETTER
        return np.flatnonzero(start)

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) + len(hashes) > MOST_CACHED:
            self._forget()
        ids = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids])
        base = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.array([y for x in ids for y in x], dtype=np.uint32)])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.checks = np.insert(self.checks, at, checks)
        self.slots = np.insert(self.slots, at, base + np.arange(len(hashes)))

    def _whole(self, text: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each row as the tokenizer itself gives them."""
        each = [e.ids for e in self.tokenizer.encode_batch([text[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)], add_special_tokens=False)]
        return np.array([y for x in each for y in x], dtype=np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one row after the other, and where each row's start."""
        text = texts.data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        heads = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
        rows = heads[texts.offsets]
        if not self.cuts_alike or any(s in text for s in self.special):
            return self._whole(text, rows)
        if not len(points):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(rows), dtype=np.int64)
        starts = self.pretokens(points, rows)
        ends = np.append(starts[1:], len(points))
        hashes = mixed(span_hashes(points.astype(np.uint64) + np.uint64(1), starts, ends, self.powers))
        checks = mixed(span_hashes(mixed(points.astype(np.uint64), 7), starts, ends, self.powers), 1)
        own, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if (checks != checks[first][inverse]).any():
            return self._whole(text, rows)

        def unknown() -> np.ndarray:
            at = np.minimum(np.searchsorted(self.hashes, own), max(len(self.hashes) - 1, 0))
            return np.flatnonzero(self.hashes[at] != own) if len(self.hashes) else np.arange(len(own))

        new = unknown()
        if len(self.hashes) + len(new) > MOST_CACHED:
            self._forget()
            new = unknown()
        if len(new):
            self._learn(own[new], checks[first][new], [text[starts[k] : ends[k]] for k in first[new]])
        at = np.searchsorted(self.hashes, own)
        if (self.checks[at] != checks[first]).any():
            return self._whole(text, rows)
        slot = self.slots[at][inverse]
        begin, size = self.starts[slot], self.starts[slot + 1] - self.starts[slot]
        done = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - done[:-1], size) + np.arange(done[-1])]
        return ids, done[np.searchsorted(starts, rows)]
