"""Greedy alignment of captures on one axis by content votes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.matching import pair_votes


@dataclass
class Alignment:
    chain: list  # captures by (shift, name)
    shifts: dict


def align(rows: DataFrame, ambiguous: int = 4) -> Alignment:
    """Place captures (rows: capture, j, h).

    One self-join gives the votes of all pairs; their totals decide on the driver (a
    few numbers per pair of captures). The first capture stands at 0; then the one
    with the most votes for a place against those placed is placed there, the earlier
    name and the earlier seen place of equal ones; captures without a vote follow
    flush in the order of names. A hash that occurs more than `ambiguous` times in
    all does not vote. Without rows the alignment is empty.
    """
    sizes = {r["capture"]: r["n"] for r in rows.groupBy("capture").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Alignment([], {})
    votes = ((r["p"], r["s"], r["delta"], r["votes"], r["min_j"]) for r in pair_votes(rows, ambiguous, both_ways=True).collect())
    shifts = placed(names, sizes, votes)
    low = min(shifts.values())
    shifts = {s: k - low for s, k in shifts.items()}
    return Alignment(sorted(names, key=lambda s: (shifts[s], s)), shifts)


def placed(names: list, sizes: dict, votes: Iterable[tuple]) -> dict:
    """Places of captures, the first at 0, from votes (p, s, delta, votes, min_j).

    A capture's totals change only when one is placed that votes for it, and only
    rise; so each vote is looked at once, and the heap's head that is not placed yet
    is the next.
    """
    given: dict = defaultdict(list)
    for p, *vote in votes:
        given[p].append(vote)
    total: dict = defaultdict(lambda: defaultdict(int))
    first: dict = defaultdict(dict)
    shifts: dict = {}
    heap: list = []

    def put(p, shift: int) -> None:
        rank = len(shifts)
        shifts[p] = shift
        for s, delta, n, min_j in given[p]:
            if s not in shifts:
                place, seen = shift + delta, (min_j, rank, min_j + delta)
                total[s][place] += n
                first[s][place] = min(first[s].get(place, seen), seen)
                heappush(heap, (-total[s][place], s))

    put(names[0], 0)
    while heap:
        _, s = heappop(heap)
        if s not in shifts:
            put(s, min(total[s], key=lambda k: (-total[s][k], first[s][k])))
    after = max(shifts[s] + sizes[s] for s in shifts)
    for s in names:
        if s not in shifts:
            shifts[s] = after
            after += sizes[s]
    return shifts
