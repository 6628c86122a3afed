"""Packing of documents into few sequences (linear grouping, then best fit).

Lengths are whole numbers up to the capacity, so how many pieces there are of
each length is all that the plan needs: at most `capacity` numbers, whatever the
corpus. On these numbers the driver

1. sorts the large lengths, cuts them into groups of equal cardinality and
   rounds each up to its group's largest,
2. finds the best configurations of the few rounded lengths (column generation:
   a linear program whose columns an integer knapsack finds),
3. puts actual pieces, by their rank in a group, in the configurations' slots,
4. fills what is left, and new sequences, with the other pieces, largest first,
   each where it leaves the least room.

What counts as large is tried at a few bounds, and the plan of the fewest
sequences is taken.

The plan is a bounded list of runs "ranks a..b of length s go to sequences
c..d at offset o". Executors number the pieces of each length (within shards,
then by prefix sums, so that a length that a third of all pieces share is no
task's own) and look up their run.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.llm.tokens import encoder
from strandweave.llm.words import sliced, texts_of
from strandweave.session import written

GROUPS = 32
LARGE = (2, 3, 6)  # lengths over capacity / k are large; the k of the fewest sequences is taken


def _pieces(path: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in sliced(batches, "text", 1 << 20):
            ids, rows = coder.encode(texts_of(batch.column(1)))
            of, piece, start, length, crc, own = [], [], [], [], [], []
            for k in range(batch.num_rows):
                tokens = np.append(ids[rows[k] : rows[k + 1]], np.uint32(end_id)).astype("<u4")
                first = len(tokens) % capacity or capacity
                cuts = [0, *range(first, len(tokens) + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    of.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(tokens[a:b].tobytes()))
                    if with_ids:
                        own.append(tokens[a:b].astype(np.int32))
            more = [pa.array(own, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *more], names=["_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return run


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Patterns (how many of each size) and how often each is used: the linear program's optimum."""
    k = len(sizes)
    base = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(demand, dtype=float)
    for _ in range(rounds):
        price = np.linalg.solve(base.T, np.ones(k))
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        each = np.array(sizes)
        for room in range(1, capacity + 1):
            best[room] = best[room - 1]
            fits = each <= room
            if fits.any():
                value = np.where(fits, best[np.maximum(room - each, 0)] + price, -1)
                i = int(value.argmax())
                if value[i] > best[room] + 1e-12:
                    best[room], took[room] = value[i], i
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if took[room] < 0:
                room -= 1
            else:
                column[took[room]] += 1
                room -= sizes[took[room]]
        x, d = np.linalg.solve(base, need), np.linalg.solve(base, column)
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        base[:, int(ratio.argmin())] = column
    x = np.linalg.solve(base, need)
    return [([int(v) for v in base[:, j]], max(float(x[j]), 0.0)) for j in range(k)]


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, large_over: int = 2) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, offset), and the number of sequences.

    counts: how many pieces there are of each length from 1 to capacity.
    """
    left, rank = dict(counts), defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, how many)]
    used = 0

    def place(size: int, n: int, first: int, room: int) -> None:
        runs.append((size, rank[size], n, first, capacity - room))
        rank[size] += n
        left[size] -= n
        free[room - size].append((first, n))

    for size in [s for s in left if s == capacity]:
        n = left[size]
        place(size, n, used, capacity)
        used += n
    large = sorted((s for s in left if capacity > s > capacity / large_over and left[s]), reverse=True)
    total = sum(left[s] for s in large)
    if total:
        # Equal-cardinality groups, as lists of (length, pieces).
        want, queue = -(-total // groups), [[s, left[s]] for s in large]
        members: list[list[list[int]]] = []
        while queue:
            need, own = want, []
            while need and queue:
                n = min(need, queue[0][1])
                own.append([queue[0][0], n])
                queue[0][1] -= n
                need -= n
                if not queue[0][1]:
                    queue.pop(0)
            if members and members[-1][0][0] == own[0][0]:  # the same rounded length
                members[-1] += own
            else:
                members.append(own)
        sizes = [m[0][0] for m in members]
        for pattern, x in configurations(sizes, [sum(n for _, n in m) for m in members], capacity):
            n = int(x + 1e-6)
            slots = [i for i, c in enumerate(pattern) for _ in range(c)]
            n = min([n, *(sum(c for _, c in members[i]) // pattern[i] for i in set(slots))])
            if not n or not slots:
                continue
            blocks = [(used, n, capacity)]
            used += n
            for i in slots:
                after = []
                for first, many, room in blocks:
                    while many:
                        size, have = members[i][0]
                        take = min(many, have)
                        runs.append((size, rank[size], take, first, capacity - room))
                        rank[size] += take
                        left[size] -= take
                        after.append((first, take, room - size))
                        first, many = first + take, many - take
                        members[i][0][1] -= take
                        if not members[i][0][1]:
                            members[i].pop(0)
                blocks = after
            for first, many, room in blocks:
                free[room].append((first, many))
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            room = min((r for r in free if r >= size and free[r]), default=None)
            if room is None:
                n = -(-left[size] // (capacity // size))
                place(size, n, used, capacity)
                used += n
                continue
            first, many = free[room].pop()
            n = min(many, left[size])
            if many > n:
                free[room].append((first + n, many - n))
            place(size, n, first, room)
    runs.sort()
    return np.array(runs, dtype=np.int64).reshape(-1, 5), used


def _look_up(runs: np.ndarray):
    keys = runs[:, 0] << 48 | runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, length.astype(np.int64) << 48 | rank, side="right") - 1
            own = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in own), pa.array(runs[at, 3] + rank - runs[at, 1], pa.int64()), pa.array(runs[at, 4], pa.int64())], names=[*own, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack the token ids of every document into sequences of at most capacity.

    Returns one row per piece: the id column, piece, start, length, ids_crc32,
    sequence_id and offset (gapless from 0), and ids if with_ids. Only documents
    longer than capacity are cut; their first piece may be shorter. Null and empty
    texts are the end id alone; null ids are packed like others; repeated rows
    are packed as often as they come; an empty table gives an empty one. Other
    columns are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = written(rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity, with_ids), schema), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs, _ = min((plan(counts, capacity, large_over=k) for k in LARGE), key=lambda found: found[1])
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(counts.values()) // 50_000)
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    each = sharded.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    before = each.select("length", "_shard", (F.sum("_n").over(W.partitionBy("length").orderBy("_shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("length", "_shard").orderBy("_id", "piece", "ids_crc32")) - 1
    ranked = sharded.withColumn("_in", within).join(before, ["length", "_shard"]).withColumn("_rank", (F.col("_before") + F.col("_in")).cast("long"))
    own = ["_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    placed = ranked.select(*own, "_rank").mapInArrow(_look_up(runs), f"{schema}, sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)
