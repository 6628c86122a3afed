"""Near-duplicates by 64-bit SimHash, found by the generalised pigeonhole.

The bits are split into m parts; correlated bits share one, so that the other
parts tell texts apart better. Part i gets a radius r_i with
sum(r_i) = distance - m + 1 (a part with radius -1 is not looked at): two
fingerprints within the distance then agree in some part up to its radius. A
dynamic program gives the radii, and the least cost over m the split, from the
estimated numbers of probes and candidates, which depend on how many
fingerprints there are: more of them get wider parts and more probes, and the
candidates per fingerprint stay few at any size.

Candidates are verified inside the join. A bucket of many fingerprints (a large
group of near copies) is cut into blocks, and each pair of blocks returns a
spanning forest of its links instead of all of them, so what comes out grows as
the group, every component stays whole, and no task gets more than two blocks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.graph import components
from strandweave.llm.words import sliced, texts_of
from strandweave.session import discard, parts_for, written

SAMPLE = 4096  # fingerprints that the candidate counts are estimated from
BIG = 128  # bucket size beyond which blocks are used
BLOCK = 2048  # fingerprints of a block at most
SPREAD, LEAST_BLOCK = 8, 256  # a bucket has so many blocks unless they were smaller than this
_SIGN = 1 << 63


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGN else x


def _text_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined, n = b" ".join(words), len(words)
    if n <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = list(itertools.accumulate(map(len, words), lambda at, x: at + 1 + x))
    starts = [0, *(e + 1 for e in ends[: n - size])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=True)]


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 18):
            texts = texts_of(batch.column(1))
            hashes, counts = [], []
            for k in range(len(texts)):
                own = _text_hashes(texts.bytes_of(k), size)
                hashes += own
                counts.append(len(own))
            counts = np.array(counts)
            out = np.zeros(len(texts), dtype=np.uint64)
            if hashes:
                bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                over = sums * 2 > counts[full][:, None]
                out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64), pa.int64()), batch.column(2)], names=["_id", "_fp", "_mark"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """_id, _fp (a signed long) and _mark (a hash of the text) of every row; _fp is 0 for null texts and those without words."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.withColumn("_mark", F.xxhash64("text")).mapInArrow(_prints(size), f"_id {kind}, _fp long, _mark long")


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((64, 64))
    for batch in batches:
        fps = batch.column(0).to_numpy().astype("<i8")
        for k in range(0, len(fps), 1 << 15):
            bits = np.unpackbits(np.ascontiguousarray(fps[k : k + (1 << 15)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
    i, j = np.indices((64, 64)).reshape(2, -1)
    yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel().astype(np.int64), pa.int64())], names=["i", "j", "c"])


def correlations(nodes: DataFrame, n: int) -> np.ndarray:
    """Absolute correlations of the 64 bits over all fingerprints."""
    sums = np.zeros((64, 64))
    for i, j, c in nodes.select("_fp").mapInArrow(_joint, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c")).collect():
        sums[i, j] = c
    p = sums / max(n, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs((p - np.outer(mean, mean)) / np.outer(spread, spread))


def grouped_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each takes the bit most correlated with it next."""
    free, out = set(range(64)), []
    for k in range(m):
        want = 64 // m + (k < 64 % m)
        rest = sorted(free)
        first = max(rest, key=lambda b: (corr[b, rest].sum(), -b))
        part = [first]
        free.discard(first)
        while len(part) < want:
            part.append(max(sorted(free), key=lambda b: (corr[b, part].sum(), -b)))
            free.discard(part[-1])
        out.append(sorted(part))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Radii from -1 up, one for each part, that sum to total at the least cost.

    costs[i][r + 1] is the cost of radius r in part i.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (c, radii) in best.items():
            for r in range(-1, len(own) - 1):
                new = (c + own[r + 1], [*radii, r])
                if s + r not in after or new < after[s + r]:
                    after[s + r] = new
        best = after
    return best[total]


def plan_parts(corr: np.ndarray, sample: np.ndarray, n: int, distance: int) -> list[tuple[int, int]]:
    """(mask, radius) of the parts that are looked at."""
    sample = sample.astype(np.uint64)
    pairs = max(1, len(sample) * (len(sample) - 1) // 2)
    plans = []
    for m in range(2, distance + 3):
        parts, costs = grouped_bits(corr, m), []
        for part in parts:
            mask, w = np.uint64(sum(1 << b for b in part)), len(part)
            seen = np.zeros(distance + 1)
            for k in range(len(sample)):
                far = np.bitwise_count((sample[k + 1 :] ^ sample[k]) & mask)
                seen += np.bincount(np.minimum(far, distance + 1), minlength=distance + 2)[: distance + 1]
            own = [0.0]
            for r in range(distance + 1):
                ball = sum(math.comb(w, k) for k in range(r + 1))
                share = max(seen[: r + 1].sum() / pairs, ball / 2**w)
                own.append(1 + ball + 0.25 * n * share)
            costs.append(own)
        cost, radii = allocate(costs, distance - m + 1)
        plans.append((cost, [(sum(1 << b for b in part), r) for part, r in zip(parts, radii, strict=True) if r >= 0]))
    return min(plans)[1]


def _ball(mask: int, radius: int) -> list[int]:
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [_signed(sum(x)) for r in range(radius + 1) for x in itertools.combinations(bits, r)]


def _bound(f, *first):
    return lambda v: f(*first, v)


def forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the same values as all links within the distance do."""
    rest = np.unique(values)
    out: list[tuple[int, int]] = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            found, rest = rest[near], rest[~near]
            out += [(int(at), int(x)) for x in found]
            queue += list(found)
    return out


def _block_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[:4]):
            links = forest(np.array([r[4] for r in group], dtype=np.int64).view(np.uint64), distance)
            if links:
                both = np.array(links, dtype=np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def _blocks(n: Column) -> Column:
    """How many blocks a bucket of n fingerprints has."""
    return F.greatest(F.ceil(n / BLOCK), F.least(F.lit(SPREAD), F.ceil(n / LEAST_BLOCK))).cast("long")


def links(nodes: DataFrame, distance: int = 3, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Links a, b between fingerprints (nodes: distinct _fp) that hold the same components as all pairs within the distance.

    scratch gets the tables that the links are made of, which can go once the links are written.
    """
    n = nodes.count()
    bounded = nodes.select("_fp").orderBy(F.xxhash64("_fp"), "_fp").limit(SAMPLE)
    sample = np.array([r[0] for r in bounded.collect()], dtype=np.int64).view(np.uint64)
    parts = plan_parts(correlations(nodes, n), sample, n, distance)
    part_key = lambda k, mask, v: F.struct(F.lit(k).alias("part"), F.col("_fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(v).alias("key"))
    kept = [part_key(k, mask, F.lit(0)) for k, (mask, _) in enumerate(parts)]
    index = nodes.select("_fp", F.explode(F.array(*kept)).alias("x")).select("x.*", "_fp")
    near = [F.transform(F.array(*map(F.lit, _ball(mask, r))), _bound(part_key, k, mask)) for k, (mask, r) in enumerate(parts)]
    probes = nodes.select("_fp", F.explode(F.concat(*near)).alias("x")).select("x.*", "_fp")
    # Each is written before it meets the other: the joins then have plain shuffles on both sides, whose large partitions Spark can split.
    big = written(index.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BIG), "big")
    index = written(index.join(big, ["part", "key"], "left"), "index")
    probes = written(probes.join(big, ["part", "key"], "left"), "probes")
    few = index.where("n is null").select("part", "key", F.col("_fp").alias("b"))
    asked = probes.where("n is null").select("part", "key", F.col("_fp").alias("a"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    pairs = asked.join(few, ["part", "key"]).where(close).select("a", "b")
    # A big bucket: rows of a block go to all blocks of the other side.
    asking = probes.where("n is not null").select("part", "key", "n", "_fp")
    asks = asking.groupBy("part", "key").agg(F.max("n").alias("n"), F.count("*").alias("asks"))
    blocks = written(asks.select("part", "key", _blocks(F.col("n")).alias("kd"), _blocks(F.col("asks")).alias("kp")), "blocks")
    place = lambda k: F.pmod(F.xxhash64("_fp", F.lit(7)), F.col(k))
    held = index.where("n is not null").drop("n").join(blocks, ["part", "key"]).select("part", "key", F.explode(F.sequence(F.lit(0), F.col("kp") - 1)).alias("p"), place("kd").alias("d"), "_fp")
    sent = asking.drop("n").join(blocks, ["part", "key"]).select("part", "key", place("kp").alias("p"), F.explode(F.sequence(F.lit(0), F.col("kd") - 1)).alias("d"), "_fp")
    cells = held.unionByName(sent).repartition(parts_for(nodes), "part", "key", "p", "d").sortWithinPartitions("part", "key", "p", "d")
    if scratch is not None:
        scratch += [big, index, probes, blocks]
    return pairs.unionByName(cells.mapInArrow(_block_links(distance), "a long, b long"))


def _by_group(prints: DataFrame, distance: int, first: Column) -> DataFrame:
    """_fp and least (the least value of `first` in its group) of every distinct fingerprint."""
    nodes = written(prints.groupBy("_fp").agg(F.min(first).alias("first")), "nodes")
    scratch: list[DataFrame] = []
    roots = components(links(nodes, distance, scratch)).withColumnRenamed("node", "_fp")
    discard(*scratch)
    grouped = written(nodes.join(roots, "_fp", "left").select("_fp", "first", F.coalesce("root", "_fp").alias("root")), "grouped")
    return grouped.join(grouped.groupBy("root").agg(F.min("first").alias("least")), "root").select("_fp", "root", "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """The group of every document.

    Returns the id column, fingerprint (16 hex digits) and component_id, the
    smallest id that links reach. Null and empty texts and texts of white space
    have fingerprint zero and form a group with all others that link to it.
    Repeated rows are rows of one group, and rows of one id with other texts are
    rows of the groups that their texts have. Null ids never name a group unless
    it has no other id; then component_id is null. An empty table gives an empty
    one; other columns are not looked at.
    """
    prints = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    named = _by_group(prints, distance, F.col("_id")).select("_fp", F.col("least").alias("component_id"))
    out = prints.join(named, "_fp")
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """docs with one row of each group: that of the least id, null ids last, and of the least text hash of one id.

    All columns stay, in their order. Rows are told apart by id and text, so one id
    may stay with several texts of different groups; of rows alike in both (repeated
    rows) one stays. An empty table gives an empty one.
    """
    key, mark, kept = "_simhash_id", "_simhash_mark", "_simhash_row"
    prints = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_mark").alias("mark"))
    first = _by_group(prints, distance, order).where("_fp = root").select("least.*")
    # Repeated rows become one before the shuffle that the join needs anyway.
    own = docs.select(F.col(id_col).alias(key), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(mark), F.struct(*map(F.col, docs.columns)).alias(kept))
    own = own.groupBy(key, mark).agg(F.first(kept).alias(kept))
    both = own.join(first, own[key].eqNullSafe(first["id"]) & (own[mark] == first["mark"]), "left_semi")
    return both.select(f"{kept}.*")
