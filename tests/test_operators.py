"""Operators against small procedural models, on random rows in many partitions at once."""

import random

from pyspark.sql import functions as F

from strandweave.functions import clocks
from strandweave.operators import matching as M
from strandweave.operators import ordered as O


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_rephase_makes_counters_run_on(spark):
    rnd = random.Random(1)
    rows = [(g, s, rnd.randrange(16), rnd.randrange(2), rnd.randrange(16)) for g in range(60) for s in range(rnd.randint(1, 9))]
    got = {(r.g, r.s): r.offset for r in O.rephase(frame(spark, rows, "g int, s int, first_cc int, payload int, last_cc int"), ["g"], "s").collect()}
    last = {}
    for g, s, a, p, b in rows:
        off = 0 if s == 0 else (last[g] + p - a) % 16
        assert got[g, s] == off
        last[g] = (b + off) % 16


def test_kway_merge_is_the_merge_of_heads(spark):
    rnd = random.Random(2)
    runs = [[rnd.randrange(8) for _ in range(rnd.randint(1, 7))] for _ in range(6)]
    rows = [(r, k, v) for r, own in enumerate(runs) for k, v in enumerate(own)]
    got = O.kway_merge(frame(spark, rows, "run int, k int, v int"), "run", "k", F.col("v")).orderBy("out_pos").collect()
    at, want, prev = [0] * len(runs), [], None
    while any(a < len(r) for a, r in zip(at, runs, strict=True)):
        r = min((x for x in range(len(runs)) if at[x] < len(runs[x])), key=lambda x: runs[x][at[x]])
        want.append((r, at[r], prev is not None and prev != r))
        at[r], prev = at[r] + 1, r
    assert [(x.run, x.k, x.gap_before) for x in got] == want


def test_asof_joins(spark):
    rnd = random.Random(3)
    left = [(g, rnd.randrange(40), k) for g in range(40) for k in range(4)]
    right = [(g, x, x * 100 + g) for g in range(38) for x in sorted(rnd.sample(range(40), rnd.randint(1, 6)))]
    got = {(r.g, r.id): (r.v, r.distance) for r in M.asof_nearest(frame(spark, left, "g int, x int, id int"), frame(spark, right, "g int, x int, v int"), ["g"], "x", "v").collect()}
    for g, x, k in left:
        own = [(abs(y - x), y, v) for gg, y, v in right if gg == g]
        assert got[g, k] == ((min(own)[2], min(own)[0]) if own else (None, None))
    clock = [(g, j, None if rnd.random() < 0.2 else rnd.randrange(30)) for g in range(40) for j in range(6)]
    probes = [(g, t, t) for g in range(40) for t in rnd.sample(range(35), 3)]
    found = {(r.g, r.t): r.j for r in M.asof_truncated(frame(spark, probes, "g int, t int, id int"), frame(spark, clock, "g int, j int, c int"), ["g"], "t", "c", "j").collect()}
    for g, t, _ in probes:
        answer = 0
        for gg, j, c in clock:
            if gg == g and c is not None:
                if c > t:
                    break
                answer = j
        assert found[g, t] == answer


def test_no_frame_is_gone_through_anew_for_every_row(spark):
    from strandweave.plans.verify import decode_errors

    rows = frame(spark, [(0, 1, 2, True, "x")], "g int, j int, c int, b boolean, line string")
    found = [
        M.asof_nearest(rows.select("g", "j", "c"), rows.select("g", "j", "line"), ["g"], "j", "line"),
        M.next_observation(rows, ["g"], ["j"], F.col("b"), F.col("b"), "c", "next"),
        O.clean_run_ahead(rows, ["g"], "j", F.col("b")),
        decode_errors(rows.withColumn("n", F.col("j")), rows.withColumn("pts", F.col("c"))),
    ]
    for df in found:
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "rowframe" in plan and not [x for x in plan.split("specifiedwindowframe(")[1:] if "unboundedfollowing" in x.split(")")[0] and "unboundedpreceding" not in x.split(")")[0]]


def test_sessions_and_breaks(spark):
    rnd = random.Random(4)
    rows = [(g, j, None if rnd.random() < 0.2 else rnd.randrange(40) / 10) for g in range(50) for j in range(8)]
    got = {(r.g, r.j): r.session for r in O.sessions(frame(spark, rows, "g int, j int, t double"), ["g"], ["j"], "t", 1.0, 0.2).collect()}
    last, session = {}, {}
    for g, j, t in rows:
        if t is not None:
            if g in last and (t - last[g] > 1.0 or t - last[g] < -0.2):
                session[g] = session.get(g, 0) + 1
            assert got[g, j] == session.get(g, 0)
            last[g] = t
    rows = [(g, j, rnd.randrange(4), rnd.random() < 0.7, rnd.random() < 0.2) for g in range(60) for j in range(9)]
    got = {(r.g, r.j): r.cc_break for r in O.counter_breaks(frame(spark, rows, "g int, j int, c int, p boolean, s boolean"), ["g"], ["j"], "c", F.col("p"), F.col("s"), 4).collect()}
    state = {}
    for g, j, c, p, s in rows:
        prev, armed = state.get(g, (None, False))
        if p:
            assert got[g, j] == int(prev is not None and not (armed or s) and c != (prev + 1) % 4)
            state[g] = (c, False)
        else:
            state[g] = (prev, armed or s)


def test_missing_ranges_and_clean_runs(spark):
    rnd = random.Random(5)
    rows = [(g, a, a + rnd.randrange(4)) for g in range(40) for a in rnd.sample(range(40), 4)]
    got = {}
    for r in O.missing_ranges(frame(spark, rows, "g int, lo int, hi int"), ["g"], "lo", "hi").collect():
        got.setdefault(r.g, set()).update(range(r.gap_from, r.gap_to + 1))
    for g in range(40):
        covered = {x for gg, a, b in rows if gg == g for x in range(a, b + 1)}
        assert got.get(g, set()) == set(range(min(covered), max(covered) + 1)) - covered
    bad = [(g, j, rnd.random() < 0.3) for g in range(40) for j in range(7)]
    runs = {(r.g, r.j): r.clean_run for r in O.clean_run_ahead(frame(spark, bad, "g int, j int, b boolean"), ["g"], "j", F.col("b"), 4).collect()}
    flags = {(g, j): b for g, j, b in bad}
    for (g, j), _ in flags.items():
        n = 0
        while n < 4 and flags.get((g, j + n)) is False:
            n += 1
        assert runs[g, j] == n


def test_lost_spans(spark):
    def lost(*rows):
        df = frame(spark, [(k, None if t is None else float(t), None if w is None else float(w)) for k, (t, w) in enumerate(rows)], "k int, t double, w double")
        return [(r.k, r.frames) for r in O.lost_spans(df, [], ["k"], "t", "w").collect()]

    assert lost((0, 0), (0.48, 0), (3.48, 3), (4, 4)) == [(1, 74)]
    assert lost((0, 0), (0.48, 60), (0.96, 61)) == []
    assert lost((20, 20), (5, 25), (8, 28)) == []
    assert lost((0, None), (9, 9), (None, 10), (30, 31)) == []


def test_clock_parsing(spark):
    rows = frame(spark, [("01:02:03:05", "2007-01-01 09:00:00"), ("01:02:03;05", "2007-01-01"), ("x", "2007-02-31 09:00:00"), (None, None), ("1:2:3", "soon")], "tc string, rec string")
    got = rows.select(clocks.timecode_seconds(F.col("tc")).alias("s"), clocks.wall_clock(F.col("rec")).isNotNull().alias("w")).collect()
    assert [r.s for r in got] == [3723.2, 3723.2, None, None, None] and [r.w for r in got] == [True, False, False, False, False]


def test_previous_looks_at_every_row(spark):
    rnd = random.Random(7)
    rows = [(k, f"v{k}") for k in rnd.sample(range(-50, 5000), 300)] + [(1 << 40, None)]
    order = sorted(rows)
    want = [(k, *((None, None) if i == 0 else order[i - 1])) for i, (k, _) in enumerate(order)]
    for buckets in (None, 1, 7, 400):
        got = O.previous(frame(spark, rows, "k long, v string").repartition(9), "k", ["k", "v"], buckets).collect()
        assert sorted((r.k, r.prev_k, r.prev_v) for r in got) == want
    assert O.previous(frame(spark, [], "k long, v string"), "k", ["k", "v"]).count() == 0


def test_whole_queries_leave_no_rows_out(spark):
    import os

    from strandweave.plans import driver_queries as D

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    segments = D.lines(spark, sf).select("capture").distinct().count()
    seams = D.QUERIES["q47_seam_check"](spark, sf).collect()
    assert len(seams) == segments - 1 and {r.capture % 10 for r in seams} == set(range(10))


def test_kway_merge_takes_the_least_head(spark):
    import heapq

    rnd = random.Random(9)
    runs = {g: [rnd.randrange(50) for _ in range(rnd.randint(1, 60))] for g in range(7)}
    rows = [(g, j, v) for g, own in runs.items() for j, v in enumerate(own)]
    heads, want = [(own[0], g, 0) for g, own in runs.items()], []
    heapq.heapify(heads)
    while heads:
        _, g, j = heapq.heappop(heads)
        want.append((g, j))
        if j + 1 < len(runs[g]):
            heapq.heappush(heads, (runs[g][j + 1], g, j + 1))
    got = sorted((r.out_pos, r.g, r.j, r.gap_before) for r in O.kway_merge(frame(spark, rows, "g int, j int, v int"), "g", "j", F.col("v")).collect())
    assert [x[1:3] for x in got] == want and [x[0] for x in got] == list(range(len(want)))
    assert [x[3] for x in got] == [k > 0 and want[k][0] != want[k - 1][0] for k in range(len(want))]
    assert O.kway_merge(frame(spark, [], "g int, j int, v int"), "g", "j", F.col("v")).count() == 0
