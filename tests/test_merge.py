import io
import json
import os

import pytest
from strandweave import cli
from strandweave.plans.align import align
from strandweave.plans.analysis import analysis
from strandweave.plans.build import CannotBuild, build
from strandweave.plans.merge_plan import Segment, build_plan, merge_runs
from strandweave.plans.report import render
from strandweave.plans.verify import NotATransportStream, decode_errors, decode_spots, verify, verify_build
from strandweave.sources import captures, transport
from strandweave.streaming.ingest import ingest
from strandweave.sources.synthetic import Tape


def test_a_capture_is_put_together_range_by_range(spark, tmp_path):
    from pyspark.sql import functions as F

    # No labels between packets 400 and 1,000, and ranges without a unit's beginning.
    data = bytearray(Tape(0, 300, {7: "cc", 30: "cc", 31: "corrupt"}, (50,)).render())
    for k in range(400, 1000):
        if data[188 * k + 1] & 31 == 2 and data[188 * k + 2] == 1:
            data[188 * k + 2] = 5
    path = tmp_path / "A.m2t"
    path.write_bytes(bytes(data))
    whole = sorted(map(str, captures.scan(spark, [str(path)]).collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for each in (188 * 40, 188 * 401):
            rows = captures.scan(spark, [str(path)], each)
            assert sorted(map(str, rows.collect())) == whole and len(whole) == 300
            assert rows.where("i >= 0").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_captures_are_placed_like_one_after_the_other_and_in_time():
    import random
    import time

    from strandweave.plans.align import placed

    def slowly(names, sizes, votes):
        shifts, rank = {names[0]: 0}, {names[0]: 0}
        while len(shifts) < len(names):
            best = None
            for s in names:
                total, first = {}, {}
                for p, own, delta, n, min_j in votes:
                    if own == s and s not in shifts and p in shifts:
                        place = shifts[p] + delta
                        total[place] = total.get(place, 0) + n
                        seen = (min_j, rank[p], min_j + delta)
                        first[place] = min(first.get(place, seen), seen)
                if total:
                    place = min(total, key=lambda k: (-total[k], first[k]))
                    if best is None or total[place] > best[0]:
                        best = total[place], s, place
            if best is None:
                after = max(shifts[s] + sizes[s] for s in shifts)
                for s in names:
                    if s not in shifts:
                        shifts[s], after = after, after + sizes[s]
                break
            rank[best[1]], shifts[best[1]] = len(rank), best[2]
        return shifts

    rnd = random.Random(5)
    for _ in range(300):
        names = [f"c{k}" for k in range(rnd.randint(1, 9))]
        sizes = {s: rnd.randint(1, 9) for s in names}
        votes = {(p, s, rnd.randint(-3, 3)): (rnd.randint(1, 3), rnd.randrange(4)) for p in names for s in names if p != s and rnd.random() < 0.4 for _ in range(3)}
        votes = [(*k, *v) for k, v in votes.items()]
        assert placed(names, sizes, iter(votes)) == slowly(names, sizes, votes)
    names = [f"c{k:06d}" for k in range(20_000)]
    near = [(names[a], names[b], (b - a) * 250, 150, 0) for k in range(19_999) for a, b in ((k, k + 1), (k + 1, k))]
    began = time.monotonic()
    got = placed(names, dict.fromkeys(names, 400), near)
    assert [got[s] for s in names] == [k * 250 for k in range(20_000)] and time.monotonic() - began < 20


def units_of(spark, tmp_path, **tapes):
    paths = [tape.write(tmp_path / f"{name}.m2t") for name, tape in tapes.items()]
    return captures.units(captures.scan(spark, paths)).cache()


def scanned(path):
    data = open(path, "rb").read()
    return transport.Scan(transport.find_streams(data)).read(io.BytesIO(data), len(data))


def test_clean_merge(spark, tmp_path):
    rows = units_of(spark, tmp_path, A=Tape(0, 40), B=Tape(10, 50))
    axis = align(rows)
    assert axis.chain == ["A", "B"] and axis.shifts == {"A": 0, "B": 10}
    plan = build_plan(rows, axis)
    assert len(plan.segments) == 2 and plan.total_frames == 200 and plan.complete
    assert not (plan.residuals or plan.divergences or plan.gaps or plan.lost or plan.bad_seams)
    out = str(tmp_path / "out.m2t")
    size = build(spark, plan, out)
    assert size == os.path.getsize(out) and not os.path.exists(out + ".part")
    got = scanned(out)
    assert len(got) == 50 and sum(u.cc + u.tei for u in got) == 0
    plain = b"".join(open(s.src, "rb").read()[s.off : s.end] for s in plan.segments)
    built = open(out, "rb").read()
    differ = [k for k in range(len(plain)) if plain[k] != built[k]]
    assert len(plain) == len(built) and differ and all(k % 188 == 3 and plain[k] >> 4 == built[k] >> 4 for k in differ)
    ok, info = verify_build(spark, out, plan)
    assert ok and info["cc"] == 0 and info["rec_head"]
    at = next(k for k in range(188 * 50, len(built), 188) if (built[k + 1] & 31) << 8 | built[k + 2] == 0x200)
    broken = bytearray(built)
    broken[at + 3] = broken[at + 3] & 0xF0 | (broken[at + 3] + 7) & 15
    open(out, "wb").write(bytes(broken))
    ok, info = verify_build(spark, out, plan)
    assert not ok and info["cc"] > info["expected_cc"]
    text = json.dumps(analysis(rows, plan), sort_keys=True)
    got = json.loads(text)
    assert got["chain"] == ["A", "B"] and got["complete"] and len(got["segments"]) == 2 and got["sources"][0]["ngops"] == 40
    assert "Nothing to capture again" in render(plan)


def test_damage_is_routed_around_or_reported(spark, tmp_path):
    plan = build_plan(units_of(spark, tmp_path, A=Tape(0, 40, {24: "cc"}), B=Tape(10, 50)))
    assert not plan.residuals and plan.total_frames == 200
    plan = build_plan(units_of(spark, tmp_path, C=Tape(0, 40, {5: "cc"})))
    assert [r["tag"] for r in plan.residuals] == ["C"] and plan.residuals[0]["rec"] in ("2007-01-01 09:00:04", "2007-01-01 09:00:05")
    assert not plan.complete and "Capture again" in render(plan)


def test_divergence_is_flagged(spark, tmp_path):
    plan = build_plan(units_of(spark, tmp_path, A=Tape(0, 40, {24: "corrupt"}), B=Tape(10, 50)))
    assert plan.divergences and any(c["tag"] == "A" for d in plan.divergences for c in d["copies"])


def test_majority_over_a_dropout(spark, tmp_path):
    rows = units_of(spark, tmp_path, A=Tape(0, 40, {24: "corrupt"}, (25, 26, 27)), B=Tape(10, 40), C=Tape(10, 40))
    plan = build_plan(rows)
    assert plan.alignment.chain[0] == "A" and plan.divergences and not plan.lost
    out = str(tmp_path / "out.m2t")
    build(spark, plan, out)
    recs = [u.rec for u in scanned(out)]
    assert len(recs) == 40 and recs == sorted(recs)


def test_decode_flags(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = units_of(spark, tmp_path, A=Tape(0, 40, {23: "corrupt"}), B=Tape(0, 40))
    flagged = rows.withColumn("dec", F.when((F.col("capture") == "A") & (F.col("j") == 24), 4).otherwise(0))
    assert not build_plan(flagged).residuals
    alone = units_of(spark, tmp_path, D=Tape(0, 20)).withColumn("dec", F.when(F.col("j") == 5, 3).otherwise(0))
    assert [r["dec"] for r in build_plan(alone).residuals] == [3]


def test_redundant_island_and_twin(spark, tmp_path):
    bad = {k: "corrupt" for k in range(20, 24)}
    plan = build_plan(units_of(spark, tmp_path, long=Tape(0, 40), short=Tape(20, 24, bad)))
    out = str(tmp_path / "out.m2t")
    build(spark, plan, out)
    assert len(scanned(out)) == 40
    plan = build_plan(units_of(spark, tmp_path, A=Tape(0, 40), B=Tape(0, 40)))
    assert plan.total_frames == 160 and not any(s.gap_before for s in plan.segments)
    assert plan.never_emitted == ["B"] and plan.unused_sources == []


def test_island_over_a_gap(spark, tmp_path):
    plan = build_plan(units_of(spark, tmp_path, A=Tape(0, 20), B=Tape(30, 50)))
    assert [(s.tag, s.gap_before) for s in plan.segments] == [("A", False), ("B", True)] and plan.total_frames == 160
    assert plan.gaps == []
    assert len(plan.lost) == 1
    out = str(tmp_path / "out.m2t")
    size = build(spark, plan, out)
    assert size == sum(s.nbytes for s in plan.segments) + 188
    got = scanned(out)
    assert len(got) == 40 and sum(u.cc for u in got) == 0
    assert "⟂" in render(plan)


def test_stray_first_capture_and_unique_tail(spark, tmp_path):
    plan = build_plan(units_of(spark, tmp_path, a=Tape(0, 10), b=Tape(20, 50, {35: "cc"}), c=Tape(30, 60)))
    assert {s.tag for s in plan.segments} == {"a", "b", "c"} and not plan.residuals
    spine = Tape(0, 100, {k: "cc" for k in range(85, 90)}, tuple(range(90, 95)))
    plan = build_plan(units_of(spark, tmp_path, spine=spine, tail=Tape(85, 95)))
    assert plan.total_frames == 400


def test_merge_order_falls_back_to_the_wall_clock():
    seg = lambda tag, rec, run: Segment(tag, "", 0, 0, 0, 188, rec, rec, None, None, run)
    m = [seg("m", "2007-01-01 09:00:00", 0), seg("m", "2007-01-01 09:10:00", 0)]
    got = merge_runs([m, [seg("f", "2007-01-01 09:05:00", 1)]], lambda s: None)
    assert [(s.tag, s.gap_before) for s in got] == [("m", False), ("f", True), ("m", True)]
    clock = {"m": 5.0, "f": 1.0}
    assert [s.tag for s in merge_runs([m, [seg("f", "2007-01-01 09:05:00", 1)]], lambda s: clock[s.tag])] == ["f", "m", "m"]


def test_empty_and_refused(spark, tmp_path):
    rows = units_of(spark, tmp_path, A=Tape(0, 4)).where("false")
    plan = build_plan(rows)
    assert plan.segments == [] and plan.complete
    with pytest.raises(CannotBuild):
        build(spark, plan, str(tmp_path / "none.m2t"))
    (tmp_path / "x.m2t").write_bytes(b"not a stream")
    with pytest.raises(NotATransportStream):
        verify(str(tmp_path / "x.m2t"))


def test_cache_work_list_and_json_lines(spark, tmp_path):
    path, cache = Tape(0, 12).write(tmp_path / "A.m2t"), str(tmp_path / "cache")
    assert captures.needs_work(spark, [path], cache) == [path]
    first = captures.index(spark, [path], cache)
    assert first.where("i >= 0").count() == 12 and captures.needs_work(spark, [path], cache) == []
    again = captures.index(spark, [path], cache)
    assert again.count() == 13
    Tape(0, 9).write(tmp_path / "A.m2t")
    assert captures.needs_work(spark, [path], cache) == [path]
    assert captures.index(spark, [path], cache).where("i >= 0").count() == 9
    to = captures.index_path(path, str(tmp_path))
    captures.save_jsonl(captures.index(spark, [path], cache), path, to)
    head, rows = captures.load_jsonl(spark, to)
    assert head["v"] == captures.VERSION and rows.count() == 9
    before = open(to, "rb").read()
    captures.save_jsonl(captures.index(spark, [path], cache), path, to)
    assert open(to, "rb").read() == before
    (tmp_path / "sub").mkdir()
    Tape(0, 9).write(tmp_path / "sub" / "A.m2t")
    with pytest.raises(captures.SameTag):
        captures.units(captures.scan(spark, [path, str(tmp_path / "sub" / "A.m2t")]))
    assert captures.discover([str(tmp_path / "sub"), str(tmp_path / "sub" / "A.m2t")]) == [str(tmp_path / "sub" / "A.m2t")]


def test_packet_source_with_a_pushed_filter(spark, tmp_path):
    path = Tape(0, 30).write(tmp_path / "A.m2t")
    rows = captures.packets(spark, [path], per_partition=7)
    assert rows.count() == os.path.getsize(path) // 188
    assert rows.where("pid = 513").count() == 30
    assert rows.where("pid = 512 and unit_start").count() == 30


def test_streaming_ingest(spark, tmp_path):
    folder, cache = tmp_path / "in", str(tmp_path / "cache")
    folder.mkdir()
    Tape(0, 5).write(folder / "A.m2t")
    ingest(spark, str(folder), cache, str(tmp_path / "ck")).awaitTermination()
    Tape(0, 7).write(folder / "B.m2t")
    ingest(spark, str(folder), cache, str(tmp_path / "ck")).awaitTermination()
    got = spark.read.schema(captures.UNITS).parquet(cache).where("i >= 0").groupBy("tag").count().collect()
    assert {r["tag"]: r["count"] for r in got} == {"A": 5, "B": 7}


def test_decoder_log(spark):
    rows = spark.createDataFrame([(k, k * 43200, 12, 0, 0, f"00:00:00:{k:02d}", "2007-01-01 09:00:00") for k in range(30)], "j long, pts long, npic int, cc int, tei int, tc string, rec string")
    lines = ["[mpeg2video] ac-tex damaged", "Packet corrupt (dts = 5)", "[Parsed_showinfo] n:0 pts_time:0.0", "concealing 3 errors", "[Parsed_showinfo] n:1 pts_time:9.7", "damaged at the end"]
    log = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    got = {(r["kind"], r["j"]): r["errors"] for r in decode_errors(log, rows).collect()}
    assert got == {("error", 0): 1, ("container", 0): 1, ("error", 20): 1}
    spots = decode_spots(rows, decode_errors(log, rows), [24], []).collect()
    assert [(s["kind"], s["frame"], s["count"]) for s in spots] == [("residual", 0, 1), ("unexplained", 240, 1)]


def test_command_line(spark, tmp_path, capsys):
    Tape(0, 20).write(tmp_path / "A.m2t")
    Tape(5, 30).write(tmp_path / "B.m2t")
    assert cli.main(["--json", "--no-index", str(tmp_path)], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["total_frames"] == 120
    out = str(tmp_path / "m.out")
    assert cli.main(["-o", out, "--index-dir", str(tmp_path / "ix"), str(tmp_path)], spark) == 0
    assert os.path.exists(out + ".report.md")
    kept = {n: (tmp_path / "ix" / f"{n}.m2t.idx.jsonl") for n in "AB"}
    before = {n: (p.stat().st_mtime_ns, len(p.read_text().splitlines())) for n, p in kept.items()}
    assert [n for _, n in before.values()] == [21, 26]
    assert cli.main(["--index-dir", str(tmp_path / "ix"), str(tmp_path)], spark) == 0
    assert before == {n: (p.stat().st_mtime_ns, len(p.read_text().splitlines())) for n, p in kept.items()}
    (tmp_path / "e").mkdir()
    assert cli.main([str(tmp_path / "e")], spark) == 2
    with pytest.raises(SystemExit):
        cli.main(["--index-dir", "x", "--no-index", "y"], spark)


def test_progress_is_told(spark):
    import time

    from strandweave.progress import watched

    seen = []
    with watched(spark, lambda done, total: seen.append((done, total)), 0.05):
        spark.range(8).repartition(8).rdd.foreach(lambda _: time.sleep(0.3))
    assert seen and all(0 <= a <= b for a, b in seen)


def test_wider_framing_is_built(spark, tmp_path):
    def wide(path, tape):
        data = tape.render()
        path.write_bytes(b"".join(data[k : k + 188] + b"\1\2\3\4" for k in range(0, len(data), 188)))
        return str(path)

    paths = [wide(tmp_path / "A.m2t", Tape(0, 20)), wide(tmp_path / "B.m2t", Tape(30, 50))]
    plan = build_plan(captures.units(captures.scan(spark, paths)))
    out = "file://" + str(tmp_path / "out.m2t")
    size = build(spark, plan, out)
    data = open(tmp_path / "out.m2t", "rb").read()
    assert len(data) == size and size % 192 == 0 and all(data[k] == 0x47 for k in range(0, size, 192))
    got = scanned(str(tmp_path / "out.m2t"))
    assert len(got) == 40 and sum(u.cc for u in got) == 0


def test_parts_are_joined_where_tasks_cannot_share_a_file(spark, tmp_path, monkeypatch):
    from strandweave.plans import build as B

    rows = units_of(spark, tmp_path, A=Tape(0, 20), B=Tape(10, 30))
    plan = build_plan(rows)
    build(spark, plan, str(tmp_path / "one.m2t"))
    monkeypatch.setattr(B, "local_path", lambda _: None)
    build(spark, plan, str(tmp_path / "two.m2t"))
    assert (tmp_path / "one.m2t").read_bytes() == (tmp_path / "two.m2t").read_bytes() and not (tmp_path / "two.m2t.parts").exists()


#: Says of each capture that its sixth second has damage.
DECODER = ("python3", "-c", "import sys; e=sys.stderr; print('[showinfo] n:0 pts_time:0.0', file=e); print('[mpeg2video] ac-tex damaged', file=e); print('[showinfo] n:1 pts_time:0.0 ' + sys.argv[1], file=e)", "{path}")


def test_decoder_pass_is_kept_and_made_up_for(spark, tmp_path):
    paths, cache = [Tape(0, 12).write(tmp_path / f"{n}.m2t") for n in "AB"], str(tmp_path / "cache")
    captures.index(spark, paths[:1], cache, decoder=DECODER)
    assert captures.needs_work(spark, paths, cache) == captures.needs_work(spark, paths, cache, decode=True) == paths[1:]
    plain = captures.index(spark, paths, cache)
    assert {(r.path, r.decoded) for r in plain.where("i = -1").collect()} == {(paths[0], True), (paths[1], False)}
    assert captures.needs_work(spark, paths, cache) == [] and captures.needs_work(spark, paths, cache, decode=True) == paths[1:]
    done = captures.index(spark, paths, cache, decoder=DECODER)
    assert done.count() == 26 and captures.needs_work(spark, paths, cache, decode=True) == []
    assert {(r.path, r.i, r.dec) for r in done.where("dec > 0").collect()} == {(p, 0, 1) for p in paths}
    direct = captures.index(spark, paths, None, decoder=DECODER)
    assert sorted(map(str, direct.collect())) == sorted(map(str, done.select(direct.columns).collect()))


def test_command_line_runs_a_decoder(spark, tmp_path, capsys):
    import shlex

    Tape(0, 20).write(tmp_path / "A.m2t")
    assert cli.main(["--json", "--no-index", "--decoder", shlex.join(DECODER), str(tmp_path)], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["sources"][0]["dec"] == 1 and got["sources"][0]["decoded"]
    assert cli.main(["--json", "--no-index", "--decoder", "no-such-decoder {path}", str(tmp_path)], spark) == 0
    assert "no-such-decoder is not here" in capsys.readouterr().err


def test_sources_not_used_are_reported_with_their_span(spark, tmp_path):
    plan = build_plan(units_of(spark, tmp_path, A=Tape(0, 40), B=Tape(0, 40)))
    assert "| B " in render(plan) and "09:00:00 – 09:00:39" in render(plan)


@pytest.mark.parametrize("each", [752 * 3, 5000, 100_000])
def test_ranges_of_a_capture_give_what_one_reading_gives(spark, tmp_path, each):
    path = Tape(0, 60, {7: "cc", 20: "corrupt", 33: "cc"}, (40, 41)).write(tmp_path / "A.m2t")
    data = open(path, "rb").read()
    open(path, "wb").write(b"junk" * 30 + data[: 188 * 100] + b"lost sync" + data[188 * 100 :])
    want = scanned(path)
    got = captures.scan(spark, [path], each).where("i >= 0").orderBy("i").collect()
    names = ("i", "off", "end", "npic", "closed", "broken", "pts", "h", "cc", "tei", "rec", "tc")
    assert [tuple(r[c] for c in names) for r in got] == [tuple(getattr(u, c) for c in names) for u in want]


def test_names_of_captures(spark):
    from pyspark.sql import functions as F

    paths = ["/a/b.c.m2t", "x", "/a/.hidden", "file:///d/e.ts", "/a/b."]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(captures.tag_column(F.col("path"))).collect()
    assert [r[0] for r in rows] == [captures.tag_of(p) for p in paths]
