"""The relational operators over the driver's tables, and SQL that says the same.

Two views give the tables the roles of captures. Lines: a document is a capture,
its non-blank lines are positions, their md5 the content hash. Events: a user is
a capture, events in time order are positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandweave.functions import bits, clocks, text
from strandweave.operators import matching as M
from strandweave.operators import ordered as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """capture, source, j, h, len of every non-blank line."""
    docs = _t(spark, sf, "documents")
    own = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    each = docs.select(F.col("doc_id").alias("capture"), "source", F.posexplode(own).alias("j", "line"))
    return each.select("capture", "source", F.col("j").cast("long").alias("j"), F.md5(F.col("line").cast("binary")).alias("h"), F.length("line").alias("len"))


L = """l0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
l AS (SELECT doc_id AS capture, source, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS j, md5(line) AS h, length(line) AS len FROM l0 WHERE trim(line, ' ') <> '')"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    """capture, j, us, event_id, event_type, cents, k of every event."""
    e = _t(spark, sf, "events")
    us = clocks.micros(F.col("ts"))
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(F.col("user_id").alias("capture"), us.alias("us"), "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), k.alias("k"))
    j = F.row_number().over(W.partitionBy("capture").orderBy("us", "event_id")) - 1
    return rows.withColumn("j", j.cast("long"))


E = """e AS (SELECT user_id AS capture, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j, epoch_us(ts) AS us, event_id, event_type,
CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


# --- content joins over lines


@query("q01_align_votes", f"""WITH {L}, f AS (SELECT h FROM l GROUP BY h HAVING count(*) <= 4), u AS (SELECT capture, j, h FROM l WHERE h IN (SELECT h FROM f)),
v AS (SELECT p.capture AS p, s.capture AS s, p.j - s.j AS delta, count(*) AS votes, min(s.j) AS min_j FROM u p JOIN u s ON p.h = s.h AND p.capture < s.capture GROUP BY 1, 2, 3)
SELECT p, s, delta, votes, min_j FROM v QUALIFY row_number() OVER (PARTITION BY p, s ORDER BY votes DESC, min_j, delta) = 1""")
def q01(spark, sf):
    return M.top_votes(M.pair_votes(lines(spark, sf)))


@query("q02_hash_frequency", f"WITH {L} SELECT h, count(*) AS n, count(DISTINCT capture) AS n_captures FROM l GROUP BY h HAVING count(*) > 1")
def q02(spark, sf):
    return M.hash_frequency(lines(spark, sf)).where("n > 1")


LOCATED = f"""{L}, f AS (SELECT h FROM l GROUP BY h HAVING count(*) <= 4), u AS (SELECT capture, j, h, lag(h) OVER (PARTITION BY capture ORDER BY j) AS ph, count(*) OVER (PARTITION BY capture) AS n FROM l),
m AS (SELECT * FROM u WHERE h IN (SELECT h FROM f)), pr AS (SELECT capture, j, h, lag(h) OVER (PARTITION BY capture ORDER BY j) AS ph FROM m),
loc AS (SELECT t.capture AS t, t.j, q.capture AS q, q.j AS c FROM pr t JOIN pr q ON t.h = q.h AND t.capture <> q.capture
QUALIFY row_number() OVER (PARTITION BY t.capture, t.j, q.capture ORDER BY CASE WHEN t.ph = q.ph THEN 0 ELSE 1 END, abs(q.j - t.j), q.j) = 1)"""


@query("q03_locate", f"WITH {LOCATED} SELECT t, j, q, c FROM loc")
def q03(spark, sf):
    return M.locate(M.unambiguous(lines(spark, sf)))


@query("q04_clean_twin", f"""WITH {E}, x AS (SELECT *, event_type || ':' || CAST(cents // 100 AS VARCHAR) AS h, k % 10 = 0 AS t, k % 3 = 0 AS d FROM e)
SELECT capture, j, t OR (d AND h NOT IN (SELECT h FROM x WHERE NOT t AND NOT d)) AS bad FROM x""")
def q04(spark, sf):
    h = F.concat(F.col("event_type"), F.lit(":"), F.expr("cents div 100").cast("string"))
    rows = events(spark, sf).withColumn("h", h)
    return M.clean_twin(rows, F.col("k") % 10 == 0, F.col("k") % 3 == 0).select("capture", "j", "bad")


def candidates(spark, sf, with_own=False):
    """What may follow each row: t, j, ord, q, cj, h and facts of the candidate."""
    rows = lines(spark, sf)
    n = F.count("*").over(W.partitionBy("capture"))
    facts = O.clean_run_ahead(rows.withColumn("bad", F.col("len") % 7 == 0).withColumn("n", n), ["capture"], "j", F.col("bad"), 120)
    facts = facts.select(F.col("capture").alias("q"), F.col("j").alias("cj"), "h", "bad", "n", "clean_run")
    found = M.locate(M.unambiguous(rows)).select("t", "j", "q", (F.col("c") + 1).alias("cj"), (F.col("q") + 1).alias("ord"))
    if with_own:
        own = rows.select(F.col("capture").alias("t"), "j", F.col("capture").alias("q"), (F.col("j") + 1).alias("cj"), F.lit(0).cast("long").alias("ord"))
        found = found.unionByName(own)
    return found.join(facts, ["q", "cj"])


CANDIDATES = f"""{LOCATED}, fa AS (SELECT capture AS q, j AS cj, h, len % 7 = 0 AS bad, count(*) OVER (PARTITION BY capture) AS n,
least(coalesce(min(CASE WHEN len % 7 = 0 THEN j END) OVER (PARTITION BY capture ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), count(*) OVER (PARTITION BY capture)) - j, 120) AS clean_run FROM l),
c0 AS (SELECT t, j, q, c + 1 AS cj, q + 1 AS ord FROM loc), c1 AS (SELECT * FROM c0 UNION ALL SELECT capture, j, capture, j + 1, 0 FROM l),
ca AS (SELECT c0.t, c0.j, c0.ord, c0.q, c0.cj, fa.* EXCLUDE (q, cj) FROM c0 JOIN fa ON c0.q = fa.q AND c0.cj = fa.cj),
cb AS (SELECT c1.t, c1.j, c1.ord, c1.q, c1.cj, fa.* EXCLUDE (q, cj) FROM c1 JOIN fa ON c1.q = fa.q AND c1.cj = fa.cj)"""


@query("q05_majority_hash", f"WITH {CANDIDATES}, g AS (SELECT t, j, h, count(*) AS n, min(ord) AS o FROM ca GROUP BY 1, 2, 3) SELECT t, j, h, n FROM g QUALIFY row_number() OVER (PARTITION BY t, j ORDER BY n DESC, o) = 1")
def q05(spark, sf):
    return M.majority(candidates(spark, sf), ["t", "j"])


@query("q06_divergence", f"""WITH {CANDIDATES} SELECT t, j, count(DISTINCT h) AS n_hashes, string_agg(CAST(q AS VARCHAR) || ':' || CAST(cj AS VARCHAR) || ':' || h, ',' ORDER BY ord, CAST(q AS VARCHAR) || ':' || CAST(cj AS VARCHAR) || ':' || h) AS copies
FROM cb GROUP BY t, j HAVING count(DISTINCT h) > 1""")
def q06(spark, sf):
    label = F.concat_ws(":", F.col("q").cast("string"), F.col("cj").cast("string"), F.col("h"))
    return M.divergences(candidates(spark, sf, True), ["t", "j"], label)


@query("q07_successor", f"""WITH {CANDIDATES}, x AS (SELECT *, NOT bad AS clean, NOT bad AND least(cj, n - 1 - cj) >= 2 AS interior FROM cb),
ih AS (SELECT t, j, h, count(*) AS c, min(ord) AS o FROM x WHERE interior GROUP BY 1, 2, 3), im AS (SELECT t, j, h, c FROM ih QUALIFY row_number() OVER (PARTITION BY t, j ORDER BY c DESC, o) = 1),
lv AS (SELECT x.*, bool_or(clean) OVER (PARTITION BY t, j) AS any_clean FROM x), ph AS (SELECT t, j, h, count(*) AS c, min(ord) AS o FROM lv WHERE clean OR NOT any_clean GROUP BY 1, 2, 3),
pm AS (SELECT t, j, h FROM ph QUALIFY row_number() OVER (PARTITION BY t, j ORDER BY c DESC, o) = 1), own AS (SELECT t, j, h FROM x WHERE ord = 0 AND clean),
th AS (SELECT pm.t, pm.j, CASE WHEN own.h IS NULL THEN pm.h WHEN im.h IS NOT NULL AND im.h <> own.h AND coalesce(oc.c, 0) < im.c THEN im.h ELSE own.h END AS true_h FROM pm
LEFT JOIN own ON pm.t = own.t AND pm.j = own.j LEFT JOIN im ON pm.t = im.t AND pm.j = im.j LEFT JOIN ih oc ON own.t = oc.t AND own.j = oc.j AND own.h = oc.h),
gr AS (SELECT x.* FROM x JOIN th ON x.t = th.t AND x.j = th.j AND x.h = th.true_h)
SELECT t, j, q AS next_capture, cj AS next_j, h, bad FROM gr QUALIFY row_number() OVER (PARTITION BY t, j ORDER BY bad, least(cj, n - 1 - cj) < 2, q <> t, -clean_run, ord) = 1""")
def q07(spark, sf):
    from strandweave.plans.successor import choose

    return choose(candidates(spark, sf, True), edge=2).select("t", "j", F.col("q").alias("next_capture"), F.col("cj").alias("next_j"), "h", "bad")


# --- runs, sessions and sums over events


@query("q08_clean_run_ahead", f"WITH {E} SELECT capture, j, least(coalesce(min(CASE WHEN event_type = 'error' THEN j END) OVER (PARTITION BY capture ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), count(*) OVER (PARTITION BY capture)) - j, 6) AS clean_run FROM e")
def q08(spark, sf):
    return O.clean_run_ahead(events(spark, sf), ["capture"], "j", F.col("event_type") == "error", 6).select("capture", "j", "clean_run")


RUNS = f"{E}, a AS (SELECT *, event_type = 'error' AS f, j - row_number() OVER (PARTITION BY capture, event_type = 'error' ORDER BY j) AS g FROM e), r AS (SELECT capture, min(j) AS first, max(j) AS last, count(*) AS length, f FROM a GROUP BY capture, f, g)"


@query("q09_damage_runs", f"WITH {RUNS} SELECT capture, first, last, length, length = max(length) OVER (PARTITION BY capture) AND first = min(first) OVER (PARTITION BY capture, length) AS longest FROM r WHERE f")
def q09(spark, sf):
    runs = O.flag_runs(events(spark, sf), ["capture"], "j", F.col("event_type") == "error")
    best = O.longest_run(runs, ["capture"]).select("capture", "first", F.lit(True).alias("longest"))
    return runs.join(best, ["capture", "first"], "left").withColumn("longest", F.coalesce("longest", F.lit(False)))


@query("q10_coverage_sessions", f"""WITH {E}, k AS (SELECT capture, j, CASE WHEN k % 5 <> 0 THEN cents END AS t FROM e), n AS (SELECT *, t - lag(t) OVER (PARTITION BY capture ORDER BY j) AS d FROM k WHERE t IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN d > 1000 OR d < -200 THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY j ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM n)
SELECT capture, session, min(j) AS j_from, max(j) + 1 AS j_to, arg_min(t, j) AS t_first, arg_max(t, j) AS t_last FROM s GROUP BY capture, session""")
def q10(spark, sf):
    rows = events(spark, sf).withColumn("t", F.when(F.col("k") % 5 != 0, F.col("cents")))
    s = O.sessions(rows, ["capture"], ["j"], "t", 1000, 200)
    return s.groupBy("capture", "session").agg(F.min("j").alias("j_from"), (F.max("j") + 1).alias("j_to"), F.min_by("t", "j").alias("t_first"), F.max_by("t", "j").alias("t_last"))


@query("q11_residual_groups", f"""WITH {E}, x AS (SELECT capture, j, k, j - lag(j) OVER (PARTITION BY capture ORDER BY j) AS d FROM e WHERE event_type = 'error'),
g AS (SELECT *, sum(CASE WHEN d > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY capture ORDER BY j ROWS UNBOUNDED PRECEDING)::BIGINT AS near FROM x),
m AS (SELECT capture, near, min(j) AS j_from, max(j) AS j_to, count(*) AS n, max(CAST(k % 2 = 0 AS INT)) AS cc, max(CAST(k % 3 = 0 AS INT)) AS tei, max(CAST(k % 5 = 0 AS INT)) AS dec FROM g GROUP BY 1, 2)
SELECT capture, near, j_from, j_to, n, CASE WHEN cc + tei + dec = 0 THEN 'damage' ELSE concat_ws(', ', CASE WHEN cc > 0 THEN 'dropped packets' END, CASE WHEN tei > 0 THEN 'transport error' END, CASE WHEN dec > 0 THEN 'decode error' END) END AS kinds FROM m""")
def q11(spark, sf):
    errors = events(spark, sf).where("event_type = 'error'")
    groups = O.near_groups(errors, ["capture"], ["j"], "j", 5).groupBy("capture", "near")
    has = lambda m: F.max((F.col("k") % m == 0).cast("int"))
    found = groups.agg(F.min("j").alias("j_from"), F.max("j").alias("j_to"), F.count("*").alias("n"), has(2).alias("cc"), has(3).alias("tei"), has(5).alias("dec"))
    return found.select("capture", "near", "j_from", "j_to", "n", text.kinds(F.col("cc"), F.col("tei"), F.col("dec")).alias("kinds"))


@query("q12_coalesce", """WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), a AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS g FROM d)
SELECT l_suppkey, min(l_orderkey) AS j0, max(l_orderkey) AS j1, count(*) AS n FROM a GROUP BY l_suppkey, g""")
def q12(spark, sf):
    from strandweave.session import dealt

    rows = dealt(_t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey"), "l_suppkey").distinct()
    return O.coalesce_runs(rows, ["l_suppkey"], ["l_orderkey"], "l_orderkey").drop("seg")


@query("q18_prefix_frames", f"WITH {E} SELECT capture, j, coalesce(sum(k) OVER (PARTITION BY capture ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS frame0, sum(k) OVER (PARTITION BY capture)::BIGINT AS total FROM e")
def q18(spark, sf):
    rows = O.prefix_sum(events(spark, sf), ["capture"], ["j"], F.col("k"), "frame0")
    return rows.select("capture", "j", F.col("frame0").cast("long").alias("frame0"), F.sum("k").over(W.partitionBy("capture")).alias("total"))


@query("q19_lost_spans", f"""WITH {E}, x AS (SELECT capture, j, CAST(cents AS DOUBLE) / 100 AS tc, CAST(k AS DOUBLE) + CAST(cents AS DOUBLE) / 100 AS wall FROM e),
y AS (SELECT *, lead(tc) OVER w - tc AS gain, lead(wall) OVER w - wall AS passed, max(tc) OVER (PARTITION BY capture ORDER BY j ROWS UNBOUNDED PRECEDING) AS front FROM x WINDOW w AS (PARTITION BY capture ORDER BY j))
SELECT capture, j, CAST(greatest(1.0, round_even(gain * 25.0, 0) - 1) AS BIGINT) AS frames FROM y WHERE gain > 1.5 AND passed > 0 AND gain - passed <= greatest(1.0, 0.34 * gain) AND tc >= front - 1.0""")
def q19(spark, sf):
    rows = events(spark, sf).withColumn("tc", F.col("cents").cast("double") / 100)
    rows = rows.withColumn("wall", F.col("k").cast("double") + F.col("cents").cast("double") / 100)
    return O.lost_spans(rows, ["capture"], ["j"], "tc", "wall").select("capture", "j", "frames")


@query("q20_session_reset", f"""WITH {E}, x AS (SELECT capture, j, CASE WHEN k % 4 <> 0 THEN cents END AS t FROM e)
SELECT capture, j, coalesce(t < last_value(t IGNORE NULLS) OVER (PARTITION BY capture ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 2000, false) AS seam FROM x""")
def q20(spark, sf):
    rows = events(spark, sf).withColumn("t", F.when(F.col("k") % 4 != 0, F.col("cents")))
    return O.resets(rows, ["capture"], ["j"], "t", 2000).select("capture", "j", "seam")


@query("q21_downsample", """WITH x AS (SELECT o_orderpriority, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, o_orderkey, o_orderdate FROM x WHERE i % greatest(1, n // 600) = 0 OR i = n - 1""")
def q21(spark, sf):
    rows = _t(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    return O.downsample(rows, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 600)


@query("q22_counter_breaks", f"""WITH {E}, x AS (SELECT capture, j, k % 16 AS c, event_type <> 'view' AS p, event_type = 'signup' OR (event_type = 'view' AND k % 2 = 0) AS s FROM e),
g AS (SELECT *, coalesce(sum(CAST(p AS INT)) OVER (PARTITION BY capture ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM x),
y AS (SELECT *, bool_or(s) OVER (PARTITION BY capture, g) AS x FROM g), z AS (SELECT *, lag(c) OVER (PARTITION BY capture ORDER BY j) AS lc FROM y WHERE p)
SELECT capture, j, CAST(lc IS NOT NULL AND c <> (lc + 1) % 16 AND NOT x AS INTEGER) AS cc_break FROM z""")
def q22(spark, sf):
    rows = events(spark, sf).withColumn("c", F.col("k") % 16)
    signalled = (F.col("event_type") == "signup") | ((F.col("event_type") == "view") & (F.col("k") % 2 == 0))
    return O.counter_breaks(rows, ["capture"], ["j"], "c", F.col("event_type") != "view", signalled).select("capture", "j", "cc_break")


@query("q23_rephase_prefix_mod", f"""WITH {E}, x AS (SELECT capture, event_type, j, k % 16 AS a, cents % 16 AS b, k % 2 AS p FROM e),
y AS (SELECT *, coalesce(lag(b) OVER w + p - a, 0) AS st FROM x WINDOW w AS (PARTITION BY capture, event_type ORDER BY j)), z AS (SELECT *, sum(st) OVER (PARTITION BY capture, event_type ORDER BY j ROWS UNBOUNDED PRECEDING) AS t FROM y)
SELECT capture, event_type, j, CAST(((t % 16) + 16) % 16 AS INTEGER) AS "offset" FROM z""")
def q23(spark, sf):
    rows = events(spark, sf).select("capture", "event_type", "j", (F.col("k") % 16).alias("first_cc"), (F.col("cents") % 16).alias("last_cc"), (F.col("k") % 2).alias("payload"))
    return O.rephase(rows, ["capture", "event_type"], "j").select("capture", "event_type", "j", "offset")


@query("q24_kway_merge", f"""WITH {E}, x AS (SELECT capture, j, max(cents) OVER (PARTITION BY capture ORDER BY j ROWS UNBOUNDED PRECEDING) AS m FROM e)
SELECT capture, j, row_number() OVER (ORDER BY m, capture, j) - 1 AS out_pos, coalesce(lag(capture) OVER (ORDER BY m, capture, j) <> capture, false) AS gap_before FROM x""")
def q24(spark, sf):
    return O.kway_merge(events(spark, sf), "capture", "j", F.col("cents")).select("capture", "j", "out_pos", "gap_before")


@query("q25_carrier_dedup", f"WITH {L}, s AS (SELECT *, count(*) OVER (PARTITION BY capture) AS n FROM l), o AS (SELECT h, capture FROM s QUALIFY row_number() OVER (PARTITION BY h ORDER BY n DESC, capture) = 1) SELECT DISTINCT capture FROM o")
def q25(spark, sf):
    rows = lines(spark, sf)
    sizes = rows.groupBy("capture").agg(F.count("*").alias("n"))
    return M.carriers(rows.join(sizes, "capture"), "capture", "n", "h")


@query("q26_duplicate_moments", f"""WITH {E} SELECT capture, event_type, cents // 1000 AS moment, min(j) AS first, max(j) AS last, count(*) AS n FROM e GROUP BY 1, 2, 3 HAVING max(j) - min(j) + 1 > count(*)""")
def q26(spark, sf):
    rows = events(spark, sf).withColumn("moment", F.expr("cents div 1000"))
    return M.duplicate_moments(rows, ["capture"], ["event_type", "moment"], "j")


@query("q27_missing_ranges", """WITH i AS (SELECT o_orderstatus, o_custkey AS lo, o_custkey + o_orderkey % 2 AS hi FROM orders),
r AS (SELECT *, max(hi) OVER (PARTITION BY o_orderstatus ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i) SELECT o_orderstatus, m + 1 AS gap_from, lo - 1 AS gap_to FROM r WHERE lo > m + 1""")
def q27(spark, sf):
    rows = _t(spark, sf, "orders").select("o_orderstatus", F.col("o_custkey").alias("lo"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("hi"))
    return O.missing_ranges(rows, ["o_orderstatus"], "lo", "hi")


@query("q28_source_summary", f"""WITH {E} SELECT capture, count(*) AS n, sum(k)::BIGINT AS frames, count(*) FILTER (WHERE event_type = 'error') AS damaged, count(DISTINCT event_type) AS n_types,
arg_min(cents, j) FILTER (WHERE event_type = 'purchase') AS first_purchase, arg_max(cents, j) FILTER (WHERE event_type = 'purchase') AS last_purchase FROM e GROUP BY capture""")
def q28(spark, sf):
    bought = F.when(F.col("event_type") == "purchase", F.col("j"))
    return events(spark, sf).groupBy("capture").agg(
        F.count("*").alias("n"), F.sum("k").alias("frames"), F.count_if(F.col("event_type") == "error").alias("damaged"), F.count_distinct("event_type").alias("n_types"),
        F.min_by("cents", bought).alias("first_purchase"), F.max_by("cents", bought).alias("last_purchase"),
    )


# --- as-of, range and band joins


@query("q13_asof_nearest", f"""WITH {E}, g AS (SELECT * FROM e WHERE event_type = 'purchase'), a AS (SELECT * FROM e WHERE event_type = 'click'),
m AS (SELECT g.capture, g.us, g.event_id, a.event_id AS click_id, abs(a.us - g.us) AS distance FROM g LEFT JOIN a ON g.capture = a.capture QUALIFY row_number() OVER (PARTITION BY g.capture, g.event_id ORDER BY abs(a.us - g.us), a.us, a.event_id) = 1) SELECT * FROM m""")
def q13(spark, sf):
    e = events(spark, sf)
    bought, clicks = e.where("event_type = 'purchase'").select("capture", "us", "event_id"), e.where("event_type = 'click'").select("capture", "us", F.col("event_id").alias("click_id"))
    return M.asof_nearest(bought, clicks, ["capture"], "us", "click_id")


@query("q14_asof_backward_trunc", f"""WITH {E}, r AS (SELECT capture, j, cents, max(cents) OVER (PARTITION BY capture ORDER BY j ROWS UNBOUNDED PRECEDING) AS m FROM e), p AS (SELECT capture, event_id, cents + 5000 AS target FROM e WHERE event_type = 'error')
SELECT p.capture, p.event_id, p.target, coalesce(max(r.j), 0) AS j FROM p LEFT JOIN r ON p.capture = r.capture AND r.m <= p.target GROUP BY 1, 2, 3""")
def q14(spark, sf):
    e = events(spark, sf)
    probes = e.where("event_type = 'error'").select("capture", "event_id", (F.col("cents") + 5000).alias("target"))
    return M.asof_truncated(probes, e.select("capture", "j", "cents"), ["capture"], "target", "cents", "j")


@query("q15_next_observation", f"""WITH {E}, x AS (SELECT *, min(CASE WHEN event_type = 'view' THEN j END) OVER (PARTITION BY capture ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_j FROM e)
SELECT capture, next_j, count(*) AS errors FROM x WHERE event_type = 'error' AND next_j IS NOT NULL GROUP BY 1, 2""")
def q15(spark, sf):
    found = M.next_observation(events(spark, sf), ["capture"], ["j"], F.col("event_type") == "error", F.col("event_type") == "view", "j", "next_j")
    return found.groupBy("capture", "next_j").agg(F.count("*").alias("errors"))


@query("q16_range_join", f"""WITH {E}, s AS (SELECT capture, j, k, coalesce(sum(k) OVER (PARTITION BY capture ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM e),
p AS (SELECT capture, event_id, cents % 4000 AS frame FROM e WHERE event_type = 'error') SELECT p.capture, p.event_id, p.frame, s.j FROM p JOIN s ON p.capture = s.capture AND s.a <= p.frame AND p.frame < s.a + s.k""")
def q16(spark, sf):
    e = events(spark, sf)
    units = O.prefix_sum(e, ["capture"], ["j"], F.col("k"), "a").where("k > 0").withColumn("b", F.col("a") + F.col("k"))
    points = e.where("event_type = 'error'").select("capture", "event_id", (F.col("cents") % 4000).alias("frame"))
    return M.range_join(points, units, ["capture"], "frame", "a", "b", ["j"])


@query("q17_band_join_priority", f"""WITH {E}, c AS (SELECT capture, j, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS priority FROM e WHERE event_type IN ('purchase', 'signup', 'click') AND k % 4 = 0)
SELECT x.capture, x.j, min(c.priority) AS cause FROM e x LEFT JOIN c ON x.capture = c.capture AND c.j BETWEEN x.j - 5 AND x.j + 5 WHERE x.event_type = 'error' GROUP BY 1, 2""")
def q17(spark, sf):
    e = events(spark, sf)
    rank = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    causes = e.where("event_type in ('purchase', 'signup', 'click') and k % 4 = 0").select("capture", "j", rank.alias("priority"))
    return M.band_causes(e.where("event_type = 'error'").select("capture", "j"), causes, ["capture"], "j")


# --- scalar expressions


@query("q29_tc_parse", f"""WITH {E}, x AS (SELECT event_id, CASE WHEN k % 9 = 0 THEN 'bad' WHEN k % 7 = 0 THEN '01:02:03' ELSE lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(cents % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(j % 60 AS VARCHAR), 2, '0') || (CASE WHEN k % 2 = 0 THEN ';' ELSE ':' END) || lpad(CAST(k % 25 AS VARCHAR), 2, '0') END AS tc FROM e),
p AS (SELECT event_id, tc, string_split(replace(tc, ';', ':'), ':') AS a FROM x)
SELECT event_id, tc, CASE WHEN len(a) = 4 THEN CAST(round((try_cast(a[1] AS INT) * 3600 + try_cast(a[2] AS INT) * 60 + try_cast(a[3] AS INT)) * 1000 + try_cast(a[4] AS INT) * 40) AS BIGINT) END AS ms FROM p""")
def q29(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    full = F.concat(two(F.col("k") % 24), F.lit(":"), two(F.col("cents") % 60), F.lit(":"), two(F.col("j") % 60), F.when(F.col("k") % 2 == 0, ";").otherwise(":"), two(F.col("k") % 25))
    tc = F.when(F.col("k") % 9 == 0, "bad").when(F.col("k") % 7 == 0, "01:02:03").otherwise(full)
    rows = events(spark, sf).select("event_id", tc.alias("tc"))
    return rows.withColumn("ms", F.round(clocks.timecode_seconds(F.col("tc")) * 1000).cast("long"))


@query("q30_rec_parse", """WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d') WHEN event_id % 7 = 0 THEN '2024-02-31 10:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS rec FROM events)
SELECT event_id, CAST(epoch(try_strptime(rec, '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS s, CASE WHEN instr(rec, ' ') > 0 THEN split_part(rec, ' ', 1) ELSE rec END AS day, CASE WHEN instr(rec, ' ') > 0 THEN split_part(rec, ' ', 2) ELSE '?' END AS clock FROM x""")
def q30(spark, sf):
    full = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rec = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 7 == 0, "2024-02-31 10:00:00").otherwise(full)
    rows = _t(spark, sf, "events").select("event_id", rec.alias("rec"))
    r = F.col("rec")
    return rows.select("event_id", F.unix_timestamp(clocks.wall_clock(r)).alias("s"), clocks.date_part(r).alias("day"), clocks.time_part(r).alias("clock"))


@query("q31_header_bits", """WITH x AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_orderkey % 256 AS INT) AS b1, CAST(l_partkey % 256 AS INT) AS b2, CAST(l_suppkey * 7 % 256 AS INT) AS b3, CAST(l_orderkey * 3 % 256 AS INT) AS b4, CAST(l_partkey * 5 % 256 AS INT) AS b5 FROM lineitem)
SELECT DISTINCT b1, b2, b3, b4, b5, ((b1 & 31) << 8) + b2 AS pid, (b1 & 64) <> 0 AS unit_start, (b1 & 128) <> 0 AS tei, (b3 >> 4) & 3 AS afc, ((b3 >> 4) & 3) IN (1, 3) AS has_payload, b3 & 15 AS cc,
CASE WHEN ((b3 >> 4) & 3) = 1 THEN 4 WHEN ((b3 >> 4) & 3) = 3 AND b4 + 5 < 188 THEN b4 + 5 END AS payload_start, ((b3 >> 4) & 3) >= 2 AND b4 > 0 AND (b5 & 128) <> 0 AS disc FROM x""")
def q31(spark, sf):
    byte = lambda c, f=1: (F.col(c) * f % 256).cast("int")
    rows = _t(spark, sf, "lineitem").select(byte("l_orderkey").alias("b1"), byte("l_partkey").alias("b2"), byte("l_suppkey", 7).alias("b3"), byte("l_orderkey", 3).alias("b4"), byte("l_partkey", 5).alias("b5")).distinct()
    b1, b2, b3, b4, b5 = (F.col(f"b{k}") for k in range(1, 6))
    return rows.select(
        "*", bits.pid(b1, b2).alias("pid"), bits.unit_start(b1).alias("unit_start"), bits.transport_error(b1).alias("tei"), bits.adaptation(b3).alias("afc"), bits.has_payload(b3).alias("has_payload"),
        bits.counter(b3).alias("cc"), bits.payload_start(b3, b4).alias("payload_start"), bits.discontinuity(b3, b4, b5).alias("disc"),
    )


@query("q32_bcd", "SELECT DISTINCT CAST(l_partkey % 256 AS INTEGER) AS b, CAST((l_partkey % 256) & 15 AS INTEGER) + CAST(((l_partkey % 256) >> 4) & 15 AS INTEGER) * 10 AS v FROM lineitem")
def q32(spark, sf):
    b = (F.col("l_partkey") % 256).cast("int")
    return _t(spark, sf, "lineitem").select(b.alias("b")).distinct().withColumn("v", bits.bcd(F.col("b")))


LOG = "CASE event_id % 7 WHEN 0 THEN '[mpeg2video] ac-tex damaged at 22 17' WHEN 1 THEN '[mpegts] Packet corrupt (stream = 0)' WHEN 2 THEN '[Parsed_showinfo_0] n:12 pts_time:' || CAST(event_id AS {text}) || '.5' WHEN 3 THEN 'concealing 36 DC errors' WHEN 4 THEN 'MVs not available, invalid' WHEN 5 THEN '[null] non monotonically increasing dts, invalid' ELSE 'Press q to stop' END"


@query("q33_log_classify", f"""WITH x AS (SELECT event_id, {LOG.format(text="VARCHAR")} AS line FROM events) SELECT event_id, CASE WHEN regexp_matches(line, '{text.FRAME_LINE}') THEN 'frame'
WHEN line LIKE '%showinfo%' OR line LIKE '%{text.HARMLESS_LINE}%' OR NOT regexp_matches(line, '{text.ERROR_LINE}') THEN 'other' WHEN regexp_matches(line, '{text.CONTAINER_LINE}') THEN 'container' ELSE 'error' END AS kind,
CAST(round_even(try_cast(regexp_extract(line, '{text.FRAME_LINE}', 1) AS DOUBLE) * 90000, 0) AS BIGINT) AS ticks FROM x""")
def q33(spark, sf):
    rows = _t(spark, sf, "events").select("event_id", F.expr(LOG.format(text="STRING")).alias("line"))
    return rows.select("event_id", text.log_class(F.col("line")).alias("kind"), text.frame_ticks(F.col("line")).alias("ticks"))


@query("q34_hms", f"WITH {E}, x AS (SELECT event_id, CAST(floor(cents * k / 25.0) AS BIGINT) AS s FROM e) SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS hms FROM x")
def q34(spark, sf):
    return events(spark, sf).select("event_id", clocks.hms(F.col("cents") * F.col("k")).alias("hms"))


@query("q35_title_lcp", """WITH x AS (SELECT p_brand, p_type, min(p_name) AS a, max(p_name) AS b FROM part GROUP BY 1, 2), y AS (SELECT *, unnest(generate_series(0, least(length(a), length(b)))) AS n FROM x)
SELECT p_brand, p_type, a[1:max(n)] AS title FROM y WHERE a[1:n] = b[1:n] GROUP BY p_brand, p_type, a""")
def q35(spark, sf):
    spans = _t(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    return spans.select("p_brand", "p_type", text.common_prefix(F.col("a"), F.col("b")).alias("title"))


@query("q46_clock_decode", """WITH x AS (SELECT DISTINCT CAST(l_orderkey % 256 AS BIGINT) AS a, CAST(l_partkey % 256 AS BIGINT) AS b, CAST(l_suppkey % 256 AS BIGINT) AS c FROM lineitem)
SELECT a, b, c, (((a >> 1) & 7) << 30) + (b << 22) + (((c >> 1) & 127) << 15) + (b << 7) + ((a >> 1) & 127) AS pts, ((a << 25) + (b << 17) + (c << 9) + (b << 1) + (a >> 7)) / 90000.0::DOUBLE AS pcr FROM x""")
def q46(spark, sf):
    byte = lambda c: (F.col(c) % 256).cast("int")
    rows = _t(spark, sf, "lineitem").select(byte("l_orderkey").alias("a"), byte("l_partkey").alias("b"), byte("l_suppkey").alias("c")).distinct()
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    wide = [x.cast("long").alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"))]
    return rows.select(*wide, bits.timestamp33(a, b, c, b, a).alias("pts"), bits.clock_seconds(a, b, c, b, a).alias("pcr"))


@query("q51_hash_and_count", "SELECT doc_id, md5(text) AS h, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT) AS n FROM documents")
def q51(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), text.count_substring(F.col("text"), F.lit("th")).alias("n"))


# --- sets, caches, totals


@query("q36_ordered_dedupe", f"WITH {L}, x AS (SELECT *, capture * 1000000 + j AS o FROM l) SELECT h, min(o) AS first FROM x GROUP BY h")
def q36(spark, sf):
    return M.ordered_distinct(lines(spark, sf).withColumn("o", F.col("capture") * 1000000 + F.col("j")), "h", "o")


@query("q37_reconcile", f"""WITH {E}, p AS (SELECT capture, sum(k)::BIGINT AS planned, count(*) FILTER (WHERE event_type = 'error') AS breaks FROM e GROUP BY 1), b AS (SELECT user_id AS capture, sum(CAST(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS built, sum(CAST(event_type = 'error' AS INT))::BIGINT AS found FROM events GROUP BY 1)
SELECT p.capture, planned, built, planned = built AND breaks = found AS same, breaks = 0 AS complete FROM p JOIN b USING (capture)""")
def q37(spark, sf):
    error = F.col("event_type") == "error"
    plan = events(spark, sf).groupBy("capture").agg(F.sum("k").alias("planned"), F.count_if(error).alias("breaks"))
    raw = _t(spark, sf, "events").groupBy(F.col("user_id").alias("capture")).agg(F.sum(F.get_json_object("props", "$.k").cast("int")).alias("built"), F.sum(error.cast("int")).alias("found"))
    return plan.join(raw, "capture").select("capture", "planned", "built", ((F.col("planned") == F.col("built")) & (F.col("breaks") == F.col("found"))).alias("same"), (F.col("breaks") == 0).alias("complete"))


@query("q38_lead_end", f"WITH {E} SELECT capture, j, us AS \"off\", coalesce(lead(us) OVER (PARTITION BY capture ORDER BY us), 1800000000000000) AS \"end\", coalesce(lead(us) OVER (PARTITION BY capture ORDER BY us), 1800000000000000) - us AS nbytes FROM e")
def q38(spark, sf):
    rows = O.lead_end(events(spark, sf).withColumnRenamed("us", "off"), ["capture"], "off", F.lit(1800000000000000))
    return rows.select("capture", "j", "off", "end", (F.col("end") - F.col("off")).alias("nbytes"))


@query("q39_chain_rank", f"""WITH {L}, s AS (SELECT source AS tag, CAST(sum(j) % 97 AS BIGINT) - 40 AS shift FROM l GROUP BY 1), m AS (SELECT tag, shift - min(shift) OVER () AS shift FROM s) SELECT tag, shift, row_number() OVER (ORDER BY shift, tag) - 1 AS chain_pos FROM m""")
def q39(spark, sf):
    shifts = lines(spark, sf).groupBy(F.col("source").alias("tag")).agg((F.sum("j") % 97 - 40).alias("shift"))
    return O.chain_rank(shifts)


@query("q40_work_list", """WITH c AS (SELECT doc_id AS path, md5(text) AS fingerprint, CAST(CASE WHEN doc_id % 5 = 0 THEN 5 ELSE 6 END AS INTEGER) AS v FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id AS path, md5(text) AS fingerprint FROM documents d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = d.doc_id AND c.fingerprint = md5(d.text) AND c.v = 6)""")
def q40(spark, sf):
    found = _t(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("fingerprint"))
    cached = found.where("path % 3 <> 0").withColumn("v", F.when(F.col("path") % 5 == 0, 5).otherwise(6))
    return M.work_list(found.withColumn("v", F.lit(6)), cached, ["path", "fingerprint", "v"]).drop("v")


@query("q41_spot_coalesce", f"""WITH {E}, x AS (SELECT capture, event_type, j, k, j - lag(j) OVER (PARTITION BY capture, event_type ORDER BY j) AS d FROM e),
g AS (SELECT *, sum(CASE WHEN d > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY capture, event_type ORDER BY j ROWS UNBOUNDED PRECEDING)::BIGINT AS spot FROM x) SELECT capture, event_type, spot, min(j) AS j_from, max(j) AS j_to, sum(k)::BIGINT AS total FROM g GROUP BY 1, 2, 3""")
def q41(spark, sf):
    g = O.near_groups(events(spark, sf), ["capture", "event_type"], ["j"], "j", 5, "spot")
    return g.groupBy("capture", "event_type", "spot").agg(F.min("j").alias("j_from"), F.max("j").alias("j_to"), F.sum("k").alias("total"))


@query("q47_seam_check", f"""WITH {L}, n AS (SELECT capture, max(j) AS last FROM l GROUP BY 1), s AS (SELECT capture, lag(capture) OVER (ORDER BY capture) AS prev FROM n)
SELECT s.capture, s.prev, a.h = b.h AS joined FROM s JOIN l a ON a.capture = s.capture AND a.j = 0 JOIN n ON n.capture = s.prev JOIN l b ON b.capture = s.prev AND b.j = n.last WHERE s.prev IS NOT NULL""")
def q47(spark, sf):
    ends = lines(spark, sf).groupBy("capture").agg(F.min_by("h", "j").alias("head"), F.max_by("h", "j").alias("tail"))
    found = O.previous(ends, "capture", ["capture", "tail"])
    return found.where("prev_capture is not null").select("capture", F.col("prev_capture").alias("prev"), (F.col("head") == F.col("prev_tail")).alias("joined"))


@query("q48_output_offsets", f"""WITH {E}, x AS (SELECT capture, j, k * 188 AS nbytes, CASE WHEN event_type = 'signup' AND j > 0 THEN 188 ELSE 0 END AS mark FROM e)
SELECT capture, j, (coalesce(sum(nbytes + mark) OVER (PARTITION BY capture ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + mark)::BIGINT AS out_off FROM x""")
def q48(spark, sf):
    mark = F.when((F.col("event_type") == "signup") & (F.col("j") > 0), 188).otherwise(0)
    rows = O.prefix_sum(events(spark, sf).withColumn("mark", mark), ["capture"], ["j"], F.col("k") * 188 + F.col("mark"), "before")
    return rows.select("capture", "j", (F.col("before") + F.col("mark")).cast("long").alias("out_off"))


@query("q49_loss_totals", f"WITH {E} SELECT event_type, sum(CASE WHEN k % 4 = 0 THEN coalesce(k, 0) ELSE 0 END)::BIGINT AS lost, count(*) FILTER (WHERE coalesce(k, 1) > 50) AS big, coalesce(sum(cents), 0)::BIGINT AS cents FROM e GROUP BY 1")
def q49(spark, sf):
    k = F.coalesce(F.col("k"), F.lit(0))
    return events(spark, sf).groupBy("event_type").agg(F.sum(F.when(k % 4 == 0, k).otherwise(0)).alias("lost"), F.count_if(F.coalesce(F.col("k"), F.lit(1)) > 50).alias("big"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))


@query("q50_probe_window", f"""WITH {E}, p AS (SELECT capture, min(us) + (max(us) - min(us)) // 2 AS target FROM e GROUP BY 1) SELECT p.capture, p.target, arg_min(e.event_id, e.us) AS event_id FROM p JOIN e ON e.capture = p.capture AND e.us >= p.target AND e.us < p.target + 86400000000 WHERE e.event_type = 'view' GROUP BY 1, 2""")
def q50(spark, sf):
    e = events(spark, sf)
    target = F.expr("min(us) + (max(us) - min(us)) div 2")
    probes = e.groupBy("capture").agg(target.alias("target"))
    near = e.where("event_type = 'view'").join(probes, "capture").where("us >= target and us < target + 86400000000")
    return near.groupBy("capture", "target").agg(F.min_by("event_id", "us").alias("event_id"))


@query("q52_not_covered", f"WITH {L} SELECT capture, j, h FROM l WHERE h NOT IN (SELECT h FROM l WHERE capture % 2 = 0)")
def q52(spark, sf):
    rows = lines(spark, sf)
    return rows.select("capture", "j", "h").join(rows.where("capture % 2 = 0").select("h"), "h", "left_anti").select("capture", "j", "h")


# --- whole plans: the alignment over sources, and synthetic captures for what works on bytes


@query("q42_greedy_align", f"""WITH RECURSIVE {L}, r AS (SELECT source AS c, capture * 1000000 + j AS j, h FROM l), u AS (SELECT * FROM r WHERE h IN (SELECT h FROM r GROUP BY h HAVING count(*) <= 4)),
v AS (SELECT p.c AS p, s.c AS s, p.j - s.j AS delta, count(*) AS votes, min(s.j) AS min_j FROM u p JOIN u s ON p.h = s.h AND p.c <> s.c GROUP BY 1, 2, 3), n AS (SELECT c, count(*) AS n FROM r GROUP BY c),
st AS (SELECT [{{'c': min(c), 'shift': 0::BIGINT, 'rank': 0::BIGINT}}] AS placed FROM n
UNION ALL SELECT list_append(placed, (SELECT {{'c': s, 'shift': place, 'rank': len(placed)}} FROM (SELECT v.s, z.x.shift + v.delta AS place, sum(v.votes) AS total, min(ROW(v.min_j, z.x.rank, v.min_j + v.delta)) AS first FROM (SELECT unnest(placed) AS x) z JOIN v ON v.p = z.x.c
WHERE NOT list_contains([y.c FOR y IN placed], v.s) GROUP BY 1, 2) ORDER BY total DESC, s, first LIMIT 1)) FROM st WHERE len(placed) < (SELECT count(*) FROM n) AND placed[-1] IS NOT NULL),
last AS (SELECT [y FOR y IN placed IF y IS NOT NULL] AS placed FROM st ORDER BY len(placed) DESC LIMIT 1), f AS (SELECT x.c AS c, x.shift AS shift FROM (SELECT unnest(placed) AS x FROM last)),
rest AS (SELECT c, (SELECT max(shift + n) FROM f JOIN n USING (c)) + coalesce(sum(n) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM n WHERE c NOT IN (SELECT c FROM f)),
a AS (SELECT * FROM f UNION ALL SELECT * FROM rest) SELECT c AS capture, shift - min(shift) OVER () AS shift, CAST(row_number() OVER (ORDER BY shift, c) - 1 AS INTEGER) AS chain_pos FROM a""")
def q42(spark, sf):
    from strandweave.plans.align import align

    rows = lines(spark, sf).select(F.col("source").alias("capture"), (F.col("capture") * 1000000 + F.col("j")).alias("j"), "h")
    found = align(rows)
    return spark.createDataFrame([(t, int(found.shifts[t]), k) for k, t in enumerate(found.chain)], "capture string, shift long, chain_pos int")


LENGTH, STEP = 400, 250  # units of a capture, and from one capture's start to the next


def tapes(n: int) -> dict[str, tuple[int, int]]:
    """Captures of a tape that is 900 units long and one more for every twenty of n: first and last + 1 unit."""
    total = 900 + n // 20
    return {f"c{k:06d}": (k * STEP, min(k * STEP + LENGTH, total)) for k in range(1 + max(0, -(-(total - LENGTH) // STEP)))}


def synthetic_captures(spark: SparkSession, sf: str) -> list[str]:
    """Damaged captures of one tape, in the shared folder; as many as the events are numerous, each rendered by a task."""
    import uuid

    from strandweave.session import shared_dir, ship

    ship(spark)
    top = f"{shared_dir(spark)}/strandweave/{spark.sparkContext.applicationId}/captures-{uuid.uuid4().hex}"
    found = tapes(_t(spark, sf, "events").count())
    last = max(found)

    def render(batches):
        from pyarrow import fs

        from strandweave.sources.synthetic import Tape

        for batch in batches:
            for name, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, folder = fs.FileSystem.from_uri(top)
                system.create_dir(folder, recursive=True)
                # A break of the counter, a copy that differs and units that are not there, where the next capture has them.
                tape = Tape(a, b, {a + 300: "cc", a + 320: "corrupt"}, (a + 340, a + 341)) if name != last else Tape(a, b)
                with system.open_output_stream(f"{folder}/{name}.m2t") as f:
                    f.write(tape.render())
            yield batch

    rows = spark.createDataFrame([(name, a, b) for name, (a, b) in found.items()], "name string, a long, b long")
    rows.repartition(len(found), "name").mapInArrow(render, "name string, a long, b long").count()
    return [f"{top}/{name}.m2t" for name in found]


#: The same captures in SQL: capture, place on the tape, number within the capture, and whether its copy differs. A unit's
#: packet begins with bytes that end the unit before: that one has the counter's break, and a capture's last unit lacks them.
T = f"""total AS (SELECT 900 + count(*) // 20 AS t FROM events), k AS (SELECT t, unnest(range(0, 1 + greatest(0, CAST(ceil((t - {LENGTH}) / {STEP}.0) AS BIGINT)))) AS k FROM total),
tape AS (SELECT k, max(k) OVER () AS last, 'c' || lpad(CAST(k AS VARCHAR), 6, '0') AS tag, k * {STEP} AS a, unnest(range(k * {STEP}, least(k * {STEP} + {LENGTH}, t))) AS p FROM k),
units AS (SELECT tag, a, p, k < last AND p - a = 320 AS corrupt, k < last AND p - a = 299 AS jump, row_number() OVER (PARTITION BY tag ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY tag) AS n FROM tape WHERE k = last OR p - a NOT IN (340, 341))"""


@query("q43_plan")
def q43(spark, sf):
    from strandweave.plans.merge_plan import build_plan
    from strandweave.sources.captures import scan, units

    plan = build_plan(units(scan(spark, synthetic_captures(spark, sf))))
    rows = [(k, s.tag, s.j0, s.j1, s.ngops, s.nbytes, s.frame0, s.gap_before) for k, s in enumerate(plan.segments)]
    return spark.createDataFrame(rows, "seg_idx int, tag string, j0 int, j1 int, ngops int, nbytes long, frame0 long, gap_before boolean")


@query("q44_scan", f"""WITH {T}, c AS (SELECT p, corrupt, i = n - 1 AS cut, count(*) AS copies FROM units GROUP BY 1, 2, 3)
SELECT tag, CAST(i AS INTEGER) AS i, i * 752 + 564 AS off, CASE WHEN i = n - 1 THEN n * 752 ELSE (i + 1) * 752 + 564 END AS "end", CAST(CASE WHEN i = n - 1 THEN 188 ELSE 752 END AS BIGINT) AS nbytes, CAST(4 AS INTEGER) AS npic,
CAST(1 AS INTEGER) AS closed, CAST(0 AS INTEGER) AS broken, CAST(NULL AS BIGINT) AS pts, copies, CAST(jump AS INTEGER) AS cc, CAST(0 AS INTEGER) AS tei, CAST(0 AS INTEGER) AS dec,
strftime(TIMESTAMP '2007-01-01 09:00:00' + to_seconds(units.p), '%Y-%m-%d %H:%M:%S') AS rec, strftime(TIMESTAMP '2007-01-01 00:00:00' + to_seconds(units.p), '00:%M:%S:') || lpad(CAST(units.p % 25 AS VARCHAR), 2, '0') AS tc
FROM units JOIN c ON units.p = c.p AND units.corrupt = c.corrupt AND (i = n - 1) = cut""")
def q44(spark, sf):
    from strandweave.session import written
    from strandweave.sources.captures import scan, units

    rows = written(units(scan(spark, synthetic_captures(spark, sf))), "units")
    copies = rows.groupBy("h").agg(F.count("*").alias("copies"))
    return rows.join(copies, "h").select("tag", "i", "off", "end", "nbytes", "npic", "closed", "broken", "pts", "copies", "cc", "tei", "dec", "rec", "tc")


@query("q45_build_verify")
def q45(spark, sf):
    from strandweave.plans.build import build
    from strandweave.plans.merge_plan import build_plan
    from strandweave.plans.verify import verify_build
    from strandweave.sources.captures import scan, units

    paths = synthetic_captures(spark, sf)
    plan = build_plan(units(scan(spark, paths)))
    # Beside the captures, where all executors can write.
    to = f"{paths[0].rsplit('/', 1)[0]}/merged.out"
    size = build(spark, plan, to)
    ok, info = verify_build(spark, to, plan)
    return spark.createDataFrame([(ok, size, info["cc"], info["expected_cc"], info["rec_head"], info["rec_tail"])], "ok boolean, size long, cc int, expected_cc int, rec_head string, rec_tail string")


@query("q53_packet_filter", f"WITH {T} SELECT tag || '.m2t' AS capture, count(*) AS packets, count(*) AS starts, count(*) AS rewritten, CAST(sum(jump) AS BIGINT) AS jumps FROM units GROUP BY tag")
def q53(spark, sf):
    from strandweave.sources.captures import packets

    rows = packets(spark, synthetic_captures(spark, sf), 2000)
    video = rows.where(F.col("pid") == 0x200)
    start = bits.payload_start(bits.byte_at(F.col("packet"), 3), bits.byte_at(F.col("packet"), 4))
    name = F.element_at(F.split("path", "/"), -1)
    again = bits.with_counter(F.col("packet"), F.col("cc") + 1)
    # What the rewrite leaves: the counter is one up, and nothing else has changed.
    right = (F.length(again) == 188) & (F.col("cc") + 1 - 16 * (F.col("cc") == 15).cast("int") == bits.byte_at(again, 3).bitwiseAND(15)) & (F.overlay(again, F.substring("packet", 4, 1), 4) == F.col("packet"))
    order = W.partitionBy("path").orderBy("off")
    jump = F.pmod(F.col("cc") - F.lag("cc").over(order) - 1, F.lit(16)) != 0
    kept = video.where(start.isNotNull()).withColumn("again", again).withColumn("_right", right).withColumn("_jump", F.coalesce(jump, F.lit(False)))
    return kept.groupBy(name.alias("capture")).agg(F.count("*").alias("packets"), F.count_if("unit_start").alias("starts"), F.count_if("_right").alias("rewritten"), F.count_if("_jump").alias("jumps"))
