"""Queries of online regressions, volatilities of errors, and of streams that keep state: positions, late rows, parameters by period."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import adapting as A
from tickloom.operators import bars as B
from tickloom.operators import pairs as P
from tickloom.plans import fixtures as X
from tickloom.plans.catalog import query, rounded
from tickloom.plans.runs import landing
from tickloom.plans.signals import HEDGE, S
from tickloom.sources import runs as R
from tickloom.sources import tables as T
from tickloom.streaming import kalman as N
from tickloom.streaming import ticks as K

CUT = "2024-01-11"
PARAMS = N.Params(window=48)


def filter_sql(source: str, window: int) -> str:
    """kf: an online regression over a table (pair, k from 1, ts, y, x), a row for each bar with what was known before it; for WITH RECURSIVE."""
    within = lambda v: f"greatest(1e-10, least(1e6, {v}))"
    gain = lambda v: f"greatest(-1, least(1, {v}))"
    return f"""kf AS (
  SELECT DISTINCT pair, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS z, NULL::DOUBLE AS beta, NULL::DOUBLE AS alpha, NULL::DOUBLE AS innovation, NULL::DOUBLE AS vol, NULL::DOUBLE AS gain,
    1.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, []::DOUBLE[] AS errors FROM {source}
  UNION ALL SELECT pair, k, ts, CASE WHEN len(errors) >= {window} AND gain <= 0.3 THEN e / vol * least(1, 0.5 / p00) END, x0, x1, e, vol, gain, x0 + k0 * e, x1 + k1 * e,
    {within('m00 * (1 - k0 * x) - m01 * k0 + r * k0 * k0')}, {within('-m00 * k1 * x + m01 * (1 - k1) + r * k0 * k1')}, {within('-m10 * k1 * x + m11 * (1 - k1) + r * k1 * k1')}, list_append(errors, e)[-{window}:]
  FROM (SELECT *, (1 - k0 * x) * a00 - k0 * a01 AS m00, (1 - k0 * x) * a01 - k0 * a11 AS m01, -k1 * x * a00 + (1 - k1) * a01 AS m10, -k1 * x * a01 + (1 - k1) * a11 AS m11 FROM (
    SELECT *, {gain('(a00 * x + a01) / s')} AS k0, {gain('(a01 * x + a11) / s')} AS k1 FROM (
      SELECT *, x * (a00 * x + a01) + a01 * x + a11 + r AS s FROM (
        SELECT b.pair, b.k, b.ts, b.x, kf.x0, kf.x1, kf.p00, kf.errors, 0.01::DOUBLE AS r, b.y - (b.x * kf.x0 + kf.x1) AS e, {within('kf.p00 + 1e-6 / 100')} AS a00, {within('kf.p01')} AS a01, {within('kf.p11 + 1e-6')} AS a11,
          abs(kf.p00 * b.x + kf.p01) / (b.x * (kf.p00 * b.x + kf.p01) + kf.p01 * b.x + kf.p11 + 0.01) AS gain,
          CASE WHEN coalesce(list_aggregate(kf.errors, 'stddev_pop'), 0) > 1e-8 THEN list_aggregate(kf.errors, 'stddev_pop') ELSE 0.01 END AS vol
        FROM kf JOIN {source} b ON b.pair = kf.pair AND b.k = kf.k + 1)))))"""


#: The filter over the end of the training part of each pair (three half-lives, 7 to 45 days) and all bars after it.
WARM = f"""{HEDGE}, tr AS (SELECT pair, spread, lag(spread) OVER (PARTITION BY pair ORDER BY ts) AS b FROM sp),
 hl AS (SELECT pair, regr_slope(spread - b, b) AS s FROM tr WHERE b IS NOT NULL GROUP BY pair),
 dl AS (SELECT pair, greatest(7, least(45, floor(least(CASE WHEN s < -1e-10 THEN -ln(2) / s ELSE 'inf'::DOUBLE END, 1e9) / 24 * 3)))::INT AS d FROM hl),
 tb AS (SELECT p.*, d, max(p.ts) FILTER (p.ts < TIMESTAMP '{CUT}') OVER (PARTITION BY p.pair) AS last FROM pair_bars p JOIN dl USING (pair)),
 tw AS (SELECT *, count(*) FILTER (ts < TIMESTAMP '{CUT}' AND ts >= last - to_days(d)) OVER (PARTITION BY pair) AS n FROM tb),
 wb AS (SELECT pair, ts, y, x, row_number() OVER (PARTITION BY pair ORDER BY ts) AS k FROM tw WHERE ts >= TIMESTAMP '{CUT}' OR ts >= last - to_days(d) OR n < 100),
 {filter_sql('wb', 48)},
 sane AS (SELECT pair FROM (SELECT pair, arg_max(x0, k) AS x0, arg_max(p00, k) AS p00 FROM kf WHERE ts < TIMESTAMP '{CUT}' GROUP BY pair) WHERE abs(x0) BETWEEN 0.01 AND 50 AND p00 <= 5)
SELECT pair, ts, round(z, 4) + 0.0 AS z, round(beta, 4) + 0.0 AS beta, round(alpha, 4) + 0.0 AS alpha, round(innovation, 4) + 0.0 AS innovation, round(vol, 4) + 0.0 AS vol, round(gain, 4) + 0.0 AS gain FROM kf JOIN sane USING (pair) WHERE ts >= TIMESTAMP '{CUT}'"""


def cut_bars(spark, sf):
    """(bars before the cut, bars from it on, half-lives)."""
    p = X.pair_bars(spark, sf)
    at = F.lit(CUT).cast("timestamp_ntz")
    return p.where(F.col("ts") < at), p.where(F.col("ts") >= at), P.half_life(P.with_spread(p, P.hedge(p).drop("n")))


@query(f"WITH RECURSIVE {WARM}")
def kalman_signals(spark, sf):
    """M1, M2, M3: online hedge ratios and z-scores of all pairs, warmed up on the end of the days before."""
    before, after, lives = cut_bars(spark, sf)
    return rounded(N.filtered(after, PARAMS, N.warm_states(before, PARAMS, lives)), 4)


@query(f"WITH RECURSIVE {WARM}")
def warm_states(spark, sf):
    """States of the online regression, saved and loaded; signals go on from there."""
    path = R.new_folder(spark)
    before, after, lives = cut_bars(spark, sf)
    R.save_states(N.warm_states(before, PARAMS, lives), path)
    return rounded(N.filtered(after, PARAMS, R.load_states(spark, path)), 4)


@query(f"""WITH RECURSIVE {HEDGE}, o AS (SELECT p.pair, row_number() OVER (PARTITION BY p.pair ORDER BY ts) AS k, y, x, h.beta AS b0 FROM pair_bars p JOIN h USING (pair)),
 f AS (SELECT pair, 0::BIGINT AS k, beta AS b, 0.0::DOUBLE AS a, 1.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 1.0::DOUBLE AS p11, NULL::DOUBLE AS e FROM h
  UNION ALL SELECT pair, k, b + h0 / s * u, a + h1 / s * u, q00 - h0 * h0 / s, p01 - h0 * h1 / s, q11 - h1 * h1 / s, y - (b + h0 / s * u) * x - (a + h1 / s * u) FROM (
    SELECT *, x * h0 + h1 + 0.01 AS s FROM (SELECT *, q00 * x + p01 AS h0, p01 * x + q11 AS h1 FROM (
      SELECT o.pair, o.k, o.x, o.y, f.b, f.a, f.p01, f.p00 + 1e-6 AS q00, f.p11 + 1e-6 AS q11, o.y - f.b * o.x - f.a AS u FROM f JOIN o ON o.pair = f.pair AND o.k = f.k + 1)))),
 l AS (SELECT pair, k, b, e, lag(e) OVER (PARTITION BY pair ORDER BY k) AS e1 FROM f WHERE k > 0),
 g AS (SELECT pair, count(*) AS n, arg_max(b, k) AS kb, regr_slope(e - e1, e1) AS slope FROM l GROUP BY pair)
SELECT pair, g.n, round(kb, 4) + 0.0 AS kalman_beta, round(abs(kb - beta) / (CASE WHEN abs(beta) > 1e-6 THEN abs(beta) ELSE 1 END), 3) + 0.0 AS divergence, round(CASE WHEN slope < -1e-10 THEN -ln(2) / slope ELSE 'inf'::DOUBLE END, 4) + 0.0 AS half_life FROM g JOIN h USING (pair)""")
def kalman_spread(spark, sf):
    """Where the online ratio ends, how far from the fixed one, and how fast its spread reverts."""
    p = X.pair_bars(spark, sf)
    out = N.spread_check(p, P.hedge(p))
    return out.select("pair", "n", (F.round("kalman_beta", 4) + 0.0).alias("kalman_beta"), (F.round("divergence", 3) + 0.0).alias("divergence"), (F.round("half_life", 4) + 0.0).alias("half_life"))


@query()
def kalman_stationarity(spark, sf):
    """Whether what the online regression leaves over is stationary and its ratio stays near the fixed one, with the reason if not."""
    p = X.pair_bars(spark, sf)
    return N.spread_check(p, P.hedge(p))


STEPS = f"{S}, d AS (SELECT pair, ts, spread - lag(spread) OVER (PARTITION BY pair ORDER BY ts) AS e FROM signals), l AS (SELECT pair, ts, list(e) OVER (PARTITION BY pair ORDER BY ts ROWS 47 PRECEDING) AS l FROM d), v AS (SELECT pair, ts, list_filter(l, lambda x: x IS NOT NULL) AS l FROM l)"


def steps(spark, sf):
    s = X.signals(spark, sf)
    return s.select("pair", "ts", (F.col("spread") - F.lag("spread").over(Window.partitionBy("pair").orderBy("ts"))).alias("e"))


@query(f"""WITH {STEPS} SELECT pair, ts, round(CASE WHEN len(l) > 0 THEN sqrt(list_reduce(list_prepend(0.0, l), lambda a, x: 0.2 * x * x + 0.8 * a)) END, 6) + 0.0 AS vol FROM v""")
def ewma_vol(spark, sf):
    """2.M, M3: the volatility of a pair's last errors, the later the heavier."""
    return rounded(steps(spark, sf).select("pair", "ts", B.ewma_vol("e", 48, 0.2).alias("vol")))


@query(f"""WITH {STEPS} SELECT pair, ts, round(CASE WHEN len(l) > 0 THEN list_aggregate(l, 'mad') * 1.4826 END, 6) + 0.0 AS vol FROM v""")
def mad_vol(spark, sf):
    """2.M, M3: the volatility of a pair's last errors by their median distance from the median."""
    return rounded(steps(spark, sf).select("pair", "ts", B.mad_vol("e", 48, 1.4826).alias("vol")))


#: Ticks that decisions are made on, and the rules.
TICKS = "o AS (SELECT event_type AS pair, ts, (value - 50) / 15 AS z, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS k FROM events)"
RULES = K.Rules(entry=1.5, leave=0.5, stop=3.0, hours=2)
#: Ticks in a batch.
BATCH = 8_000_000


@query(f"""WITH RECURSIVE {TICKS},
 f AS (SELECT DISTINCT pair, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS z, NULL::VARCHAR AS action, NULL::TIMESTAMP AS since, NULL::TIMESTAMP AS timed FROM o
  UNION ALL SELECT pair, k, ts, z, action, CASE WHEN action = 'enter' THEN ts WHEN action IN ('stop', 'exit') THEN NULL ELSE held END, timed FROM (
   SELECT *, CASE WHEN held IS NOT NULL AND abs(z) > 3 THEN 'stop' WHEN held IS NOT NULL AND abs(z) < 0.5 THEN 'exit' WHEN held IS NULL AND abs(z) > 1.5 AND abs(z) <= 3 THEN 'enter' ELSE 'hold' END AS action FROM (
    SELECT o.pair, o.k, o.ts, o.z, CASE WHEN f.since + INTERVAL 2 HOUR <= o.ts THEN f.since + INTERVAL 2 HOUR END AS timed, CASE WHEN f.since + INTERVAL 2 HOUR > o.ts THEN f.since END AS held FROM f JOIN o ON o.pair = f.pair AND o.k = f.k + 1))),
 e AS (SELECT pair, arg_max(struct_pack(s := since), k).s AS since FROM f GROUP BY pair)
SELECT pair, ts, round(z, 6) + 0.0 AS z, action FROM f WHERE k > 0 UNION ALL SELECT pair, timed, NULL, 'time' FROM f WHERE timed IS NOT NULL
UNION ALL SELECT pair, since + INTERVAL 2 HOUR, NULL, 'time' FROM e WHERE since + INTERVAL 2 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_decisions(spark, sf):
    """M5: what a live bot would do at each tick, by the positions that its own decisions have opened; no order is placed."""
    s = X.table(spark, sf, "events").select(F.col("event_type").alias("pair"), F.col("ts").cast("timestamp").alias("ts"), ((F.col("value") - 50) / 15).alias("z"))
    path = R.new_folder(spark)
    K.delivered(K.in_order(s, BATCH), path, lambda src: landing(K.live_decisions(src, RULES, "1 hour"), path))
    return rounded(spark.read.schema(K.ACTIONS).parquet(f"{path}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


ARRIVE = "a AS (SELECT event_id, event_type AS symbol, ts, value, event_id % 7 = 0 AS last FROM events), m AS (SELECT max(ts) - INTERVAL 5 DAY AS t FROM a WHERE NOT last)"


@query(f"""WITH {ARRIVE} SELECT event_id, symbol, ts, round(value, 6) + 0.0 AS value, coalesce(last AND ts < (SELECT t FROM m), false) AS late FROM a""")
def stream_late(spark, sf):
    """M7: rows that come twice stay once; those that come days behind go to a table of their own, merged by key and month."""
    path, e = R.new_folder(spark), X.table(spark, sf, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    first = e.where("event_id % 7 <> 0")
    parts = (first, e.where("event_id % 7 = 0").unionByName(first.where("event_id % 3 = 0")))  # a seventh comes last, with copies of rows that came before
    K.delivered(parts, path, lambda src: K.each_batch(src, K.late_aside(path, ["event_id"], 5), f"{path}/checkpoint"))
    return rounded(both_tables(spark, path, e.schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def both_tables(spark, path, schema):
    """On-time and late rows of `late_aside` together."""
    got = spark.read.schema(schema).parquet(f"{path}/on_time/*").withColumn("late", F.lit(False))
    if not R.has_files(spark, f"{path}/late"):
        return got
    late = spark.read.schema(schema).parquet(f"{path}/late").drop("month").withColumn("late", F.lit(True))
    return got.unionByName(late.join(got.select("event_id"), "event_id", "left_anti"))


@query("""SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL""")
def upsert_months(spark, sf):
    """Two deliveries put into a table by month; of rows with the same key the last to arrive stays, and untouched months keep their files."""
    path = R.new_folder(spark)
    e = X.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value", "event_id")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), e.where("event_id % 2 = 1")):
        T.upsert_by_month(part, path, ["symbol", "ts"], ["event_id"])
    return spark.read.schema(e.schema).parquet(path).drop("month")


TRAIL = f"""{X.TRADES}, pe AS (SELECT DATE '1970-01-01' + (k * 30)::INT AS period_end FROM range(250, 400) t(k)), tp AS (SELECT period_end, net / 1000 + CASE WHEN quarter(exit_ts) % 2 = 1 THEN 1e-5 ELSE -1e-5 END AS net, exit_ts, pair, trade_seq FROM trades JOIN pe ON exit_ts > period_end - INTERVAL 60 DAY AND exit_ts <= period_end),
 c AS (SELECT *, sum(net) OVER (PARTITION BY period_end ORDER BY exit_ts, pair, trade_seq ROWS UNBOUNDED PRECEDING) AS cum FROM tp), d AS (SELECT *, greatest(max(cum) OVER (PARTITION BY period_end ORDER BY exit_ts, pair, trade_seq ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM c),
 s AS (SELECT period_end, count(*) AS n, avg((net > 0)::INT) AS w, max(dd) AS dd, CASE WHEN coalesce(-sum(CASE WHEN net < 0 THEN net END), 0) > 0 THEN coalesce(sum(CASE WHEN net > 0 THEN net END), 0) / -sum(CASE WHEN net < 0 THEN net END) ELSE 99 END AS pf FROM d GROUP BY period_end HAVING count(*) >= 20),
 m AS (SELECT period_end, n, CASE WHEN pf < 1 OR dd > 0.1 THEN 'off' WHEN pf > 1.5 AND w > 0.5 THEN 'on' ELSE 'keep' END AS mode FROM s),
 u AS (SELECT period_end::TIMESTAMP AS period_end, n, mode, round(greatest(1.5, least(3, 2 + 0.1 * CASE mode WHEN 'off' THEN 1 WHEN 'on' THEN -1 ELSE 0 END)), 6) + 0.0 AS entry_z, round(greatest(0.2, least(1, 0.8 - 0.1 * CASE mode WHEN 'off' THEN 1 WHEN 'on' THEN -1 ELSE 0 END)), 6) + 0.0 AS size FROM m)
SELECT period_end, n, mode, entry_z, size FROM u WHERE period_end <= (SELECT max(exit_ts) FROM trades) QUALIFY (entry_z, size) IS DISTINCT FROM lag((entry_z, size)) OVER (ORDER BY period_end)"""


def closed_trades(spark, sf):
    """Trades that are small beside the limits, better in every other quarter."""
    good = F.when(F.quarter("exit_ts") % 2 == 1, 1e-5).otherwise(-1e-5)
    return X.trades(spark, sf, line_tasks(spark, sf)).select("pair", "trade_seq", "exit_ts", (F.col("net") / 1000 + good).alias("net"))


def line_tasks(spark, sf):
    return R.tasks_for(spark, X.table(spark, sf, "lineitem").count())


@query(f"WITH {TRAIL}")
def trailing_parameters(spark, sf):
    """M8: parameters at the end of each month by the trades of the last two, where they change."""
    d = closed_trades(spark, sf)
    ends = A.trailing_parameters(d, 2.0, 0.8, 30, 60, tasks=line_tasks(spark, sf))
    last = d.agg(F.max("exit_ts").alias("last"))
    return rounded(K.changed(ends.crossJoin(F.broadcast(last)).where("period_end <= last").drop("last")))


@query(f"WITH {TRAIL}")
def stream_parameters(spark, sf):
    """M8: the same, from a stream of trades that keeps what the next period needs."""
    path, d = R.new_folder(spark), R.saved(closed_trades(spark, sf))
    years = ("exit_ts < '1994-05-06'", "exit_ts >= '1994-05-06' and exit_ts < '1996-07-08'", "exit_ts >= '1996-07-08'")
    K.delivered([d.where(y) for y in years], path, lambda src: K.each_batch(src, K.parameter_updates(path, 2.0, 0.8, 30, 60), f"{path}/checkpoint"))
    return rounded(spark.read.parquet(f"{path}/out/*"))


@query("""WITH closes AS (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_max(value, ts) AS close FROM events GROUP BY ALL), g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM closes GROUP BY symbol)
SELECT symbol, ts, round(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS close, close IS NULL AS filled FROM g LEFT JOIN closes USING (symbol, ts)""")
def gap_fill(spark, sf):
    """2.M: a table function by series, equal to a join with the grid."""
    return rounded(B.gap_filled(X.closes(spark, sf), 3600))
