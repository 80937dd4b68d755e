"""Queries of scans, trades as intervals, and runs over walk-forward windows, with those that learn from window to window."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tickloom.operators import feedback as FB
from tickloom.operators import ledger as L
from tickloom.operators import screening as S
from tickloom.operators import walkforward as W
from tickloom.operators.intervals import interval_trades
from tickloom.plans import fixtures as X
from tickloom.plans.catalog import query, rounded
from tickloom.plans.sources_joins import asof_funding
from tickloom.sources.runs import new_folder, saved

#: Limits of the queries: the tables' pairs revert within hours, and no two series are close.
LIMITS = S.Limits(max_p=1.0, min_vol=0.002, max_z=2.5, min_half_life=0.0, max_half_life=720.0)
CORR, RATIO = 0.03, 0.8
#: Windows of the runs, in days: training, test, step. When symbols and pairs drop out of the run with feedback.
DAYS = (6, 2, 2)
RULES = FB.Rules(min_trades=1.0, min_windows=3, worst_avg=-0.15, worst_stops=0.1, max_cost=0.003, max_stops=0.3)


def prices(spark, sf):
    return X.bars(spark, sf).where("px > 0").select("ts", "symbol", F.log("px").alias("lp"))


def trades_sql(source: str, keys: str, most_hold: int = 48, stop: float = 0.5) -> str:
    """Names ending in taken (keys, i) and led (the trades) of a table of signals; for WITH RECURSIVE."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda t: ", ".join(f"{t}.{k}" for k in keys.split(", "))
    return f"""nb AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS i, lead(ts) OVER (PARTITION BY {keys} ORDER BY ts) IS NULL AS last FROM {source}),
 en AS (SELECT * FROM nb WHERE entry_mask AND NOT last AND y IS NOT NULL AND x IS NOT NULL AND beta IS NOT NULL AND z IS NOT NULL),
 st AS (SELECT {of('e')}, e.i, e.ts AS entry_ts, e.beta, CASE WHEN e.z > 0 THEN -1 ELSE 1 END AS dir, b.i - e.i AS hold, b.ts AS exit_ts, b.last, b.exit_mask,
   (CASE WHEN e.z > 0 THEN -1 ELSE 1 END) / (1 + abs(e.beta)) * ((b.y - e.y) - e.beta * (b.x - e.x)) AS gross FROM en e JOIN nb b ON {same('e', 'b')} AND b.i > e.i AND b.i <= e.i + {most_hold}),
 sr AS (SELECT *, CASE WHEN gross <= -{stop} THEN 3 WHEN hold >= {most_hold} THEN 2 WHEN last THEN 4 WHEN exit_mask THEN 1 END AS reason FROM st),
 ca AS (SELECT *, row_number() OVER (PARTITION BY {keys}, i ORDER BY hold) AS nth FROM sr WHERE reason IS NOT NULL),
 cand AS (SELECT * FROM ca WHERE nth = 1),
 taken AS (SELECT {keys}, min(i) AS i FROM cand GROUP BY {keys} UNION ALL
   SELECT {of('t')}, min(c.i) FROM taken t JOIN cand d ON {same('t', 'd')} AND t.i = d.i JOIN cand c ON {same('t', 'c')} AND c.i > d.i + d.hold GROUP BY {of('t')}),
 led AS (SELECT {of('c')}, c.entry_ts, c.exit_ts, c.dir, c.hold, c.reason, c.gross, 2 * 5e-4::DOUBLE AS fees, 2 * 5e-4::DOUBLE AS slippage, c.gross - 4 * 5e-4::DOUBLE AS net FROM taken t JOIN cand c ON {same('t', 'c')} AND t.i = c.i)"""


def scan_sql(train_only: bool) -> str:
    """wp (prices in their windows), pb (bars of candidates) and ranked (both directions with their gates, the better one first); needs lp and windows."""
    by = "window_id, pair, direction"
    return f"""wp AS (SELECT window_id, ts, symbol, lp, ts < train_end AS tr FROM lp JOIN windows ON ts >= train_start AND ts < {'train_end' if train_only else 'test_end'}),
 cc AS (SELECT a.window_id, a.symbol AS coin_y, b.symbol AS coin_x FROM wp a JOIN wp b ON a.window_id = b.window_id AND a.ts = b.ts AND a.symbol < b.symbol WHERE a.tr GROUP BY ALL HAVING count(*) >= 3 AND abs(corr(a.lp, b.lp)) >= {CORR}),
 pb AS (SELECT cc.window_id, coin_y || '-' || coin_x AS pair, a.ts, a.tr, a.lp AS y, b.lp AS x FROM cc JOIN wp a ON a.window_id = cc.window_id AND a.symbol = coin_y JOIN wp b ON b.window_id = cc.window_id AND b.symbol = coin_x AND b.ts = a.ts),
 sd AS (SELECT window_id, pair, 'y~x' AS direction, ts, y, x FROM pb WHERE tr UNION ALL SELECT window_id, pair, 'x~y', ts, x, y FROM pb WHERE tr),
 sn AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM sd),
 sx AS (SELECT *, rn <= greatest(2, least(floor(n * {RATIO}), n - 2)) AS train FROM sn),
 sb AS (SELECT {by}, regr_slope(y, x) AS beta FROM sx WHERE train GROUP BY ALL),
 ss AS (SELECT sx.*, beta, y - beta * x AS spread FROM sx JOIN sb USING ({by})),
 sm AS (SELECT {by}, avg(spread) AS mean, stddev_samp(spread) AS vol FROM ss WHERE train GROUP BY ALL),
 se AS (SELECT ss.*, vol, spread - mean AS e, lag(spread - mean) OVER (PARTITION BY {by} ORDER BY ts) AS e1 FROM ss JOIN sm USING ({by})),
 sg AS (SELECT {by}, count(*) AS n, any_value(beta) AS hedge_ratio, any_value(vol) AS spread_vol, regr_slope(e - e1, e1) FILTER (train AND e1 IS NOT NULL) AS slope, max(abs(e)) FILTER (NOT train) / any_value(vol) AS max_z,
   arg_max(e, ts) / any_value(vol) AS current_z, count(e1) FILTER (train) AS k, sum(e1 * e1) FILTER (train) AS q, sum(e1 * (e - e1)) FILTER (train) AS c, sum((e - e1) * (e - e1)) FILTER (train) AS d FROM se GROUP BY ALL),
 sh AS (SELECT {by}, n, hedge_ratio, spread_vol, CASE WHEN slope < -1e-10 THEN -ln(2) / slope ELSE 'inf'::DOUBLE END AS half_life, max_z, current_z, c / q / sqrt((d - c / q * c) / (k - 1) / q) AS df FROM sg),
 sr0 AS (SELECT *, CASE WHEN spread_vol < {LIMITS.min_vol} THEN 'volatility' WHEN max_z > {LIMITS.max_z} THEN 'drift' WHEN NOT half_life BETWEEN {LIMITS.min_half_life} AND {LIMITS.max_half_life} THEN 'half_life' END AS reason FROM sh),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY window_id, pair ORDER BY reason IS NOT NULL, direction = 'x~y') AS nth FROM sr0)"""


BASE = f"{X.BARS}, lp AS (SELECT ts, symbol, ln(px) AS lp FROM bars WHERE px > 0), {X.windows_sql(*DAYS)}"
#: Signals of the pairs that pass, in their test parts.
RUN = f"""{BASE}, {scan_sql(False)},
 ob AS (SELECT pb.window_id, pb.pair, ts, tr, CASE WHEN direction = 'x~y' THEN x ELSE y END AS y, CASE WHEN direction = 'x~y' THEN y ELSE x END AS x, hedge_ratio AS beta FROM pb JOIN ranked ON ranked.window_id = pb.window_id AND ranked.pair = pb.pair AND nth = 1 AND reason IS NULL),
 oz AS (SELECT *, y - beta * x AS spread, count(*) OVER w AS m, stddev_samp(y - beta * x) OVER w AS sd, avg(y - beta * x) OVER w AS av FROM ob WINDOW w AS (PARTITION BY window_id, pair ORDER BY ts ROWS 23 PRECEDING)),
 sig AS (SELECT window_id, pair, ts, y, x, beta, z, coalesce(abs(z) > 1.5, false) AS entry_mask, coalesce(abs(z) < 0.5, false) AS exit_mask FROM (SELECT *, CASE WHEN m >= 24 AND sd > 1e-9 THEN (spread - av) / sd END AS z FROM oz WHERE NOT tr)),
 {trades_sql('sig', 'window_id, pair')}"""


def run_spreads(spark, sf):
    return W.picked_spreads(prices(spark, sf), X.windows(spark, sf, *DAYS), LIMITS, 24, RATIO, CORR, None)


@query(f"""WITH {BASE}, {scan_sql(True)}
SELECT window_id, pair, direction, n, round(hedge_ratio, 5) + 0.0 AS hedge_ratio, round(spread_vol, 5) + 0.0 AS spread_vol, round(half_life, 4) + 0.0 AS half_life, round(max_z, 4) + 0.0 AS max_z, round(current_z, 4) + 0.0 AS current_z, round(df, 4) + 0.0 AS df, reason FROM ranked WHERE nth = 1""")
def scan_gates(spark, sf):
    """Candidates of each window with ratio, half-life, validation |z| and the first gate that they fail, in the better direction."""
    d = W.with_windows(prices(spark, sf), X.windows(spark, sf, *DAYS)).where("role = 'train'").select("window_id", "ts", "symbol", "lp")
    out = S.scan(d, ("window_id",), LIMITS, RATIO, CORR, 3, None)
    return out.select("window_id", "pair", "direction", "n", *((F.round(c, k) + 0.0).alias(c) for c, k in (("hedge_ratio", 5), ("spread_vol", 5), ("half_life", 4), ("max_z", 4), ("current_z", 4), ("df", 4))), "reason")


@query()
def pair_scan(spark, sf):
    """Engle-Granger tests with chosen lags, both ways, and all gates, for each window and candidate."""
    d = saved(W.with_windows(prices(spark, sf), X.windows(spark, sf)).where("role = 'train'").select("window_id", "ts", "symbol", "lp"))
    return S.scan(d, ("window_id",), S.Limits(max_p=0.05, max_z=3.0, min_half_life=0.0), 0.9, CORR)


@query()
def two_stage_scan(spark, sf):
    """Pairs found on twenty days and confirmed, or not, on the last ten, with rolling tests and block ratios."""
    loose, tight = S.Limits(max_p=0.05, max_z=4.0, min_half_life=0.0), S.Limits(max_p=0.05, max_z=4.0, min_half_life=0.0, max_failures=0.9, max_beta_drift=5.0)
    return S.two_stage(prices(spark, sf), 20, 10, loose, tight, 0.02, (0.0, 500.0), (60, 8, 100, 25), 0.0, all_=True)


@query(f"WITH RECURSIVE {RUN} SELECT window_id, pair, count(*) AS trades, round(avg((net > 0)::INT), 6) + 0.0 AS win_rate, round(sum(gross), 6) + 0.0 AS gross, round(sum(net), 6) + 0.0 AS net FROM led GROUP BY ALL")
def walk_forward_run(spark, sf):
    """Scan, signals, entries, trades and result of all windows in one job."""
    return rounded(W.run(W.run_trades(run_spreads(spark, sf))))


FEEDBACK = f"""{RUN},
 res AS (SELECT window_id, pair, split_part(pair, '-', 1) AS a, split_part(pair, '-', 2) AS b, sum(gross) AS gross, sum(fees + slippage) AS cost, sum(net) AS net, count(*)::DOUBLE AS trades, sum((reason = 3)::INT)::DOUBLE AS stops FROM led GROUP BY ALL),
 names AS (SELECT DISTINCT pair AS name, 'pair' AS kind FROM res UNION SELECT DISTINCT unnest([a, b]), 'symbol' FROM res),
 cal AS (SELECT window_id, row_number() OVER (ORDER BY window_id) - 1 AS k FROM (SELECT DISTINCT window_id FROM res)),
 state AS (SELECT -1::BIGINT AS k, name, kind, 0.0::DOUBLE AS gross, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS trades, 0.0::DOUBLE AS stops, 0::BIGINT AS seen, false AS listed FROM names
  UNION ALL SELECT s.k + 1, s.name, s.kind, s.gross + coalesce(c.gross, 0), s.cost + coalesce(c.cost, 0), s.trades + coalesce(c.trades, 0), s.stops + coalesce(c.stops, 0), s.seen + (c.name IS NOT NULL)::INT,
    s.listed OR coalesce(s.kind = 'symbol' AND c.name IS NOT NULL AND s.seen + 1 >= {RULES.min_windows} AND ((s.gross + c.gross) / (s.seen + 1) < {RULES.worst_avg} OR (s.stops + c.stops) / (s.trades + c.trades) > {RULES.worst_stops}), false)
  FROM state s LEFT JOIN (
    SELECT k, name, kind, sum(gross) AS gross, sum(cost) AS cost, sum(trades) AS trades, sum(stops) AS stops FROM (
      SELECT cal.k, unnest([r.pair, r.a, r.b]) AS name, unnest(['pair', 'symbol', 'symbol']) AS kind, unnest([r.gross, r.net / 2, r.net / 2]) AS gross, unnest([r.cost, 0, 0]) AS cost, unnest([r.trades, r.trades / 2, r.trades / 2]) AS trades, unnest([r.stops, r.stops / 2, r.stops / 2]) AS stops
      FROM res r JOIN cal USING (window_id) JOIN state p ON p.kind = 'pair' AND p.name = r.pair AND p.k = cal.k - 1 JOIN state u ON u.kind = 'symbol' AND u.name = r.a AND u.k = cal.k - 1 JOIN state v ON v.kind = 'symbol' AND v.name = r.b AND v.k = cal.k - 1
      WHERE NOT u.listed AND NOT v.listed AND NOT (CASE WHEN abs(p.gross) > 1e-10 THEN p.cost / abs(p.gross) WHEN p.cost > 0 THEN 'inf'::DOUBLE ELSE 0 END > {RULES.max_cost}) AND NOT (p.trades > 0 AND p.stops / p.trades > {RULES.max_stops}))
    GROUP BY ALL HAVING kind = 'pair' OR sum(trades) >= {RULES.min_trades}) c ON c.k = s.k + 1 AND c.kind = s.kind AND c.name = s.name
  WHERE s.k + 1 < (SELECT count(*) FROM cal))
SELECT r.window_id, r.pair, r.trades::BIGINT AS trades, round(r.net, 6) + 0.0 AS net, CASE WHEN u.listed OR v.listed THEN 'listed' WHEN CASE WHEN abs(p.gross) > 1e-10 THEN p.cost / abs(p.gross) WHEN p.cost > 0 THEN 'inf'::DOUBLE ELSE 0 END > {RULES.max_cost} THEN 'costly' WHEN p.trades > 0 AND p.stops / p.trades > {RULES.max_stops} THEN 'stopped' ELSE 'traded' END AS verdict
FROM res r JOIN cal USING (window_id) JOIN state p ON p.kind = 'pair' AND p.name = r.pair AND p.k = cal.k - 1 JOIN state u ON u.kind = 'symbol' AND u.name = r.a AND u.k = cal.k - 1 JOIN state v ON v.kind = 'symbol' AND v.name = r.b AND v.k = cal.k - 1"""


@query(f"WITH RECURSIVE {FEEDBACK}")
def run_feedback(spark, sf):
    """The run in which listed symbols and the pairs' own past keep pairs out of later windows."""
    out = FB.carried(FB.results(W.run_trades(run_spreads(spark, sf))), new_folder(spark), RULES)
    return rounded(out.select("window_id", "pair", "trades", "net", "verdict"))


@query()
def sweep_runs(spark, sf):
    """A run of all windows for each cell of entry, exit and test limit, ranked."""
    limits = S.Limits(max_p=0.5, max_z=math.inf, min_half_life=0.0)
    return W.sweep_runs(W.picked_spreads(prices(spark, sf), X.windows(spark, sf), limits, 24, RATIO), [1.0, 1.5, 2.0], [0.0, 0.5], [0.001, 0.5])


def pair_trades(spark, sf):
    return interval_trades(X.masks(spark, sf), [], 5e-4, 5e-4, 48, 0.5)


@query(f"""WITH RECURSIVE {X.MASKS}, {trades_sql('masks', 'pair')} SELECT m.pair, m.ts, count(led.pair) > 0 AS in_trade FROM masks m LEFT JOIN led ON led.pair = m.pair AND m.ts > led.entry_ts AND m.ts <= led.exit_ts GROUP BY m.pair, m.ts""")
def in_trade_bars(spark, sf):
    """Bars at which a pair is in a trade."""
    return L.in_trade(X.masks(spark, sf).select("pair", "ts"), pair_trades(spark, sf))


@query(f"""WITH RECURSIVE {X.MASKS}, {X.FUNDING}, {trades_sql('masks', 'pair')},
 pbar AS (SELECT p.pair, p.ts, round((fy.rate - fx.rate) / 8, 10) + 0.0 AS per_bar FROM pair_bars p ASOF LEFT JOIN funding fy ON p.coin_y = fy.symbol AND p.ts >= fy.ts ASOF LEFT JOIN funding fx ON p.coin_x = fx.symbol AND p.ts >= fx.ts)
SELECT led.pair, row_number() OVER (PARTITION BY led.pair ORDER BY entry_ts) AS trade_seq, entry_ts, exit_ts, dir::BIGINT AS dir, hold AS hold_bars, reason::BIGINT AS exit_reason, round(gross, 6) + 0.0 AS gross, round(net, 6) + 0.0 AS net, round(-dir * sum(coalesce(per_bar, 0)), 6) + 0.0 AS funding
FROM led JOIN pbar ON pbar.pair = led.pair AND pbar.ts > entry_ts AND pbar.ts <= exit_ts GROUP BY led.pair, entry_ts, exit_ts, dir, hold, reason, gross, net""")
def trade_funding(spark, sf):
    """K2: funding paid by each trade over its bars."""
    out = W.trade_funding(pair_trades(spark, sf), asof_funding(spark, sf))
    return rounded(out.select("pair", "trade_seq", "entry_ts", "exit_ts", "dir", "hold_bars", "exit_reason", "gross", "net", "funding"))


WIDE = """closes AS (SELECT event_type || '/' || (user_id % 3) AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_max(value, ts) AS close FROM events GROUP BY ALL), lp AS (SELECT ts, symbol, ln(close) AS lp FROM closes WHERE close > 0),
 windows AS (SELECT 0::BIGINT AS window_id, TIMESTAMP '1900-01-01' AS train_start, TIMESTAMP '2900-01-01' AS train_end, TIMESTAMP '2900-01-01' AS test_end)"""


@query(f"""WITH {WIDE}, {scan_sql(True)}
SELECT pair, direction, n, round(hedge_ratio, 5) + 0.0 AS hedge_ratio, round(spread_vol, 5) + 0.0 AS spread_vol, round(half_life, 4) + 0.0 AS half_life, round(max_z, 4) + 0.0 AS max_z, round(current_z, 4) + 0.0 AS current_z, round(df, 4) + 0.0 AS df, reason FROM ranked WHERE nth = 1""")
def wide_scan(spark, sf):
    """The gates over all bars of fifteen series, a hundred pairs and more, of which candidates alone are joined."""
    c = X.closes(spark, sf, "concat(event_type, '/', user_id % 3)").where("close > 0").select("ts", "symbol", F.log("close").alias("lp"))
    out = S.scan(c, (), LIMITS, RATIO, CORR, 3, None)
    return out.select("pair", "direction", "n", *((F.round(c, k) + 0.0).alias(c) for c, k in (("hedge_ratio", 5), ("spread_vol", 5), ("half_life", 4), ("max_z", 4), ("current_z", 4), ("df", 4))), "reason")
