"""Queries of reports: what losing windows have in common, regimes and the half-lives they suit, whole sizes, health of models, totals and charts of a run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import reports as R
from tickloom.operators import walkforward as W
from tickloom.plans import fixtures as X
from tickloom.plans.catalog import query, rounded
from tickloom.plans.ledgers import PRED, predictions
from tickloom.plans.scans import DAYS, RUN, run_spreads

#: Net result below which a window counts as losing; the tables' windows all gain.
LOSING = 30.0
WINDOWS = f"""{RUN}, rt AS (SELECT symbol, ts, px, CASE WHEN b > 0 THEN px / b - 1 END AS ret FROM (SELECT *, lag(px) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM bars)),
 tw AS (SELECT window_id, symbol, ts, px, CASE WHEN ts > train_end THEN ret END AS ret FROM rt JOIN windows ON ts >= train_end AND ts < test_end),
 wb AS (SELECT window_id, arg_max(px, ts) / arg_min(px, ts) - 1 AS bench_return, stddev_samp(ret) * sqrt(24 * 365) AS bench_vol FROM tw WHERE symbol = 'click' AND px > 0 GROUP BY window_id),
 wx AS (SELECT window_id, avg(sd) AS dispersion FROM (SELECT window_id, ts, stddev_samp(ret) AS sd FROM tw GROUP BY ALL) GROUP BY window_id),
 wc AS (SELECT window_id, avg(c) AS mean_corr FROM (SELECT a.window_id, a.symbol, b.symbol, corr(a.ret, b.ret) AS c FROM tw a JOIN tw b ON a.window_id = b.window_id AND a.ts = b.ts AND a.symbol < b.symbol GROUP BY ALL) GROUP BY window_id),
 wl AS (SELECT window_id, sum(net) AS pnl, count(*)::DOUBLE AS trades, avg((reason = 3)::INT) AS stop_rate, avg((net > 0)::INT) AS win_rate FROM led GROUP BY window_id),
 wm AS (SELECT *, pnl < {LOSING} AS losing FROM wb JOIN wx USING (window_id) JOIN wc USING (window_id) JOIN wl USING (window_id)),
 wu AS (UNPIVOT (SELECT losing, pnl, trades, stop_rate, win_rate, bench_return, bench_vol, dispersion, mean_corr FROM wm) ON pnl, trades, stop_rate, win_rate, bench_return, bench_vol, dispersion, mean_corr INTO NAME metric VALUE v),
 wd AS (SELECT metric, avg(v) FILTER (losing) AS losing_mean, avg(v) FILTER (NOT losing) AS winning_mean, count(*) FILTER (losing) AS losing_count, count(*) FILTER (NOT losing) AS winning_count FROM wu GROUP BY metric)"""


def window_figures(spark, sf):
    w = X.returns(spark, sf).join(F.broadcast(X.windows(spark, sf, *DAYS)), F.expr("ts >= train_end and ts < test_end"))
    w = w.select("window_id", "symbol", "ts", "px", F.when(F.col("ts") > F.col("train_end"), F.col("ret")).alias("ret"))
    return R.window_figures(W.run_trades(run_spreads(spark, sf)), w, "click", 24 * 365)


@query(f"""WITH RECURSIVE {WINDOWS} SELECT metric, round(losing_mean, 5) + 0.0 AS losing_mean, round(winning_mean, 5) + 0.0 AS winning_mean, round(losing_mean - winning_mean, 5) + 0.0 AS delta, losing_count, winning_count FROM wd""")
def losing_windows(spark, sf):
    """Losing against winning windows, by eight figures."""
    return rounded(R.losing_windows(window_figures(spark, sf), LOSING), 5)


@query(f"""WITH RECURSIVE {WINDOWS} SELECT metric, round(losing_mean - winning_mean, 5) + 0.0 AS delta, CASE metric WHEN 'bench_vol' THEN 'tighten volatility limit' WHEN 'dispersion' THEN 'tighten dispersion limit' WHEN 'stop_rate' THEN 'stricter entries or wider stops' ELSE 'filter by correlation' END AS advice
FROM wd WHERE CASE metric WHEN 'bench_vol' THEN losing_mean - winning_mean > 0.1 WHEN 'dispersion' THEN losing_mean - winning_mean > 0.0001 WHEN 'stop_rate' THEN losing_mean - winning_mean > 0.1 WHEN 'mean_corr' THEN losing_mean - winning_mean < -0.1 END""")
def window_advice(spark, sf):
    """What the difference between losing and winning windows advises."""
    return rounded(R.window_advice(R.losing_windows(window_figures(spark, sf), LOSING)), 5)


@query(f"""WITH {X.RETURNS}, {X.windows_sql()}, lr AS (SELECT symbol, ts, CASE WHEN px > 0 AND b > 0 THEN ln(px / b) END AS lr FROM (SELECT *, lag(px) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM bars)),
 w AS (SELECT window_id, symbol, ts, lr, lag(lr) OVER (PARTITION BY window_id, symbol ORDER BY ts) AS r1, row_number() OVER (PARTITION BY window_id, symbol ORDER BY ts DESC) AS back FROM lr JOIN windows ON ts > train_start AND ts < train_end WHERE lr IS NOT NULL),
 v AS (SELECT window_id, back, CASE WHEN count(lr) OVER q >= 24 THEN round(stddev_samp(lr) OVER q, 9) END AS vol FROM w WHERE symbol = 'click' WINDOW q AS (PARTITION BY window_id ORDER BY ts ROWS 23 PRECEDING)),
 h AS (SELECT window_id, count(vol) AS n, max(CASE WHEN back = 1 THEN vol END) AS now FROM v WHERE back <= 168 GROUP BY window_id),
 p AS (SELECT h.window_id, CASE WHEN any_value(n) < 2 THEN 0.5 ELSE avg((vol < now)::INT) END AS vol_percentile, coalesce(any_value(now), 0) * sqrt(24 * 365) AS vol FROM h JOIN v ON v.window_id = h.window_id AND back <= 168 AND vol IS NOT NULL GROUP BY h.window_id),
 c AS (SELECT window_id, symbol, corr(lr, r1) AS c FROM w WHERE r1 IS NOT NULL AND back <= 168 GROUP BY ALL HAVING count(*) >= 20), a AS (SELECT window_id, quantile_cont(c, 0.5) AS autocorr FROM c GROUP BY window_id),
 k AS (SELECT window_id, vol_percentile, vol, autocorr, CASE WHEN vol_percentile < 0.25 THEN 'low' WHEN vol_percentile > 0.75 THEN 'high' ELSE 'normal' END AS volatility, CASE WHEN autocorr > 0.15 THEN 'trending' WHEN autocorr < -0.1 THEN 'mean_reverting' ELSE 'neutral' END AS trend FROM p JOIN a USING (window_id))
SELECT window_id, round(vol_percentile, 5) + 0.0 AS vol_percentile, round(vol, 4) + 0.0 AS vol, round(autocorr, 5) + 0.0 AS autocorr, volatility, trend, CASE trend WHEN 'trending' THEN 40 WHEN 'mean_reverting' THEN 80 ELSE CASE volatility WHEN 'high' THEN 120 WHEN 'low' THEN 40 ELSE 60 END END::BIGINT AS min_half_life,
 CASE trend WHEN 'trending' THEN 480 WHEN 'mean_reverting' THEN 1440 ELSE CASE volatility WHEN 'high' THEN 1200 WHEN 'low' THEN 720 ELSE 960 END END::BIGINT AS max_half_life FROM k""")
def regime_ranges(spark, sf):
    """Each training part's volatility rank, autocorrelation, their classes, and the half-lives that suit them."""
    px = X.bars(spark, sf).where("px > 0").select("symbol", "ts", "px")
    out = R.regime_ranges(px, X.windows(spark, sf), "click", 168, 24, 24 * 365)
    return out.select("window_id", *((F.round(c, k) + 0.0).alias(c) for c, k in (("vol_percentile", 5), ("vol", 4), ("autocorr", 5))), "volatility", "trend", "min_half_life", "max_half_life")


@query(f"""WITH {X.SIGNALS}, d AS (SELECT pair, ts, z, spread - lag(spread) OVER (PARTITION BY pair ORDER BY ts) AS r FROM signals),
 v AS (SELECT *, CASE WHEN count(r) OVER q >= 12 THEN stddev_samp(r) OVER q END * sqrt(8760) AS rv FROM d WINDOW q AS (PARTITION BY pair ORDER BY ts ROWS 47 PRECEDING)), m AS (SELECT pair, quantile_cont(rv, 0.5) AS mid FROM v GROUP BY pair),
 cr AS (SELECT a.pair, b.pair AS other, abs(corr(a.r, b.r)) AS c FROM d a JOIN d b ON a.ts = b.ts AND a.pair <> b.pair WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL), ca AS (SELECT pair, (sum(c) + 1) / (count(c) + 1) AS mean_corr FROM cr GROUP BY pair)
SELECT v.pair, ts, round(greatest(0.1, least(0.25, 0.15 * (0.3 + 0.9 * least(1, abs(z) / 3)) * greatest(0.5, least(2, 60 / greatest(0.001, coalesce(rv, CASE WHEN mid > 0 THEN mid ELSE 0.1 END)))) * greatest(0.5, 1 - greatest(mean_corr - 0.3, 0) / 0.7 * 0.5))), 5) + 0.0 AS size
FROM v JOIN m USING (pair) JOIN ca USING (pair) WHERE z IS NOT NULL""")
def conviction_sizes(spark, sf):
    """H9: sizes by conviction, volatility target and mean correlation, between the least and the largest."""
    s = X.signals(spark, sf)
    s = s.withColumn("r", F.col("spread") - F.lag("spread").over(Window.partitionBy("pair").orderBy("ts"))).withColumn("score", F.least(F.lit(1.0), F.abs("z") / 3))
    sizes = R.Sizes(base=0.15, conviction=(0.3, 1.2), target_vol=60.0, lookback=48, threshold=0.3, least=0.1, most=0.25)
    return rounded(R.sized(s, sizes).where("z is not null").select("pair", "ts", "size"), 5)


HEALTH = f"""{PRED}, c AS (SELECT *, greatest(0, least(1, 1 - abs(p - 0.5) * 1.5)) AS conf FROM pred), b AS (SELECT p, y, least(floor(p * 10), 9) AS bin FROM pred),
 e AS (SELECT sum(n * gap) / sum(n) AS ece FROM (SELECT bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY ALL)),
 m AS (SELECT count(*) AS n, quantile_cont(conf, 0.1) AS p10, quantile_cont(conf, 0.5) AS p50, quantile_cont(conf, 0.9) AS p90, 100 * avg((conf < 0.3)::INT) AS fallback_pct, sqrt(avg((p - y) ** 2)) AS rmse FROM c)"""


@query(f"""WITH {HEALTH} SELECT n, round(p10, 6) + 0.0 AS confidence_p10, round(p50, 6) + 0.0 AS confidence_p50, round(p90, 6) + 0.0 AS confidence_p90, round(fallback_pct, 6) + 0.0 AS fallback_pct, round(rmse, 6) + 0.0 AS rmse, round(ece, 6) + 0.0 AS ece,
 list_filter(['drift', CASE WHEN rmse > 1.5 * 0.25 THEN 'accuracy' END, CASE WHEN ece > 0.15 THEN 'calibration' END, CASE WHEN 31 > 30 THEN 'age' END], lambda x: x IS NOT NULL)::VARCHAR AS reasons, true AS retrain FROM m, e""")
def model_health(spark, sf):
    """Confidence of predictions, how many fall back, and whether and why the model should be fitted again."""
    d = predictions(spark, sf).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(F.col("p") - 0.5) * 1.5)))
    out = R.model_health(d, psi=0.3, days=31, baseline=0.25)
    return rounded(out.withColumn("reasons", F.concat(F.lit("["), F.array_join("reasons", ", "), F.lit("]"))))


@query(f"""WITH {X.TRADES}, w AS (SELECT window_id, sum(net) AS net, count(*) AS n FROM trades GROUP BY window_id), x AS (SELECT avg((exit_reason = 1)::INT) AS s, avg((exit_reason = 2)::INT) AS t, avg((exit_reason = 3)::INT) AS p, avg((exit_reason = 4)::INT) AS f, sum(fees + slippage) / abs(sum(gross)) AS c FROM trades)
SELECT count(*) AS windows, round(exp(sum(ln(1 + greatest(net / 100, -0.99)))) - 1, 6) + 0.0 AS compounded, round(any_value(s), 6) + 0.0 AS signal_share, round(any_value(t), 6) + 0.0 AS time_share, round(any_value(p), 6) + 0.0 AS stop_share, round(any_value(f), 6) + 0.0 AS forced_share,
 any_value(p) > 0.4 AS many_stops, any_value(c) > 0.5 AS costly, any_value(f) > 0.3 AS many_forced FROM w, x""")
def run_totals(spark, sf):
    """A run's return compounded over windows, how trades ended, and warnings. Returns are results of a hundred units of capital."""
    return rounded(R.run_totals(X.trades(spark, sf), 100.0))


@query(f"""WITH {X.TRADES}, g AS (SELECT pair, count(*) AS trades, count(*) FILTER (net > 0) AS wins FROM trades GROUP BY pair), k AS (SELECT *, row_number() OVER (ORDER BY trades DESC, pair) AS place FROM g) SELECT place, pair, wins, trades - wins AS losses, round(wins / trades, 6) + 0.0 AS win_rate FROM k WHERE place <= 20""")
def wins_and_losses(spark, sf):
    """The data of a chart, wins and losses of the twenty pairs with most trades."""
    return rounded(R.wins_and_losses(X.trades(spark, sf), 20))


@query(f"""WITH {X.TRADES}, g AS (SELECT pair, avg(gross) - 0.001 AS expected, sum(net) AS realised, count(*) AS trades FROM trades GROUP BY pair)
SELECT pair, round(expected, 6) + 0.0 AS expected, round(realised, 6) + 0.0 AS realised, least(500, greatest(30, trades * 20)) AS dot, CASE WHEN expected > 0 AND realised > 0 THEN 'as_hoped' WHEN expected < 0 AND realised < 0 THEN 'as_feared' WHEN expected > 0 AND realised < 0 THEN 'disappointed' ELSE 'surprised' END AS quadrant FROM g""")
def expected_and_realised(spark, sf):
    """The data of a chart, expectancy against result, and the quadrant of each pair."""
    t = X.trades(spark, sf)
    return rounded(R.quadrants(t.groupBy("pair").agg((F.avg("gross") - 0.001).alias("expected"), F.sum("net").alias("realised"), F.count("*").alias("trades"))))
