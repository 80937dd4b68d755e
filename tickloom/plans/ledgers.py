"""Queries of aggregations over candles, trades and returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import ledger as L
from tickloom.plans import fixtures as X
from tickloom.plans.catalog import query, rounded

T = X.TRADES


@query(f"""WITH {X.CANDLES}, n AS (SELECT count(DISTINCT ts) AS n FROM candles)
SELECT symbol, data_source, count(DISTINCT ts) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, round(100.0 * count(DISTINCT ts) / any_value(n), 6) + 0.0 AS coverage FROM candles, n GROUP BY GROUPING SETS ((symbol, data_source), (symbol))""")
def coverage(spark, sf):
    """Coverage by symbol and source, and by symbol."""
    c = X.candles(spark, sf)
    n = c.agg(F.count_distinct("ts").alias("n"))
    g = c.groupingSets([["symbol", "data_source"], ["symbol"]], "symbol", "data_source").agg(F.count_distinct("ts").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return rounded(g.join(F.broadcast(n)).withColumn("coverage", 100.0 * F.col("bars") / F.col("n")).drop("n"))


@query(f"""WITH {X.BARS}, d AS (SELECT symbol, ts, date_diff('second', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) / 3600.0 AS gap FROM closes)
SELECT symbol, sum((gap > 1.5)::INT)::BIGINT AS gaps, sum((gap > 1.5 AND gap <= 3)::INT)::BIGINT AS small, sum((gap > 3 AND gap <= 10)::INT)::BIGINT AS middle, sum((gap > 10)::INT)::BIGINT AS large, max(gap)::DOUBLE AS longest,
 round(100 * (1 - count(*) / (floor(date_diff('second', min(ts), max(ts)) / 3600) + 1)), 6) + 0.0 AS missing, CASE WHEN max(gap) > 10 THEN 'fatal' WHEN max(gap) > 3 THEN 'warn' ELSE 'ok' END AS status FROM d GROUP BY symbol""")
def gap_report(spark, sf):
    """Gaps between bars by length, and a verdict."""
    from tickloom.operators.bars import gaps

    return rounded(gaps(X.closes(spark, sf), 3600, (3, 10)))


@query("""SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2024-01-01')::TIMESTAMP AS ts, arg_max(value, ts) AS close, round(sum(value), 6) + 0.0 AS turnover, count(*) AS n FROM events GROUP BY ALL""")
def resample(spark, sf):
    """D3: four-hour bars, the last value of each."""
    from tickloom.operators.bars import resampled

    e = X.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"), F.col("value").alias("turnover"))
    out = resampled(e, "4 hours")
    return out.withColumn("turnover", F.round("turnover", 6) + 0.0)


STATS = """count(*) AS trades, avg((net > 0)::INT) AS win_rate, coalesce(avg(CASE WHEN net > 0 THEN net END), 0) AS avg_win, coalesce(-avg(CASE WHEN net < 0 THEN net END), 0) AS avg_loss, avg(net) AS expectancy,
  sum(gross) AS gross, sum(fees) AS fees, sum(slippage) AS slippage, sum(net) AS net, sum((exit_reason = 1)::INT)::BIGINT AS exits_signal, sum((exit_reason = 2)::INT)::BIGINT AS exits_time, sum((exit_reason = 3)::INT)::BIGINT AS exits_stop,
  sum((exit_reason = 4)::INT)::BIGINT AS exits_forced"""
STATS_ROUND = "trades, round(win_rate, 6) + 0.0 AS win_rate, round(avg_win, 6) + 0.0 AS avg_win, round(avg_loss, 6) + 0.0 AS avg_loss, round(expectancy, 6) + 0.0 AS expectancy, round(gross, 6) + 0.0 AS gross, round(fees, 6) + 0.0 AS fees, round(slippage, 6) + 0.0 AS slippage, round(net, 6) + 0.0 AS net, exits_signal, exits_time, exits_stop, exits_forced, round(CASE WHEN abs(gross) > 1e-12 THEN (fees + slippage) / abs(gross) END, 6) + 0.0 AS cost_to_gross"


@query(f"WITH {T} SELECT pair, {STATS_ROUND} FROM (SELECT pair, {STATS} FROM trades GROUP BY ROLLUP (pair))")
def ledger_stats(spark, sf):
    """What each pair made and cost, and all together."""
    return rounded(L.ledger_stats(X.trades(spark, sf)))


@query(f"""WITH {T}, p AS (SELECT pair, sum(net) AS net FROM trades GROUP BY pair), s AS (SELECT sum(gross) AS gross, sum(fees) AS fees, sum(slippage) AS slippage, sum(net) AS net FROM trades)
SELECT round(gross, 6) + 0.0 AS gross, round(net, 6) + 0.0 AS net, abs(gross - fees - slippage - net) < 1e-6 AS consistent, gross < 0 AS no_edge, gross > 0 AND net < 0 AS eaten_by_cost,
 (SELECT coalesce(sum(net), 0) FROM (SELECT net FROM p WHERE net < 0 ORDER BY net, pair LIMIT 2)) < 0.5 * (SELECT coalesce(sum(net), 0) FROM p WHERE net < 0) AS concentrated FROM s""")
def attribution_flags(spark, sf):
    """Totals, their residual, and warnings."""
    return rounded(L.attribution_flags(X.trades(spark, sf)))


@query(f"""WITH {T}, c AS (SELECT *, sum(net) OVER (PARTITION BY pair ORDER BY trade_seq ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY pair ORDER BY net, trade_seq) AS k, count(*) OVER (PARTITION BY pair) AS n FROM trades),
 d AS (SELECT *, greatest(max(cum) OVER (PARTITION BY pair ORDER BY trade_seq ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM c),
 g AS (SELECT pair, count(*) AS n, avg((net > 0)::INT) AS win_rate, sum(net) AS total, avg(net) AS mean, quantile_cont(net, 0.5) AS median, stddev_samp(net) AS std, max(dd) AS max_dd,
  CASE WHEN coalesce(-sum(CASE WHEN net < 0 THEN net END), 0) > 0 THEN coalesce(sum(CASE WHEN net > 0 THEN net END), 0) / -sum(CASE WHEN net < 0 THEN net END) ELSE 99 END AS profit_factor, max(CASE WHEN k = round_even(0.9 * (n - 1), 0) + 1 THEN net END) AS p90 FROM d GROUP BY pair)
SELECT pair, n, round(win_rate, 5) + 0.0 AS win_rate, round(total, 5) + 0.0 AS total, round(mean, 5) + 0.0 AS mean, round(median, 5) + 0.0 AS median, round(std, 5) + 0.0 AS std, round(max_dd, 5) + 0.0 AS max_dd, round(profit_factor, 5) + 0.0 AS profit_factor,
 round(p90, 5) + 0.0 AS p90, round(CASE WHEN std > 1e-12 THEN mean / std END, 5) + 0.0 AS sharpe FROM g""")
def trade_stats(spark, sf):
    """Distribution of a pair's trades."""
    return rounded(L.trade_stats(X.trades(spark, sf), ["pair"]), 5)


@query(f"""WITH {X.DAILY}, e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM daily),
 d AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM e), u AS (SELECT *, sum((dd <= 1e-12)::INT) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peaks FROM d),
 runs AS (SELECT series, max(len) AS longest FROM (SELECT series, peaks, count(*) AS len FROM u WHERE dd > 1e-12 GROUP BY ALL) GROUP BY series),
 c AS (SELECT d.series, CASE WHEN count(*) >= 3 THEN corr(d.ret, b.ret) ELSE 0 END AS corr FROM d JOIN daily b ON d.ts = b.ts AND b.series = '1-URGENT' GROUP BY d.series),
 m AS (SELECT series, count(*) AS n, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS total_return, max(dd) AS max_dd, avg(ret) / stddev_samp(ret) * sqrt(365) AS sharpe FROM d GROUP BY series)
SELECT series, n, round(total_return, 5) + 0.0 AS total_return, round(max_dd, 5) + 0.0 AS max_dd, round(sharpe, 5) + 0.0 AS sharpe, coalesce(longest, 0)::BIGINT AS longest_dd, round(corr, 5) + 0.0 AS corr,
 round(CASE WHEN max_dd > 1e-12 THEN (pow(1 + total_return, 365 / n) - 1) / max_dd END, 5) + 0.0 AS calmar FROM m LEFT JOIN runs USING (series) LEFT JOIN c USING (series)""")
def portfolio_metrics(spark, sf):
    """Return, drawdown and its length, Calmar, Sharpe, correlation to a benchmark."""
    d = X.daily(spark, sf)
    return rounded(L.portfolio_metrics(d, d.where("series = '1-URGENT'").select("ts", F.col("ret").alias("bench")), 365), 5)


@query(f"""WITH {X.BARS}, tf AS (SELECT unnest([1, 4, 24]) AS h), b AS (SELECT h, symbol, time_bucket(to_hours(h), ts, TIMESTAMP '2024-01-01') AS t, arg_max(px, ts) AS px FROM bars, tf WHERE px > 0 GROUP BY ALL),
 r AS (SELECT h, symbol, ln(px) - lag(ln(px)) OVER (PARTITION BY h, symbol ORDER BY t) AS ret FROM b)
SELECT h::BIGINT AS hours, count(ret) AS n, round(sum(ret), 6) + 0.0 AS gross, round(count(ret) * 4 * 0.0007, 6) + 0.0 AS cost, round(avg(ret) / stddev_samp(ret), 6) + 0.0 AS sharpe FROM r GROUP BY h""")
def timeframe_metrics(spark, sf):
    """The same figures at several bar lengths."""
    b = X.bars(spark, sf).where("px > 0").withColumn("hours", F.explode(F.array(*(F.lit(h).cast("long") for h in (1, 4, 24)))))
    hour = F.expr(f"timestampdiff(hour, timestamp_ntz'{X.START}', ts)")
    b = b.groupBy("hours", "symbol", F.floor(hour / F.col("hours")).alias("t")).agg(F.max_by("px", "ts").alias("px"))
    d = b.withColumn("ret", F.log("px") - F.lag(F.log("px")).over(Window.partitionBy("hours", "symbol").orderBy("t")))
    return rounded(d.groupBy("hours").agg(F.count("ret").alias("n"), F.sum("ret").alias("gross"), (F.count("ret") * 4 * 0.0007).alias("cost"), (F.avg("ret") / F.stddev_samp("ret")).alias("sharpe")))


@query(f"""WITH {X.RETURNS}, {X.windows_sql()}, w AS (SELECT window_id, symbol, ts, px, CASE WHEN ts > train_end THEN ret END AS ret FROM returns JOIN windows ON ts >= train_end AND ts < test_end),
 b AS (SELECT window_id, arg_max(px, ts) / arg_min(px, ts) - 1 AS bench_return, stddev_samp(ret) * sqrt(24 * 365) AS bench_vol FROM w WHERE symbol = 'click' AND px > 0 GROUP BY window_id),
 x AS (SELECT window_id, avg(sd) AS dispersion FROM (SELECT window_id, ts, stddev_samp(ret) AS sd FROM w GROUP BY ALL) GROUP BY window_id),
 c AS (SELECT window_id, avg(c) AS mean_corr FROM (SELECT a.window_id, a.symbol, b.symbol, corr(a.ret, b.ret) AS c FROM w a JOIN w b ON a.window_id = b.window_id AND a.ts = b.ts AND a.symbol < b.symbol GROUP BY ALL) GROUP BY window_id)
SELECT window_id, round(bench_return, 5) + 0.0 AS bench_return, round(bench_vol, 5) + 0.0 AS bench_vol, round(dispersion, 5) + 0.0 AS dispersion, round(mean_corr, 5) + 0.0 AS mean_corr FROM b JOIN x USING (window_id) JOIN c USING (window_id)""")
def window_conditions(spark, sf):
    """Benchmark return and volatility, dispersion and mean correlation in each test window."""
    from tickloom.operators.pairs import correlated

    w = X.returns(spark, sf).join(F.broadcast(X.windows(spark, sf)), F.expr("ts >= train_end and ts < test_end"))
    # returns inside the window: its first bar has none
    w = w.select("window_id", "symbol", "ts", "px", F.when(F.col("ts") > F.col("train_end"), F.col("ret")).alias("ret"))
    b = w.where("symbol = 'click' and px > 0").groupBy("window_id").agg((F.max_by("px", "ts") / F.min_by("px", "ts") - 1).alias("bench_return"), (F.stddev_samp("ret") * (24 * 365) ** 0.5).alias("bench_vol"))
    x = w.groupBy("window_id", "ts").agg(F.stddev_samp("ret").alias("sd")).groupBy("window_id").agg(F.avg("sd").alias("dispersion"))
    c = correlated(w.where("ret is not null").select("window_id", "symbol", "ts", F.col("ret").alias("lp")), 0.0, 2, ["window_id"]).groupBy("window_id").agg(F.avg("corr").alias("mean_corr"))
    return rounded(b.join(x, "window_id").join(c, "window_id"), 5)


@query(f"""WITH {T}, l AS (SELECT unnest([split_part(pair, '-', 1), substr(pair, instr(pair, '-') + 1)]) AS symbol, window_id, net, exit_reason FROM trades),
 g AS (SELECT symbol, window_id, sum(net) / 2 AS pnl, count(*) / 2 AS n, sum((exit_reason = 3)::INT) / 2 AS stops FROM l GROUP BY ALL HAVING count(*) / 2 >= 5),
 c AS (SELECT symbol, window_id, sum(pnl) OVER w AS cum_pnl, sum(n) OVER w AS cum_trades, sum(stops) OVER w AS cum_stops, count(*) OVER w AS windows FROM g WINDOW w AS (PARTITION BY symbol ORDER BY window_id ROWS UNBOUNDED PRECEDING))
SELECT symbol, window_id, round(cum_pnl, 6) + 0.0 AS cum_pnl, cum_trades, cum_stops, windows, bool_or(windows >= 2 AND (cum_pnl / windows < -0.003 OR cum_stops / cum_trades > 0.45)) OVER (PARTITION BY symbol ORDER BY window_id ROWS UNBOUNDED PRECEDING) AS blacklisted FROM c""")
def symbol_blacklist(spark, sf):
    """Legs that lost or were stopped too often, listed for good."""
    return rounded(L.leg_blacklist(X.trades(spark, sf)))


@query(f"""WITH {T}, d AS (SELECT pair, trade_seq, row_number() OVER w AS k, avg((exit_reason = 3)::INT) OVER w AS s, avg(net) OVER w AS m, avg((net > 0)::INT) OVER w AS p FROM trades WINDOW w AS (PARTITION BY pair ORDER BY trade_seq ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT pair, trade_seq, CASE WHEN s > 0.5 THEN 'stops' WHEN m < 0 THEN 'expectancy' WHEN p < 0.25 THEN 'wins' END AS reason FROM d WHERE k >= 6)
SELECT pair, min(trade_seq) AS retired_at, arg_min(reason, trade_seq) AS reason FROM r WHERE reason IS NOT NULL GROUP BY pair""")
def pair_quality(spark, sf):
    """The trade after which a pair is retired, and why."""
    return L.retired(X.trades(spark, sf))


@query(f"""WITH {T}, d AS (SELECT *, row_number() OVER w AS k, sum((net > 0)::INT) OVER w AS wins, avg(net) OVER w AS m, sum(net) OVER w AS c FROM trades WINDOW w AS (PARTITION BY pair ORDER BY trade_seq ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, sum((exit_reason = 3 AND net <= 0)::INT) OVER (PARTITION BY pair, wins ORDER BY trade_seq ROWS UNBOUNDED PRECEDING) AS stops FROM d),
 r AS (SELECT pair, trade_seq, CASE WHEN stops >= 3 THEN 'stop_streak' WHEN wins / k < 0.35 THEN 'win_rate' WHEN m < -0.005 THEN 'mean' WHEN c < -0.02 THEN 'sum' END AS reason FROM s WHERE k >= 6)
SELECT pair, min(trade_seq) AS disabled_at, arg_min(reason, trade_seq) AS reason FROM r WHERE reason IS NOT NULL GROUP BY pair""")
def pair_kill_switch(spark, sf):
    """The trade after which a pair is disabled, and why."""
    return L.kill_switch(X.trades(spark, sf))


@query(f"""WITH {T}, d AS (SELECT *, row_number() OVER w AS k, sum(net) OVER w AS c, avg((exit_reason = 3)::INT) OVER w AS s, sum((net > 0)::INT) OVER w AS wins FROM trades WINDOW w AS (PARTITION BY window_id, pair ORDER BY trade_seq ROWS UNBOUNDED PRECEDING)),
 l AS (SELECT *, sum((net <= 0)::INT) OVER (PARTITION BY window_id, pair, wins ORDER BY trade_seq ROWS UNBOUNDED PRECEDING) AS losses FROM d),
 r AS (SELECT *, bool_or(c < -0.005 OR (k >= 5 AND s > 0.5) OR losses >= 5) OVER (PARTITION BY window_id, pair ORDER BY trade_seq ROWS UNBOUNDED PRECEDING) AS tripped FROM l)
SELECT window_id, pair, trade_seq, tripped, CASE WHEN tripped THEN 0.5 ELSE 1.0 END::DOUBLE AS size, CASE WHEN tripped THEN 0.5 ELSE 0.0 END::DOUBLE AS z_add FROM r""")
def circuit_breaker(spark, sf):
    """Once a window's losses trip it, smaller sizes and higher thresholds."""
    return L.circuit_breaker(X.trades(spark, sf), ["window_id", "pair"]).select("window_id", "pair", "trade_seq", "tripped", "size", "z_add")


@query(f"""WITH {T}, s AS (SELECT pair, window_id, sum(gross) AS gross, sum(fees) AS fees, sum(slippage) AS slippage, count(*) AS trades, sum((exit_reason = 3)::INT) AS stops FROM trades GROUP BY ALL)
SELECT pair, window_id, round(coalesce(sum(gross) OVER w, 0), 6) + 0.0 AS gross, round(coalesce(sum(fees) OVER w, 0), 6) + 0.0 AS fees, round(coalesce(sum(slippage) OVER w, 0), 6) + 0.0 AS slippage, coalesce(sum(trades) OVER w, 0)::BIGINT AS trades, coalesce(sum(stops) OVER w, 0)::BIGINT AS stops
FROM s WINDOW w AS (PARTITION BY pair ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_ledger(spark, sf):
    """What is known of a pair before each window."""
    return rounded(L.running_ledger(X.trades(spark, sf)))


@query(f"""WITH {T}, e AS (SELECT pair, avg(24 / (1 + abs(gross * 100))) AS expected FROM trades GROUP BY pair), a AS (SELECT pair, avg(hold_bars) AS actual FROM trades GROUP BY pair)
SELECT pair, round(expected, 6) + 0.0 AS expected, round(actual, 6) + 0.0 AS actual, round(actual / expected, 6) + 0.0 AS ratio, actual / expected < 0.3 AS warn FROM e JOIN a USING (pair)""")
def hold_calibration(spark, sf):
    """How long trades were expected to be held, and were."""
    t = X.trades(spark, sf)
    d = t.groupBy("pair").agg(F.avg(24 / (1 + F.abs(F.col("gross") * 100))).alias("expected"), F.avg("hold_bars").alias("actual"))
    return rounded(d.withColumn("ratio", F.col("actual") / F.col("expected")).withColumn("warn", F.col("ratio") < 0.3))


@query(f"""WITH {X.SIGNALS}, g AS (SELECT pair, coalesce(abs(z) > 1, false) AS a, coalesce(expected_profit > 0.1, false) AS b, coalesce(abs(z) < 2.5, false) AS c, coalesce(vol > 0.5, false) AS d FROM signals),
 n AS (SELECT pair, count(*) AS bars, sum(a::INT) AS raw, sum((a AND b)::INT) AS profit, sum((a AND b AND c)::INT) AS bounded, sum((a AND b AND c AND d)::INT) AS final FROM g GROUP BY pair)
SELECT pair, bars, raw::BIGINT AS raw, profit::BIGINT AS profit, bounded::BIGINT AS bounded, final::BIGINT AS final, round(CASE WHEN raw > 0 THEN final / raw ELSE 0 END, 6) + 0.0 AS conversion,
 CASE greatest(raw - profit, profit - bounded, bounded - final) WHEN raw - profit THEN 'profit' WHEN profit - bounded THEN 'bounded' ELSE 'final' END AS blocker FROM n""")
def entry_funnel(spark, sf):
    """How many signals are left after each gate, and which takes most."""
    from tickloom.operators.entries import funnel

    s = X.signals(spark, sf).withColumns({"raw": F.abs("z") > 1, "profit": F.col("expected_profit") > 0.1, "bounded": F.abs("z") < 2.5, "final": F.col("vol") > 0.5})
    return rounded(funnel(s, ["pair"], ["raw", "profit", "bounded", "final"]))


@query(f"""WITH {T}, d AS (SELECT date_trunc('day', entry_ts)::TIMESTAMP AS day, sum(net) AS ret FROM trades GROUP BY 1), s AS (SELECT avg(ret) AS m, stddev_samp(ret) AS sd FROM d)
SELECT day, round(ret, 6) + 0.0 AS ret, round((ret - m) / sd, 5) + 0.0 AS z FROM d, s WHERE abs(ret) > greatest(2.5 * sd, 0.02)""")
def outlier_days(spark, sf):
    """Days of unusual returns."""
    d = X.trades(spark, sf).groupBy(F.date_trunc("day", "entry_ts").cast("timestamp_ntz").alias("day")).agg(F.sum("net").alias("ret"))
    s = d.agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"))
    out = d.join(F.broadcast(s)).where(F.abs("ret") > F.greatest(2.5 * F.col("sd"), F.lit(0.02)))
    return out.select("day", (F.round("ret", 6) + 0.0).alias("ret"), (F.round((F.col("ret") - F.col("m")) / F.col("sd"), 5) + 0.0).alias("z"))


@query(f"""WITH {T} SELECT split_part(pair, '-', 1) AS leg, round(sum(CASE WHEN exit_reason = 1 THEN net END), 6) + 0.0 AS signal, round(sum(CASE WHEN exit_reason = 2 THEN net END), 6) + 0.0 AS time, round(sum(CASE WHEN exit_reason = 3 THEN net END), 6) + 0.0 AS stop, round(sum(CASE WHEN exit_reason = 4 THEN net END), 6) + 0.0 AS forced FROM trades GROUP BY 1""")
def exit_heatmap(spark, sf):
    """The data of a chart, legs by exit reason."""
    t = X.trades(spark, sf).select(F.split("pair", "-", 2)[0].alias("leg"), "exit_reason", "net")
    return rounded(t.groupBy("leg").pivot("exit_reason", [1, 2, 3, 4]).agg(F.sum("net")).toDF("leg", "signal", "time", "stop", "forced"))


@query(f"""WITH {T} SELECT least(floor(hold_bars / 5), 9)::BIGINT AS bin, count(*) AS n, round(avg(net), 6) + 0.0 AS mean_net FROM trades GROUP BY 1""")
def duration_histogram(spark, sf):
    """The data of a chart, trades by holding time."""
    return rounded(X.trades(spark, sf).groupBy(F.least(F.floor(F.col("hold_bars") / 5), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("net").alias("mean_net")))


@query("""WITH f AS (SELECT d.doc_id % 2 AS half, d.n_chars AS x FROM documents d), e AS (SELECT quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM f WHERE half = 0),
 b AS (SELECT half, least(len(list_filter(q, lambda v: v <= x)), 10) AS bin FROM f, e WHERE x >= q[1] AND x <= q[11]), n AS (SELECT half, bin, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT half, sum(n) AS t FROM n GROUP BY half),
 s AS (SELECT bin, greatest(coalesce(max(CASE WHEN half = 0 THEN n / t END), 0), 1e-6) AS r, greatest(coalesce(max(CASE WHEN half = 1 THEN n / t END), 0), 1e-6) AS c FROM n JOIN t USING (half) GROUP BY bin)
SELECT round(sum((c - r) * ln(c / r)), 6) + 0.0 AS psi, count(*) AS bins FROM s""")
def feature_drift(spark, sf):
    """Population stability between two halves."""
    from tickloom.operators.learning import stability

    d = X.table(spark, sf, "documents")
    return rounded(stability(d.where("doc_id % 2 = 0").select(F.col("n_chars").alias("x")), d.where("doc_id % 2 = 1").select(F.col("n_chars").alias("x"))))


PRED = "pred AS (SELECT l.doc_id, (1 / (1 + exp(-(n_chars - 1500) / 1000.0)))::DOUBLE AS p, quality::DOUBLE AS y, lang AS regime FROM documents JOIN labels l USING (doc_id))"


def predictions(spark, sf):
    d = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", (1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000))).alias("p"), F.col("quality").cast("double").alias("y"), F.col("lang").alias("regime"))


@query(f"""WITH {PRED}, b AS (SELECT regime, p, y, least(floor(p * 10), 9) AS bin FROM pred), e AS (SELECT regime, sum(n * gap) / sum(n) AS ece FROM (SELECT regime, bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY ALL) GROUP BY regime)
SELECT regime, count(*) AS n, round(sqrt(avg((p - y) ** 2)), 6) + 0.0 AS rmse, round(avg((p - y) ** 2), 6) + 0.0 AS brier, round(any_value(ece), 6) + 0.0 AS ece, round(avg(((p >= 0.5) = (y = 1))::INT), 6) + 0.0 AS hit_rate, round(quantile_cont(p, 0.5), 6) + 0.0 AS median_p FROM b JOIN e USING (regime) GROUP BY regime""")
def prediction_quality(spark, sf):
    """Error, calibration and hit rate of predictions by regime."""
    from tickloom.operators.learning import prediction_quality as quality

    return rounded(quality(predictions(spark, sf), ["regime"]))


@query(f"""WITH {T}, s AS (SELECT window_id, pair, sum(abs(net)) AS w FROM trades GROUP BY ALL), sh AS (SELECT *, w / sum(w) OVER (PARTITION BY window_id) AS share FROM s)
SELECT window_id, count(*) AS n, round(sum(w), 6) + 0.0 AS exposure, round(sum(share * share), 6) + 0.0 AS hhi, round(1 / sum(share * share), 6) + 0.0 AS effective_n, round(max(share), 6) + 0.0 AS max_share FROM sh GROUP BY window_id""")
def concentration(spark, sf):
    """How far exposure gathers in few pairs."""
    from tickloom.operators.sizing import concentration as of

    s = X.trades(spark, sf).groupBy("window_id", "pair").agg(F.sum(F.abs("net")).alias("w"))
    return rounded(of(s, ["window_id"], "w"))


@query(f"""WITH {T}, l AS (SELECT window_id, pair, unnest([split_part(pair, '-', 1), substr(pair, instr(pair, '-') + 1)]) AS leg FROM (SELECT DISTINCT window_id, pair FROM trades)), c AS (SELECT window_id, left(leg, 7) AS cluster, count(*) AS legs FROM l GROUP BY ALL)
SELECT window_id, cluster, legs, round(1 - sum(pow(legs / t, 2)) OVER (PARTITION BY window_id), 6) + 0.0 AS diversity FROM (SELECT *, sum(legs) OVER (PARTITION BY window_id) AS t FROM c)""")
def cluster_exposure(spark, sf):
    """Legs in each cluster, and how diverse they are."""
    p = X.trades(spark, sf).select("window_id", "pair").distinct().withColumn("leg", F.explode(F.split("pair", "-", 2)))
    c = p.groupBy("window_id", F.substring("leg", 1, 7).alias("cluster")).agg(F.count("*").alias("legs"))
    w = Window.partitionBy("window_id")
    return rounded(c.withColumn("t", F.sum("legs").over(w)).withColumn("diversity", 1 - F.sum(F.pow(F.col("legs") / F.col("t"), 2)).over(w)).drop("t"))


@query(f"""WITH {X.SIGNALS}, p AS (SELECT unnest([1.0, 1.5, 2.0])::DOUBLE AS entry_z), r AS (SELECT entry_z, count(*) AS n, sum(expected_profit) AS net, count(*) * 0.0028 / abs(sum(expected_profit) + count(*) * 0.0028) AS cost_to_gross, avg(expected_profit) / stddev_samp(expected_profit) AS sharpe FROM signals JOIN p ON abs(z) > entry_z GROUP BY entry_z)
SELECT entry_z, n, round(cost_to_gross, 6) + 0.0 AS cost_to_gross, cost_to_gross < 0.5 AS cheap, row_number() OVER (ORDER BY cost_to_gross, entry_z) AS rank_cost, round(net, 6) + 0.0 AS net, round(sharpe, 6) + 0.0 AS sharpe, row_number() OVER (ORDER BY net DESC, entry_z) AS rank_net, row_number() OVER (ORDER BY sharpe DESC, entry_z) AS rank_sharpe FROM r""")
def parameter_sweep(spark, sf):
    """A grid of thresholds over one pass of the signals, ranked."""
    from tickloom.operators.entries import sweep

    return rounded(sweep(X.signals(spark, sf), [1.0, 1.5, 2.0]))


@query(f"""WITH {X.MASKS}, e AS (SELECT ts, sum(CASE WHEN entry_mask THEN least(abs(z) / 3, 1) ELSE 0 END) AS exposure, sum(entry_mask::INT) AS n FROM masks GROUP BY ts)
SELECT round(avg(exposure), 6) + 0.0 AS mean_exposure, round(max(exposure), 6) + 0.0 AS max_exposure, round(min(exposure), 6) + 0.0 AS min_exposure, round(avg((n > 0)::INT), 6) + 0.0 AS active_share, arg_max(n, ts)::BIGINT AS last_n FROM e""")
def exposure_summary(spark, sf):
    """Exposure over time in one row."""
    m = X.masks(spark, sf)
    e = m.groupBy("ts").agg(F.sum(F.when(F.col("entry_mask"), F.least(F.abs("z") / 3, F.lit(1.0))).otherwise(0.0)).alias("exposure"), F.sum(F.col("entry_mask").cast("long")).alias("n"))
    return rounded(e.agg(F.avg("exposure").alias("mean_exposure"), F.max("exposure").alias("max_exposure"), F.min("exposure").alias("min_exposure"), F.avg((F.col("n") > 0).cast("int")).alias("active_share"), F.max_by("n", "ts").alias("last_n")))


@query(f"""WITH {T}, w AS (SELECT window_id, sum(net) AS net, sum(gross) AS gross, count(*) AS trades, avg((net > 0)::INT) AS win_rate, avg((exit_reason = 3)::INT) AS stop_rate FROM trades GROUP BY window_id)
SELECT count(*) AS windows, sum(trades)::BIGINT AS trades, round(sum(gross), 6) + 0.0 AS gross, round(sum(net), 6) + 0.0 AS net, round(sum(win_rate * trades) / sum(trades), 6) + 0.0 AS win_rate, sum((net > 0)::INT)::BIGINT AS winning_windows, bool_or(stop_rate > 0.4) AS many_stops FROM w""")
def run_summary(spark, sf):
    """A whole run in one row."""
    w = L.ledger_stats(X.trades(spark, sf), ["window_id"], total=False).withColumn("stop_rate", F.col("exits_stop") / F.col("trades"))
    return rounded(w.agg(F.count("*").alias("windows"), F.sum("trades").alias("trades"), F.sum("gross").alias("gross"), F.sum("net").alias("net"), (F.sum(F.col("win_rate") * F.col("trades")) / F.sum("trades")).alias("win_rate"), F.sum((F.col("net") > 0).cast("long")).alias("winning_windows"), F.max(F.col("stop_rate") > 0.4).alias("many_stops")))


@query(f"""WITH {T} SELECT window_id, round(sum(net), 6) + 0.0 AS net, sum((net <> 0)::INT)::BIGINT AS trades, round(avg((net > 0)::INT), 6) + 0.0 AS win_rate, round(sum(gross), 6) + 0.0 AS gross FROM trades GROUP BY window_id""")
def window_metrics(spark, sf):
    """K3: each window's result."""
    return rounded(X.trades(spark, sf).groupBy("window_id").agg(F.sum("net").alias("net"), F.sum((F.col("net") != 0).cast("long")).alias("trades"), F.avg((F.col("net") > 0).cast("int")).alias("win_rate"), F.sum("gross").alias("gross")))
