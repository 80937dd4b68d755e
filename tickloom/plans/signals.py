"""Queries of rolling figures, entries, sizes, pairs, walk-forward windows and trade ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import entries as E
from tickloom.operators import features as T
from tickloom.operators import learning as M
from tickloom.operators import ledger as L
from tickloom.operators import pairs as P
from tickloom.operators import sizing as Z
from tickloom.operators import walkforward as W
from tickloom.plans import fixtures as X
from tickloom.plans.catalog import query, rounded

S, K = X.SIGNALS, X.MASKS
OVER = "PARTITION BY pair ORDER BY ts"

def of_pair() -> Window:
    """A pair's rows in order of time."""
    return Window.partitionBy("pair").orderBy("ts")


def keep(df, *cols):
    return rounded(df.select("pair", "ts", *cols))


@query(f"""WITH {X.BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM bars),
 n AS (SELECT symbol, ts, close, k, last_value(CASE WHEN close IS NOT NULL THEN k END IGNORE NULLS) OVER b AS ka, last_value(close IGNORE NULLS) OVER b AS va, first_value(CASE WHEN close IS NOT NULL THEN k END IGNORE NULLS) OVER f AS kb, first_value(close IGNORE NULLS) OVER f AS vb FROM k
  WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, ts, round(CASE WHEN close IS NOT NULL THEN close WHEN kb - ka - 1 <= 2 THEN va + (vb - va) * (k - ka) / (kb - ka) END, 6) + 0.0 AS px FROM n""")
def interpolate(spark, sf):
    """Short gaps on a line."""
    return rounded(B.interpolated(X.bars(spark, sf).select("symbol", "ts", "close"), 2).select("symbol", "ts", "px"))


TREND = S + f""", m AS (SELECT pair, ts, z, spread, CASE WHEN count(spread) OVER w >= 20 THEN avg(spread) OVER w END AS ma, CASE WHEN count(spread) OVER w >= 20 THEN stddev_samp(spread) OVER w END AS sd FROM signals WINDOW w AS ({OVER} ROWS 19 PRECEDING)),
 d AS (SELECT pair, ts, z, CASE WHEN sd > 1e-12 THEN (ma - lag(ma) OVER ({OVER})) / sd END AS slope, CASE WHEN sd > 1e-12 THEN (spread - ma) / sd END AS vs FROM m),
 trend AS (SELECT *, coalesce(1 - least(abs(slope) / 0.1, 1), 1) AS score, coalesce(slope > 0.1 AND vs > 1, false) AS no_short, coalesce(slope < -0.1 AND vs < -1, false) AS no_long FROM d)"""


@query(f"WITH {TREND} SELECT pair, ts, round(slope, 6) + 0.0 AS ma_slope, round(vs, 6) + 0.0 AS vs_ma, round(score, 6) + 0.0 AS trend_score, no_short, no_long FROM trend")
def trend_state(spark, sf):
    """Slope and place of the spread against its mean, and what they forbid."""
    return keep(B.trend(X.signals(spark, sf), 20, 0.1, 1.0), "ma_slope", "vs_ma", "trend_score", "no_short", "no_long")


@query(f"WITH {TREND} SELECT pair, ts, abs(z) > 1.5 AND NOT (z > 0 AND no_short) AND NOT (z < 0 AND no_long) AS entry, round(abs(z) * (0.7 + 0.3 * score), 6) + 0.0 AS score FROM trend WHERE z IS NOT NULL")
def trend_entries(spark, sf):
    """No entry against the trend; scores pay for it."""
    d = B.trend(X.signals(spark, sf), 20, 0.1, 1.0).where("z is not null")
    ok = (F.abs("z") > 1.5) & ~((F.col("z") > 0) & F.col("no_short")) & ~((F.col("z") < 0) & F.col("no_long"))
    return keep(d, ok.alias("entry"), (F.abs("z") * (0.7 + 0.3 * F.col("trend_score"))).alias("score"))


@query(f"""WITH {S}, l AS (SELECT pair, ts, z, lag(z, 3) OVER ({OVER}) AS a, lag(z, 6) OVER ({OVER}) AS b FROM signals)
SELECT pair, ts, round((z - a) / 3, 6) + 0.0 AS velocity, round(((z - a) - (a - b)) / 9, 6) + 0.0 AS acceleration, coalesce(z * ((z - a) / 3) < 0, false) AS reverting, coalesce(abs(z) - abs(a) >= -0.1::DOUBLE * 3, false) AS fresh, coalesce(abs(b) > abs(z), false) AND coalesce(z * ((z - a) / 3) < 0, false) AS stale FROM l""")
def spread_velocity(spark, sf):
    """How fast z moves, and whether back."""
    return keep(E.velocity(X.signals(spark, sf), 3), "velocity", "acceleration", "reverting", "fresh", "stale")


@query(f"""WITH {S}, l AS (SELECT pair, ts, z, lag(z) OVER ({OVER}) AS z1 FROM signals)
SELECT pair, ts, round(CASE WHEN count(z * z1) OVER w >= 24 AND stddev_samp(z) OVER w * stddev_samp(z1) OVER w > 1e-12 THEN (avg(z * z1) OVER w - avg(z) OVER w * avg(z1) OVER w) / (stddev_samp(z) OVER w * stddev_samp(z1) OVER w) END, 5) + 0.0 AS lag1 FROM l WINDOW w AS ({OVER} ROWS 23 PRECEDING)""")
def lag1_autocorr(spark, sf):
    """E5: rolling lag-1 autocorrelation."""
    d = X.signals(spark, sf).withColumn("z1", F.lag("z").over(of_pair()))
    return rounded(d.select("pair", "ts", B.lag1(F.col("z"), F.col("z1"), of_pair(), 24).alias("lag1")), 5)


@query(f"""WITH {X.RETURNS}, {X.CANDLES}, {X.FUNDING}, q AS (SELECT ts, quantile_cont(ret, 0.1) AS lo, quantile_cont(ret, 0.9) AS hi FROM returns GROUP BY ts), m AS (SELECT r.ts, avg(ret) AS market FROM returns r JOIN q USING (ts) WHERE ret >= lo AND ret <= hi GROUP BY r.ts),
 d AS (SELECT symbol, ts, px, ret, market, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM returns JOIN m USING (ts) WHERE ret IS NOT NULL),
 g AS (SELECT symbol, covar_samp(ret, market) FILTER (k <= 240) / var_samp(market) FILTER (k <= 240) AS beta, avg(ret) FILTER (k <= 240) AS mean, avg(market) FILTER (k <= 240) AS mm, stddev_samp(ret) FILTER (k <= 240) AS vol,
  100 * avg(greatest(ret, 0)) FILTER (k <= 120) / (avg(greatest(ret, 0)) FILTER (k <= 120) + avg(greatest(-ret, 0)) FILTER (k <= 120)) AS rsi, arg_max(px, ts) / quantile_cont(px, 0.5) FILTER (k <= 240) - 1 AS reversion FROM d GROUP BY symbol), v AS (SELECT b.symbol, b.ts, coalesce(sum(c.turnover), 0) AS turnover FROM bars b LEFT JOIN candles c ON b.symbol = c.symbol AND b.ts = c.ts GROUP BY ALL), vk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM v),
 vf AS (SELECT symbol, avg(turnover) FILTER (k <= 72) / CASE WHEN avg(turnover) FILTER (k <= 720) = 0 THEN 1 ELSE avg(turnover) FILTER (k <= 720) END - 1 AS volume_flow FROM vk GROUP BY symbol), ff AS (SELECT symbol, 100 * avg(rate) FILTER (k <= 9) AS funding_sentiment FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM funding) GROUP BY symbol)
SELECT symbol, round(beta, 5) + 0.0 AS beta, round(mean - beta * mm, 5) + 0.0 AS alpha, round(vol, 5) + 0.0 AS vol, round(rsi, 5) + 0.0 AS rsi, round(reversion, 5) + 0.0 AS reversion, round(volume_flow, 5) + 0.0 AS volume_flow, round(coalesce(funding_sentiment, 0), 9) + 0.0 AS funding_sentiment FROM g JOIN vf USING (symbol) LEFT JOIN ff USING (symbol)""")
def coin_features(spark, sf):
    """Figures of each symbol against a trimmed market return."""
    turnover = X.bars(spark, sf).select("symbol", "ts").join(X.candles(spark, sf).groupBy("symbol", "ts").agg(F.sum("turnover").alias("turnover")), ["symbol", "ts"], "left")
    out = B.coin_features(X.returns(spark, sf), 240, 120).join(B.flows(turnover, 72, 720), "symbol").join(B.sentiment(X.funding(spark, sf), 9), "symbol", "left")
    mood = F.round(F.coalesce("funding_sentiment", F.lit(0.0)), 9) + 0.0
    return out.select("symbol", *((F.round(c, 5) + 0.0).alias(c) for c in ("beta", "alpha", "vol", "rsi", "reversion", "volume_flow")), mood.alias("funding_sentiment"))


REGIME = X.RETURNS + """, v AS (SELECT ts, CASE WHEN count(ret) OVER w >= 12 THEN round(stddev_samp(ret) OVER w, 9) END AS vol FROM returns WHERE symbol = 'click' WINDOW w AS (ORDER BY ts ROWS 23 PRECEDING)),
 b AS (SELECT ts, vol, CASE WHEN vol IS NOT NULL THEN (rank() OVER (ORDER BY vol NULLS LAST) + (count(vol) OVER (PARTITION BY vol) - 1) / 2) / count(vol) OVER () END AS vol_rank FROM v),
 x AS (SELECT ts, dispersion, count(dispersion) OVER w AS n, min(dispersion) OVER w AS lo, max(dispersion) OVER w AS hi FROM (SELECT ts, stddev_samp(ret) AS dispersion FROM returns GROUP BY ts) WINDOW w AS (ORDER BY ts ROWS 23 PRECEDING)),
 regime AS (SELECT coalesce(b.ts, x.ts) AS ts, vol_rank, CASE WHEN n >= 12 AND hi > lo THEN (dispersion - lo) / (hi - lo) END AS dispersion_pos FROM b FULL JOIN x ON b.ts = x.ts)"""


@query(f"""WITH {REGIME} SELECT ts, round(vol_rank, 6) + 0.0 AS vol_rank, round(dispersion_pos, 6) + 0.0 AS dispersion_pos, coalesce(vol_rank <= 0.8, false) AND coalesce(dispersion_pos <= 0.8, true) AS allowed,
 CASE WHEN coalesce(vol_rank, 0.5) > 0.85 OR coalesce(dispersion_pos, 0.5) > 0.85 THEN 'RED' WHEN coalesce(vol_rank, 0.5) > 0.6 OR coalesce(dispersion_pos, 0.5) > 0.6 THEN 'YELLOW' ELSE 'GREEN' END AS state FROM regime""")
def market_regime(spark, sf):
    """Rank of volatility, place of dispersion, what they allow, and a state."""
    return rounded(B.regime(X.returns(spark, sf), "click", 24, 0.8, 0.6, 0.85))


@query(f"""WITH {X.RETURNS}, {X.windows_sql()}, r AS (SELECT window_id, symbol, ts, ret, lag(ret) OVER (PARTITION BY window_id, symbol ORDER BY ts) AS r1 FROM returns JOIN windows ON ts >= train_start AND ts < train_end),
 a AS (SELECT window_id, quantile_cont(c, 0.5) AS autocorr FROM (SELECT window_id, symbol, corr(ret, r1) AS c FROM r WHERE ret IS NOT NULL AND r1 IS NOT NULL GROUP BY ALL HAVING count(*) >= 20) GROUP BY window_id)
SELECT window_id, round(autocorr, 5) + 0.0 AS autocorr, CASE WHEN autocorr > 0.15 THEN 'trending' WHEN autocorr < -0.1 THEN 'mean_reverting' ELSE 'neutral' END AS trend FROM a""")
def trend_regime(spark, sf):
    """Median autocorrelation of each window, and its class."""
    return rounded(W.trend_regime(X.returns(spark, sf), X.windows(spark, sf)), 5)


COOL = K + ", m AS (SELECT *, CASE WHEN abs(z) > 2 THEN 3 ELSE 1 END AS exit_reason, exit_mask OR abs(z) > 2 AS out FROM masks)"


@query(f"""WITH {COOL}, c AS (SELECT pair, ts, entry_mask, CASE WHEN coalesce(out, false) THEN ts + to_hours(CASE WHEN exit_reason = 3 THEN 8 ELSE 2 END) END AS til FROM m)
SELECT pair, ts, entry_mask AND coalesce(max(til) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= ts, false) AS blocked FROM c""")
def entry_cooldown(spark, sf):
    """No entry soon after an exit, later after a stop."""
    m = X.masks(spark, sf).withColumns({"exit_reason": F.when(F.abs("z") > 2, 3).otherwise(1), "exit_mask": F.coalesce(F.col("exit_mask") | (F.abs("z") > 2), F.lit(False))})
    return E.cooled(m, {0: 2, 3: 8}).select("pair", "ts", "blocked")


@query(f"""WITH {S}, a AS (SELECT pair, ts, abs(z) AS a, coalesce(abs(z) >= 1.5, false)::INT AS b FROM signals)
SELECT pair, ts, coalesce(a < lag(a) OVER ({OVER}), false) AS slope, count(*) OVER ({OVER} ROWS 1 PRECEDING) >= 2 AND min(b) OVER ({OVER} ROWS 1 PRECEDING) = 1 AS confirmed,
 coalesce(a < max(a) OVER ({OVER} ROWS 2 PRECEDING), false) AND count(a) OVER ({OVER} ROWS 2 PRECEDING) >= 2 AS inflected, sum(b) OVER ({OVER} ROWS 4 PRECEDING) <= 4 AS not_stale FROM a""")
def entry_filters(spark, sf):
    """Falling, confirmed, turned and not stale signals."""
    return E.filters(X.signals(spark, sf), 1.5, 2, 2, 4).select("pair", "ts", "slope", "confirmed", "inflected", "not_stale")


@query(f"""WITH {S}, a AS (SELECT pair, ts, z, coalesce(abs(z) > 1.5, false) AS above, lag(z) OVER ({OVER}) AS b, row_number() OVER ({OVER}) AS k FROM signals),
 o AS (SELECT *, z - b AS v, max(CASE WHEN NOT above THEN k END) OVER ({OVER} ROWS 9 PRECEDING) AS o FROM a), n AS (SELECT *, CASE WHEN above THEN k - coalesce(o, greatest(k - 10, 0)) - 1 ELSE -1 END AS since FROM o),
 s AS (SELECT *, k >= 4 AND since BETWEEN 2 AND 10 AS inside FROM n), t AS (SELECT *, coalesce(inside AND z > 0 AND v < -0.05, false) AS peak, coalesce(inside AND z <= 0 AND v > 0.05, false) AS valley, coalesce(inside AND abs(z) < abs(b), false) AS reverting FROM s)
SELECT pair, ts, since::BIGINT AS bars_since, peak, valley, reverting, round(CASE WHEN peak OR valley THEN 0.4 * least(abs(v) / 0.2, 1) + 0.4 * least(CASE WHEN abs(b) > 1e-10 THEN (abs(b) - abs(z)) / abs(b) ELSE 0 END / 0.1, 1) + 0.2 * CASE WHEN since BETWEEN 3 AND 5 THEN 1 WHEN since < 3 THEN since / 3 ELSE greatest(0.2, 1 - (since - 5) / 5) END ELSE 0 END, 6) + 0.0 AS confidence FROM t""")
def inflection_points(spark, sf):
    """Turns of a run beyond the threshold, with a confidence."""
    return keep(E.inflection(X.signals(spark, sf), 1.5), "bars_since", "peak", "valley", "reverting", "confidence")


@query(f"""WITH {S}, r AS (SELECT pair, ts, CASE WHEN expected_profit IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY expected_profit NULLS LAST) + (count(expected_profit) OVER (PARTITION BY ts, expected_profit) - 1) / 2) / count(expected_profit) OVER (PARTITION BY ts) END AS r FROM signals)
SELECT pair, ts, round(r, 6) + 0.0 AS profit_rank, coalesce(r >= 0.5, false) AS top FROM r""")
def profit_rank(spark, sf):
    """Rank of a pair's expected profit in its bar."""
    return keep(E.best_of_bar(X.signals(spark, sf), 0.5), "profit_rank", "top")


@query(f"""WITH {X.PAIR_BARS} SELECT pair, ts, round(CASE WHEN count(x) OVER w >= 48 AND var_samp(x) OVER w > 1e-12 THEN covar_samp(y, x) OVER w / var_samp(x) OVER w END, 5) + 0.0 AS beta FROM pair_bars WINDOW w AS ({OVER} ROWS 47 PRECEDING)""")
def rolling_beta(spark, sf):
    """Rolling hedge ratio."""
    return rounded(X.pair_bars(spark, sf).select("pair", "ts", P.rolling_beta(48, F.col("y"), F.col("x")).alias("beta")), 5)


HALF = f"""l AS (SELECT *, lag(z) OVER ({OVER}) AS z1 FROM signals), h AS (SELECT *, CASE WHEN count(z1) OVER w >= 48 THEN greatest(50, least(500, -ln(2) / ln(greatest(0.01::DOUBLE, least(0.99::DOUBLE, covar_samp(z, z1) OVER w / var_samp(z) OVER w))))) END AS half_life FROM l WINDOW w AS ({OVER} ROWS 47 PRECEDING))"""


def with_half_life(spark, sf):
    """Signals with a rolling half-life, missing until it has 48 bars."""
    d = X.signals(spark, sf).withColumn("z1", F.lag("z").over(of_pair()))
    return d.withColumn("half_life", F.when(F.count("z1").over(X.rows(of_pair(), 48)) >= 48, E.rolling_half_life(48))).drop("z1")


def within(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x})) END"


def rounds(columns: dict[str, str], digits: int = 5) -> str:
    return ", ".join(f"round({x}, {digits}) + 0.0 AS {n}" for n, x in columns.items())


SCORE_FEATURES = {
    "z_score_abs": "abs(z)",
    "z_normalized": "(abs(z) - 1.5::DOUBLE) / 2.5::DOUBLE",
    "z_dist_from_optimal": "abs(abs(z) - 2.75::DOUBLE) / 2.5::DOUBLE",
    "z_velocity": "abs(v)",
    "is_expanding": "coalesce(z * v > 0, false)::INT::DOUBLE",
    "is_reverting": "coalesce(z * v < 0, false)::INT::DOUBLE",
    "is_fresh_extreme": "coalesce(abs(z) - abs(z3) >= -0.1::DOUBLE * 3, false)::INT::DOUBLE",
    "is_stale_signal": "coalesce(abs(z6) > abs(z) AND z * v < 0, false)::INT::DOUBLE",
    "z_acceleration": "abs(v - (z3 - z6) / 3) / 3",
    "expected_profit": within("expected_profit", -0.1, 0.1),
    "expected_hold_bars": within("expected_hold::DOUBLE", 0, 2000),
    "profit_per_bar": within("(expected_profit / nullif(expected_hold, 0))", -0.001, 0.001),
    "spread_volatility": "vol",
    "vol_trend": within("(vol / nullif(vm, 0))", 0.5, 2),
    "half_life_bars": "coalesce(half_life, 500)::DOUBLE",
    "half_life_normalized": within("(coalesce(half_life, 500) / 240)", 0.1, 5),
    "mean_reversion_rate": "ln(2) / greatest(60::DOUBLE, least(2000::DOUBLE, coalesce(half_life, 500)))",
    "kalman_gain": "0.5::DOUBLE",
    "beta_abs": within("abs(beta)", 0, 5),
    "beta_drift_recent": within("abs(beta - b24)", 0, 1),
    "rolling_zero_crosses": "crosses",
}


@query(f"""WITH {S}, {HALF}, a AS (SELECT *, lag(z, 3) OVER ({OVER}) AS z3, lag(z, 6) OVER ({OVER}) AS z6, lag(beta, 24) OVER ({OVER}) AS b24, CASE WHEN count(vol) OVER w = 24 THEN avg(vol) OVER w END AS vm, coalesce(z * z1 < 0, false)::INT AS c FROM h WINDOW w AS ({OVER} ROWS 23 PRECEDING)),
 f AS (SELECT *, (z - z3) / 3 AS v, CASE WHEN count(*) OVER p = 240 THEN sum(c) OVER p ELSE 0 END::DOUBLE AS crosses FROM a WINDOW p AS ({OVER} ROWS 239 PRECEDING))
SELECT pair, ts, {rounds(SCORE_FEATURES)} FROM f""")
def signal_features(spark, sf):
    """21 features of a signal for a score."""
    return rounded(T.for_scores(with_half_life(spark, sf), 1.5, 4.0), 5)


RISK_FEATURES = {
    "z_score_abs": "abs(z)",
    "z_normalized": "abs(z) / 1.5::DOUBLE",
    "z_velocity": "z - z3",
    "is_fresh_extreme": "coalesce(abs(z) > 1.5 AND abs(z1) <= 1.5, false)::INT::DOUBLE",
    "is_reverting": "coalesce(abs(z) < abs(z1) AND abs(z) > 0.5, false)::INT::DOUBLE",
    "spread_volatility": "vol",
    "spread_vol_ratio": within("(vol / greatest(mid, 1e-6))", 0.1, 10),
    "spread_autocorr_lag1": "CASE WHEN n = 24 THEN coalesce(ac, 0) ELSE 0 END::DOUBLE",
    "kalman_gain": "0.5::DOUBLE",
    "beta_drift_recent": "abs(beta - b24)",
    "half_life_normalized": "half_life / 240",
    "hours_since_last_trade": "24::DOUBLE",
    "recent_mae_same_pair": "0.01::DOUBLE",
    "vol_regime_pctl": "coalesce(vol_rank, 0.5)",
    "trend_autocorr": "coalesce(trend, 0)::DOUBLE",
}


@query(f"""WITH {X.RETURNS}, {S[len(X.BARS) + 2:]}, {HALF}, b AS (SELECT ts, ret, lag(ret) OVER (ORDER BY ts) AS r1 FROM returns WHERE symbol = 'click'),
 bw AS (SELECT ts, CASE WHEN count(ret) OVER w = 336 THEN round(stddev_samp(ret) OVER w, 9) END AS bv, CASE WHEN count(ret) OVER w = 336 THEN CASE WHEN stddev_samp(ret) OVER q * stddev_samp(r1) OVER q > 1e-12 THEN covar_samp(ret, r1) OVER q / (stddev_samp(ret) OVER q * stddev_samp(r1) OVER q) END END AS trend FROM b WINDOW w AS (ORDER BY ts ROWS 335 PRECEDING), q AS (ORDER BY ts ROWS 334 PRECEDING)),
 br AS (SELECT ts, trend, CASE WHEN bv IS NOT NULL THEN (rank() OVER (ORDER BY bv NULLS LAST) + (count(bv) OVER (PARTITION BY bv) - 1) / 2) / count(bv) OVER () END AS vol_rank FROM bw),
 a AS (SELECT *, z - z1 AS d, lag(z, 3) OVER ({OVER}) AS z3, lag(beta, 24) OVER ({OVER}) AS b24, quantile_cont(vol, 0.5) OVER (PARTITION BY pair) AS mid FROM h), c AS (SELECT *, lag(d) OVER ({OVER}) AS d1 FROM a),
 f AS (SELECT *, count(d) OVER w AS n, CASE WHEN stddev_samp(d) OVER q * stddev_samp(d1) OVER q > 1e-12 THEN covar_samp(d, d1) OVER q / (stddev_samp(d) OVER q * stddev_samp(d1) OVER q) END AS ac FROM c WINDOW w AS ({OVER} ROWS 23 PRECEDING), q AS ({OVER} ROWS 22 PRECEDING))
SELECT pair, f.ts, {rounds(RISK_FEATURES)} FROM f LEFT JOIN br ON f.ts = br.ts""")
def risk_features(spark, sf):
    """15 features for the risk of an entry, those of a benchmark's regime included."""
    return rounded(T.for_risk(with_half_life(spark, sf), T.benchmark_state(X.returns(spark, sf), "click"), 1.5), 5)


@query(f"""WITH {S}, d AS (SELECT pair, ts, spread - lag(spread) OVER ({OVER}) AS d FROM signals)
SELECT pair, ts, round(CASE WHEN count(d) OVER w = 12 THEN stddev_samp(d) OVER w END, 6) + 0.0 AS forward_vol, round(greatest(0, -min(d) OVER w), 6) + 0.0 AS worst_bar FROM d WINDOW w AS ({OVER} ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)""")
def forward_labels(spark, sf):
    """Volatility and worst move of the bars ahead."""
    ahead = of_pair().rowsBetween(1, 12)
    d = X.signals(spark, sf).withColumn("d", F.col("spread") - F.lag("spread").over(of_pair()))
    return keep(d, F.when(F.count("d").over(ahead) == 12, F.stddev_samp("d").over(ahead)).alias("forward_vol"), F.greatest(F.lit(0.0), -F.min("d").over(ahead)).alias("worst_bar"))


@query(f"""WITH {X.DAILY}, e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM daily), d AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd FROM e)
SELECT series, ts, round(CASE WHEN count(ret) OVER w >= 10 THEN greatest(0.5, least(1.5, 1 + 0.25 * (avg(ret) OVER w / CASE WHEN stddev_samp(ret) OVER w > 1e-12 THEN stddev_samp(ret) OVER w END))) ELSE 1 END, 5) + 0.0 AS performance, round(1 - 0.5 * greatest(0, least(1, (dd - 0.03) / 0.07)), 5) + 0.0 AS drawdown
FROM d WINDOW w AS (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING)""")
def size_factors(spark, sf):
    """Sizes follow performance and drawdown."""
    w = Window.partitionBy("series").orderBy("ts")
    all_ = w.rowsBetween(Window.unboundedPreceding, 0)
    d = X.daily(spark, sf).withColumn("equity", F.exp(F.sum(F.log(1 + F.col("ret"))).over(all_)))
    d = d.withColumn("dd", 1 - F.col("equity") / F.max("equity").over(all_))
    return rounded(d.select("series", "ts", Z.performance_factor(F.col("ret"), w, 20).alias("performance"), Z.drawdown_factor(F.col("dd")).alias("drawdown")), 5)


@query(f"""WITH {S}, w AS (SELECT pair, floor(date_diff('hour', TIMESTAMP '{X.START}', ts) / 168)::BIGINT AS week, ts, z, beta, sign(z) - sign(lag(z) OVER ({OVER})) AS flip FROM signals WHERE z IS NOT NULL)
SELECT pair, week, count(*) AS n, sum((abs(flip) = 2)::INT)::BIGINT AS crossings, round(abs(avg(z)), 6) + 0.0 AS mean_z, round(arg_max(beta, ts) - arg_min(beta, ts), 5) + 0.0 AS beta_drift, count(*) >= 10 AND sum((abs(flip) = 2)::INT) >= 5 AS healthy FROM w GROUP BY ALL""")
def weekly_health(spark, sf):
    """Crossings, drift and mean of each week."""
    return rounded(W.weekly_health(X.signals(spark, sf), X.START, 10, 5))


@query(f"WITH {S}, d AS (SELECT pair, ts, y - beta * x AS s FROM signals) SELECT pair, ts, round(s - lag(s) OVER ({OVER}), 5) + 0.0 AS change FROM d")
def spread_changes(spark, sf):
    """Changes of the hedged spread, those of the ratio included."""
    d = X.signals(spark, sf).withColumn("s", F.col("y") - F.col("beta") * F.col("x"))
    return rounded(d.select("pair", "ts", (F.col("s") - F.lag("s").over(of_pair())).alias("change")), 5)


@query(f"WITH {K} SELECT ts, round(spread, 6) + 0.0 AS spread, round(z, 6) + 0.0 AS z, entry_mask, exit_mask FROM masks WHERE pair = 'click-view'")
def pair_diagnosis(spark, sf):
    """All about one pair."""
    return rounded(X.masks(spark, sf).where("pair = 'click-view'").select("ts", "spread", "z", "entry_mask", "exit_mask"))


SCORES = X.TRADES + ", scores AS (SELECT window_id, pair, avg(net) * 100 AS score FROM trades GROUP BY ALL)"


def scores(spark, sf):
    return X.trades(spark, sf).groupBy("window_id", "pair").agg((F.avg("net") * 100).alias("score"))


@query(f"WITH {SCORES} SELECT window_id, pair, round(score, 6) + 0.0 AS score FROM scores WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY score DESC, pair) <= 10")
def top_scores(spark, sf):
    """each window's best pairs above a floor."""
    return rounded(E.top_scores(scores(spark, sf), ["window_id"], 10, 0.25))


@query(f"""WITH RECURSIVE {SCORES}, o AS (SELECT window_id, pair, split_part(pair, '-', 1) AS y, substr(pair, instr(pair, '-') + 1) AS x, row_number() OVER (PARTITION BY window_id ORDER BY round(-score, 9), pair) AS k FROM scores),
 f AS (SELECT DISTINCT window_id, 0::BIGINT AS k, []::VARCHAR[] AS legs, NULL::VARCHAR AS pair, false AS taken FROM o
  UNION ALL SELECT window_id, k, CASE WHEN ok THEN list_concat(legs, [y, x]) ELSE legs END, pair, ok FROM (SELECT o.*, f.legs, len(list_filter(f.legs, lambda v: v = o.y)) < 2 AND len(list_filter(f.legs, lambda v: v = o.x)) < 2 AS ok FROM f JOIN o ON f.window_id = o.window_id AND o.k = f.k + 1))
SELECT window_id, pair FROM f WHERE taken""")
def greedy_leg_cap(spark, sf):
    """F2: in order of score, at most two pairs with the same leg."""
    s = scores(spark, sf).withColumns({"coin_y": F.split("pair", "-", 2)[0], "coin_x": F.split("pair", "-", 2)[1], "rank": F.round(-F.col("score"), 9)})
    return E.greedy(s.select("window_id", "pair", "coin_y", "coin_x", "rank"), ["window_id"], ["rank", "pair"], 2).select("window_id", "pair")


@query(f"""WITH {SCORES}, o AS (SELECT window_id, pair, CASE WHEN pair[7] = '5' THEN 'none' ELSE pair[1:7] END AS cluster, round(-score, 9) AS place FROM scores)
SELECT window_id, pair, cluster FROM o QUALIFY cluster = 'none' OR row_number() OVER (PARTITION BY window_id, cluster ORDER BY place, pair) <= 3""")
def greedy_cluster_cap(spark, sf):
    """in order of score, at most three pairs in a cluster; pairs without a cluster are free."""
    s = scores(spark, sf).withColumns({"cluster": F.when(F.substring("pair", 7, 1) == "5", "none").otherwise(F.substring("pair", 1, 7)), "rank": F.round(-F.col("score"), 9)})
    return E.greedy(s.select("window_id", "pair", "cluster", "rank"), ["window_id"], ["rank", "pair"], 3, ["cluster"], free="none").select("window_id", "pair", "cluster")


@query(f"""WITH {K}, p AS (SELECT pair, ts, coin_y, coin_x, entry_mask, coalesce(abs(lag(z) OVER ({OVER})) > 1.2, false) AS active FROM masks), l AS (SELECT ts, coin, count(*) AS n FROM (SELECT ts, unnest([coin_y, coin_x]) AS coin FROM p WHERE active) GROUP BY ALL)
SELECT p.pair, p.ts, entry_mask AND greatest(coalesce(a.n, 0), coalesce(b.n, 0)) < 2 AS allowed FROM p LEFT JOIN l a ON p.ts = a.ts AND p.coin_y = a.coin LEFT JOIN l b ON p.ts = b.ts AND p.coin_x = b.coin""")
def leg_cap(spark, sf):
    """no entry with a leg that is in enough open positions."""
    m = X.masks(spark, sf).withColumn("active", F.coalesce(F.abs(F.lag("z").over(of_pair())) > 1.2, F.lit(False)))
    return E.leg_cap(m.select("pair", "ts", "coin_y", "coin_x", "entry_mask", "active"), 2).select("pair", "ts", "allowed")


@query(f"WITH {SCORES}, f AS (SELECT window_id, pair FROM scores WHERE score > 0) SELECT window_id, pair, seen FROM (SELECT *, count(*) OVER (PARTITION BY pair ORDER BY window_id RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS seen FROM f) WHERE seen >= 2")
def persistent_pairs(spark, sf):
    """pairs found in two of the last three windows."""
    return E.persistent(scores(spark, sf).where("score > 0").select("window_id", "pair"), 3, 2)


@query(f"""WITH {X.MASKS}, {X.windows_sql(10, 5, 3)} SELECT window_id, m.pair, m.ts, round(coalesce(z, 0), 6) + 0.0 AS z, entry_mask FROM masks m JOIN windows ON ts >= train_end AND ts < test_end""")
def window_union(spark, sf):
    """G1: signals of overlapping windows, told apart by window."""
    d = X.masks(spark, sf).join(F.broadcast(X.windows(spark, sf, 10, 5, 3)), F.expr("ts >= train_end and ts < test_end"))
    return rounded(d.select("window_id", "pair", "ts", F.coalesce("z", F.lit(0.0)).alias("z"), "entry_mask"))


@query(f"""WITH {SCORES}, l AS (SELECT window_id, pair FROM scores WHERE score > 0), s AS (SELECT window_id, pair FROM scores WHERE score > 1), b AS (SELECT * FROM l INTERSECT SELECT * FROM s)
SELECT window_id, pair, 'both' AS source FROM b UNION ALL SELECT window_id, pair, 'long' FROM l WHERE window_id NOT IN (SELECT window_id FROM b)""")
def consensus_pairs(spark, sf):
    """Pairs of both scans, or of the long one where they share none."""
    s = scores(spark, sf)
    return E.consensus(s.where("score > 0").select("window_id", "pair"), s.where("score > 1").select("window_id", "pair"), ["window_id"])


@query(f"WITH {X.TRADES} SELECT DISTINCT pair FROM trades ORDER BY pair")
def distinct_pairs(spark, sf):
    """All pairs, in order."""
    return X.trades(spark, sf).select("pair").distinct().orderBy("pair")


@query(f"""WITH {S}, h AS (SELECT pair, ts, z, vol, (24 * greatest(0.5, least(3, ln(greatest(abs(z) / 0.6, 1.01)))))::DOUBLE AS hold FROM signals)
SELECT pair, ts, round(4 * (0.6 * 0.0002 + 0.4 * 0.0005) + 4 * 0.0002 + 0.0004, 9) + 0.0 AS round_trip, round((abs(z) * vol * (1 - exp(-ln(2) / 24 * hold)) - 0.0028) * 0.5, 6) + 0.0 AS profit FROM h""")
def ou_profit(spark, sf):
    """H1, H2: round-trip cost, and what a reverting spread is expected to make."""
    d = X.signals(spark, sf)
    cost = 4 * (0.6 * 0.0002 + 0.4 * 0.0005) + 4 * 0.0002 + 0.0004
    return d.select("pair", "ts", F.lit(round(cost, 9)).alias("round_trip"), (F.round(E.ou_profit(F.col("z"), F.col("vol"), F.lit(24.0), 0.6, 0.0028), 6) + 0.0).alias("profit"))


@query(f"""WITH {S}, l AS (SELECT pair, ts, z, vol, lag(z) OVER ({OVER}) AS z1 FROM signals), p AS (SELECT pair, ts, z, vol, greatest(0.01::DOUBLE, least(0.99::DOUBLE, covar_samp(z, z1) OVER w / var_samp(z) OVER w)) AS phi, count(z1) OVER w AS n FROM l WINDOW w AS ({OVER} ROWS 47 PRECEDING)),
 h AS (SELECT *, CASE WHEN n >= 48 THEN greatest(50, least(500, -ln(2) / ln(phi))) END AS hl FROM p), f AS (SELECT *, least(coalesce(hl, 200) * greatest(0.5, least(3, ln(greatest(abs(z) / 0.6, 1.01)))), 96) AS hold FROM h)
SELECT pair, ts, round(hl, 4) + 0.0 AS half_life, round(hold, 4) + 0.0 AS hold, round(CASE WHEN z IS NOT NULL THEN 0.5 * greatest(-0.02, least(0.05, abs(z) * vol * (1 - exp(-ln(2) / coalesce(hl, 200) * hold)) - 0.0028 - 1e-6 * hold)) END, 6) + 0.0 AS profit FROM f""")
def rolling_half_life(spark, sf):
    """H3: half-life from the rolling coefficient of z on the z before, and the profit expected with it."""
    d = X.signals(spark, sf).withColumn("z1", F.lag("z").over(of_pair()))
    n = F.count("z1").over(X.rows(of_pair(), 48))
    d = d.withColumn("half_life", F.when(n >= 48, E.rolling_half_life(48)))
    profit, hold = E.ou_profit_v2(F.col("z"), F.col("vol"), F.coalesce("half_life", F.lit(200.0)), 0.6, 0.0028, 1e-6, 96.0, -0.02, 0.05)
    return d.select("pair", "ts", (F.round("half_life", 4) + 0.0).alias("half_life"), (F.round(hold, 4) + 0.0).alias("hold"), (F.round(profit, 6) + 0.0).alias("profit"))


@query(f"""WITH {S} SELECT pair, ts, coalesce(abs(z) > 1.5, false) AS gate_z, coalesce(expected_profit / (1 + abs(beta)) > 0.1, false) AS gate_profit, coalesce(abs(z) < 3, false) AS gate_bound, coalesce(vol >= 0.2, false) AS gate_vol,
 coalesce(abs(z) > 1.5, false) AND coalesce(expected_profit / (1 + abs(beta)) > 0.1, false) AND coalesce(abs(z) < 3, false) AND coalesce(vol >= 0.2, false) AS entry_mask, coalesce(abs(z) < 0.5 OR abs(z) > 3.5, false) AS exit_mask FROM signals""")
def entry_masks(spark, sf):
    """H4: entries and exits, gate by gate."""
    return E.masks(X.signals(spark, sf), 1.5, 0.5, 3.5, 3.0, 0.1, 0.2, beta=True).select("pair", "ts", "gate_z", "gate_profit", "gate_bound", "gate_vol", "entry_mask", "exit_mask")


@query(f"""WITH {S}, a AS (SELECT *, abs(z) AS a, coalesce(abs(z) > 0.8, false) AS above, lag(z) OVER ({OVER}) AS b, lag(z, 3) OVER ({OVER}) AS z3, row_number() OVER ({OVER}) AS k, expected_profit / (1 + abs(beta)) AS profit FROM signals),
 o AS (SELECT *, z - b AS v, (z - z3) / 3 AS velocity, max(CASE WHEN NOT above THEN k END) OVER ({OVER} ROWS 9 PRECEDING) AS o, CASE WHEN count(z * b) OVER w >= 24 AND stddev_samp(z) OVER w * stddev_samp(b) OVER w > 1e-12 THEN (avg(z * b) OVER w - avg(z) OVER w * avg(b) OVER w) / (stddev_samp(z) OVER w * stddev_samp(b) OVER w) END AS lag1 FROM a WINDOW w AS ({OVER} ROWS 23 PRECEDING)),
 n AS (SELECT *, CASE WHEN above THEN k - coalesce(o, greatest(k - 10, 0)) - 1 ELSE -1 END AS since FROM o),
 t AS (SELECT *, CASE WHEN k >= 4 AND since BETWEEN 2 AND 10 AND ((z > 0 AND v < -0.05) OR (z <= 0 AND v > 0.05)) THEN 0.4 * least(abs(v) / 0.2, 1) + 0.4 * least(CASE WHEN abs(b) > 1e-10 THEN (abs(b) - a) / abs(b) ELSE 0 END / 0.1, 1) + 0.2 * CASE WHEN since BETWEEN 3 AND 5 THEN 1 WHEN since < 3 THEN since / 3 ELSE greatest(0.2, 1 - (since - 5) / 5) END ELSE 0 END AS confidence,
  coalesce(0.35 * greatest(0, least(1, 1 - abs(a - 2.4) / 1.6)) + 0.25 * greatest(0, least(1, -sign(z) * velocity)) + 0.25 * greatest(0, least(1, profit / 0.02)) + 0.15 / (1 + vol), 0) AS score, greatest(1.2, 2 + 2 * 0.0028 / CASE WHEN vol > 1e-9 THEN vol END) AS dynamic_z,
  CASE WHEN profit >= 0.1 AND a >= 2.5 THEN -sign(z) * greatest(0, least(1, (a - 2.5) / 1)) ELSE 0 END AS size, coalesce(vol BETWEEN 0.2 AND 5, false) AS vol_ok FROM n),
 p AS (SELECT *, coalesce(profit > 0.1 AND a < 4 AND a > 0.8 AND abs(b) > 0.8 AND a < abs(b) AND z * velocity < 0 AND coalesce(lag1 <= 0.8, true) AND expected_hold BETWEEN 2 AND 12 AND confidence >= 0.5, false) AS gated, coalesce(profit > 0.1 AND a < 4 AND a > 0.8 AND score >= 0.55, false) AS scored,
  coalesce(profit > 0.1 AND a < 4 AND a > dynamic_z, false) AS dynamic, coalesce(abs(size) > 0.01, false) AS continuous FROM t)
SELECT pair, ts, round(size, 6) + 0.0 AS size, gated, scored, dynamic, continuous, vol_ok, (gated OR dynamic OR continuous) AND vol_ok AS by_gates, (scored OR dynamic OR continuous) AND vol_ok AS by_score FROM p""")
def entry_paths(spark, sf):
    """H4: entries by gates, by score, beyond a moving threshold, and by continuous exposure."""
    d = E.entry_paths(X.signals(spark, sf), 0.8, 4.0, 0.1, 0.55, 0.0028, (2, 12), (0.2, 5.0), 0.8, 24, base=2.0, sizes=(2.5, 3.5))
    return keep(d, "size", "gated", "scored", "dynamic", "continuous", "vol_ok", "by_gates", "by_score")


@query(f"""WITH {S}, v AS (SELECT *, (z - lag(z, 3) OVER ({OVER})) / 3 AS velocity FROM signals)
SELECT pair, ts, round(coalesce(0.35 * greatest(0, least(1, 1 - abs(abs(z) - 2.75) / 1.25)) + 0.25 * greatest(0, least(1, -sign(z) * velocity)) + 0.25 * greatest(0, least(1, expected_profit / 0.02)) + 0.15 / (1 + vol), 0), 6) + 0.0 AS score FROM v WHERE velocity IS NOT NULL""")
def signal_score(spark, sf):
    """H5: a score of four parts."""
    d = E.velocity(X.signals(spark, sf), 3).where("velocity is not null")
    return keep(d, E.signal_score(F.col("z"), F.col("velocity"), F.col("expected_profit"), F.col("vol"), 1.5, 4.0).alias("score"))


@query(f"""WITH {S} SELECT pair, ts, round(coalesce(-sign(z) * greatest(0, least(1, (abs(z) - 1) / 1.5)), 0), 6) + 0.0 AS exposure, round(greatest(1.2, 1.5 + 2 * 0.0028 / CASE WHEN vol > 1e-9 THEN vol END), 6) + 0.0 AS threshold FROM signals""")
def continuous_exposure(spark, sf):
    """H6: size by distance, and a threshold that costs move."""
    d = X.signals(spark, sf)
    return keep(d, E.exposure(F.col("z"), 1.0, 2.5).alias("exposure"), E.entry_threshold(F.col("vol"), 0.0028, 1.5, 1.2, 2.0).alias("threshold"))


@query(f"""WITH {X.MASKS}, {X.FUNDING}, t AS (SELECT *, avg(rate) OVER (PARTITION BY symbol ORDER BY ts ROWS 20 PRECEDING) AS mean FROM funding),
 c AS (SELECT m.*, -sign(z) * (fy.mean - fx.mean) / 8 * expected_hold AS cost FROM masks m ASOF LEFT JOIN t fy ON m.coin_y = fy.symbol AND m.ts >= fy.ts ASOF LEFT JOIN t fx ON m.coin_x = fx.symbol AND m.ts >= fx.ts)
SELECT pair, ts, round(cost, 8) + 0.0 AS cost, entry_mask AND NOT coalesce(cost > 0 AND expected_profit < 1.5 * cost, false) AS entry FROM c""")
def carry_filter(spark, sf):
    """H7: no entry whose funding eats its profit."""
    from tickloom.operators.asof import asof

    f = X.funding(spark, sf).withColumn("mean", F.avg("rate").over(X.rows(X.by_symbol(), 21)))
    m = X.masks(spark, sf)
    for leg in ("y", "x"):
        m = asof(m, f.select(F.col("symbol").alias(f"coin_{leg}"), "ts", F.col("mean").alias(f"m{leg}")), [f"coin_{leg}"], [f"m{leg}"])
    m = m.withColumn("cost", -F.signum("z") * (F.col("my") - F.col("mx")) / 8 * F.col("expected_hold"))
    return rounded(m.select("pair", "ts", "cost", (F.col("entry_mask") & ~E.no((F.col("cost") > 0) & (F.col("expected_profit") < 1.5 * F.col("cost")))).alias("entry")), 8)


@query(f"""WITH {X.TRADES}, p AS (SELECT pair, least(1, greatest(0, avg((net > 0)::INT))) AS s, avg((net > 0)::INT) AS wr, coalesce(avg(CASE WHEN net > 0 THEN net END), 0) AS w, coalesce(-avg(CASE WHEN net < 0 THEN net END), 0) AS l FROM trades GROUP BY pair)
SELECT pair, round(0.25 + 0.75 * s, 6) + 0.0 AS linear, round(0.25 + 0.75 * s * s, 6) + 0.0 AS power, round(0.25 + 0.75 * (exp(2 * s) - 1) / (exp(2) - 1), 6) + 0.0 AS exponential, round(0.25 + 0.75 / (1 + exp(-10 * (s - 0.5))), 6) + 0.0 AS sigmoid,
 round(0.25 + 0.75 * CASE WHEN s >= 0.75 THEN 1 WHEN s >= 0.5 THEN 0.66 WHEN s >= 0.25 THEN 0.33 ELSE 0 END, 6) + 0.0 AS stepped, round(greatest(0, least(1, 0.5 * (wr - (1 - wr) / CASE WHEN l > 1e-12 THEN w / l END))), 6) + 0.0 AS kelly FROM p""")
def conviction(spark, sf):
    """H9: sizes by conviction, on six curves."""
    p = L.ledger_stats(X.trades(spark, sf), total=False)
    s = F.col("win_rate")
    return rounded(p.select("pair", *(Z.conviction(s, m).alias(m) for m in ("linear", "power", "exponential", "sigmoid", "stepped")), Z.kelly(s, F.col("avg_win"), F.col("avg_loss")).alias("kelly")))


CORR = S + ", corr AS (SELECT a.pair AS pair_a, b.pair AS pair_b, corr(a.spread, b.spread) AS corr FROM signals a JOIN signals b ON a.ts = b.ts AND a.pair < b.pair GROUP BY ALL)"


@query(f"""WITH {CORR}, both_ AS (SELECT pair_a AS p, pair_b AS q, corr FROM corr UNION ALL SELECT pair_b, pair_a, corr FROM corr), m AS (SELECT p AS pair, max(abs(corr)) AS c FROM both_ WHERE q IN ('click-view', 'error-view') GROUP BY p)
SELECT s.pair, round(coalesce(c, 0), 5) + 0.0 AS max_corr, round(greatest(0.5, 1 - greatest(coalesce(c, 0) - 0.5, 0) / 0.5), 5) + 0.0 AS penalty FROM (SELECT DISTINCT pair FROM signals) s LEFT JOIN m USING (pair)""")
def correlation_penalty(spark, sf):
    """Smaller sizes for what moves like open positions."""
    s = X.signals(spark, sf)
    corr = P.correlated(s.select("ts", F.replace("pair", F.lit("-"), F.lit("/")).alias("symbol"), F.col("spread").alias("lp")), 0.0, 2).select(F.replace(F.split("pair", "-")[0], F.lit("/"), F.lit("-")).alias("pair_a"), F.replace(F.split("pair", "-")[1], F.lit("/"), F.lit("-")).alias("pair_b"), "corr")
    open_ = spark.createDataFrame([("click-view",), ("error-view",)], "pair string")
    return rounded(Z.correlation_penalty(s.select("pair").distinct(), open_, corr), 5)


@query(f"""WITH {X.TRADES}, p AS (SELECT pair, avg(greatest(-net, 0)) AS mae, stddev_samp(net) AS vol, avg((exit_reason = 3)::INT) AS stop, avg((net > 0)::INT) AS conf FROM trades GROUP BY pair),
 r AS (SELECT *, 0.4 * least(1, mae / 0.02) + 0.3 * least(1, vol / 0.1) + 0.3 * stop AS risk FROM p), s AS (SELECT *, CASE WHEN risk < 0.3 THEN 1 + 0.5 * (0.3 - risk) / 0.3 WHEN risk > 0.6 THEN 1 - 0.5 * (risk - 0.6) / 0.4 ELSE 1 END AS size FROM r)
SELECT pair, round(CASE WHEN conf < 0.5 THEN 1 + 0.5 * (size - 1) ELSE size END, 6) + 0.0 AS factor, CASE WHEN vol > 0.02 THEN 0.7 ELSE 1.2 END * CASE WHEN conf > 0.5 THEN 0.8 ELSE 1.0 END::DOUBLE AS regime FROM s""")
def risk_sizes(spark, sf):
    """Sizes by regime and by predicted risk."""
    p = X.trades(spark, sf).groupBy("pair").agg(F.avg(F.greatest(-F.col("net"), F.lit(0.0))).alias("mae"), F.stddev_samp("net").alias("vol"), F.avg((F.col("exit_reason") == 3).cast("int")).alias("stop"), F.avg((F.col("net") > 0).cast("int")).alias("conf"))
    regime = Z.regime_factor(F.when(F.col("vol") > 0.02, "high").otherwise("low"), F.when(F.col("conf") > 0.5, "trending").otherwise("flat"))
    return rounded(p.select("pair", Z.risk_factor(F.col("mae"), F.col("vol"), F.col("stop"), F.col("conf"), 0.01, 0.05).alias("factor"), regime.alias("regime")))


@query(f"""WITH {S}, e AS (SELECT pair, ts, vol, CASE WHEN abs(x) < 0.05 THEN 0 ELSE least(abs(x), 0.25) * sign(x) END AS s FROM (SELECT pair, ts, vol, coalesce(-sign(z) * greatest(0, least(1, (abs(z) - 1) / 1.5)), 0) AS x FROM signals)),
 w AS (SELECT *, 1 / greatest(coalesce(vol, quantile_cont(vol, 0.5) OVER (PARTITION BY ts)), 0.001) AS i, sum(abs(s)) OVER (PARTITION BY ts) AS t FROM e)
SELECT pair, ts, round(CASE WHEN t > 0.6 THEN s * 0.6 / t ELSE s END, 6) + 0.0 AS size, round(i / sum(i) OVER (PARTITION BY ts), 6) + 0.0 AS weight FROM w""")
def final_sizes(spark, sf):
    """Dust, single and total limits, and inverse-volatility weights."""
    d = X.signals(spark, sf).withColumn("size", E.exposure(F.col("z"), 1.0, 2.5))
    return keep(Z.inverse_vol(Z.clamped(d, "size", 0.25, 0.6, 0.05), "vol", 0.001), "size", "weight")


@query(f"""WITH {S}, e AS (SELECT pair, quantile_cont(vol, 0.5) AS v FROM signals GROUP BY pair), m AS (SELECT quantile_cont(v, 0.5) AS mid FROM e)
SELECT pair, round(0.02 * greatest(0.7, least(1.5, 1 / greatest(0.5, least(2, v / mid)))), 6) + 0.0 AS stop FROM e, m""")
def dynamic_stops(spark, sf):
    """Stops by volatility."""
    return rounded(Z.dynamic_stop(X.signals(spark, sf), 0.02))


@query(f"""WITH {K}, b AS (SELECT ts, sum(CASE WHEN abs(z) > 1 THEN 0.1 ELSE 0 END) AS exposure, sum((abs(z) > 1)::INT) AS n_active, sum(entry_mask::INT) AS n_pending FROM masks GROUP BY ts)
SELECT ts, round(greatest(0.25, least(2, 2 * sqrt(least(coalesce(n_active, 0) + n_pending, 8) / 8) * greatest(0.5 - exposure, 0) / 0.5)), 6) + 0.0 AS scale FROM b""")
def exposure_scale(spark, sf):
    """Sizes by what is open and pending."""
    m = X.masks(spark, sf)
    on = F.coalesce(F.abs("z") > 1, F.lit(False))
    b = m.groupBy("ts").agg(F.sum(F.when(on, 0.1).otherwise(0.0)).alias("exposure"), F.sum(on.cast("long")).alias("n_active"), F.sum(F.col("entry_mask").cast("long")).alias("n_pending"))
    return rounded(Z.exposure_scale(b, 0.5, 8).select("ts", "scale"))


@query(f"""WITH {X.TRADES}, p AS (SELECT pair, avg(net) AS e, avg((net > 0)::INT) AS w, avg((exit_reason = 3)::INT) AS s, avg(hold_bars) AS h, sum(fees + slippage) / (abs(sum(gross)) + sum(fees + slippage)) AS c, count(*) AS n, stddev_samp(net) AS v FROM trades GROUP BY pair)
SELECT pair, round(0.15 * greatest(0, least(1, e / 0.02)) + 0.2 * w + 0.15 * (1 - s) + 0.1 * greatest(0, least(1, 1 - h / 100)) + 0.15 * (1 - c) + 0.15 * least(1, n / 30) + 0.1 / (1 + 10 * v), 6) + 0.0 AS score FROM p""")
def pair_score(spark, sf):
    """A score of seven parts."""
    return rounded(W.pair_score(X.trades(spark, sf)))


@query(f"""WITH {X.DAILY}, sc AS (SELECT * FROM (VALUES ('base', 0.0, 0.0), ('drag', 0.0001, 0.0), ('stress', 0.0002, 0.0005)) t(scenario, drag, slip))
SELECT series, scenario, round(sum(ret - drag - CASE WHEN abs(ret) > 0.002 THEN slip ELSE 0 END), 6) + 0.0 AS total FROM daily, sc GROUP BY ALL""")
def cost_scenarios(spark, sf):
    """Returns under three cost scenarios."""
    return rounded(W.scenarios(X.daily(spark, sf), [("base", 0.0, 0.0), ("drag", 0.0001, 0.0), ("stress", 0.0002, 0.0005)], 0.002))


HEDGE = X.PAIR_BARS + ", h AS (SELECT pair, count(*) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM pair_bars GROUP BY pair), sp AS (SELECT pair, ts, y - beta * x - alpha AS spread FROM pair_bars JOIN h USING (pair))"


@query(f"WITH {HEDGE}, l AS (SELECT pair, spread, lag(spread) OVER ({OVER}) AS b FROM sp), k AS (SELECT pair, regr_slope(spread - b, b) AS s FROM l WHERE b IS NOT NULL GROUP BY pair) SELECT pair, n, round(beta, 5) + 0.0 AS beta, round(alpha, 5) + 0.0 AS alpha, round(CASE WHEN s < -1e-10 THEN -ln(2) / s ELSE 'inf'::DOUBLE END, 4) + 0.0 AS half_life FROM h JOIN k USING (pair)")
def hedge_ratios(spark, sf):
    """Hedge ratios and half-lives."""
    p = X.pair_bars(spark, sf)
    h = P.hedge(p)
    out = h.join(P.half_life(P.with_spread(p, h.drop("n"))), "pair")
    return out.select("pair", "n", (F.round("beta", 5) + 0.0).alias("beta"), (F.round("alpha", 5) + 0.0).alias("alpha"), (F.round("half_life", 4) + 0.0).alias("half_life"))


@query(f"""WITH {X.PAIR_BARS}, w AS (SELECT pair, y, x, pow(0.5, (row_number() OVER (PARTITION BY pair ORDER BY ts DESC) - 1) / 120) AS w FROM pair_bars), s AS (SELECT pair, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM w GROUP BY pair),
 b AS (SELECT *, (w * xy - x * y) / (w * xx - x * x) AS beta FROM s) SELECT pair, round(beta, 5) + 0.0 AS beta, round((y - beta * x) / w, 5) + 0.0 AS alpha FROM b""")
def weighted_hedge(spark, sf):
    """Hedge ratios that forget."""
    return rounded(P.weighted_hedge(X.pair_bars(spark, sf), 120), 5)


@query()
def rolling_stationarity(spark, sf):
    """I4: how often a pair's spread fails the test."""
    p = X.pair_bars(spark, sf)
    return P.rolling_stationarity(P.with_spread(p, P.hedge(p).drop("n")).select("pair", "ts", "spread"), 240, 34)


@query(f"""WITH {X.PAIR_BARS}, i AS (SELECT *, row_number() OVER ({OVER}) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM pair_bars), g AS (SELECT unnest(range(0, 100)) AS block), b AS (SELECT pair, block, regr_slope(y, x) AS beta FROM i JOIN g ON i >= block * 25 AND i < block * 25 + 100 AND block * 25 + 100 <= n GROUP BY ALL)
SELECT pair, count(*) AS n_blocks, round(stddev_pop(beta), 5) + 0.0 AS beta_std, round(max(beta) - min(beta), 5) + 0.0 AS beta_range, round(arg_max(beta, block) - arg_min(beta, block), 5) + 0.0 AS beta_drift FROM b WHERE beta IS NOT NULL GROUP BY pair""")
def beta_stability(spark, sf):
    """How hedge ratios move from block to block."""
    return rounded(P.block_betas(X.pair_bars(spark, sf), 100, 25).drop("beta_start"), 5)


@query(f"""WITH {X.PAIR_BARS}, i AS (SELECT pair, ts, y, x, least(floor((row_number() OVER ({OVER}) - 1) / greatest(floor(count(*) OVER (PARTITION BY pair) / 3), 1)), 2)::BIGINT AS part FROM pair_bars), h AS (SELECT pair, part, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM i GROUP BY ALL),
 s AS (SELECT pair, part, ts, y - beta * x - alpha AS s FROM i JOIN h USING (pair, part)), l AS (SELECT *, lag(s) OVER (PARTITION BY pair, part ORDER BY ts) AS b FROM s), k AS (SELECT pair, part, regr_slope(s - b, b) AS k FROM l WHERE b IS NOT NULL GROUP BY ALL),
 hl AS (SELECT pair, CASE WHEN k < -1e-10 THEN -ln(2) / k END AS hl FROM k) SELECT pair, count(*) AS parts, round(stddev_pop(hl) / avg(hl), 5) + 0.0 AS half_life_cv FROM hl GROUP BY pair""")
def subwindow_stability(spark, sf):
    """Half-lives of three parts of the data."""
    d = P.parts(X.pair_bars(spark, sf), 3)
    s = P.with_spread(d, P.hedge(d, ("pair", "part")).drop("n"), ("pair", "part"))
    h = P.half_life(s, ("pair", "part")).withColumn("hl", F.when(F.col("half_life") < float("inf"), F.col("half_life")))
    return rounded(h.groupBy("pair").agg(F.count("*").alias("parts"), (F.stddev_pop("hl") / F.avg("hl")).alias("half_life_cv")), 5)


@query(f"""WITH {X.TRADES}, t AS (SELECT pair, exp(-abs(avg(net) / stddev_samp(net) * sqrt(count(*)))) AS p_value FROM trades GROUP BY pair), r AS (SELECT *, row_number() OVER (ORDER BY p_value, pair) AS rank, count(*) OVER () AS m FROM t), s AS (SELECT *, rank / m * 0.2 AS threshold FROM r)
SELECT pair, round(p_value, 6) + 0.0 AS p_value, rank, round(threshold, 6) + 0.0 AS threshold, coalesce(rank <= (SELECT max(rank) FROM s WHERE p_value <= threshold), false) AS significant FROM s""")
def false_discovery(spark, sf):
    """I8: which of many tests stand."""
    t = X.trades(spark, sf).groupBy("pair").agg(F.exp(-F.abs(F.avg("net") / F.stddev_samp("net") * F.sqrt(F.count("*")))).alias("p_value"))
    return rounded(P.false_discovery(t, 0.2))


@query()
def platt_scaling(spark, sf):
    """Probabilities of scores, by a logistic curve and by a monotone one."""
    s = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id").select("doc_id", F.log1p("n_chars").alias("s"), F.col("quality").cast("double").alias("y"))
    a, b = M.platt(s)
    return M.isotonic(s.withColumn("platt", 1 / (1 + F.exp(F.lit(a) * F.col("s") + F.lit(b))))).select("doc_id", "platt", F.col("p").alias("isotonic"))


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, (SELECT count(*) FROM events) AS n FROM events), f AS (SELECT unnest(range(5))::INT AS fold), c AS (SELECT *, floor(n * 0.5) AS start, greatest(1, floor((n - floor(n * 0.5)) / 5)) AS size FROM o, f)
SELECT fold, CASE WHEN i < start + fold * size THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM c WHERE i < start + fold * size OR (i >= start + fold * size + 36 AND i < start + fold * size + size + 36) GROUP BY ALL""")
def purged_folds(spark, sf):
    """I16: expanding folds with a gap between training and test."""
    d = M.purged_folds(X.table(spark, sf, "events").select("event_id"), "event_id", 5, 36)
    return d.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(f"""WITH {X.BARS}, {X.windows_sql()} SELECT window_id, CASE WHEN ts < train_end THEN 'train' ELSE 'test' END AS role, symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(px), 6) + 0.0 AS mean_px FROM bars JOIN windows ON ts >= train_start AND ts < test_end GROUP BY ALL""")
def walk_forward(spark, sf):
    """Training and test parts of each window."""
    d = W.with_windows(X.bars(spark, sf), X.windows(spark, sf))
    return rounded(d.groupBy("window_id", "role", "symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("px").alias("mean_px")))


@query(f"""WITH {X.BARS}, {X.windows_sql()} SELECT window_id, count(*) AS n, round(avg(px), 6) + 0.0 AS mean_px FROM bars JOIN windows ON ts >= train_end - INTERVAL 3 DAY AND ts < train_end GROUP BY ALL""")
def short_term(spark, sf):
    """The last days of each training part."""
    d = W.with_windows(X.bars(spark, sf), X.windows(spark, sf), short_days=3).where("short")
    return rounded(d.groupBy("window_id").agg(F.count("*").alias("n"), F.avg("px").alias("mean_px")))


@query(f"""WITH {X.BARS}, c AS (SELECT lo + to_seconds(floor(0.7 * 3600 * (date_diff('hour', lo, hi) - 1))::BIGINT) AS t FROM span) SELECT CASE WHEN ts < t THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars, c GROUP BY ALL""")
def ratio_split(spark, sf):
    """A split in time that leaks nothing."""
    d = W.split(X.bars(spark, sf), 0.7)
    return d.groupBy("role").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query()
def trade_ledger(spark, sf):
    """K1: trades of each test window, no more than three at a time and one for each leg; a window's last bar closes what is open."""
    m = X.masks(spark, sf).join(F.broadcast(X.windows(spark, sf)), F.expr("ts >= train_end and ts < test_end"))
    return L.fold_trades(m, ["window_id"], 5e-4, 5e-4, 48, 0.5, {"portfolio": 3, "leg": 1})


@query(f"""WITH {K}, e AS (SELECT *, lead(ts, 6) OVER ({OVER}) AS xt, lead(y, 6) OVER ({OVER}) AS xy, lead(x, 6) OVER ({OVER}) AS xx FROM masks)
SELECT pair, ts, round(-sign(z) * ((xy - y) - beta * (xx - x)) / (1 + abs(beta)), 5) + 0.0 AS ret, date_diff('hour', ts, xt) AS hours FROM e WHERE entry_mask AND xt IS NOT NULL""")
def realised_returns(spark, sf):
    """K4: what entries made until six bars later."""
    d = X.masks(spark, sf).withColumns({"xt": F.lead("ts", 6).over(of_pair()), "xy": F.lead("y", 6).over(of_pair()), "xx": F.lead("x", 6).over(of_pair())}).where("entry_mask and xt is not null")
    ret = -F.signum("z") * ((F.col("xy") - F.col("y")) - F.col("beta") * (F.col("xx") - F.col("x"))) / (1 + F.abs("beta"))
    return rounded(d.select("pair", "ts", ret.alias("ret"), F.timestamp_diff("HOUR", F.col("ts"), F.col("xt")).alias("hours")), 5)


@query()
def regime_machine(spark, sf):
    """M4: states of the market by a machine with a cool-down."""
    from tickloom.streaming import regimes as G

    b = X.bars(spark, sf).where("symbol = 'click' and px > 0").select("symbol", "ts", "px")
    return G.states(b, 24, 96, 24)
