"""Queries of sources, predicates and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import asof as A
from tickloom.operators import universe as U
from tickloom.plans import fixtures as X
from tickloom.plans.catalog import query, rounded
from tickloom.sources import tables as T


@query(f"WITH {X.BARS} SELECT ts, symbol, round(close, 6) + 0.0 AS close FROM bars")
def wide_to_long(spark, sf):
    """A1: a wide price matrix becomes long rows."""
    wide = X.bars(spark, sf).groupBy("ts").pivot("symbol").agg(F.first("close"))
    return rounded(T.long_prices(wide))


@query("SELECT symbol, ts, count(*) AS n FROM (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts FROM events) GROUP BY ALL HAVING count(*) > 1")
def repeated_index(spark, sf):
    """A1: (ts, symbol) that a strict read rejects."""
    e = X.table(spark, sf, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("symbol"))
    return T.repeated_index(e)


@query(f"WITH {X.CANDLES} SELECT ts, symbol, round(close, 6) + 0.0 AS close, data_source FROM candles WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY AND data_source = 'okx'")
def scan_by_source(spark, sf):
    """A3: the last days of one source."""
    return rounded(T.scan(X.candles(spark, sf), F.lit("2024-01-31").cast("timestamp_ntz"), 10, "okx").select("ts", "symbol", "close", "data_source"))


@query(f"""WITH {X.BARS}, good AS (SELECT symbol FROM closes, span GROUP BY symbol, lo, hi HAVING count(*) >= 0.5 * date_diff('hour', lo, hi))
SELECT symbol, ts, round(px, 6) + 0.0 AS close FROM bars SEMI JOIN good USING (symbol)""")
def regular_export(spark, sf):
    """A4: complete bars of symbols with enough coverage, filled forward."""
    return rounded(T.regular(X.closes(spark, sf), X.grid(spark, sf), 0.5))


@query(f"""WITH {X.FUNDING} SELECT symbol, ts, round(last_value(rate IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS rate FROM funding""")
def funding_export(spark, sf):
    """A5: funding rates, filled forward."""
    fill = X.by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return rounded(X.funding(spark, sf).withColumn("rate", F.last("rate", True).over(fill)), 9)


@query("""SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL""")
def upsert_last(spark, sf):
    """Of rows with the same key the last to arrive stays."""
    e = X.table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value", "event_id")
    return T.latest(e, ["symbol", "ts"], ["event_id"])


@query("""WITH raw AS (SELECT ['hyperliquid', 'okx', 'coinbase', 'binance'][(user_id % 4 + 1)::INT] AS src, ['kPEPE', 'BTC', 'kBONK'][(event_id % 3 + 1)::INT] AS sym,
  event_id, value, (props->>'$.k')::BIGINT AS k FROM events),
scaled AS (SELECT *, CASE WHEN sym LIKE 'k%' AND src = 'okx' THEN 1000.0::DOUBLE WHEN sym LIKE 'k%' AND src = 'binance' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS f FROM raw)
SELECT TIMESTAMP '1970-01-01' + to_milliseconds(1704067200000 + event_id * 1000) AS ts, sym AS symbol, round(value * f, 6) + 0.0 AS close, round(k / f, 6) + 0.0 AS volume,
  round(CASE WHEN src = 'okx' THEN coalesce(k * value, 0) WHEN src = 'binance' THEN k * value ELSE (k / f) * (value * f) END, 6) + 0.0 AS turnover, src AS data_source FROM scaled""")
def normalised_candles(spark, sf):
    """Raw rows of four exchanges in one form."""
    e = X.table(spark, sf, "events").select("event_id", "value", F.from_json("props", "k long").alias("p"), F.expr("element_at(array('hyperliquid', 'okx', 'coinbase', 'binance'), cast(user_id % 4 + 1 as int))").alias("src"), F.expr("element_at(array('kPEPE', 'BTC', 'kBONK'), cast(event_id % 3 + 1 as int))").alias("sym"))
    return rounded(T.normalised(e, F.col("src"), F.col("sym"), F.lit(1704067200000) + F.col("event_id") * 1000, F.col("value"), F.col("p.k"), F.col("p.k") * F.col("value")))


@query(f"""WITH {X.CANDLES}, seen AS (SELECT symbol, max(ts) AS m FROM candles WHERE ts < TIMESTAMP '2024-01-20' AND symbol <> 'view' GROUP BY symbol)
SELECT symbol, count(*) AS n, min(ts) AS first_ts FROM candles LEFT JOIN seen USING (symbol) WHERE m IS NULL OR ts > m GROUP BY symbol""")
def resumed_load(spark, sf):
    """Only rows after what is loaded."""
    c = X.candles(spark, sf)
    loaded = c.where("ts < '2024-01-20' and symbol <> 'view'").groupBy("symbol").agg(F.max("ts").alias("max_ts"))
    return T.unseen(c, loaded).groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("SELECT r_name AS cluster, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS symbols FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def cluster_map(spark, sf):
    """A JSON map of clusters, to rows and back."""
    n = X.table(spark, sf, "nation").join(X.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    as_json = n.groupBy("r_name").agg(F.collect_list("n_name").alias("l")).select(F.to_json(F.create_map("r_name", "l")).alias("json"))
    return T.inverted(T.members(as_json)).select("cluster", F.array_join("symbols", ",").alias("symbols"))


@query("""SELECT DISTINCT p_brand AS symbol, CASE p_brand WHEN 'Brand#11' THEN NULL WHEN 'Brand#12' THEN 'B12-PERP' ELSE p_brand || 'USDT' END AS other, regexp_matches('k' || upper(p_brand), '^k[^a-z]*[A-Z][^a-z]*$') AS thousand FROM part""")
def symbol_names(spark, sf):
    """B1: names at an exchange, and thousand-unit tokens."""
    p = X.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return p.select("symbol", U.exchange_symbol(F.col("symbol"), "USDT", {"Brand#11": None, "Brand#12": "B12-PERP"}).alias("other"), U.thousand_units(F.concat(F.lit("k"), F.upper("symbol"))).alias("thousand"))


@query(f"""WITH {X.TRADES} SELECT DISTINCT pair, trim(split_part(pair, '-', 1)) AS coin_y, trim(substr(pair, instr(pair, '-') + 1)) AS coin_x, true AS ok FROM trades""")
def pair_legs(spark, sf):
    """B2: a pair's two legs."""
    a, b, ok = U.legs(F.col("pair"))
    return X.trades(spark, sf).select("pair").distinct().select("pair", a.alias("coin_y"), b.alias("coin_x"), ok.alias("ok"))


@query(f"""WITH {X.BARS} SELECT symbol, ts, round(CASE WHEN px > 0 THEN ln(px) END, 6) + 0.0 AS strict,
  round(ln(greatest(px, min(CASE WHEN px > 0 THEN px END) OVER (PARTITION BY symbol))), 6) + 0.0 AS clipped FROM bars""")
def log_prices(spark, sf):
    """Logarithms, strict and clipped."""
    return rounded(U.clipped_log(X.bars(spark, sf)).select("symbol", "ts", U.safe_log(F.col("px")).alias("strict"), F.col("lp").alias("clipped")))


@query(f"""WITH {X.BARS} SELECT symbol, first_ts, last_ts, n, days, coverage, days >= 20 AND coverage >= 0.5 AS ok FROM (
  SELECT *, CASE WHEN days > 0 THEN round(n / (days * 24), 3) ELSE 0 END AS coverage FROM (
    SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, floor(date_diff('second', min(ts), max(ts)) / 86400)::BIGINT AS days FROM closes GROUP BY symbol))""")
def availability(spark, sf):
    """How long and how densely a symbol is covered."""
    return U.availability(X.closes(spark, sf), 24, 20, 0.5)


@query("SELECT c_name AS symbol, c_acctbal AS volume FROM customer WHERE c_acctbal >= 5000 ORDER BY c_acctbal DESC, c_name LIMIT 50")
def most_liquid(spark, sf):
    """The symbols of most volume."""
    return U.most_liquid(X.table(spark, sf, "customer").select(F.col("c_name").alias("symbol"), F.col("c_acctbal").alias("volume")), 5000, 50)


VOLS = X.BARS + """, vols AS (SELECT symbol, stddev_samp(d) AS vol FROM (
  SELECT symbol, ln(px) - lag(ln(px)) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars WHERE px > 0) GROUP BY symbol)"""


def vols(spark, sf):
    d = X.bars(spark, sf).where("px > 0").withColumn("d", F.log("px") - F.lag(F.log("px")).over(X.by_symbol()))
    return d.groupBy("symbol").agg(F.stddev_samp("d").alias("vol"))


@query(f"""WITH {VOLS} SELECT symbol, round(vol, 6) + 0.0 AS vol, vol <= 100 AND vol <= (SELECT quantile_cont(vol, 0.9) FROM vols WHERE vol <= 100) AS keep FROM vols""")
def calm_symbols(spark, sf):
    """Symbols within the volatility cap and its upper decile."""
    return rounded(U.calm(vols(spark, sf), 100.0))


FSTATS = X.FUNDING + ", stats AS (SELECT symbol, avg(rate) AS mean_rate, count(rate) / 90 AS coverage FROM funding GROUP BY symbol)"


@query(f"""WITH {FSTATS} SELECT symbol, round(mean_rate, 9) + 0.0 AS mean_rate, round(coverage, 9) + 0.0 AS coverage, coverage >= 0.7 AND abs(mean_rate) <= 1e-5 AS keep FROM stats""")
def funding_stats(spark, sf):
    """Funding coverage and mean."""
    return rounded(U.funding_stats(X.funding(spark, sf), 90, 0.7, 1e-5), 9)


@query(f"""WITH {FSTATS} SELECT a.symbol AS coin_y, b.symbol AS coin_x, round(a.mean_rate - b.mean_rate, 9) + 0.0 AS net_rate FROM stats a JOIN stats b ON a.symbol < b.symbol WHERE abs(a.mean_rate - b.mean_rate) <= 1e-5""")
def funding_pairs(spark, sf):
    """Pairs whose legs pay about the same funding."""
    stats = U.funding_stats(X.funding(spark, sf), 90, 0.7, 1e-5)
    pairs = X.pair_bars(spark, sf).select("coin_y", "coin_x").distinct()
    return rounded(U.funding_pairs(pairs, stats, 1e-5), 9)


@query(f"""WITH {X.RETURNS} SELECT symbol, count(*) AS n, round(sum(ret), 6) + 0.0 AS total FROM returns
WHERE NOT (ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07') AND NOT (ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-21') GROUP BY symbol""")
def outside_events(spark, sf):
    """Figures without the bars of named intervals."""
    events = spark.createDataFrame([("2024-01-05", "2024-01-07"), ("2024-01-20", "2024-01-21")], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("start"), F.col("b").cast("timestamp_ntz").alias("end"))
    return rounded(U.outside(X.returns(spark, sf), events).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("ret").alias("total")))


FEATURES = X.RETURNS + """, feats AS (SELECT symbol, avg(ret) AS alpha, stddev_samp(ret) AS vol, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) / count(ret) AS volume_flow FROM returns GROUP BY symbol),
  features AS (SELECT symbol, alpha - 1 AS alpha, (vol - avg(vol) OVER ()) / stddev_samp(vol) OVER () AS volatility_z, volume_flow FROM feats)"""


def features(spark, sf):
    f = X.returns(spark, sf).groupBy("symbol").agg((F.avg("ret") - 1).alias("alpha"), F.stddev_samp("ret").alias("vol"), (F.sum(F.when(F.col("ret") > 0, 1).otherwise(0)) / F.count("ret")).alias("volume_flow"))
    over = f.agg(F.avg("vol").alias("m"), F.stddev_samp("vol").alias("s"))
    return f.join(F.broadcast(over)).select("symbol", "alpha", ((F.col("vol") - F.col("m")) / F.col("s")).alias("volatility_z"), "volume_flow")


@query(f"""WITH {FEATURES} SELECT a.symbol AS coin_y, b.symbol AS coin_x, coalesce((a.alpha < 0.5 AND b.alpha < 0.5) OR greatest(a.volatility_z, b.volatility_z) > 1.2 OR least(a.volume_flow, b.volume_flow) < 0.4, false) AS rejected
FROM features a JOIN features b ON a.symbol < b.symbol""")
def feature_filter(spark, sf):
    """Pairs rejected by what their legs look like."""
    pairs = X.pair_bars(spark, sf).select("coin_y", "coin_x").distinct()
    return U.by_features(pairs, features(spark, sf), alpha=0.5, vol_z=1.2)


@query(f"""WITH {X.TRADES} SELECT pair, round(ratio, 6) + 0.0 AS cost_ratio, round(stop_rate, 6) + 0.0 AS stop_rate, ratio > 0.8 OR stop_rate > 0.4 AS rejected FROM (
  SELECT pair, CASE WHEN abs(sum(gross)) > 1e-12 THEN (abs(sum(fees)) + abs(sum(slippage))) / abs(sum(gross)) ELSE 'inf'::DOUBLE END AS ratio, avg((exit_reason = 3)::INT) AS stop_rate FROM trades GROUP BY pair)""")
def history_filter(spark, sf):
    """Pairs rejected by what they cost and how often they were stopped."""
    return rounded(U.by_history(X.trades(spark, sf)))


@query(f"""WITH {X.BARS}, {X.windows_sql()} SELECT window_id, symbol, round(avg((close IS NOT NULL)::INT), 6) + 0.0 AS coverage FROM bars JOIN windows ON ts >= train_start AND ts < train_end GROUP BY ALL HAVING avg((close IS NOT NULL)::INT) >= 0.2""")
def window_coverage(spark, sf):
    """Symbols that cover enough of a window's training part."""
    return rounded(U.window_coverage(X.bars(spark, sf), X.windows(spark, sf), 0.2))


@query(f"""WITH {X.SIGNALS}, {X.FUNDING}, f AS (SELECT *, avg(rate) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_rate FROM funding),
 g AS (SELECT s.pair, s.ts, s.vol, s.z, fy.day_rate - fx.day_rate AS net FROM signals s ASOF LEFT JOIN f fy ON s.coin_y = fy.symbol AND s.ts >= fy.ts ASOF LEFT JOIN f fx ON s.coin_x = fx.symbol AND s.ts >= fx.ts),
 v AS (SELECT *, vol * 0.5 - 4 * 0.0007 - net * 24 * 2 AS ev FROM g)
SELECT pair, ts, round(ev, 6) + 0.0 AS ev, CASE WHEN vol IS NULL THEN 'no_vol' WHEN net IS NULL THEN 'no_funding' WHEN ev > 0.2 THEN 'ok' ELSE 'low_ev' END AS reason FROM v""")
def expected_value_gate(spark, sf):
    """Expected value of a signal after costs and the last day's funding; rejected rows stay, with a reason."""
    day = Window.partitionBy("symbol").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-86400, 0)
    f = X.funding(spark, sf).withColumn("day_rate", F.avg("rate").over(day))
    s = X.signals(spark, sf)
    for leg in ("y", "x"):
        s = A.asof(s, f.select(F.col("symbol").alias(f"coin_{leg}"), "ts", F.col("day_rate").alias(f"f{leg}")), [f"coin_{leg}"], [f"f{leg}"])
    s = s.withColumn("net", F.col("fy") - F.col("fx")).withColumn("ev", F.col("vol") * 0.5 - F.lit(4 * 0.0007) - F.col("net") * 24 * 2)
    reason = F.when(F.col("vol").isNull(), "no_vol").when(F.col("net").isNull(), "no_funding").when(F.col("ev") > 0.2, "ok").otherwise("low_ev")
    return rounded(s.select("pair", "ts", "ev", reason.alias("reason")))


@query(f"""WITH {X.DAILY}, e AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS equity FROM daily),
 d AS (SELECT *, 1 - equity / max(equity) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING) AS dd, stddev_samp(ret) OVER (PARTITION BY series ORDER BY ts ROWS 19 PRECEDING) AS vol FROM e)
SELECT series, ts, round(dd, 5) + 0.0 AS drawdown, round(least(CASE WHEN vol > 0 THEN 0.01 / vol ELSE 0 END, 1.5), 5) + 0.0 AS size, dd > 0.05 AS killed FROM d""")
def risk_limits(spark, sf):
    """Size by volatility under a leverage cap, drawdown from the peak, kill switch."""
    w = Window.partitionBy("series").orderBy("ts")
    all_ = w.rowsBetween(Window.unboundedPreceding, 0)
    d = X.daily(spark, sf).withColumns({"equity": F.exp(F.sum(F.log(1 + F.col("ret"))).over(all_)), "vol": F.stddev_samp("ret").over(X.rows(w, 20))})
    d = d.withColumn("drawdown", 1 - F.col("equity") / F.max("equity").over(all_))
    return rounded(d.select("series", "ts", "drawdown", F.least(F.when(F.col("vol") > 0, 0.01 / F.col("vol")).otherwise(0.0), F.lit(1.5)).alias("size"), (F.col("drawdown") > 0.05).alias("killed")), 5)


@query(f"""WITH {X.SPAN}, {X.CANDLES}, best AS (SELECT symbol, ts, arg_min(close, CASE data_source WHEN 'hyperliquid' THEN 1 WHEN 'okx' THEN 2 WHEN 'coinbase' THEN 3 ELSE 4 END) AS close,
  min(CASE data_source WHEN 'hyperliquid' THEN 1 WHEN 'okx' THEN 2 WHEN 'coinbase' THEN 3 ELSE 4 END) AS prio FROM candles GROUP BY symbol, ts),
 grid AS (SELECT symbol, unnest(range(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT symbol FROM candles), span),
 filled AS (SELECT symbol, ts, prio, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING) AS close FROM grid LEFT JOIN best USING (symbol, ts)),
 good AS (SELECT symbol FROM filled GROUP BY symbol HAVING avg((close IS NOT NULL)::INT) >= 0.3)
SELECT symbol, ts, round(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS close, coalesce(prio > 1, false) AS gap_filled FROM filled SEMI JOIN good USING (symbol)""")
def merged_sources(spark, sf):
    """The best source of each bar, short gaps filled, thin symbols dropped."""
    rank = F.expr("case data_source when 'hyperliquid' then 1 when 'okx' then 2 when 'coinbase' then 3 else 4 end")
    c = X.candles(spark, sf).withColumn("prio", rank)
    best = c.groupBy("symbol", "ts").agg(F.min_by("close", "prio").alias("close"), F.min("prio").alias("prio"))
    filled = X.hourly(c.select("symbol").distinct(), spark, sf).join(best, ["symbol", "ts"], "left").withColumn("close", F.last("close", True).over(X.rows(X.by_symbol(), 6)))
    share = F.avg(F.col("close").isNotNull().cast("int")).over(Window.partitionBy("symbol"))
    good = filled.withColumn("share", share).where("share >= 0.3")
    all_ = X.by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return rounded(good.select("symbol", "ts", F.last("close", True).over(all_).alias("close"), F.coalesce(F.col("prio") > 1, F.lit(False)).alias("gap_filled")))


@query(f"""WITH {X.BARS}, {X.FUNDING} SELECT ts, symbol, round(px, 6) + 0.0 AS px, round(coalesce(rate, 0), 9) + 0.0 AS rate FROM (
  SELECT b.*, rate, min((px IS NOT NULL)::INT) OVER (PARTITION BY b.ts) AS all_there FROM bars b LEFT JOIN funding f ON b.ts = f.ts AND b.symbol = f.symbol) WHERE all_there = 1""")
def candles_with_funding(spark, sf):
    """Complete bars with funding, 0 where there is none."""
    b = X.bars(spark, sf).join(X.funding(spark, sf), ["symbol", "ts"], "left")
    b = b.withColumn("there", F.min(F.col("px").isNotNull().cast("int")).over(Window.partitionBy("ts"))).where("there = 1")
    return b.select("ts", "symbol", (F.round("px", 6) + 0.0).alias("px"), (F.round(F.coalesce("rate", F.lit(0.0)), 9) + 0.0).alias("rate"))


@query(f"""WITH {X.PAIR_BARS}, {X.FUNDING} SELECT p.pair, p.ts, round((fy.rate - fx.rate) / 8, 10) + 0.0 AS per_bar
FROM pair_bars p ASOF LEFT JOIN funding fy ON p.coin_y = fy.symbol AND p.ts >= fy.ts ASOF LEFT JOIN funding fx ON p.coin_x = fx.symbol AND p.ts >= fx.ts""")
def asof_funding(spark, sf):
    """The funding in force at each bar, net of both legs, per bar."""
    f, p = X.funding(spark, sf), X.pair_bars(spark, sf)
    for leg in ("y", "x"):
        p = A.asof(p, f.select(F.col("symbol").alias(f"coin_{leg}"), "ts", F.col("rate").alias(f"r{leg}")), [f"coin_{leg}"], [f"r{leg}"])
    return rounded(p.select("pair", "ts", ((F.col("ry") - F.col("rx")) / 8).alias("per_bar")), 10)


WIDE = """wide AS (SELECT 'U' || (user_id % 12) AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_max(value, ts) AS close FROM events GROUP BY ALL)"""


@query(f"""WITH {WIDE} SELECT a.symbol || '-' || b.symbol AS pair, count(*) AS n, round(corr(ln(a.close + 1), ln(b.close + 1)), 6) + 0.0 AS corr FROM wide a JOIN wide b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1 HAVING count(*) >= 3 AND abs(corr(ln(a.close + 1), ln(b.close + 1))) >= 0.02""")
def candidate_pairs(spark, sf):
    """C4: correlated pairs of a dozen symbols, by a join of bars with bars of the same time."""
    from tickloom.operators.pairs import correlated

    prices = X.closes(spark, sf, "concat('U', user_id % 12)").select("ts", "symbol", F.log(F.col("close") + 1).alias("lp"))
    return rounded(correlated(prices, 0.02, 3))


@query(f"""WITH {X.MASKS}, ret AS (SELECT pair, ts, lead(spread) OVER (PARTITION BY pair ORDER BY ts) - spread AS ret FROM signals)
SELECT pair, ts, round(coalesce(z, 0), 6) + 0.0 AS z, round(coalesce(vol, 0), 6) + 0.0 AS vol, round(ret, 6) + 0.0 AS ret FROM masks LEFT JOIN ret USING (pair, ts) WHERE entry_mask""")
def training_rows(spark, sf):
    """Features of entries with the return that followed."""
    m = X.masks(spark, sf)
    ret = m.select("pair", "ts", (F.lead("spread").over(Window.partitionBy("pair").orderBy("ts")) - F.col("spread")).alias("ret"))
    return rounded(m.join(ret, ["pair", "ts"], "left").where("entry_mask").select("pair", "ts", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("vol", F.lit(0.0)).alias("vol"), "ret"))


@query(f"""WITH {X.PAIR_BARS}, p AS (SELECT DISTINCT pair, coin_y, coin_x FROM pair_bars) SELECT * FROM p WHERE coin_y <> 'error' AND coin_x <> 'error' AND coin_y IN ('click', 'purchase', 'error', 'signup') AND coin_x IN ('click', 'purchase', 'signup', 'view')""")
def listed_pairs(spark, sf):
    """Pairs with both legs listed and none blacklisted."""
    p = X.pair_bars(spark, sf).select("pair", "coin_y", "coin_x").distinct()
    known = spark.createDataFrame([("click",), ("purchase",), ("error",), ("signup",), ("view",)], "symbol string")
    return U.unlisted(U.listed(p, known), spark.createDataFrame([("error",)], "symbol string")).select("pair", "coin_y", "coin_x")


@query(f"""WITH {X.MASKS} SELECT pair, ts, min(CASE WHEN exit_mask THEN ts END) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS exit_ts FROM masks QUALIFY entry_mask""")
def next_exit(spark, sf):
    """The exit that follows each entry; none if the data end before."""
    after = Window.partitionBy("pair").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    return X.masks(spark, sf).withColumn("exit_ts", F.first(F.when(F.col("exit_mask"), F.col("ts")), True).over(after)).where("entry_mask").select("pair", "ts", "exit_ts")


@query(f"""WITH {X.TRADES}, a AS (SELECT pair, bool_or(hold_bars > 45) AS is_open FROM trades WHERE window_id = 0 GROUP BY pair HAVING sum(net) > 0), f AS (SELECT pair FROM trades WHERE window_id = 1 GROUP BY pair HAVING sum(net) > 0)
SELECT coalesce(a.pair, f.pair) AS pair, CASE WHEN a.pair IS NULL THEN 'add' WHEN f.pair IS NOT NULL THEN 'keep' WHEN a.is_open THEN 'retire' ELSE 'drop' END AS action FROM a FULL JOIN f ON a.pair = f.pair""")
def pair_changes(spark, sf):
    """What a new scan adds, keeps, retires and drops."""
    t = X.trades(spark, sf)
    good = lambda w: t.where(F.col("window_id") == w).groupBy("pair").agg(F.max(F.col("hold_bars") > 45).alias("is_open"), F.sum("net").alias("net")).where("net > 0")
    return U.changes(good(0), good(1))
