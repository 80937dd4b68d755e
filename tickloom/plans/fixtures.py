"""Candles, bars, pairs, signals and trades derived from the given tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where weeks and blocks of hours begin to count.
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_symbol(order: str = "ts", *keys: str) -> Window:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def rows(window: Window, n: int) -> Window:
    """The last n rows, this one included."""
    return window.rowsBetween(1 - n, 0)


def candles(spark: SparkSession, sf: str, symbol: str = "event_type") -> DataFrame:
    """(symbol, ts, data_source, open, high, low, close, volume, turnover) by the hour."""
    e = table(spark, sf, "events").select(F.expr(symbol).alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "value", F.expr("element_at(array('hyperliquid', 'okx', 'coinbase', 'binance'), cast(user_id % 4 + 1 as int))").alias("data_source"))
    out = e.groupBy("symbol", F.col("hour").alias("ts_hour"), "data_source").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("turnover")
    )
    return out.withColumnRenamed("ts_hour", "ts")


CANDLES = """candles AS (
  SELECT symbol, hour AS ts, data_source, arg_min(value, t) AS open, max(value) AS high, min(value) AS low, arg_max(value, t) AS close,
         count(*)::DOUBLE AS volume, sum(value) AS turnover
  FROM (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS hour, ts AS t, value,
               ['hyperliquid', 'okx', 'coinbase', 'binance'][(user_id % 4 + 1)::INT] AS data_source FROM events)
  GROUP BY symbol, hour, data_source)"""


def span(spark: SparkSession, sf: str) -> DataFrame:
    """(lo, hi): the first day with events, and the day after the last. One row, so it may go to all tasks."""
    day = lambda c: F.date_trunc("day", c).cast("timestamp_ntz")
    return table(spark, sf, "events").agg(day(F.min("ts")).alias("lo"), (day(F.max("ts")) + F.expr("interval '1' day")).alias("hi"))


SPAN = "span AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS lo, date_trunc('day', max(ts))::TIMESTAMP + INTERVAL 1 DAY AS hi FROM events)"
#: The hours of a span.
EACH_HOUR = "sequence(lo, hi - interval '1' hour, interval '1' hour)"


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return span(spark, sf).select(F.explode(F.expr(EACH_HOUR)).alias("ts"))


def hourly(symbols: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """symbols at each hour of the span."""
    return symbols.join(F.broadcast(span(spark, sf))).select(*symbols.columns, F.explode(F.expr(EACH_HOUR)).alias("ts"))


def closes(spark: SparkSession, sf: str, symbol: str = "event_type") -> DataFrame:
    """(symbol, ts, close): the last value of each hour."""
    return table(spark, sf, "events").groupBy(F.expr(symbol).alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max_by("value", "ts").alias("close")).withColumnRenamed("hour", "ts")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, ts, close, px) on the full grid; px is the last known close."""
    c = closes(spark, sf)
    return hourly(c.select("symbol").distinct(), spark, sf).join(c, ["symbol", "ts"], "left").withColumn("px", F.last("close", True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))


BARS = f"""{SPAN},
closes AS (
  SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, arg_max(value, ts) AS close FROM events GROUP BY ALL),
grid AS (SELECT symbol, unnest(range(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT symbol FROM closes), span),
bars AS (
  SELECT symbol, ts, close, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS px
  FROM grid LEFT JOIN closes USING (symbol, ts))"""


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, ts, px, ret): ret is the change of px, by a positive px before."""
    before = F.lag("px").over(by_symbol())
    return bars(spark, sf).withColumn("ret", F.when(before > 0, F.col("px") / before - 1))


RETURNS = BARS + """,
returns AS (
  SELECT symbol, ts, close, px, CASE WHEN b > 0 THEN px / b - 1 END AS ret
  FROM (SELECT *, lag(px) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM bars))"""


def pair_bars(spark: SparkSession, sf: str) -> DataFrame:
    """(pair, ts, coin_y, coin_x, y, x): logarithms of positive prices of both legs, coin_y before coin_x by name."""
    b = bars(spark, sf).where("px > 0").select("ts", "symbol", F.log("px").alias("lp"))
    y, x = b.select("ts", F.col("symbol").alias("coin_y"), F.col("lp").alias("y")), b.select("ts", F.col("symbol").alias("coin_x"), F.col("lp").alias("x"))
    return y.join(x, "ts").where("coin_y < coin_x").select(F.concat_ws("-", "coin_y", "coin_x").alias("pair"), "ts", "coin_y", "coin_x", "y", "x")


PAIR_BARS = BARS + """,
lp AS (SELECT ts, symbol, ln(px) AS lp FROM bars WHERE px > 0),
pair_bars AS (
  SELECT a.symbol || '-' || b.symbol AS pair, a.ts, a.symbol AS coin_y, b.symbol AS coin_x, a.lp AS y, b.lp AS x
  FROM lp a JOIN lp b ON a.ts = b.ts AND a.symbol < b.symbol)"""


def signals(spark: SparkSession, sf: str, n: int = 24) -> DataFrame:
    """pair_bars with spread, z, vol (rolling deviation, full windows only), beta, expected_profit and expected_hold."""
    w = rows(Window.partitionBy("pair").orderBy("ts"), n)
    s = pair_bars(spark, sf).withColumn("spread", F.col("y") - F.col("x"))
    full = F.count("spread").over(w) >= n
    s = s.withColumns({"vol": F.when(full, F.stddev_samp("spread").over(w)), "mid": F.when(full, F.avg("spread").over(w)), "beta": F.when(full & (F.var_samp("x").over(w) > 1e-12), F.covar_samp("y", "x").over(w) / F.var_samp("x").over(w))})
    s = s.withColumn("z", F.when(F.col("vol") > 1e-9, (F.col("spread") - F.col("mid")) / F.col("vol")))
    return s.drop("mid").withColumns({"expected_profit": F.abs("z") * F.col("vol") * 0.5 - 0.0028, "expected_hold": F.floor(24 / (1 + F.abs("z")))})


SIGNALS = PAIR_BARS + """,
signals AS (
  SELECT pair, ts, coin_y, coin_x, y, x, spread, vol, beta, z, abs(z) * vol * 0.5 - 0.0028 AS expected_profit, floor(24 / (1 + abs(z)))::BIGINT AS expected_hold
  FROM (SELECT *, CASE WHEN vol > 1e-9 THEN (spread - mid) / vol END AS z
        FROM (SELECT pair, ts, coin_y, coin_x, y, x, spread, CASE WHEN n >= 24 THEN sd END AS vol, CASE WHEN n >= 24 THEN av END AS mid,
                     CASE WHEN n >= 24 AND vx > 1e-12 THEN cv / vx END AS beta
              FROM (SELECT *, count(spread) OVER w AS n, stddev_samp(spread) OVER w AS sd, avg(spread) OVER w AS av,
                           covar_samp(y, x) OVER w AS cv, var_samp(x) OVER w AS vx
                    FROM (SELECT *, y - x AS spread FROM pair_bars) WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS 23 PRECEDING)))))"""


def masks(spark: SparkSession, sf: str, entry: float = 1.5, leave: float = 0.5) -> DataFrame:
    """signals with entry_mask and exit_mask, false where z is missing."""
    return signals(spark, sf).withColumns({"entry_mask": F.coalesce(F.abs("z") > entry, F.lit(False)), "exit_mask": F.coalesce(F.abs("z") < leave, F.lit(False))})


MASKS = SIGNALS + """,
masks AS (SELECT *, coalesce(abs(z) > 1.5, false) AS entry_mask, coalesce(abs(z) < 0.5, false) AS exit_mask FROM signals)"""


def funding(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, ts, rate) for every eight hours."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("symbol"), F.window(F.col("ts").cast("timestamp"), "8 hours").start.cast("timestamp_ntz").alias("t8")).agg(((F.avg("value") - 50) / 1e5).alias("rate")).withColumnRenamed("t8", "ts")


FUNDING = """funding AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2024-01-01')::TIMESTAMP AS ts, (avg(value) - 50) / 1e5 AS rate FROM events GROUP BY ALL)"""


def trades(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    """(window_id, pair, trade_seq, entry_ts, exit_ts, hold_bars, exit_reason, gross, fees, slippage, net), one per line item.

    exit_reason: 1 signal, 2 time, 3 stop, 4 forced. The sequence is by window, then by all other figures. Pairs are dealt over so many tasks, if named.
    """
    t = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    t = t.select(
        (F.year("l_shipdate") - 1995).cast("long").alias("window_id"), F.concat_ws("-", "p_brand", F.replace("p_type", F.lit(" "), F.lit("_"))).alias("pair"), F.col("l_shipdate").alias("entry_ts"),
        F.col("l_quantity").cast("long").alias("hold_bars"), (1 + F.col("l_linenumber") % 4).cast("long").alias("exit_reason"), ((F.col("l_discount") - 0.05) * F.col("l_extendedprice") / 1e5).alias("gross"),
        F.lit(5e-4).alias("fees"), F.lit(5e-4).alias("slippage"), "l_orderkey", "l_linenumber", "l_suppkey",
    )
    t = t.withColumns({"net": F.col("gross") - F.col("fees") - F.col("slippage"), "exit_ts": F.col("entry_ts") + F.expr("make_dt_interval(0, hold_bars)")})
    t = t.repartition(tasks, "pair") if tasks else t
    order = Window.partitionBy("pair").orderBy("window_id", "entry_ts", "l_orderkey", "l_linenumber", "l_suppkey", "gross", "hold_bars")
    return t.withColumn("trade_seq", F.row_number().over(order).cast("long")).drop("l_orderkey", "l_linenumber", "l_suppkey")


TRADES = """trades AS (
  SELECT *, row_number() OVER (PARTITION BY pair ORDER BY window_id, entry_ts, l_orderkey, l_linenumber, l_suppkey, gross, hold_bars) AS trade_seq
  FROM (SELECT *, gross - fees - slippage AS net, entry_ts + to_hours(hold_bars::INT) AS exit_ts
        FROM (SELECT (year(l_shipdate) - 1995)::BIGINT AS window_id, p_brand || '-' || replace(p_type, ' ', '_') AS pair, l_shipdate AS entry_ts, l_quantity::BIGINT AS hold_bars,
                     (1 + l_linenumber % 4)::BIGINT AS exit_reason, (l_discount - 0.05) * l_extendedprice / 1e5 AS gross, 5e-4::DOUBLE AS fees, 5e-4::DOUBLE AS slippage,
                     l_orderkey, l_linenumber, l_suppkey
              FROM lineitem JOIN part ON l_partkey = p_partkey)))"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(series, ts, ret): daily returns of five series made of orders."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(((F.avg("o_totalprice") / 200000 - 1) / 100).alias("ret"))


DAILY = "daily AS (SELECT o_orderpriority AS series, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, (avg(o_totalprice) / 200000 - 1) / 100 AS ret FROM orders GROUP BY ALL)"


def windows(spark: SparkSession, sf: str, train: int = 10, test: int = 5, step: int = 5) -> DataFrame:
    """(window_id, train_start, train_end, test_end): all that fit into the span, in days."""
    n = F.floor((F.date_diff("hi", "lo") - (train + test)) / step) + 1
    after = lambda days: (F.col("lo") + F.make_dt_interval(F.col("window_id").cast("int") * step + days)).cast("timestamp_ntz")
    d = span(spark, sf).where(n > 0).select("lo", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("window_id"))
    return d.select("window_id", after(0).alias("train_start"), after(train).alias("train_end"), after(train + test).alias("test_end"))


def windows_sql(train: int = 10, test: int = 5, step: int = 5) -> str:
    """windows, which needs span."""
    return f"""windows AS (
  SELECT w AS window_id, lo + to_days((w * {step})::INT) AS train_start, lo + to_days((w * {step} + {train})::INT) AS train_end, lo + to_days((w * {step} + {train + test})::INT) AS test_end
  FROM (SELECT lo, unnest(range(greatest(0, (date_diff('day', lo, hi) - {train + test}) // {step} + 1))) AS w FROM span WHERE date_diff('day', lo, hi) >= {train + test}))"""
