"""Queries of what runs write and read again, of streams, and of the data of charts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import ledger as L
from tickloom.operators import pairs as P
from tickloom.plans import fixtures as X
from tickloom.plans.catalog import query, rounded
from tickloom.plans.ledgers import STATS, STATS_ROUND, T
from tickloom.plans.signals import REGIME
from tickloom.sources import runs as R
from tickloom.streaming import ticks as K


@query(f"""WITH {X.MASKS}, {X.windows_sql()} SELECT 'r1' AS run_id, window_id, pair, ts, round(z, 6) + 0.0 AS z, round(vol, 6) + 0.0 AS vol, entry_mask, exit_mask FROM masks JOIN windows ON ts >= train_end AND ts < test_end WHERE window_id IN (0, 2)""")
def run_artifacts(spark, sf):
    """Signals and masks of a run, written by window and read again, two windows of it."""
    path = R.new_folder(spark)
    d = X.masks(spark, sf).join(F.broadcast(X.windows(spark, sf)), F.expr("ts >= train_end and ts < test_end")).withColumn("run_id", F.lit("r1"))
    R.write_run(d.select("run_id", "window_id", "pair", "ts", "z", "vol", "entry_mask", "exit_mask"), path)
    got = R.read_run(spark, path, "r1", [0, 2], ["run_id", "window_id", "pair", "ts", "z", "vol", "entry_mask", "exit_mask"])
    return rounded(got.withColumn("window_id", F.col("window_id").cast("long")))


@query(f"""WITH {T} SELECT window_id, pair, trade_seq, entry_ts AS ts, round(net, 6) + 0.0 AS net, exit_reason FROM trades WHERE entry_ts >= TIMESTAMP '1997-01-01'""")
def trade_history(spark, sf):
    """A10: trades appended to a history, read from a time on."""
    path = R.new_folder(spark)
    t = X.trades(spark, sf).select("window_id", "pair", "trade_seq", F.col("entry_ts").alias("ts"), "net", "exit_reason")
    R.append_trades(t, path)
    spark.createDataFrame([("not json",), ('{"pair": "no time"}',)], "value string").write.mode("append").text(path)
    return rounded(R.read_trades(spark, path, t.schema, F.lit("1997-01-01").cast("timestamp_ntz")))


@query(f"WITH {T} SELECT pair, {STATS_ROUND} FROM (SELECT pair, {STATS} FROM trades GROUP BY pair)")
def report_sink(spark, sf):
    """The ledger's report as CSV and JSON, read again; both hold the same."""
    path = R.new_folder(spark)
    report = L.ledger_stats(X.trades(spark, sf), total=False)
    R.write_report(report, path)
    both = [rounded(R.read_report(spark, path, report.schema, kind)) for kind in ("csv", "json")]
    return both[0].intersect(both[1])


@query(f"""WITH {T}, w AS (SELECT window_id, sum(net) AS net, count(*) AS trades, avg((net > 0)::INT) AS win_rate FROM trades GROUP BY window_id)
SELECT 'run' || window_id AS run_id, round(net, 6) + 0.0 AS net, trades, CASE WHEN window_id % 2 = 0 THEN round(win_rate, 6) + 0.0 END AS win_rate, row_number() OVER (ORDER BY round(net, 6) DESC, window_id) AS rank FROM w""")
def run_comparison(spark, sf):
    """Metrics of several runs side by side, each from its own folder; some lack a metric."""
    path = R.new_folder(spark)
    w = X.trades(spark, sf).groupBy("window_id").agg(F.sum("net").alias("net"), F.count("*").alias("trades"), F.avg((F.col("net") > 0).cast("int")).alias("win_rate"))
    metrics = w.withColumn("win_rate", F.when(F.col("window_id") % 2 == 0, F.col("win_rate"))).withColumn("run", F.concat(F.lit("run"), "window_id"))
    metrics.write.partitionBy("run").json(path)
    got = R.compared(spark, [f"{path}/run=*"]).withColumn("run_id", F.replace("run_id", F.lit("run="), F.lit("")))
    got = rounded(got.select("run_id", "net", "trades", "win_rate", "window_id"))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("net"), "window_id")).cast("long")).drop("window_id")  # a row for each run


def streamed(spark, sf):
    """The events as a stream of (event_id, symbol, ts, value); watermarks need TIMESTAMP."""
    schema = X.table(spark, sf, "events").schema
    e = R.stream_of(spark, f"{sf}/events.parquet", schema)
    return e.select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")


def landed(stream, spark):
    """What a stream writes until all that is there is read, as a table."""
    path = R.new_folder(spark)
    landing(stream, path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def landing(stream, path):
    """Starts a stream that writes all that is there to {path}/out."""
    return stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()


@query("""WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2024-01-01')::TIMESTAMP AS start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY ALL)
SELECT symbol, start, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, n FROM b WHERE start + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_bars(spark, sf):
    """M6: four-hour bars of live ticks, once the watermark has passed them."""
    out = landed(K.live_bars(streamed(spark, sf), "4 hours", "1 hour"), spark)
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("""SELECT event_id, event_type AS symbol, ts, round(value, 6) + 0.0 AS value FROM events""")
def stream_once(spark, sf):
    """M7: rows that come twice pass once; those later than the watermark would go the way of `upsert_last`."""
    s = streamed(spark, sf)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return rounded(landed(K.once(twice, ["event_id"], "30 days"), spark).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(f"""WITH {T} SELECT exit_reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share, round(sum(net), 6) + 0.0 AS net FROM trades GROUP BY exit_reason""")
def exit_reasons(spark, sf):
    """The data of a chart, shares of exit reasons."""
    g = X.trades(spark, sf).groupBy("exit_reason").agg(F.count("*").alias("n"), F.sum("net").alias("net"))
    return rounded(g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())))  # a row for each reason


@query(f"""WITH {T}, w AS (SELECT window_id, sum(net) AS net, count(*) AS trades, avg((net > 0)::INT) AS win_rate FROM trades GROUP BY window_id)
SELECT window_id, round(net, 6) + 0.0 AS net, trades, round(win_rate, 6) + 0.0 AS win_rate, round(sum(net) OVER (ORDER BY window_id), 6) + 0.0 AS cumulative FROM w""")
def walk_forward_progression(spark, sf):
    """The data of a chart, each window's result and their running sum."""
    w = X.trades(spark, sf).groupBy("window_id").agg(F.sum("net").alias("net"), F.count("*").alias("trades"), F.avg((F.col("net") > 0).cast("int")).alias("win_rate"))
    return rounded(w.withColumn("cumulative", F.sum("net").over(Window.orderBy("window_id"))))  # a row for each window


@query(f"""WITH {T}, s AS (SELECT sum(gross) AS gross, sum(fees) AS fees, sum(slippage) AS slippage, sum(net) AS net FROM trades)
SELECT step, label, round(amount, 6) + 0.0 AS amount, round(level, 6) + 0.0 AS level FROM (SELECT unnest([0, 1, 2, 3])::BIGINT AS step, unnest(['gross', 'fees', 'slippage', 'net']) AS label, unnest([gross, -fees, -slippage, net]) AS amount, unnest([gross, gross - fees, gross - fees - slippage, net]) AS level FROM s)""")
def pnl_waterfall(spark, sf):
    """The data of a chart, from gross to net."""
    s = X.trades(spark, sf).agg(*(F.sum(c).alias(c) for c in ("gross", "fees", "slippage", "net")))
    bars, level = [], F.lit(0.0)
    for k, (name, amount) in enumerate((("gross", F.col("gross")), ("fees", -F.col("fees")), ("slippage", -F.col("slippage")))):
        level = level + amount
        bars.append(F.struct(F.lit(k).cast("long").alias("step"), F.lit(name).alias("label"), amount.alias("amount"), level.alias("level")))
    bars.append(F.struct(F.lit(3).cast("long").alias("step"), F.lit("net").alias("label"), F.col("net").alias("amount"), F.col("net").alias("level")))
    return rounded(s.select(F.explode(F.array(*bars)).alias("b")).select("b.*"))


@query(f"""WITH {T}, s AS (SELECT pair, window_id, sum(net) AS net, count(*) AS trades FROM trades GROUP BY ALL)
SELECT pair, window_id, round(net, 6) + 0.0 AS net, trades, rank() OVER (PARTITION BY window_id ORDER BY round(net, 6) DESC) AS place FROM s""")
def pair_heatmap(spark, sf):
    """The data of a chart, pairs by windows."""
    s = rounded(X.trades(spark, sf).groupBy("pair", "window_id").agg(F.sum("net").alias("net"), F.count("*").alias("trades")))
    return s.withColumn("place", F.rank().over(Window.partitionBy("window_id").orderBy(F.desc("net"))).cast("long"))


@query(f"""WITH {X.DAILY} SELECT a.series AS series_a, b.series AS series_b, round(corr(a.ret, b.ret), 5) + 0.0 AS corr, count(*) AS n FROM daily a JOIN daily b ON a.ts = b.ts AND a.series < b.series GROUP BY ALL""")
def return_correlations(spark, sf):
    """The data of a chart, correlations of returns; a matrix of a few series."""
    d = X.daily(spark, sf)
    pairs = d.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("series", "ret"))).alias("r"))  # the series of one day meet
    both = pairs.select(F.posexplode("r").alias("i", "a"), "r").select("a", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("b"))
    return rounded(both.groupBy(F.col("a.series").alias("series_a"), F.col("b.series").alias("series_b")).agg(F.corr("a.ret", "b.ret").alias("corr"), F.count("*").alias("n")), 5)


@query(f"""WITH {REGIME}, s AS (SELECT *, CASE WHEN coalesce(vol_rank, 0.5) > 0.85 OR coalesce(dispersion_pos, 0.5) > 0.85 THEN 'RED' WHEN coalesce(vol_rank, 0.5) > 0.6 OR coalesce(dispersion_pos, 0.5) > 0.6 THEN 'YELLOW' ELSE 'GREEN' END AS state FROM regime)
SELECT max(ts) AS ts, round(arg_max(coalesce(vol_rank, -1), ts), 6) + 0.0 AS vol_rank, round(arg_max(coalesce(dispersion_pos, -1), ts), 6) + 0.0 AS dispersion_pos, arg_max(state, ts) AS state, round(avg((state = 'GREEN')::INT), 6) + 0.0 AS green, round(avg((state = 'YELLOW')::INT), 6) + 0.0 AS yellow, round(avg((state = 'RED')::INT), 6) + 0.0 AS red FROM s""")
def regime_summary(spark, sf):
    """The regime at the latest bar (-1 where unknown), and how often each state held."""
    r = B.regime(X.returns(spark, sf), "click", 24, 0.8, 0.6, 0.85)
    known = lambda c: F.max_by(F.coalesce(c, F.lit(-1.0)), "ts").alias(c)
    return rounded(r.agg(F.max("ts").alias("ts"), known("vol_rank"), known("dispersion_pos"), F.max_by("state", "ts").alias("state"), *(F.avg((F.col("state") == x.upper()).cast("int")).alias(x) for x in ("green", "yellow", "red"))))


@query()
def subwindow_passes(spark, sf):
    """In how many of three equal parts a pair's spread passes its test, and how its half-lives vary there."""
    return P.subwindow_passes(X.pair_bars(spark, sf), 3, 0.5)


@query()
def weighted_stationarity(spark, sf):
    """The forgetting hedge ratio, and whether the spread's last three half-lives of weight are stationary."""
    p = X.pair_bars(spark, sf)
    return P.weighted_stationarity(p, 120)
