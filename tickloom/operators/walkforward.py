"""Walk-forward windows, and a whole run over them as one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import ledger as L
from tickloom.operators import screening as S
from tickloom.operators.entries import clip
from tickloom.operators.intervals import interval_trades
from tickloom.sources.runs import saved


def with_windows(bars: DataFrame, windows: DataFrame, short_days: int = 0) -> DataFrame:
    """bars in each window that they are part of, with role (train, test) and short: of the last short_days of train.

    windows are a row for each step of a calendar: they go to all tasks.
    """
    d = bars.join(F.broadcast(windows), (F.col("ts") >= F.col("train_start")) & (F.col("ts") < F.col("test_end")))
    train = F.col("ts") < F.col("train_end")
    short = train & (F.col("ts") >= F.col("train_end") - F.expr(f"interval '{short_days}' day"))
    return d.withColumns({"role": F.when(train, "train").otherwise("test"), "short": short})


def split(bars: DataFrame, ratio: float) -> DataFrame:
    """bars with role: before or after the moment that cuts their span in this ratio."""
    span = bars.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    cut = F.col("lo") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(ratio * F.timestamp_diff("SECOND", F.col("lo"), F.col("hi"))).cast("decimal(18,6)"))
    return bars.join(F.broadcast(span.select(cut.alias("cut")))).withColumn("role", F.when(F.col("ts") < F.col("cut"), "train").otherwise("test")).drop("cut")


def trend_regime(returns: DataFrame, windows: DataFrame, trending: float = 0.15, reverting: float = -0.1) -> DataFrame:
    """(window_id, autocorr, trend): the median of the symbols' lag-1 autocorrelations in training."""
    d = with_windows(returns, windows).where("role = 'train'").withColumn("r1", F.lag("ret").over(Window.partitionBy("window_id", "symbol").orderBy("ts"))).where("ret is not null and r1 is not null")
    each = d.groupBy("window_id", "symbol").agg(F.corr("ret", "r1").alias("c"), F.count("*").alias("n")).where("n >= 20")
    a = each.groupBy("window_id").agg(F.median("c").alias("autocorr"))
    return a.withColumn("trend", F.when(F.col("autocorr") > trending, "trending").when(F.col("autocorr") < reverting, "mean_reverting").otherwise("neutral"))


def weekly_health(signals: DataFrame, start: str, least: int, crossings: int) -> DataFrame:
    """(pair, week, n, crossings, mean_z, beta_drift, healthy)."""
    w = Window.partitionBy("pair").orderBy("ts")
    d = signals.where("z is not null").withColumns({"week": F.floor(F.timestamp_diff("HOUR", F.lit(start).cast("timestamp_ntz"), F.col("ts")) / 168), "flip": F.abs(F.signum("z") - F.signum(F.lag("z").over(w))) == 2})
    g = d.groupBy("pair", "week").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("flip").cast("long")), F.lit(0)).alias("crossings"), F.abs(F.avg("z")).alias("mean_z"), (F.max_by("beta", "ts") - F.min_by("beta", "ts")).alias("beta_drift"))
    return g.withColumn("beta_drift", F.round("beta_drift", 5)).withColumn("healthy", (F.col("n") >= least) & (F.col("crossings") >= crossings))


def pair_score(trades: DataFrame) -> DataFrame:
    """(pair, score): expectancy, wins, stops, holding time, cost, number and steadiness of a pair's trades."""
    cost = F.sum(F.col("fees") + F.col("slippage"))
    p = trades.groupBy("pair").agg(F.avg("net").alias("e"), F.avg((F.col("net") > 0).cast("int")).alias("w"), F.avg((F.col("exit_reason") == 3).cast("int")).alias("s"), F.avg("hold_bars").alias("h"), (cost / (F.abs(F.sum("gross")) + cost)).alias("c"), F.count("*").alias("n"), F.stddev_samp("net").alias("v"))
    score = 0.15 * clip(F.col("e") / 0.02, 0.0, 1.0) + 0.2 * F.col("w") + 0.15 * (1 - F.col("s")) + 0.1 * clip(1 - F.col("h") / 100, 0.0, 1.0) + 0.15 * (1 - F.col("c")) + 0.15 * F.least(F.lit(1.0), F.col("n") / 30) + 0.1 / (1 + 10 * F.col("v"))
    return p.select("pair", score.alias("score"))


def scenarios(returns: DataFrame, dim: Sequence[tuple[str, float, float]], exit_size: float) -> DataFrame:
    """(series, scenario, total): returns less a drag per bar and slippage per exit (a bar that moves over exit_size)."""
    each = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(d).alias("drag"), F.lit(s).alias("slip")) for n, d, s in dim))
    d = returns.withColumn("s", F.explode(each)).select("series", "ret", "s.*")
    return d.groupBy("series", "scenario").agg(F.sum(F.col("ret") - F.col("drag") - F.when(F.abs("ret") > exit_size, F.col("slip")).otherwise(0.0)).alias("total"))


def trade_funding(trades: DataFrame, per_bar: DataFrame) -> DataFrame:
    """trades with funding: -dir times the sum of what their bars cost; per_bar has (pair, ts, per_bar).

    Running sums turn the range join into two joins on bars.
    """
    w = Window.partitionBy("pair").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    run = per_bar.withColumn("run", F.sum(F.coalesce("per_bar", F.lit(0.0))).over(w)).select("pair", "ts", "run")
    d = trades.join(run.select("pair", F.col("ts").alias("entry_ts"), F.col("run").alias("r0")), ["pair", "entry_ts"]).join(run.select("pair", F.col("ts").alias("exit_ts"), F.col("run").alias("r1")), ["pair", "exit_ts"])
    return d.withColumn("funding", -F.col("dir") * (F.col("r1") - F.col("r0"))).select(*trades.columns, "funding")


def picked_spreads(prices: DataFrame, windows: DataFrame, limits: S.Limits, n: int, ratio: float = 0.8, least_corr: float = 0.0, max_lags: int | None = 5) -> DataFrame:
    """Test bars (window_id, pair, ts, y, x, beta, z) of the pairs that a scan of the training part lets pass, with p_value if it tests; z also looks back into train.

    prices has (ts, symbol, lp). All windows are one scan; bars are joined for pairs that passed alone, in the direction that did.
    """
    d = saved(with_windows(prices, windows))  # both legs of candidates and of found pairs read it
    found = S.scan(d.where("role = 'train'").select("window_id", "ts", "symbol", "lp"), ("window_id",), limits, ratio, least_corr, 3, max_lags).where("reason is null")
    b = S.bars_of(found.select("window_id", "pair"), d.select("window_id", "ts", "symbol", "lp"), ("window_id",)).join(found.select("window_id", "pair", "direction", F.col("hedge_ratio").alias("beta"), *(["p_value"] if max_lags is not None else [])), ["window_id", "pair"])
    turned = F.col("direction") == S.DIRECTIONS[1]
    b = b.withColumns({"y": F.when(turned, F.col("x")).otherwise(F.col("y")), "x": F.when(turned, F.col("y")).otherwise(F.col("x"))})
    w = Window.partitionBy("window_id", "pair").orderBy("ts").rowsBetween(1 - n, 0)
    s = b.withColumn("spread", F.col("y") - F.col("beta") * F.col("x"))
    s = s.withColumn("z", F.when((F.count("spread").over(w) >= n) & (F.stddev_samp("spread").over(w) > 1e-9), (F.col("spread") - F.avg("spread").over(w)) / F.stddev_samp("spread").over(w)))
    return s.join(F.broadcast(windows.select("window_id", "train_end")), "window_id").where("ts >= train_end").drop("train_end")  # a row for each window


def with_masks(spreads: DataFrame, entry: Column, leave: Column) -> DataFrame:
    return spreads.withColumns({"entry_mask": F.coalesce(F.abs("z") > entry, F.lit(False)), "exit_mask": F.coalesce(F.abs("z") < leave, F.lit(False))})


#: Costs of a trade (fee and slippage), most bars that it is held, and loss at which it stops.
TRADE = {"fee": 5e-4, "slip": 5e-4, "max_hold": 48, "stop": 0.5}


def run_trades(spreads: DataFrame, entry: float = 1.5, leave: float = 0.5, **trade: float) -> DataFrame:
    """Trades of all windows, as one job."""
    return interval_trades(with_masks(spreads, F.lit(entry), F.lit(leave)), ["window_id"], **(TRADE | trade))


def run(trades: DataFrame) -> DataFrame:
    """(window_id, pair, trades, win_rate, gross, net) of a run in which no window needs another's result."""
    return L.ledger_stats(trades, ["window_id", "pair"], total=False).select("window_id", "pair", "trades", "win_rate", "gross", "net")


def sweep_runs(spreads: DataFrame, entries: Sequence[float], leaves: Sequence[float], max_ps: Sequence[float]) -> DataFrame:
    """(max_p, entry_z, exit_z, trades, win_rate, gross, net, cost_to_gross, cheap, rank_net): a run of all windows for each cell of the grid.

    spreads are those of pairs that the loosest limit lets pass, with p_value; cells are rows of the same job. A cell
    without a trade has 0 trades and no rate. Ranks, over the cells alone, go by net, then by the cell.
    """
    axis = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    cell = ["max_p", "entry_z", "exit_z"]
    grid = lambda d: d.withColumn("max_p", F.explode(axis(max_ps))).withColumn("entry_z", F.explode(axis(entries))).withColumn("exit_z", F.explode(axis(leaves)))
    s = with_masks(grid(spreads).where("p_value < max_p"), F.col("entry_z"), F.col("exit_z"))
    t = L.ledger_stats(interval_trades(s, [*cell, "window_id"], **TRADE), cell, total=False).select(*cell, "trades", "win_rate", "gross", "net", "cost_to_gross")
    all_ = grid(spreads.sparkSession.range(1)).drop("id").join(t, cell, "left").fillna(0, ["trades"]).fillna(0.0, ["gross", "net"])
    return all_.withColumns({"cheap": F.coalesce(F.col("cost_to_gross") < 0.5, F.lit(False)), "rank_net": F.row_number().over(Window.orderBy(F.round("net", 9).desc(), *cell)).cast("long")})
