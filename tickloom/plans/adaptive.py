"""Queries of parameters that follow results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import adapting as A
from tickloom.operators import bars as B
from tickloom.operators import ledger as L
from tickloom.operators import pairs as P
from tickloom.operators.entries import in_and_out
from tickloom.plans import fixtures as X
from tickloom.plans.catalog import query, rounded
from tickloom.plans.signals import HEDGE, REGIME, S


@query(f"""WITH {REGIME}, s AS (SELECT ts, vol_rank, CASE WHEN coalesce(vol_rank, 0.5) > 0.85 OR coalesce(dispersion_pos, 0.5) > 0.85 THEN 'RED' WHEN coalesce(vol_rank, 0.5) > 0.6 OR coalesce(dispersion_pos, 0.5) > 0.6 THEN 'YELLOW' ELSE 'GREEN' END AS state FROM regime)
SELECT ts, state, CASE state WHEN 'GREEN' THEN 2.0 WHEN 'YELLOW' THEN 2.3 ELSE 3.0 END::DOUBLE AS entry_z, CASE state WHEN 'GREEN' THEN 1.0 WHEN 'YELLOW' THEN 0.6 ELSE 0.0 END::DOUBLE AS size, CASE state WHEN 'GREEN' THEN 8 WHEN 'YELLOW' THEN 5 ELSE 2 END::BIGINT AS max_positions FROM s""")
def regime_parameters(spark, sf):
    """Thresholds, sizes and caps of each bar's regime."""
    return rounded(A.regime_parameters(B.regime(X.returns(spark, sf), "click", 24, 0.8, 0.6, 0.85).select("ts", "state"), 2.0))


@query(f"""WITH {REGIME} SELECT ts, round(1e-6 * greatest(0.3, least(3, 2 - 2 * coalesce(vol_rank, 0.5))), 12) + 0.0 AS delta, round(0.01 * greatest(0.5, least(3, 0.5 + 2 * coalesce(vol_rank, 0.5))), 12) + 0.0 AS r FROM regime""")
def filter_noise(spark, sf):
    """Noise of the online regression by regime."""
    d = B.regime(X.returns(spark, sf), "click", 24, 0.8, 0.6, 0.85)
    delta, r = A.filter_noise(F.col("vol_rank"), 1e-6, 0.01)
    return rounded(d.select("ts", delta.alias("delta"), r.alias("r")), 12)


@query(f"""WITH {HEDGE}, l AS (SELECT pair, spread, lag(spread) OVER (PARTITION BY pair ORDER BY ts) AS b FROM sp), k AS (SELECT pair, regr_slope(spread - b, b) AS s FROM l WHERE b IS NOT NULL GROUP BY pair)
SELECT pair, CASE WHEN s < -1e-10 THEN trunc(-ln(2) / s * 100)::BIGINT ELSE 96 END AS time_stop FROM k""")
def time_stops(spark, sf):
    """H8: longest holding times by half-life."""
    p = X.pair_bars(spark, sf)
    return A.time_stops(P.half_life(P.with_spread(p, P.hedge(p).drop("n"))), 100.0, 96)


@query(f"""WITH {X.TRADES}, p AS (SELECT DISTINCT pair, split_part(pair, '-', 1) AS cluster_y, substr(pair, instr(pair, '-') + 1) AS cluster_x FROM trades), e AS (SELECT unnest([cluster_y, cluster_x]) AS cluster FROM p WHERE pair LIKE 'Brand#1%'), n AS (SELECT cluster, count(*) AS legs FROM e GROUP BY cluster)
SELECT pair, round(greatest(0.3, 1 - 0.1 * greatest(coalesce(a.legs, 0), coalesce(b.legs, 0))), 6) + 0.0 AS penalty FROM p LEFT JOIN n a ON cluster_y = a.cluster LEFT JOIN n b ON cluster_x = b.cluster""")
def cluster_penalty(spark, sf):
    """Scores pay for clusters that are full."""
    p = X.trades(spark, sf).select("pair").distinct().select("pair", F.split("pair", "-", 2)[0].alias("cluster_y"), F.split("pair", "-", 2)[1].alias("cluster_x"))
    n = p.where("pair like 'Brand#1%'").select(F.explode(F.array("cluster_y", "cluster_x")).alias("cluster")).groupBy("cluster").agg(F.count("*").alias("legs"))
    return rounded(A.cluster_penalty(p, n).select("pair", "penalty"))


@query(f"""WITH {X.RETURNS}, m AS (SELECT ts, avg(ret) AS market FROM returns GROUP BY ts), g AS (SELECT symbol AS cluster, covar_samp(ret, market) / var_samp(market) AS beta, stddev_samp(ret) AS vol, avg(ret - market) AS alpha FROM returns JOIN m USING (ts) WHERE ret IS NOT NULL AND market IS NOT NULL GROUP BY symbol)
SELECT cluster, CASE WHEN vol > 1.5 * avg(vol) OVER () THEN 'wild' WHEN beta > 1.2 THEN 'aggressive' WHEN beta < 0.8 THEN 'defensive' WHEN alpha > 0 THEN 'leader' ELSE 'core' END AS label FROM g""")
def cluster_labels(spark, sf):
    """Names of clusters by their means."""
    r = X.returns(spark, sf)
    m = r.groupBy("ts").agg(F.avg("ret").alias("market"))
    g = r.join(m, "ts").where("ret is not null and market is not null").groupBy(F.col("symbol").alias("cluster")).agg((F.covar_samp("ret", "market") / F.var_samp("market")).alias("beta"), F.stddev_samp("ret").alias("vol"), F.avg(F.col("ret") - F.col("market")).alias("alpha"))
    return A.labelled(g).select("cluster", "label")


@query(f"""WITH {X.TRADES}, r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY trade_seq DESC) AS k FROM trades), t AS (SELECT * FROM r WHERE k <= 60), c AS (SELECT *, sum(net) OVER (PARTITION BY pair ORDER BY trade_seq ROWS UNBOUNDED PRECEDING) AS cum FROM t),
 d AS (SELECT *, greatest(max(cum) OVER (PARTITION BY pair ORDER BY trade_seq ROWS UNBOUNDED PRECEDING), 0) - cum AS dd FROM c),
 s AS (SELECT pair, count(*) AS n, avg((net > 0)::INT) AS w, max(dd) AS dd, CASE WHEN coalesce(-sum(CASE WHEN net < 0 THEN net END), 0) > 0 THEN coalesce(sum(CASE WHEN net > 0 THEN net END), 0) / -sum(CASE WHEN net < 0 THEN net END) ELSE 99 END AS pf FROM d GROUP BY pair),
 m AS (SELECT pair, CASE WHEN n < 20 THEN 'keep' WHEN pf < 1 OR dd > 0.1 THEN 'off' WHEN pf > 1.5 AND w > 0.5 THEN 'on' ELSE 'keep' END AS mode FROM s)
SELECT pair, mode, round(greatest(1.5, least(3, 2 + 0.1 * CASE mode WHEN 'off' THEN 1 WHEN 'on' THEN -1 ELSE 0 END)), 6) + 0.0 AS entry_z, round(greatest(0.2, least(1, 0.8 - 0.1 * CASE mode WHEN 'off' THEN 1 WHEN 'on' THEN -1 ELSE 0 END)), 6) + 0.0 AS size FROM m""")
def recommended_parameters(spark, sf):
    """Parameters moved a step by the last trades."""
    w = Window.partitionBy("pair").orderBy(F.desc("trade_seq"))
    t = X.trades(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 60").drop("k")
    return rounded(A.recommended(L.trade_stats(t, ["pair"]), 2.0, 0.8).select("pair", "mode", "entry_z", "size"))


@query(f"""WITH RECURSIVE {X.TRADES}, w AS (SELECT window_id, sum(net) AS pnl FROM trades GROUP BY window_id), o AS (SELECT *, row_number() OVER (ORDER BY window_id) AS k FROM w),
 f AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS window_id, 0.8::DOUBLE AS t UNION ALL SELECT o.k, o.window_id, greatest(0.5, least(0.9, f.t + CASE WHEN o.pnl < 0 THEN -0.05 WHEN o.pnl > 0 THEN 0.025 ELSE 0 END))::DOUBLE FROM f JOIN o ON o.k = f.k + 1)
SELECT window_id, round(t, 6) + 0.0 AS threshold FROM f WHERE k > 0""")
def stepped_thresholds(spark, sf):
    """A threshold that each window moves on from the last."""
    w = X.trades(spark, sf).groupBy("window_id").agg(F.sum("net").alias("pnl"))
    return rounded(A.stepped(w, 0.8, 0.05, 0.5, 0.9))


@query(f"""WITH {S}, g AS (SELECT pair, sum((abs(z) > 1.5)::INT)::BIGINT AS entries, sum((abs(z) > 3)::INT)::BIGINT AS stops FROM signals GROUP BY pair),
 e AS (SELECT pair, ts, spread, CASE WHEN abs(z) > 1.5 THEN 1 WHEN abs(z) < 0.5 THEN 0 END AS e FROM signals WHERE z IS NOT NULL), o AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER w, 0) AS open FROM e WINDOW w AS (PARTITION BY pair ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s AS (SELECT *, last_value(CASE WHEN e = 1 AND open = 0 THEN spread END IGNORE NULLS) OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0 FROM o),
 t AS (SELECT pair, count(*) AS n_trades, avg(CASE WHEN abs(s0) > 1e-10 THEN CASE WHEN s0 > 0 THEN s0 - spread ELSE spread - s0 END / abs(s0) ELSE 0 END) AS expectancy FROM s WHERE e = 0 AND open = 1 GROUP BY pair)
SELECT g.pair, entries, stops, round(CASE WHEN entries > 0 THEN least(stops / entries, 1) ELSE 0.5 END, 6) + 0.0 AS stop_rate, coalesce(n_trades, 0)::BIGINT AS n_trades, round(coalesce(expectancy, 0), 5) + 0.0 AS expectancy FROM g LEFT JOIN t USING (pair)""")
def training_stop_rate(spark, sf):
    """How often signals of the past went on to a stop, half of them without any, and what a simple trade in and out made."""
    s, a = X.signals(spark, sf), F.abs("z")
    g = s.groupBy("pair").agg(F.coalesce(F.sum((a > 1.5).cast("long")), F.lit(0)).alias("entries"), F.coalesce(F.sum((a > 3).cast("long")), F.lit(0)).alias("stops"))
    g = g.withColumn("stop_rate", F.when(F.col("entries") > 0, F.least(F.col("stops") / F.col("entries"), F.lit(1.0))).otherwise(0.5))
    t = in_and_out(s, 1.5, 0.5).select("pair", "n_trades", (F.round("expectancy", 5) + 0.0).alias("expectancy"))
    return rounded(g.join(t, "pair", "left").na.fill({"n_trades": 0, "expectancy": 0.0}))
