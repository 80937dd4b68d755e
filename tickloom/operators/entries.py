"""Entries and exits of pairs: gates, filters, scores, cool-downs, caps and parameter grids.

Signals have (pair, ts, z, vol, ...), one row for each bar of a pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.bars import lag1, last, percent_rank


def of_pair() -> Window:
    """A pair's rows in order of time."""
    return Window.partitionBy("pair").orderBy("ts")


def no(c: Column) -> Column:
    """False for null."""
    return F.coalesce(c, F.lit(False))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def funnel(gates: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, bars, a count after each gate in turn, conversion of the first to the last, blocker: the gate that takes most)."""
    sums, so_far = [F.count("*").alias("bars")], F.lit(True)
    for n in names:
        so_far = so_far & no(F.col(n))
        sums.append(F.sum(so_far.cast("long")).alias(n))
    out = gates.groupBy(*keys).agg(*sums)
    lost = [F.col(a) - F.col(b) for a, b in zip(names, names[1:])]
    most, blocker = F.greatest(*lost), F.lit(None).cast("string")
    for n, x in reversed(list(zip(names[1:], lost))):
        blocker = F.when(x == most, n).otherwise(blocker)
    return out.withColumns({"conversion": F.when(F.col(names[0]) > 0, F.col(names[-1]) / F.col(names[0])).otherwise(0.0), "blocker": blocker})


def sweep(signals: DataFrame, entries: Sequence[float], cost: float = 0.0028) -> DataFrame:
    """(entry_z, n, net, sharpe, cost_to_gross, cheap, ranks): all thresholds in one pass over the signals; cheap: costs are under half of the gross."""
    grid = signals.where("z is not null").withColumn("entry_z", F.explode(F.array(*map(F.lit, entries)))).where("abs(z) > entry_z")
    out = grid.groupBy("entry_z").agg(F.count("*").alias("n"), F.sum("expected_profit").alias("net"), (F.avg("expected_profit") / F.stddev_samp("expected_profit")).alias("sharpe"), (F.count("*") * cost / F.abs(F.sum("expected_profit") + F.count("*") * cost)).alias("cost_to_gross"))
    rank = lambda c: F.row_number().over(Window.orderBy(c, "entry_z")).cast("long")  # noqa: E731  a row for each threshold
    return out.withColumns({"cheap": F.col("cost_to_gross") < 0.5, "rank_net": rank(F.desc("net")), "rank_sharpe": rank(F.desc("sharpe")), "rank_cost": rank(F.asc("cost_to_gross"))})


def velocity(signals: DataFrame, k: int) -> DataFrame:
    """signals with velocity, acceleration, reverting, fresh and stale."""
    z, a, b = F.col("z"), F.lag("z", k).over(of_pair()), F.lag("z", 2 * k).over(of_pair())
    d = signals.withColumns({"velocity": (z - a) / k, "acceleration": ((z - a) - (a - b)) / (k * k), "change": F.abs(z) - F.abs(a), "__old": F.abs(b)})
    reverting = no((z * F.col("velocity")) < 0)
    return d.withColumns({"reverting": reverting, "fresh": no(F.col("change") >= -0.1 * k), "stale": no(F.col("__old") > F.abs(z)) & reverting}).drop("change", "__old")


def ou_profit(z: Column, vol: Column, half: Column, exit_z: float, cost: float, funding: Column | float = 0.0) -> Column:
    """Expected profit of a mean-reverting spread: what reverts in the time to the exit, less costs, halved."""
    hold = half * clip(F.log(F.greatest(F.abs(z) / exit_z, F.lit(1.01))), 0.5, 3.0)
    return (F.abs(z) * vol * (1 - F.exp(-F.log(F.lit(2.0)) / half * hold)) - cost - funding * hold) * 0.5


def rolling_half_life(n: int) -> Column:
    """From the rolling AR(1) coefficient of z on z1, the value before, kept between .01 and .99; between 50 and 500 bars."""
    f = last(of_pair(), n)
    phi = clip(F.covar_samp("z", "z1").over(f) / F.var_samp("z").over(f), 0.01, 0.99)
    return clip(-F.log(F.lit(2.0)) / F.log(phi), 50.0, 500.0)


def signal_score(z: Column, velocity_: Column, profit: Column, vol: Column, entry: float, wide: float) -> Column:
    """Four parts: a triangle in |z|, reversion, profit against 2 percent, steadiness."""
    a = F.abs(z)
    shape = clip(1 - F.abs(a - (entry + wide) / 2) / ((wide - entry) / 2), 0.0, 1.0)
    turn = clip(-F.signum(z) * velocity_, 0.0, 1.0)
    return F.coalesce(0.35 * shape + 0.25 * turn + 0.25 * clip(profit / 0.02, 0.0, 1.0) + 0.15 / (1 + vol), F.lit(0.0))


def masks(signals: DataFrame, entry: float, leave: float, stop: float, most: float, hurdle: float, vol_floor: float = 0.0, beta: bool = False) -> DataFrame:
    """signals with each gate, entry_mask and exit_mask; missing figures open nothing and close nothing.

    With beta the profit counts for both legs' weight, 1 + |beta|.
    """
    a = F.abs("z")
    profit = F.col("expected_profit") / (1 + F.abs("beta")) if beta else F.col("expected_profit")
    d = signals.withColumns({"gate_z": no(a > entry), "gate_profit": no(profit > hurdle), "gate_bound": no(a < most), "gate_vol": no(F.col("vol") >= vol_floor)})
    return d.withColumns({"entry_mask": F.col("gate_z") & F.col("gate_profit") & F.col("gate_bound") & F.col("gate_vol"), "exit_mask": no((a < leave) | (a > stop))})


def entry_paths(signals: DataFrame, entry: float, most: float, hurdle: float, least_score: float, cost: float, hold: tuple[int, int], vol: tuple[float, float], autocorr: float, n: int, k: int = 3, least_confidence: float = 0.5, base: float = 1.5, sizes: tuple[float, float] = (1.5, 2.5)) -> DataFrame:
    """signals with every way to enter, each false where a figure it needs is missing.

    gated: beyond entry and turned since the bar before, back over k bars, profit over the hurdle, |z| under most, autocorrelation of n bars
    at most `autocorr` (or unknown), hold in its range, an inflection of enough confidence. scored: the score in place of those gates. dynamic: beyond a
    threshold that costs move from `base`. continuous: an exposure over 1 percent, from none to whole between `sizes`. by_gates and by_score are the gated or scored way, or dynamic, or continuous,
    each only with volatility in its range. The profit counts for both legs' weight, 1 + |beta|.
    """
    z, a, before = F.col("z"), F.abs("z"), F.abs("__z1")
    d = velocity(inflection(signals, entry), k).withColumn("__z1", F.lag("z").over(of_pair()))
    d = d.withColumns({"__lag1": lag1(F.col("z"), F.col("__z1"), of_pair(), n), "profit": F.col("expected_profit") / (1 + F.abs("beta"))})
    profit = F.col("profit")
    d = d.withColumns({"score": signal_score(z, F.col("velocity"), profit, F.col("vol"), entry, most), "dynamic_z": entry_threshold(F.col("vol"), cost, base, 1.2, 2.0)})
    d = d.withColumn("size", F.when((profit >= hurdle) & (a >= sizes[0]), exposure(z, *sizes)).otherwise(0.0))
    fair = (profit > hurdle) & (a < most)
    calm = (F.col("__lag1") <= autocorr) | F.col("__lag1").isNull()
    turned = (before > entry) & (a < before)
    d = d.withColumns({
        "gated": no(fair & (a > entry) & turned & F.col("reverting") & calm & F.col("expected_hold").between(*hold) & (F.col("confidence") >= least_confidence)),
        "scored": no(fair & (a > entry) & (F.col("score") >= least_score)),
        "dynamic": no(fair & (a > F.col("dynamic_z"))),
        "continuous": no(F.abs("size") > 0.01),
        "vol_ok": no(F.col("vol").between(*vol)),
    })
    either = F.col("dynamic") | F.col("continuous")
    return d.withColumns({"by_gates": (F.col("gated") | either) & F.col("vol_ok"), "by_score": (F.col("scored") | either) & F.col("vol_ok")}).drop("__z1", "__lag1")


def exposure(z: Column, start: float, whole: float) -> Column:
    """Against the sign of z, from 0 at start to 1 at whole."""
    return F.coalesce(-F.signum(z) * clip((F.abs(z) - start) / (whole - start), 0.0, 1.0), F.lit(0.0))


def entry_threshold(vol: Column, cost: float, base: float, least: float, k: float) -> Column:
    return F.greatest(F.lit(least), base + k * cost / F.when(vol > 1e-9, vol))


def filters(signals: DataFrame, entry: float, bars: int, turn: int, stale: int) -> DataFrame:
    """signals with slope, confirmed, inflected and not_stale of an entry at |z| >= entry.

    slope: |z| falls. confirmed: the last `bars` bars are all beyond. inflected: |z| is below the largest of the `turn` bars
    before and this one. not_stale: of the last stale + 1 bars at most `stale` are beyond.
    """
    d = signals.withColumn("__a", F.abs("z"))
    beyond = no(F.col("__a") >= entry).cast("int")
    return d.withColumn("__b", beyond).withColumns({
        "slope": no(F.col("__a") < F.lag("__a").over(of_pair())),
        "confirmed": (F.count("*").over(last(of_pair(), bars)) >= bars) & (F.min("__b").over(last(of_pair(), bars)) == 1),
        "inflected": no(F.col("__a") < F.max("__a").over(last(of_pair(), turn + 1))) & (F.count("__a").over(last(of_pair(), turn + 1)) >= 2),
        "not_stale": F.sum("__b").over(last(of_pair(), stale + 1)) <= stale,
    }).drop("__a", "__b")


def inflection(signals: DataFrame, threshold: float, frame: int = 11, least: int = 2, most: int = 10, reversal: float = -0.05) -> DataFrame:
    """signals with bars_since, the bars since the run beyond the threshold began (-1 outside one), peak, valley, reverting and confidence.

    Only the last `frame` bars count, the first of them not as a beginning; a missing z ends a run. A peak is a positive z whose change is
    below `reversal`, a valley another z whose change is above -reversal; both only from `least` to `most` bars after the run began. The
    confidence weighs speed, how much of |z| is gone, and timing, best after 3 to 5 bars.
    """
    z, before = F.col("z"), F.lag("z").over(of_pair())
    d = signals.withColumns({"__k": F.row_number().over(of_pair()), "__above": no(F.abs(z) > threshold), "__b": before})
    d = d.withColumn("__out", F.max(F.when(~F.col("__above"), F.col("__k"))).over(last(of_pair(), frame - 1)))
    since = F.when(F.col("__above"), F.col("__k") - F.coalesce("__out", F.greatest(F.col("__k") - frame + 1, F.lit(0)))) - 1
    d = d.withColumns({"bars_since": F.coalesce(since, F.lit(-1)).cast("long"), "__v": z - F.col("__b")})
    inside = (F.col("__k") >= 4) & F.col("bars_since").between(least, most)
    d = d.withColumns({"peak": no(inside & (z > 0) & (F.col("__v") < reversal)), "valley": no(inside & (z <= 0) & (F.col("__v") > -reversal)), "reverting": no(inside & (F.abs(z) < F.abs("__b")))})
    a, b, n = F.abs(z), F.abs("__b"), F.col("bars_since")
    gone = F.when(b > 1e-10, (b - a) / b).otherwise(0.0)
    timing = F.when(n.between(3, 5), 1.0).when(n < 3, n / 3).otherwise(F.greatest(F.lit(0.2), 1 - (n - 5) / 5))
    conf = 0.4 * F.least(F.abs("__v") / 0.2, F.lit(1.0)) + 0.4 * F.least(gone / 0.1, F.lit(1.0)) + 0.2 * timing
    return d.withColumn("confidence", F.when(F.col("peak") | F.col("valley"), conf).otherwise(0.0)).drop("__k", "__above", "__v", "__b", "__out")


def ou_profit_v2(z: Column, vol: Column, half: Column, exit_z: float, cost: float, per_bar: float, max_hold: float, lo: float, hi: float, discount: float = 0.5) -> tuple[Column, Column]:
    """(profit, hold) of a mean-reverting spread: the hold is capped, the profit net of costs and funding clipped and discounted."""
    hold = F.least(half * clip(F.log(F.greatest(F.abs(z) / exit_z, F.lit(1.01))), 0.5, 3.0), F.lit(max_hold))
    net = F.abs(z) * vol * (1 - F.exp(-F.log(F.lit(2.0)) / half * hold)) - cost - per_bar * hold
    return F.when(net.isNotNull(), clip(net, lo, hi) * discount), hold


def in_and_out(signals: DataFrame, entry: float, leave: float) -> DataFrame:
    """(pair, n_trades, expectancy): a trade opens at |z| above entry and closes at |z| below leave, one at a time.

    What it makes is the move of the spread towards zero, relative to the spread at its entry. A trade is open where the last crossing
    was of the entry, so no bar needs another's outcome.
    """
    a = F.abs("z")
    all_ = of_pair().rowsBetween(Window.unboundedPreceding, -1)
    d = signals.where("z is not null").withColumn("__e", F.when(a > entry, 1).when(a < leave, 0))
    d = d.withColumn("__open", F.coalesce(F.last("__e", True).over(all_), F.lit(0)))
    d = d.withColumn("__s", F.last(F.when((F.col("__e") == 1) & (F.col("__open") == 0), F.col("spread")), True).over(all_))
    s, now = F.col("__s"), F.col("spread")
    made = F.when(F.abs(s) > 1e-10, F.when(s > 0, s - now).otherwise(now - s) / F.abs(s)).otherwise(0.0)
    closed = (F.col("__e") == 0) & (F.col("__open") == 1)
    return d.groupBy("pair").agg(F.count(F.when(closed, 1)).alias("n_trades"), F.coalesce(F.avg(F.when(closed, made)), F.lit(0.0)).alias("expectancy"))


def cooled(masks_: DataFrame, after: dict[int, int], unit: str = "hour") -> DataFrame:
    """masks_ with blocked: an entry within a cool-down after the last exits; `after` gives bars by exit reason, 0 for the rest.

    masks_ has entry_mask, exit_mask and exit_reason.
    """
    wait = F.lit(after.get(0, 0))
    for k, v in after.items():
        if k:
            wait = F.when(F.col("exit_reason") == k, v).otherwise(wait)
    until = F.when(F.col("exit_mask"), F.timestamp_add(unit.upper(), wait, F.col("ts")))
    before = of_pair().rowsBetween(Window.unboundedPreceding, -1)
    return masks_.withColumn("__until", until).withColumn("blocked", F.col("entry_mask") & no(F.max("__until").over(before) >= F.col("ts"))).drop("__until")


def best_of_bar(signals: DataFrame, least: float) -> DataFrame:
    """signals with profit_rank among the pairs of a bar, and top: the rank is high enough."""
    d = signals.withColumn("profit_rank", percent_rank(F.col("expected_profit"), Window.partitionBy("ts")))
    return d.withColumn("top", no(F.col("profit_rank") >= least))


def leg_cap(positions: DataFrame, most: int) -> DataFrame:
    """(pair, ts, coin_y, coin_x, active, entry_mask) with allowed: neither leg is in `most` open positions at the start of the bar."""
    leg = positions.where("active").select("ts", F.explode(F.array("coin_y", "coin_x")).alias("coin")).groupBy("ts", "coin").agg(F.count("*").alias("n"))
    d = positions
    for c in ("y", "x"):
        d = d.join(leg.select("ts", F.col("coin").alias(f"coin_{c}"), F.col("n").alias(f"n_{c}")), ["ts", f"coin_{c}"], "left")
    return d.withColumn("allowed", F.col("entry_mask") & (F.greatest(F.coalesce("n_y", F.lit(0)), F.coalesce("n_x", F.lit(0))) < most)).drop("n_y", "n_x")


def greedy(pairs: DataFrame, keys: Sequence[str], order: Sequence[str], most: int, members: Sequence[str] = ("coin_y", "coin_x"), free: str | None = None) -> DataFrame:
    """pairs that are taken if, in order, no member is in `most` taken ones; `free` names a member that has no limit.

    An ordered fold over a sorted array for each group of keys: candidates of one window, some hundreds at most.
    """
    cols = pairs.columns
    row = F.struct(*order, *(c for c in cols if c not in order))
    got = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = got.schema["rows"].dataType.simpleString()
    full_ = " or ".join(f"(size(filter(acc, t -> {' or '.join(f't.{m} = r.{n}' for m in members)})) >= {most}" + (f" and r.{n} <> '{free}'" if free else "") + ")" for n in members)
    return got.withColumn("taken", F.expr(f"aggregate(rows, cast(array() as {kind}), (acc, r) -> if({full_}, acc, concat(acc, array(r))))")).select(F.explode("taken").alias("t")).select(*(F.col(f"t.{c}") for c in cols))


def top_scores(scores: DataFrame, keys: Sequence[str], n: int, floor: float) -> DataFrame:
    """The n best of each group, of those not below the floor; ties by pair."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "pair"))
    return scores.withColumn("__k", rank).where((F.col("__k") <= n) & (F.col("score") >= floor)).drop("__k")


def persistent(found: DataFrame, of: int, least: int) -> DataFrame:
    """found (window_id, pair) with seen: in how many of the last `of` windows; those in at least `least`."""
    w = Window.partitionBy("pair").orderBy("window_id").rangeBetween(1 - of, 0)
    return found.withColumn("seen", F.count("*").over(w)).where(F.col("seen") >= least)


def consensus(long: DataFrame, short: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs found by both scans of a group of keys; those of the long one where no pair is."""
    both = long.join(short, [*keys, "pair"], "left_semi")
    return both.withColumn("source", F.lit("both")).unionByName(long.join(both.select(*keys).distinct(), list(keys), "left_anti").withColumn("source", F.lit("long")))

