"""Sequential selections and simulations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.indicators import frame


def spaced(positions: Column, distance: int) -> Column:
    """Of an ascending array those that lie at least `distance` after the last one kept."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("kept"))
    take = lambda a, x: a["last"].isNull() | (x - a["last"] >= distance)
    step = lambda a, x: F.when(take(a, x), F.struct(x.alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    return F.aggregate(positions, start, step)["kept"]


def round_trip(entry: Column, leave: Column, fee: float = 0.0010, slip: float = 0.0005) -> Column:
    """Net return of a long round trip with fee and slippage on each side."""
    return leave * (1 - fee - slip) / (entry * (1 + fee + slip)) - 1


def matched_controls(events: DataFrame, candidates: DataFrame, family: list[str], reserve: int = 6) -> DataFrame:
    """(family, event_at, control_at): for each event in turn the most recent candidate of the same context, available before
    it, not within `reserve` bars of an event, and not used before; null if there is none.

    events (family, context, at) and candidates (family, context, at, available) hold bar numbers. The choice depends on
    the ones before, so a family (with its context) is one group.
    """

    def run(key: tuple, e: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(e["at"].to_numpy(np.int64))
        c = c.sort_values("available")
        at, ready = c["at"].to_numpy(np.int64), c["available"].to_numpy(np.int64)
        if len(times):
            k = np.searchsorted(times, at)
            gap = np.minimum(np.abs(times[np.minimum(k, len(times) - 1)] - at), np.abs(times[np.maximum(k - 1, 0)] - at))
            at, ready = at[gap > reserve], ready[gap > reserve]
        free: list[int] = []
        out, j = [], 0
        for t in times:
            while j < len(at) and ready[j] < t:
                free.append(int(at[j]))
                j += 1
            out.append([*key, int(t), free.pop() if free else None])
        return pd.DataFrame(out, columns=[*family, "context", "event_at", "control_at"]).astype({"control_at": "Int64"})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in family] + ["context string, event_at long, control_at long"])
    candidates = candidates.toDF(*candidates.columns)  # columns of its own, should both come from one frame
    return events.groupBy(*family, "context").cogroup(candidates.groupBy(*family, "context")).applyInPandas(run, schema)


def triple_barrier(bars: DataFrame, up: float = 0.05, down: float = 0.04, hold: int = 20, settle: int = 2) -> DataFrame:
    """(symbol, open_ms, outcome, exit_price): entry at the next open; from `settle` bars after entry on the first bar that
    gaps or trades through the stop or the target decides (both: stop), else the last close. Null where bars are missing.
    A row looks at the `hold` + 1 bars ahead of it, as a frame."""
    ahead = F.collect_list(F.struct("open", "high", "low", "close")).over(frame(1, hold + 1))
    x = bars.withColumn("_a", ahead).withColumn("_in", F.get("_a", F.lit(0))["open"])
    stop, target = F.col("_in") * (1 - down), F.col("_in") * (1 + up)

    def decided(e: Column) -> Column:
        told = lambda name, price: F.struct(F.lit(name).alias("outcome"), price.alias("price"))
        return F.when(e["open"] <= stop, told("stop", e["open"])).when(e["open"] >= target, told("target", e["open"])).when(e["low"] <= stop, told("stop", stop)).when(e["high"] >= target, told("target", target))

    found = F.get(F.filter(F.transform(F.slice("_a", settle + 1, hold - settle + 1), decided), lambda d: d.isNotNull()), F.lit(0))
    x = x.withColumn("_f", F.when(F.size("_a") == hold + 1, F.coalesce(found, F.struct(F.lit("timeout").alias("outcome"), F.get("_a", F.lit(hold))["close"].alias("price")))))
    return x.select("symbol", "open_ms", F.col("_f.outcome").alias("outcome"), F.col("_f.price").alias("exit_price"))


def monte_carlo(returns: DataFrame, order: list[str], paths: int = 1000, trades: int = 250, share: float = 0.12, start: float = 10_000.0, ruin: float = 0.4, seed: int = 42) -> DataFrame:
    """(path, final, drawdown, ruined) of trade returns drawn with replacement from all rows of returns (r double, order);
    each path has a seed of its own. Ruined: a drawdown of `ruin` or more, or a balance of at most 1 - ruin of the start.

    `order` tells rows apart; its first column parts them for numbering. Drawn numbers meet the numbered rows in a join, so
    no task holds the pool; a path is one group of `trades` rows. Without returns each draw is 0.
    """
    from pyspark.sql import Window

    spark = returns.sparkSession
    first = order[0]
    sizes = returns.groupBy(first).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = returns.withColumn("k", F.row_number().over(Window.partitionBy(first).orderBy(*order[1:])) - 1)
    numbered = numbered.join(sizes.select(first, before.alias("before")), first).select((F.col("before") + F.col("k")).alias("number"), "r")
    size = returns.count()

    def draw(batches):
        for pdf in batches:
            for k in pdf["id"]:
                number = np.random.default_rng([seed, int(k)]).integers(0, max(size, 1), trades)
                yield pd.DataFrame({"path": int(k), "step": np.arange(trades), "number": number})

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        equity = start * np.concatenate([[1.0], np.cumprod(1 + share * b.sort_values("step")["r"].to_numpy(float))])
        fall = 1 - equity / np.maximum.accumulate(equity)
        ruined = bool(((fall >= ruin) | (equity <= start * (1 - ruin))).any())
        return pd.DataFrame([(key[0], float(equity[-1]), float(fall.max()), ruined)], columns=["path", "final", "drawdown", "ruined"])

    drawn = spark.range(paths).mapInPandas(draw, "path long, step long, number long").join(numbered, "number", "left")
    return drawn.select("path", "step", F.coalesce("r", F.lit(0.0)).alias("r")).groupBy("path").applyInPandas(run, "path long, final double, drawdown double, ruined boolean")


def portfolio(scores: DataFrame, top: int = 2, keep: int = 3, every: int = 5, cash: float = 100_000.0, lot: int = 1, fee: float = 0.0015) -> DataFrame:
    """(model, session, nav, held): every `every` sessions hold the `top` scores, where a held name stays while it ranks
    within `keep`; orders fill at the next session's price in whole lots, sales first.

    scores (model, session, symbol, score, price). Path-dependent, so a model is one group; ranks come from Spark.
    """
    from pyspark.sql import Window

    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("model", "session").orderBy(F.desc_nulls_last("score"), "symbol")))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        money, held, wanted, out, last = cash, {}, None, [], {}
        for k, (session, day) in enumerate(b.sort_values(["session", "symbol"]).groupby("session")):
            price = {s: p for s, p in zip(day["symbol"], day["price"], strict=True) if p == p and p}
            last |= price
            if wanted is not None:
                for s in sorted(set(held) - wanted):
                    if s in price:
                        money += held.pop(s) * price[s] * (1 - fee)
                buy = sorted(s for s in wanted - set(held) if s in price)
                for i, s in enumerate(buy):
                    n = int(money / (len(buy) - i) / (price[s] * (1 + fee)) // lot) * lot
                    if n:
                        held[s] = n
                        money -= n * price[s] * (1 + fee)
                wanted = None
            if k % every == 0:
                rank = dict(zip(day["symbol"], day["rank"], strict=True))
                stay = {s for s in held if rank.get(s, keep + 1) <= keep}
                fresh = [s for s in sorted(rank, key=rank.get) if s not in stay]
                wanted = stay | set(fresh[: max(0, top - len(stay))])
            out.append([*key, session, money + sum(n * last[s] for s, n in held.items()), ",".join(sorted(held))])
        return pd.DataFrame(out, columns=["model", "session", "nav", "held"])

    return ranked.groupBy("model").applyInPandas(run, "model string, session long, nav double, held string")
