"""Indicators, features and labels over bars (symbol, open_ms, open, high, low, close, volume, quote).

All finite-window forms are row frames of one window per symbol, so a query that uses several sorts once. Recursive forms
stream through a sorted partition. A value whose window is not full is null, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

KEYS = ("symbol", "open_ms")


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_ms")


def frame(first: int, last: int) -> WindowSpec:
    return by_symbol().rowsBetween(first, last)


def full(value: Column, x: Column | str, rows: int) -> Column:
    """value where the last `rows` rows all have x, else null."""
    return F.when(F.count(x).over(frame(1 - rows, 0)) == rows, value)


def lag(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_symbol())


def lead(x: str, n: int = 1) -> Column:
    return F.lead(x, n).over(by_symbol())


def sma(x: str, rows: int) -> Column:
    return full(F.avg(x).over(frame(1 - rows, 0)), x, rows)


def bollinger(x: str, rows: int = 20, width: float = 2.0) -> tuple[Column, Column, Column]:
    """Middle, upper and lower band; population deviation."""
    mid, sd = sma(x, rows), full(F.stddev_pop(x).over(frame(1 - rows, 0)), x, rows)
    return mid, mid + width * sd, mid - width * sd


def true_range() -> Column:
    """Of a first bar: high less low."""
    before = lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def rsi_simple(bars: DataFrame, rows: int = 14) -> DataFrame:
    """rsi from the mean gain and loss over exactly `rows` changes; 100 without losses."""
    moved = bars.withColumn("_d", F.col("close") - lag("close"))
    gain = full(F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(frame(1 - rows, 0)), "_d", rows)
    loss = full(F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame(1 - rows, 0)), "_d", rows)
    told = moved.withColumn("_g", gain).withColumn("_l", loss)
    rsi = F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    return told.withColumn("rsi", F.when(F.col("_g").isNotNull(), rsi)).drop("_d", "_g", "_l")


def ema_finite(x: str, period: int, window: int = 60) -> Column:
    """Exponential mean over the last `window` rows, seeded with the first of them; null before."""
    alpha = 2.0 / (period + 1)
    values = F.collect_list(x).over(frame(1 - window, 0))
    rest = F.slice(values, 2, window - 1)
    return F.when(F.size(values) == window, F.aggregate(rest, values[0], lambda e, v: e + alpha * (v - e)))


def recurse_many(bars: DataFrame, steps: list[tuple[str, str, Callable[[], Callable[[float | None], float | None]]]]) -> DataFrame:
    """Adds for each (x, name, start) in turn: what start()'s function returns for the values of x of one symbol in the order
    of open_ms; x may be a name before it.

    For recurrences whose rounding depends on the order. Rows stream through the sorted partition once, so a task holds a
    batch and a state for each step, however long a symbol's series is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, states = None, []
        for batch in batches:
            symbols = batch.column("symbol").to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(symbols) else np.zeros(0, int)
            known = {c: batch.column(c) for c in {x for x, _, _ in steps} & set(batch.schema.names)}
            values = {c: [None if v != v else v for v in col.cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()] for c, col in known.items()}
            values |= {name: [] for _, name, _ in steps}
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(symbols)], strict=True):
                if not states or symbols[a] != symbol:
                    symbol, states = symbols[a], [start() for _, _, start in steps]
                for step, (x, name, _) in zip(states, steps, strict=True):
                    values[name] += map(step, values[x][a:b])
            names = [name for _, name, _ in steps]
            yield pa.record_batch([*batch.columns, *[pa.array(values[n], pa.float64()) for n in names]], names=[*batch.schema.names, *names])

    schema = StructType([*bars.schema.fields, *[StructField(name, DoubleType()) for _, name, _ in steps]])
    return bars.repartition("symbol").sortWithinPartitions("symbol", "open_ms").mapInArrow(run, schema)


def recurse(bars: DataFrame, x: str, name: str, start: Callable[[], Callable[[float | None], float | None]]) -> DataFrame:
    """recurse_many() for one step."""
    return recurse_many(bars, [(x, name, start)])


def smoothed(seed: int, period: int, ema: bool) -> Callable[[], Callable[[float | None], float | None]]:
    """A start for recurse(): the mean of the first `seed` values, then smoothed with 2 / (period + 1) (ema) or 1 / period
    (Wilder). Null before; a null repeats the one before."""

    def start() -> Callable[[float | None], float | None]:
        seen: list[float] = []
        last: list[float] = []

        def step(v: float | None) -> float | None:
            if v is None:
                return last[0] if last else None
            if last:
                last[0] = last[0] + (v - last[0]) * 2.0 / (period + 1) if ema else (last[0] * (period - 1) + v) / period
                return last[0]
            seen.append(v)
            if len(seen) < seed:
                return None
            last.append(sum(seen) / seed)
            return last[0]

        return step

    return start


def ema_recursive(bars: DataFrame, x: str, period: int, name: str = "ema") -> DataFrame:
    """Exponential mean seeded with the mean of the first `period` values; null before; a null repeats the one before."""
    return recurse(bars, x, name, smoothed(period, period, True))


def wilder_index(period: int = 14, twice: bool = False, flat: float = 100.0) -> Callable[[], Callable[[float | None], float | None]]:
    """A start for recurse(): Wilder's index of closes: means of the first `period` changes, then smoothed; 100 without
    losses, `flat` without gains and losses, null before. twice: the last change of the seed counts once more at the seed,
    as (mean + change) / period, which the stored indicators of the reference do."""

    def start() -> Callable[[float | None], float | None]:
        state = {"before": None, "n": 0, "gain": 0.0, "loss": 0.0}

        def step(v: float | None) -> float | None:
            before, state["before"] = state["before"], v
            if before is None or v is None:
                return None
            gain, loss = max(v - before, 0.0), max(before - v, 0.0)
            state["n"] += 1
            if state["n"] <= period:
                state["gain"] += gain
                state["loss"] += loss
                if state["n"] < period:
                    return None
                state["gain"], state["loss"] = state["gain"] / period, state["loss"] / period
                if twice:
                    state["gain"], state["loss"] = (state["gain"] + gain) / period, (state["loss"] + loss) / period
            else:
                state["gain"] = (state["gain"] * (period - 1) + gain) / period
                state["loss"] = (state["loss"] * (period - 1) + loss) / period
            if state["loss"] == 0:
                return flat if state["gain"] == 0 else 100.0
            return 100 - 100 / (1 + state["gain"] / state["loss"])

        return step

    return start


def rsi_wilder(bars: DataFrame, x: str = "close", period: int = 14, name: str = "rsi") -> DataFrame:
    """Wilder's index of x, see wilder_index()."""
    return recurse(bars, x, name, wilder_index(period))


def adx(rows: int = 42, period: int = 14) -> Column:
    """Directional index from the last `rows` bars (high, low, close), all of them there or not; 20 for under two periods."""
    bars = F.collect_list(F.struct("high", "low", "close")).over(frame(1 - rows, 0))
    n = F.size(bars)
    pair = F.transform(F.sequence(F.lit(2), n), lambda i: F.struct(F.element_at(bars, i - 1).alias("p"), F.element_at(bars, i).alias("c")))
    c = lambda e, x: e["c"][x]
    up, down = (lambda e: c(e, "high") - e["p"]["high"]), (lambda e: e["p"]["low"] - c(e, "low"))
    moves = F.transform(
        pair,
        lambda e: F.struct(
            F.greatest(c(e, "high") - c(e, "low"), F.abs(c(e, "high") - e["p"]["close"]), F.abs(c(e, "low") - e["p"]["close"])).alias("t"),
            F.when((up(e) > down(e)) & (up(e) > 0), up(e)).otherwise(0.0).alias("p"),
            F.when((down(e) > up(e)) & (down(e) > 0), down(e)).otherwise(0.0).alias("m"),
        ),
    )
    start = F.struct(F.lit(0).alias("k"), *[F.lit(0.0).alias(x) for x in "tpm"], F.lit(0).alias("n"), F.lit(0.0).alias("s"))

    def take(a: Column, e: Column) -> Column:
        grown = {x: F.when(a["k"] < period, a[x] + e[x]).otherwise(a[x] - a[x] / period + e[x]) for x in "tpm"}
        plus, minus = (100 * grown[x] / F.greatest(grown["t"], F.lit(1e-9)) for x in "pm")
        dx = 100 * F.abs(plus - minus) / F.greatest(plus + minus, F.lit(1e-9))
        full = a["k"] + 1 >= period
        seen = F.when(full, a["n"] + 1).otherwise(0)
        mean = F.when(seen < period, a["s"] + dx).when(seen == period, (a["s"] + dx) / period).otherwise((a["s"] * (period - 1) + dx) / period)
        return F.struct((a["k"] + 1).alias("k"), *[grown[x].alias(x) for x in "tpm"], seen.alias("n"), F.when(full, mean).otherwise(0.0).alias("s"))

    told = F.aggregate(moves, start, take, lambda a: F.when(a["n"] == 0, 20.0).when(a["n"] < period, a["s"] / a["n"]).otherwise(a["s"]))
    return F.when(n >= 2 * period, told).otherwise(20.0)


#: Rows of a symbol that one task takes at least, if it has more.
SPLIT_ROWS = 1 << 14


def split(bars: DataFrame, before: int, after: int, width_ms: int, rows: int | None = None) -> DataFrame:
    """bars with symbols cut into parts of some `rows` neighbouring rows, each with at least `before` rows that precede and
    `after` that follow it, where there are so many: functions over frames within that reach give for a part's own rows what
    they give over the whole symbol, and a symbol with most rows is many tasks. A part's name holds the times of its own
    rows; whole() keeps these and gives the symbols back. Rows are counted by spans of 24 bars, a small table."""
    rows = max(rows or SPLIT_ROWS, 4 * max(before, after, 24))
    by = Window.partitionBy("_s").orderBy("_span")  # the only order that is needed, so one sort
    sofar, later = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1, Window.unboundedFollowing)
    n = bars.groupBy(F.col("symbol").alias("_s"), _span(width_ms).alias("_span")).agg(F.count("*").alias("_n"))
    n = n.withColumn("_end", F.sum("_n").over(by)).withColumn("_start", F.col("_end") - F.col("_n")).withColumn("_part", F.floor(F.col("_start") / rows))
    head = F.lag("_part").over(by).isNull() | (F.lag("_part").over(by) != F.col("_part"))
    n = n.withColumn("_head", F.when(head, F.struct(F.col("_span").alias("first"), F.col("_start").alias("low"))))
    # a part's first span and row, those of the next part, and of the one after that and the one before: places only grow
    n = n.withColumn("_own", F.max("_head").over(sofar)).withColumn("_next", F.min("_head").over(later))
    n = n.withColumn("_stop", F.coalesce("_next.first", F.lit(1 << 60))).withColumn("_then", F.min(F.when(F.col("_head").isNotNull(), F.col("_stop"))).over(later))
    n = n.withColumn("_last", F.max(F.when(F.col("_head").isNotNull(), F.lag("_own.first").over(by))).over(sofar))
    name = lambda first, stop: F.concat_ws("#", F.coalesce("_s", F.lit("\0")), first, stop)
    # the last rows of a part also precede those of the next, and its first rows follow those of the one before
    also = F.array(
        name(F.col("_own.first"), F.col("_stop")),
        F.when(F.col("_next.low") - F.col("_end") < before, name(F.col("_next.first"), F.col("_then"))),
        F.when(F.col("_last").isNotNull() & (F.col("_start") - F.col("_own.low") < after), name(F.col("_last"), F.col("_own.first"))),
    )
    n = n.select("_s", "_span", F.filter(also, lambda x: x.isNotNull()).alias("_names"))
    both = bars.withColumn("_at", _span(width_ms)).join(n, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("_at") == F.col("_span")))
    return both.select(F.explode("_names").alias("symbol"), *[c for c in bars.columns if c != "symbol"])


def _span(width_ms: int) -> Column:
    return F.floor(F.col("open_ms") / (24 * width_ms))


def whole(parts: DataFrame, width_ms: int) -> DataFrame:
    """The own rows (symbol, open_ms, ...) of what split() made, under their symbols."""
    name = lambda k: F.regexp_extract("symbol", r"(?s)^(.*)#(-?\d+)#(-?\d+)$", k)
    own = (_span(width_ms) >= name(2).cast("long")) & (_span(width_ms) < name(3).cast("long"))
    return parts.where(own).withColumn("symbol", F.when(name(1) != "\0", name(1)))


def obv_step() -> Column:
    """On-balance volume's step: the volume with the sign of the change, at first the volume itself."""
    return F.when(lag("close").isNull(), F.col("volume")).otherwise(F.signum(F.col("close") - lag("close")) * F.col("volume"))


def segments(bars: DataFrame, width_ms: int) -> DataFrame:
    """Adds gap_ms to the bar before and segment, the number of gaps so far: islands of adjacent bars."""
    told = bars.withColumn("gap_ms", F.col("open_ms") - lag("open_ms"))
    return told.withColumn("segment", F.sum(F.when(F.col("gap_ms") > width_ms, 1).otherwise(0)).over(frame(Window.unboundedPreceding, 0)))


def contexts(bars: DataFrame) -> DataFrame:
    """Adds trend (of the last five changes) and volatility (range over close against the median of up to 20 before)."""
    told = bars.withColumn("_d", F.col("close") - lag("close")).withColumn("_r", F.when(F.col("close") != 0, true_range() / F.col("close")))
    up, down, seen = (F.sum(F.when(c, 1).otherwise(0)).over(frame(-4, 0)) for c in (F.col("_d") > 0, F.col("_d") < 0, F.col("_d").isNotNull()))
    trend = F.when(seen < 3, "unknown").when((up >= 4) & (down <= 1), "up").when((down >= 4) & (up <= 1), "down").otherwise("sideways")
    prior, many = F.percentile("_r", 0.5).over(frame(-20, -1)), F.count("_r").over(frame(-20, -1))
    vol = F.when((many < 10) | F.col("_r").isNull(), "unknown").when(F.col("_r") >= 1.5 * prior, "high").when(F.col("_r") <= 0.67 * prior, "low").otherwise("normal")
    return told.withColumn("trend", trend).withColumn("volatility", vol).drop("_d", "_r")
