"""Event modules over contiguous bars: what each bar's close tells, and which modules agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators import indicators as I

#: The declared parameters of the modules.
EMA_BARS, RSI_BARS, SMA_BARS, VOLUME_BARS, PIVOT_RADIUS = 60, 14, 50, 20, 2
RSI_BANDS, VOLUME_TIMES = (30.0, 70.0), (1.5, 2.0)
DOJI, LONG_WICK, SHORT_WICK = 0.1, 2.0, 1.0
PROFILE_BARS, PROFILE_BINS, VALUE_AREA = 100, 24, 0.7
BULLISH, BEARISH = ("BULL", "ABOVE", "EXIT_OVERSOLD", "ENTER_OVERSOLD"), ("BEAR", "BELOW", "EXIT_OVERBOUGHT", "ENTER_OVERBOUGHT")


def by_segment(bars: DataFrame, width_ms: int) -> DataFrame:
    """bars whose symbol names a run of adjacent bars (symbol#segment), so that no window goes over a gap; i: place in it."""
    told = I.segments(bars, width_ms).withColumn("symbol", F.concat_ws("#", "symbol", "segment")).drop("segment", "gap_ms")
    return told.withColumn("i", F.row_number().over(I.by_symbol()) - 1)


def _events(x: DataFrame, module: str, *labels: Column) -> DataFrame:
    """(symbol, open_ms, module, event_type) for each label that is not null."""
    all_ = F.filter(F.array(*labels), lambda e: e.isNotNull())
    return x.select("symbol", "open_ms", F.lit(module).alias("module"), F.explode(all_).alias("event_type"))


def indicator_events(x: DataFrame, ema_bars: int = EMA_BARS, bands: tuple[float, float] = RSI_BANDS) -> DataFrame:
    """Crossings of the two finite exponential means, of the bands of the simple strength index, and of the 50-bar mean."""
    x = I.rsi_simple(x, RSI_BARS).withColumn("fast", I.ema_finite("close", 12, ema_bars)).withColumn("slow", I.ema_finite("close", 26, ema_bars)).withColumn("m", I.sma("close", SMA_BARS))
    for c in ("rsi", "fast", "slow", "m", "close"):
        x = x.withColumn(f"p_{c}", I.lag(c))
    low, high = bands
    c = F.col
    ema = F.when((c("p_fast") <= c("p_slow")) & (c("fast") > c("slow")), "EMA_BULL_CROSS").when((c("p_fast") >= c("p_slow")) & (c("fast") < c("slow")), "EMA_BEAR_CROSS")
    rsi = (
        F.when((c("p_rsi") >= low) & (c("rsi") < low), "RSI_ENTER_OVERSOLD").when((c("p_rsi") <= low) & (c("rsi") > low), "RSI_EXIT_OVERSOLD")
        .when((c("p_rsi") <= high) & (c("rsi") > high), "RSI_ENTER_OVERBOUGHT").when((c("p_rsi") >= high) & (c("rsi") < high), "RSI_EXIT_OVERBOUGHT")
    )
    mean = F.when((c("p_close") <= c("p_m")) & (c("close") > c("m")), "CLOSE_ABOVE_SMA50").when((c("p_close") >= c("p_m")) & (c("close") < c("m")), "CLOSE_BELOW_SMA50")
    return _events(x.where(c("i") >= max(ema_bars, SMA_BARS, RSI_BARS + 2)), "technicalIndicators", ema, rsi, mean)


def shape_labels(doji: float = DOJI, long_wick: float = LONG_WICK) -> list[Column]:
    """Every causal candle shape that holds for a bar, each null where it does not; needs a window by symbol."""
    o, h, l, c, po, pc = (F.col("open"), F.col("high"), F.col("low"), F.col("close"), I.lag("open"), I.lag("close"))
    body, span = F.abs(c - o), h - l
    safe, upper, lower = F.greatest(body, span * 1e-6), h - F.greatest(o, c), F.least(o, c) - l
    there = lambda cond, name: F.when((span > 0) & cond, name)
    return [
        there(body / span <= doji, "DOJI"),
        there((lower >= long_wick * safe) & (upper <= SHORT_WICK * safe), "HAMMER_SHAPE"),
        there((upper >= long_wick * safe) & (lower <= SHORT_WICK * safe), "SHOOTING_STAR_SHAPE"),
        there((pc < po) & (c > o) & (o <= pc) & (c >= po), "BULLISH_ENGULFING"),
        there((pc > po) & (c < o) & (o >= pc) & (c <= po), "BEARISH_ENGULFING"),
    ]


def pattern_events(x: DataFrame, doji: float = DOJI, long_wick: float = LONG_WICK) -> DataFrame:
    names = shape_labels(doji, long_wick)
    x = x.select("symbol", "open_ms", *[n.alias(f"s{k}") for k, n in enumerate(names)])
    return _events(x, "candlePatterns", *[F.col(f"s{k}") for k in range(len(names))])


def volume_events(x: DataFrame, times: tuple[float, ...] = VOLUME_TIMES) -> DataFrame:
    """One event for each threshold that the volume reaches, as a multiple of the mean of the bars before."""
    prior = I.frame(-VOLUME_BARS, -1)
    x = x.withColumn("base", F.when(F.count("volume").over(prior) == VOLUME_BARS, F.avg("volume").over(prior))).where("base > 0 AND volume >= 0")
    return _events(x, "volumeAnomaly", *[F.when(F.col("volume") / F.col("base") >= t, "VOLUME_ANOMALY_" + str(t).replace(".", "_") + "X") for t in times])


def regime_events(x: DataFrame) -> DataFrame:
    """Changes of (trend, volatility) from the twelfth bar on."""
    x = I.contexts(x).withColumn("pt", I.lag("trend")).withColumn("pv", I.lag("volatility"))
    trend = F.when(F.col("trend") == "up", "BULL").when(F.col("trend") == "down", "BEAR").otherwise("SIDEWAYS")
    x = x.where("i >= 11 AND (trend <> pt OR volatility <> pv)")
    return _events(x, "marketRegime", F.concat(F.lit("REGIME_"), trend, F.lit("_"), F.upper("volatility")))


def fibonacci_events(x: DataFrame, radius: int = PIVOT_RADIUS) -> DataFrame:
    """A leg where a confirmed strict pivot follows one of the other kind, at the bar that confirms it."""
    from barline.operators.events import pivots

    p = pivots(x, radius).withColumn("before", I.lag("kind")).where("before <> kind")
    return p.select("symbol", F.col("confirmed_ms").alias("open_ms"), F.lit("fibonacci").alias("module"), F.when(F.col("before") == "low", "FIBONACCI_LEG_BULL").otherwise("FIBONACCI_LEG_BEAR").alias("event_type"))


def profile_levels(x: DataFrame, bars: int = PROFILE_BARS, bins: int = PROFILE_BINS, area: float = VALUE_AREA) -> DataFrame:
    """x with poc, vah and val of the volume by price of the last `bars` bars: midpoints of equal bins between their least
    low and greatest high. Of equal volumes the lowest bin comes first; null where the window is short or flat."""
    w = I.frame(1 - bars, 0)
    x = x.withColumn("_lo", F.min("low").over(w)).withColumn("_hi", F.max("high").over(w))
    x = x.withColumn("_all", F.when(F.count("*").over(w) == bars, F.collect_list(F.struct(((F.col("high") + F.col("low") + F.col("close")) / 3).alias("t"), F.greatest(F.col("volume"), F.lit(0)).cast("double").alias("v"))).over(w)))
    x = x.withColumn("_width", (F.col("_hi") - F.col("_lo")) / bins)
    slot = lambda e: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((e["t"] - F.col("_lo")) / F.col("_width")))).cast("int")
    add = lambda acc, e: F.transform(acc, lambda v, i: F.when(i == slot(e), v + e["v"]).otherwise(v))
    x = x.withColumn("_bins", F.when(F.col("_hi") > F.col("_lo"), F.aggregate("_all", F.array_repeat(F.lit(0.0), bins), add)))
    total = F.aggregate("_bins", F.lit(0.0), lambda s, v: s + v)
    x = x.withColumn("_total", total).withColumn("_ranked", F.array_sort(F.transform("_bins", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("top"), F.lit(bins).alias("bottom"))
    take = lambda s, e: F.when(s["sum"] >= area * F.col("_total"), s).otherwise(F.struct((s["sum"] - e["v"]).alias("sum"), F.greatest(s["top"], e["i"]).alias("top"), F.least(s["bottom"], e["i"]).alias("bottom")))
    x = x.withColumn("_area", F.when(F.col("_total") > 0, F.aggregate("_ranked", start, take)))
    mid = lambda i: F.when(F.col("_total") > 0, F.col("_lo") + (i + 0.5) * F.col("_width"))
    told = x.withColumn("poc", mid(F.col("_ranked")[0]["i"])).withColumn("vah", mid(F.col("_area.top"))).withColumn("val", mid(F.col("_area.bottom")))
    return told.drop("_lo", "_hi", "_all", "_width", "_bins", "_total", "_ranked", "_area")


def profile_events(x: DataFrame, bars: int = PROFILE_BARS, bins: int = PROFILE_BINS) -> DataFrame:
    """Closes that cross from one window's level to the other side of the next window's."""
    x = profile_levels(x, bars, bins).withColumn("pc", I.lag("close"))
    for c in ("poc", "vah", "val"):
        x = x.withColumn(f"p_{c}", I.lag(c))
    x = x.where("p_poc IS NOT NULL AND poc IS NOT NULL")
    name = lambda c: f"VOLUME_PROFILE_CLOSE_%s_{c.upper()}"
    cross = lambda c: F.when((F.col("pc") < F.col(f"p_{c}")) & (F.col("close") >= F.col(c)), name(c) % "ABOVE").when((F.col("pc") > F.col(f"p_{c}")) & (F.col("close") <= F.col(c)), name(c) % "BELOW")
    return _events(x, "volumeProfile", cross("poc"), cross("vah"), cross("val"))


def direction(event_type: Column) -> Column:
    """1, -1 or 0 by the tokens of its name; a bullish token comes before a bearish one."""
    has = lambda tokens: event_type.rlike("|".join(tokens))
    return F.when(has(BULLISH), 1).when(has(BEARISH), -1).otherwise(0)


def base_events(x: DataFrame) -> DataFrame:
    """All modules' events over bars by segment."""
    out = indicator_events(x)
    for more in (pattern_events(x), volume_events(x), regime_events(x), fibonacci_events(x), profile_events(x)):
        out = out.unionByName(more)
    return out


def confluence(events: DataFrame, least: int = 2) -> DataFrame:
    """(symbol, open_ms, way, modules): closes at which at least so many modules point one way. Neutral events have no say,
    nor has a module that points both ways at a close."""
    told = events.withColumn("way", direction(F.upper("event_type"))).where("way <> 0")
    one = told.groupBy("symbol", "open_ms", "module").agg(F.min("way").alias("way"), F.max("way").alias("other")).where("way = other")
    return one.groupBy("symbol", "open_ms", "way").agg(F.count("*").alias("modules")).where(F.col("modules") >= least)


def first_crossing(bars: DataFrame, asked: DataFrame, key: str, span: int = 256) -> DataFrame:
    """asked (key, at, price, up, any more columns) with found: the place of the first later bar of its key whose high is at
    or over the price (up) or whose low is at or under it (not up); null if there is none.

    bars (key, i, high, low). A tree of `span` children a node, three levels of it: a look at one's own node, at its later
    neighbours, at theirs, and back down. Each look is an equi-join with rows of `span` entries, so a search takes five
    whatever the distance, and a key with most bars is many nodes.
    """
    entry = F.struct("i", "high", "low")
    level = bars.select(key, "i", "high", "low")
    nodes = []
    for _ in range(3):
        node = level.groupBy(key, F.expr(f"cast(i DIV {span} AS long)").alias("node")).agg(F.array_sort(F.collect_list(entry)).alias("in_"), F.max("high").alias("high"), F.min("low").alias("low"))
        nodes.append(node.select(F.col(key).alias("_k"), F.col("node").alias("_node"), "in_"))
        level = node.select(key, F.col("node").alias("i"), "high", "low")

    def look(rows: DataFrame, depth: int, after: str, into: str, self: bool = False) -> DataFrame:
        """into: the first entry after the place `after` of its node (self: or at it) that reaches the price; else null."""
        node = nodes[depth]
        on = (rows[key] == node["_k"]) & (F.expr(f"cast({after} DIV {span} AS long)") == node["_node"])
        reach = lambda e: F.when(F.col("up"), e["high"] >= F.col("price")).otherwise(e["low"] <= F.col("price"))
        first = F.filter("in_", lambda e: (e["i"] >= F.col(after) if self else e["i"] > F.col(after)) & reach(e))
        return rows.join(node, on, "left").withColumn(into, F.get(first, F.lit(0))["i"].cast("long")).drop("_k", "_node", "in_")

    place = lambda level: F.expr(f"cast(at DIV {span**level} AS long)")
    rows = look(asked, 0, "at", "_0")
    rows = look(rows.withColumn("_a", F.when(F.col("_0").isNull(), place(1))), 1, "_a", "_1")
    rows = look(rows.withColumn("_a", F.when(F.col("_0").isNull() & F.col("_1").isNull(), place(2))), 2, "_a", "_2")
    # down again: the first child of the node that was found, and the first bar of that one
    rows = look(rows.withColumn("_a", F.col("_2") * span), 1, "_a", "_3", True).withColumn("_3", F.when(F.col("_2").isNotNull(), F.col("_3")))
    rows = rows.withColumn("_b", F.coalesce("_1", "_3"))
    rows = look(rows.withColumn("_a", F.col("_b") * span), 0, "_a", "_4", True)
    return rows.withColumn("found", F.coalesce("_0", F.when(F.col("_b").isNotNull(), F.col("_4")))).drop("_0", "_1", "_2", "_3", "_4", "_a", "_b")
