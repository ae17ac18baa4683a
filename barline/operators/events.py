"""Causal events on bars, and what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators import indicators as I
from barline.sources.tables import HOUR


def causal(bars: DataFrame) -> DataFrame:
    """(symbol, open_ms, module, event_type) known at the close of their bar: crossings of the 50-bar mean (equality belongs to
    the side before), volume of 1.5 and 2 times the mean of 20 bars before, and changes of context from the 12th bar on."""
    x = I.contexts(bars).withColumn("m", I.sma("close", 50)).withColumn("i", F.row_number().over(I.by_symbol()))
    x = x.withColumn("pm", I.lag("m")).withColumn("pc", I.lag("close")).withColumn("pt", I.lag("trend")).withColumn("pvol", I.lag("volatility"))
    prior = I.frame(-20, -1)
    ratio = F.when(F.count("volume").over(prior) == 20, F.avg("volume").over(prior))
    x = x.withColumn("pv", ratio)
    cross = F.when((F.col("pc") <= F.col("pm")) & (F.col("close") > F.col("m")), "CLOSE_ABOVE_SMA50").when((F.col("pc") >= F.col("pm")) & (F.col("close") < F.col("m")), "CLOSE_BELOW_SMA50")
    trend = F.when(F.col("trend") == "up", "BULL").when(F.col("trend") == "down", "BEAR").otherwise("SIDEWAYS")
    found = F.array(
        F.struct(F.lit("technicalIndicators").alias("module"), cross.alias("event_type")),
        *[F.struct(F.lit("volumeAnomaly").alias("module"), F.when(F.col("volume") >= t * F.col("pv"), "VOLUME_ANOMALY_" + str(t).replace(".", "_") + "X").alias("event_type")) for t in (1.5, 2.0)],
        F.struct(F.lit("marketRegime").alias("module"), F.when((F.col("i") > 11) & ((F.col("trend") != F.col("pt")) | (F.col("volatility") != F.col("pvol"))), F.concat(F.lit("REGIME_"), trend, F.lit("_"), F.upper("volatility"))).alias("event_type")),
    )
    told = x.select("symbol", "open_ms", "close", "trend", "volatility", F.explode(F.filter(found, lambda e: e["event_type"].isNotNull())).alias("e"))
    return told.select("symbol", "open_ms", "close", "trend", "volatility", "e.module", "e.event_type")


def _pivot(x: str, better: bool, radius: int) -> Column:
    left, right = I.frame(-radius, -1), I.frame(1, radius)
    whole = (F.count(x).over(left) == radius) & (F.count(x).over(right) == radius)
    if better:
        return whole & (F.col(x) > F.max(x).over(left)) & (F.col(x) > F.max(x).over(right))
    return whole & (F.col(x) < F.min(x).over(left)) & (F.col(x) < F.min(x).over(right))


def pivots(bars: DataFrame, radius: int = 2) -> DataFrame:
    """Strict highs and lows within radius bars (a bar that is both is a high), known `radius` bars later; leg: of another
    kind than the pivot before."""
    kind = F.when(_pivot("high", True, radius), "high").when(_pivot("low", False, radius), "low")
    found = bars.withColumn("kind", kind).withColumn("confirmed_ms", I.lead("open_ms", radius)).where("kind IS NOT NULL")
    found = found.withColumn("price", F.when(F.col("kind") == "high", F.col("high")).otherwise(F.col("low")))
    before = I.lag("kind")
    return found.withColumn("leg", before.isNull() | (before != F.col("kind")))


def gaps(bars: DataFrame, horizon: int = 99) -> DataFrame:
    """Fair-value gaps over three bars, stamped at the third, and whether a later bar within the horizon fills them."""
    ahead = I.frame(1, horizon)
    x = bars.withColumn("h0", I.lag("high", 2)).withColumn("l0", I.lag("low", 2)).withColumn("lo", F.min("low").over(ahead)).withColumn("hi", F.max("high").over(ahead))
    x = x.where("h0 < low OR l0 > high")
    up = F.col("h0") < F.col("low")
    return x.select(
        "symbol", "open_ms", F.when(up, "bullish").otherwise("bearish").alias("kind"), F.when(up, F.col("h0")).otherwise(F.col("high")).alias("gap_low"), F.when(up, F.col("low")).otherwise(F.col("l0")).alias("gap_high"),
        F.coalesce(F.when(up, F.col("lo") <= F.col("h0")).otherwise(F.col("hi") >= F.col("l0")), F.lit(False)).alias("mitigated"),
    )


def structure(bars: DataFrame, radius: int = 2) -> DataFrame:
    """Closes beyond the last confirmed pivot: BOS along the last break's way, CHOCH against it."""
    x = bars.withColumn("ph", F.when(_pivot("high", True, radius), F.col("high"))).withColumn("pl", F.when(_pivot("low", False, radius), F.col("low")))
    known = I.frame(Window.unboundedPreceding, -radius)
    x = x.withColumn("top", F.last("ph", True).over(known)).withColumn("bottom", F.last("pl", True).over(known))
    x = x.withColumn("way", F.when(F.col("close") > F.col("top"), "up").when(F.col("close") < F.col("bottom"), "down"))
    before = F.last("way", True).over(I.frame(Window.unboundedPreceding, -1))
    x = x.withColumn("event_type", F.when(before.isNull() | (before == F.col("way")), "BOS").otherwise("CHOCH")).where("way IS NOT NULL")
    return x.withColumn("price", F.when(F.col("way") == "up", F.col("top")).otherwise(F.col("bottom")))


def horizons(bars: DataFrame, steps: tuple[int, ...] = (1, 3, 6), width_ms: int = HOUR) -> DataFrame:
    """(symbol, open_ms, horizon, forward_return, mfe, mae) where the next `horizon` bars are there without a gap."""
    x = I.segments(bars, width_ms)
    w = Window.partitionBy("symbol", "segment").orderBy("open_ms")
    entries = [
        F.struct(F.lit(h).alias("horizon"), F.lead("close", h).over(w).alias("c"), F.max("high").over(w.rowsBetween(1, h)).alias("hi"), F.min("low").over(w.rowsBetween(1, h)).alias("lo")) for h in steps
    ]
    x = x.select("symbol", "open_ms", "close", F.array(*entries).alias("all")).select("symbol", "open_ms", "close", F.explode("all").alias("h")).where("h.c IS NOT NULL AND close <> 0")
    back = lambda c: F.col(c) / F.col("close") - 1
    return x.select("symbol", "open_ms", "h.horizon", back("h.c").alias("forward_return"), back("h.hi").alias("mfe"), back("h.lo").alias("mae"))
