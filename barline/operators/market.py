"""Rules of a market: ticks, limits, lots, sizes, liquidation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price steps, the daily band, shares in a lot and the fee of a side.
BAND, LOT, FEE = 0.07, 100, 0.0015


def tick(price: Column) -> Column:
    return F.when(price < 10_000, 10).when(price < 50_000, 50).otherwise(100)


def limits(reference: Column, band: float = BAND) -> tuple[Column, Column]:
    """The lowest and the highest price of a day, on ticks inside the band."""
    low, high = reference * (1 - band), reference * (1 + band)
    return F.ceil(low / tick(low)) * tick(low), F.floor(high / tick(high)) * tick(high)


def lots(cash: Column, price: Column, fee: float = FEE) -> Column:
    """Shares in whole lots that cash can buy, fee included."""
    return F.floor(cash / (price * (1 + fee)) / LOT) * LOT


def kelly(win: Column, payoff: Column, share: float = 0.25, least: float = 0.05, most: float = 0.25) -> Column:
    """A share of the growth-optimal size for a chance to win and the ratio of gain to loss, between two bounds."""
    return F.least(F.lit(most), F.greatest(F.lit(least), share * (win - (1 - win) / payoff)))


def liquidation(entry: Column, leverage: float, margin: float, side: int) -> Column:
    """The price at which a position of that leverage (side 1 long, -1 short) is closed."""
    return entry * (1 - side / leverage + side * margin)
