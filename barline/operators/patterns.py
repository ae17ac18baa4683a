"""Candle patterns of one, two and three bars, as ordered rules over a bar and the ones after it, and their n-grams.

The rules are data: (name, condition), of which the first that holds names the bar they begin at. The conditions are SQL
over a bar's columns o1 h1 l1 c1 and those of the two bars after it, the trend, and the parts computed in PARTS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names and thresholds of the patterns.
ONE = [
    ("Doji", "s1 <= 1e-9"),
    ("DragonflyDoji", "b1 < 0.015 * s1 AND d1 > 0.6 * s1 AND u1 < 0.1 * s1"),
    ("GravestoneDoji", "b1 < 0.015 * s1 AND u1 > 0.6 * s1 AND d1 < 0.1 * s1"),
    ("Doji", "b1 < 0.015 * s1"),
    ("BullishMarubozu", "b1 > 0.95 * s1 AND c1 >= o1"),
    ("BearishMarubozu", "b1 > 0.95 * s1"),
    ("SpinningTop", "b1 < 0.3 * s1 AND u1 > 0.25 * s1 AND d1 > 0.25 * s1"),
    ("Hammer", "d1 >= 2 * b1 AND u1 < 0.15 * s1 AND trend = 'down'"),
    ("HangingMan", "d1 >= 2 * b1 AND u1 < 0.15 * s1 AND trend = 'up'"),
    ("InvertedHammer", "u1 >= 2 * b1 AND d1 < 0.15 * s1 AND trend = 'down'"),
    ("ShootingStar", "u1 >= 2 * b1 AND d1 < 0.15 * s1 AND trend = 'up'"),
]
_RISE, _FALL = "c1 < o1 AND c2 >= o2", "c1 >= o1 AND c2 < o2"
TWO = [
    (None, "c2 IS NULL OR b1 <= 1e-9 OR b2 <= 1e-9 OR s1 <= 1e-9"),
    ("BullishEngulfing", f"{_RISE} AND o2 <= c1 AND c2 >= o1 AND b2 > b1"),
    ("BearishEngulfing", f"{_FALL} AND o2 >= c1 AND c2 <= o1 AND b2 > b1"),
    ("PiercingLine", f"{_RISE} AND trend = 'down' AND o2 < c1 AND c2 > (o1 + c1) / 2 AND c2 < o1"),
    ("DarkCloudCover", f"{_FALL} AND trend = 'up' AND o2 > c1 AND c2 < (o1 + c1) / 2 AND c2 > o1"),
    ("BullishHarami", f"{_RISE} AND b2 < 0.6 * b1 AND o2 <= o1 AND c2 >= c1"),
    ("BearishHarami", f"{_FALL} AND b2 < 0.6 * b1 AND o2 >= o1 AND c2 <= c1"),
    ("TweezerBottoms", f"trend = 'down' AND {_RISE} AND abs(l1 - l2) < 0.08 * s1"),
    ("TweezerTops", f"trend = 'up' AND {_FALL} AND abs(h1 - h2) < 0.08 * s1"),
]
_STAR = "b1 > 0.5 * s1 AND b2 < 0.3 * s2 AND b3 > 0.5 * b1"
_LONG = "b1 > 0.5 * s1 AND b2 > 0.5 * s1 AND b3 > 0.5 * s1"
THREE = [
    (None, "c3 IS NULL OR s1 <= 1e-9 OR s2 <= 1e-9"),
    ("MorningStar", f"c1 < o1 AND c3 >= o3 AND trend = 'down' AND {_STAR} AND c3 > (o1 + c1) / 2"),
    ("EveningStar", f"c1 >= o1 AND c3 < o3 AND trend = 'up' AND {_STAR} AND c3 < (o1 + c1) / 2"),
    ("ThreeWhiteSoldiers", f"c1 >= o1 AND c2 >= o2 AND c3 >= o3 AND {_LONG} AND o2 > o1 AND c2 > c1 AND o3 > o2 AND c3 > c2 AND h1 - c1 < 0.15 * b1 AND h2 - c2 < 0.15 * b2 AND h3 - c3 < 0.15 * b3"),
    ("ThreeBlackCrows", f"c1 < o1 AND c2 < o2 AND c3 < o3 AND {_LONG} AND o2 < o1 AND c2 < c1 AND o3 < o2 AND c3 < c2 AND c1 - l1 < 0.15 * b1 AND c2 - l2 < 0.15 * b2 AND c3 - l3 < 0.15 * b3"),
    ("ThreeInsideUp", "c1 < o1 AND c2 >= o2 AND c3 >= o3 AND trend = 'down' AND b2 < 0.6 * b1 AND o2 >= c1 AND c2 <= o1 AND c3 > h1"),
    ("ThreeInsideDown", "c1 >= o1 AND c2 < o2 AND c3 < o3 AND trend = 'up' AND b2 < 0.6 * b1 AND o2 <= c1 AND c2 >= o1 AND c3 < l1"),
]
#: Causal shapes at the bar that completes them.
SHAPES = [
    (None, "s1 <= 0"),
    ("BULLISH_ENGULFING", "c0 < o0 AND c1 > o1 AND o1 <= c0 AND c1 >= o0"),
    ("BEARISH_ENGULFING", "c0 > o0 AND c1 < o1 AND o1 >= c0 AND c1 <= o0"),
    ("DOJI", "b1 <= 0.1 * s1"),
    ("HAMMER_SHAPE", "d1 >= 2 * greatest(b1, 1e-6 * s1) AND u1 <= greatest(b1, 1e-6 * s1)"),
    ("SHOOTING_STAR_SHAPE", "u1 >= 2 * greatest(b1, 1e-6 * s1) AND d1 <= greatest(b1, 1e-6 * s1)"),
]
PARTS = {f"{n}{k}": e.format(k=k) for k in (1, 2, 3) for n, e in (("b", "abs(c{k} - o{k})"), ("s", "h{k} - l{k}"), ("u", "h{k} - greatest(o{k}, c{k})"), ("d", "least(o{k}, c{k}) - l{k}"))}


def _case(rules: list[tuple[str | None, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN " + ("NULL" if name is None else f"'{name}'") for name, cond in rules) + " END"


RULES = {"pattern1": ONE, "pattern2": TWO, "pattern3": THREE, "shape": SHAPES}


def recognise(bars: DataFrame) -> DataFrame:
    """Adds pattern1, pattern2, pattern3 (stamped at their first bar) and shape (at the bar that completes it).

    bars need trend: up, down or another. One sort by symbol serves all.
    """
    w = Window.partitionBy("symbol").orderBy("open_ms")
    x = bars
    for letter, name in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")):
        x = x.withColumn(f"{letter}1", F.col(name)).withColumn(f"{letter}2", F.lead(name).over(w)).withColumn(f"{letter}3", F.lead(name, 2).over(w)).withColumn(f"{letter}0", F.lag(name).over(w))
    x = x.withColumns({k: F.expr(e) for k, e in PARTS.items()})
    x = x.withColumns({k: F.expr(_case(r)) for k, r in RULES.items()})
    return x.select(*bars.columns, *RULES)


def ngrams(named: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(chain, n, seen): runs of n patterns p in a row of a symbol's patterns, and how often they occur."""
    w = Window.partitionBy("symbol").orderBy("open_ms")
    ahead = F.collect_list("p").over(w.rowsBetween(0, max(sizes) - 1))
    chains = named.select(ahead.alias("ahead")).select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.slice("ahead", 1, n).alias("chain")) for n in sizes])).alias("g"))
    return chains.where("size(g.chain) = g.n").groupBy(F.array_join("g.chain", ">").alias("chain"), F.col("g.n").alias("n")).agg(F.count("*").alias("seen"))


_SHIFT = ", ".join(f"{f} AS {c}{k}" for c, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")) for k, f in ((0, f"lag({n}) OVER w"), (1, n), (2, f"lead({n}) OVER w"), (3, f"lead({n}, 2) OVER w")))
SINGLE_SQL = f""", sh AS (SELECT *, {_SHIFT} FROM ctx WINDOW w AS (PARTITION BY symbol ORDER BY open_ms)),
pp AS (SELECT *, {", ".join(f"{e} AS {k}" for k, e in PARTS.items())} FROM sh),
pat AS (SELECT symbol, open_ms, {", ".join(f"{_case(r)} AS {k}" for k, r in RULES.items())} FROM pp)"""
