import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barline.functions import text
from barline.operators import events, joins, patterns, simulate, stats
from barline.operators import indicators as I
from barline.plans import relational, sequential
from barline.sources.tables import daily_prices

HOUR = 3_600_000
SCHEMA = "symbol string, open_ms long, open double, high double, low double, close double, volume long, quote double"


def series(n, symbol="a", seed=1, skip=()):
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        o = price
        price = max(1.0, price * (1 + rng.uniform(-0.03, 0.03)))
        if i not in skip:
            out.append((symbol, i * HOUR, o, max(o, price) * 1.01, min(o, price) * 0.99, price, rng.randrange(1, 50), price * 3))
    return out


@pytest.fixture(scope="module")
def rows():
    return series(120)


@pytest.fixture(scope="module")
def bars(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def column(df, name):
    return [r[name] for r in df.orderBy("open_ms").collect()]


def test_sma_needs_a_full_window(bars, rows):
    got = column(bars.withColumn("x", I.sma("close", 20)), "x")
    close = [r[5] for r in rows]
    assert got[:19] == [None] * 19
    assert got[50] == pytest.approx(sum(close[31:51]) / 20)


def test_recursive_forms_follow_their_definition(bars, rows):
    close = [r[5] for r in rows]
    ema = sum(close[:12]) / 12
    for v in close[12:]:
        ema += (v - ema) * 2 / 13
    assert column(I.ema_recursive(bars, "close", 12), "ema")[-1] == pytest.approx(ema)
    moves = [b - a for a, b in zip(close, close[1:])]
    g, l = sum(max(m, 0) for m in moves[:14]) / 14, sum(max(-m, 0) for m in moves[:14]) / 14
    for m in moves[14:]:
        g, l = (g * 13 + max(m, 0)) / 14, (l * 13 + max(-m, 0)) / 14
    told = column(I.rsi_wilder(bars), "rsi")
    assert told[13] is None and told[-1] == pytest.approx(100 - 100 / (1 + g / l))


def test_later_bars_change_nothing_before(spark, rows, bars):
    """Causal events of a prefix are those of the whole, cut there."""
    part = events.causal(spark.createDataFrame(rows[:90], SCHEMA)).select("open_ms", "event_type")
    whole = events.causal(bars).select("open_ms", "event_type").where(F.col("open_ms") < 90 * HOUR)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.collect()))


def test_horizons_stop_at_gaps(spark):
    b = spark.createDataFrame(series(20, skip=(10,)), SCHEMA)
    got = {(r["open_ms"] // HOUR, r["horizon"]) for r in events.horizons(b).collect()}
    assert (8, 1) in got and (9, 1) not in got and (8, 3) not in got and (11, 6) in got


def test_pivots_are_strict_and_known_later(spark):
    highs = [1, 2, 5, 2, 1, 5, 5, 1, 1]
    b = spark.createDataFrame([("a", i * HOUR, 1.0, float(h), 0.5, 1.0, 1, 1.0) for i, h in enumerate(highs)], SCHEMA)
    got = events.pivots(b).collect()
    assert [(r["open_ms"] // HOUR, r["confirmed_ms"] // HOUR, r["kind"]) for r in got] == [(2, 4, "high")]


def test_first_rule_names_the_pattern(spark):
    # a fall, then a green body round it
    data = [("a", 0, 10.0, 10.1, 8.9, 9.0, 1, 1.0), ("a", HOUR, 8.9, 11.1, 8.8, 11.0, 1, 1.0)]
    b = spark.createDataFrame(data, SCHEMA).withColumn("trend", F.lit("sideways"))
    got = patterns.recognise(b).orderBy("open_ms").collect()
    assert got[0]["pattern2"] == "BullishEngulfing" and got[1]["shape"] == "BULLISH_ENGULFING" and got[1]["pattern2"] is None


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_against_a_loop(spark, strict):
    rng = random.Random(3)
    left = [(i, rng.randrange(3), rng.randrange(50)) for i in range(200)]
    right = sorted({(rng.randrange(3), t): None for t in rng.sample(range(50), 30)})
    right = [(k, t, float(10 * k + t) if t % 4 else None) for k, t in right]
    got = joins.as_of(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, s int, v double"), ["k"], "t", "s", ["s", "v"], strict)
    for r in got.collect():
        known = [(s, v) for k, s, v in right if k == r["k"] and (s < r["t"] if strict else s <= r["t"])]
        assert (r["s"], r["v"]) == (max(known) if known else (None, None))
    assert got.count() == 200


def test_merge_keeps_lineage(spark):
    kind = "k int, v double, available long, source string, flag boolean"
    old = spark.createDataFrame([(1, None, 5, "a", False), (2, 2.0, 5, "a", False), (3, 3.0, 5, "a", True)], kind)
    new = spark.createDataFrame([(1, 1.0, 9, "b", False), (2, 7.0, 9, "b", False), (4, 4.0, 9, "b", False)], kind)
    got = {r["k"]: tuple(r)[1:] for r in joins.merge_lineage(old, new, ["k"], ["v"], "available", "source", "flag").collect()}
    assert got == {1: (1.0, 9, "multiple", False), 2: (7.0, 5, "multiple", False), 3: (3.0, 5, "a", True), 4: (4.0, 9, "b", False)}


def test_false_discovery_steps_up(spark):
    p = [0.001, 0.02, 0.03, 0.9]
    got = stats.benjamini_yekutieli(spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "f string, i int, p double"), "p", ["f"], ["i"]).orderBy("i").collect()
    h = sum(1 / k for k in range(1, 5))
    raw = [v * 4 * h / (k + 1) for k, v in enumerate(p)]
    want = [min([1.0, *raw[k:]]) for k in range(4)]
    assert [r["q"] for r in got] == pytest.approx(want)


def test_normal_cdf(spark):
    got = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], "x double").select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - (1 + math.erf(r["x"] / math.sqrt(2))) / 2) < 1e-7 for r in got)


def test_bootstrap_of_a_constant_and_of_one_value(spark):
    x = spark.createDataFrame([("c", t, 2.0) for t in range(30)] + [("one", 0, 1.0)], "g string, t long, x double")
    got = {r["g"]: r for r in stats.block_bootstrap(x, ["g"], "x", "t", samples=50).collect()}
    assert (got["c"]["low"], got["c"]["high"], got["c"]["n"]) == (2.0, 2.0, 30) and got["one"]["p"] is None


def test_spacing_counts_from_the_last_kept(spark):
    got = spark.createDataFrame([([1, 3, 6, 7, 12, 13],)], "a array<long>").select(simulate.spaced(F.col("a"), 6).alias("k")).first()["k"]
    assert got == [1, 7, 13]


def test_controls_are_used_once_and_known_before(spark):
    e = spark.createDataFrame([("f", "c", 50), ("f", "c", 80)], "f string, context string, at long")
    c = spark.createDataFrame([("f", "c", a, a + 6) for a in (10, 20, 47, 60, 76)], "f string, context string, at long, available long")
    got = simulate.matched_controls(e, c, ["f"]).orderBy("event_at").collect()
    assert [(r["event_at"], r["control_at"]) for r in got] == [(50, 20), (80, 60)]


def test_amounts_and_folding(spark):
    x = spark.createDataFrame([("1.234.567",), ("(1,200)",), ("12,34",), ("-5",), (None,)], "s string")
    assert [r[0] if r[0] is None else int(r[0]) for r in x.select(text.amount(F.col("s"))).collect()] == [1234567, -1200, None, -5, None]
    assert spark.createDataFrame([("  Đà  Nẵng é",)], "s string").select(text.folded(F.col("s"))).first()[0].startswith("DA N")


def test_paths_draw_from_all_returns(spark):
    rows = [(s, k, 0.001 * (1 + k + 1500 * (s == "b"))) for s in "ab" for k in range(1500)]
    returns = spark.createDataFrame(rows, "symbol string, day int, r double").repartition(3)
    got = simulate.monte_carlo(returns, ["symbol", "day"], paths=200, trades=1, share=1.0, start=1.0).collect()
    want = {k: 1 + 0.001 * (1 + int(np.random.default_rng([42, k]).integers(0, 3000, 1)[0])) for k in range(200)}
    assert {r["path"]: round(r["final"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    fall = spark.createDataFrame([("a", 0, -0.41)], "symbol string, day int, r double")
    assert [r["ruined"] for r in simulate.monte_carlo(fall, ["symbol", "day"], paths=1, trades=1, share=1.0).collect()] == [True]
    assert [r["final"] for r in simulate.monte_carlo(fall.where("false"), ["symbol", "day"], paths=1).collect()] == [10_000.0]


def test_the_pool_is_every_symbols_returns(spark, monkeypatch):
    told = []
    monkeypatch.setattr(sequential.simulate, "monte_carlo", lambda returns, order: told.append(returns))
    sequential.QUERIES["monte_carlo_ruin"](spark, "/root/testdata/sf0.01")
    days = daily_prices(spark, "/root/testdata/sf0.01").groupBy("symbol").count().collect()
    assert len(days) == 5 and told[0].count() == sum(r["count"] - 1 for r in days)


def test_streams_count_every_event_whatever_the_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n = events.count()
    for k, part in enumerate(events.withColumn("p", F.ntile(4).over(Window.orderBy(F.desc("ts")))).where(f"p = {p}").drop("p") for p in (1, 2, 3, 4)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    run = lambda name: sequential.QUERIES[name](spark, str(tmp_path))
    bars = run("stream_tumbling_watermark")
    assert bars.agg(F.sum("n")).first()[0] == n and bars.where("start > 190000000000000").count() == 0
    assert run("stream_sessions").agg(F.sum("n")).first()[0] == events.select("event_id").distinct().count()
    d, q = events.where("event_id % 10 = 0").alias("d"), events.where("event_id % 10 <> 0").alias("q")
    met = d.join(q, F.expr("d.event_type = q.event_type AND q.ts > d.ts AND q.ts <= d.ts + INTERVAL 15 minutes"))
    assert run("stream_interval_fills").count() == met.count()


def test_queries_of_repeated_ids_all_count(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 4)], 0) for i in [*range(95, 105), *range(98, 102), 200, *range(5)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(relational.ORACLE_SQL["cosine_topk"]).fetchall()
    got = relational.QUERIES["cosine_topk"](spark, str(tmp_path)).collect()
    plain = lambda rows: sorted((int(a), int(b), round(float(s), 4)) for a, b, s in rows)
    assert plain(got) == plain(want)
