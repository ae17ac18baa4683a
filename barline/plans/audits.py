"""Queries that check series, forecasts and simulations against rules: backtests, drift, coverage, rolls, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.operators import simulate, stats
from barline.sources.tables import DAILY_SQL, daily_prices, table

QUERIES, ORACLE_SQL = {}, {}
R = lambda c: F.round(c, 6)
D = "(PARTITION BY symbol ORDER BY day"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _by_day() -> Window:
    return Window.partitionBy("symbol").orderBy("day")


@query(f"""WITH RECURSIVE {DAILY_SQL}, x AS (SELECT symbol, day, row_number() OVER {D}) AS i, close, avg(close) OVER {D} ROWS 19 PRECEDING) AS m, lead(close) OVER {D}) AS entry, lead(close, 5) OVER {D}) AS leave FROM daily),
s AS (SELECT * FROM x WHERE i >= 20 AND close > m AND leave IS NOT NULL),
w AS (SELECT symbol, min(i) AS i FROM s GROUP BY symbol UNION ALL SELECT w.symbol, (SELECT min(s.i) FROM s WHERE s.symbol = w.symbol AND s.i >= w.i + 5) FROM w WHERE w.i IS NOT NULL),
t AS (SELECT s.symbol, s.i, leave * (1 - CAST(0.0015 AS DOUBLE)) / (entry * (1 + CAST(0.0015 AS DOUBLE))) - 1 AS r FROM w JOIN s USING (symbol, i)),
e AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY i) AS lg FROM t), d AS (SELECT *, greatest(0, max(lg) OVER (PARTITION BY symbol ORDER BY i)) AS top FROM e)
SELECT symbol, count(*) AS trades, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS wins, round(arg_max(lg, i), 4) AS log_equity, round(max(1 - exp(lg - top)), 6) AS max_drawdown, round(avg(r) / stddev_samp(r), 6) AS sharpe,
  round(sum(greatest(r, 0)) / -sum(least(r, 0)), 6) AS profit_factor, CAST(count(*) * 5 AS BIGINT) AS bars_held FROM d GROUP BY symbol""")
def sequential_backtest(spark: SparkSession, d: str) -> DataFrame:
    """One position at a time: a signal fills at the next price, holds to the fifth, and signals meanwhile are skipped."""
    w = _by_day()
    x = daily_prices(spark, d).select("symbol", F.row_number().over(w).cast("long").alias("i"), "close", F.avg("close").over(w.rowsBetween(-19, 0)).alias("m"), F.lead("close").over(w).alias("entry"), F.lead("close", 5).over(w).alias("leave"))
    s = x.where("i >= 20 AND close > m AND leave IS NOT NULL")
    taken = s.groupBy("symbol").agg(F.array_sort(F.collect_list("i")).alias("all")).select("symbol", F.explode(simulate.spaced(F.col("all"), 5)).alias("i"))
    t = s.join(taken, ["symbol", "i"]).select("symbol", "i", simulate.round_trip(F.col("entry"), F.col("leave"), 0.0015, 0.0).alias("r"))
    upto = Window.partitionBy("symbol").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    e = t.withColumn("lg", F.sum(F.log1p("r")).over(upto)).withColumn("top", F.greatest(F.lit(0.0), F.max("lg").over(upto)))
    g = e.groupBy("symbol").agg(
        F.count("*").alias("trades"), R(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0))).alias("wins"), F.round(F.max_by("lg", "i"), 4).alias("log_equity"), R(F.max(1 - F.exp(F.col("lg") - F.col("top")))).alias("max_drawdown"),
        R(F.avg("r") / F.stddev_samp("r")).alias("sharpe"), R(F.sum(F.greatest("r", F.lit(0.0))) / -F.sum(F.least("r", F.lit(0.0)))).alias("profit_factor"),
    )
    return g.withColumn("bars_held", F.col("trades") * 5)


@query("""WITH x AS (SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND doc_id IS NOT NULL), n AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM x GROUP BY lang)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM x) SELECT lang, doc_id FROM k, n WHERE r <= least""")
def undersampled_classes(spark: SparkSession, d: str) -> DataFrame:
    """As many rows of each class as the rarest has: a sampling operator, by a hash."""
    x = table(spark, d, "documents").where("lang IS NOT NULL AND doc_id IS NOT NULL").select("lang", "doc_id")
    least = x.groupBy("lang").count().agg(F.min("count").alias("least"))
    w = Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id")
    return x.withColumn("r", F.row_number().over(w)).join(F.broadcast(least), F.col("r") <= F.col("least")).select("lang", "doc_id")


@query("""WITH x AS (SELECT CAST(ts AS DATE) AS day, value, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y, least(0.99, greatest(0.01, (user_id % 100) / 100.0)) AS p FROM events), m AS (SELECT max(day) AS last FROM x),
w AS (SELECT CASE WHEN day > last - INTERVAL 7 DAY THEN 'recent' ELSE 'before' END AS part, count(*) AS n, avg((p - y) * (p - y)) AS brier, avg(y) AS rate FROM x, m GROUP BY 1)
SELECT part, n, round(brier, 6) AS brier, round(rate, 6) AS rate, brier > 1.1 * min(brier) FILTER (part = 'before') OVER () AS drifted FROM w""")
def drift_check(spark: SparkSession, d: str) -> DataFrame:
    """The score of the last seven days against that of all before, and whether it is a tenth worse."""
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), (F.col("user_id") % 100) / 100.0))
    y = F.when(F.col("value") > 50, 1).otherwise(0)
    x = table(spark, d, "events").select(F.to_date("ts").alias("day"), y.alias("y"), ((p - y) * (p - y)).alias("b"))
    g = x.groupBy("day").agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.sum("y").alias("y"))  # a row a day
    whole = Window.partitionBy()
    part = F.when(F.col("day") > F.date_sub(F.max("day").over(whole), 7), "recent").otherwise("before")
    w = g.withColumn("part", part).groupBy("part").agg(F.sum("n").alias("n"), (F.sum("b") / F.sum("n")).alias("brier"), (F.sum("y") / F.sum("n")).alias("rate"))
    base = F.min(F.when(F.col("part") == "before", F.col("brier"))).over(whole)
    return w.select("part", "n", R("brier").alias("brier"), R("rate").alias("rate"), (F.col("brier") > 1.1 * base).alias("drifted"))


@query(f"""WITH {DAILY_SQL}, e AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS ex, count(*) AS n FROM orders WHERE o_totalprice > 300000 AND o_custkey % 50 = 0 GROUP BY 1, 2),
c AS (SELECT *, lag(close) OVER {D}) AS before, lead(close) OVER {D}) AS after FROM daily) SELECT e.symbol, ex, n, round(close / before - 1, 6) AS gap, round(after / close - 1, 6) AS next FROM e JOIN c ON c.symbol = e.symbol AND c.day = e.ex""")
def ex_date_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Corporate events with the price moves into and out of their day."""
    e = table(spark, d, "orders").where("o_totalprice > 300000 AND o_custkey % 50 = 0").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("ex")).agg(F.count("*").alias("n"))
    w = _by_day()
    c = daily_prices(spark, d).withColumn("gap", F.col("close") / F.lag("close").over(w) - 1).withColumn("next", F.lead("close").over(w) / F.col("close") - 1).withColumnRenamed("day", "ex")
    return e.join(c, ["symbol", "ex"]).select("symbol", "ex", "n", R("gap").alias("gap"), R("next").alias("next"))


@query(f"""WITH {DAILY_SQL}, f AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS month FROM daily), x AS (SELECT month, CAST(month + INTERVAL 14 DAY AS DATE) AS expiry FROM f)
SELECT d.symbol, d.day, (SELECT min(expiry) FROM x WHERE x.expiry >= d.day) AS front, coalesce((SELECT min(expiry) FROM x WHERE x.expiry >= d.day) <> lag((SELECT min(expiry) FROM x WHERE x.expiry >= d.day)) OVER (PARTITION BY d.symbol ORDER BY d.day), false) AS roll FROM daily d""")
def front_month_rolls(spark: SparkSession, d: str) -> DataFrame:
    """Each day's earliest contract that has not expired, and the days on which it changes: the contract is found by sorting
    days and expiries together, not by a range join."""
    x = daily_prices(spark, d).select("symbol", "day")
    expiries = x.select(F.trunc("day", "month").alias("m")).distinct().select(F.date_add("m", 14).alias("expiry"))
    days = x.select("day").distinct().select("day", F.lit(None).cast("date").alias("expiry"))
    both = days.unionByName(expiries.select(F.col("expiry").alias("day"), "expiry"))
    ahead = Window.orderBy("day", F.col("expiry").isNull().desc()).rowsBetween(0, Window.unboundedFollowing)  # a row a day
    front = both.withColumn("front", F.min("expiry").over(ahead)).where("expiry IS NULL").select("day", "front")
    w = _by_day()
    return x.join(front, "day").select("symbol", "day", "front", F.coalesce(F.col("front") != F.lag("front").over(w), F.lit(False)).alias("roll"))


@query(f"""WITH {DAILY_SQL}, p AS (SELECT symbol, min(day) AS first_day, max(day) AS last_day, count(*) AS bars, count(*) FILTER (close IS NULL) AS empty FROM daily GROUP BY symbol), s AS (SELECT count(DISTINCT day) AS sessions FROM daily)
SELECT symbol, first_day, last_day, bars, empty, sessions - bars AS missing, round(bars / sessions, 6) AS coverage FROM p, s""")
def snapshot_coverage(spark: SparkSession, d: str) -> DataFrame:
    x = daily_prices(spark, d)
    s = x.agg(F.countDistinct("day").alias("sessions"))
    p = x.groupBy("symbol").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("bars"), F.count_if(F.col("close").isNull()).alias("empty"))
    return p.crossJoin(F.broadcast(s)).select("symbol", "first_day", "last_day", "bars", "empty", (F.col("sessions") - F.col("bars")).alias("missing"), R(F.col("bars") / F.col("sessions")).alias("coverage"))


@query("""WITH x AS (SELECT event_type AS kind, user_id % 10 AS k, value FROM events), m AS (SELECT kind, k, avg(value) AS m, count(*) AS n FROM x GROUP BY ALL), p AS (SELECT kind, k, n / sum(n) OVER (PARTITION BY kind) AS p, CASE WHEN n >= 100 THEN m ELSE 50.0 END AS m FROM m)
SELECT kind, round(sum(p * m), 6) AS expected, round(sum(p), 6) AS total FROM p GROUP BY kind""")
def weighted_expectation(spark: SparkSession, d: str) -> DataFrame:
    """Class means by their probabilities; a class of too few rows counts with a nominal value."""
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("k")).agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    p = m.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("kind"))).withColumn("m", F.when(F.col("n") >= 100, F.col("m")).otherwise(50.0))
    return p.groupBy("kind").agg(R(F.sum(F.col("p") * F.col("m"))).alias("expected"), R(F.sum("p")).alias("total"))


@query("""SELECT o_custkey, o_orderkey, CAST(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END, TIMESTAMP '1990-01-01') AS DATE) AS shown FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END, TIMESTAMP '1990-01-01') DESC, o_orderkey) <= 2""")
def latest_titles(spark: SparkSession, d: str) -> DataFrame:
    """The two newest of each owner by publication, or else by when they were fetched."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate")), F.lit("1990-01-01").cast("date")).alias("shown"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("shown"), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")


@query("""WITH a AS (SELECT * FROM (VALUES ('view', 'VIEW'), ('click', 'CLICK'), ('purchase', 'BUY')) t(alias, name)) SELECT event_type, coalesce(name, 'unknown:' || event_type) AS name, count(*) AS n FROM events LEFT JOIN a ON alias = event_type GROUP BY 1, 2""")
def registry_names(spark: SparkSession, d: str) -> DataFrame:
    """Aliases by a declared registry; what it lacks is named, not dropped."""
    names = F.create_map(*[F.lit(x) for pair in (("view", "VIEW"), ("click", "CLICK"), ("purchase", "BUY")) for x in pair])
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy("event_type", F.coalesce(F.element_at(names, kind), F.concat(F.lit("unknown:"), kind)).alias("name")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT user_id % 20 AS k, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT k, n_view, n_click, n_purchase FROM (SELECT k, coalesce(max(n) FILTER (event_type = 'view'), 0) AS n_view, coalesce(max(n) FILTER (event_type = 'click'), 0) AS n_click, coalesce(max(n) FILTER (event_type = 'purchase'), 0) AS n_purchase FROM c GROUP BY k)""")
def breakdown_map(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a key as a map, and named entries of it with their zero."""
    c = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("k"), "event_type").count()
    m = c.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("m"))
    return m.select("k", *[F.coalesce(F.element_at("m", F.lit(x)), F.lit(0)).cast("long").alias(f"n_{x}") for x in ("view", "click", "purchase")])


def _trials(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Moments of each trial's returns (a row a symbol), and one row (v, trials): the variance of their Sharpe ratios, at
    least the mean of what each estimate varies by itself."""
    r = daily_prices(spark, d).withColumn("r", F.col("close") / F.lag("close").over(_by_day()) - 1)
    m = r.groupBy("symbol").agg(F.count("r").alias("n"), *stats.moments("r")).withColumn("sr", F.col("mean") / F.col("sd"))
    own = F.greatest(F.lit(0.0), 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")) / (F.col("n") - 1)
    return m, m.agg(F.greatest(F.var_samp("sr"), F.avg(own)).alias("v"), F.count("*").alias("trials"))


@query(f"""WITH {DAILY_SQL}, r AS (SELECT symbol, close / lag(close) OVER {D}) - 1 AS r FROM daily), q AS (SELECT symbol, count(r) AS n, avg(r) AS m, avg(r) / stddev_samp(r) AS sr, stddev_pop(r) AS sp, avg(r * r) AS r2, avg(r * r * r) AS r3, kurtosis_pop(r) + 3 AS kurt FROM r GROUP BY symbol),
m AS (SELECT symbol, n, sr, greatest(0, 1 - (r3 - 3 * m * r2 + 2 * m * m * m) / (sp * sp * sp) * sr + (kurt - 1) / 4 * sr * sr) / (n - 1) AS own FROM q), v AS (SELECT greatest(var_samp(sr), avg(own)) AS v, count(*) AS trials FROM m)
SELECT symbol, n, round(sr, 6) AS sharpe, round(sqrt(v), 6) AS spread, trials FROM m, v""")
def sharpe_spread(spark: SparkSession, d: str) -> DataFrame:
    """Sharpe ratios of all trials and their spread."""
    m, v = _trials(spark, d)
    return m.crossJoin(F.broadcast(v)).select("symbol", "n", R("sr").alias("sharpe"), R(F.sqrt("v")).alias("spread"), "trials")


def deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    """The chance that each trial's Sharpe ratio is over zero, and over the best to expect of so many trials; tested against
    a plain version."""
    m, v = _trials(spark, d)
    x = m.crossJoin(F.broadcast(v))
    best = stats.expected_best(F.col("trials"), F.sqrt(F.col("v")))
    return x.select("symbol", R(stats.probabilistic_sharpe(F.col("sr"), F.lit(0.0), F.col("n"), F.col("skew"), F.col("kurt"))).alias("psr"), R(stats.probabilistic_sharpe(F.col("sr"), best, F.col("n"), F.col("skew"), F.col("kurt"))).alias("dsr"))


QUERIES["deflated_sharpe"] = deflated_sharpe


def _draw_sql(block: int, circular: bool, name: str) -> str:
    starts = "n" if circular else f"n - {block} + 1"
    at = "1 + (start + o) % n" if circular else "1 + start + o"
    return f"""SELECT '{name}' AS method, b.kind, b.sample, sum(x.v) / any_value(n) AS mean FROM (SELECT kind, n, sample, k, least({block}, n - k * {block}) AS len, CAST(('0x' || substr(md5('42:' || sample || ':' || k), 1, 8)) AS BIGINT) % ({starts}) AS start
  FROM (SELECT kind, n, sample, CAST(unnest(range(0, CAST(ceil(n / {block}) AS BIGINT))) AS BIGINT) AS k FROM (SELECT kind, n, CAST(unnest(range(0, 20)) AS BIGINT) AS sample FROM s))) b, LATERAL (SELECT unnest(range(0, CAST(len AS BIGINT))) AS o) q JOIN x ON x.kind = b.kind AND x.i = {at} GROUP BY b.kind, b.sample"""


@query(f"""WITH x AS (SELECT event_type AS kind, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, value - 50 AS v FROM events), s AS (SELECT kind, count(*) AS n FROM x GROUP BY kind),
m AS ({_draw_sql(8, True, 'circular')} UNION ALL {_draw_sql(8, False, 'plain')} UNION ALL {_draw_sql(1, True, 'iid')})
SELECT method, kind, round(avg(mean), 6) AS mean, round(quantile_cont(mean, 0.05), 6) AS low, round(quantile_cont(mean, 0.95), 6) AS high, round((1 + count(*) FILTER (mean <= 0)) / (count(*) + 1), 6) AS p FROM m GROUP BY method, kind""")
def bootstrap_methods(spark: SparkSession, d: str) -> DataFrame:
    """Means of 20 samples of each kind's values by circular blocks, by blocks that end inside, and one by one."""
    x = table(spark, d, "events").select(F.col("event_type").alias("kind"), "event_id", (F.col("value") - 50).alias("v")).where("kind IS NOT NULL")
    out = None
    for method, block, circular in (("circular", 8, True), ("plain", 8, False), ("iid", 1, True)):
        m = stats.block_means(x, ["kind"], "v", ["event_id"], 20, block, circular).withColumn("method", F.lit(method))
        out = m if out is None else out.unionByName(m)
    q = F.percentile("mean", F.array(F.lit(0.05), F.lit(0.95)))
    g = out.groupBy("method", "kind").agg(F.avg("mean").alias("m"), q.alias("q"), ((1 + F.count_if(F.col("mean") <= 0)) / (F.count("*") + 1)).alias("p"))
    return g.select("method", "kind", R("m").alias("mean"), R(F.col("q")[0]).alias("low"), R(F.col("q")[1]).alias("high"), R("p").alias("p"))


@query("""WITH e AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), k AS (SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type FROM events))
SELECT k.user_id, k.event_type, l.event_id AS filled_from FROM k LEFT JOIN (SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) l USING (user_id, event_type) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type)""")
def incremental_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    """Declared keys that are not there yet, with what another source has for them."""
    e = table(spark, d, "events")
    grid = e.select("user_id").distinct().join(F.broadcast(e.agg(F.collect_set("event_type").alias("all"))), F.lit(True)).select("user_id", F.explode("all").alias("event_type"))  # the types are few
    have = e.where("event_id % 2 = 0").select("user_id", "event_type").distinct()
    other = e.where("event_id % 2 = 1").groupBy("user_id", "event_type").agg(F.min("event_id").alias("filled_from"))
    keys = ["user_id", "event_type"]
    return grid.join(have, keys, "left_anti").join(other, keys, "left").select(*keys, "filled_from")


@query("""WITH f AS (SELECT user_id % 200 AS id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS fill, CASE WHEN event_id % 5 = 0 THEN value END AS outcome FROM events)
SELECT id, round(arg_min(fill, event_id) FILTER (fill IS NOT NULL), 6) AS fill, round(arg_min(outcome, event_id) FILTER (outcome IS NOT NULL), 6) AS outcome, count(fill) - CASE WHEN count(fill) > 0 THEN 1 ELSE 0 END AS refused FROM f GROUP BY id""")
def write_once_fields(spark: SparkSession, d: str) -> DataFrame:
    """Each field keeps its first value; later ones are refused and counted."""
    f = table(spark, d, "events").select((F.col("user_id") % 200).alias("id"), "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("fill"), F.when(F.col("event_id") % 5 == 0, F.col("value")).alias("outcome"))
    first = lambda c: R(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("event_id")))).alias(c)
    return f.groupBy("id").agg(first("fill"), first("outcome"), F.greatest(F.count("fill") - 1, F.lit(0)).cast("long").alias("refused"))


@query(f"""WITH {DAILY_SQL}, n AS (SELECT symbol, day, lead(close) OVER {D}) AS entry, lead(close, 21) OVER {D}) AS leave, close / lag(close, 20) OVER {D}) - 1 AS score FROM daily),
m AS (SELECT *, leave / entry - 1 AS r FROM n WHERE leave IS NOT NULL AND score IS NOT NULL), q AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, symbol) AS k, count(*) OVER (PARTITION BY day) AS c FROM m WHERE (day - DATE '1990-01-01') % 20 = 0)
SELECT day, c AS members, round(avg(r) FILTER (k <= 2), 6) AS top, round(avg(r) FILTER (k > c - 2), 6) AS bottom, round(avg(r) FILTER (k <= 2) - avg(r) FILTER (k > c - 2), 6) AS spread, round(avg(r) FILTER (k <= 2) - CAST(0.004 AS DOUBLE), 6) AS net FROM q WHERE c >= 3 GROUP BY day, c""")
def forward_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Matured decisions only: the best and worst two by momentum from the next price to the twenty-first, and their spread."""
    w = _by_day()
    n = daily_prices(spark, d).select("symbol", "day", (F.lead("close", 21).over(w) / F.lead("close").over(w) - 1).alias("r"), (F.col("close") / F.lag("close", 20).over(w) - 1).alias("score"))
    m = n.where("r IS NOT NULL AND score IS NOT NULL AND datediff(day, DATE '1990-01-01') % 20 = 0")
    day = Window.partitionBy("day")
    q = m.withColumn("k", F.row_number().over(day.orderBy(F.desc("score"), "symbol"))).withColumn("c", F.count("*").over(day)).where("c >= 3")
    of = lambda c: F.avg(F.when(c, F.col("r")))
    top, low = of(F.col("k") <= 2), of(F.col("k") > F.col("c") - 2)
    return q.groupBy("day", F.col("c").alias("members")).agg(R(top).alias("top"), R(low).alias("bottom"), R(top - low).alias("spread"), R(top - 0.004).alias("net"))


@query(f"""WITH {DAILY_SQL}, n AS (SELECT *, row_number() OVER {D}) - 1 AS prior FROM daily), q AS (SELECT day, count(*) AS members FROM n WHERE prior >= 260 GROUP BY day HAVING count(*) >= 3) SELECT min(day) AS first_day, count(*) AS days FROM q""")
def first_qualifying_session(spark: SparkSession, d: str) -> DataFrame:
    """The first day on which three members have 260 prices before it."""
    n = daily_prices(spark, d).withColumn("prior", F.row_number().over(_by_day()) - 1).where("prior >= 260")
    return n.groupBy("day").agg(F.count("*").alias("members")).where("members >= 3").agg(F.min("day").alias("first_day"), F.count("*").alias("days"))


@query("""WITH b AS (SELECT event_type AS symbol, CASE WHEN value > 100 THEN 'above' ELSE 'below' END AS side, CAST(floor(value / 10) AS BIGINT) AS bin, count(*) AS volume FROM events GROUP BY ALL)
SELECT symbol, side, bin, volume, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY volume DESC, bin) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY symbol, side ORDER BY volume DESC, bin) <= 3""")
def top_bins_per_side(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), F.when(F.col("value") > 100, "above").otherwise("below").alias("side"), F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").alias("volume"))
    w = Window.partitionBy("symbol", "side").orderBy(F.desc("volume"), "bin")
    return b.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("symbol", "side", "bin", "volume", "rank")


@query(f"""WITH {DAILY_SQL}, r AS (SELECT symbol, day, ln(close / lag(close) OVER {D}) ) AS r, close FROM daily), x AS (SELECT *, lag(close, 21) OVER w AS c21, lag(close, 126) OVER w AS c126, stddev_samp(r) OVER s AS sd, count(r) OVER s AS ns, max(close) OVER y AS top, count(*) OVER y AS ny FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day), s AS (PARTITION BY symbol ORDER BY day ROWS 59 PRECEDING), y AS (PARTITION BY symbol ORDER BY day ROWS 251 PRECEDING))
SELECT symbol, day, round(c21 / c126 - 1, 6) AS momentum, round(close / c21 - 1, 6) AS reversal, CASE WHEN ns = 60 THEN round(-sd, 6) END AS low_volatility, CASE WHEN ny = 252 THEN round(close / top, 6) END AS of_high FROM x""")
def causal_equity_features(spark: SparkSession, d: str) -> DataFrame:
    """Momentum without the last month, reversal, low volatility and the nearness of the year's high; null without a full window."""
    w = _by_day()
    s, y = w.rowsBetween(-59, 0), w.rowsBetween(-251, 0)
    r = daily_prices(spark, d).withColumn("r", F.log(F.col("close") / F.lag("close").over(w)))
    c = F.col("close")
    return r.select("symbol", "day", R(F.lag("close", 21).over(w) / F.lag("close", 126).over(w) - 1).alias("momentum"), R(c / F.lag("close", 21).over(w) - 1).alias("reversal"), F.when(F.count("r").over(s) == 60, R(-F.stddev_samp("r").over(s))).alias("low_volatility"), F.when(F.count("*").over(y) == 252, R(c / F.max("close").over(y))).alias("of_high"))


@query(f"""WITH {DAILY_SQL}, a AS (SELECT symbol, day, close FROM daily), b AS (SELECT symbol, day, close * CASE WHEN day >= DATE '1997-01-01' THEN 1 + CAST(1e-12 AS DOUBLE) ELSE 1 END + CASE WHEN day = DATE '1996-06-03' THEN 1 ELSE 0 END AS close FROM daily)
SELECT a.symbol, count(*) AS days, count(*) FILTER (abs(a.close - b.close) > 1e-6) AS differ, round(max(abs(a.close - b.close)), 4) AS most FROM a JOIN b USING (symbol, day) GROUP BY a.symbol""")
def stored_parity(spark: SparkSession, d: str) -> DataFrame:
    """What is computed against what was stored (one day differs on purpose, others by a rounding)."""
    a = daily_prices(spark, d)
    tiny = F.when(F.col("day") >= "1997-01-01", 1 + 1e-12).otherwise(1.0)
    b = a.select("symbol", "day", (F.col("close") * tiny + F.when(F.col("day") == "1996-06-03", 1).otherwise(0)).alias("stored"))
    gap = F.abs(F.col("close") - F.col("stored"))
    return a.join(b, ["symbol", "day"]).groupBy("symbol").agg(F.count("*").alias("days"), F.count_if(gap > 1e-6).alias("differ"), F.round(F.max(gap), 4).alias("most"))


@query("""WITH x AS (SELECT label % 2 AS y, embedding FROM embeddings), u AS (SELECT y, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS i FROM x), m AS (SELECT i, abs(avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / stddev_samp(v) AS weight FROM u GROUP BY i)
SELECT CAST(i AS INTEGER) AS feature, round(weight, 5) AS weight FROM m ORDER BY weight DESC, i LIMIT 10""")
def feature_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The ten features whose means differ most between classes: a top-k report."""
    u = table(spark, d, "embeddings").select((F.col("label") % 2).alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "v"))
    of = lambda k: F.avg(F.when(F.col("y") == k, F.col("v")))
    m = u.groupBy("feature").agg((F.abs(of(1) - of(0)) / F.stddev_samp("v")).alias("weight"))
    return m.orderBy(F.desc("weight"), "feature").limit(10).select("feature", F.round("weight", 5).alias("weight"))


@query("""WITH p AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, value - 60 AS pnl FROM events), f AS (SELECT *, sum(pnl) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS 3 PRECEDING) < -100 AS trip FROM p),
l AS (SELECT *, max(CASE WHEN trip THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tripped FROM f)
SELECT event_id, trip, coalesce(t - tripped < 86400000, false) AS halted FROM l""")
def breaker_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Whether four trades together lose too much, and whether that happened within the last day: no trades meanwhile."""
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    p = table(spark, d, "events").select("user_id", "event_id", F.expr("unix_millis(to_utc_timestamp(cast(ts AS timestamp), current_timezone()))").alias("t"), (F.col("value") - 60).alias("pnl"))
    f = p.withColumn("trip", F.sum("pnl").over(w.rowsBetween(-3, 0)) < -100)
    last = F.max(F.when(F.col("trip"), F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return f.select("event_id", "trip", F.coalesce(F.col("t") - last < 86_400_000, F.lit(False)).alias("halted"))
