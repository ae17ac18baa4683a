"""Statistics of evidence: effect sizes, intervals, false discovery, calibration, rank correlation, risk."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effect(x: str) -> list[Column]:
    """n, mean, median, mean over sample deviation, and the shares of positive, zero and negative values."""
    c, n = F.col(x), F.count(x)
    share = lambda cond: F.when(n > 0, F.count_if(cond) / n)
    return [n.alias("n"), F.avg(c).alias("mean"), F.percentile(c, 0.5).alias("median"), F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c)).alias("effect"), share(c > 0).alias("positive"), share(c == 0).alias("ties"), share(c < 0).alias("negative")]


def t_statistic(x: str) -> Column:
    """Mean over standard error; null for under two values or no spread."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) > 1) & (sd > 0), F.avg(x) / (sd / F.sqrt(F.count(x))))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson's interval of a share, clipped to [0, 1]; null without trials."""
    p, z2 = hits / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.when(n > 0, F.greatest((mid - half) / (1 + z2 / n), F.lit(0.0))), F.when(n > 0, F.least((mid + half) / (1 + z2 / n), F.lit(1.0)))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by the rational approximation of Abramowitz and Stegun 26.2.17 (error under 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def benjamini_yekutieli(tests: DataFrame, p: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds q: step-up values under any dependence, over the tests of each group (a group is a family of hypotheses)."""
    w = Window.partitionBy(*by).orderBy(p, *order)
    whole = Window.partitionBy(*by)
    x = tests.withColumn("_k", F.row_number().over(w)).withColumn("_m", F.count("*").over(whole))
    x = x.withColumn("_h", F.sum(1 / F.col("_k")).over(whole)).withColumn("_raw", F.col(p) * F.col("_m") * F.col("_h") / F.col("_k"))
    return x.withColumn("q", F.least(F.min("_raw").over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))).drop("_k", "_m", "_h", "_raw")


def mean_rank(x: str, by: list[str]) -> Column:
    """Rank with ties at their mean."""
    ties = F.count("*").over(Window.partitionBy(*by, x))
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (ties - 1) / 2


def rank_ic(panel: DataFrame, score: str, target: str, by: list[str], least: int = 3) -> DataFrame:
    """(by, n, ic): Spearman's correlation of score and target in each group over complete pairs; null under `least` or when constant."""
    x = panel.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    x = x.withColumn("_a", mean_rank(score, by)).withColumn("_b", mean_rank(target, by))
    told = x.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("_a", "_b").alias("_c"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"))
    return told.withColumn("ic", F.when((F.col("n") >= least) & (F.col("_sa") > 0) & (F.col("_sb") > 0), F.col("_c") / (F.col("_sa") * F.col("_sb")))).drop("_c", "_sa", "_sb")


def moments(x: str) -> list[Column]:
    """mean, sample deviation, population skewness and plain (not excess) kurtosis."""
    return [F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt")]


def block_bootstrap(groups: DataFrame, by: list[str], x: str, at: str, block: int = 8, samples: int = 2000, seed: int = 42) -> DataFrame:
    """(by, n, mean, low, high, p): moving-block bootstrap of each group's mean; the last block is cut to fit.

    Sums of blocks come from prefix sums, so a draw costs as many look-ups as there are blocks; draws run in batches of
    bounded size. p: (1 + draws of the centred mean at least as far from 0) / (samples + 1).
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(at)[x].dropna().to_numpy(float)
        n = len(v)
        if n < 2:
            return pd.DataFrame([[*key, n, v.mean() if n else None, None, None, None]])
        size = max(1, min(block, n // 2))
        whole, rest = divmod(n, size)
        total = np.concatenate([[0.0], np.cumsum(v - v.mean())])
        rng, out = np.random.default_rng(seed), []
        for k in range(0, samples, 256):
            draw = rng.integers(0, n - size + 1, (min(256, samples - k), whole + (rest > 0)))
            length = np.full(draw.shape[1], size)
            if rest:
                length[-1] = rest
            out.append((total[draw + length] - total[draw]).sum(1) / n)
        means = np.concatenate(out)
        low, high = v.mean() + np.quantile(means, [0.025, 0.975])
        return pd.DataFrame([[*key, n, v.mean(), low, high, (1 + (np.abs(means) >= abs(v.mean())).sum()) / (samples + 1)]])

    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    schema = ", ".join([f"{k} {kinds[k]}" for k in by] + ["n long, mean double, low double, high double, p double"])
    return groups.select(*by, at, x).groupBy(*by).applyInPandas(run, schema)


#: The rational approximation of the normal quantile in the centre and in the tails (error under 1.2e-9).
_MID = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_MID_UNDER = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
_TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_TAIL_UNDER = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)


def normal_quantile(p: Column) -> Column:
    """The inverse of the standard normal distribution for 0 < p < 1."""

    def poly(x: Column, cs: tuple[float, ...]) -> Column:
        out = F.lit(cs[0])
        for c in cs[1:]:
            out = out * x + c
        return out

    def tail(q: Column) -> Column:
        r = F.sqrt(-2 * F.log(q))
        return poly(r, _TAIL) / (poly(r, _TAIL_UNDER) * r + 1)

    d = p - 0.5
    mid = poly(d * d, _MID) * d / (poly(d * d, _MID_UNDER) * d * d + 1)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(mid)


def probabilistic_sharpe(ratio: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """The chance that the true ratio is over the benchmark, from n returns of that skewness and (not excess) kurtosis; null
    for n under 2."""
    spread = F.greatest(1 - skew * ratio + (kurt - 1) / 4 * ratio * ratio, F.lit(1e-12))
    return F.when(n > 1, normal_cdf((ratio - benchmark) * F.sqrt(n - 1) / F.sqrt(spread)))


def expected_best(trials: Column, spread: Column) -> Column:
    """The best ratio to expect of so many trials without merit whose ratios have that deviation; 0 for one trial."""
    euler = 0.5772156649015329
    return F.when(trials > 1, spread * ((1 - euler) * normal_quantile(1 - 1 / trials) + euler * normal_quantile(1 - 1 / (trials * 2.718281828459045)))).otherwise(0.0)


#: Places of a group's values that a task holds, and draws that it makes at a time.
SPAN, DRAWS = 1 << 14, 1 << 17


def _draws(by: list[str], span: int, seed: int):
    """Rows (by, sample, _slice, _n, _b, _starts), sorted by sample and slice, to rows (by, _chunk, sample, _len, _at): the
    starts of a slice's blocks, packed by the chunk of places that they lie in and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, drawn = None, np.zeros(0, np.int64)
        for batch in batches:
            for i, row in enumerate(batch.select(["sample", "_slice", "_n", "_b", "_starts"]).to_pylist()):
                sample, first, n, b = row["sample"], row["_slice"] * DRAWS, row["_n"], row["_b"]
                whole = -(-n // b)
                many = min(DRAWS, whole - first)
                if of != (sample, first):
                    of, drawn = (sample, first), drawn[:0]
                if len(drawn) < many:  # the groups share their hashes
                    head = f"{seed}:{sample}:".encode()
                    more = b"".join(md5(b"%b%d" % (head, k)).digest()[:4] for k in range(first + len(drawn), first + many))
                    drawn = np.append(drawn, np.frombuffer(more, ">u4").astype(np.int64))
                start, length = drawn[:many] % row["_starts"], np.full(many, b)
                if first + many == whole:
                    length[-1] = n - (whole - 1) * b
                chunk = start // span
                order = np.lexsort((length, chunk))
                chunk, length, start = chunk[order], length[order], (start - chunk * span).astype("<i4")[order]
                begin = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (length[1:] != length[:-1])))
                own = [batch.column(c).take(pa.array(np.full(len(begin), i))) for c in by]
                packed = [part.tobytes() for part in np.split(start, begin[1:])]
                yield pa.record_batch([*own, pa.array(chunk[begin]), pa.array(np.full(len(begin), sample)), pa.array(length[begin]), pa.array(packed, pa.binary())], names=[*by, "_chunk", "sample", "_len", "_at"])

    return run


def _totals(by: list[str]):
    """The values of a chunk of places and the starts in it to (by, sample, total)."""

    def run(values: pa.Table, draws: pa.Table) -> pa.Table:
        v = values.column("_v").to_numpy()[np.argsort(values.column("_place").to_numpy())]
        sums: dict[int, np.ndarray] = {}  # of as many neighbours as a block has, by their first
        total: dict[int, float] = {}
        for sample, length, at in zip(*(draws.column(c).to_pylist() for c in ("sample", "_len", "_at")), strict=True):
            if length not in sums:
                most = max(len(v) - length + 1, 0)
                sums[length] = np.zeros(most)
                for o in range(length):
                    sums[length] += v[o : o + most]
            total[sample] = total.get(sample, 0.0) + float(sums[length][np.frombuffer(at, "<i4")].sum())
        own = [draws.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(total), np.int64))) for c in by]
        return pa.table([*own, pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.float64())], names=[*by, "sample", "_total"])

    return run


def block_means(values: DataFrame, by: list[str], x: str, order: list[str], samples: int, block: int, circular: bool, seed: int = 42) -> DataFrame:
    """(by, sample, mean): means of n values drawn in blocks of neighbours with replacement, n as many as a group has.

    A block's start is a hash of seed, sample and block number, modulo n (circular: a block runs on at the start again) or
    modulo the starts at which a whole block fits; the last block is cut to what is missing. A sample of n values has
    n / block draws, each one look-up; block 1 draws single values. Groups with fewer values than a block use blocks of
    their size. Draws go to the values in packs of 4 bytes each, by chunks of SPAN places, so that a task holds a chunk and
    its draws whatever the group's size.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    span = max(SPAN, block)
    sound = values.where(F.col(x).isNotNull())
    sizes = sound.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_b", F.least(F.lit(block).cast("long"), "_n"))
    draws = sizes.withColumn("_starts", F.col("_n") if circular else F.col("_n") - F.col("_b") + 1).withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
    draws = draws.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.ceil(F.col("_n") / F.col("_b")) - 1) / DRAWS).cast("long"))))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sizes.select(*by).schema)
    dealt = draws.repartition("sample", "_slice").sortWithinPartitions("sample", "_slice")
    packed = dealt.mapInArrow(_draws(by, span, seed), f"{kinds}, _chunk long, sample long, _len long, _at binary")
    # a place for each value, places past the end for the first ones; a chunk also has those that its last blocks run on to
    numbered = sound.select(*by, F.col(x).cast("double").alias("_v"), (F.row_number().over(w) - 1).cast("long").alias("_place"))
    if circular and block > 1:
        again = numbered.where(F.col("_place") < block - 1).join(sizes.select(*by, "_n"), by).select(*by, "_v", (F.col("_place") + F.col("_n")).alias("_place"))
        numbered = numbered.unionByName(again)
    at = F.floor(F.col("_place") / span).cast("long")
    also = F.when((F.col("_place") % span < block - 1) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    placed = numbered.withColumn("_chunk", F.explode(also))
    keys = [*by, "_chunk"]
    totals = placed.groupBy(*keys).cogroup(packed.groupBy(*keys)).applyInArrow(_totals(by), f"{kinds}, sample long, _total double")
    return totals.groupBy(*by, "sample").agg(F.sum("_total").alias("_total")).join(sizes, by).select(*by, "sample", (F.col("_total") / F.col("_n")).alias("mean"))
