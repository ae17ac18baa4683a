"""Mixing sources to target weights by temperature, with DataFrame functions only.

Each source's share of the tokens is raised to an exponent between 0 (all alike) and 1 (as they are); the exponent is
bisected to meet a target. The weights times the budget give each source its tokens, dealt out as whole epochs and a last
part. Within a source, documents lie in blocks by a hash; each epoch is a permutation of the blocks, and the last one stops
where the budget ends. Only in the block where it ends are documents counted one by one, so a source that holds a third
of all rows is spread over its blocks, never over one task. A source has at most MOST_BLOCKS of them, whatever its size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.scratch import cut

#: Tokens in a block, about, if that makes no more blocks than the second.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 16, 1 << 18
#: Halvings of the exponent's interval, so many to a job; exponents are rounded to 6 places and weights to 9.
HALVINGS, AT_ONCE = 40, 5
#: Hexadecimal digits of a row's key that set its block.
DIGITS = 6

#: The default count: a token for each four characters begun; none for a null or empty text.
TOKENS = "coalesce((length(text) + 3) DIV 4, 0)"


def exponent(sizes: DataFrame, repetition: float | None, entropy: float | None, share: float | None) -> tuple[float, dict[str, float]]:
    """The exponent for weights(), and the sums over the sources that it rests on. Each job sums over all sources for the
    ends of 2**AT_ONCE parts of the interval that is left, as so many halvings would; only these sums reach the driver."""
    n = F.col("tokens").cast("double")
    one = sizes.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"), F.count("*").alias("count")).first()
    total = one["total"]

    def steeper(a: float, power: float, slope: float) -> bool:
        if repetition is not None:
            times = (one["least"] / one["most"]) ** (a - 1) if share is None else share * (one["least"] / total) ** (a - 1) / power
            return times > repetition
        return math.log(power) - a * slope / power >= entropy * math.log(one["count"])

    def sums(tried: list[float]) -> dict[float, tuple[float, float]]:
        p = F.pow(n / total, F.col("a"))
        each = sizes.select("tokens", F.explode(F.array(*map(F.lit, tried))).alias("a")).groupBy("a")
        return {r["a"]: (r["power"], r["slope"]) for r in each.agg(F.sum(p).alias("power"), F.sum(p * F.log(n / total)).alias("slope")).collect()}

    low, high = 0.0, 1.0
    for _ in range(HALVINGS // AT_ONCE):
        parts = 1 << AT_ONCE
        ends = [low + (high - low) * k / parts for k in range(parts + 1)]
        told = sums(ends[1:-1])
        at, upto = 0, parts
        while upto - at > 1:
            mid = (at + upto) // 2
            if steeper(ends[mid], *told[ends[mid]]):
                at = mid
            else:
                upto = mid
        low, high = ends[at], ends[upto]
    a = round(high if repetition is not None else low, 6)
    return a, {"total": total, "top": one["most"] / total, "scale": sums([a])[a][0]}


def weights(sizes: DataFrame, repetition: float | None, entropy: float | None, share: float | None) -> DataFrame:
    """(source, tokens, weight, budget) from sizes (source, tokens > 0).

    repetition: the flattest exponent at which no source is read more than so many times over. entropy: the steepest
    exponent at which the weights' entropy is at least that share of its maximum. share: the budget, as a multiple of all
    tokens; None for the least at which each source is read in whole at least once (repetition then bounds the rarest against that).
    """
    assert (repetition is None) != (entropy is None)
    if not sizes.limit(1).count():
        return sizes.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    a, one = exponent(sizes, repetition, entropy, share)
    weight = F.round(F.pow(F.col("tokens") / F.lit(one["total"]), F.lit(a)) / F.lit(one["scale"]), 9)
    # each source whole at least once: the largest needs weight * budget = its tokens
    whole = share * one["total"] if share is not None else one["top"] * one["total"] / (one["top"] ** a / one["scale"])
    deal = F.floor(weight * F.lit(whole)).cast("long")
    if share is None:
        deal = F.greatest(deal, F.col("tokens"))
    return sizes.select("source", "tokens", weight.alias("weight"), deal.alias("budget"))


def mix(docs: DataFrame, repetition: float | None = 4.0, entropy: float | None = None, share: float | None = None, seed: int = 17, tokens: str = TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs (doc_id, text, source, any more columns) as often as their source's weight asks, with `epoch` (0 for the first),
    `block` and `place`: the row's block of its source, and that block's place in the permutation of this epoch.

    tokens: SQL for a row's tokens. A row comes once in each whole epoch of its source; of the last epoch come the blocks
    that the budget holds, in the order of its permutation, and of the block where it ends the rows that still fit, by a
    hash. A null source is one source of its own. Sources without tokens (null or empty texts only) come once, unweighted,
    with block and place null. Rows that repeat are rows like others, ties in the hash order go by doc_id. Very long texts
    count like others. No rows give no rows. Should docs have columns epoch, block or place, they go; any other names may
    occur. See weights() for repetition, entropy and share.
    """
    names = [c for c in docs.columns if c.lower() not in ("epoch", "block", "place")]
    digest = lambda *parts: F.md5(F.concat_ws(":", *parts))
    key = digest(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    # the row travels as one column, so that no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("of"), F.col("doc_id").alias("id"), F.expr(tokens).cast("long").alias("n"), key.alias("key"))
    sums = cut(rows.groupBy("of", F.substring("key", 1, DIGITS).alias("part")).agg(F.sum("n").alias("n")), "parts")
    sizes = cut(sums.groupBy(F.col("of").alias("source")).agg(F.sum("n").alias("tokens")).where("tokens > 0"), "sizes")
    told = cut(weights(sizes, repetition, entropy, share), "weights")
    count = F.least(F.ceil(F.col("tokens") / block_tokens), F.lit(MOST_BLOCKS)).cast("long")
    plan = told.select(F.col("source").alias("s"), count.alias("blocks"), (F.col("budget") / F.col("tokens")).cast("long").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"))
    number = lambda part: (F.conv(part, 16, 10).cast("long") % F.col("blocks")).alias("b")
    blocks = sums.join(plan, sums["of"].eqNullSafe(F.col("s"))).groupBy("s", "whole", "rest", number(F.col("part"))).agg(F.sum("n").alias("n"))
    # the blocks of a source in the order of each epoch: at most MOST_BLOCKS rows
    order = Window.partitionBy("s", "e").orderBy(digest(F.lit(str(seed)), F.col("e").cast("string"), F.col("b").cast("string")), "b")
    placed = blocks.withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), "whole"))).withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    placed = placed.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # room: -1 the whole block is in the last epoch, 0 none of it, else the tokens that still fit
    room = F.when(F.col("e") < F.col("whole"), None).when(F.col("before") + F.col("n") <= F.col("rest"), -1).otherwise(F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    turns = F.array_sort(F.collect_list(F.struct("e", "place")))
    held = cut(placed.groupBy("s", "b", "whole").agg(F.max(room.cast("long")).alias("room"), turns.alias("turns")), "blocks")
    keyed = rows.join(plan.select(F.col("s").alias("s0"), "blocks"), F.col("of").eqNullSafe(F.col("s0")), "left").select("row", "of", "id", "n", "key", number(F.substring("key", 1, DIGITS)).alias("at"))
    joined = keyed.join(held, F.col("of").eqNullSafe(F.col("s")) & (F.col("at") == F.col("b")), "left")
    once = F.array(F.struct(F.lit(0).cast("long").alias("e"), F.lit(None).cast("long").alias("place")))
    plain = joined.where("room IS NULL OR room <= 0").select("row", "at", F.when(F.col("room") < 0, F.col("turns")).when(F.col("room") == 0, F.slice("turns", 1, F.col("whole").cast("int"))).otherwise(once).alias("turns"))
    inside = Window.partitionBy("of", "at").orderBy(digest(F.col("key"), F.col("whole").cast("string")), "id", "n").rowsBetween(Window.unboundedPreceding, 0)
    ending = joined.where("room > 0").withColumn("upto", F.sum("n").over(inside))
    ending = ending.select("row", "at", F.slice("turns", 1, (F.col("whole") + F.when(F.col("upto") <= F.col("room"), 1).otherwise(0)).cast("int")).alias("turns"))
    both = plain.unionByName(ending).select("row", "at", F.explode("turns").alias("turn"))
    return both.select("row.*", F.col("turn.e").alias("epoch"), F.when(F.col("turn.place").isNotNull(), F.col("at")).alias("block"), F.col("turn.place").alias("place"))
