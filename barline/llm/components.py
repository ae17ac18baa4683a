"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.scratch import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) for every node of edges (a long, b long); component_id is its smallest reachable node.

    Randomised contraction: in each round every node follows its neighbour (or itself) of least hash, where the hash
    changes with the round, so that a constant share of the nodes goes whatever the order of the ids. The links and the
    node-to-root table are written after every round; only row counts reach the driver. Of a node of high degree each round
    takes minima, which are combined before the shuffle; where its links meet its one row they are the many side of a plain
    equi-join, whose skewed partitions adaptive execution splits.

    Self links only name nodes; null ends are ignored; repeated and reversed links count once; no links give no rows.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    turn = 0
    while live.limit(1).count():
        turn += 1
        rank = lambda c, k=turn: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("to"))
        both = live.union(live.select("b", "a"))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("from"), F.least(rank("a"), F.col("m"))["to"].alias("to"))
        step = cut(step, "step")
        roots = cut(
            roots.join(step, roots["root"] == step["from"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots"
        )
        moved = live.join(step.select(F.col("from").alias("a"), F.col("to").alias("ta")), "a").join(
            step.select(F.col("from").alias("b"), F.col("to").alias("tb")), "b"
        )
        live = cut(
            moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links"
        )
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    return roots.join(least, "root").select("node", "component_id")
