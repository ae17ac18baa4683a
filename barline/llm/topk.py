"""Exact top-k by exhaustive term-at-a-time accumulation.

Vectors are rows of integer weights by term. A block of candidates is turned into postings, a list of (row, weight) for
each term; for each term the query rows that have it scatter their weighted postings into a dense array of scores. The
best of each block are selected by partition, and merged. Every query block meets every candidate block once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm import kernels
from barline.llm.scratch import cut

#: Postings of a block of queries and of one of candidates (of 64 terms: 16384 and 4096 rows), and the queries scored at a
#: time. Each candidate block is copied once for each query block, so these are as large as memory allows.
QUERY_BLOCK, CANDIDATE_BLOCK, SCORED = 1 << 20, 1 << 18, 512


def _blocks(size: int, scale: float):
    """Blocks of rows of at most `size` components together: the ids, and (row, term, weight) of all weights that are not 0,
    ordered by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy()) + 1
            for at, to in kernels.slices(np.append(0, np.cumsum(lengths)), size):
                part = batch.slice(at, to - at)
                lists = part.column(1)
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                count = np.diff(lists.offsets.to_numpy())
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(ids, kind="stable")
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                row = np.repeat(place, count)
                term = np.arange(len(values)) - np.repeat(np.cumsum(count) - count, count)
                weight = np.floor(scale * values).astype(np.int64)
                keep = np.flatnonzero(weight)
                keep = keep[np.lexsort((row[keep], term[keep]))]
                yield pa.record_batch(
                    {
                        "ids": pa.array([ids[order].tobytes()]),
                        "rows": pa.array([row[keep].astype(np.int32).tobytes()]),
                        "terms": pa.array([term[keep].astype(np.int32).tobytes()]),
                        "weights": pa.array([weight[keep].tobytes()]),
                    }
                )

    return run


def accumulate(queries: tuple, candidates: tuple) -> np.ndarray:
    """Scores (query, candidate) of two blocks (ids, rows, terms, weights)."""
    score = np.zeros((len(queries[0]), len(candidates[0])), np.int64)
    _, row, term, weight = candidates
    terms = np.unique(term)
    begin, end = np.searchsorted(term, terms, "left"), np.searchsorted(term, terms, "right")
    a, b = np.searchsorted(queries[2], terms, "left"), np.searchsorted(queries[2], terms, "right")
    for k in range(len(terms)):
        posting = slice(begin[k], end[k])
        whole = end[k] - begin[k] == score.shape[1]
        for q, w in zip(queries[1][a[k] : b[k]].tolist(), queries[3][a[k] : b[k]].tolist(), strict=True):
            if whole:
                score[q] += w * weight[posting]
            else:
                score[q, row[posting]] += w * weight[posting]
    return score


def select(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id (ids ascend), without rows whose id is own."""
    there = np.flatnonzero(ids != own)
    if len(there) <= k:
        return there
    s = score[there]
    least = np.partition(s, len(s) - k)[len(s) - k]
    above = np.flatnonzero(s > least)
    return there[np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])]


def _unpack(batch: pa.RecordBatch, i: int, prefix: str) -> tuple:
    kinds = {"ids": np.int64, "rows": np.int32, "terms": np.int32, "weights": np.int64}
    return tuple(np.frombuffer(batch.column(prefix + c)[i].as_py(), t) for c, t in kinds.items())


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries, candidates = _unpack(batch, i, "q_"), _unpack(batch, i, "c_")
                who, what, value = [], [], []
                for at in range(0, len(queries[0]), SCORED):
                    mine = np.flatnonzero((queries[1] >= at) & (queries[1] < at + SCORED))
                    score = accumulate((queries[0][at : at + SCORED], queries[1][mine] - at, queries[2][mine], queries[3][mine]), candidates)
                    for q, own in enumerate(queries[0][at : at + SCORED].tolist()):
                        best = select(score[q], candidates[0], own, k)
                        who.append(np.full(len(best), own))
                        what.append(candidates[0][best])
                        value.append(score[q, best])
                yield pa.record_batch({"query_id": pa.array(np.concatenate(who)), "vec_id": pa.array(np.concatenate(what)), "score": pa.array(np.concatenate(value))})

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id long, embedding array, more columns) that is_query
    holds for, the k other rows of greatest inner product of floor(scale * component), or all if there are fewer.

    Ties go to the smaller vec_id. Rows with a null id or vector, or with a null or non-finite component, take no part;
    where lengths differ, missing components count as 0, so an empty vector scores 0. Rows that repeat a vec_id: the one
    of least vector stands for all. No queries give no rows. Scores must fit 64 bits.
    """
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    sound = sound.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    sound = cut(sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    schema = "ids binary, rows binary, terms binary, weights binary"
    queries = sound.where(is_query).coalesce(max(1, int(sound.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)).mapInArrow(_blocks(QUERY_BLOCK, scale), schema)
    queries = cut(queries.withColumn("tag", F.monotonically_increasing_id()), "queries")
    numbered = queries.select("tag", (F.row_number().over(Window.orderBy("tag")) - 1).cast("long").alias("number"))
    queries = queries.join(numbered, "tag").select("number", *[F.col(c).alias("q_" + c) for c in ("ids", "rows", "terms", "weights")])
    count = numbered.count()
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = sound.mapInArrow(_blocks(CANDIDATE_BLOCK, scale), schema).select(*[F.col(c).alias("c_" + c) for c in ("ids", "rows", "terms", "weights")])
    dealt = blocks.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).withColumn("deal", F.crc32("c_ids"))
    best = dealt.join(queries, "number").repartition("number", "deal").drop("number", "deal").mapInArrow(_score(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
