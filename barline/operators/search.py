"""Exhaustive searches by products of blocks of vectors.

Products of matrices find what may be among the best; what they find is scored again by the sums that SQL runs, one
component after the other, so that equal vectors have equal scores and ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components of a block of vectors (of 64: 4096 vectors), and queries scored at a time.
BLOCK, AT_ONCE = 1 << 18, 256
#: By how much a product of unit vectors may differ from the similarity as SQL sums it.
NEAR = 1e-9


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) to rows (dim, ids, e): vectors of equal length in blocks; a null vector has length -1."""
    held: dict[int, list] = {}

    def told(dim: int) -> pa.RecordBatch:
        ids, e = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        return pa.record_batch({"dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.astype(np.int64).tobytes()]), "e": pa.array([e.astype(np.float64).tobytes()])})

    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        for dim in np.unique(size).tolist():
            mine = np.flatnonzero(size == dim)
            step = max(1, BLOCK // max(dim, 1))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                e = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False) if dim > 0 else np.zeros(0)
                held.setdefault(dim, []).append((ids[some], e))
                if sum(len(i) for i, _ in held[dim]) >= step:
                    yield told(dim)
    for dim in list(held):
        yield told(dim)


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of a with that of b, in the order of components."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def nearest(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) for the k rows of other ids most like each query, as places in qids and ids."""
    found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    with np.errstate(all="ignore"):
        qq, ee = _summed(q, q), _summed(e, e)
        unit = np.ascontiguousarray((e / np.sqrt(ee)[:, None]).T)
        for at in range(0, len(q), AT_ONCE):
            score = (q[at : at + AT_ONCE] / np.sqrt(qq[at : at + AT_ONCE])[:, None]) @ unit
            score[~np.isfinite(score)] = np.inf
            score[qids[at : at + AT_ONCE, None] == ids[None]] = -np.inf
            most = np.partition(score, -k, 1)[:, -k] if score.shape[1] > k else np.full(len(score), -2.0)
            i, j = np.nonzero(score >= np.maximum(most - NEAR, -2.0)[:, None])
            i += at
            s = np.concatenate([np.clip(_summed(q[i[p : p + BLOCK // 8]], e[j[p : p + BLOCK // 8]]) / np.sqrt(qq[i[p : p + BLOCK // 8]] * ee[j[p : p + BLOCK // 8]]), -1, 1) for p in range(0, len(i), BLOCK // 8)] or [np.zeros(0)])
            order = np.lexsort((ids[j], -s, ~np.isnan(s), i))  # nan comes first
            i, j, s = i[order], j[order], s[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[best], j[best], s[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best(k: int):
    """Pairs of a block of queries and one of rows to (query_id, vec_id, s): the k best rows of each query in the block; s is
    null where a vector is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_dim, dim = (batch.column(c)[row].as_py() for c in ("q_dim", "dim"))
                qids, ids = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in ("q_ids", "ids"))
                if min(q_dim, dim) < 0:
                    order = np.argsort(ids, kind="stable")
                    there = [order[ids[order] != own][:k] for own in qids.tolist()]
                    i, j = np.repeat(np.arange(len(qids)), [len(t) for t in there]), np.concatenate(there)
                    s = pa.nulls(len(i), pa.float64())
                elif q_dim != dim:
                    raise ValueError(f"vectors have {q_dim} and {dim} components")
                else:
                    q, e = (np.frombuffer(batch.column(c)[row].as_py()).reshape(len(n), dim) for c, n in (("q_e", qids), ("e", ids)))
                    i, j, s = nearest(qids, q, ids, e, k)
                    s = pa.array(s)
                yield pa.record_batch([pa.array(qids[i]), pa.array(ids[j]), s], names=["query_id", "vec_id", "s"])

    return run


def cosine(rows: DataFrame, is_query, k: int) -> DataFrame:
    """(query_id, vec_id, similarity): for each row of rows (vec_id long, e array<double>) that is_query holds for, the k rows
    of other ids that are most like it; all, if fewer. Exhaustive: every block of queries meets every block of rows.

    Ties go to the smaller id. As in SQL, zero vectors and components that are not finite make a similarity of nan, which
    comes first, and null vectors one of null, which comes last. Queries that repeat an id choose together.
    """
    sound = rows.where("vec_id IS NOT NULL")
    schema = "dim int, ids binary, e binary"
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    blocks = sound.mapInArrow(_blocks, schema)
    queries = sound.where(is_query).coalesce(parts).mapInArrow(_blocks, schema).select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("e").alias("q_e"))
    dealt = blocks.repartition(4 * parts, F.crc32("ids"), "dim")  # of few files too
    best = dealt.crossJoin(queries).mapInArrow(_best(k), "query_id long, vec_id long, s double")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("s"), "vec_id")
    return best.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select("query_id", "vec_id", F.col("s").alias("similarity"))
