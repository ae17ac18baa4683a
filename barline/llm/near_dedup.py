"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets are one class, which its smallest id stands for. Classes are banded; in each bucket
the signatures are compared a batch at a time, and a pair goes as soon as the posterior probability that its similarity
reaches the threshold falls under `miss`. Survivors are verified on the full shingle sets.

Survivors are verified where their bucket is, on the full shingle sets, which come along for classes that share a bucket
with another. Only links that join something new leave the task, fewer than it has members. Buckets with the same members
are looked at once. A bucket of more than BLOCK classes, or of more shingles than a block's, is dealt out: first each block by itself and with the first block;
then, where its members are not yet one component, all pairs of blocks, but only classes of different components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import kernels
from barline.llm.components import components
from barline.llm.scratch import among, cut, tidy

#: Bands and rows: a pair of similarity 0.85 shares no bucket with probability (1 - 0.85**6)**26 < 5e-6; below it, one of
#: similarity 0.8 with (1 - 0.8**5)**31 < 5e-6.
BANDS, ROWS = 26, 6
LOW_BANDS, LOW_ROWS = 31, 5
HASHES = BANDS * ROWS
#: Hashes compared at a time.
BATCH = 26
#: Classes in a block, and shingles of all of them, about: a task holds the sets of two blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
#: Posterior probability under which a pair is pruned.
MISS = 1e-7

_MUL = (kernels.splitmix(np.arange(HASHES) + 31) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (kernels.splitmix(np.arange(HASHES) + 9031) >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of HASHES permutations for each set that is not empty, one row a set."""
    off = np.cumsum([0, *map(len, sets)])
    base = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(base * _MUL[k] + _ADD[k], off[:-1])
    return out


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number n of compared hashes, the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    Uniform prior: the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = [0]
    for n in range(1, HASHES + 1):
        tail, m = 0.0, -1
        while tail < miss and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _bands(sig: np.ndarray, percent: int) -> np.ndarray:
    """A hash of each band of each signature."""
    bands, each = (BANDS, ROWS) if percent >= 85 else (LOW_BANDS, LOW_ROWS)
    rows = sig[:, : bands * each].reshape(len(sig), bands, each).astype(np.uint64)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(each):
        out = kernels.splitmix(out ^ rows[:, :, k])
    return out.view(np.int64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray], list[int], np.ndarray]]:
    """For parts of the rows (id, text): ids, shingle sets, places of those not empty, and their signatures."""
    for batch in batches:
        buf, off = kernels.byte_view(batch.column(1))
        for a, b in kernels.slices(off):
            sets = kernels.shingles(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            full = [i for i, s in enumerate(sets) if len(s)]
            yield batch.column(0).slice(a, b - a), sets, full, signatures([sets[i] for i in full]) if full else np.zeros((0, HASHES), np.uint32)


def _describe(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, full, sig in _each(batches):
            bands: list[np.ndarray | None] = [None] * len(sets)
            for i, row in zip(full, _bands(sig, percent), strict=True):
                bands[i] = row
            yield pa.record_batch(
                {
                    "doc_id": ids,
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                }
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets, full, sig in _each(batches):
        yield pa.record_batch({"rep": ids.take(pa.array(full, pa.int64())), "shingles": pa.array([sets[i].tobytes() for i in full], pa.binary()), "sig": pa.array([r.tobytes() for r in sig], pa.binary())})


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first `keys` columns, across the batches of a sorted partition."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(k)[i].as_py() for k in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(keys):
            col = batch.column(k).to_numpy(zero_copy_only=False)
            change |= col[1:] != col[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and key(held[0], 0) != key(batch, a):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def surviving(sig: np.ndarray, left: np.ndarray, right: np.ndarray, floor: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (left[i], right[i]) of rows of sig those that no batch of hashes rules out, and their matches."""
    hits = np.zeros(len(left), np.int64)
    for k in range(0, HASHES, BATCH):
        hits += (sig[left, k : k + BATCH] == sig[right, k : k + BATCH]).sum(1)
        stay = hits >= floor[k + BATCH]
        left, right, hits = left[stay], right[stay], hits[stay]
    return left, right, hits


class Joined:
    """Sets of numbers that grow together."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.top(x)] = self.top(y)


def verified(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, hits: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs (left, right) of sets, likeliest first, those that link and whose ends no earlier one has joined."""
    size = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.cumsum([0, *size.tolist()])
    mark = np.zeros(int(local.max()) + 1, np.int64)
    order = np.lexsort((-hits, left))
    joined, out = Joined(), []
    left, right = left[order], right[order]
    begin = np.flatnonzero(np.append(True, left[1:] != left[:-1]))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(left)], strict=True):
        i = int(left[a])
        others = [int(j) for j in right[a:b] if joined.top(int(label[j])) != joined.top(int(label[i]))]
        if not others:
            continue
        mark[local[off[i] : off[i + 1]]] = 1
        for j in others:
            if joined.top(int(label[j])) == joined.top(int(label[i])):
                continue
            both = int(mark[local[off[j] : off[j + 1]]].sum())
            if 100 * both >= percent * (size[i] + size[j] - both):
                joined.join(int(label[j]), int(label[i]))
                out.append((i, j))
        mark[local[off[i] : off[i + 1]]] = 0
    return out


def _links(floor: list[int], percent: int):
    """Rows (bucket, part, rep, label, side, sig, shingles), sorted by bucket and part, to links of different labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for table in groups(batches, 2):
            rep, label, side = (table.column(c).to_numpy() for c in ("rep", "label", "side"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
            kept = []
            for i in range(len(rep)):
                # side 0: both blocks are one and the same; 1 and 2: only pairs across the two blocks
                other = np.arange(i + 1, len(rep)) if side[i] == 0 else np.flatnonzero(side > 1) if side[i] == 1 else np.zeros(0, int)
                other = other[label[other] != label[i]]
                if len(other):
                    kept.append(surviving(sig, np.full(len(other), i), other, floor))
            left, right, hits = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, int),) * 3
            if len(left):
                sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
                for i, j in verified(sets, label, left, right, hits, percent):
                    a.append(int(rep[i]))
                    b.append(int(rep[j]))
        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _compare(members: DataFrame, sets: DataFrame, floor: list[int], percent: int, every: bool) -> DataFrame:
    """Links (a, b) among members (bucket, blocks, rep, label). Of buckets of several blocks either the blocks by themselves
    and with the first block, or (every) all pairs of blocks."""
    blocks = members.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    all_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    partners = all_ if every else F.when(F.col("mine") == 0, all_).otherwise(F.array(F.lit(0), F.col("mine")))
    dealt = blocks.withColumn("other", F.explode(partners)).select(
        "bucket",
        (F.least("mine", "other").cast("long") * F.col("blocks") + F.greatest("mine", "other")).alias("part"),
        "rep",
        "label",
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
    )
    dealt = dealt.join(sets, "rep").select("bucket", "part", "rep", "label", "side", "sig", "shingles")
    dealt = dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return dealt.mapInArrow(tidy(_links(floor, percent)), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (rep, text) of docs whose doc_id is in ids (rep); most others go before texts are shuffled."""
    near = among(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", ids)
    return near.join(ids, "rep", "left_semi")


def near_duplicates(docs: DataFrame, percent: int = 85, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id long, text string, any more columns).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a document's set has its distinct five-word shingles, or its
    whole word sequence if that is shorter. Rows link if 100 * intersection >= percent * union (percent from 80 up: the
    bands are laid out for these). component_id is the smallest doc_id that is reachable by links, itself included.

    Null, empty and blank texts have n_shingles 0, link with nothing and are kept. A row without doc_id links with
    nothing, has component_id null and is kept. Rows that repeat a doc_id with the same text give equal result rows; if
    the texts differ, links are verified on one of them, so ids must name one text. No rows give no rows.
    """
    assert 80 <= percent <= 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = cut(docs.mapInArrow(tidy(_describe(percent)), "doc_id long, n_shingles long, set_key binary, bands array<long>"), "described")
    some = told.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands")).alias("m"), F.max("n_shingles").alias("size")).select("set_key", F.col("m.doc_id").alias("rep"), "size", F.col("m.bands").alias("bands"))
    classes = cut(classes, "classes")
    banded = classes.select("rep", "size", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.expr("bit_xor(xxhash64(rep, 1))").alias("x"), F.expr("bit_xor(xxhash64(rep, 2))").alias("y")
    )
    dealt = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
    buckets = buckets.where("n > 1").groupBy("n", "size", "least", "most", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", dealt.alias("blocks"))
    members = cut(banded.drop("size").join(cut(buckets, "buckets"), "bucket"), "members")
    ends = cut(members.select("rep").distinct(), "ends")
    sets = cut(_texts_of(docs, ends).mapInArrow(tidy(_sets), "rep long, shingles binary, sig binary").dropDuplicates(["rep"]), "sets")
    floor = least_matches(percent / 100, miss)
    links = cut(_compare(members.withColumn("label", F.col("rep")), sets, floor, percent, False), "links")
    roots = cut(components(links), "roots")
    large = members.where("blocks > 1")
    if large.limit(1).count():
        labelled = large.join(roots, large["rep"] == roots["node"], "left").select("bucket", "blocks", "rep", F.coalesce("component_id", "rep").alias("label"))
        open_ = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
        more = cut(_compare(labelled.join(open_, "bucket", "left_semi"), sets, floor, percent, True), "links")
        roots = cut(components(links.union(more)), "roots")
    # the hot class's rows meet its one row here: a plain join, which AQE splits where a key is skewed
    ends = cut(classes.select("set_key", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id")), "ends")
    return told.join(ends, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.coalesce("component_id", "doc_id"))).alias("kept"),
    )
