"""Substring dedup by content-defined chunks.

A gear hash rolls over the last 16 bytes. A chunk ends after a white-space byte where the hash is small (one word in
six), after a character of three or more bytes, as scripts without spaces have, where it is as small for its bytes (one in
twelve), or before any character where it is very small. Whether a place is a cut depends on the bytes around it alone, so
an insertion changes only the chunks that it touches. Equal chunks, by 128-bit digest, are found over all documents; the
first by (doc_id, place) stays, and maximal runs of others that are long enough go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from barline.llm import kernels
from barline.llm.scratch import tidy

#: Of 65536: how small the hash must be for a cut after white space (one in 6), after a character of three or more bytes
#: (one in 12: some 36 bytes, as with words), and elsewhere (one in 256).
AFTER_SPACE, AFTER_WIDE, ANYWHERE = 10923, 5461, 256
#: A chunk without a cut ends after so many bytes.
LONGEST = 4096
#: Runs of repeated chunks go from so many bytes on (about twenty words): of repeats of over 50 words 99.7 % hold such a run,
#: while lines that documents share by chance or custom stay.
LEAST_RUN = 120

_GEAR = (kernels.splitmix(np.arange(256) + 555) >> np.uint64(48)).astype(np.uint16)


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of all chunks in buf, where rows start at off (one more entry than rows); no chunk spans rows."""
    if not len(buf):
        return np.zeros(0, np.int64)
    rolled = _GEAR[buf]
    for step in (1, 2, 4, 8):  # now the hash of the last 16 bytes: sum of gear << distance
        more = rolled.copy()
        more[step:] += rolled[:-step] << np.uint16(step)
        rolled = more
    lead = np.ones(len(buf), bool)
    lead[:-1] = (buf[1:] & 0xC0) != 0x80
    small = rolled < AFTER_SPACE
    heavy = np.zeros(len(buf), bool)  # where a character of three or more bytes ends: lead says that it is the last byte
    heavy[2:] = buf[:-2] >= 0xE0
    heavy[3:] |= buf[:-3] >= 0xF0
    place = np.flatnonzero(lead & small & (kernels.SPACE[buf] | (heavy & (rolled < AFTER_WIDE)) | (rolled < ANYWHERE))) + 1
    # a row's first 15 hashes also hold bytes of the row before: no cuts there
    row = np.searchsorted(off, place - 1, "right") - 1
    place = place[place - 1 - off[row] >= 15]
    place = np.union1d(place[place < len(buf)], off[:-1][np.diff(off) > 0])
    wide = np.flatnonzero(np.diff(place, append=len(buf)) > LONGEST)
    if len(wide):
        ends = np.append(place, len(buf))
        forced = [np.arange(place[i] + LONGEST, ends[i + 1], LONGEST) for i in wide.tolist()]
        forced = np.concatenate(forced)
        while len(bad := np.flatnonzero((buf[forced] & 0xC0) == 0x80)):  # to the next character
            forced[bad] += 1
            forced = forced[forced < len(buf)]
        place = np.union1d(place, forced)
    return place


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    """batch (doc_id, text), ordered by doc_id, without the rows that repeat a doc_id with the same text."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    again = ids[1:] == ids[:-1]
    if not again.any():
        return batch
    keep, texts = np.ones(len(ids), bool), set()
    for i in np.flatnonzero(np.append(again, False) | np.append(False, again)).tolist():
        pair = (int(ids[i]), batch.column(1)[i].as_py())
        keep[i] = pair not in texts
        texts.add(pair)
    return batch.filter(pa.array(keep))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, start, size, one, two, sure). sure: the chunk repeats an earlier one of the same batch."""
    for batch in batches:
        # null ids come last; the first of equal chunks in this order is the one that may stay
        order = np.argsort(batch.column(0).fill_null(2**63 - 1).to_numpy(zero_copy_only=False), kind="stable")
        batch = _distinct(batch.take(pa.array(order)))
        ids = batch.column(0)
        buf, off = kernels.byte_view(batch.column(1))
        seen: set[bytes] = set()
        for a, b in kernels.slices(off):
            part, edge = buf[off[a] : off[b]], off[a : b + 1] - off[a]
            place = cuts(part, edge)
            if not len(place):
                continue
            data = part.tobytes()
            ends = np.append(place[1:], len(data))
            digests = [xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(place.tolist(), ends.tolist(), strict=True)]
            sure = np.zeros(len(place), bool)
            for i, d in enumerate(digests):
                if d in seen:
                    sure[i] = True
                else:
                    seen.add(d)
            row = np.searchsorted(edge, place, "right") - 1
            # neighbouring sure chunks of a row become one
            first = np.ones(len(place), bool)
            first[1:] = ~(sure[1:] & sure[:-1] & (row[1:] == row[:-1]))
            head = np.flatnonzero(first)
            last = np.append(head[1:], len(place)) - 1
            pair = np.frombuffer(b"".join([digests[i] for i in head.tolist()]), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                {
                    "doc_id": ids.take(pa.array(row[head] + a)),
                    "start": pa.array((place[head] - edge[row[head]]).astype(np.int32)),
                    "size": pa.array((ends[last] - place[head]).astype(np.int32)),
                    "one": pa.array(pair[:, 0].copy()),
                    "two": pa.array(pair[:, 1].copy()),
                    "sure": pa.array(sure[head]),
                }
            )


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, start, size, kept_doc_id) of every chunk, or run of chunks, of docs that repeats an earlier one.

    Repeats within a batch of input rows are told there and never meet the others of their digest, so that a chunk that
    a third of all documents share brings one row a batch to its task. kept_doc_id is null where it is not looked up.
    """
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(
        tidy(_chunks), "doc_id long, start int, size int, one long, two long, sure boolean"
    )
    # a sure row is alone under a key of its own
    keyed = rows.withColumn("own", F.when(F.col("sure"), F.xxhash64("doc_id", "start")).otherwise(F.lit(0)))
    w = Window.partitionBy("one", "two", "own").orderBy("doc_id", "start")
    # rank, not row_number: rows that repeat a doc_id share a place, and a chunk is no repeat of its own
    told = keyed.withColumn("rank", F.rank().over(w)).withColumn("kept_doc_id", F.first("doc_id").over(w))
    return told.where("sure OR rank > 1").select("doc_id", "start", "size", F.expr("if(sure, NULL, kept_doc_id)").alias("kept_doc_id"))


def _without(least_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text"), batch.column("spans")
            out, gone = [], []
            for i in range(batch.num_rows):
                text, marks = texts[i], spans[i].as_py()
                if text.as_py() is None or not marks:
                    out.append(text.as_py())
                    gone.append([])
                    continue
                data = text.as_py().encode()
                runs: list[list[int]] = []
                for m in sorted({(m["start"], m["size"]) for m in marks}):
                    if runs and runs[-1][1] >= m[0]:
                        runs[-1][1] = max(runs[-1][1], m[0] + m[1])
                    else:
                        runs.append([m[0], m[0] + m[1]])
                runs = [r for r in runs if r[1] - r[0] >= least_run]
                kept, at = [], 0
                for x, y in runs:
                    kept.append(data[at:x])
                    at = y
                out.append(b"".join([*kept, data[at:]]).decode())
                gone.append([{"start": x, "stop": y} for x, y in runs])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.record_batch([*[batch.column(c) for c in batch.schema.names if c not in ("text", "spans")], pa.array(out, pa.string()), pa.array(gone, kind)], names=[*[c for c in batch.schema.names if c not in ("text", "spans")], "text", "removed"])

    return run


def substring_dedup(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """docs (doc_id, text, any more columns) with repeated passages cut from text, and `removed`: the byte spans of the old text.

    Of equal chunks the first by (doc_id, place) stays. Runs of other chunks shorter than least_run bytes stay as well. A
    removed run takes the white space after it along. A null or empty text, or a row with a null doc_id, stays as it is and
    has no spans. Rows that repeat a doc_id count as one document: if they hold the same text, each keeps what the first
    keeps; ids must name one text. No rows give no rows. Should docs have columns spans or removed, they go.
    """
    names = [c for c in docs.columns if c not in ("spans", "removed")]
    docs = docs.select(*names)
    spans = repeated_chunks(docs).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col("_doc"), "left").drop("_doc")
    rest = [c for c in names if c != "text"]
    span = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])
    schema = StructType([*[docs.schema[c] for c in rest], StructField("text", StringType()), StructField("removed", ArrayType(span))])
    cut = joined.select(*rest, "text", "spans").mapInArrow(tidy(_without(least_run)), schema)
    return cut.select(*names, "removed")
