"""Token ids in binary files of patched frame-of-reference blocks.

A file, little-endian:
  magic b"BPFR0001", then five u64: documents D, ids N, blocks K, bytes of the document table, bytes of the blocks
  document table: D i64 doc_ids, D u8 (1: doc_id present), D u64 ends (ids of the file up to each document's end)
  index: K u64, where each block starts in the block area
  block area: each block holds BLOCK ids (the last maybe fewer): u32 least id, u8 width, u8 zero, u16 exceptions E,
    the differences to the least id in `width` bits each (BLOCK * width / 8 bytes, padded with zeros),
    E u16 places and E u32 differences for those that do not fit, whose packed bits are their low ones
The width is the bits of the difference at WIDE of the block's range, so that at most one id in ten is an exception.
A document never spans files; files of a folder follow each other by name in ascending doc_id order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm import scratch
from barline.llm.bpe import Pieces, Units, gathered, runs

MAGIC = b"BPFR0001"
#: Ids in a block: a multiple of 64, so that blocks are whole 64-bit words.
BLOCK = 256
#: Share of a block's differences that its width holds.
WIDE = 0.9
#: The pieces of byte-level vocabularies, which the library encodes each by itself, and how many of them and of text units are remembered.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 400_000
#: Characters of texts that are encoded together.
RUN = 1 << 21
#: A file is closed once it holds so many ids.
FILE_IDS = 1 << 22


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each value under 2**32 takes."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The block area of ids, and where each block starts in it."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return b"", np.zeros(0, np.uint64)
    grid = np.empty(count * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[-1]
    grid = grid.reshape(count, BLOCK)
    least = grid.min(1)
    grid = grid - least[:, None]
    width = _bits(np.partition(grid, int(WIDE * (BLOCK - 1)), axis=1)[:, int(WIDE * (BLOCK - 1))])
    outlier = grid >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0
    outlier[width >= 32] = False
    many = outlier.sum(1)
    size = 8 + BLOCK // 8 * width + 6 * many
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros(count, [("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("many", "<u2")])
    head["least"], head["width"], head["many"] = least, width, many
    out[start[:, None] + np.arange(8)] = head.view(np.uint8).reshape(count, 8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low = (grid[rows] & np.uint32((1 << w) - 1)).astype(np.uint64).T.copy()
        words = np.zeros((BLOCK * w // 64, len(rows)), np.uint64)
        for k in range(BLOCK):
            word, shift = divmod(k * w, 64)
            words[word] |= low[k] << np.uint64(shift)
            if shift + w > 64:
                words[word + 1] |= low[k] >> np.uint64(64 - shift)
        out[(start[rows] + 8)[:, None] + np.arange(BLOCK * w // 8)] = np.ascontiguousarray(words.T).view(np.uint8)
    for row in np.flatnonzero(many).tolist():
        places = np.flatnonzero(outlier[row])
        at = int(start[row]) + 8 + BLOCK // 8 * int(width[row])
        patch = places.astype("<u2").tobytes() + grid[row, places].astype("<u4").tobytes()
        out[at : at + len(patch)] = np.frombuffer(patch, np.uint8)
    return out.tobytes(), start.astype(np.uint64)


def unpack_blocks(area: bytes, start: np.ndarray, total: int) -> np.ndarray:
    """The ids of the blocks that begin at start."""
    count = len(start)
    if not count:
        return np.zeros(0, np.uint32)
    raw, start = np.frombuffer(area, np.uint8), start.astype(np.int64)
    head = raw[start[:, None] + np.arange(8)].copy().view([("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("many", "<u2")]).reshape(count)
    grid = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(head["width"]).tolist():
        if not w:
            continue
        rows = np.flatnonzero(head["width"] == w)
        words = raw[(start[rows] + 8)[:, None] + np.arange(BLOCK * w // 8)].copy().view(np.uint64).T.copy()
        low = np.empty((BLOCK, len(rows)), np.uint32)
        mask = np.uint64((1 << w) - 1)
        for k in range(BLOCK):
            word, shift = divmod(k * w, 64)
            value = words[word] >> np.uint64(shift)
            if shift + w > 64:
                value = value | words[word + 1] << np.uint64(64 - shift)
            low[k] = value & mask
        grid[rows] = low.T
    for row in np.flatnonzero(head["many"]).tolist():
        n = int(head["many"][row])
        at = int(start[row]) + 8 + BLOCK // 8 * int(head["width"][row])
        grid[row, np.frombuffer(area, "<u2", n, at)] = np.frombuffer(area, "<u4", n, at + 2 * n)
    return (grid + head["least"][:, None]).reshape(-1)[:total]


def write_file(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    area, start = pack_blocks(ids)
    table = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is not None for x in doc_ids) + np.cumsum([len(d) for d in documents]).astype("<u8").tobytes()
    return MAGIC + struct.pack("<5Q", len(documents), len(ids), len(start), len(table), len(area)) + table + start.astype("<u8").tobytes() + area


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The doc_ids, where each document ends, and all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, total, blocks, table, area = struct.unpack_from("<5Q", data, 8)
    at = 48
    names = np.frombuffer(data, "<i8", docs, at).tolist()
    there = data[at + 8 * docs : at + 9 * docs]
    ends = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    start = np.frombuffer(data, "<u8", blocks, at + table)
    body = at + table + 8 * blocks
    return [n if t else None for n, t in zip(names, there, strict=True)], ends, unpack_blocks(data[body : body + area], start, total)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


_made: dict[str, Units] = {}


def _units(path: str) -> Units:
    if path not in _made:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        whole = regex.compile(r" \p{L}+")

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # a space and letters is one piece wherever it stands, so many go as one text, and each is a word of the result
            letters = [p[0] == " " and p[1:].isalpha() and (p.isascii() or whole.fullmatch(p) is not None) for p in pieces]
            plain = [p for p, x in zip(pieces, letters, strict=True) if x]
            rest = [p for p, x in zip(pieces, letters, strict=True) if not x]
            parts, counts = [], []
            for k in range(0, len(plain), 1024):
                e = tokenizer.encode("".join(plain[k : k + 1024]), add_special_tokens=False)
                parts.append(np.array(e.ids, np.uint32))
                counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(plain[k : k + 1024])))
            for e in tokenizer.encode_batch_fast(rest, add_special_tokens=False):
                parts.append(np.array(e.ids, np.uint32))
                counts.append(np.array([len(parts[-1])]))
            if not parts:
                return np.zeros(0, np.uint32), np.zeros(0, np.int64)
            flat, count = np.concatenate(parts), np.concatenate(counts)
            place = np.empty(len(pieces), np.int64)  # where each piece stands in plain + rest
            told = np.array(letters, bool)
            place[told], place[~told] = np.arange(len(plain)), np.arange(len(plain), len(pieces))
            start = np.cumsum(count) - count
            return gathered(flat, start[place], count[place]), count[place]

        def as_it_is(text: str) -> np.ndarray:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

        _made[path] = Units(Pieces(regex.compile(PIECES), encode, REMEMBERED), as_it_is, special, REMEMBERED)
    return _made[path]


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes docs (doc_id, text) and writes them below folder; returns (path, part, number, n_docs, n_ids), a row a file.

    The texts are sorted by doc_id over the cluster, so that each task writes whole files one after the other and holds one
    at a time. A task that runs again writes files of other names; only those in the result count, and the result is
    written to the shared folder as the list of what is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(vocabulary)
        store, base = _store(folder)
        part, number = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.bpfr"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(write_file(names, held))
            return pa.record_batch({"path": [f"{folder}/{name}"], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": [len(names)], "n_ids": [size]})

        store.create_dir(base, recursive=True)
        for batch in batches:
            for at, texts in runs(batch.column(1), RUN):
                for name, packed in zip(batch.column(0).slice(at, len(texts)), units.pack(texts), strict=True):
                    names.append(name.as_py())
                    held.append(np.concatenate([packed, end]))
                    size += len(held[-1])
                    if size >= file_ids:
                        yield close()
                        number, size = number + 1, 0
                        names.clear()
                        held.clear()
        if names:
            yield close()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").repartitionByRange(parts, "doc_id", F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return scratch.cut(ordered.mapInArrow(run, "path string, part int, number int, n_docs long, n_ids long"), "token-files")


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids binary]) from the files that write() lists, a task a few files.

    start counts the ids of all documents before, over all files; its running sum takes one row a file.
    """
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _store(path)
                with store.open_input_stream(name) as f:
                    names, ends, ids = read_file(f.read())
                ids = ids.astype("<u4", copy=False)
                starts = [0, *ends[:-1].tolist()]
                packed = [ids[a:b].tobytes() for a, b in zip(starts, ends.tolist(), strict=True)]
                out = {"doc_id": pa.array(names, pa.int64()), "start": pa.array([base + a for a in starts], pa.int64()), "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()), "ids_crc32": pa.array([zlib.crc32(p) for p in packed], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(packed, pa.binary())
                yield pa.record_batch(out)

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return placed.select("path", "base").repartition(parts, "path").mapInArrow(run, schema)


def token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes docs (doc_id, text, any more columns) as token files and returns what reading them back gives, see read().

    Null and empty texts hold end_id alone. Documents are in ascending doc_id order, a null doc_id first; rows that repeat
    a doc_id follow each other in the order of their texts' hashes. No rows make no files and give no rows. The files
    stay in folder, by default a new one below the shared folder.
    """
    return read(write(docs, vocabulary, folder or scratch.fresh(docs.sparkSession, "tokens"), end_id))
