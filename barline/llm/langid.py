"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample. It gives every letter position a distribution over
the languages; a document's probabilities are the mean over its letter positions. Texts are cut into windows of WINDOW
bytes that run side by side, so every byte of every text passes through the network in both directions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from barline.llm import kernels
from barline.llm.scratch import tidy

WINDOW, HIDDEN = 64, 8
#: Training takes at most so many documents of each language, and so many characters of each document.
TRAIN_DOCS, TRAIN_CHARS = 400, 800
STEPS, BATCH, RATE = 500, 128, 0.01

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LETTER[0x80:] = True


def start(langs: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters by name; f and b are the two directions. Columns of x and u: update, reset, candidate."""
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["x" + d] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
        p["u" + d] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        p["w" + d] = rng.normal(0, 0.3, (HIDDEN, langs))
    p["c"] = np.zeros(langs)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def loss_and_gradient(p: dict[str, np.ndarray], seq: np.ndarray, lang: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the letter positions of seq (rows, steps) whose row has the language lang, and its gradient."""
    rows, steps = seq.shape
    n = HIDDEN
    tape: dict[str, list] = {"f": [], "b": []}
    logits = np.tile(p["c"], (steps, rows, 1))
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((rows, n), np.float32)
        for t in order:
            x, y = p["x" + d][seq[:, t]], h @ p["u" + d]
            z, r = _sigmoid(x[:, :n] + y[:, :n]), _sigmoid(x[:, n : 2 * n] + y[:, n : 2 * n])
            c = np.tanh(x[:, 2 * n :] + r * y[:, 2 * n :])
            new = (1 - z) * c + z * h
            tape[d].append((t, h, z, r, c, y[:, 2 * n :], new))
            h = new
            logits[t] += h @ p["w" + d]
    mask = _LETTER[seq].T
    count = max(1, int(mask.sum()))
    prob = np.exp(logits - logits.max(2, keepdims=True))
    prob /= prob.sum(2, keepdims=True)
    loss = -float(np.log(np.maximum(prob[:, np.arange(rows), lang], 1e-12))[mask].sum()) / count
    prob[:, np.arange(rows), lang] -= 1
    error = prob * mask[:, :, None] / count
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["c"] = error.sum((0, 1))
    for d in "fb":
        back = np.zeros((rows, n), np.float32)
        for t, h, z, r, c, y, new in reversed(tape[d]):
            grad["w" + d] += new.T @ error[t]
            dh = back + error[t] @ p["w" + d].T
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * y * r * (1 - r)
            gate = np.concatenate([dz, dr, dc], 1)
            np.add.at(grad["x" + d], seq[:, t], gate)
            inner = np.concatenate([dz, dr, dc * r], 1)
            grad["u" + d] += h.T @ inner
            back = dh * z + inner @ p["u" + d].T
    return loss, grad


def windows(text: bytes) -> np.ndarray:
    """The bytes of a text as rows of WINDOW, folded, the last padded with spaces."""
    data = np.full(-(-len(text) // WINDOW) * WINDOW, 32, np.uint8)
    data[: len(text)] = np.frombuffer(text, np.uint8)
    return _FOLD[data].reshape(-1, WINDOW)


def train(texts: list[str], langs: list[int], kinds: int, steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over random windows, each language equally often."""
    p = start(kinds, seed)
    rows = [windows(t.encode()) for t in texts]
    seq = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.uint8)
    lang = np.repeat(np.array(langs, np.int64), [len(r) for r in rows])
    of = [np.flatnonzero(lang == k) for k in range(kinds)]
    if kinds < 2 or any(len(x) == 0 for x in of):
        return p
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of[k]) for k in rng.integers(0, kinds, BATCH)])
        _, grad = loss_and_gradient(p, seq[pick], lang[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2.0 - 2.0 * step / (steps + 1))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = (p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def positions(p: dict[str, np.ndarray], seq: np.ndarray) -> np.ndarray:
    """Probabilities (steps, languages, rows) at every position of folded windows.

    Rows run along the last axis, so that every operation is on whole lines; the gates' halving is in the weights.
    """
    rows, steps = seq.shape
    n = HIDDEN
    scale = np.array([0.5] * (2 * n) + [1.0] * n, np.float32)
    logits = np.empty((steps, len(p["c"]), rows), np.float32)
    logits[:] = p["c"][:, None]
    turned = np.ascontiguousarray(seq.T).astype(np.intp)
    x, y = np.empty((3 * n, rows), np.float32), np.empty((3 * n, rows), np.float32)
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        wx, wu, w = (np.ascontiguousarray(m.T) for m in (p["x" + d] * scale, p["u" + d] * scale, p["w" + d]))
        h = np.zeros((n, rows), np.float32)
        for t in order:
            np.take(wx, turned[t], axis=1, out=x, mode="clip")
            np.matmul(wu, h, out=y)
            gate, c, back = x[: 2 * n], x[2 * n :], y[2 * n :]
            gate += y[: 2 * n]
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            back *= gate[n:]
            c += back
            np.tanh(c, out=c)
            h -= c
            h *= gate[:n]
            h += c
            logits[t] += w @ h
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def document_probabilities(p: dict[str, np.ndarray], buf: np.ndarray, off: np.ndarray, rows_at_once: int = 2048) -> np.ndarray:
    """For each row the mean over its letter positions; all 0 if it has none."""
    if not len(p["c"]):
        return np.zeros((len(off) - 1, 0))
    size = np.diff(off)
    count = -(-size // WINDOW)
    place = np.cumsum(count) - count
    grid = np.full(int(count.sum()) * WINDOW, 32, np.uint8)
    grid[np.arange(len(buf)) + np.repeat(place * WINDOW - off[:-1], size)] = _FOLD[buf]
    grid = grid.reshape(-1, WINDOW)
    sums = np.zeros((len(grid) + 1, len(p["c"])))
    for k in range(0, len(grid), rows_at_once):
        part = grid[k : k + rows_at_once]
        prob = positions(p, part)
        prob *= _LETTER[part].T[:, None, :]
        sums[k : k + len(part)] = prob.sum(0).T
    total = np.add.reduceat(sums, np.minimum(place, len(grid)), axis=0) * (count > 0)[:, None] if len(off) > 1 else np.zeros((0, len(p["c"])))
    return total / np.maximum(total.sum(1, keepdims=True), 1e-30)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, p: dict[str, np.ndarray], langs: list[str]) -> DataFrame:
    """docs (doc_id, text, any more columns) with lang_pred and score added after all columns but those of these names."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*names)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = kernels.byte_view(batch.column(at))
            plain = np.zeros(256, bool)
            plain[65:91] = plain[97:123] = True
            for a, b in kernels.slices(off):
                part, edge = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                prob = document_probabilities(p, part, edge)
                seen = np.append(0, np.cumsum(plain[part]))
                letter = seen[edge[1:]] > seen[edge[:-1]]
                for i in np.flatnonzero(~letter).tolist():
                    letter[i] = _has_letter(part[edge[i] : edge[i + 1]].tobytes())
                best = prob.argmax(1) if len(langs) else np.zeros(b - a, int)
                said = [langs[k] if ok and langs else "und" for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                score = np.where(letter, prob.max(1, initial=0), 0.0)
                yield pa.record_batch([*batch.slice(a, b - a).columns, pa.array(said), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def sample(docs: DataFrame) -> tuple[list[str], list[int], list[str]]:
    """Texts, their languages' numbers and the languages' names: of each language the TRAIN_DOCS rows of least hash of
    their id among those whose crc32(doc_id as text) mod 5 is not 0, of each text TRAIN_CHARS characters from a place that
    its id sets. One pass, in which each task keeps its TRAIN_DOCS least of a language before the shuffle."""
    may = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    piece = F.expr(f"substring(text, cast(1 + pmod(xxhash64(doc_id), greatest(1, length(text) - {TRAIN_CHARS})) AS int), {TRAIN_CHARS})")
    rows = may.select("lang", "doc_id", piece.alias("text"))
    order = (F.xxhash64("doc_id"), "doc_id", "text")
    # what all tasks have kept of a language meets in shares first
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("place") <= TRAIN_DOCS)
    chosen = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= TRAIN_DOCS).orderBy("lang", "place").collect()
    names = sorted({r["lang"] for r in chosen})
    number = {x: k for k, x in enumerate(names)}
    chosen.sort(key=lambda r: (r["place"], r["lang"]))
    return [r["text"] for r in chosen], [number[r["lang"]] for r in chosen], names


def language_id(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """docs (doc_id, text, lang, any more columns) with lang_pred and score added.

    Learned from text and lang of rows whose crc32(doc_id as text) mod 5 is not 0 (see sample), all languages of them; text
    alone enters a prediction. Rows that repeat give equal rows, and no rows give no rows. Texts that are null or have no letter get `und` and score 0; so does every text if nothing can be learned.
    Every other text gets a learned language, and as score the mean probability of that language over its letters.
    """
    texts, langs, names = sample(docs)
    return predict(docs, train(texts, langs, len(names), steps), names)
