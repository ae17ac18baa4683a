"""Byte-level BPE by a finite-state transducer, and streaming decoding.

The merges of a rank table are compiled, as inputs ask for it, into a deterministic transducer. It rests on a property of
rank-ordered merging: a token sequence is the encoding of its bytes exactly if each token encodes to itself and each
neighbouring pair encodes to that pair. So each prefix of a piece has one last token, found from the last tokens of
shorter prefixes. A state is the last token that has been emitted with the bytes read since; a token is emitted once
every token that could still begin or go on leaves it in place, at most the longest token's length later.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from barline.llm.scratch import tidy

#: Entries at which a memory of text units, of pieces, of token pairs and of transitions is thinned out or full: about 200 MB
#: together, held by a task until it ends. More transitions only take more memory: rare ones are as fast worked out anew.
UNITS, PIECES, PAIRS, MOVES = 500_000, 400_000, 200_000, 60_000
#: Characters of texts that are encoded together.
RUN = 1 << 21
#: Above every rank.
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: on each line a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes pieces (bytes) by ranks. A piece that is a token as a whole is that token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self._size = [0] * (max(self.token, default=-1) + 1)
        #: bytes that a token is or begins with -> 2 * rank (-2: no token) + whether a longer token goes on from them
        self._at = {b[:k]: -1 for b in ranks for k in range(1, len(b))}
        for b, i in ranks.items():
            self._size[i] = len(b)
            self._at[b] = 2 * i + (b in self._at)
        self.lookahead = max(map(len, ranks), default=0)
        self._ends: dict[int, tuple[list, list, bool] | None] = {}
        self.forget()

    def forget(self) -> None:
        """Drops the states and transitions that inputs have asked for."""
        self._fine: dict[int, bool] = {}
        #: (token before, bytes since, last token of each prefix of these, places where a token can begin, number or -1)
        self._start = (-1, b"", (-1,), (0,), 0)
        self._known: dict[tuple[int, bytes], tuple] = {(-1, b""): self._start}
        #: state number * 256 + byte -> (tokens emitted, state); once MOVES are known, others are worked out anew
        self._moves: dict[int, tuple[tuple[int, ...], tuple]] = {}

    def merged(self, piece: bytes, parts_left: int = 1) -> list[bytes]:
        """The definition: merge the neighbouring parts of least rank, the leftmost first, until none has a rank or few are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > parts_left:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, t: int) -> tuple[list, list, bool] | None:
        """The tokens at the right and at the left end of t while it is merged, as (rank, bytes), shortest first; and whether
        each merge has a later rank than those that make its parts, as in a trained table. None: t never encodes to itself."""
        found = self._ends.get(t, ())
        if found == ():
            whole = self.token[t]
            if len(whole) == 1:
                found = [(t, whole)], [(t, whole)], True
            else:
                halves = self.merged(whole, 2)
                ends = [self._edges(self.ranks[h]) for h in halves] if len(halves) == 2 else [None]
                if None in ends:
                    found = None
                else:
                    rising = all(e[2] and (self.ranks[h] < t or len(h) == 1) for e, h in zip(ends, halves, strict=True))
                    found = [*ends[1][0], (t, whole)], [*ends[0][1], (t, whole)], rising
            self._ends[t] = found
        return found

    def _follows(self, one: int, two: int) -> bool:
        """Whether token two can stand after token one (-1: at the start): no merge over the boundary comes before those that make them."""
        found = self._fine.get(one << 32 | two)
        if found is None:
            if len(self._fine) > PAIRS:
                self._fine.clear()
            right = self._edges(two)
            left = self._edges(one) if one >= 0 else None
            if right is None or one < 0:
                found = right is not None
            elif left is None or not (left[2] and right[2]):
                found = self.merged(self.token[one] + self.token[two]) == [self.token[one], self.token[two]]
            else:
                found = self._apart(left[0], right[1])
            self._fine[one << 32 | two] = found
        return found

    def _apart(self, left: list, right: list) -> bool:
        """left, right: what stands before and after the boundary in turn. True if they never merge."""
        i = j = 0
        while True:
            over = self.ranks.get(left[i][1] + right[j][1], NEVER)
            grow_left = left[i + 1][0] if i + 1 < len(left) else NEVER
            grow_right = right[j + 1][0] if j + 1 < len(right) else NEVER
            if over < grow_left and over <= grow_right and over != NEVER:
                return False
            if grow_left == grow_right == NEVER:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def _advance(self, state: tuple, byte: int) -> tuple[tuple[int, ...], tuple]:
        before, tail, last, open_, _ = state
        tail += bytes((byte,))
        end = len(tail)
        at, fine = self._at.get, self._fine.get
        t, still = -1, []
        for k in open_:  # one token ends here; a token goes on only from where one could begin
            found = at(tail[k:])
            if found is None:
                continue
            if found & 1:
                still.append(k)
            if t < 0 <= found >> 1:
                one, two = last[k] if k else before, found >> 1
                if fine(one << 32 | two) or self._follows(one, two):
                    t = two
        if t < 0:
            raise ValueError(f"no token ends {tail!r}")
        last = (*last, t)
        # all open places and the end go back along their tokens until they meet: up to there all is settled
        size, done = self._size, end
        for k in still:
            while k != done:
                if k > done:
                    k -= size[last[k]]
                else:
                    done -= size[last[done]]
            if not done:
                break
        here = (last[done], tail[done:]) if done else (before, tail)
        state = self._known.get(here)
        if state is None:
            # the entry at the start of the tail is never read
            rest = (-1, *last[done + 1 :]) if done else last
            state = (*here, rest, (*(k - done for k in still), end - done), len(self._known) if len(self._moves) < MOVES else -1)
            if state[4] >= 0:
                self._known[here] = state
        return self._back(last, done) if done else (), state

    def _back(self, last: tuple, k: int) -> tuple[int, ...]:
        """The tokens from the start of the tail to place k."""
        out = []
        while k:
            out.append(last[k])
            k -= self._size[last[k]]
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_sorted([piece])[0]

    def encode_sorted(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; a piece goes on from where the one before it begins to differ, so sorted ones are cheapest."""
        result = []
        moves, whole, advance, back = self._moves, self.ranks.get, self._advance, self._back
        read, states, ends, out = b"", [self._start], [0], []
        for piece in pieces:
            found = whole(piece)
            if found is not None:
                result.append([found])
                continue
            same = 0
            for x, y in zip(read, piece):  # noqa: B905
                if x != y:
                    break
                same += 1
            del states[same + 1 :], ends[same + 1 :], out[ends[same] :]
            state = states[-1]
            for byte in piece[same:]:
                at = state[4] * 256 + byte
                move = moves.get(at) if at >= 0 else None
                if move is None:
                    move = advance(state, byte)
                    if at >= 0 and len(moves) < MOVES:
                        moves[at] = move
                if move[0]:
                    out += move[0]
                state = move[1]
                states.append(state)
                ends.append(len(out))
            read = piece
            result.append([*out, *back(state[2], len(state[1]))])
        return result


def gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + count], one after the other."""
    return flat[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]


class Memory:
    """The ids of texts that were met, in arrays; a number stands for each text until the next call of numbers()."""

    def __init__(self, limit: int, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        """encode: distinct texts to their ids, one after the other, and how many each has."""
        self.limit, self.encode = limit, encode
        self.at: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.start, self.count, self.again = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _thin(self) -> None:
        """Keeps what was met more than once since the last time, at most half of the limit."""
        stay = np.flatnonzero(self.again)[: self.limit // 2]
        number = np.full(len(self.again), -1)
        number[stay] = np.arange(len(stay))
        kept = number.tolist()
        self.at = {text: kept[k] for text, k in self.at.items() if kept[k] >= 0}
        self.flat = gathered(self.flat, self.start[stay], self.count[stay])
        self.count = self.count[stay]
        self.start, self.again = np.cumsum(self.count) - self.count, np.zeros(len(stay), bool)

    def numbers(self, texts: list[str]) -> np.ndarray:
        """The numbers of distinct texts."""
        if len(self.at) > self.limit:
            self._thin()
        get = self.at.get
        found = np.array([get(t, -1) for t in texts], np.int64)
        self.again[found[found >= 0]] = True
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [texts[i] for i in missing.tolist()]
            ids, count = self.encode(new)
            first = len(self.count)
            found[missing] = np.arange(first, first + len(new))
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(count) - count)
            self.flat, self.count = np.append(self.flat, ids.astype(np.uint32, copy=False)), np.append(self.count, count)
            self.again = np.append(self.again, np.zeros(len(new), bool))
        return found

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of these numbers, one after the other, and how many each has."""
        count = self.count[numbers]
        return gathered(self.flat, self.start[numbers], count), count


class Pieces:
    """Texts to ids by way of a memory of the pieces that a pattern cuts them into."""

    def __init__(self, split: regex.Pattern, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = PIECES):
        self.split, self.memory = split, Memory(limit, encode)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        find, place, sequence, many = self.split.findall, {}, [], []
        for text in texts:
            pieces = find(text)
            sequence += [place.setdefault(p, len(place)) for p in pieces]
            many.append(len(pieces))
        numbers = self.memory.numbers(list(place))
        ids, count = self.memory.ids(numbers[np.array(sequence, np.int64)])
        upto = np.append(0, np.cumsum(count))
        ends = upto[np.cumsum(np.array(many, np.int64))]
        return ids, np.diff(ends, prepend=0)


#: A run of white space around a single space; only there may a piece cross a cut before " x".
_CROSSES = re.compile(r"\s \s|\s \Z")


class Units:
    """Texts to ids by way of a memory of text units.

    A unit is a space and what follows it up to the next space. As each alternative of the pattern takes a space only at
    its start or inside a run of white space, texts without such runs fall into units that are encoded apart.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], np.ndarray] | None = None, special: tuple[str, ...] = (), limit: int = UNITS):
        """special: strings, and whole the way to encode a text that holds one."""
        self.encode, self.whole, self.special = encode, whole, special
        self.memory = Memory(limit, lambda units: encode([" " + u for u in units]))

    def pack(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; each distinct unit of them is looked up once."""
        result: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        firsts: list[tuple[int, str]] = []
        rests: list[tuple[int, str]] = []
        for k, t in enumerate(texts):
            if self.special and any(x in t for x in self.special):
                result[k] = self.whole(t)
                continue
            first, space, rest = (t, "", "") if _CROSSES.search(t) else t.partition(" ")
            if first:
                firsts.append((k, first))
            if space:
                rests.append((k, rest))
        ids, count = self.encode([t for _, t in firsts])
        at = np.append(0, np.cumsum(count)).tolist()
        for (k, _), x, y in zip(firsts, at[:-1], at[1:], strict=True):
            result[k] = ids[x:y]
        if rests:
            split = pc.split_pattern(pa.array([t for _, t in rests], pa.large_string()), " ")
            coded = split.flatten().dictionary_encode()
            numbers = self.memory.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            ids, count = self.memory.ids(numbers[coded.indices.to_numpy()])
            at = np.append(0, np.cumsum(count))[split.offsets.to_numpy()].tolist()
            for (k, _), x, y in zip(rests, at[:-1], at[1:], strict=True):
                result[k] = np.concatenate([result[k], ids[x:y]]) if len(result[k]) else ids[x:y]
        return result


def runs(column: pa.Array, most: int = RUN) -> Iterator[tuple[int, list[str]]]:
    """(where it begins, texts) of runs of a column of texts, null as empty: as many as come to `most` characters, one at least."""
    at, held, size = 0, [], 0
    for k, text in enumerate(column):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= most or k + 1 == len(column):
            yield at, held
            at, held, size = k + 1, [], 0


class Utf8Machine:
    """Incremental UTF-8: give it bytes as they come; it returns the text that is complete so far.

    The state is the start of a character that has not ended (at most three bytes). Ill-formed bytes become U+FFFD.
    """

    def __init__(self):
        self.open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that lacks its rest."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 4 if 0xF0 <= byte <= 0xF4 else 3 if byte >= 0xE0 and byte < 0xF0 else 2 if 0xC2 <= byte < 0xE0 else 1
            if need <= back:
                return 0
            if back > 1:  # the byte after the first has a narrower range for some
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                if not low <= data[-back + 1] <= high:
                    return 0
            return back
        return 0

    def push(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data) - self._unfinished(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids to bytes by table, and to text as a stream."""

    def __init__(self, token: dict[int, bytes]):
        size = max(token, default=-1) + 1
        self.length = np.zeros(size, np.int64)
        for i, b in token.items():
            self.length[i] = len(b)
        self.start = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(token.get(i, b"") for i in range(size)), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        total = int(n.sum())
        return self.blob[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(total)].tobytes()

    def stream(self, ids: np.ndarray, step: int = 1 << 16) -> Iterator[tuple[bytes, str]]:
        """(bytes, text complete so far) for `step` ids at a time."""
        machine = Utf8Machine()
        for k in range(0, len(ids), step):
            data = self.bytes_of(ids[k : k + step])
            yield data, machine.push(data)
        if machine.open:
            yield b"", machine.end()


def encoder(machine: Transducer, pattern: str) -> Units:
    """Texts to ids by the machine's ranks, each match of the pattern separately."""

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in pieces]
        order = sorted(range(len(raw)), key=raw.__getitem__)
        flat, count = array("I"), np.zeros(len(raw), np.int64)
        start = np.zeros(len(raw), np.int64)
        for k in range(0, len(order), 1 << 14):
            part = order[k : k + (1 << 14)]
            for i, ids in zip(part, machine.encode_sorted([raw[j] for j in part]), strict=True):
                start[i], count[i] = len(flat), len(ids)
                flat.extend(ids)
        return gathered(np.frombuffer(flat, np.uint32) if flat else np.zeros(0, np.uint32), start, count), count

    return Units(Pieces(regex.compile(pattern), encode))


_made: dict[str, tuple[Transducer, Decoder]] = {}


def _tools(path: str) -> tuple[Transducer, Decoder]:
    if path not in _made:
        machine = Transducer(read_ranks(path))
        _made[path] = machine, Decoder(machine.token)
    return _made[path]


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids binary, decoded string]) for each row of docs (doc_id, text, any more columns).

    path: a rank file that every worker can read. The digests are of the ids as little-endian unsigned 32-bit integers
    and of the bytes that decoding them gives; with_ids adds both themselves. A null text counts as empty: no ids, and
    the digests of nothing. Rows that repeat give equal rows; a null doc_id stays null; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, decoder = _tools(path)
        units = encoder(machine, pattern)
        gc.disable()  # nothing here makes cycles, and looking for them among so many tuples takes time
        try:
            for batch in batches:
                for at, texts in runs(batch.column(1)):
                    part = batch.slice(at, len(texts))
                    rows: list[tuple] = []
                    for ids in units.pack(texts):
                        packed = ids.astype("<u4", copy=False).tobytes()
                        told, said = hashlib.sha256(), []
                        for data, string in decoder.stream(ids):
                            told.update(data)
                            if with_ids:
                                said.append(string)
                        rows.append((len(ids), hashlib.sha256(packed).hexdigest(), told.hexdigest(), packed, "".join(said)))
                    cols = list(zip(*rows, strict=True))
                    out = {"doc_id": part.column(0), "n_tokens": pa.array(cols[0], pa.int64()), "ids_sha256": pa.array(cols[1], pa.string()), "decoded_sha256": pa.array(cols[2], pa.string())}
                    if with_ids:
                        out |= {"ids": pa.array(cols[3], pa.binary()), "decoded": pa.array(cols[4], pa.string())}
                    yield pa.record_batch(out)
        finally:  # the worker may go on to other stages, whose memory this would take
            gc.enable()
            machine.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(tidy(run), schema)
