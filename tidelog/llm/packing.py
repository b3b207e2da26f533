"""Packing of token ids into sequences of a fixed size: sum-of-squares online packing within each partition.

A document of n ids gives n // size whole windows and one remainder. The remainder goes to the fill level (0 opens a window) for which
the sum of squares of N(level), the number of partially filled windows at each level, is least afterwards; the array N is all the state
that the choice reads. When the input ends, the windows still open are closed by cutting: their pieces, in order, are run on into
full sequences, and what is left is cut into sequences whose sizes are powers of two, which need no padding. So no sequence is padded.

Each partition packs what it reads; nothing is shuffled, and the state is the open windows' pieces (numbers, no texts). A sequence id
holds the partition in its upper bits. Results: a null text is an empty document, that is the end id alone; null and repeated ids are
carried as they come, each row by itself. An empty table gives no piece. Very long texts are cut, never dropped; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

#: Parts strings in a batch for the tokenizer; a single token.
MARK = b"^"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = ~_LETTER
_SIGN[128:] = False
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class Tokens:
    """Token ids of texts, looked up by a word's parts in an open-addressing table that the tokenizer fills.

    The tokenizer drops white space, lower-cases, and splits words where a run of letters ends, never joining across such a place. So
    a text's ids are those of its words' parts in turn: the letters a word begins with (when a sign of ASCII follows a letter of ASCII or
    Latin-1), and the rest. Texts that may hold special tokens are encoded whole."""

    BITS = 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a run
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.where = np.full(1 << self.BITS, -1, np.int32)
        self.first = np.zeros(1, np.int64)
        self.pool = np.zeros(0, "<u4")
        #: Of each entry its size in bytes and its first 16 bytes, which are all of it: longer parts are in `long`, by their bytes.
        self.size, self.low, self.high = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.long: dict[bytes, int] = {}

    def find(self, h: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each short part, -1 if it has none. An entry is taken only if its bytes are the part's."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            e = self.where[slot[left]]
            left, e = left[e >= 0], e[e >= 0]
            hit = (self.low[e] == low[left]) & (self.high[e] == high[left]) & (self.size[e] == size[left])
            out[left[hit]] = e[hit]
            left = left[~hit]
            slot[left] = (slot[left] + 1) & ((1 << self.BITS) - 1)
        return out

    def _append(self, parts: list[bytes]) -> np.ndarray:
        ids = self.encode(parts)
        entry = np.arange(len(parts), dtype=np.int32) + np.int32(len(self.first) - 1)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
        self.pool = np.concatenate([self.pool, *ids])
        return entry

    def add(self, h: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, parts: list[bytes]) -> None:
        """Short parts that have no entry yet."""
        entry = self._append(parts)
        self.size, self.low, self.high = (np.concatenate(x) for x in ((self.size, size), (self.low, low), (self.high, high)))
        slot, left = (h >> np.uint64(64 - self.BITS)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.where[slot[left]] < 0]
            self.where[slot[free]] = entry[free]
            left = left[self.where[slot[left]] != entry[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.BITS) - 1)

    def add_long(self, parts: list[bytes]) -> None:
        for p, e in zip(parts, self._append(parts).tolist(), strict=True):
            self.long[p] = e
        blank = np.zeros(len(parts), np.int64)
        self.size, self.low, self.high = np.concatenate([self.size, blank - 1]), np.concatenate([self.low, blank.astype(np.uint64)]), np.concatenate([self.high, blank.astype(np.uint64)])

    def entries(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each part buf[a:b]; parts that are new get one."""
        size, blocks, raw = b - a, tx.blocks_at(buf), None
        h, low, high = tx.range_hashes(buf, a, b), tx.first_bytes(blocks, a, size), tx.first_bytes(blocks, a + 8, size - 8)
        short, out = np.flatnonzero(size <= 16), np.full(len(a), -1, np.int64)
        if len(self.first) + len(a) > 1 << (self.BITS - 1):
            self.clear()
        bytes_of = lambda k: raw[a[k] : b[k]]
        if len(short) < len(a):
            raw = buf.tobytes()
            long = [(k, bytes_of(k)) for k in np.flatnonzero(size > 16).tolist()]
            if new := list(dict.fromkeys(p for _, p in long if p not in self.long)):
                self.add_long(new)
            for k, p in long:
                out[k] = self.long[p]
        out[short] = self.find(h[short], size[short], low[short], high[short])
        while (miss := np.flatnonzero(out < 0)).size:  # once more only if different parts share a hash
            raw = raw or buf.tobytes()
            new = miss[np.unique(h[miss], return_index=True)[1]]
            self.add(h[new], size[new], low[new], high[new], [bytes_of(k) for k in new.tolist()])
            out[miss] = self.find(h[miss], size[miss], low[miss], high[miss])
        return out

    def encode(self, parts: list[bytes]) -> list[np.ndarray]:
        """Many short strings in a few calls: runs of letters are parted by the tokens that end a run, others by MARK."""
        call = lambda text: np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, "<u4")
        out: list = [None] * len(parts)
        runs = [i for i, p in enumerate(parts) if _LETTERS.fullmatch(p)]
        known = set(runs)
        for at in range(0, len(runs), 20_000):
            ids = call(b"\n".join([parts[i] for i in runs[at : at + 20_000]]))
            for i, x in zip(runs[at : at + 20_000], np.split(ids, np.flatnonzero(self.last[ids])[:-1] + 1), strict=True):
                out[i] = x
        others = [i for i in range(len(parts)) if i not in known and MARK not in parts[i]]
        for at in range(0, len(others), 20_000):
            ids = call((b"\n" + MARK + b"\n").join([parts[i] for i in others[at : at + 20_000]]))
            cuts = np.flatnonzero(ids == self.mark)
            for i, a, b in zip(others[at : at + 20_000], [0, *(cuts + 1)], [*cuts, len(ids)], strict=True):
                out[i] = ids[a:b]
        return [call(p) if x is None else x for p, x in zip(parts, out, strict=True)]

    def documents(self, data, offsets: np.ndarray) -> list[bytes]:
        """The ids of each document, as little-endian 32-bit numbers."""
        special = {d for d in range(len(offsets) - 1) if b"<|" in bytes(data[offsets[d] : offsets[d + 1]])} if b"<|" in bytes(data) else set()
        buf = tx.LOWER[np.frombuffer(data, np.uint8)]
        starts, ends, first = tx.words(buf, offsets)
        signs = np.append(np.flatnonzero(_SIGN[buf]), len(buf))
        cut = signs[np.searchsorted(signs, starts)]
        one, two = buf[np.maximum(cut - 1, 0)], buf[np.maximum(cut - 2, 0)]
        cuts = (cut > starts) & (cut < ends) & (_LETTER[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7) & (cut - 2 >= starts)))
        count = 1 + cuts.astype(np.int64)
        lead = np.cumsum(count) - count  # index of a word's first part
        a, b = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        a[lead], b[lead] = starts, np.where(cuts, cut, ends)
        a[lead[cuts] + 1], b[lead[cuts] + 1] = cut[cuts], ends[cuts]
        entry = self.entries(buf, a, b)
        n = np.diff(self.first)[entry] if len(entry) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.first[entry] - before[:-1], n) + np.arange(before[-1])]
        edge = before[np.append(lead, len(a))[first]].tolist()
        out = [ids[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
        for d in special:
            out[d] = np.array(self.tokenizer.encode(str(data[offsets[d] : offsets[d + 1]], "utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        return out


@functools.lru_cache(1)
def tokens_of(path: str) -> Tokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(path)


class Packer:
    """One partition's packer. finish() and put() return pieces (doc, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, size: int, base: int):
        if size & (size - 1):
            raise ValueError("the sequence size must be a power of two")
        self.size, self.base, self.next = size, base, 0
        self.count = np.zeros(size, np.int64)  # N(level)
        self.open: list[list[list]] = [[] for _ in range(size)]  # by level, the windows: lists of (doc, start, ids, tokens)

    def _sequence(self) -> int:
        self.next += 1
        return self.base + self.next - 1

    @staticmethod
    def _piece(doc, start, ids, tokens, sequence, offset):
        return doc, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset

    def put(self, doc, ids: bytes) -> list[tuple]:
        size, n = self.size, len(ids) // 4
        whole = n - n % size
        out = [self._piece(doc, s, ids[4 * s : 4 * (s + size)], n, self._sequence(), 0) for s in range(0, whole, size)]
        if whole < n:
            out += self._place(doc, whole, ids[4 * whole :], n)
        return out

    def level(self, length: int) -> int:
        """The fill level to join: a window that moves from h to g changes N(h)^2 + N(g)^2; ties go to the fullest window."""
        size, count = self.size, self.count
        h = np.flatnonzero(count[: size - length + 1])
        if not len(h):
            return 0
        goal = h + length
        change = 2 - 2 * count[h] + 2 * np.append(count, -1)[goal]  # N(h) falls and N(goal) grows by one; a full window has no level
        best = len(h) - 1 - int(change[::-1].argmin())
        return int(h[best]) if change[best] <= 2 * count[length] + 1 else 0

    def _place(self, doc, start, ids, tokens) -> list[tuple]:
        length = len(ids) // 4
        h = self.level(length)
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
        window.append((doc, start, ids, tokens))
        goal = h + length
        if goal < self.size:
            self.count[goal] += 1
            self.open[goal].append(window)
            return []
        return self._emit(window)

    def _emit(self, window) -> list[tuple]:
        sequence, at, out = self._sequence(), 0, []
        for doc, start, ids, tokens in window:
            out.append(self._piece(doc, start, ids, tokens, sequence, at))
            at += len(ids) // 4
        return out

    def finish(self) -> list[tuple]:
        """Runs the open windows on into full sequences, fullest first, and the rest into powers of two."""
        pieces = [p for level in reversed(self.open) for w in level for p in w]
        left = sum(len(p[2]) // 4 for p in pieces)
        rooms = [self.size] * (left // self.size) + [1 << b for b in reversed(range(self.size.bit_length())) if (left % self.size) >> b & 1]
        out, k, room, window = [], 0, rooms[0] if rooms else 0, []
        for doc, start, ids, tokens in pieces:
            while ids:
                take = min(room, len(ids) // 4)
                window.append((doc, start, ids[: 4 * take], tokens))
                ids, start, room = ids[4 * take :], start + take, room - take
                if not room:
                    out += self._emit(window)
                    window, k = [], k + 1
                    room = rooms[k] if k < len(rooms) else 0
        self.open = [[] for _ in range(self.size)]
        self.count[:] = 0
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], SCHEMA.replace(" bigint", "").split(", "))


def pack(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece. The tokenizer file must lie at `path` on each executor."""

    from .shared import small_batches

    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        tokens, packer = tokens_of(path), Packer(size, TaskContext.get().partitionId() << 40)
        end, rows = np.array([end_id], "<u4").tobytes(), []
        for batch in batches:
            for ids, data, offsets in tx.slices(batch.column(0), batch.column(1), 1 << 20):
                for doc, x in zip(tx.plain_ids(ids), tokens.documents(data, offsets), strict=True):
                    rows += packer.put(doc, x + end)
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
