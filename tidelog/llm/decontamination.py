"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, then weighted-shingle similarity.

Words are lower-cased (A-Z); a shingle is `shingle` words in a row (a shorter item is one shingle). For an item of L words every window of L
words of a document is a candidate, and a document of fewer words is one as a whole. Each has a 64-bit SimHash over its weighted shingles
(weight: how often it occurs in it). Item fingerprints are filed by each of 4 blocks of 16 bits; a window asks for all values within
3 bits of each of its blocks, so it meets every item within 15 bits: beyond 3 in each block there would be 16. Items met within `radius` bits
are verified exactly: weighted Jaccard similarity (sum of minima over sum of maxima of the counts) of at least `similarity`.

Windows are only hashed where they can reach the similarity s: a window of M shingles needs s (M + m) / (1 + s) shingles that some item
of m shingles holds. That bound is exact, so it changes no result; it is counted with prefix sums over all positions. SimHash itself may miss
a pair: at similarity 0.8 fingerprints differ in about 10 bits. `tests/llm` measures the recall at radius 15.

The benchmark is a query set: it is read in blocks of about `block_chars` characters (one more pass over the documents for each block beyond
the first), one block at a time on the driver and in a task, whatever its size. With several blocks the rows are numbered once in a
table, and hits are brought together by that number, so the result does not depend on the blocks.

Results: a null text or item text has no words; an item without words or id matches nothing. Items that repeat an id are one item, with its
best window. Documents repeat as they come, also with null or equal ids, each with its own hits. Empty tables give no rows, an empty
benchmark no hits. Very long texts are searched whole. Columns other than doc_id, text and item_id are not read; `clean` passes them on.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import written

SCHEMA = "doc_id bigint, n_hits bigint, items string, similarity double, spans string"
BLOCKS, WIDTH, REACH = 4, 16, 3
def _flips(most: int) -> np.ndarray:
    """All changes of at most `most` bits of a block."""
    return np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in itertools.combinations(range(WIDTH), n)], np.int64)


#: The changes are split between the two sides: an item is filed under its block with one bit changed or none, a window asks with up to two.
_FILED, _ASKED, _ALL = _flips(1), _flips(REACH - 1), _flips(REACH)


def _simhash(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1).view(">u8").reshape(sums.shape[:-1]).astype(np.uint64)


def _signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _counts(h) -> dict:
    values, n = np.unique(h, return_counts=True)
    return dict(zip(values.tolist(), n.tolist(), strict=True))


def weighted_similarity(a: dict, b: dict) -> float:
    low = sum(min(n, b.get(k, 0)) for k, n in a.items())
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


class Group:
    """Items of one number of words: their shingle counts, fingerprints, and the items of each value of each block."""

    def __init__(self, words: int, items: list[tuple[int, np.ndarray]]):
        self.words, self.items, self.shingles = words, [i for i, _ in items], len(items[0][1])
        self.counts = [_counts(h) for _, h in items]
        self.prints = np.array([_simhash(_signs(h).sum(0)) for _, h in items], np.uint64)
        self.values, self.order, self.near_any = [], [], []
        for b in range(BLOCKS):
            value = self._block(self.prints, b)
            filed = (value[:, None] ^ _FILED).ravel()
            order = np.argsort(filed, kind="stable")
            self.values.append(filed[order])
            self.order.append(order // len(_FILED))
            near = np.zeros(1 << WIDTH, bool)
            for at in range(0, len(value), 1024):
                near[(value[at : at + 1024, None] ^ _ALL).ravel()] = True
            self.near_any.append(np.packbits(near))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(64 - WIDTH * (b + 1))).astype(np.int64) & ((1 << WIDTH) - 1)

    def near(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) pairs that meet in a block and differ in at most radius bits, in order."""
        found = []
        for b in range(BLOCKS):
            value = self._block(prints, b)
            live = np.flatnonzero(self.near_any[b][value >> 3] >> (7 - (value & 7)) & 1)
            for at in range(0, len(live), 4096):
                part = live[at : at + 4096]
                asked = (value[part, None] ^ _ASKED).ravel()
                lo, hi = np.searchsorted(self.values[b], asked), np.searchsorted(self.values[b], asked, "right")
                met = np.flatnonzero(hi > lo)
                n = (hi - lo)[met]
                who = part[np.repeat(met // len(_ASKED), n)]
                item = self.order[b][np.repeat(lo[met] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                close = np.bitwise_count(prints[who] ^ self.prints[item]) <= radius
                found.append(who[close] * len(self.items) + item[close])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pair // len(self.items), pair % len(self.items)


class Index:
    """Benchmark items by length. `compared` and `possible` count the window-item pairs that met in a block, and all."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, similarity: float, radius: int):
        if radius > BLOCKS * (REACH + 1) - 1:
            raise ValueError(f"blocks guarantee pairs within {BLOCKS * (REACH + 1) - 1} bits")
        self.similarity, self.radius, self.compared, self.possible = similarity, radius, 0, 0
        by: dict = {}
        for item, text in items:
            data = tx.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, ends, _ = tx.words(data, np.array([0, len(data)]))
            if len(starts):
                h = tx.range_hashes(data, starts, ends)
                by.setdefault(len(h), []).append((item, tx.window_hashes(h, min(len(h), shingle))))
        self.groups: dict[int, list[Group]] = {}
        for words, group in sorted(by.items()):
            self.groups.setdefault(min(words, shingle), []).append(Group(words, group))
        self.known = {w: np.unique(np.concatenate([h for n, g in by.items() if min(n, shingle) == w for _, h in g])) for w in self.groups}
        # Most shingles of a text are in no item: a table of bits turns them away before the exact look-up.
        self.sieve = {w: np.zeros(1 << 20, bool) for w in self.known}
        for w, known in self.known.items():
            self.sieve[w][(known >> np.uint64(44)).astype(np.int64)] = True

    def search(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, item, similarity, first word, words) of every window that matches; h: word hashes, first: documents' first words."""
        n_words = np.diff(first)
        for width, known in self.known.items():
            s = tx.window_hashes(h, width)
            if not len(s):
                continue
            maybe = np.flatnonzero(self.sieve[width][(s >> np.uint64(44)).astype(np.int64)])
            at = np.searchsorted(known, s[maybe])
            hit = maybe[known[np.minimum(at, len(known) - 1)] == s[maybe]]
            if not len(hit):
                continue
            hits = np.zeros(len(s) + 1, np.int64)
            hits[hit + 1] = 1
            hits = np.cumsum(hits)
            touched = np.unique(np.searchsorted(first, hit, "right") - 1)
            for group in self.groups[width]:
                # Shorter documents are windows as they are; one that cannot reach the similarity by its size is left out.
                whole = touched[(n_words[touched] >= width) & (n_words[touched] < group.words)]
                m = n_words[whole] - width + 1
                good = (m >= self.similarity * group.shingles - 1e-9) & (hits[first[whole] + m] - hits[first[whole]] >= self.need(m, group.shingles))
                yield from self._verified(s, group, first[whole[good]], m[good], whole[good], n_words[whole[good]])
                yield from self._windows(s, hits, hit, group, first)

    def need(self, m, other):
        """Shingles that both of two windows of m and `other` shingles hold at least."""
        return np.ceil((m + other) * self.similarity / (1 + self.similarity) - 1e-9)

    def _windows(self, s, hits, hit, group: Group, first):
        """Windows of the group's words, that is m shingles from their first word on."""
        m = group.shingles
        low = np.maximum(hit - m + 1, np.concatenate([[0], hit[:-1] + 1]))  # places whose window holds a hit, each once
        size = hit - low + 1
        starts = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        starts = starts[starts + m <= len(s)]
        starts = starts[hits[starts + m] - hits[starts] >= self.need(m, m)]
        doc = np.searchsorted(first, starts, "right") - 1
        inside = starts + group.words <= first[doc + 1]
        starts, doc = starts[inside], doc[inside]
        yield from self._verified(s, group, starts, np.full(len(starts), m), doc, np.full(len(starts), group.words))

    def _verified(self, s, group: Group, starts, m, doc, words):
        """Windows of m shingles from `starts` on, against the items that their fingerprints meet."""
        for at in range(0, len(starts), 4096):
            part, size = starts[at : at + 4096], m[at : at + 4096]
            sums = np.zeros((len(part), 64), np.int32)
            for k in range(int(size.max())):
                live = np.flatnonzero(size > k)
                sums[live] += _signs(s[part[live] + k])
            who, item = group.near(_simhash(sums), self.radius)
            self.compared += len(who)
            self.possible += len(part) * len(group.items)
            for i, j in zip(who.tolist(), item.tolist(), strict=True):
                sim = weighted_similarity(_counts(s[part[i] : part[i] + size[i]]), group.counts[j])
                if sim >= self.similarity - 1e-12:
                    yield int(doc[at + i]), group.items[j], sim, int(part[i]), int(words[at + i])


def _best_hits(index: Index, data, offsets) -> list[dict]:
    """For each document of a run, item -> (similarity, first word, end) of its best window; the first one of equals."""
    buf = tx.LOWER[np.frombuffer(data, np.uint8)]
    starts, ends, first = tx.words(buf, offsets)
    found: list[dict] = [{} for _ in range(len(offsets) - 1)]
    for doc, item, sim, at, size in index.search(tx.range_hashes(buf, starts, ends), first):
        at -= int(first[doc])
        if item not in found[doc] or (-sim, at, at + size) < (-found[doc][item][0], *found[doc][item][1:]):
            found[doc][item] = (sim, at, at + size)
    return found


def indexes(benchmark: DataFrame, shingle: int, similarity: float, radius: int, block_chars: int) -> Iterator[Index]:
    """One index per block of the benchmark, each of about block_chars characters; made one by one."""
    known = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = known.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = int(total // block_chars) + 1
    for b in range(n):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield Index(list(zip(part["item_id"].to_pylist(), part["text"].to_pylist(), strict=True)), shingle, similarity, radius)


def _columns(rows: list[dict]) -> list[list]:
    """n_hits, items, similarity and spans from item -> (similarity, first word, end)."""
    return [
        [len(r) for r in rows],
        [",".join(str(i) for i in sorted(r)) for r in rows],
        [max((v[0] for v in r.values()), default=0.0) for r in rows],
        [",".join(f"{i}:{r[i][1]}:{r[i][2]}" for i in sorted(r)) for r in rows],
    ]


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 15, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document: how many items it holds, their ids in order, the best similarity, and item:first word:end of the best windows."""
    blocks = indexes(benchmark, shingle, similarity, radius, block_chars)
    index, second = next(blocks), next(blocks, None)
    if second is None:
        return tx.map_documents(docs, lambda ids, data, offsets: [tx.plain_ids(ids), *_columns(_best_hits(index, data, offsets))], SCHEMA)
    numbered = written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))
    hits = None
    for index in itertools.chain([index, second], blocks):

        def per_slice(ids, data, offsets, index=index):
            flat = [(row, item, *v) for row, found in zip(ids.tolist(), _best_hits(index, data, offsets), strict=True) for item, v in found.items()]
            return [list(c) for c in zip(*flat, strict=True)] or [[], [], [], [], []]

        part = written(tx.map_documents(numbered.select(F.col("row").alias("doc_id"), "text"), per_slice, "row bigint, item bigint, sim double, at bigint, end bigint"))
        hits = part if hits is None else hits.unionByName(part)
    # An item in two blocks (two texts under one id) keeps its best window. A row has few items, so its list is short.
    best = hits.groupBy("row", "item").agg(F.min_by(F.struct("sim", "at", "end"), F.struct(-F.col("sim"), "at", "end")).alias("v"))
    each = best.select("row", "item", "v.*").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item", "sim", "at", "end"))).alias("h"))
    joined = numbered.select("doc_id", "row").join(each, "row", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<item bigint, sim double, at bigint, end bigint>>")))
    text = lambda f: F.array_join(F.transform("h", f), ",")
    return joined.select(
        "doc_id", F.size("h").cast("long").alias("n_hits"), text(lambda x: x["item"].cast("string")).alias("items"), F.coalesce(F.array_max(F.transform("h", lambda x: x["sim"])), F.lit(0.0)).alias("similarity"),
        text(lambda x: F.concat_ws(":", x["item"], x["at"], x["end"])).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 15, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of docs, all columns, that hold no item. The verdict is computed beside the row, so no join on ids is needed."""
    from pyspark.sql.types import BooleanType

    from .shared import small_batches

    small_batches(docs.sparkSession)
    blocks = indexes(benchmark, shingle, similarity, radius, block_chars)
    index = next(blocks)
    while index is not None:

        def free(texts: pa.Array, index=index) -> pa.Array:
            out = [np.array([not r for r in _best_hits(index, data, offsets)], bool) for _, data, offsets in tx.slices(pa.array(np.arange(len(texts))), texts)]
            return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

        docs, index = docs.where(F.arrow_udf(_one_column(free), BooleanType())("text")), next(blocks, None)
        if index is not None:  # the next block's index gets a worker of its own
            docs = written(docs)
    return docs


def _one_column(fn):
    def verdict(texts: pa.Array) -> pa.Array:
        return fn(texts)

    verdict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return verdict
