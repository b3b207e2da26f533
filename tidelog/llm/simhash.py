"""SimHash near-duplicates with covering locality-sensitive hashing.

Fingerprint: XXH64 (seed 42) of each run of 3 words of the text with A-Z lower-cased, repeats included; bit b is 1 if it is set in over half
of them. A text of fewer words has its whole sequence as its one shingle; one without words has fingerprint zero and is linked like any.

Two fingerprints link when they differ in at most `radius` bits. Each bit position i gets a vector phi(i) of radius + 1 bits; for each
of the 2^(radius+1) - 1 non-zero vectors v, the mask holds the positions with <phi(i), v> odd. Whatever `radius` positions a pair differs in,
some v is orthogonal to all their vectors, so the pair agrees on that mask and meets in its bucket. phi deals the vectors out evenly.

Only distinct fingerprints are dealt into buckets (copies share one). A bucket of more than `most` fingerprints is split by the bits outside
its mask: all positions are dealt into radius + 1 classes, a linked pair agrees on one of them, so the pair meets in a bucket of the mask with
that class added; this repeats with other classes. In a bucket, pairs are compared in blocks of numpy arrays and only a spanning
forest of its links leaves. Components come from alternating large-star and small-star steps, with a checkpoint each.

Results: a null text has no words. A null doc_id takes part in no component: its component_id is null, and its fingerprint is given. Rows that
repeat stay rows. An empty table gives an empty result. Very long texts are read whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import checkpoint

BITS = 64


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """Of a UTF-8 text whose A-Z are lower-cased."""
    words = data.split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        h = np.array([digest(b" ".join(words), seed)], np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (a signed long holding the 64 bits); no shuffle."""

    def per_slice(ids, data, offsets):
        low = tx.LOWER[np.frombuffer(data, np.uint8)].tobytes()
        fps = [fingerprint(low[a:b], width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return [tx.plain_ids(ids), np.array(fps, np.uint64).view(np.int64)]

    return tx.map_documents(docs, per_slice, "doc_id bigint, fp bigint", 1 << 20)


def masks(radius: int) -> list[int]:
    """The covering masks: position i has the vector 1 + i mod (2^(radius+1) - 1)."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if bin((1 + i % n) & v).count("1") % 2) for v in range(1, n + 1)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n-1 under the links a-b, the least node of each one's component."""
    root = np.arange(n)
    while True:
        before = root
        root = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, before[a], least)
        np.minimum.at(root, before[b], least)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return root


def links_within(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (star edges) of the links inside each group; rows are sorted by group, fps within a group are distinct."""
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(group)))
    left = np.repeat(begin + size, size) - np.arange(len(group))  # rows from this one to its group's end
    root = np.arange(len(group))
    a, b, waiting = [], [], 0
    live = np.arange(len(group))
    for d in range(1, int(size.max(initial=0))):
        live = live[left[live] > d]
        i = live[root[live] != root[live + d]]
        i = i[np.bitwise_count((fps[i] ^ fps[i + d]).view(np.uint64)) <= radius]
        a.append(i)
        b.append(i + d)
        waiting += len(i)
        if waiting > len(group):  # joins what is known, so that links inside a component are not gathered again
            root = _roots(len(group), np.concatenate([*a, np.arange(len(group))]), np.concatenate([*b, root]))
            a, b, waiting = [], [], 0
    if a:
        root = _roots(len(group), np.concatenate([*a, np.arange(len(group))]), np.concatenate([*b, root]))
    tied = np.flatnonzero(root != np.arange(len(group)))
    return fps[tied], fps[root[tied]]


def _linker(radius: int):
    """mapInArrow over (key, fp) sorted by key: links within each key's bucket. The last bucket of a batch waits for the next batch."""

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(k, f):
            x, y = links_within(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if cut:
                yield out(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
        if len(held_k):
            yield out(held_k, held_f)

    return run


def _long(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _classes(level: int, parts: int) -> list[int]:
    """All bit positions dealt into `parts` classes, another way at each level."""
    deal = np.random.default_rng(level).permutation(BITS) % parts
    return [sum(1 << i for i in range(BITS) if deal[i] == j) for j in range(parts)]


def candidate_links(distinct: DataFrame, radius: int = 3, most: int = 2048, levels: int = 12) -> DataFrame:
    """Links a-b between distinct fingerprints (column fp), a forest per bucket.

    Buckets of up to `most` are compared; the rows of larger ones go on to finer masks (a look at the counts per level, no data leaves
    the executors). After `levels` levels whatever is left is compared as it is, so no link is lost."""
    rows = distinct.select("fp", F.explode(F.array(*map(_long, masks(radius)))).alias("m"))
    found = None
    for level in range(levels + 1):
        keyed = rows.withColumn("key", F.xxhash64("m", F.col("fp").bitwiseAND(F.col("m"))))
        light, hot = keyed, 0
        if level < levels:
            heavy = checkpoint(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"))
            hot = heavy.count()
        if hot:
            light = keyed.join(heavy, "key", "left_anti")
        part = light.select("key", "fp").repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInArrow(_linker(radius), "a bigint, b bigint")
        found = part if found is None else found.unionByName(part)
        if not hot:
            return found
        finer = F.array(*[F.col("m").bitwiseOR(_long(c)) for c in _classes(level, radius + 1)])
        rows = checkpoint(keyed.join(heavy, "key", "left_semi").select("fp", "m").distinct()).select("fp", F.explode(finer).alias("m")).distinct()
    return found


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of each component of the links (columns a, b), by large-star and small-star steps until nothing changes.

    Each pair of steps only lowers the numbers that edges lead to, so it ends; in practice the rounds grow with the logarithm of the longest
    path. A step keeps an edge per node and neighbour at most; hot nodes only take part in minima (pre-aggregated) and equi-joins that AQE splits."""
    # The signed order of the longs is an order like any other.
    edges = checkpoint(links.where("a <> b").distinct())
    if not edges.head(1):
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each node ties its smaller neighbours, and itself, to the least of them.
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        joined = low.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpoint(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("shiftright(xxhash64(b, a), 20)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


#: Fingerprints of more than this share of the documents are few by count, so their labels are broadcast.
FEW = 100_000


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its component)."""
    prints = checkpoint(fingerprints(docs, width))
    least = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    tied = components(candidate_links(least, radius))
    # Per component the smallest id, then back to its fingerprints, then to the documents; only linked fingerprints take this way.
    members = tied.union(tied.select("root", "root")).distinct()
    named = members.join(least.withColumnRenamed("fp", "node"), "node")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select(F.col("node").alias("fp"), "component")
    label = checkpoint(least.join(named, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component")))
    # A fingerprint that many documents share would bring them all to one task. Those of over n / FEW documents are fewer than FEW, whatever n is.
    most = max(64, prints.count() // FEW)
    heavy = F.broadcast(label.where(F.col("n") > most).select("fp", F.lit(True).alias("heavy"), F.col("component").alias("known")))
    marked = prints.join(heavy, "fp", "left")
    light = marked.where("heavy is null").select("fp", "doc_id").join(label.where(F.col("n") <= most), "fp").select("fp", "doc_id", "component")
    found = marked.where("heavy").select("fp", "doc_id", F.col("known").alias("component")).unionByName(light)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
