"""Near-duplicates by Jaccard similarity of word shingles: MinHash bands propose pairs, each pair is verified on its whole shingle sets.

A document's set holds the hashes of each run of `width` words, A-Z lower-cased (a shorter text is one shingle; texts without words are
equal). Pairs are proposed by SimHash: the fingerprint of a set has 64 bits, and all sets whose fingerprints differ in at most `radius` bits share a key of the
covering masks of `simhash`. That finds the closer pairs only: those of similarity 0.8 differ in some 10 bits, and a covering search of radius r needs
2^(r+1) - 1 keys. For the rest there are `bands` keys of `rows` minima each, which meet with probability 1 - (1 - s^rows)^bands: 0.9996 at s = 0.8.

Equal sets are one node, named by a 64-bit digest, so copies cost nothing further. The nodes that share a key with another one are a
bucket; each gets its set once (six bytes a shingle), and all pairs of the bucket are verified but for those whose sizes alone rule out the
similarity (an exact bound) or that other links have joined. Only links that join components leave. A bucket too large for a task
(`most_nodes`, `most_bytes`) is cut into blocks, and each pair of blocks is a task; no candidate pair is left out. Rows grow in proportion to
the nodes; the comparisons in a bucket of many texts that are not similar enough grow with the square of their number.

Results of `one_of_each`: a null text has no words. Rows with a null doc_id take no part and all stay. Of rows that repeat an id one stays, the
one of smallest hash. An empty table gives no row. Very long texts are compared whole. Further columns are passed on, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import checkpoint, written
from .simhash import BITS, components, masks


def shingle_sets(data, offsets, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents of a run, sorted in each, and where each document's begin (one more entry at the end)."""
    buf = tx.LOWER[np.frombuffer(data, np.uint8)]
    starts, ends, first = tx.words(buf, offsets)
    h = tx.range_hashes(buf, starts, ends)
    n = np.diff(first)
    at = tx.window_starts(first, width) if len(h) else np.zeros(0, np.int64)
    doc, s = [tx.owner(first)[at]], [tx.window_hashes(h, width)[at] if len(at) else np.zeros(0, np.uint64)]
    for d in np.flatnonzero(n < width):
        doc.append(np.array([d]))
        s.append(tx.window_hashes(h[first[d] : first[d + 1]], int(n[d])) if n[d] else np.zeros(1, np.uint64))
    doc, s = np.concatenate(doc), np.concatenate(s)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    return s[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def digests(s: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set."""
    sums = np.add.reduceat(tx.mix(s ^ np.uint64(0x5851F42D4C957F2D)), edges[:-1])
    return tx.mix(sums + np.diff(edges).astype(np.uint64)).view(np.int64)


def band_keys(s: np.ndarray, edges: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(document, band): a hash of the band's minima."""
    rng = np.random.default_rng(17)
    out = np.zeros((len(edges) - 1, bands), np.uint64)
    for b in range(bands):
        key = np.full(len(edges) - 1, b + 1, np.uint64)
        for _ in range(rows):
            flip, by = (np.uint64(x) for x in rng.integers(1, 1 << 63, 2))
            x = (s ^ flip) * (by | np.uint64(1))
            key = tx.mix(key ^ np.minimum.reduceat(x ^ (x >> np.uint64(32)), edges[:-1]))
        out[:, b] = key
    return out.view(np.int64)


def fingerprints(s: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The SimHash of each set: a bit is 1 if it is set in over half of the set's hashes."""
    x, n = tx.mix(s ^ np.uint64(0x9E3779B97F4A7C15)), np.diff(edges)
    out = np.zeros(len(n), np.uint64)
    for b in range(BITS):
        ones = np.add.reduceat((x >> np.uint64(b) & np.uint64(1)).astype(np.int64), edges[:-1])
        out |= (2 * ones > n).astype(np.uint64) << np.uint64(b)
    return out


def covering_keys(fps: np.ndarray, radius: int) -> np.ndarray:
    """(document, mask): a hash of the bits of the fingerprint in each covering mask."""
    out = np.zeros((len(fps), (2 << radius) - 1), np.uint64)
    for k, m in enumerate(masks(radius)):
        out[:, k] = tx.mix((fps & np.uint64(m)) ^ tx.mix(np.full(1, k + 1, np.uint64) << np.uint64(32)))
    return out.view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int, rows: int, radius: int = 3) -> DataFrame:
    """doc_id, node, size of the set, and the keys of each document, of its fingerprint and of bands; no shuffle."""

    def per_slice(ids, data, offsets):
        s, edges = shingle_sets(data, offsets, width)
        keys = np.concatenate([covering_keys(fingerprints(s, edges), radius), band_keys(s, edges, bands, rows)], axis=1)
        return [tx.plain_ids(ids), digests(s, edges), np.diff(edges), list(keys)]

    return tx.map_documents(docs, per_slice, "doc_id bigint, node bigint, size bigint, keys array<bigint>")


def packed(s: np.ndarray) -> np.ndarray:
    """The low six bytes of each hash. They tell shingles of two sets of n apart but for n^2 / 2^48 on average."""
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def unpacked(data) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").reshape(-1)


def node_sets(docs: DataFrame, width: int) -> DataFrame:
    """node and its packed set; no shuffle."""

    def per_slice(ids, data, offsets):
        s, edges = shingle_sets(data, offsets, width)
        six = packed(s)
        return [digests(s, edges), [six[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]]

    return tx.map_documents(docs, per_slice, "node bigint, shingles binary", 1 << 19)


def _in_buckets(fn, names: list[str]):
    """mapInArrow over rows sorted by key (the first column): fn gets the rows of whole buckets. The last bucket of a batch waits."""

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in fn(held.slice(0, cut))], names)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in fn(held)], names)

    return run


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _verifier(similarity: float):
    """All pairs of a bucket (or between two blocks of one) on their whole sets; only the links that join components leave."""

    def bucket(node, size, block, sets):
        edges = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(int(flat.max()) + 1, np.int32)
        comp, two = np.arange(len(node)), block.min() != block.max()
        for i in range(len(node) - 1):
            to = int(np.searchsorted(size, size[i] / similarity + 1e-6, "right"))  # sizes grow; larger sets cannot be as similar
            rest = slice(i + 1, to)
            if to <= i + 1 or not ((comp[rest] != comp[i]) & ((block[rest] != block[i]) | (not two))).any():
                continue
            own = flat[edges[i] : edges[i + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat[edges[i + 1] : edges[to]]], edges[rest] - edges[i + 1])
            mark[own] = 0
            for j in np.flatnonzero((both * (1 + similarity) >= similarity * (size[i] + size[rest]) - 1e-9) & ((block[rest] != block[i]) | (not two))) + i + 1:
                if comp[i] != comp[j]:
                    yield min(node[i], node[j]), max(node[i], node[j])
                    comp[comp == comp[j]] = comp[i]

    def pairs(table):
        key, node, size, block = (table.column(i).to_numpy() for i in range(4))
        shingles = table.column(4).combine_chunks()
        begin = np.append(_starts(key), len(key))
        found = [x for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True) for x in bucket(node[a:b], size[a:b], block[a:b], [unpacked(shingles[k].as_buffer()) for k in range(a, b)])]
        return [x for x, _ in found], [y for _, y in found]

    return pairs


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df (of narrow rows) with a broadcast hint if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node and its set for the wanted nodes; only their documents are read."""
    wanted = checkpoint(nodes.select("node", "doc_id").join(wanted, "node", "left_semi"))
    texts = docs.select("doc_id", "text").join(small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    # An id may stand on several texts; the digest tells which one is meant.
    return written(node_sets(texts, width).join(small(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]))


def links(docs: DataFrame, nodes: DataFrame, width: int, similarity: float, most_nodes: int = 1024, most_bytes: int = 1 << 24) -> DataFrame:
    """Verified links a-b between nodes; every pair of a bucket is linked, verified and refused, or in one component with others' links."""
    rows = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    cut = F.ceil(F.greatest(F.col("n") / most_nodes, 6 * F.col("total") / most_bytes)).cast("int")
    rows = checkpoint(rows.join(shared.select("key", cut.alias("blocks")), "key").select("key", "node", "size", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    # A node of a bucket of several blocks goes to each pair of blocks that has its own.
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).alias("key"), "node", "size", "block")
    sets = sets_of(rows.select("node").distinct(), docs, nodes, width)
    ready = dealt.join(sets, "node").select("key", "node", "size", "block", "shingles").repartition(F.col("key")).sortWithinPartitions("key", "size", "node")
    return ready.mapInArrow(_in_buckets(_verifier(similarity), ["a", "b"]), "a bigint, b bigint").distinct()


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; of rows that repeat an id, one. Rows without an id all stay."""
    named = docs.where("doc_id is not null")
    sketched = written(sketches(named, width, bands, rows))
    nodes = checkpoint(sketched.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    tied = components(links(named, nodes, width, similarity))
    # components() names each node but the roots.
    tied = tied.union(tied.select("root", "root")).distinct()
    ids = checkpoint(nodes.select("node", "doc_id").join(tied, "node", "left").withColumn("root", F.coalesce("root", "node")))
    kept = ids.groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    all_ids = sketched.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    gone = checkpoint(all_ids.select("doc_id").join(kept, "doc_id", "left_anti"))
    left = named.join(small(gone), "doc_id", "left_anti")
    every_column = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    again = checkpoint(all_ids.where("n > 1").select("doc_id").join(gone, "doc_id", "left_anti"))
    if again.head(1):
        every = F.struct(*every_column)
        one = left.join(small(again), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(every, F.xxhash64(F.to_json(every))).alias("_row")).select("_row.*")
        left = left.join(small(again), "doc_id", "left_anti").select(*every_column).unionByName(one)
    return left.select(*every_column).unionByName(docs.where("doc_id is null"))
