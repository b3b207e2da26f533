"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

Score of a document with features x (each hash bucket's share of the words, then standardised statistics):
    sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])
The pairwise part takes linear time (sum-of-squares identity) over the distinct buckets of a document. Training is Adam on the log loss, with
numpy on the driver, over at most `max_train` labelled rows (those of smallest hash of doc_id, so a bounded and reproducible sample). Their
features, not their texts, reach the driver: at most 2^bits numbers a row. Scoring runs in the executors over all rows and whole texts. The
model has (buckets + statistics) * (rank + 1) floats, whatever the corpus.

Labels, lang, source and doc_id are no inputs of a score. A null text is an empty one: it has all-zero words and gets a score.
A null label or doc_id trains nothing; of labels that repeat an id the highest counts. Without labels of both kinds every score is the share
of label 1 (0.5 if there are none), so empty tables train and score without a special case. Repeated rows are scored one by one, very long
texts whole. Columns other than doc_id and text are not read for a score; `keep` passes them on under whatever names they have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .quality_rules import MARKS, SHOUTS, SYMBOLS, closes

N_STATS = 14
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def statistics(buf, offsets, starts, ends, first) -> np.ndarray:
    """Structure of each document (shares, and logarithms of sizes as metadata), a row each."""
    n = len(offsets) - 1
    words = np.maximum(np.diff(first), 1)
    size = np.maximum(np.diff(offsets), 1)

    def by_byte(flags):
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    by_word = lambda flags: tx.per_document(flags.astype(np.int64), first)
    last, before, length = buf[ends - 1], buf[np.maximum(ends - 2, 0)], ends - starts
    doc = tx.owner(first)
    h = tx.range_hashes(buf, starts, ends)
    keys = np.unique(tx.mix(h ^ tx.mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
    distinct = np.bincount(doc[keys], minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    breaks = buf == 10
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(breaks[:-1]) + 1 if len(buf) else []])).astype(np.int64)
    of = np.searchsorted(offsets, begin, "right") - 1
    line = tx.mix(tx.range_hashes(buf, begin, np.append(begin[1:], len(buf))[: len(begin)]) ^ tx.mix(of.astype(np.uint64) + np.uint64(1)))
    lines = np.maximum(np.bincount(of, minlength=n), 1)
    unique_lines = np.bincount(of[np.unique(line, return_index=True)[1]], minlength=n)
    return np.column_stack([
        by_byte(SYMBOLS[buf]) / size,
        by_byte((buf >= 65) & (buf <= 90)) / size,
        by_byte((buf >= 48) & (buf <= 57)) / size,
        by_word((length == 1) & ((last == 124) | (last == 62))) / words,
        by_word((length > 1) & MARKS[last] & MARKS[before]) / words,
        by_word((length > 1) & SHOUTS[last] & SHOUTS[before]) / words,
        by_word(closes(buf, ends)) / words,
        by_word(again) / words,
        distinct / words,
        unique_lines / lines,
        by_word(length) / words / 10,
        np.log1p(np.diff(first)) / 5,
        np.log1p(lines) / 5,
        by_byte(buf >= 128) / size,
    ])


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bits: int

    def logits(self, buf, offsets) -> np.ndarray:
        bucket, x, first, stats = features(buf, offsets, self.bits)
        return forward(self, bucket, x, first, np.clip((stats - self.mean) / self.scale, -5, 5))[0]


def features(buf, offsets, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each document in order, each one's share of the words, where a document's begin, and its statistics."""
    starts, ends, first = tx.words(buf, offsets)
    index = (tx.range_hashes(buf, starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
    key, count = np.unique((tx.owner(first) << bits) + index, return_counts=True)
    doc = key >> bits
    return key & ((1 << bits) - 1), count / np.diff(first)[doc], np.searchsorted(doc, np.arange(len(offsets))), statistics(buf, offsets, starts, ends, first)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out


def forward(m: Machine, bucket, x, first, stats) -> tuple[np.ndarray, np.ndarray]:
    """Logit of each document, and its sums over features of v x."""
    n_words = 1 << m.bits
    vx = m.v[bucket] * x[:, None]
    s = _sums(vx, first) + stats @ m.v[n_words:]
    q = _sums(vx**2, first) + (stats**2) @ (m.v[n_words:] ** 2)
    return m.bias + _sums(m.w[bucket] * x, first) + stats @ m.w[n_words:] + 0.5 * (s**2 - q).sum(1), s


def gradients(m: Machine, bucket, x, first, stats, g) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the sum of g times the logits, by w, v and the bias: dz/dw_i = x_i, dz/dv_if = x_i (s_f - v_if x_i)."""
    s, n_words = forward(m, bucket, x, first, stats)[1], 1 << m.bits
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    gw, gv = np.zeros_like(m.w), np.zeros_like(m.v)
    gx = g[of] * x
    gw[:n_words], gw[n_words:] = np.bincount(bucket, gx, n_words), g @ stats
    for k in range(m.v.shape[1]):
        gv[:n_words, k] = np.bincount(bucket, gx * (s[of, k] - m.v[bucket, k] * x), n_words)
    gv[n_words:] = stats.T @ (g[:, None] * s) - m.v[n_words:] * ((stats**2).T @ g)[:, None]
    return gw, gv, float(g.sum())


def train_on(bucket, x, first, stats, labels, bits: int = 12, rank: int = 4, epochs: int = 12, seed: int = 7) -> Machine:
    """Adam on the log loss with an L2 pull on all weights. Features as from `features`."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    size = (1 << bits) + N_STATS
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)), np.zeros(N_STATS), np.ones(N_STATS), bits)
    if len(set(y.tolist())) < 2:
        rate = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        m.v[:] = 0
        m.bias = float(np.log(rate / (1 - rate)))
        return m
    m.mean, m.scale = stats.mean(0), stats.std(0) + 1e-3
    stats = np.clip((stats - m.mean) / m.scale, -5, 5)
    moments = [[0.0, 0.0] for _ in range(3)]
    step = 0
    # Label 0 weighs as much as label 1 in sum, within a factor of four either way, so that the rare one is learned.
    odds = y.mean() / (1 - y.mean())
    weight = np.where(y == 1, 1.0, np.clip(odds, 0.25, 4.0))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            rows = np.sort(order[at : at + 256])
            lengths = first[rows + 1] - first[rows]
            f = np.concatenate([[0], np.cumsum(lengths)])
            where = np.repeat(first[rows] - f[:-1], lengths) + np.arange(f[-1])
            z = forward(m, bucket[where], x[where], f, stats[rows])[0]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            gw, gv, gb = gradients(m, bucket[where], x[where], f, stats[rows], g)
            gw += 1e-4 * m.w
            gv += 1e-4 * m.v
            step += 1
            for k, (value, grad) in enumerate(((m.w, gw), (m.v, gv), (None, gb))):
                a, b = moments[k]
                a, b = 0.9 * a + 0.1 * grad, 0.99 * b + 0.01 * grad * grad
                moments[k] = [a, b]
                move = 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
                if value is None:
                    m.bias -= float(move)
                else:
                    value -= move
    return m


def train(texts: list[str], labels: list[int], bits: int = 12, **options) -> Machine:
    """Of texts at hand."""
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    return train_on(*features(buf, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), bits), labels, bits, **options)


def labelled(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """At most max_train rows (doc_id, text, label) outside the held-out fold, by smallest hash of the id, then of the text."""
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.where(F.expr("doc_id is not null and crc32(cast(doc_id as string)) % 5 != 0"))
    # Ids are limited before they meet the texts, so no more than max_train of them are looked up.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_train)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 4000, bits: int = 12, **options) -> Machine:
    """max_train bounds the rows whose features reach the driver."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            at = 0
            for _, data, offsets in tx.slices(batch.column(0), batch.column(1)):
                bucket, x, first, stats = features(np.frombuffer(data, np.uint8), offsets, bits)
                cut = lambda v, f=first: [v[a:b] for a, b in zip(f[:-1].tolist(), f[1:].tolist(), strict=True)]
                n = len(first) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + n], batch.column(2)[at : at + n].cast(pa.float64()), pa.array(cut(bucket), pa.list_(pa.int64())), pa.array(cut(x), pa.list_(pa.float64())), pa.array(list(stats), pa.list_(pa.float64()))], ["doc_id", "label", "bucket", "x", "stats"])
                at += n

    found = labelled(docs, labels, max_train).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(run, "doc_id bigint, label double, bucket array<bigint>, x array<double>, stats array<double>")
    # Sorted, so that the order in which partitions arrive doesn't matter.
    rows = sorted(found.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["bucket"], r["x"]))
    flat = lambda name: np.concatenate([np.asarray(r[name], np.float64) for r in rows]) if rows else np.zeros(0)
    first = np.concatenate([[0], np.cumsum([len(r["bucket"]) for r in rows])]).astype(np.int64)
    return train_on(flat("bucket").astype(np.int64), flat("x"), first, flat("stats").reshape(-1, N_STATS), [int(r["label"]) for r in rows], bits, **options)


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; no shuffle. The model travels with the task (its size is fixed)."""

    def per_slice(ids, data, offsets):
        z = machine.logits(np.frombuffer(data, np.uint8), offsets)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return [tx.plain_ids(ids), tx.fold(ids, 5) == 0, p, (p >= threshold).astype(np.int64)]

    return tx.map_documents(docs, per_slice, SCHEMA)


def keep(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold.

    The verdict is computed beside the row (an Arrow UDF on the text), so no join on ids is needed and repeated or null ids are safe."""
    import pyarrow as pa
    from pyspark.sql.types import BooleanType

    from .shared import small_batches

    small_batches(docs.sparkSession)

    def verdict(texts: pa.Array) -> pa.Array:
        out = []
        for _, data, offsets in tx.slices(pa.array(np.arange(len(texts))), texts):
            z = machine.logits(np.frombuffer(data, np.uint8), offsets)
            out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))) >= threshold)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    verdict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.where(F.arrow_udf(verdict, BooleanType())("text"))
