"""Language-model scores by deleted interpolation of trigram, bigram, unigram and uniform estimates.

Tokens are the words, A-Z lower-cased, and an end after each text. With counts c over all training documents (crc32 of the id modulo 7
is not 2), N tokens and V distinct ones:
    p(w | u v) = l3 c(u v w) / c(u v) + l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1)
Weights l are chosen by the buckets of the contexts' counts: floor(log2 c(u v)) and floor(log2 c(v)), each with a bucket for none.
They come from expectation-maximisation on held-out counts: each event of the deleted part (training documents whose remainder is 3)
is scored with itself taken out of the counts. Those events are binned by the ratios of the estimates (half powers of two) in a
table of bounded size that is summed in Spark, so the fit reads all of them and the driver gets numbers of cells only.

All counts are of the whole corpus: each chunk of documents asks for its distinct words, pairs and triples through `exchange`, which adds up
the chunks' training counts. Replies are kept in the shared folder; no vocabulary is ever in one place. Words have hashes of 64 bits, pairs
and triples of as many as the size of the corpus calls for (`dropped`), so that less than one in a million shares a count with another.

Results: a null text is an empty one, so just the end token. A null doc_id hashes as an empty text. Repeated rows are counted and scored each.
An empty table gives no row. Very long texts are read whole, and columns other than doc_id and text are not read.
Without training documents every word is unknown and the score is that of the uniform part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import text as tx
from .shared import written

FOLDS, TEST, DELETED = 7, 2, 3
#: Buckets of the counts of both contexts, steps of the ratios for a factor of two, and bins of a ratio.
PAIR_BUCKETS, WORD_BUCKETS, STEPS, TOP = 10, 12, 2, 80
END, BEGIN = np.uint64(0x51A7F0D2B3C49E11), np.uint64(0x0F3C5D7E91B2A486)
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def dropped(total_bytes: int) -> int:
    """Low bits of a pair's or triple's hash that are not kept: what is left is 20 bits over the logarithm of the number of tokens."""
    return min(16, max(0, 64 - 20 - int(total_bytes / 6 + 1).bit_length()))


def _previous(x: np.ndarray, edge: np.ndarray, first) -> np.ndarray:
    """The value of the token before in the same document; `first` for a document's first token."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[edge[:-1]] = first
    return out


def _events(table: pa.Table, drop: int):
    """For each run of documents: ids, folds, copies, the hashes of each token, of it with one and with two tokens before it, first tokens."""
    table = table.combine_chunks()
    if not table.num_rows:
        return
    copies, at, cut = table["copies"].to_numpy(), 0, np.uint64(drop)
    for ids, data, offsets in tx.slices(table["doc_id"].chunk(0), table["text"].chunk(0)):
        buf = tx.LOWER[np.frombuffer(data, np.uint8)]
        starts, ends, first = tx.words(buf, offsets)
        h = tx.range_hashes(buf, starts, ends)
        edge = np.concatenate([[0], np.cumsum(np.diff(first) + 1)])
        token = np.empty(int(edge[-1]), np.uint64)
        is_end = np.zeros(len(token), bool)
        is_end[edge[1:] - 1] = True
        token[~is_end], token[is_end] = h, END
        pair = tx.mix(_previous(token, edge, BEGIN) * np.uint64(0x9FB21C651E98DF25) ^ token)
        triple = tx.mix(_previous(pair, edge, BEGIN) * np.uint64(0xE7037ED1A0B428DB) ^ token)
        yield ids, tx.fold(ids, FOLDS), copies[at : at + len(ids)], (token, pair >> cut << cut, triple >> cut << cut), edge
        at += len(ids)


def _counted(hashes: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sum of weights of each."""
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, w = np.concatenate(hashes), np.concatenate(weights)
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[starts], np.add.reduceat(w[order], starts)


def _keys(table: pa.Table, drop: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct words, pairs and triples of a chunk with their training counts. Runs are counted one by one first, to bound the memory."""
    found: list[tuple[list, list]] = [([], []) for _ in range(3)]
    for _, folds, copies, grams, edge in _events(table, drop):
        train = np.repeat(np.where(folds != TEST, copies, 0).astype(np.int64), np.diff(edge))
        for (h, w), x in zip(found, grams, strict=True):
            a, b = _counted([x], [train])
            h.append(a)
            w.append(b)
    return [_counted(*x) for x in found]


def _bucket(c: np.ndarray, most: int) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.frexp(np.maximum(c, 1).astype(np.float64))[1], most - 1), 0)


def buckets(c2: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """One number for the buckets of the counts of a pair and a word as contexts."""
    return _bucket(c2, PAIR_BUCKETS) * WORD_BUCKETS + _bucket(c1, WORD_BUCKETS)


def estimates(n3, n2, n1, c2, c1, n_train: int):
    """Maximum-likelihood estimates of order 3, 2 and 1; 0 where the context was never seen."""
    return np.where(c2 > 0, n3 / np.maximum(c2, 1), 0.0), np.where(c1 > 0, n2 / np.maximum(c1, 1), 0.0), n1 / max(n_train, 1)


def cells(bucket, p3, p2, p1, p0) -> np.ndarray:
    """One number for a bucket and the ratios of three estimates to p0; ratio 0 has a bin of its own."""

    def bins(p):
        return np.where(p > 0, np.clip(np.rint(np.log2(np.maximum(p, 1e-300) / p0) * STEPS) + 20, 1, TOP - 1), 0).astype(np.int64)

    return ((bucket * TOP + bins(p3)) * TOP + bins(p2)) * TOP + bins(p1)


def fit_weights(cell: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """EM for the weights (l3, l2, l1, l0) of each bucket from binned held-out events. A context that was never seen has no weight."""
    n = PAIR_BUCKETS * WORD_BUCKETS
    open_ = np.ones((n, 4))
    open_[: WORD_BUCKETS, 0] = 0
    open_[::WORD_BUCKETS, :2] = 0
    start = open_ * [0.3, 0.3, 0.3, 0.1]
    start /= start.sum(1, keepdims=True)
    weights, bucket = start.copy(), cell // TOP**3
    ratio = lambda k: np.where(k > 0, 2.0 ** ((k - 20.0) / STEPS), 0.0)
    terms = np.column_stack([ratio(cell // TOP**2 % TOP), ratio(cell // TOP % TOP), ratio(cell % TOP), np.ones(len(cell))])
    for _ in range(rounds):
        part = weights[bucket] * terms
        part *= (counts / part.sum(1))[:, None]
        for k in range(4):
            weights[:, k] = np.bincount(bucket, part[:, k], n) + 0.5 * start[:, k]  # half an event of prior keeps empty buckets as they were
        weights /= weights.sum(1, keepdims=True)
    return weights


def score(docs: DataFrame) -> DataFrame:
    """One row per document: contract columns; score is the model's log10 probability of the text and its end."""
    n_chunks, bits = ex.sizes(docs, chunk_mb=(8, 32))
    drop = dropped(docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)
    rows, restore = ex.without_hot(docs)
    n_deleted = max(48, n_chunks // FOLDS)
    fold = F.expr(f"crc32(encode(coalesce(cast(doc_id as string), ''), 'utf-8')) % {FOLDS}")
    # The deleted part has chunks of its own, so that its statistics read no other documents.
    chunk = F.when(fold == DELETED, F.pmod(ex.spread(), F.lit(n_deleted))).otherwise(F.pmod(ex.spread(), F.lit(n_chunks)) + n_deleted).cast("int")
    dealt = rows.withColumn("chunk", chunk)

    def ask(key, table: pa.Table) -> pa.Table:
        return pa.concat_tables([ex.requests(key[0].as_py(), *k, bits, tag, drop if tag else 0) for tag, k in enumerate(_keys(table, drop))])

    def total(starts, sizes, counts):
        return np.repeat(np.add.reduceat(counts, starts), sizes)

    requests = dealt.groupBy("chunk").applyInArrow(ex.typed(ask, "table"), ex.REQUEST)
    replies = written(ex.answer(requests, bits, total, sums_below=1 << bits, drops=(0, drop, drop)))
    sums = replies.where("chunk < 0").agg(F.sum("total").alias("n"), F.sum("positive").alias("v")).first()
    n_train, v_train = int(sums["n"] or 0), int(sums["v"] or 0)
    replies = replies.where("chunk >= 0").select("chunk", "bucket", "vals")
    p0 = 1 / (v_train + 1)

    def counted(table: pa.Table, answers: pa.Table):
        """The events of a chunk with counts of triple, pair and word, and of the pair and the word before."""
        keys = [k for k, _ in _keys(table, drop)]
        found = [ex.gathered(answers, k, bits, tag) for tag, k in enumerate(keys)]
        at = np.searchsorted(keys[0], END)
        texts = int(found[0][at]) if at < len(keys[0]) and keys[0][at] == END else 0  # as many beginnings as ends
        for ids, folds, copies, grams, edge in _events(table, drop):
            n1, n2, n3 = (c[np.searchsorted(k, g)] for c, k, g in zip(found, keys, grams, strict=True))
            yield ids, folds, copies, n3, n2, n1, _previous(n2, edge, texts), _previous(n1, edge, texts), edge

    def held_out(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        seen: dict = {}
        for _, _, copies, n3, n2, n1, c2, c1, edge in counted(table, answers):
            found = cells(buckets(c2 - 1, c1 - 1), *estimates(n3 - 1, n2 - 1, n1 - 1, c2 - 1, c1 - 1, n_train - 1), p0)
            cell, where = np.unique(found, return_inverse=True)
            for c, n in zip(cell.tolist(), np.bincount(where, np.repeat(copies, np.diff(edge))).tolist(), strict=True):
                seen[c] = seen.get(c, 0) + int(n)
        return pa.table([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["cell", "n"])

    deleted = dealt.where(fold == DELETED).groupBy("chunk").cogroup(replies.where(F.col("chunk") < n_deleted).groupBy("chunk"))
    table = deleted.applyInArrow(ex.typed(held_out, "table", "answers"), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    weights = fit_weights(table["cell"].to_numpy(), table["n"].to_numpy())
    if not n_train:
        weights[:] = [0, 0, 0, 1]

    def scored(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        parts, at, hot = [], 0, table["hot"].combine_chunks()
        for ids, folds, _, n3, n2, n1, c2, c1, edge in counted(table, answers):
            w = weights[buckets(c2, c1)]
            p = sum(w[:, k] * e for k, e in enumerate(estimates(n3, n2, n1, c2, c1, n_train))) + w[:, 3] * p0
            base = np.log10((n1 + 1) / (n_train + v_train + 1))
            each = [np.add.reduceat(x, edge[:-1]) for x in ((n1 > 0).astype(np.int64), base, np.log10(p))]
            parts.append(pa.table([
                pa.array(tx.plain_ids(ids), pa.int64()), pa.array(folds == TEST), pa.array(np.diff(edge), pa.int64()), pa.array(each[0], pa.int64()),
                pa.array(np.full(len(ids), n_train), pa.int64()), pa.array(each[1]), pa.array(each[2]), pa.array(hot[at : at + len(ids)].to_pylist(), pa.int64()),
            ], [*NAMES, "hot"]))
            at += len(ids)
        return pa.concat_tables(parts)

    return restore(dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(ex.typed(scored, "table", "answers"), SCHEMA + ", hot bigint"))
