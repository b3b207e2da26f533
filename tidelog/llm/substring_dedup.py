"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark; repeated windows merge into removal intervals.

Windows are hashed in chunks of documents; `exchange` tells each chunk, for each of its distinct window hashes, whether a document with
a smaller id outside the chunk holds it (inside the chunk it is seen at once). A word goes when any such window covers it: neighbouring
windows add up to maximal intervals. Windows are judged on the input texts.

Results: a null text has no words; a document shorter than a window loses nothing. A null doc_id counts as larger than every other.
Rows with equal ids are one another's equals: neither is smaller, so neither loses to the other. Repeated rows each get their row. An empty
table gives no row, very long texts are read whole, and columns other than doc_id and text are not read.
Hashes are polynomials modulo 2^61 - 1 of 64-bit word hashes: among n distinct windows about n^2 / 2^62 pairs collide by chance (0.004 in
1.4e8; some 200,000 in 1e12, so beyond that the width of the hash has to grow).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from . import text as tx

LAST = np.iinfo(np.int64).max
SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, intervals string"


def _ids(ids: np.ndarray) -> np.ndarray:
    return np.array([LAST if i is None else i for i in ids.tolist()], np.int64)


def _windows(table: pa.Table, width: int):
    """For each run of documents: ids, buffer, starts, ends, first words, window starts and their hashes."""
    table = table.combine_chunks()
    ids = table["doc_id"].chunk(0) if table["doc_id"].num_chunks else pa.array([], pa.int64())
    texts = table["text"].chunk(0) if table["text"].num_chunks else pa.array([], pa.string())
    for part, data, offsets in tx.slices(ids, texts):
        buf = np.frombuffer(data, np.uint8)
        starts, ends, first = tx.words(buf, offsets)
        at = tx.window_starts(first, width)
        h = tx.window_hashes(tx.range_hashes(buf, starts, ends), width)
        yield part, data, starts, ends, first, at, h[at] if len(h) else h


def _smallest(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the smallest id that holds each."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[starts], np.minimum.reduceat(ids[order], starts) if len(starts) else ids


def _chunk_keys(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [_smallest(h, _ids(part)[tx.owner(first)[at]]) for part, _, _, _, first, at, h in _windows(table, width)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _smallest(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def intervals_of(covered: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words, end exclusive."""
    steps = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True))


def remove_repeats(docs: DataFrame, width: int = 13, with_text: bool = False) -> DataFrame:
    """One row per document: word counts, digest of the kept words, removed intervals of words, and (with_text) the kept words."""
    n_chunks, bits = ex.sizes(docs)
    rows, restore = ex.without_hot(docs)
    dealt = rows.select("doc_id", "text", "hot", F.pmod(ex.spread(), F.lit(n_chunks)).cast("int").alias("chunk"))

    def ask(key, table: pa.Table) -> pa.Table:
        return ex.requests(key[0].as_py(), *_chunk_keys(table, width), bits)

    def beaten(starts, sizes, ids):
        return (np.repeat(np.minimum.reduceat(ids, starts), sizes) < ids).astype(np.int64)

    def remove(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        keys, least = _chunk_keys(table, width)
        outside = ex.gathered(replies, keys, bits).astype(bool)
        rows, hot = [], table["hot"].to_pylist()
        for part, data, starts, ends, first, at, h in _windows(table, width):
            ids = _ids(part)
            where = np.searchsorted(keys, h)
            gone = at[outside[where] | (least[where] < ids[tx.owner(first)[at]])]
            steps = np.zeros(len(starts) + 1, np.int64)
            np.add.at(steps, gone, 1)
            np.add.at(steps, gone + width, -1)
            covered = np.cumsum(steps[:-1]) > 0
            for d, doc in enumerate(tx.plain_ids(part)):
                lo, hi = first[d], first[d + 1]
                own = covered[lo:hi]
                kept = np.flatnonzero(~own) + lo
                text = b" ".join([bytes(data[s:e]) for s, e in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)])
                spans = ",".join(f"{a}:{b}" for a, b in intervals_of(own)) if own.any() else ""
                rows.append((doc, hi - lo, int(own.sum()), hashlib.sha256(text).hexdigest(), spans, hot[len(rows)]) + ((text.decode(),) if with_text else ()))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * with_text
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals", "hot"] + ["kept"] * with_text
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    requests = dealt.groupBy("chunk").applyInArrow(ex.typed(ask, "table"), ex.REQUEST)
    replies = ex.answer(requests, bits, beaten)
    return restore(dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(ex.typed(remove, "table", "replies"), SCHEMA + ", hot bigint" + (", kept string" if with_text else "")))


#: The same rows (without intervals) in DuckDB.
ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM s),
m AS (SELECT k, min(doc_id) AS d FROM h GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM h JOIN m USING (k) WHERE d < doc_id),
g AS (SELECT doc_id, list(p) AS ps FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE [x FOR x, j IN ws IF NOT list_contains(ps, j)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
