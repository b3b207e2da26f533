"""Phrase collocations by language: all 1- to max_n-grams become rows, are counted, scored by their weakest cut, and ranked.

A text is split into pieces at PIECE marks, a piece into words at spaces and tabs; A-Z are lower-cased. Every 1..max_n-gram of every piece
counts. A corpus has nearly as many distinct n-grams as words, and most of them occur once or twice, so an n-gram becomes a row (lang, n, phrase, f)
only if it can be frequent: the hashes of all n-grams are counted first, through the packed exchange, over the whole corpus, and those
under `least` are left out. They keep as many bits as tell most n-grams apart; equal ones only raise a count, so none that is frequent is lost. The
rows are then aggregated by their words. Parts of
a frequent phrase are at least as frequent as it, so the same table holds all prefix and suffix counts.

The rest is DataFrame work: cuts joined to the counts of both parts, scores in whole decimals, the anti-join against one-word extensions (whatever
lies between a phrase and a longer candidate is a candidate at least as frequent as the longer one, so one word is enough), and ranks. A language may
hold most candidates: scores below those of its first `top` are cut by a histogram, ties among them within 64 parts, before the last window.

Results: a null text is empty, a null lang is `und`; ids are not read, and rows that repeat count each time. No phrase of `least`, no row; an empty table
gives none. Very long texts are read whole. Ties in score and count are ranked by the phrase's bytes. Columns other than text and lang are
not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as ex
from . import text as tx
from .near_copies import small
from .shared import checkpoint, small_batches

#: Marks that end a piece, and what lies between words.
PIECE = np.zeros(256, bool)
PIECE[[ord(c) for c in ".,;:!?"]] = True
PIECE[10:14] = True
BETWEEN = PIECE.copy()
BETWEEN[[9, 32]] = True
#: A candidate is dropped if an extension has this share of its occurrences, in hundredths.
ABSORBED = 80
PARTS = 64
#: The screen's hashes have so many bits more than the logarithm of the bytes of all texts: one in some 2^SPARE n-grams meets another.
SPARE = 14


def grams(table: pa.Table, max_n: int):
    """For each run of documents: languages, buffer, word starts and ends, first words, copies of each document, and for each n (first word, hash) of all n-grams."""
    table, at = table.combine_chunks(), 0
    langs = table["doc_id"].chunk(0) if table["doc_id"].num_chunks else pa.array([], pa.string())
    texts = table["text"].chunk(0) if table["text"].num_chunks else pa.array([], pa.string())
    copies = table["copies"].to_numpy()
    for part, data, offsets in tx.slices(langs, texts):
        buf = tx.LOWER[np.frombuffer(data, np.uint8)]
        starts, ends, first = tx.words(buf, offsets, BETWEEN)
        doc, marks = tx.owner(first), np.concatenate([[0], np.cumsum(PIECE[buf])])
        h = tx.range_hashes(buf, starts, ends)
        joined = (doc[1:] == doc[:-1]) & (marks[starts[1:]] == marks[starts[:-1]])
        of_lang = {x: xxhash.xxh3_64_intdigest(x.encode()) for x in set(part)}
        seed = np.array([of_lang[x] for x in part], np.uint64)
        g, at_word, every = tx.mix(h ^ seed[doc]), np.arange(len(h)), []
        for n in range(1, max_n + 1):
            if n > 1:  # g: hashes of the n-grams at at_word; a longer one needs the next word in the same piece
                more = at_word + n - 1 < len(h)
                more[more] = joined[at_word[more] + n - 2]
                at_word, g = at_word[more], g[more]
                g = tx.mix(g * np.uint64(0x9E3779B97F4A7C15) + h[at_word + n - 1])
            every.append((at_word, g))
        yield part, buf, starts, ends, first, copies[at : at + len(part)], every
        at += len(part)


def _counted(g: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sum of their weights (or their number)."""
    if not len(g):
        return g, np.zeros(0, np.int64)
    if weights is None:
        g = np.sort(g)
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        return g[starts], np.diff(np.append(starts, len(g)))
    order = np.argsort(g, kind="stable")
    g, weights = g[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[starts], np.add.reduceat(weights, starts)


def chunk_keys(table: pa.Table, max_n: int, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes (their bits under the mask) of a chunk, sorted, and how often each occurs in it."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, _, _, first, copies, every in grams(table, max_n):
        doc = tx.owner(first)
        for at, g in every:
            k, c = _counted(g & mask, None if (copies == 1).all() else copies[doc[at]])
            keys.append(k)
            counts.append(c)
    return _counted(np.concatenate(keys), np.concatenate(counts))


def _among(g: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of g are among the sorted `wanted`; a bitmap of leading bits refuses most of them first."""
    if not len(wanted):
        return np.zeros(len(g), bool)
    top = np.zeros(1 << 22, bool)
    top[(wanted >> np.uint64(42)).astype(np.int64)] = True
    hit = top[(g >> np.uint64(42)).astype(np.int64)]
    some = np.flatnonzero(hit)
    where = np.minimum(np.searchsorted(wanted, g[some]), len(wanted) - 1)
    hit[some] = wanted[where] == g[some]
    return hit


def frequent(docs: DataFrame, max_n: int, least: int) -> DataFrame:
    """lang, n, phrase and f of all 1..max_n-grams that occur `least` times or more in their language; n = 0 has a language's number of words."""
    small_batches(docs.sparkSession)
    # Languages take the place of ids: equal rows of a language that would fill a chunk stand once, with their number.
    named = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n_chunks, bits = ex.sizes(named, chunk_mb=(2, 16))
    drop = max(0, 64 - SPARE - int(named.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0).bit_length())
    mask = ~np.uint64((1 << drop) - 1)
    rows, _ = ex.without_hot(named)
    dealt = rows.select("doc_id", "text", "copies", F.pmod(ex.spread(), F.lit(n_chunks)).cast("int").alias("chunk"))

    def ask(key, table: pa.Table) -> pa.Table:
        return ex.requests(key[0].as_py(), *chunk_keys(table, max_n, mask), bits, drop=drop)

    def enough(starts, sizes, counts):
        return np.repeat((np.add.reduceat(counts, starts) >= least).astype(np.int64), sizes)

    def spell(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        keys, _ = chunk_keys(table, max_n, mask)
        wanted = keys[ex.gathered(replies, keys, bits).astype(bool)]
        found: dict = {}
        for langs, buf, starts, ends, first, copies, every in grams(table, max_n):
            doc, data = tx.owner(first), buf.tobytes()
            for lang, words in zip(langs.tolist(), (np.diff(first) * copies).tolist(), strict=True):
                found[lang, 0, b""] = found.get((lang, 0, b""), 0) + words
            for n, (at, g) in enumerate(every, 1):
                hit = np.flatnonzero(_among(g & mask, wanted))
                _, one, which = np.unique(g[hit], return_index=True, return_inverse=True)
                total = np.bincount(which, copies[doc[at[hit]]], len(one)).astype(np.int64)
                for w, c in zip(at[hit][one].tolist(), total.tolist(), strict=True):
                    k = langs[doc[w]], n, b" ".join([data[starts[i] : ends[i]] for i in range(w, w + n)])
                    found[k] = found.get(k, 0) + c
        lang, n, phrase = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array([p.decode() for p in phrase], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "n", "phrase", "f"])

    requests = dealt.groupBy("chunk").applyInArrow(ex.typed(ask, "table"), ex.REQUEST)
    replies = ex.answer(requests, bits, enough, drops=(drop,))
    spelled = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(ex.typed(spell, "table", "replies"), "lang string, n int, phrase string, f bigint")
    return spelled.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where((F.col("n") == 0) | (F.col("f") >= least))


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2..max_n words."""
    found = checkpoint(frequent(docs, max_n, least))
    counts = found.where("n > 0").select("lang", "phrase", "f")
    phrases = found.where("n > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = phrases.where(F.size("words") > 2).select("lang", F.col("a").alias("of"), F.explode(F.array(F.expr("array_join(slice(words, 1, size(words) - 1), ' ')"), F.expr("array_join(slice(words, 2, size(words) - 1), ' ')"))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    absorbed = phrases.join(longer, ["lang", "phrase"]).where(100 * wide("of") >= ABSORBED * wide("a")).select("lang", "phrase")
    kept = checkpoint(scored.join(absorbed, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    step = F.expr("score div 10000")
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step"))) - F.col("n")
    lowest = kept.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).withColumn("above", above).where(F.col("above") < top).groupBy("lang").agg(F.min("step").alias("lowest"))
    kept = kept.join(small(lowest), "lang").where(step >= F.col("lowest")).drop("lowest")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = found.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(small(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
tot AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, ws, unnest(range(1, len(ws))) AS j FROM c),
sc AS (SELECT cut.lang, cut.phrase, cut.a, j, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:j], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[j + 1:], ' ')),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c q ON q.lang = c.lang AND q.k > c.k AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ') AND 100::HUGEINT * q.a >= 80::HUGEINT * c.a),
r AS (SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM r JOIN tot USING (lang) WHERE rank <= 2000
"""
