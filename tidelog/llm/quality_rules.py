"""Quality rules, line first: each line is judged on its own, failing lines go, and a document that loses too many words is rejected.

A line with a word fails when (n: its words)
* punctuation: it has under 12 words and the last one does not end in one of CLOSING, or over 30 % of its words end in two of ! ?, or over 30 % in
  two of # * $ % & < >;
* navigation: over 20 % of its words are a lone | or >;
* boilerplate: it holds one of BOILERPLATE (A-Z in any case), or over 30 % of its words equal the word before them in that line.

Equal hashes of lines and windows are confirmed on the bytes, so counts are exact whatever the texts.

Results: a null text is an empty one; a document without words fails the base rule. A null doc_id is passed on. Repeated rows are
judged one by one, an empty table gives no row, very long texts are judged whole, and columns other than doc_id and text are not read, so
their names don't matter. No shuffle; everything is vectorised over the Arrow buffer.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from . import text as tx

# Phrases of legal notices, consent banners and calls to act, in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript", "click here", "subscribe to", "sign up for", "lorem ipsum",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "cookie-richtlinie", "klicken sie hier", "jetzt anmelden", "newsletter abonnieren",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "cliquez ici", "inscrivez-vous", "abonnez-vous",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "aviso legal", "haga clic", "regístrese", "suscríbase",
)
_PHRASES = [p.encode() for p in BOILERPLATE]
#: Marks that close a sentence or a quotation.
CLOSING = ".!?:;\"')]»”’…。！？"


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS, CLOSERS, SHOUTS, MARKS = _table("#*$%&|<>"), _table(CLOSING.encode("ascii", "ignore").decode()), _table("!?"), _table("#*$%&<>")
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_lost_words bigint"


def closes(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character before each end is one of CLOSING."""
    last = buf[ends - 1]
    out, wide = CLOSERS[last], np.flatnonzero(last >= 128)
    for c in CLOSING:
        raw = c.encode()
        if len(raw) > 1:
            hit = ends[wide] >= len(raw)
            for k, byte in enumerate(raw):
                hit &= buf[np.maximum(ends[wide] - len(raw) + k, 0)] == byte
            out[wide[hit]] = True
    return out


def _covered(words: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Words in any of the windows that start at `starts`."""
    steps = np.zeros(words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return np.cumsum(steps[:-1]) > 0


def _equal_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of neighbours of equal keys, in the order of keys and places: in a group each one but the first is second once."""
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    return order[same], order[same + 1]


def _duplicate_lines(data, lines: list[tuple[int, int]]) -> int:
    return len(lines) - len({bytes(data[a:b]) for a, b in lines})


def _repeat_words(words: list[bytes], width: int) -> int:
    """Words in windows that occur twice or more, counted on the words themselves."""
    windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    found = Counter(windows)
    return int(_covered(len(words), np.array([i for i, w in enumerate(windows) if found[w] > 1], np.int64), width).sum())


def judge(ids, data, offsets, max_lost: float = 0.5, with_text: bool = False, open_words: int = 12) -> list:
    buf = np.frombuffer(data, np.uint8)
    starts, ends, first = tx.words(buf, offsets)
    doc = tx.owner(first)
    n_words = np.diff(first)
    inside = np.concatenate([[0], np.cumsum(~tx.SEPARATOR[buf] & ((buf & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
    spans = lambda sums: sums[offsets[1:]] - sums[offsets[:-1]]

    at = tx.window_starts(first, 8)
    hashes = tx.range_hashes(buf, starts, ends)
    keys = tx.window_hashes(hashes, 8)[at] if len(at) else np.zeros(0, np.uint64)
    keys = tx.mix(keys ^ tx.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    one, two = _equal_pairs(keys)
    one, two = at[one], at[two]
    n_repeat = tx.per_document(_covered(len(starts), np.concatenate([one, two]), 8).astype(np.int64), first)
    # Equal hashes are confirmed on the bytes; a document with a collision is counted on its words.
    same, blocks = np.ones(len(one), bool), tx.blocks_at(buf)
    for k in range(8):
        same &= tx.same_ranges(buf, (starts[one + k], ends[one + k]), (starts[two + k], ends[two + k]), blocks)
    for d in np.unique(doc[np.concatenate([one[~same], two[~same]])]):
        n_repeat[d] = _repeat_words([bytes(data[a:b]) for a, b in zip(starts[first[d] : first[d + 1]].tolist(), ends[first[d] : first[d + 1]].tolist(), strict=True)], 8)

    # A line begins at each document's start and after each \n; lines of one document are neighbours.
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(buf[:-1] == 10) + 1 if len(buf) else []])).astype(np.int64)
    line = np.searchsorted(begin, starts, "right") - 1
    n_in = np.bincount(line, minlength=len(begin))
    stop = np.append(begin[1:], len(buf))
    stop = stop - ((stop > begin) & (buf[np.maximum(stop - 1, 0)] == 10)) if len(begin) else stop
    of = np.searchsorted(offsets, begin, "right") - 1
    full = np.flatnonzero(n_in)
    line_keys = tx.mix(tx.range_hashes(buf, begin[full], stop[full]) ^ tx.mix(of[full].astype(np.uint64) + np.uint64(1)))
    one, two = _equal_pairs(line_keys)
    n_docs = len(offsets) - 1
    n_dup = np.bincount(of[full][two], minlength=n_docs)
    same = tx.same_ranges(buf, (begin[full[one]], stop[full[one]]), (begin[full[two]], stop[full[two]]), blocks)
    for d in np.unique(of[full][np.concatenate([one[~same], two[~same]])]):
        n_dup[d] = _duplicate_lines(data, [(int(begin[i]), int(stop[i])) for i in full[of[full] == d]])

    last, before, size = buf[ends - 1], buf[np.maximum(ends - 2, 0)], ends - starts
    share = lambda flags: np.bincount(line[flags], minlength=len(begin))
    failed = 10 * share((size > 1) & SHOUTS[last] & SHOUTS[before]) > 3 * n_in
    failed |= 10 * share((size > 1) & MARKS[last] & MARKS[before]) > 3 * n_in
    failed |= 10 * share((size == 1) & ((last == 124) | (last == 62))) > 2 * n_in
    stutter = np.zeros(len(starts), bool)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))
    stutter[again + 1] = tx.same_ranges(buf, (starts[again], ends[again]), (starts[again + 1], ends[again + 1]), blocks)
    failed |= 10 * share(stutter) > 3 * n_in
    closed = np.zeros(len(begin), bool)
    final = np.flatnonzero(np.diff(line, append=-1))  # each line's last word
    closed[line[final]] = closes(buf, ends[final])
    failed |= ~closed & (n_in < open_words)
    low = tx.LOWER[buf].tobytes()
    for phrase in _PHRASES:  # a search for each is quicker than one pattern of all
        at = low.find(phrase)
        while at >= 0:
            k = np.searchsorted(begin, at, "right") - 1
            failed[k] |= at + len(phrase) <= stop[k]  # not across the end of a document
            at = low.find(phrase, at + 1)
    lost = tx.per_document(np.where(failed[line], 1, 0), first) if len(line) else np.zeros(n_docs, np.int64)

    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    kept = ~base_failed & (lost <= max_lost * n_words)
    out = [tx.plain_ids(ids), n_words, spans(inside), spans(symbols), n_dup, n_repeat, base_failed, kept, lost]
    if with_text:
        good = ~failed | (n_in == 0)
        texts = [b"".join(bytes(data[begin[i] : begin[i + 1] if i + 1 < len(begin) and of[i + 1] == d else offsets[d + 1]]) for i in range(*np.searchsorted(of, [d, d + 1])) if good[i]).decode() for d in range(n_docs)]
        out.append(texts)
    return out


def line_rules(docs: DataFrame, max_lost: float = 0.5, with_text: bool = False) -> DataFrame:
    """One row per document with counts, verdict and (with_text) the text without its failed lines."""
    return tx.map_documents(docs, lambda *a: judge(*a, max_lost, with_text), SCHEMA + (", cleaned string" if with_text else ""))


#: The same rows in DuckDB.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM a WHERE len(ws) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(8)) AS p FROM g WHERE (doc_id, k) IN (SELECT (doc_id, k) FROM g GROUP BY doc_id, k HAVING count(*) > 1)) GROUP BY doc_id),
l AS (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS v FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
j AS (SELECT doc_id, line, len(v) AS n, 10 * len(list_filter(v, lambda x: regexp_matches(x, '[!?][!?]$'))) > 3 * len(v) OR 10 * len(list_filter(v, lambda x: regexp_matches(x, '[#*$%&<>][#*$%&<>]$'))) > 3 * len(v)
  OR 10 * len(list_filter(v, lambda x: x = '|' OR x = '>')) > 2 * len(v) OR 10 * len(list_filter(range(1, len(v)), lambda k: v[k] = v[k + 1])) > 3 * len(v)
  OR (len(v) < 12 AND NOT regexp_matches(v[-1], '[{CLOSING.replace("'", "''").replace("]", chr(92) + "]")}]$')) OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(BOILERPLATE).replace("'", "''")}') AS bad FROM l),
s AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (bad), 0) AS lost FROM j GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words FROM a LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * n_lost_words <= n_words AS kept, n_lost_words FROM f
"""
