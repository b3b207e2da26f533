"""Secret scans: base patterns, and dictionary-primed zstandard novelty for strings in a sensitive context.

Base spans (leftmost, non-overlapping per kind): assign, access, hex. The method looks at every string of 16 characters or more of
[A-Za-z0-9+/_.=-] that has a digit and a letter and begins at a sensitive word (`_WORD`) or within 48 characters after it, in its line; each
word counts, also one inside the 48 characters of another, and a string is taken to its end whatever its length.

Its novelty is what it adds to a compressed frame, zstd(surroundings + string) minus zstd(surroundings), as a share of what strings of the same length drawn at
random from its alphabet add there. So length, alphabet and surroundings cancel out: a key adds as much as chance does, whatever it is made
of, an identifier less. Frames are primed with a dictionary: lines of code and configuration (`PRIMER`), and the words that the corpus itself makes its identifiers of
(`identifier_words`: counted over all rows in Spark, the commonest first, up to DICTIONARY bytes). A string of at least `novelty` is reported as kind
`novel`, unless it touches a base span.

Results: a null text is an empty one. Ids may be null or repeat; rows are scanned one by one. An empty table gives no row, very long texts are
scanned whole, and columns other than doc_id and text are not read. No shuffle.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
import string
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

KINDS = ("assign", "access", "hex", "novel")
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_WORD = re.compile(r"(?=(secret|token|passw|credential|private[ _-]?key|api[ _-]?key|access[ _-]?key|auth|bearer|signature|session[ _-]?id))", re.I | re.A)
_STRING = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

#: What code and configuration look like: identifiers, words, dates, versions, paths.
PRIMER = (
    b"public static final String config = new Configuration(); def __init__(self, name, value=None): return self.value\n"
    b"import os, sys; from typing import Optional; const express = require('express'); function handleRequest(req, res) {}\n"
    b"SELECT id, name, created_at FROM users WHERE status = 'active' ORDER BY updated_at DESC; INSERT INTO table VALUES\n"
    b"http://www.example.com/index.html https://api.example.org/v1/resources?limit=100&offset=0 user@mail.example.com\n"
    b"password passwd secret token api_key apikey access_key private_key authorization bearer credential session_id signature\n"
    b"0123456789 1234567890 2020-01-01T00:00:00Z 2021-12-31 23:59:59 version 1.2.3 10.0.0.1 127.0.0.1 localhost:8080\n"
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ true false null undefined example changeme placeholder test\n"
    b"getUserProfileById setUserName createSessionHandler updateRequestToken deleteResponseHeader loadConfigFile saveDataModel findAllByEmail\n"
    b"isAuthenticated hasPermission validateInput parseJsonString formatDateTime convertToArray mapValues filterItems sendMessage receiveEvent\n"
    b"user_name user_id account_number client_secret refresh_token access_token session_key public_key file_path base_url max_retries time_out\n"
    b"ServiceManager ControllerFactory RepositoryImpl AbstractProvider BuilderPattern DefaultListener ConnectionPool ThreadExecutor CacheEntry\n"
    b"the and for with this that from have not are was were which their would about there these could other into more\n"
)


#: Bytes of identifier words in the dictionary, and how many words are fetched for it at most (words have 3 to 24 letters).
DICTIONARY, MOST_WORDS, LEAST = 60_000, 20_000, 3
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
NOVELTY = 0.88
_CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits)


def pieces(text: str) -> set[str]:
    """The words that the long strings of a text are made of."""
    return {p for m in _STRING.finditer(text) for p in _PIECE.findall(m.group()) if 3 <= len(p) <= 24}


def identifier_words(docs: DataFrame) -> tuple[str, ...]:
    """The words of identifiers by documents times length, rarest first (what stands last in a dictionary is found at least cost), up to DICTIONARY bytes."""
    from .shared import small_batches

    small_batches(docs.sparkSession)

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(pieces(text or ""))
            if len(held) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    out, size = [], 0
    for row in counts.orderBy(F.desc(F.col("n") * F.length("word")), "word").limit(MOST_WORDS).collect():
        size += len(row.word) + 1
        if size > DICTIONARY:
            break
        out.append(row.word)
    return tuple(reversed(out))


@functools.lru_cache(2)
def _compressor(words: tuple[str, ...]):
    import zstandard

    known = zstandard.ZstdCompressionDict(PRIMER + " ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=9)
    return zstandard.ZstdCompressor(level=9, dict_data=known, write_content_size=False, write_checksum=False)


def marginal(around: bytes, added: bytes, words: tuple[str, ...] = ()) -> int:
    """Bytes that a string adds to its surroundings."""
    c = _compressor(words)
    return len(c.compress(around + added)) - len(c.compress(around))


def alphabet(s: str) -> str:
    """The characters that a string seems drawn from: hex digits, or the classes that it has characters of, and its own signs."""
    if set(s) <= set("0123456789abcdef"):
        return "0123456789abcdef"
    return "".join(c for c in _CLASSES if not set(c).isdisjoint(s)) + "".join(sorted({c for c in s if not c.isalnum()}))


@functools.lru_cache(4096)
def _drawn(letters: str, n: int) -> tuple[bytes, ...]:
    """Strings drawn at random; a long one is enough."""
    return tuple("".join(random.Random(f"{letters}{n}{k}").choices(letters, k=n)).encode() for k in range(8 if n <= 256 else 1))


def novelty_of(around: bytes, s: str, words: tuple[str, ...] = ()) -> float:
    drawn = _drawn(alphabet(s), len(s)) if len(s) <= 4096 else _drawn.__wrapped__(alphabet(s), len(s))
    by_chance = sum(marginal(around, x, words) for x in drawn) / len(drawn)
    return marginal(around, s.encode(), words) / max(by_chance, 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: float, identifiers: tuple[str, ...] = ()) -> list[tuple[int, int, int]]:
    words = [m.span(1) for m in _WORD.finditer(text)]
    runs = [m.span() for m in _STRING.finditer(text)] if words else []
    ends = [b for _, b in runs]
    # Base spans of different kinds may overlap: the furthest end so far tells whether one reaches into a place.
    starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    taken = lambda a, b: (k := bisect.bisect_left(starts, b)) > 0 and reach[k - 1] > a
    out, seen = [], set()
    for word, stop in words:
        line = text.find("\n", stop, stop + 48)
        last = line if line >= 0 else min(len(text), stop + 48)
        for k in range(bisect.bisect_right(ends, word), len(runs)):
            # A word inside a string begins it; so strings of one run have their end in common.
            a, b = max(runs[k][0], word), runs[k][1]
            if a > last:
                break
            if b in seen or b - a < 16 or taken(a, b):
                continue
            seen.add(b)
            s = text[a:b]
            if not (re.search("[0-9]", s) and re.search("[A-Za-z]", s)):
                continue
            around = (text[max(0, a - 400) : a] + text[b : b + 400]).encode()
            if novelty_of(around, s, identifiers) >= novelty:
                out.append((a, 3, b))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str, novelty: float = NOVELTY, identifiers: tuple[str, ...] = ()) -> tuple[list, list]:
    """Base spans and added spans of one text."""
    base = base_spans(text)
    return base, novel_spans(text, base, novelty, identifiers)


def find_secrets(docs: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans. The dictionary (DICTIONARY bytes) is a broadcast variable."""
    identifiers = docs.sparkSession.sparkContext.broadcast(identifier_words(docs))

    def per_slice(ids, data, offsets):
        rows = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            base, added = scan(str(data[a:b], "utf-8"), novelty, identifiers.value)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)))
        return [tx.plain_ids(ids), *map(list, zip(*rows, strict=True))]

    return tx.map_documents(docs, per_slice, SCHEMA)
