"""Token counts of whole texts under a sentencepiece model; huge documents are encoded in overlapping chunks and spliced.

A document over `huge` characters is cut into chunks of `chunk` characters; each chunk reads `overlap` characters on. Both
neighbours encode the overlap with offsets. A position is a stable common boundary when both encodings have a token boundary there, at a
space whose left neighbour is no space: `splits_at_spaces` proves from the vocabulary that no piece spans such a place, so merges on
its two sides never meet. The splice counts the left chunk's tokens up to that place and the right chunk's from it on. Without one the
overlap doubles, up to the rest of the document, which is then encoded in one piece.

Results: a null text counts as empty (0 bytes, 0 tokens). Ids may be null or repeat; each row is counted by itself. An empty table gives no row,
very long texts are counted whole, and columns other than doc_id and text are not read. No shuffle.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from . import text as tx

SPACE = "▁"
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


@functools.lru_cache(2)
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(2)
def splits_at_spaces(path: str) -> bool:
    """Whether no piece holds a space after another character: then no token spans the left edge of a run of spaces."""
    sp = model(path)
    return not any(SPACE in sp.id_to_piece(i).lstrip(SPACE) for i in range(sp.get_piece_size()) if not sp.is_control(i))


def _offsets(sp, text: str) -> np.ndarray:
    offsets = sp.encode(text, return_type="offset_mapping")["offsets"]
    return np.array(offsets, np.int64).reshape(-1, 2)[:, 0].copy()


def _begins(sp, text: str, leads: bool) -> np.ndarray:
    """Where the tokens begin. The library puts a space before a text; a chunk within a document starts at a space, which is left out for it."""
    if leads:
        return _offsets(sp, text)
    if text == " ":
        return np.zeros(1, np.int64)
    out = _offsets(sp, text[1:]) + 1
    out[0] = 0
    return out


def _edges(text: str, lo: int, hi: int) -> list[int]:
    """Places from lo on, before hi, at a space after a character that is no space."""
    out, at = [], text.find(" ", max(lo, 1), hi)
    while at >= 0:
        if text[at - 1] not in (" ", SPACE):
            out.append(at)
        at = text.find(" ", at + 1, hi)
    return out


def count_huge(path: str, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text, by chunks; equal to len(encode(text))."""
    sp = model(path)
    if not splits_at_spaces(path):
        return len(sp.encode(text))
    total, at = 0, 0
    while True:
        wide = overlap
        while True:
            to = min(len(text), at + chunk + wide)
            here = _begins(sp, text[at:to], at == 0) + at
            if to == len(text):
                return total + len(here)
            # The right neighbour starts at a place of the overlap; its own begins confirm the boundaries that follow.
            edges = _edges(text, at + chunk, to)
            stable = None
            if edges:
                there = _begins(sp, text[edges[0] : to], False) + edges[0]
                both = np.intersect1d(here, there)
                common = set(both.tolist())
                inner = [e for e in edges if e in common]
                stable = inner[len(inner) // 2] if inner else None
            if stable is not None:
                break
            wide *= 2
        total += int((here < stable).sum())
        at = stable


def counter(path: str, limit: int, huge: int, chunk: int, overlap: int):
    def per_slice(ids, data, offsets):
        sp, sizes = model(path), np.diff(offsets)
        counts = np.zeros(len(sizes), np.int64)
        texts = [str(data[offsets[i] : offsets[i + 1]], "utf-8") for i in range(len(sizes))]
        short = [i for i, t in enumerate(texts) if len(t) <= huge]
        counts[short] = [len(x) for x in sp.encode([texts[i] for i in short], num_threads=1)] if short else []
        for i, t in enumerate(texts):
            if len(t) > huge:
                counts[i] = count_huge(path, t, chunk, overlap)
        return [tx.plain_ids(ids), sizes, counts, counts > limit]

    return per_slice


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, huge: int = 1 << 15, chunk: int = 1 << 14, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. The model file must lie at `path` on each executor."""
    return tx.map_documents(docs, counter(path, limit, huge, chunk, overlap), SCHEMA, 1 << 20)
