"""The near-dedup stage of the pipeline against brute-force Jaccard similarity."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def _kept(rows):
    """Ids that are the smallest of their component."""
    sets = [_shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group}
    return set(least.values())


def test_near_copies_are_found_as_by_brute_force(spark):
    import corpus_pipeline as cp

    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        text = rng.choices(words, k=rng.randint(200, 1000))
        for share in (0, 0.005, 0.01, 0.02, 0.03):
            rows.append((len(rows), " ".join(rng.choice(words) if rng.random() < share else w for w in text)))
    # A chain: each is like the next, the ends are not; then short, empty and null texts, and copies.
    text = rng.choices(words, k=300)
    for k in range(12):
        rows.append((len(rows), " ".join(text[k * 15 :] + [f"n{j}" for j in range(k * 15)])))
    rows += [(len(rows) + i, t) for i, t in enumerate(["one", "One", "one two", "", None, " \n", "a b c d e f", "a b c d e f", "a b c d e g", "a b c d e f g h i j k l m", "a b c d e f g h i j k l x"])]
    rows += [(len(rows) + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    frame = spark.createDataFrame([*rows, (None, rows[0][1]), (None, rows[0][1]), (0, rows[0][1])], "doc_id long, text string").repartition(5)
    found = [r.doc_id for r in cp.near_dedup(spark, frame, SF).collect()]
    assert sorted(i for i in found if i is not None) == sorted(_kept(rows)) and found.count(None) == 2


def test_fingerprints_propose_pairs(spark):
    """Without any bands the stage finds the similar pairs whose fingerprints differ in at most three bits, through the covering masks."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidelog.llm import near_copies as nc

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(80):
        text = rng.choices(words, k=600)
        texts += [text, [*text[:300], "changed", *text[301:]]]
    data = [" ".join(t).encode() for t in texts]
    s, edges = nc.shingle_sets(b"".join(data), np.concatenate([[0], np.cumsum([len(d) for d in data])]), 5)
    prints = nc.fingerprints(s, edges)
    near = [int(prints[k] ^ prints[k + 1]).bit_count() <= 3 for k in range(0, len(texts), 2)]
    assert 20 < sum(near)
    frame = spark.createDataFrame([(k, d.decode()) for k, d in enumerate(data)], "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in nc.one_of_each(frame, bands=0).select(F.col("doc_id")).collect()}
    # Pairs a little farther apart may share a mask too.
    assert set(range(0, len(texts), 2)) <= kept and not any(near[k // 2] for k in kept if k % 2)
