"""Spelled-out mailboxes: linear time, no anchor missed, any column name in the stages."""

import time

import pytest

from tidelog.llm import pii

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", [
    "mail to first." + "abc." * 1000 + "@ in the tree", "first" + ".abc" * 1000, "1." * 1000 + "2", "at-" * 3000, "a dot " * 3000 + "at", "x at " + "b dot " * 3000, "a@" * 5000, "at " * 5000, "a.at-b" * 3000,
])
def test_time_is_linear(text):
    began = time.time()
    for kind in range(4):
        pii.plausible(kind, text)
        pii._named(kind, text)
        pii._fitted(text, 0, kind, len(text))
    pii.ANCHOR.findall(text)
    pii.base_spans(text)
    assert time.time() - began < 2


def test_what_is_a_mailbox():
    for s in ("jane.doe at firm.org", "john.doe [at] example [dot] com", "jane(at)firm(dot)org", "joe-at-firm dot com", "a @ b . com", "x dot y at firm dot co dot uk", "jojo .b@x.com", "a.b@c.de"):
        assert pii.plausible(0, s), s
        assert pii.ANCHOR.search(s), s
        assert next(pii.mailboxes(s)) == (0, len(s)), s
    for s in ("at firm.org", "jane at firm", "jane at firm.o", "jane at firm.c0m", "@x.com", "a@.com", "a at", "at", "", "see at last"):
        assert not pii.plausible(0, s), s


def test_windows_without_an_anchor_change_nothing(spark):
    """All windows of all documents run, against those near anchors."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(2000)
    texts = [r.text[:800] for r in docs.collect()] + ["They said jane.doe at firm.org would know. " + "Nothing else here. " * 30, "meet at noon. Then go " * 20]
    tagger = pii.default_tagger()
    every = pii.tagged_spans(tagger, texts, 0.7, anchor=re.compile("(?s)."))
    near = pii.tagged_spans(tagger, texts, 0.7)
    good = lambda found: [[(a, pii._named(k, t[a:b]), b) for a, k, b in spans if pii._named(k, t[a:b]) is not None] for t, spans in zip(texts, found, strict=True)]
    assert good(every) == good(near) and sum(map(len, good(near))) > 20


def test_stages_take_any_column_name(spark, tmp_path):
    from pyspark.sql import functions as F

    import corpus_pipeline as cp

    names = ["meta.url", "a`b", "_id", "_row", "key", "node", "a b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(5))
    docs = docs.select("*", *[F.col("source").alias(n) for n in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == docs.columns
        frame = spark.createDataFrame(out.collect(), out.schema)
    assert cp.run(spark, str(tmp_path)).count() > 0
