"""The event table in ranges: equal to recomputation, few ranges rewritten, a batch again, transactions taken back, checkpoints with the rest."""

import random

from tidelog.operators import store
from tidelog.operators.ranged_store import RangedStore, bloom, may_have

SCHEMA = "db_name string, lsn string, txn_id string, v int, is_deleted boolean"


def rows(rng, n, space=4000):
    return [(rng.choice(["a", "b"]), f"{rng.randrange(space):08x}", f"t{rng.randrange(60)}", rng.randrange(1000), rng.random() < 0.1) for _ in range(n)]


def content(df):
    return sorted((r.db_name, r.lsn, r.txn_id, r.v) for r in df.collect())


def test_equals_recomputation(spark, tmp_path):
    rng, table = random.Random(3), RangedStore(spark, str(tmp_path / "t"), 150)
    want: dict = {}
    for seq in range(5):
        one = {(r[0], r[1]): r for r in rows(rng, [900, 40, 1, 500, 60][seq])}
        gone = {("a", "t7"), ("b", "t9")} if seq == 3 else set()
        table.upsert(spark.createDataFrame(list(one.values()), SCHEMA), seq, spark.createDataFrame(list(gone), "db_name string, txn_id string") if gone else None, {"a": f"{seq:08x}"})
        want = {k: r for k, r in want.items() if (r[0], r[2]) not in gone} | one
        want = {k: r for k, r in want.items() if not r[4]}
        assert content(table.read()) == sorted(r[:4] for r in want.values()), seq
    state = table.state()
    assert state.seq == 4 and state.checkpoints == {"a": "00000004"} and len(state.ranges) > 5
    assert all(r["n"] <= 300 for r in state.ranges.values())
    part = table.read("a", "00000100", "00000300")
    assert content(part) == sorted(r[:4] for r in want.values() if r[0] == "a" and "00000100" <= r[1] <= "00000300")
    assert len(part.inputFiles()) < len(table.read().inputFiles()) / 2
    # An event table of appended versions has the same events.
    assert store.latest(table.read().drop("is_deleted")).count() == len(want)


def test_few_ranges_are_rewritten(spark, tmp_path):
    table = RangedStore(spark, str(tmp_path / "t"), 500)
    table.upsert(spark.createDataFrame([("a", f"{i:08x}", f"t{i // 100}", 0, False) for i in range(10_000)], SCHEMA), 0)
    before = table.state().ranges
    assert len(before) >= 15
    batch = spark.createDataFrame([("a", f"{i:08x}", "new", 1, False) for i in range(3000, 4000)], SCHEMA)
    hit = table.upsert(batch, 1)
    after = table.state().ranges
    assert 2 <= len(hit) <= 4 and {n for n in before if before[n] != after.get(n)} == set(hit)
    # The same batch again, and an older one: nothing is written.
    files = sorted(table.read().inputFiles())
    assert table.upsert(batch, 1) == [] and table.upsert(batch, 0) == [] and sorted(table.read().inputFiles()) == files
    # A transaction lies in one range; nearly all others are left alone.
    hit = table.upsert(batch.limit(0), 2, spark.createDataFrame([("a", "t77")], "db_name string, txn_id string"))
    assert 1 <= len(hit) <= 3 and table.read().where("txn_id = 't77'").count() == 0 and table.read().count() == 9900


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    table = RangedStore(spark, str(tmp_path / "t"), 100)
    assert table.read() is None
    table.upsert(spark.createDataFrame(rows(random.Random(1), 50), SCHEMA), 0)
    seen = content(table.read())
    # A manifest that lacks rows.
    found = spark.read.parquet(str(tmp_path / "t" / "manifest" / "seq=0"))
    found.selectExpr("total + 1 as total", *found.columns[1:]).write.parquet(str(tmp_path / "t" / "manifest" / "seq=1"))
    assert content(table.read()) == seen and table.state().seq == 0


def test_filters():
    import numpy as np

    rng = np.random.default_rng(1)
    inside, outside = rng.integers(-(2**63), 2**63 - 1, 1000), rng.integers(-(2**63), 2**63 - 1, 1000)
    data = bloom(inside)
    assert all(may_have(data, inside[k : k + 1]) for k in range(1000)) and sum(may_have(data, outside[k : k + 1]) for k in range(1000)) < 40
    assert not may_have(bloom(inside[:0]), outside)


def test_one_shuffle_and_no_count_of_small_ranges(spark, tmp_path):
    """The rows of a batch and those of its ranges are dealt once, by range; they are merged for their number only where a range may have grown too large."""
    plans = []

    class Seen(RangedStore):
        def _arranged(self, rows):
            plans.append(rows._jdf.queryExecution().sparkPlan().toString() + rows._jdf.queryExecution().executedPlan().toString())
            return rows

    table, rng = Seen(spark, str(tmp_path / "t"), 300), random.Random(5)
    for seq in range(2):
        table.upsert(spark.createDataFrame(list({r[:2]: r for r in rows(rng, 900)}.values()), SCHEMA), seq)
    assert len(plans) == 2 and all(p.split("AdaptiveSparkPlan")[1].count("Exchange hashpartitioning") == 1 for p in plans)
    state = table.state()
    out, hit = {}, sorted(state.ranges)
    assert table._split(None, state, hit, out, dict.fromkeys(hit, 600 - max(r["n"] for r in state.ranges.values()))) is None and sorted(out) == hit


def test_long_lists_of_transactions_are_not_read_to_their_end(monkeypatch):
    from tidelog.operators import ranged_store

    import numpy as np

    seen, mixed = [], ranged_store._mixed
    every = np.random.default_rng(1).integers(-(2**62), 2**62, 100_000)
    data, absent = bloom(every[:200]), bloom(np.arange(0))
    monkeypatch.setattr(ranged_store, "_mixed", lambda h: seen.append(len(h)) or mixed(h))
    assert may_have(data, every[::-1]) and sum(seen) < 10_000
    assert not may_have(absent, every) and may_have(data, every[199:200])
