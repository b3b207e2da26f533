"""Epochs of reused transaction ids against a plain walk, and how often the rows that tell them are shuffled."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidelog import scan_queries
from tidelog.operators import generate, transactions

SF = "/root/testdata/sf0.001"
KINDS = "db_name string, lsn string, operation string, transaction_id string, transaction_name string, seen_at timestamp, cleanup boolean"
DATA = "operation = 'LOP_INSERT_ROWS'"


def _log(n=600, seed=7):
    """Ids come again, also without a begin, behind an end or in a later stretch; some transactions are internal, some hold a clean-up."""
    pick, rows = random.Random(seed), []
    for i in range(n):
        lsn = f"{1 + i // 200:08x}:{(i // 20) * 4096:08x}:{i % 20 + 1:04x}"
        op = pick.choices(("LOP_BEGIN_XACT", "LOP_COMMIT_XACT", "LOP_ABORT_XACT", "LOP_INSERT_ROWS"), (2, 2, 1, 5))[0]
        name = pick.choice(("Backup:x", "user", "user", "user", None)) if op == "LOP_BEGIN_XACT" else None
        seen = datetime(2024, 1, 1) + timedelta(seconds=i) if op != "LOP_INSERT_ROWS" else None
        rows.append((pick.choice(("a", None)), lsn, op, pick.choice(("1", "2", "3", None)), name, seen, op == "LOP_INSERT_ROWS" and pick.random() < 0.03))
    return rows


def _walked(rows):
    epochs, at, of = {}, {}, []
    for db, lsn, op, txn, name, seen, cleanup in rows:
        key = (db, txn)
        e = at.setdefault(key, 0)
        told = epochs.setdefault((key, e), {"kind": None, "begin": None, "end": None, "excluded": None})
        of.append((lsn, key, e))
        if op == "LOP_BEGIN_XACT":
            told["begin"] = seen
        if (op == "LOP_BEGIN_XACT" and (name or "").startswith("Backup:")) or cleanup:
            told["excluded"] = told["excluded"] or lsn
        if op in ("LOP_COMMIT_XACT", "LOP_ABORT_XACT"):
            told["kind"], told["end"], at[key] = op, seen, e + 1
    last = {}
    for (key, e), told in epochs.items():
        if told["excluded"]:
            last[key] = max(last.get(key, -1), e)
    return {lsn: (e, *epochs[key, e].values(), last.get(key, -1) > e) for lsn, key, e in of}


def test_epochs_equal_a_walk(spark):
    rows = _log()
    df, want = spark.createDataFrame(rows, KINDS), _walked(rows)
    wanted = {lsn: want[lsn] for _, lsn, op, *_ in rows if op == "LOP_INSERT_ROWS"}
    for options in ({}, {"parts": 3}, {"lsn_prefix": 8, "parts": 2}):
        read = lambda d: {r.lsn: (r.epoch, r.kind, r.begin_at, r.end_at, r.excluded_from, r.undone) for r in d.collect()}
        assert read(transactions.with_epochs(df, **options)) == want
        assert read(transactions.with_epochs(df, only=F.expr(DATA), **options)) == wanted


def _exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(.*", df._jdf.queryExecution().executedPlan().toString())


def test_rows_that_tell_epochs_go_by_id_once(spark):
    """The records, the stretches, what goes by id, and the stretches again with their epochs."""
    assert len(_exchanges(transactions.with_epochs(spark.createDataFrame(_log(), KINDS), parts=300))) == 4


def test_a_scan_folds_what_events_need(spark):
    """Names, and what a record's epoch was found by, are not shuffled to the slots."""
    plan = generate.scan(scan_queries._records(spark, SF), scan_queries._catalog(spark))._jdf.queryExecution().optimizedPlan().toString()
    folded = next(line for line in plan.split("\n") if "MapInArrow" in line)
    assert "fold_path" in folded
    assert not re.search(r"\b(alloc_unit_name|transaction_name|seen_at|cleanup|match|kind|excluded_from|undone)#", folded)
