"""What is kept beside the rows of the event table equals recomputation after upserts and retractions; searches read few blocks; pages by rank."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelog import schemas as S
from tidelog.operators import indexed_store
from tidelog.operators.indexed_store import IndexedStore, grams_of
from tidelog.plans import log_queries as Q
from tidelog.plans.ranked_pages import RankedPages

T0 = datetime(2024, 3, 1, 10, 0, 0)
WORDS = ["insert", "update", "delete", "[dbo].[T]", "50%", "a_b", "x\\y", "naïve", "😀ok", "where", "values"]


def event(rng, i, **more):
    time = None if rng.random() < 0.05 else T0 + timedelta(microseconds=rng.randrange(3_600_000_000))
    text = rng.choice([None, "", "ab", " ".join(rng.choices(WORDS, k=6)) + f" key{i:05d}"])
    rest = {
        "id": i, "lsn": f"{i:08x}", "txn_id": rng.choice([None, "", f"t{i // 4}"]), "operation": rng.choice(["INSERT", "UPDATE", "DELETE", "OTHER", None]), "db_name": rng.choice(["a", "b"]), "schema_name": rng.choice(["dbo", None]),
        "table_name": f"T{rng.randrange(3)}", "sql_stmt": text, "rollback_sql": rng.choice([None, "-- no", "undo"]), "event_time": time, "commit_time": rng.choice([None, T0 + timedelta(seconds=i)]), "status": rng.choice(["ok", "bad", None]),
    }
    return tuple((rest | more).get(c) for c in S.EVENT_COLUMNS)


def made(spark, rng, ids, **more):
    return spark.createDataFrame([event(rng, i, **more) for i in ids], S.LOG_EVENTS)


def same(got, want):
    columns = sorted(want.columns)
    key = lambda df: sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
    assert sorted(got.columns) == columns and key(got) == key(want)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng, t = random.Random(5), IndexedStore(spark, str(tmp_path_factory.mktemp("t")), 300, 20)
    t.upsert(made(spark, rng, range(2000)), 0)
    t.upsert(made(spark, rng, rng.sample(range(2000), 150), db_name="a"), 1)
    t.upsert(made(spark, rng, rng.sample(range(2000), 90)).withColumn("is_deleted", F.lit(True)), 2, spark.createDataFrame([("a", f"t{k}") for k in range(40, 60)], "db_name string, txn_id string"))
    return t


def test_counts(spark, table):
    events = table.read().cache()
    assert 1500 < events.count() < 2600 and "block" not in events.columns
    same(table.counts("operation").drop("rollbacks"), Q.stats_by_operation(events))
    same(table.total(Q.LogFilter(db="a", operation="INSERT,UPDATE")), Q.total(events, Q.LogFilter(db="a", operation="INSERT,UPDATE")))
    same(table.counts("status").select("status", "n"), events.groupBy("status").agg(F.count(F.lit(1)).alias("n")))
    same(table.tables(), Q.stats_tables(events))
    same(table.databases(), Q.stats_databases(events))
    with pytest.raises(ValueError):
        table.total(Q.LogFilter(search="x"))


def test_transactions(table):
    events = table.read()
    for db, page in (("", 1), ("", 3), ("b", 2)):
        same(table.transaction_groups(db, page, 50), Q.transaction_groups(events, Q.LogFilter(db=db), page, 50))


@pytest.mark.parametrize(("since", "length", "buckets"), [(T0, 3_600_000, 60), (T0 + timedelta(seconds=7, microseconds=345678), 2_000_123, 7), (T0, 30_000, 72), (T0 - timedelta(hours=2), 86_400_000, 5), (T0 + timedelta(minutes=1), 120_000, 1)])
def test_timeline(table, since, length, buckets):
    events, until = table.read(), since + timedelta(milliseconds=length)
    for where in (Q.LogFilter(), Q.LogFilter(db="a", table="dbo.T1")):
        same(table.timeline(since, until, buckets, where), Q.timeline(events, since, until, buckets, where, dense=False))


def test_a_batch_writes_what_is_kept_of_its_own_ranges(spark, table):
    before = table.state().ranges
    hit = table.upsert(made(spark, random.Random(9), range(100, 110), db_name="a"), 3)
    after = table.state().ranges
    assert 1 <= len(hit) <= 2 < len(before) and all(table._beside(after[n]["folder"], "times") == table._beside(before[n]["folder"], "times") for n in before if n not in hit)
    same(table.counts("operation").drop("rollbacks"), Q.stats_by_operation(table.read()))


def test_search(table, monkeypatch):
    events, rng = table.read().cache(), random.Random(2)
    texts = [r.sql_stmt for r in events.select("sql_stmt").where("length(sql_stmt) > 10").collect()]
    terms = ["50%", "a_b", "x\\y", "ï", "", "ab", "%", "___", "😀ok wh", "no such text", "ins%key00", "naïve%upd"]
    for _ in range(28):
        text = rng.choice(texts)
        at = rng.randrange(len(text) - 4)
        terms.append(text[at : at + rng.choice([2, 4, 8])])
    for term in terms:
        where = Q.LogFilter(search=term)
        assert sorted(r.id for r in table.matching(where).collect()) == sorted(r.id for r in where.apply(events).collect()), term
    every = table.blocks("key").count()
    rare = rng.choice([t for t in texts if "key" in t])[-8:]
    assert every > 80 and 1 <= table.blocks(rare).count() < every / 10
    assert grams_of("ab%cd_") == [] and grams_of("abcd%abc") == ["abc", "bcd"]
    # Terms of many blocks: ranges are read as a whole.
    monkeypatch.setattr(indexed_store, "MOST_BLOCKS", 3)
    where = Q.LogFilter(search="where", db="a")
    assert sorted(r.id for r in table.matching(where).collect()) == sorted(r.id for r in where.apply(events).collect())


def test_before_the_first_batch(spark, tmp_path):
    t = IndexedStore(spark, str(tmp_path / "t"))
    assert t.matching(Q.LogFilter(search="abc")) is None and t.read() is None and t.total().collect()[0].total == 0
    assert t.transaction_groups().count() == t.timeline(T0, T0 + timedelta(hours=1)).count() == t.tables().count() == 0


def test_pages_by_rank(spark, table, tmp_path):
    events = table.read().cache()
    for by, direction in (("event_time", "desc"), ("operation", "asc"), ("lsn", "asc")):
        pages = RankedPages.build(events, str(tmp_path / by), by, direction, 200)
        assert len(pages.counts) > 5
        for where in (Q.LogFilter(), Q.LogFilter(db="a", operation="INSERT"), Q.LogFilter(table="none")):
            n = where.apply(events).count()
            for page in (1, 2, n // 90, n // 90 + 1, n // 90 + 2):
                page = max(page, 1)
                got = pages.page(where, page, 90)
                assert [r.id for r in got.collect()] == [r.id for r in Q.logs(events, where, by, direction, page, 90).collect()], (by, where, page)
                assert len({f.split("part=")[1].split("/")[0] for f in got.inputFiles() if "part=" in f}) <= (2 if not where.terms() else 6)
    assert [r.id for r in RankedPages.build(events.limit(0), str(tmp_path / "none")).page().collect()] == []
