"""How the sources of a language differ: divergence of every pair of sources, and the terms that set each apart, by systolic rotation.

Every group (a language's source) has a vector of term counts. Vectors are cut into shards of the language's kept terms (some SHARD each), and
the groups of a shard sit on seats of a few groups. A seat's vectors stay in their partition; in each round of a round-robin tournament
(circle method) every seat has one partner, whose compressed vectors travel to it for that round, and the meeting evaluates both directions. So each
pair of seats meets once, no task holds more than two seats of one shard, and each round is a table of its own in the shared folder. The first
round is each seat with itself and with the language's own vector; there a heap per group and shard keeps the terms of highest value.
Values add up over shards.

Counts come from one pass that adds up terms within each task first. All arithmetic is in whole numbers: p = 1 + floor(10^9 (c + 2) / D) is
worked out as long division by thousands, so that counts up to 10^15 fit 64 bits.

Results: null text, lang and source are ''. Groups without a term, and languages without a kept one, take part. Documents are rows: rows that repeat
count each time; ids are not read. A language with one source has no pair; an empty table gives no row. Very long texts are read whole, in
stretches. Columns other than lang, source and text are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import typed
from .near_copies import small
from .shared import checkpoint, small_batches, written

SHARD = 8192
#: Seats hold this many groups, more when a language has over SEATS times as many sources, so that there are at most SEATS rounds.
SEAT, SEATS = 8, 64
_TERM, _BREAK = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("d", pa.int64())])
MEETING = "lang string, source string, item string, shard int, tid int, value bigint"


def terms_of(data: bytes, stretch: int = 1 << 20):
    """Lists of the terms of a text, a stretch at a time; a term is never cut."""
    at = 0
    while at < len(data):
        cut = _BREAK.search(data, at + stretch) if at + stretch < len(data) else None
        end = cut.start() if cut else len(data)
        yield _TERM.findall(data[at:end].lower())
        at = end


def _count(batches, most: int = 600_000):
    """Rows of COUNTS, added up until `most` entries are held; term null: the group occurs."""
    held: dict = {}
    size = 0

    def out():
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (c, d) in held.items():
            columns[0] += [lang] * (len(c) + 1)
            columns[1] += [source] * (len(c) + 1)
            columns[2] += [None, *(t.decode() for t in c)]
            columns[3] += [0, *c.values()]
            columns[4] += [0, *(d[t] for t in c)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, COUNTS, strict=True)], schema=COUNTS)

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            c, d = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, own = len(c), set()
            for found in terms_of(text.as_buffer().to_pybytes() if text.is_valid and len(text.as_buffer() or b"") else b""):
                c.update(found)
                own.update(found)
            d.update(own)
            size += len(c) - before + 1
            if size >= most:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences) and d (documents) of every group; one row of term null says that the group occurs."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = rows.mapInArrow(_count, "lang string, source string, term string, c bigint, d bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _packed(key, table: pa.Table) -> pa.Table:
    """One vector: steps between term numbers, then counts, compressed."""
    tid, c = table["tid"].to_numpy(), table["c"].to_numpy()
    order = np.argsort(tid)
    blob = zlib.compress(np.diff(tid[order], prepend=0).astype("<i4").tobytes() + c[order].astype("<i8").tobytes(), 1)
    types = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.binary())
    return pa.table([pa.array([x], t) for x, t in zip((*(k.as_py() for k in key), blob), types, strict=True)], ["lang", "source", "whole", "shard", "vector"])


def _dense(blob: bytes | None, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    if blob:
        data = zlib.decompress(blob)
        k = len(data) // 12
        out[np.cumsum(np.frombuffer(data, "<i4", k))] = np.frombuffer(data, "<i8", k, 4 * k)
    return out


def shares(c: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (c + 2) / (total + 2 kept)), exactly."""
    whole = total + 2 * kept
    rest, out = c + 2, np.zeros(len(c), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _vectors(table: pa.Table) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(source, counts, shares) of each row."""
    out = []
    for source, total, kept, n, blob in zip(*(table[k].to_pylist() for k in ("source", "total", "kept", "n", "vector")), strict=True):
        c = _dense(blob, n)
        out.append((source, c, shares(c, total, kept)))
    return out


def _rows(lang: str, shard: int, rows: list[tuple]) -> pa.Table:
    source, item, tid, value = zip(*rows, strict=True) if rows else ((), (), (), ())
    n = len(rows)
    columns = (pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array([shard] * n, pa.int32()), pa.array(tid, pa.int32()), pa.array(value, pa.int64()))
    return pa.table(columns, ["lang", "source", "item", "shard", "tid", "value"])


def _both(a, b) -> list[tuple]:
    v = int(values(a[2], b[2]).sum())
    return [(a[0], b[0], None, v), (b[0], a[0], None, v)]


def _at_home(top: int):
    def meet(key, home: pa.Table, guests: pa.Table) -> pa.Table:
        own, rows = _vectors(home), []
        if not own:
            return _rows("", 0, [])
        (_, _, q), *_ = _vectors(guests)
        for i, (source, c, p) in enumerate(own):
            for other in own[:i]:
                rows += _both(other, own[i])
            apart = np.flatnonzero((c > 0) & (p > q))
            v = values(p[apart], q[apart])
            rows += [(source, None, t, -x) for x, t in heapq.nsmallest(top, zip((-v).tolist(), apart.tolist(), strict=True))]
        return _rows(key[0].as_py(), key[1].as_py(), rows)

    return typed(meet, "home", "guests")


def _abroad(key, home: pa.Table, guests: pa.Table) -> pa.Table:
    if not home.num_rows or not guests.num_rows:
        return _rows("", 0, [])
    own, others = _vectors(home), _vectors(guests)
    return _rows(key[0].as_py(), key[1].as_py(), [row for a in own for b in others for row in _both(a, b)])


def partner(seat: Column, turn: int, seats: int) -> Column:
    """Whom a seat meets in a turn (1 to seats - 1) of the circle method; `seats` is even."""
    last = seats - 1
    other = F.pmod(F.lit(2 * turn) - seat, F.lit(last))
    return F.when(seat == last, F.lit(turn % last)).when(other == seat, F.lit(last)).otherwise(other).cast("int")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` for every ordered pair of a language's sources, part `term` for each group's first terms."""
    counts = written(term_counts(docs))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("d").alias("d")).where(F.col("d") >= least_docs)
    kept = checkpoint(kept.select("lang", "term"))
    langs = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left")
    langs = checkpoint(langs.select("lang", F.coalesce("kept", F.lit(0)).alias("kept")).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("kept") / SHARD)).cast("int")))
    # Never dealt by language alone: one may hold most terms.
    terms = kept.join(small(langs), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")).repartition("lang", "shard")
    terms = checkpoint(terms.select("lang", "shard", "term", (F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1).alias("tid")))

    # `whole` marks the language's own vector, beside those of its sources.
    cells = counts.join(terms, ["lang", "term"]).select("lang", "source", F.lit(False).alias("whole"), "shard", "tid", "c")
    cells = checkpoint(cells.unionByName(cells.groupBy("lang", "shard", "tid").agg(F.sum("c").alias("c")).select("*", F.lit("").alias("source"), F.lit(True).alias("whole"))))
    vectors = cells.groupBy("lang", "source", "whole", "shard").applyInArrow(typed(_packed, "table"), "lang string, source string, whole boolean, shard int, vector binary")
    totals = cells.groupBy("lang", "source", "whole").agg(F.sum("c").alias("total"))
    sources = counts.select("lang", "source").distinct()
    most = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    size = max(SEAT, -(-most // SEATS))
    seated = sources.select("lang", "source", F.lit(False).alias("whole"), F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / size).cast("int").alias("seat"))
    groups = seated.unionByName(langs.select("lang", F.lit("").alias("source"), F.lit(True).alias("whole"), F.lit(-1).alias("seat")))
    frame = groups.join(small(langs), "lang").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    frame = frame.join(terms.groupBy("lang", "shard").agg(F.count(F.lit(1)).cast("int").alias("n")), ["lang", "shard"], "left")
    frame = frame.join(totals, ["lang", "source", "whole"], "left").join(vectors, ["lang", "source", "whole", "shard"], "left")
    frame = frame.select("lang", "shard", "seat", "source", F.coalesce("total", F.lit(0)).alias("total"), "kept", F.coalesce("n", F.lit(0)).alias("n"), "vector")
    resident = checkpoint(frame.repartition("lang", "shard", "seat"))

    home, place = resident.where("seat >= 0"), ["lang", "shard", "seat"]
    own = resident.where("seat < 0").drop("seat").join(home.select(*place).distinct(), ["lang", "shard"])

    def meet(guests: DataFrame, how) -> DataFrame:
        guests = guests.select(*(F.col(c).alias(c) for c in guests.columns))
        return checkpoint(home.groupBy(*place).cogroup(guests.groupBy(*place)).applyInArrow(how, MEETING))

    first = meet(own, _at_home(top))
    rounds, seats = [first.where("item is not null")], -(-most // size)
    seats += seats % 2
    for turn in range(1, seats if most > size else 1):
        to = partner(F.col("seat"), turn, seats)
        # Of two partners the lower seat stays at home when their sum is even, else the upper one.
        travels = F.when((F.col("seat") + to) % 2 == 0, F.col("seat") > to).otherwise(F.col("seat") < to)
        rounds.append(meet(home.where(travels).withColumn("seat", to), typed(_abroad, "home", "guests")))
    pairs = rounds[0]
    for r in rounds[1:]:
        pairs = pairs.unionByName(r)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    apart = first.where("tid is not null").drop("item").join(terms.withColumnRenamed("term", "item"), ["lang", "shard", "tid"])
    order = [F.desc("value"), F.asc("item")]
    for by in (["lang", "source", F.pmod(F.col("shard"), F.lit(64))], ["lang", "source"]):
        apart = apart.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("at") <= top)
    both = pairs.select("lang", "source", "part", "item", "value").unionByName(apart.select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(*order)))


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
v AS (SELECT g.lang, coalesce(k.v, 0) AS v FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k USING (lang)),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, CAST(coalesce(sum(c), 0) AS HUGEINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (n.n + 2 * v.v) AS p
  FROM n JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
ln AS (SELECT lang, sum(n) AS n FROM n GROUP BY lang),
lc AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (lc.c + 2)) // (ln.n + 2 * v.v) AS q FROM lc JOIN ln USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
