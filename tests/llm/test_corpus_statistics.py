"""Phrases, divergence of sources and url filters against brute-force versions, on small tables with nulls, ties, repeated rows and clashing names."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"
LONG = "one two three four. " * 3000


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["A", "b", "Cc", "dé", "Éa", "x1", "日本", "the", "The"]
    rows = [(rng.choice([None, i, 7]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, ""])) for i in range(n)]
    rows += [(1, None, "en", "s1"), (2, "", None, None), (None, None, None, None), (3, LONG, "en", "s1"), (3, LONG, "en", "s1"), (4, "!? 12", "nn", "only"), (5, "  \n", "nn", "other")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("phrase", "f", "n", "copies", "shard", "tid", "term", "whole", "a.b", "a`b")}
    return {seed: spark.createDataFrame(corpus(seed), SCHEMA).withColumns(clash).repartition(3).cache() for seed in (1, 2)}


def phrases_by_hand(rows, least, top):
    count, words_of = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(ws)
            for n in range(1, 5):
                count.update((lang, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1))
    out = []
    cands = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    for lang in words_of:
        own = []
        for (of, p), a in cands.items():
            if of != lang or any(g == lang and len(q) > len(p) and inside(p, q) and 100 * f >= 80 * a for (g, q), f in cands.items()):
                continue
            score, k = min((2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), " ".join(p), count[lang, p[:k]], count[lang, p[k:]]))
        out += [(lang, i + 1, p, -a, left, right, words_of[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(own)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (30, 5), (2, 7)])
def test_phrases(docs, least, top):
    from tidelog.llm.phrases import collocations

    for seed, df in docs.items():
        assert sorted(map(tuple, collocations(df, least=least, top=top).collect())) == phrases_by_hand(corpus(seed), least, top)


def test_phrases_of_repeated_rows_and_none(spark, docs):
    """Equal rows that would fill a chunk stand once and count each; an empty table has no row."""
    from tidelog.llm.phrases import collocations

    rows = [(None, LONG, None, "s")] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, collocations(df).collect())) == phrases_by_hand(rows, 30, 2000)
    assert collocations(docs[1].limit(0)).collect() == []


def test_shares_are_exact():
    """Products pass 64 bits."""
    from tidelog.llm.divergence import shares

    c, total, kept = np.array([0, 9 * 10**14, 123456789012345]), 10**15, 10**7
    assert shares(c, total, kept).tolist() == [1 + 10**9 * (int(x) + 2) // (total + 2 * kept) for x in c]


def divergence_by_hand(rows, least_docs, top):
    groups, docs_with = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, source in rows:
        lang, found = lang or "", TERM.findall(low(text or ""))
        groups[lang, source or ""].update(found)
        docs_with.update((lang, t) for t in set(found))
    out = []
    for lang in {k for k, _ in groups}:
        kept = sorted((t for (g, t), d in docs_with.items() if g == lang and d >= least_docs), key=str.encode)
        own = {s: c for (g, s), c in groups.items() if g == lang}

        def p(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        q = p(sum(own.values(), collections.Counter()))
        of = {s: p(c) for s, c in own.items()}
        for s, c in own.items():
            pairs = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-f(of[s][t], q[t]), t.encode(), t) for t in kept if c[t] > 0 and of[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "seat"), [(8192, 8), (3, 1), (2, 2)])
def test_divergence(docs, monkeypatch, shard, seat):
    """Also with many shards and seats, so that the tournament takes several rounds."""
    from tidelog.llm import divergence as d

    monkeypatch.setattr(d, "SHARD", shard)
    monkeypatch.setattr(d, "SEAT", seat)
    for seed, df in docs.items():
        assert sorted(map(tuple, d.audit(df, top=4).collect())) == divergence_by_hand(corpus(seed), 10, 4)
    assert d.audit(docs[1].limit(0)).collect() == []


def test_every_pair_of_seats_meets_once(spark):
    from pyspark.sql import functions as F

    from tidelog.llm.divergence import partner

    for seats in (2, 4, 6, 10):
        met = collections.Counter()
        for turn in range(1, seats):
            got = {r.id: r.p for r in spark.range(seats).select("id", partner(F.col("id").cast("int"), turn, seats).alias("p")).collect()}
            assert all(got[got[s]] == s != got[s] for s in got)
            met.update(frozenset(x) for x in got.items())
        assert met == {frozenset(x): 2 for x in itertools.combinations(range(seats), 2)}


def test_terms_are_not_cut():
    from tidelog.llm.divergence import terms_of

    text = ("aB" * 50 + " é-ß" + "\x00" + "日本" * 30) * 20
    assert [t for part in terms_of(text.encode(), 7) for t in part] == [t.encode() for t in TERM.findall(low(text))]


# ---- urls -----------------------------------------------------------------------------------------------------------------------

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return low(m[1]), m[2]


def rule_by_hand(host, path):
    fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


def urls_by_hand(urls, reject=0.8, least=8, weight=4.0, depth=8):
    """Template and purity of each url, by recursion over the pages of a node."""
    known = [parts_by_hand(u) for u in urls]
    said = [rule_by_hand(*x)[1] for x in known]
    labelled = lambda ids: [said[i] for i in ids if said[i]]
    bad = lambda ids: sum(s == "block" for s in labelled(ids))
    smooth = lambda ids, above: (bad(ids) + weight * above) / (len(labelled(ids)) + weight)
    shape = [re.sub("[0-9]+", "{n}", re.sub(r"(?<![0-9A-Za-z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "{h}", p)).split("/") for _, p in known]
    out = {}

    def grow(ids, node, purity, level):
        for i in ids:
            if len(shape[i]) <= level:
                out[i] = node, purity
        ids = [i for i in ids if len(shape[i]) > level]
        names = collections.Counter(shape[i][level] for i in ids)
        branches = collections.defaultdict(list)
        for i in ids:
            s = shape[i][level]
            branches[s if names[s] >= least and names[s] * 64 >= len(ids) else "*"].append(i)
        rate = lambda x: bad(x) / max(len(labelled(x)), 1)
        order, classes = sorted(branches, key=lambda b: (not labelled(branches[b]), rate(branches[b]), b)), []
        for k, b in enumerate(order):
            own, n = branches[b], len(labelled(branches[b]))
            if k:
                last = branches[order[k - 1]]
                m = len(labelled(last))
                both = (bad(own) + bad(last)) / max(n + m, 1)
                apart = m > 0 if not n else abs(rate(own) - rate(last)) > 2.58 * math.sqrt(both * (1 - both) * (1 / max(n, 1) + 1 / max(m, 1)))
            if k and not apart:
                classes[-1].append(b)
            else:
                classes.append([b])
        for group in classes:
            inside = [i for b in group for i in branches[b]]
            name = node + "/" + (group[0] if len(group) == 1 else "{" + "|".join(sorted(group)) + "}")
            q = smooth(inside, purity)
            if level == depth:
                out.update({i: (name + ("/**" if len(shape[i]) > level + 1 else ""), q) for i in inside})
            else:
                grow(inside, name, q, level + 1)

    everything = range(len(urls))
    prior = bad(everything) / len(labelled(everything)) if labelled(everything) else 0.0
    for host in {h for h, _ in known}:
        ids = [i for i in everything if known[i][0] == host]
        grow(ids, "", smooth(ids, prior), 1)
    rows = []
    for i in everything:
        rule, says = rule_by_hand(*known[i])
        rows.append((*known[i], rule, says or ("block" if out[i][1] >= reject else "allow"), out[i][0], round(out[i][1], 9)))
    return rows


def some_urls(seed):
    rng = random.Random(seed)
    hosts = ["a.com", "B.Example.com", "x.example.org", "example.org", "org", "example.net", "de.com:80", "deep.com"]
    urls = [None, "", "no scheme/de/1", "://", "http://", "http://A.COM", "http://a.com?x=/de/", "ftp://a.com/de/1#f", "http://a.com/fr", "https://q.com/de/x://y", "http://a.com/" + "p/" * 3000, "http://a.com/de/\n/x"]
    for _ in range(600):
        section = rng.choice(["en", "de", "fr", "es", "news"])
        tail = rng.choice(["{}", "{}.html", "{}/", "title-{}", "deadbeef{}", "a/b/c/d/e/f/g/h/i/j", "{}?q=/x", "page"]).format(rng.randint(1, 5000))
        urls.append(f"http://{rng.choice(hosts)}/{section}/{tail}")
    urls += [f"http://big.com/{s}/{rng.choice('abcdefgh') * 5}{chr(97 + i % 26)}{'xyz'[i % 3]}" for i in range(300) for s in ["de" if i % 9 else "fr"]]
    urls += [f"http://big.com/other/{i}" for i in range(30)] + [f"http://bad.com/de/{i}" for i in range(60)] + [f"http://bad.com/more/{i}" for i in range(20)]
    return urls


def test_urls(spark):
    from pyspark.sql import functions as F

    from tidelog.llm.url_filter import judge

    blocked = 0
    for seed in (1, 2):
        urls = some_urls(seed)
        ids = [None if i % 50 == 0 else i // 2 for i in range(len(urls))]
        df = spark.createDataFrame(list(zip(ids, urls, strict=True)), "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "says", "shape", "html", "a.b", "a`b")})
        got = judge(df).collect()
        want = [(i, *x) for i, x in zip(ids, urls_by_hand(urls), strict=True)]
        assert sorted(map(repr, ((*r[:-1], round(r[-1], 9)) for r in got))) == sorted(map(repr, want))
        blocked += sum(r.verdict == "block" and r.rule is None for r in got)
    assert blocked > 0
    assert judge(df.limit(0)).collect() == []


def test_no_label_allows_all(spark):
    from tidelog.llm.url_filter import judge

    df = spark.createDataFrame([(i, f"http://h.net/a/{i}") for i in range(20)] + [(None, None)], "page_id long, url string")
    assert {r.verdict for r in judge(df).collect()} == {"allow"}
