"""Precision and recall of added secrets on lines of installed packages, whose authors wrote them for other ends; keys are put in the place of half of them."""

import base64
import glob
import os
import random
import string
import sysconfig

import pytest

from tidelog.llm import secrets as s


@pytest.fixture(scope="module")
def packages():
    """(lines, words): (before, string, after) of every string in a sensitive context of the packages' sources, each string once; the words of all identifiers."""
    from collections import Counter

    places = [sysconfig.get_paths()["stdlib"], sysconfig.get_paths()["purelib"], *glob.glob("/usr/lib/python3*")]
    files = sorted({f for d in places for f in glob.glob(os.path.join(d, "**", "*.py"), recursive=True)})
    lines: dict = {}
    counts: Counter = Counter()
    for f in files[::2]:
        try:
            with open(f, encoding="utf-8") as h:
                text = h.read()
        except (OSError, UnicodeDecodeError):
            continue
        counts.update(s.pieces(text))
        for a, _, b in s.novel_spans(text, s.base_spans(text), -1):
            lines.setdefault(text[a:b], (text[max(0, a - 400) : a], text[a:b], text[b : b + 400]))
    for f in files[1::2]:
        try:
            with open(f, encoding="utf-8") as h:
                text = h.read()
        except (OSError, UnicodeDecodeError):
            continue
        for a, _, b in s.novel_spans(text, s.base_spans(text), -1):
            lines.setdefault(text[a:b], (text[max(0, a - 400) : a], text[a:b], text[b : b + 400]))
    words = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1] * len(x[0]), x[0])) if n >= s.LEAST][:6000]
    return list(lines.values()), tuple(reversed(words))


def _key(rng, i):
    letters = string.ascii_letters + string.digits
    draw = lambda of, lo, hi: "".join(rng.choices(of, k=rng.randint(lo, hi)))
    return (
        base64.b64encode(rng.randbytes(rng.randint(15, 60))).decode(), base64.urlsafe_b64encode(rng.randbytes(rng.randint(15, 40))).decode().rstrip("="), draw(letters, 20, 64), draw(string.ascii_lowercase + string.digits, 20, 40),
        rng.randbytes(16).hex(), "sk_live_" + draw(letters, 24, 24), "ghp_" + draw(letters, 36, 36),
    )[i % 7]


def test_precision_and_recall(packages):
    lines, words = packages
    if len(lines) < 150:
        pytest.skip(f"too few packages are installed here: {len(lines)} lines")
    rng = random.Random(4)
    score = lambda a, x, b: s.novelty_of((a + b).encode(), x, words)
    wrong = sum(score(*line) >= s.NOVELTY for line in lines)
    right = sum(score(a, _key(rng, i), b) >= s.NOVELTY for i, (a, _, b) in enumerate(lines))
    print(f"{2 * len(lines)} lines: recall {right / len(lines):.3f}, precision {right / (right + wrong):.3f}")
    assert right / len(lines) >= 0.93 and right / (right + wrong) >= 0.93


def test_identifiers_and_links_are_not_keys(packages):
    for text in ("token: see https://docs.example.org/guides/2024/getting-started/authentication-overview.html", "signature of getCustomerOrderHistoryByDate20240115", "auth/v2/internal/OrderController2.createSubscriptionPlan"):
        assert s.scan(text, identifiers=packages[1])[1] == [], text


def test_words_of_the_corpus(spark):
    docs = spark.createDataFrame([(i, "call secret getCustomerOrders20 and XMLHttpRequest.openConnection9 now") for i in range(4)] + [(9, None), (10, ""), (11, "x" * 40 + "Rare-word-once-in-all")], "doc_id long, text string")
    words = s.identifier_words(docs)
    assert {"Customer", "Orders", "XML", "Http", "Request", "Connection", "open"} <= set(words) and "Rare" not in words
    assert s.identifier_words(docs.limit(0)) == ()
    assert s.alphabet("00ff12ab") == "0123456789abcdef" and s.alphabet("aB1/") == string.ascii_lowercase + string.ascii_uppercase + string.digits + "/"
