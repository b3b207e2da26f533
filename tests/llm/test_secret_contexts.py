"""Strings in a sensitive context: every word opens its own, and a string is taken whole."""

import random
import string

from tidelog.llm import secrets as s


def _key(n, seed=1):
    return "".join(random.Random(seed).choices(string.ascii_letters + string.digits, k=n))


def _added(text):
    return [text[a:b] for a, _, b in s.scan(text)[1]]


def test_long_strings_are_taken_whole():
    for n in (20, 512, 513, 700, 5000):
        key = _key(n)
        assert _added(f"Authorization: Bearer {key} end") == [key]
    jwt = ".".join(_key(n, n) for n in (100, 1200, 43))
    assert _added(f"the bearer sends {'x' * 20} {jwt}") == [jwt]


def test_a_word_within_the_context_of_another():
    key = _key(20)
    assert _added(f'"token_type": "Bearer", "expires_in": 3600, "access_key_value": "{key}"') == [key]
    assert _added(f"auth, {'z ' * 20}signature of all: {'y ' * 10}{key}") == [key]
    # Each is reported once, and neither another line nor more than 48 characters away.
    assert _added(f"bearer signature {key}") == [key]
    assert _added(f"bearer\n{key}") == [] and _added(f"bearer{' a' * 25} {key}") == []
