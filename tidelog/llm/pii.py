"""Personal data: base patterns, and a character BiLSTM with CRF transitions that finds spans the patterns miss.

The tagger reads windows of WINDOW characters that start every STEP characters, so neighbours overlap by half. Forward-backward over the CRF
gives each window's tag posteriors. They are reconciled over the document: each character takes its tag from the window in which it lies most
centrally, and runs of tags, whichever windows they come from, are the spans. So a span may be of any length and lie anywhere; when
a run of tags reaches the end of what was decoded, the windows beyond are decoded too, until none does. Base spans stay; a span of the
tagger is added when it touches none of them, is certain enough on average and passes `plausible` (for instance the Luhn sum of a card).

Every span holds an anchor (`plausible` demands it): a digit, an @, "at" in brackets, or a bare "at" with a name and a dot behind it. A window with no
anchor in reach is therefore not run; that changes no result (tests run all windows, too). Training is numpy back-propagation through time with Adam, from labelled spans (`labelled_spans` makes texts
with known spans by rule; any list of (text, [(kind, start, end)]) will do). It depends on the seed alone and is kept per process.

Results: a null text is an empty one (`masked` leaves it null). Ids may be null or repeat, and rows that repeat are read one by one; an empty
table gives no row. Very long texts are read whole. Columns other than doc_id and text are not read; `masked` passes them on and counts
n_chars, if there is one, anew. No shuffle; offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
WINDOW, STEP = 128, 64
#: Characters on either side of an anchor that are decoded at first.
REACH = 48

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order. Each pattern is matched in linear time: a run that cannot match is read once."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:  # the local part is the run of its characters before the @, from the last match on
        a = at
        while a > done and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            out.append((a, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # no local part reaches over an @
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_AT = r"(?:@|[\[({<]\s?at\s?[\])}>]|\bat\b)"
_DOT = r"(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>]|\bdot\b)"
#: What `mailbox` and the digits of the other kinds cannot do without. A bare "at" has one space behind it, so no two look at the same name.
ANCHOR = re.compile(rf"[0-9@]+|[\[({{<]\s?at\s?[\])}}>]|\bat(?=-|\s[\w-]++\s?{_DOT}\s?[\w-])", re.I)
_ATS, _DOTS, _DOT_BEFORE = re.compile(_AT, re.I), re.compile(rf"\s?{_DOT}\s?", re.I), re.compile(rf"\s?{_DOT}\s?\Z", re.I)
_LOCALS, _NAMES, _TOP = re.compile(r"[\w.%+-]+"), re.compile(r"[\w-]+"), re.compile(r"[A-Za-z]{2,}")
#: No spelling of a dot is as long.
_DOT_LENGTH = 12


def mailboxes(s: str):
    """(start, end) around each "at" of a text that has a mailbox: local parts joined by dots, the at, names joined by dots, of which the last is all letters; the
    widest in both directions. Runs of characters are found once and chains of them remembered, so time is linear."""
    ats = [m.span() for m in _ATS.finditer(s)]
    if not ats:
        return
    local, name = [m.span() for m in _LOCALS.finditer(s)], [m.span() for m in _NAMES.finditer(s)]
    local_at, name_at = [a for a, _ in local], [a for a, _ in name]
    begins: dict[int, int] = {}
    ends: dict[int, int | None] = {}

    def run_of(runs, starts, at):
        k = bisect.bisect_right(starts, at) - 1
        return k if k >= 0 and runs[k][1] > at else -1

    def begin(k):
        """Where the chain of local parts that ends in run k begins."""
        chain = []
        while k not in begins:
            chain.append(k)
            a = local[k][0]
            m = _DOT_BEFORE.search(s, max(0, a - _DOT_LENGTH), a)
            if not m and s[a] == "." and a + 1 < local[k][1]:  # the run's own first dot joins it to what stands before a space
                m = _DOT_BEFORE.search(s, max(0, a - _DOT_LENGTH), a + 1)
            before = run_of(local, local_at, m.start() - 1) if m and m.start() else -1
            if before < 0 or before >= k:
                begins[k] = a
            else:
                k = before
        for c in reversed(chain):
            begins[c] = begins[k]
        return begins[k]

    def end(k):
        """Where the chain of names that starts in run k ends: behind its last name of letters; None if there is none after a dot."""
        chain = []
        while k not in ends:
            m = _DOTS.match(s, name[k][1])
            after = run_of(name, name_at, m.end()) if m else -1
            if after <= k or name[after][0] != m.end():
                ends[k] = None
            else:
                chain.append((k, after))
                k = after
        for k, after in reversed(chain):
            ends[k] = ends[after] if ends[after] is not None else (name[after][1] if _TOP.fullmatch(s, *name[after]) else None)
        return ends[chain[0][0] if chain else k]

    for a, b in ats:
        left = run_of(local, local_at, a - 1)
        if left < 0 and a > 1 and s[a - 1].isspace():
            left = run_of(local, local_at, a - 2)
        right = run_of(name, name_at, b)
        if right < 0 and b < len(s) and s[b].isspace():
            right = run_of(name, name_at, b + 1)
        if left >= 0 and right >= 0 and (to := end(right)) is not None:
            yield begin(left), to


_PARTS = re.compile(rf"\s?{_DOT}\s?", re.I)
_EDGE = " \t\r\n.,;:!?\"'"


def plausible(kind: int, s: str) -> bool:
    """What a span of the tagger must be to be added."""
    d = _digits(s)
    if kind == 0:
        return (0, len(s)) in mailboxes(s)
    if kind == 1:
        parts = _PARTS.split(s)
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return not re.search(r"[^0-9 ./_-]", s) and 12 <= len(d) <= 19 and luhn(d)
    return not re.search(r"[^0-9 ()./+-]", s) and 9 <= len(d) <= 15


# ---- labelled spans -------------------------------------------------------------------------------------------------------------


def labelled_spans(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts of made-up words with spans of each kind in several spellings, and look-alikes that are none."""
    rng = random.Random(seed)
    letters = "eeeeaaaiioonnttrrsslldhcumpgfbvwyzéèüößñ"
    choice = rng.choice

    def word():
        if rng.random() < 0.08:
            return choice(["at", "dot", "the", "mail", "call", "card", "server", "at", "de", "und", "le"])
        w = "".join(choice(letters) for _ in range(rng.randint(1, 10)))
        return (w.capitalize() if rng.random() < 0.1 else w) + choice(["", "", "", "", ",", ".", ":"])

    def number(k):
        return "".join(choice("0123456789") for _ in range(k))

    def name():
        return "".join(choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 12)))

    def email():
        at, dot = choice([("@", "."), ("@", "."), ("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "{dot}"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", "."), ("@", " . "), (" @ ", " . "), (" at ", " dot "), ("(at)", "."), (" AT ", " DOT ")])
        local = choice(["", ".", "_", "-"]).join(choice([name(), name(), number(rng.randint(1, 4))]) for _ in range(rng.randint(1, 3)))
        host = dot.join(name() + choice(["", "", "", number(1), "-" + name()]) for _ in range(rng.randint(1, 3)))
        return f"{local}{at}{host}{dot}{choice(['com', 'org', 'net', 'example', 'de', 'fr', 'es', 'info', 'edu'])}"

    def ip():
        return choice([".", ".", "[.]", "(.)", "[dot]", "(dot)", " . ", "{.}", " dot "]).join(str(choice([rng.randint(0, 255), rng.randint(0, 9), 10, 192])) for _ in range(4))

    def card():
        d = number(choice([12, 13, 14, 15, 15, 15, 15, 17, 18]))
        d += next(c for c in "0123456789" if luhn(d + c))
        cut = choice([4, 4, 4, len(d), 5])
        return choice([" ", "-", ".", "/", "_", "  ", " - "]).join(d[i : i + cut] for i in range(0, len(d), cut))

    def phone():
        a, b, c = number(3), number(3), number(4)
        sep = choice(["-", ".", " ", "/", " - "])
        return choice([f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {number(6)}", f"({a}) {b}{sep}{c}", f"{a}{sep}{b}{sep}{c}", f"({a}){b}-{c}", f"0{number(2)} {number(4)} {number(4)}", f"0{number(3)}/{number(6)}", f"00{number(2)} {a} {b} {c}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}"])

    def decoy():
        return choice([
            number(rng.randint(1, 11)), f"{number(1)}.{number(1)}.{number(2)}", f"{number(1)}.{number(2)}", f"20{number(2)}-0{number(1)}-1{number(1)}", f"{number(2)}:{number(2)}", f"{number(3)},{number(3)}", f"#{number(4)}", f"{name()}{number(3)}",
            f"@{name()}", f"{number(8)}{name()}", f"{number(3)}/{number(2)}", f"{name()} at {name()}", f"at {number(1)} {name()}", f"19{number(2)}-19{number(2)}", f"{number(2)} {name()} 20{number(2)}", f"{name()} (at {name()})", f"{number(2)} - {number(2)}", f"{name()} @ {name()}", f"{number(2)}.{number(2)}.20{number(2)}",
            f"{number(1)},{number(3)},{number(3)}.{number(2)}", f"v{number(1)}.{number(1)}.{number(1)}", f"{number(3)}-{number(1)}-{number(2)}-{number(5)}", f"{name()} dot {name()}",
        ])

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 8))), []
        for _ in range(rng.randint(1, 3)):
            if text:
                text += choice([" ", " ", " ", "\n", " (", " <"])
            kind = choice([0, 0, 1, 2, 3, 4, 4])
            s = (email, ip, card, phone, decoy)[kind]()
            if kind < 4:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + choice([" ", " ", " ", ", ", ". ", ") ", "\n"]) + " ".join(word() for _ in range(rng.randint(0, 8)))
        out.append((text, spans))
    return out


# ---- the tagger -----------------------------------------------------------------------------------------------------------------

N_CHARS = 72


def char_codes(text: str) -> np.ndarray:
    """A class for each code point: digits, signs and letters of ASCII apart, other letters and the rest together."""
    p = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _CODES[np.minimum(p, 256)]


def _codes() -> np.ndarray:
    out = np.full(257, 1, np.int64)  # 0: padding, 1: not ASCII
    shown = [chr(c) for c in range(32, 127) if not chr(c).isupper()]
    for i, c in enumerate(shown):
        out[ord(c)] = out[ord(c.upper())] = i + 2
    out[[9, 10, 13]] = out[32]
    return out


_CODES = _codes()
N_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Embedding -> LSTM each way -> linear emissions -> CRF. Arrays are (batch, time, ...); both ways run side by side, (way, batch, time, ...)."""

    def __init__(self, hidden: int = 20, size: int = 10, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        p = {"emb": rng.normal(0, 0.3, (N_CHARS, size)), "out": rng.normal(0, 0.2, (2 * hidden, N_TAGS)), "out_b": np.zeros(N_TAGS), "trans": rng.normal(0, 0.05, (N_TAGS, N_TAGS)), "start": np.zeros(N_TAGS)}
        p["w"] = rng.normal(0, 1 / np.sqrt(size + hidden), (2, size + hidden, 4 * hidden))
        p["b"] = np.tile(np.concatenate([np.ones(hidden), np.zeros(3 * hidden)]), (2, 1, 1))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _lstm(self, x, keep):
        _, n, t, size = x.shape
        hid, w = self.hidden, self.p["w"]
        base = x @ w[:, None, :size] + self.p["b"][:, None]
        h, c = np.zeros((2, n, hid), np.float32), np.zeros((2, n, hid), np.float32)
        out, past = np.empty((2, n, t, hid), np.float32), []
        for k in range(t):
            z = base[:, :, k] + h @ w[:, size:]
            s = _sigmoid(z[..., : 3 * hid])
            f, i, o = s[..., :hid], s[..., hid : 2 * hid], s[..., 2 * hid :]
            g = np.tanh(z[..., 3 * hid :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, :, k] = h
            if keep:
                past.append((last, f, i, o, g, before, tc))
        return out, past

    def _lstm_back(self, grad, past, x):
        _, n, t, hid = grad.shape
        w, size = self.p["w"], x.shape[3]
        dz = np.empty((2, n, t, 4 * hid), np.float32)
        dh, dc = np.zeros((2, n, hid), np.float32), np.zeros((2, n, hid), np.float32)
        back = w[:, size:].transpose(0, 2, 1)
        for k in reversed(range(t)):
            _, f, i, o, g, before, tc = past[k]
            dh = dh + grad[:, :, k]
            dc = dc + dh * o * (1 - tc * tc)
            d = np.concatenate([dc * before * f * (1 - f), dc * g * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 2)
            dz[:, :, k] = d
            dh, dc = d @ back, dc * f
        joined = np.concatenate([x, np.stack([p[0] for p in past], 2)], 3).reshape(2, n * t, -1)
        flat = dz.reshape(2, n * t, -1)
        return dz @ w[:, None, :size].transpose(0, 1, 3, 2), joined.transpose(0, 2, 1) @ flat, flat.sum(1, keepdims=True)

    def emissions(self, codes: np.ndarray, keep: bool = False):
        x = self.p["emb"][np.stack([codes, codes[:, ::-1]])]
        h, past = self._lstm(x, keep)
        both = np.concatenate([h[0], h[1][:, ::-1]], 2)
        return both @ self.p["out"] + self.p["out_b"], (x, both, past)

    def _chain(self, e: np.ndarray):
        """Forward and backward messages of the CRF, each scaled to sum 1, the potentials, and the log normaliser."""
        n, t, _ = e.shape
        top = e.max(2, keepdims=True)
        trans, e = np.exp(self.p["trans"]), np.exp(e - top)
        a, b, z = np.empty_like(e), np.empty_like(e), top.sum((1, 2), dtype=np.float64)
        for k in range(t):
            x = e[:, 0] * np.exp(self.p["start"]) if not k else (a[:, k - 1] @ trans) * e[:, k]
            total = x.sum(1, keepdims=True)
            a[:, k], z = x / total, z + np.log(total[:, 0])
        b[:, -1] = 1
        for k in reversed(range(t - 1)):
            x = (b[:, k + 1] * e[:, k + 1]) @ trans.T
            b[:, k] = x / x.sum(1, keepdims=True)
        return a, b, e, trans, z

    def loss(self, codes: np.ndarray, tags: np.ndarray):
        """Negative log-likelihood per window, and gradients."""
        e, (x, both, past) = self.emissions(codes, True)
        n, t, _ = e.shape
        a, b, pot, trans, z = self._chain(e)
        gamma = a * b
        gamma /= gamma.sum(2, keepdims=True)
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(t), tags].sum() + self.p["start"][tags[:, 0]].sum() + self.p["trans"][tags[:, :-1], tags[:, 1:]].sum()
        de = gamma.copy()
        de[rows, np.arange(t), tags] -= 1
        de /= n
        right = pot[:, 1:] * b[:, 1:]
        left = a[:, :-1] / np.maximum(((a[:, :-1] @ trans) * right).sum(2, keepdims=True), 1e-30)
        pairs = (left.reshape(n * (t - 1), -1).T @ right.reshape(n * (t - 1), -1)) * trans
        np.subtract.at(pairs, (tags[:, :-1], tags[:, 1:]), 1)
        start = gamma[:, 0].sum(0)
        np.subtract.at(start, tags[:, 0], 1)
        grads = {"trans": pairs / n, "start": start / n, "out": both.reshape(n * t, -1).T @ de.reshape(n * t, -1), "out_b": de.sum((0, 1))}
        dboth = de @ self.p["out"].T
        dx, grads["w"], grads["b"] = self._lstm_back(np.stack([dboth[:, :, : self.hidden], dboth[:, ::-1, self.hidden :]]), past, x)
        dx = (dx[0] + dx[1][:, ::-1]).reshape(n * t, -1)
        flat = codes.ravel()
        grads["emb"] = np.column_stack([np.bincount(flat, dx[:, j], N_CHARS) for j in range(dx.shape[1])]).astype(np.float32)
        return float(z.sum() - gold) / n, grads

    def posteriors(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest tag of each character under the CRF (forward-backward), and its probability."""
        a, b, *_ = self._chain(self.emissions(codes)[0])
        a *= b
        return a.argmax(2), a.max(2) / a.sum(2)


def train_tagger(examples, epochs: int = 12, batch: int = 128, rate: float = 0.03, seed: int = 0) -> Tagger:
    """From (text, [(kind, start, end)]); of a longer text a window anywhere is taken, so that cut spans are learned too."""
    rng = np.random.default_rng(seed)
    codes, tags = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
    for i, (text, spans) in enumerate(examples):
        x = char_codes(text)
        y = np.zeros(len(x), np.int64)
        for kind, a, b in spans:
            y[a:b] = 2 + 2 * kind
            y[a] = 1 + 2 * kind
        at = int(rng.integers(0, max(len(x) - WINDOW, 0) + 1))
        part = slice(at, at + WINDOW)
        codes[i, : len(x[part])], tags[i, : len(x[part])] = x[part], y[part]
    tagger = Tagger(seed=seed)
    m, v, step = {k: 0.0 for k in tagger.p}, {k: 0.0 for k in tagger.p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, grads = tagger.loss(codes[rows], tags[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                move = rate * 0.8**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                tagger.p[k] = (tagger.p[k] - move).astype(np.float32)
    return tagger


@functools.lru_cache(2)
def default_tagger(n: int = 4000, seed: int = 11) -> Tagger:
    return train_tagger(labelled_spans(n, seed), seed=seed)


# ---- decoding whole texts -------------------------------------------------------------------------------------------------------


def _owner(at: int, n: int) -> int:
    """The window in which character `at` of n lies most centrally; window k starts at k * STEP."""
    return min(max(0, (at - (WINDOW - STEP) // 2) // STEP), max(0, -(-(n - WINDOW) // STEP)))


def _own(k: int, n: int) -> tuple[int, int]:
    """The characters that window k answers for."""
    edge = (WINDOW - STEP) // 2
    last = k == max(0, -(-(n - WINDOW) // STEP))
    return (k * STEP + edge if k else 0), (n if last else k * STEP + edge + STEP)


def _runs(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, mean certainty) of the runs of tags that are not outside; the commonest kind names a run."""
    kind = (tags + 1) // 2  # 0 outside
    edge = np.flatnonzero(np.diff(kind > 0, prepend=False, append=False))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append((a, b, int(np.bincount(kind[a:b]).argmax()) - 1, float(sure[a:b].mean())))
    return out


def tagged_spans(tagger: Tagger, texts: list[str], least: float, batch: int = 256, anchor: re.Pattern = ANCHOR) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of the tagger in each text, certain by `least` on average, without spaces and marks at their ends."""
    known: list[dict] = [{} for _ in texts]
    spans: list[list] = [[] for _ in texts]
    wanted = {}
    for i, text in enumerate(texts):
        reach = set()
        for m in anchor.finditer(text):
            reach.update(range(_owner(max(0, m.start() - REACH), len(text)), _owner(min(len(text) - 1, m.end() + REACH), len(text)) + 1))
        if reach:
            wanted[i] = reach
    while wanted:
        jobs = [(i, k) for i, ks in wanted.items() for k in sorted(ks) if k not in known[i]]
        for at in range(0, len(jobs), batch):
            part = jobs[at : at + batch]
            codes = np.zeros((len(part), WINDOW), np.int64)
            for r, (i, k) in enumerate(part):
                x = char_codes(texts[i][k * STEP : k * STEP + WINDOW])
                codes[r, : len(x)] = x
            for (i, k), tags, sure in zip(part, *tagger.posteriors(codes), strict=True):
                a, b = _own(k, len(texts[i]))
                known[i][k] = tags[a - k * STEP : b - k * STEP], sure[a - k * STEP : b - k * STEP]
        again = {}
        for i in wanted:
            n, ks, more, spans[i] = len(texts[i]), sorted(known[i]), set(), []
            cuts = [0, *[j for j in range(1, len(ks)) if ks[j] != ks[j - 1] + 1], len(ks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                tags, sure = (np.concatenate([known[i][k][c] for k in ks[lo:hi]]) for c in (0, 1))
                base = _own(ks[lo], n)[0]
                if tags[0] and ks[lo] > 0:
                    more.add(ks[lo] - 1)
                if tags[-1] and base + len(tags) < n:
                    more.add(ks[hi - 1] + 1)
                spans[i] += [(base + a, kind, base + b) for a, b, kind, p in _runs(tags, sure) if p >= least]
            if more:
                again[i] = more
        wanted = again
    return [[x for x in (_fitted(texts[i], *_trimmed(texts[i], *s)) for s in spans[i]) if x[0] < x[2]] for i in range(len(texts))]


def _named(kind: int, text: str) -> int | None:
    """The kind that a span of the tagger is added as: its own, else one that its text passes for; the tagger tells extents better than kinds."""
    return next((k for k in (kind, 2, 1, 3, 0) if plausible(k, text)), None)


def _fitted(text: str, a: int, kind: int, b: int) -> tuple[int, int, int]:
    """A span cut to what it names: a mailbox begins at its local part, whatever words the tagger took along."""
    found = next(mailboxes(text[a:b]), None) if kind == 0 else None
    return (a + found[0], kind, a + found[1]) if found else (a, kind, b)


def _inside_word(text: str, a: int, b: int) -> bool:
    """Whether a letter or digit goes on before or after the span."""
    return (a > 0 and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def _trimmed(text: str, a: int, kind: int, b: int) -> tuple[int, int, int]:
    while a < b and text[a] in _EDGE:
        a += 1
    while a < b and text[b - 1] in _EDGE:
        b -= 1
    return a, kind, b


def find(texts: list[str], tagger: Tagger, least: float = 0.7) -> list[tuple[list, list]]:
    """Base spans and added spans of each text."""
    out = []
    for text, more in zip(texts, tagged_spans(tagger, texts, least), strict=True):
        own = base_spans(text)
        # Base spans of different kinds may overlap: the furthest end so far tells whether one reaches into a place.
        starts, reach = [s for s, _, _ in own], list(itertools.accumulate((e for _, _, e in own), max))
        free = lambda a, b, starts=starts, reach=reach: not (k := bisect.bisect_left(starts, b)) or reach[k - 1] <= a
        out.append((own, [(a, named, b) for a, kind, b in more if free(a, b) and not _inside_word(text, a, b) and (named := _named(kind, text[a:b])) is not None]))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, tagger: Tagger | None = None, least: float = 0.7) -> DataFrame:
    """One row per document. The tagger (some 6,500 numbers) travels with the tasks."""
    tagger = tagger or default_tagger()

    def per_slice(ids, data, offsets):
        texts = [str(data[a:b], "utf-8") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        rows = []
        for base, added in find(texts, tagger, least):
            n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added)))
        return [tx.plain_ids(ids), *map(list, zip(*rows, strict=True))]

    return tx.map_documents(docs, per_slice, SCHEMA)


def mask(text: str, spans) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first one's kind stands for all."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, tagger: Tagger | None = None, least: float = 0.7) -> DataFrame:
    """docs with all spans in `text` masked and `n_chars`, if there is one, counted anew; a null text stays null."""
    from .shared import small_batches

    small_batches(docs.sparkSession)
    tagger = tagger or default_tagger()

    def change(texts: pa.Array) -> pa.Array:
        plain = texts.to_pylist()
        spans = find([t or "" for t in plain], tagger, least)
        return pa.array([None if t is None else mask(t, b + a) if b or a else t for t, (b, a) in zip(plain, spans, strict=True)], pa.string())

    change.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    out = docs.withColumn("text", F.arrow_udf(change, "string")("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
