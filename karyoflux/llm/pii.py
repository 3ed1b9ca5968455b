"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

Patterns find e-mail addresses, IPv4 addresses, card and phone numbers; their spans always stay. The random field then labels
the rest of the text in segments. A segment is a run of at most MAX_TOKENS tokens with a type, or one token outside; its score
is a sum of weights of features of the whole span (its shape, length, digits, the words before it), and one for the change of
type between neighbours. Weights maximise the conditional likelihood of whole labellings, with the partition sum over all
segmentations by the forward recursion; the best labelling comes from the same recursion with maxima, so boundaries and types
are chosen jointly.

It is trained here on drawn examples (train()), which need no labelled text: spans of each kind in the forms the patterns
know and in forms they don't (quoted tokens, keys, account numbers, phones without a plus, addresses spelled out), between
neutral words and near misses.

Every entity holds a digit or an at sign (may()) and has at most MAX_TOKENS tokens, so only windows of that many tokens around
each digit run and at sign are decoded, with the words before them that features look at. All else is outside in every
labelling, and the spans are those of decoding the whole text. Added kinds: secret, account, contact. Added spans that overlap
a pattern's span give way to it.

Null counts as empty text and has no spans. Texts are read whole; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyoflux.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "contact")
LABELS = ("O", *ADDED)
#: Enough for account numbers in groups of four and phones in pairs with signs between.
MAX_TOKENS = 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start and then kind as listed; offsets are code points."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b in _addresses(text)]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 14 and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from the at signs in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+) with parts of at most 255: each four parts of a dotted run."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + len(".".join(four))
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield at, end
                at = end + 1


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# -- the random field -----------------------------------------------------------------------------------------------------
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_MIXED = re.compile(r"[A-Za-z0-9_-]{16,}")
# Words that announce an entity, in the languages of the examples.
TRIGGERS = {
    "secret": "token key secret password passwd pwd apikey bearer credential passwort clave contraseña jeton",
    "account": "iban account konto cuenta compte ssn passport tax social insurance",
    "contact": "phone tel telefon téléphone teléfono mobile call fax email mail contact",
}
_TRIGGER = {w: k for k, words in TRIGGERS.items() for w in words.split()}
#: Tokens before a span that its features look at.
CONTEXT = 4
_CANDIDATE = re.compile(r"\d|@|\(at\)|\[at\]")


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of runs: long mixed runs whole, else letters, digits and single signs."""
    out, at = [], 0
    for m in _MIXED.finditer(text):
        if _DIGIT.search(m[0]):
            out += [(t.start(), t.end()) for t in _TOKEN.finditer(text, at, m.start())]
            out.append(m.span())
            at = m.end()
    return out + [(t.start(), t.end()) for t in _TOKEN.finditer(text, at)]


def span_features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Names of the features of the segment of tokens i to j (exclusive)."""
    a, b = toks[i][0], toks[j - 1][1]
    s = text[a:b]
    digits = sum(c.isdecimal() for c in s)
    letters = sum(c.isalpha() for c in s)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "9", s))
    out = [
        f"len{min(len(s) // 8, 6)}", f"dig{min(digits // 3, 6)}", f"tok{j - i}", f"shape:{shape[:12]}" if len(shape) <= 12 else "shape:long",
        f"mix{int(digits > 0 and letters > 0)}", f"hex{int(len(s) >= 20 and not re.search('[^0-9A-Fa-f]', s))}", f"sep{int(' ' in s)}", f"line{int(chr(10) in s)}",
        f"at{int('@' in s or '(at)' in s or '[at]' in s)}", f"edge{int(s[0].isalnum())}{int(s[-1].isalnum())}",
    ]
    seen = [text[x:y].lower() for x, y in toks[max(0, i - 4) : i] if text[x].isalpha()]
    for w in seen[-3:]:
        if w in _TRIGGER:
            out.append(f"after:{_TRIGGER[w]}")
            out.append(f"after:{_TRIGGER[w]}&mix{int(digits > 0 and letters > 0)}&dig{min(digits // 3, 6)}")
    if i and text[toks[i - 1][0]] in "\"'" and b < len(text) and text[b] in "\"'":
        out.append("quoted")
    if digits:
        out.append(f"whole{int((a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()))}")
    return out


class Field:
    """Weights by (label, feature) and label pair; lattices are scored by segments of at most MAX_TOKENS tokens."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.w = weights or {}

    def may(self, text: str, toks: list[tuple[int, int]], i: int, j: int) -> bool:
        """Entities start and end in a letter or digit, hold a digit or an at sign, and stay in a line."""
        a, b = toks[i][0], toks[j - 1][1]
        s = text[a:b]
        return s[0].isalnum() and s[-1].isalnum() and len(s) >= 6 and "\n" not in s and _CANDIDATE.search(s) is not None

    def arcs(self, text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int, int, list[str]]]:
        """(i, j, label, features) of every segment that may be one."""
        return [(i, j, k, f) for i, j, kinds, f in self.segments(text, toks) for k in kinds]

    def segments(self, text: str, toks: list[tuple[int, int]]) -> Iterator[tuple[int, int, range, list[str]]]:
        """(i, j, labels, features), by start, so that no more than one span's features are held at a time."""
        for i, (a, b) in enumerate(toks):
            yield i, i + 1, range(1), [f"o:{f}" for f in span_features(text, toks, i, i + 1)] if any(c.isdecimal() for c in text[a:b]) else ["o:plain"]
            if not text[a].isalnum() or not _CANDIDATE.search(text, a, toks[min(len(toks), i + MAX_TOKENS) - 1][1]):
                continue
            for j in range(i + 1, min(len(toks), i + MAX_TOKENS) + 1):
                if self.may(text, toks, i, j):
                    yield i, j, range(1, len(LABELS)), span_features(text, toks, i, j)

    def score(self, label: int, features: list[str]) -> float:
        name = LABELS[label]
        return sum(self.w.get((name, f), 0.0) for f in features)

    def best(self, text: str, toks: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The spans of the labelling with the greatest score; ties go to the earlier arc, so to outside."""
        n, size = len(toks), len(LABELS)
        move = [[self.w.get((p, f"next:{k}"), 0.0) for p in LABELS] for k in LABELS]
        top = np.full((n + 1, size), -np.inf).tolist()
        top[0][0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        into, at = [], -1
        for i, j, kinds, f in self.segments(text, toks):
            if i > at:  # segments come in order of their start, so top[i] is complete
                at = i
                into = [max((top[i][p] + move[k][p], -p) for p in range(size)) for k in range(size)]
            for k in kinds:
                x, p = into[k]
                if (x := x + self.score(k, f)) > top[j][k]:
                    top[j][k], back[j, k] = x, (i, -p)
        at, out = (n, top[n].index(max(top[n]))), []
        while at[0] > 0:
            i, p = back[at]
            if at[1]:
                out.append((LABELS[at[1]], toks[i][0], toks[at[0] - 1][1]))
            at = (i, p)
        return out[::-1]

    def gradient(self, text: str, toks: list[tuple[int, int]], gold: set[tuple[int, int, int]]) -> dict[tuple[str, str], float]:
        """Observed less expected feature counts of one example; gold holds (i, j, label) of its entities."""
        n, size, arcs = len(toks), len(LABELS), self.arcs(text, toks)
        move = np.array([[self.w.get((LABELS[p], f"next:{LABELS[k]}"), 0.0) for k in range(size)] for p in range(size)])
        alpha, beta = np.full((n + 1, size), -np.inf), np.full((n + 1, size), -np.inf)
        alpha[0, 0], beta[n] = 0.0, 0.0
        scored = [(i, j, k, f, self.score(k, f)) for i, j, k, f in arcs]
        for i, j, k, _, s in scored:  # arcs come in order of their start, so alpha[i] is complete
            alpha[j, k] = np.logaddexp(alpha[j, k], np.logaddexp.reduce(alpha[i] + move[:, k]) + s)
        for i, j, k, _, s in reversed(scored):
            beta[i] = np.logaddexp(beta[i], move[:, k] + s + beta[j, k])
        total = beta[0, 0]
        inside = {t for i, j, _ in gold for t in range(i, j)}
        out: dict[tuple[str, str], float] = {}
        label_at = {}
        for i, j, k, f, s in scored:
            p = np.exp(alpha[i] + move[:, k] + s + beta[j, k] - total)
            there = (i, j, k) in gold or (k == 0 and i not in inside)
            if there:
                label_at[i] = (j, k)
            d = float(there) - float(p.sum())
            if abs(d) > 1e-6:
                for x in f:
                    out[LABELS[k], x] = out.get((LABELS[k], x), 0.0) + d
            for q in range(size):
                if p[q] > 1e-6:
                    key = (LABELS[q], f"next:{LABELS[k]}")
                    out[key] = out.get(key, 0.0) - float(p[q])
        at, before = 0, 0
        while at < n and at in label_at:
            j, k = label_at[at]
            key = (LABELS[before], f"next:{LABELS[k]}")
            out[key] = out.get(key, 0.0) + 1.0
            at, before = j, k
        return out


def examples(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Drawn texts with their spans: entities in many forms among neutral words and near misses."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "la", "de", "ich", "ung", "ción", "eau", "st"]) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k, up: "".join(r.choice("0123456789ABCDEF" if up else "0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k - 1)) + r.choice("0123456789")

    def trigger(kind):
        w = r.choice(TRIGGERS[kind].split())
        return r.choice([w, w.upper(), w.capitalize()])

    def entity():
        kind = r.choice(ADDED)
        if kind == "secret" and r.random() < 0.4:  # a password that someone chose, told from other words by what is before it
            w = r.choice(["password", "passwd", "pwd", "passwort", "contraseña", "clave"])
            q = r.choice(['"', "'", "", "", ""])
            v = r.choice([f"{word()}{digits(r.randint(1, 4))}{word()}", f"{word()}{digits(r.randint(2, 6))}", f"{word().capitalize()}{digits(2)}{r.choice('-_.&!')}{word()}{digits(1)}"])
            v = v if len(v) >= 6 else v + digits(6 - len(v))
            w = r.choice([w, w.upper(), w.capitalize()])
            return r.choice([f"{w}: {q}", f"{w} = {q}", f"{w}={q}", f"{w} is {q}"]), kind, v, q
        if kind == "secret":
            v = r.choice([hexes(r.choice([32, 40, 64]), r.random() < 0.3), mixed(r.randint(20, 44)), "AKIA" + hexes(16, True), "sk-" + mixed(32)])
            q = r.choice(['"', '"', "'", ""])
            return r.choice([f"{trigger(kind)} = {q}", f"{trigger(kind)}: {q}", f"{trigger(kind)}={q}", q]), kind, v, q
        if kind == "account":
            v = r.choice([r.choice(["DE", "FR", "ES", "GB"]) + digits(20), r.choice(["DE", "FR", "ES", "GB"]) + f"{digits(2)} " + " ".join(digits(4) for _ in range(r.randint(4, 6))) + f" {digits(2)}", f"{digits(3)}-{digits(2)}-{digits(4)}", digits(r.randint(8, 12))])
            return r.choice([f"{trigger(kind)} ", f"{trigger(kind)}: ", f"{trigger(kind)} no. "]), kind, v, ""
        pairs = r.choice(" .-").join(["0" + digits(1), *(digits(2) for _ in range(4))])
        v = r.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(2)} {digits(3)} {digits(3)}", pairs, f"{word()}{r.choice(['', digits(2)])}{r.choice(['(at)', '[at]'])}{word()}"])
        return r.choice([f"{trigger(kind)} ", f"{trigger(kind)}: ", f"{trigger(kind)}. "]), kind, v, ""

    def near_miss():
        return r.choice([f"version {digits(1)}.{digits(1)}", f"CC BY-NC {digits(1)}.0", digits(r.randint(1, 16)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"page {digits(6)}", f"{word()}{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(7)}.{digits(3)}", f"no. {digits(7)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"])

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(0, 5))), []
        for _ in range(r.randint(0, 2)):
            if r.random() < 0.5:
                lead, kind, value, tail = entity()
                text += f" {lead}"
                spans.append((kind, len(text), len(text) + len(value)))
                text += f"{value}{tail}"
            else:
                text += f" {near_miss()}"
            text += r.choice([" ", ", ", ".\n", " | ", "!! "]) + " ".join(word() for _ in range(r.randint(0, 5)))
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def train(n: int = 400, rounds: int = 4, seed: int = 11) -> Field:
    """A field fitted by AdaGrad steps on n drawn examples; the same n, rounds and seed give the same weights."""
    field, squares, order = Field(), {}, random.Random(seed)
    drawn = examples(n, seed)
    for _ in range(rounds):
        order.shuffle(drawn)
        for text, spans in drawn:
            toks = tokens(text)
            starts, ends = {a: i for i, (a, _) in enumerate(toks)}, {b: i + 1 for i, (_, b) in enumerate(toks)}
            gold = {(starts[a], ends[b], LABELS.index(k)) for k, a, b in spans if a in starts and b in ends and ends[b] - starts[a] <= MAX_TOKENS and field.may(text, toks, starts[a], ends[b])}
            for key, g in field.gradient(text, toks, gold).items():
                g -= 0.002 * field.w.get(key, 0.0)
                squares[key] = squares.get(key, 0.0) + g * g
                field.w[key] = field.w.get(key, 0.0) + 0.5 * g / (1e-3 + squares[key] ** 0.5)
    return field


def windows(text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of tokens around candidates that the field decodes, merged where they meet.

    A span that holds a candidate starts fewer than MAX_TOKENS tokens before it and ends fewer than that after it; one more token
    on each side, where there is one, is outside.
    """
    out: list[list[int]] = []
    k = 0
    for m in _CANDIDATE.finditer(text):
        while k < len(toks) and toks[k][1] <= m.start():
            k += 1
        a, b = max(0, k - MAX_TOKENS - CONTEXT), min(len(toks), k + MAX_TOKENS + 3)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def added_spans(text: str, field: Field, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the field finds besides base."""
    if not _CANDIDATE.search(text):
        return []
    toks = tokens(text)
    found = [s for a, b in windows(text, toks) for s in field.best(text, toks[a:b])]
    return [s for s in found if not any(s[1] < b and a < s[2] for _, a, b in base)]


def all_spans(text: str | None, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(pattern spans, all spans): the second holds the first."""
    text = text or ""
    base = pattern_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}
    return base, sorted(base + added_spans(text, field, base), key=lambda s: (s[1], order[s[0]]))


def find(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), field: Field | None = None) -> DataFrame:
    """`keep`, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, and spans as kind:start:end joined by commas.

    The field is broadcast; it has some hundred weights.
    """
    sent = df.sparkSession.sparkContext.broadcast((field or train()).w)
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    @F.pandas_udf("struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = Field(sent.value)
        for s in batches:
            rows = []
            for t in s:
                base, every = all_spans(t, f)
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            yield pd.DataFrame(rows, columns=names)

    small_batches(df.sparkSession)
    return df.select(*keep, run(F.col(text)).alias("_found")).select(*keep, "_found.*")


def redact(df: DataFrame, text: str = "text", out: str = "redacted", field: Field | None = None) -> DataFrame:
    """df with `out`: the text with each span replaced by its kind in angle brackets. Null stays null."""
    sent = df.sparkSession.sparkContext.broadcast((field or train()).w)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Field(sent.value)
        for s in batches:
            yield pd.Series([None if t is None else _masked(t, all_spans(t, f)[1]) for t in s], dtype=object)

    small_batches(df.sparkSession)
    return df.withColumn(out, run(F.col(text)))


def _masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for k, a, b in spans:
        if b > at:
            out += [text[at : max(a, at)], f"<{k}>" if a >= at else ""]
            at = b
    return "".join(out) + text[at:]
