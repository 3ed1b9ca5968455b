"""Subword lattice likelihood: the marginal log-probability of a text over all segmentations into a public vocabulary's pieces.

A word is a path of pieces of which the last one ends the word, a text is its words and an end mark, and the probability of a
text is the product of its pieces' probabilities summed over all paths. Pieces never cross a word, so a text's marginal is the
sum of its words' log marginals and that of the end mark. A word's marginal comes from the forward recursion in log space, side
by side for words of about one length. All windows of a word are looked up at once in a hash table of the pieces, which takes less
than reading stored arcs back, so rounds find them anew; long words are worked in blocks of windows.

Words seen in training are also pieces of their own: one more arc from a word's start to its end, with the word's share of the
training tokens. Arcs of vocabulary pieces share the weight u, the share of training tokens that occur once (Good and Turing's
estimate of what is still unseen), arcs of whole words the rest. piece_score is the marginal without the whole-word arcs.

The vocabulary is an existing one and stays as it is. Its scores start from its own order (a Zipf law over its ranks) and are
then fitted to the training rows by expectation maximisation: each round sums every piece's expected uses, by the forward and
backward recursions, over all distinct training words weighted by their counts.

The add-one base needs the training count of every word. Counts are summed over all training rows; the HEAD most frequent ones,
a fixed number, are broadcast, and rarer words of each text meet their counts in a join, so nothing that grows is broadcast.

Null counts as empty text: one token, the end mark. Texts are read whole. Repeated rows get equal results. An empty table gives
no rows; without training rows N is 0 and every word is unknown.
"""

from __future__ import annotations

import itertools
import json
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from karyoflux.llm.bpe import _byte_symbols
from karyoflux.llm.common import small_batches
from karyoflux.runtime import materialize

#: Words whose counts are broadcast at most, and rounds of expectation maximisation.
HEAD, ROUNDS = 200_000, 4
#: Letters of the words that are worked side by side, and windows whose pieces are looked up at once.
SIDE, BLOCK_CELLS = 1 << 14, 1 << 17
#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
#: Words whose lattices a task works together.
TOGETHER = 1 << 14


class Vocabulary:
    """Pieces as bytes: those inside a word, and those that end it; the last id is the end mark's."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]
        back = {ch: b for b, ch in enumerate(_byte_symbols())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for piece, i in model["vocab"].items():
            ends = piece.endswith(suffix)
            symbols = piece[: -len(suffix)] if ends else piece
            if symbols and all(ch in back for ch in symbols):
                (self.final if ends else self.inner)[bytes(back[ch] for ch in symbols)] = i
        self.end = 1 + max([*self.inner.values(), *self.final.values()])
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.pieces = Pieces([(w, 0, i) for w, i in self.inner.items()] + [(w, 1, i) for w, i in self.final.items()], self.end + 1)

    def start(self) -> np.ndarray:
        """Log-probabilities from the vocabulary's order: piece number r has weight 1 / (r + 100); of -inf: ids without a piece."""
        w = np.zeros(self.end + 1)
        ids = np.array([*self.inner.values(), *self.final.values(), self.end])
        w[ids] = 1.0 / (ids + 100.0)
        with np.errstate(divide="ignore"):
            return np.log(w / w.sum())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Pieces:
    """Finds the pieces in windows of words, all windows at once: an open hash table over two polynomials of a window's bytes.

    A polynomial's value in the window [i, j) is the difference of two prefix sums over the power of i, modulo 2 ** 64. The first
    finds the slot and the second must agree as well.
    """

    _BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    _ENDS = np.uint64(0xD6E8FEB86659FD93)  # added to a window that ends its word
    _SPREAD, _BITS = np.uint64(0xFF51AFD7ED558CCD), 18

    def __init__(self, pieces: list[tuple[bytes, int, int]], none: int):
        self.none = none
        self._powers = [np.ones(1, np.uint64) for _ in range(4)]
        self.slots = np.full(1 << self._BITS, none, np.int32)
        self.keys = np.zeros((2, 1 << self._BITS), np.uint64)
        self.probes = 1
        for w, last, i in pieces:
            b = np.frombuffer(w, np.uint8)[:, None]
            sums = self.prefixes(b)
            key = [self._key(s, 0, len(w), k) + self._ENDS * np.uint64(last) for k, s in enumerate(sums)]
            at, tries = int(self._slot(key[0])[0]), 1
            while self.slots[at] != none:
                if self.keys[0, at] == key[0][0] and self.keys[1, at] == key[1][0]:
                    raise ValueError("two pieces of a vocabulary have one key")
                at, tries = (at + 1) % len(self.slots), tries + 1
            self.slots[at], self.keys[0, at], self.keys[1, at] = i, key[0][0], key[1][0]
            self.probes = max(self.probes, tries)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> np.uint64(29))) * self._SPREAD >> np.uint64(64 - self._BITS)).astype(np.int64)

    def powers(self, k: int, n: int) -> np.ndarray:
        """The first n + 1 powers of a base (k = 0, 1) or of its inverse (k = 2, 3)."""
        if len(self._powers[k]) <= n:
            base = self._BASES[k] if k < 2 else pow(self._BASES[k - 2], -1, 1 << 64)
            steps = np.full(max(64, 2 * n), base, np.uint64)
            steps[0] = 1
            self._powers[k] = np.multiply.accumulate(steps)
        return self._powers[k]

    def prefixes(self, letters: np.ndarray) -> list[np.ndarray]:
        """Of letters (place, word), both polynomials' sums before each place."""
        n, words = letters.shape
        out = []
        for k in range(2):
            s = np.zeros((n + 1, words), np.uint64)
            np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * self.powers(k, n)[:n, None], axis=0, out=s[1:])
            out.append(s)
        return out

    def _key(self, s: np.ndarray, first, last, k: int) -> np.ndarray:
        return (s[last] - s[first]) * (self.powers(k + 2, len(s))[first] if np.isscalar(first) else self.powers(k + 2, len(s))[first][:, None])

    def find(self, sums: list[np.ndarray], first: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids (span, word) of the pieces in the windows [first, last) of words of these sizes; none where there is none."""
        ends = np.where(last[:, None] == sizes, self._ENDS, np.uint64(0))
        key = self._key(sums[0], first, last, 0) + ends
        at = self._slot(key)
        hit = (self.keys[0][at] == key) & (self.slots[at] != self.none)
        ids = np.where(hit, self.slots[at], self.none)
        more = np.nonzero((~hit & (self.slots[at] != self.none)).ravel())[0]
        at = at.ravel()[more]
        for _ in range(self.probes - 1):
            if not len(more):
                break
            at = (at + 1) % len(self.slots)
            good = (self.keys[0][at] == key.ravel()[more]) & (self.slots[at] != self.none)
            ids.ravel()[more[good]] = self.slots[at[good]]
            more, at = (x[~good & (self.slots[at] != self.none)] for x in (more, at))
        span, word = np.nonzero(ids != self.none)
        second = (sums[1][last[span], word] - sums[1][first[span], word]) * self.powers(3, len(sums[1]))[first[span]] + ends[span, word]
        at = self._slot(key[span, word])
        for _ in range(self.probes):  # the slot whose first key agreed
            wrong = self.keys[0][at] != key[span, word]
            if not wrong.any():
                break
            at = np.where(wrong, (at + 1) % len(self.slots), at)
        bad = self.keys[1][at] != second
        ids[span[bad], word[bad]] = self.none
        return np.where(last[:, None] > sizes, self.none, ids)


#: Log-probability of what can't be, small enough that its exponential is 0 and its sums stay finite.
NEVER = -1e30


class Lattice:
    """Words side by side, those of about one length, with the recursions over their pieces.

    Pieces are found for BLOCK_CELLS windows at a time, so a long word never has all its windows in memory; per place of a word
    only the forward sum is kept.
    """

    def __init__(self, v: Vocabulary, logs: np.ndarray, words: list[bytes]):
        self.v, self.scores = v, np.append(np.maximum(logs, NEVER), NEVER)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = self.n = int(self.sizes.max())
        self.letters = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(len(words), n).T
        self.sums = v.pieces.prefixes(self.letters)

    def blocks(self, back: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(j0, j1, first, last, ids): all windows that end in j0 to j1 - 1, in order of their ends."""
        step = max(1, BLOCK_CELLS // (self.v.longest * len(self.sizes)))
        edges = range(1, self.n + 1, step)
        for j0 in reversed(edges) if back else edges:
            j1 = min(self.n + 1, j0 + step)
            first = np.concatenate([np.arange(max(0, j - self.v.longest), j) for j in range(j0, j1)])
            last = np.repeat(np.arange(j0, j1), [min(j, self.v.longest) for j in range(j0, j1)])
            yield j0, j1, first, last, self.v.pieces.find(self.sums, first, last, self.sizes)

    def forward(self) -> np.ndarray:
        """Log sums over all paths from 0 to each place, (n + 1, words)."""
        alpha = np.full((self.n + 1, len(self.sizes)), NEVER)
        alpha[0] = 0.0
        for j0, j1, _, _, ids in self.blocks():
            scores, at = self.scores[ids], 0
            for j in range(j0, j1):
                i = max(0, j - self.v.longest)
                x = alpha[i:j] + scores[at : at + j - i]
                top = x.max(0)
                alpha[j] = np.maximum(top + np.log(np.exp(x - top).sum(0)), NEVER)
                at += j - i
        return alpha

    def marginals(self) -> np.ndarray:
        return self.forward()[self.sizes, np.arange(len(self.sizes))]

    def uses(self, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur counts times."""
        words, out = np.arange(len(self.sizes)), np.zeros(self.v.end + 2)
        alpha = self.forward()
        total = alpha[self.sizes, words]
        beta = np.full_like(alpha, NEVER)
        beta[self.sizes, words] = 0.0
        for j0, j1, first, last, ids in self.blocks(back=True):
            scores, at = self.scores[ids], len(ids)
            for j in range(j1 - 1, j0 - 1, -1):
                i = max(0, j - self.v.longest)
                at -= j - i
                beta[i:j] = np.logaddexp(beta[i:j], np.maximum(beta[j] + scores[at : at + j - i], NEVER))
            span, word = np.nonzero(ids != self.v.pieces.none)
            ids, i, j = ids[span, word], first[span], last[span]
            n = np.exp(alpha[i, word] + self.scores[ids] + beta[j, word] - total[word]) * counts[word]
            out += np.bincount(ids, n, self.v.end + 2)
        return out[:-1]


def _by_length(words: list[bytes]) -> Iterator[list[int]]:
    """Places of words of about one length, fewer of long words: SIDE letters in all, or one word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        most = int(sizes[order[at]])
        most += max(1, most // 8)
        end = min(at + max(1, SIDE // most), int(np.searchsorted(sizes[order], most, "right")))
        yield order[at:end].tolist()
        at = end


def word_scores(v: Vocabulary, logs: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural-log marginals of words; -inf where the pieces have no path."""
    out = np.empty(len(words))
    for places in _by_length(words):
        out[places] = Lattice(v, logs, [words[k] for k in places]).marginals()
    return np.where(out <= NEVER / 2, -np.inf, out)


def expected(v: Vocabulary, logs: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur counts times."""
    out = np.zeros(v.end + 1)
    for places in _by_length(words):
        out += Lattice(v, logs, [words[k] for k in places]).uses(counts[places])
    return out


# -- over the corpus --------------------------------------------------------------------------------------------------------
def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(texts: Column, df: DataFrame) -> DataFrame:
    """(word, c) over all rows of df; tasks count before they shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(_words(t.as_py()))
                if len(seen) > COUNTED:
                    yield _counted(seen)
                    seen.clear()
        if seen:
            yield _counted(seen)

    return df.select(texts.alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Head:
    """The most frequent words: their places in values, whose rows are base score, mixed score and piece score, and the end mark's."""

    def __init__(self, words: pa.Table, ends: int, end_pieces: float, n: int, v: int, whole: float, u: float):
        def rows(c: np.ndarray, pieces: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore", over="ignore", under="ignore"):
                mixed = np.where(c > 0, np.log10(whole * c + u * 10.0**pieces), math.log10(u) + pieces)
            return np.array([np.log10((c + 1) / (n + v + 1)), mixed, pieces])

        self.place = dict(zip(words["word"].to_pylist(), range(len(words)), strict=True))
        self.values = rows(words["c"].to_numpy().astype(np.float64), words["log10"].to_numpy().astype(np.float64))
        self.end = rows(np.array([float(ends)]), np.array([end_pieces]))[:, 0]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of words in lots of TOGETHER rows or bytes, so that lattices are wide however small a batch is."""
    some, size = [], 0
    for b in batches:
        some.append(b)
        size += max(b.num_rows, b.nbytes // 64)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])


def fit(counts: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece log-probabilities fitted to counts (word, c) and `ends` end marks. What reaches the driver is one row a piece."""
    spark, logs = counts.sparkSession, vocabulary(path).start()
    size = len(logs)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(logs)

        def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, total = vocabulary(path), np.zeros(size)
            for some in _gathered(batches):
                words = [w for b in some for w in b.column(0).to_pylist()]
                total += expected(v, sent.value, words, np.concatenate([b.column(1).to_numpy() for b in some]))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["piece", "uses"])

        got = np.zeros(size)
        for piece, n in counts.select("word", "c").mapInArrow(uses, "piece long, uses double").groupBy("piece").agg(F.sum("uses")).collect():
            got[piece] = n
        got[-1] = ends
        smooth = np.where(np.isfinite(logs), got + 0.01, 0.0)
        with np.errstate(divide="ignore"):
            logs = np.log(smooth / smooth.sum())
    return logs


def score(df: DataFrame, held_out: Column, path: str, doc_id: str = "doc_id", text: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, piece_score; log10, learned from rows not held out."""
    spark = df.sparkSession
    small_batches(spark)
    slim = df.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    counts = materialize(count_words(F.col("text"), slim.where(~F.col("held_out"))), "words")
    ends = slim.where(~F.col("held_out")).count()
    total, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    n, v = total + ends, distinct + (ends > 0)
    logs = fit(counts, ends, path, rounds)
    lattice = spark.sparkContext.broadcast(logs)
    scored = materialize(with_scores(counts, path, lattice), "lattice")
    u = min(0.5, max(1e-6, once / n)) if n else 1.0
    whole = (1 - u) / max(n, 1)
    head_words = scored.where(F.col("c") >= head_count(scored, head)).select("word", "c", "log10").toArrow()
    sent = spark.sparkContext.broadcast(Head(head_words, ends, float(logs[-1]) / math.log(10), n, v, whole, u))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            docs: tuple[list, ...] = tuple([] for _ in range(5))
            tails: tuple[list, ...] = ([], [], [])
            for rid, t in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                words = _words(t.as_py())
                at = np.fromiter(map(known.place.get, words, itertools.repeat(-1)), np.int64, len(words))
                rare = at < 0
                if rare.any():
                    for w, times in Counter(itertools.compress(words, rare)).items():
                        tails[0].append(rid)
                        tails[1].append(w)
                        tails[2].append(times)
                    at = at[~rare]
                for col, x in zip(docs, (len(words) + 1, int(ends > 0) + len(at), *(known.values[:, at].sum(1) + known.end)), strict=True):
                    col.append(x)
            yield table([b.column(0), b.column(1), b.column(2), *docs, None, None], b.num_rows)
            yield table([tails[0], *[None] * 7, *tails[1:]], len(tails[0]))

    def table(cols: list, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if c is None else pa.array(c, t) if isinstance(c, list) else c for c, t in zip(cols, kinds, strict=True)], names)

    names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "piece_score", "word", "times"]
    kinds = [pa.int64(), to_arrow_type(slim.schema["doc_id"].dataType), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
    schema = f"rid long, doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, piece_score double, word binary, times long"
    rows = slim.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    found = materialize(rows.mapInArrow(run, schema), "scored")
    met = found.where(F.col("word").isNotNull()).select("rid", "word", "times").join(scored, "word", "left")
    fresh = with_scores(met.where(F.col("c").isNull()).select("rid", "times", "word", F.lit(0).cast("long").alias("c")), path, lattice)
    met = met.where(F.col("c").isNotNull()).select("rid", "times", "c", "log10").unionByName(fresh.select("rid", "times", "c", "log10"))
    c, x = F.col("c"), F.col("log10")
    rare = met.groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(n + v + 1)))).alias("more_base"),
        F.sum(F.col("times") * F.when(c > 0, F.log10(c * F.lit(whole) + F.lit(u) * F.pow(F.lit(10.0), x))).otherwise(F.log10(F.lit(u)) + x)).alias("more_score"),
        F.sum(F.col("times") * x).alias("more_pieces"),
    )
    docs = found.where(F.col("word").isNull()).join(rare, "rid", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return docs.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base_score", "more_base"), plus("score", "more_score"), plus("piece_score", "more_pieces")
    )


def head_count(counts: DataFrame, most: int) -> float:
    """A count that at most `most` words reach, from a histogram of counts in steps of an eighth of a power of two."""
    step = F.floor(F.log2("c") * 8)
    total, least = 0, math.inf
    for s, words in sorted((tuple(r) for r in counts.groupBy(step.alias("s")).agg(F.count("*")).collect()), reverse=True):
        total += words
        if total > most:
            break
        least = 2.0 ** (s / 8)
    return math.floor(least) if least < 2 else math.ceil(least - 1e-9) if math.isfinite(least) else math.inf


def with_scores(df: DataFrame, path: str, lattice) -> DataFrame:
    """df with log10: the log10 marginal of its column word."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, at = vocabulary(path), columns.index("word")
        for some in _gathered(batches):
            new = list({w for b in some for w in b.column(at).to_pylist()})
            known = dict(zip(new, (word_scores(v, lattice.value, new) / math.log(10)).tolist(), strict=True))
            for b in some:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([known[w] for w in b.column(at).to_pylist()], pa.float64())], [*columns, "log10"])

    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [*df.dtypes, ("log10", "double")]))
