"""Language identification of mixed texts: script ranges narrow the candidates, Viterbi labels spans of words.

Model: for each language the scripts its letters come from, and letter n-grams (1 to 4, with word edges) counted over a bounded
sample of labelled rows. A word's score is the log-probability of its n-grams, by interpolation from short to long contexts;
languages that were never seen in the word's script get no candidate score.

Labels: over the words of a text, the sequence of languages with the greatest sum of word scores, less a penalty for each
switch, is found by Viterbi. Most texts need no walk: where no run of words gains more by another language than a switch costs
(the greatest sub-sum of the gains, exact and vectorised), the best single language is the Viterbi answer.

Result: the language with most letters in its spans, and as score its share of all letters, times the share of letters in
words of a known script. Where no word's script is known to any language that is the first language, with score 0. Text that is
null or has no letter (of category L) is `und` with score 0. Nulls in lang are never learned; without any labelled row every text
is `und`. Texts are read whole; repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyoflux.llm.common import free_name, remainder, small_batches

UND = "und"
#: Labelled rows learned of each language, and the length up to which rows are preferred.
ROWS_A_LANGUAGE, LETTERS_A_ROW = 250, 20_000
#: What a switch costs, in natural log units.
SWITCH = 12.0
ORDER = 4
#: Words that a task remembers; workers outlive their tasks, so a task forgets them at its end.
REMEMBERED = 200_000

# First and last code point of the main letter blocks of each script (Unicode).
SCRIPTS = (
    ("Latin", 0x41, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Hebrew", 0x590, 0x5FF),
    ("Arabic", 0x600, 0x77F), ("Devanagari", 0x900, 0x97F), ("Bengali", 0x980, 0x9FF), ("Tamil", 0xB80, 0xBFF), ("Thai", 0xE00, 0xE7F),
    ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x1F00, 0x1FFF), ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF), ("Han", 0x20000, 0x2FFFF),
)
_STARTS = np.array([s[1] for s in SCRIPTS])
#: A letter by its Unicode category, then letters and the marks on them.
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def script(ch: str) -> str:
    at = int(np.searchsorted(_STARTS, ord(ch), "right")) - 1
    return SCRIPTS[at][0] if at >= 0 and ord(ch) <= SCRIPTS[at][2] else "Other"


@dataclass
class Model:
    """langs in order of code point; rows: n-gram to its row of logs, which holds the log-probability of its last letter in each
    language; the last row of logs is for letters never seen."""

    langs: list[str]
    scripts: dict[str, np.ndarray]
    rows: dict[str, int]
    logs: np.ndarray
    switch: float = SWITCH
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def _grams(self, w: str) -> list[int]:
        padded, rows, out = f"^{w}$", self.rows, []
        for i in range(1, len(padded)):
            for n in range(min(ORDER, i + 1), 0, -1):
                if (at := rows.get(padded[i - n + 1 : i + 1])) is not None:
                    out.append(at)
                    break
            else:
                out.append(len(self.logs) - 1)
        return out

    def learn(self, words: list[str]) -> None:
        """Scores of new lower-case words; all zeros where no language knows the word's script."""
        none = np.zeros(len(self.langs), bool)
        grams = [self._grams(w) for w in words]
        starts = np.cumsum([0, *map(len, grams[:-1])])
        s = np.add.reduceat(self.logs[np.concatenate(grams)], starts, axis=0)
        may = np.array([self.scripts.get(script(w[0]), none) for w in words])
        s = np.where(may, s, np.where(may.any(1, keepdims=True), -1e4, 0.0))
        at = len(self.known)
        if self.table is None or at + len(words) > len(self.table):
            grown = np.zeros((max(1 << 16, 2 * (at + len(words))), len(self.langs) + 1))
            grown[:at] = 0 if self.table is None else self.table[:at]
            self.table = grown
        self.table[at : at + len(words), :-1] = s
        self.table[at : at + len(words), -1] = [len(w) for w in words]
        self.known.update(zip(words, range(at, at + len(words)), strict=True))

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its score in each language, then its number of letters."""
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, None
        if new := [w for w in set(words) if w not in self.known]:
            self.learn(new)
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, lang) of the runs of words with one language, in code points."""
        found = list(_WORD.finditer(text or ""))
        if not found or not self.langs:
            return []
        labels = viterbi(self.scores([m[0].lower() for m in found])[:, :-1], self.switch)
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(found)]
        return [(found[a].start(), found[b - 1].end(), self.langs[labels[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall((text or "").lower())
        if not words or not self.langs:
            return UND, 0.0
        s = self.scores(words)
        s, size = s[:, :-1], s[:, -1]
        known = s.any(axis=1)
        if not known.any():
            return self.langs[0], 0.0
        got = np.bincount(viterbi(s, self.switch)[known], size[known], len(self.langs))
        best = int(got.argmax())
        return self.langs[best], float(got[best] / size.sum())


def viterbi(s: np.ndarray, switch: float) -> np.ndarray:
    """The labels with the greatest sum of s[word, label] less switch for each change; ties go to the first label."""
    best = int(s.sum(0).argmax())
    if len(s) < 2 or _no_better(s - s[:, best : best + 1], switch):
        return np.full(len(s), best)
    back: list[list[int] | None] = [None]
    at = s[0].tolist()
    for row in s[1:].tolist():
        top = max(at)
        least, source = top - switch, at.index(top)
        if min(at) < least:
            back.append([source if x < least else k for k, x in enumerate(at)])
            at = [max(x, least) + y for x, y in zip(at, row, strict=True)]
        else:
            back.append(None)
            at = [x + y for x, y in zip(at, row, strict=True)]
    labels = np.empty(len(s), np.int64)
    now = at.index(max(at))
    for i in range(len(s) - 1, -1, -1):
        labels[i] = now
        if back[i] is not None:
            now = back[i][now]
    return labels


def _no_better(gain: np.ndarray, switch: float) -> bool:
    """Whether no path gains more than its switches cost over staying in the best single language.

    A path with that language in it pays a switch for each run in another one. One without it pays a switch less, so there the first
    and the last run together must not gain more than one switch either."""
    run = np.vstack([np.zeros(gain.shape[1]), gain.cumsum(0)])
    return bool((run - np.minimum.accumulate(run)).max() <= switch and run.max() + (run[-1] - run).max() <= switch)


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = ROWS_A_LANGUAGE, letters: int = LETTERS_A_ROW, switch: float = SWITCH) -> Model:
    """A model from at most `rows` labelled rows of each language, those with the least hash of key and text.

    The languages themselves are found over all rows. Rows of more than `letters` characters are learned, whole, only of languages
    that lack shorter ones. A threshold on the hash leaves a few times the rows needed before anything is ranked; a language of
    which it leaves none (few distinct rows) is ranked without it.
    """
    from pyspark.sql import Window

    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"), F.col(text).alias("text"))
    labelled = labelled.withColumn("hash", F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "text"))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model([], {}, {}, np.zeros((1, 0)), switch)
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4.0 * rows / n)))]), F.col("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.length("text") > letters, "hash", "key", "text"))
    first = lambda some: some.withColumn("place", place).where(F.col("place") <= rows).select("lang", "text").orderBy("lang", "place").toLocalIterator()
    drawn = [(r.lang, r.text) for r in first(labelled.where(F.pmod("hash", F.lit(1 << 20)) < share * (1 << 20)))]
    if missed := sorted(counts.keys() - {lang for lang, _ in drawn}):
        drawn += [(r.lang, r.text) for r in first(labelled.where(F.col("lang").isin(missed)))]
    return fit(drawn, switch)


def fit(rows, switch: float = SWITCH) -> Model:
    """A model from (lang, text) pairs. Each language weighs the same, whatever its number of rows."""
    words: dict[str, Counter] = {}
    for lang, text in rows:
        words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
    langs = sorted(words)
    if not langs:
        return Model([], {}, {}, np.zeros((1, 0)), switch)
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    letters = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        seen = Counter()
        for w, n in words[lang].items():
            seen[script(w[0])] += n
            padded = f"^{w}$"
            for i in range(1, len(padded)):
                letters[k] += n
                for m in range(1, min(ORDER, i + 1) + 1):
                    g = padded[i - m + 1 : i + 1]
                    if g not in counts:
                        counts[g] = np.zeros(len(langs))
                    counts[g][k] += n
        for name, n in seen.items():
            if n >= max(2, 0.001 * sum(seen.values())):
                scripts.setdefault(name, np.zeros(len(langs), bool))[k] = True
    alphabet = 1 + sum(len(g) == 1 for g in counts)
    context: dict[str, np.ndarray] = {}
    for g, c in counts.items():
        if len(g) > 1:
            context[g[:-1]] = context.get(g[:-1], 0) + c
    probs: dict[str, np.ndarray] = {}
    for g in sorted(counts, key=len):  # interpolation with the shorter context, weighed by its number of followers
        if len(g) == 1:
            probs[g] = (counts[g] + 0.5) / (letters + 0.5 * alphabet)
        else:
            total = context[g[:-1]]
            probs[g] = (counts[g] + 5.0 * probs[g[1:]]) / (total + 5.0)
    table = np.log(np.vstack([*probs.values(), 0.5 / (letters + 0.5 * alphabet)]))
    return Model(langs, scripts, dict(zip(probs, range(len(probs)), strict=True)), table, switch)


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score. The model is broadcast: its size is bounded by the sample it was fitted on."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    small_batches(df.sparkSession)
    out = free_name(df, "_label")

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        try:
            for s in batches:
                yield pd.DataFrame([m.predict(t) for t in s], columns=["lang_pred", "score"])
        finally:
            m.known, m.table = {}, None

    kept = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    return df.select(*[df[c] for c in kept], run(F.col(text)).alias(out)).select(*kept, f"{out}.lang_pred", f"{out}.score")


#: Texts under this score are rejected by keep_identified, besides those that are `und`.
LEAST_SCORE = 0.2


def keep_identified(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """df without the rows whose language can't be told, all columns as they were: those without letters, and those of which less
    than LEAST_SCORE of the letters is of the main language, because most are of scripts that no language was learned in. With up
    to four languages of one script no mix of them falls below it, so mixed texts stay."""
    model = train(df.where(remainder(F.col(doc_id), 4) != 2), text, lang, doc_id)
    out = identify(df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(text).alias("text")), model)
    return out.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE)).select("row.*")
