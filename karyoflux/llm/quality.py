"""Quality by co-training of two views: a classifier of the text's words and layout, and one of the page's metadata alone.

Both are logistic regressions that start from a bounded sample of labelled rows. In each round both views score all unlabelled rows, and
the ones a view is most sure of, as many good as bad in proportion to the labelled ones, join the other's training rows as
labelled; these are the top of all rows, found where the rows lie. How sure a view is counts after calibration, so a view that
knows little has no say. At the end each view is calibrated (Platt) on labelled rows that neither was trained on, and a third
regression on the two calibrated log-odds gives the score of every row. Features of whole texts are computed once and kept, sparse,
in the scratch folder; rounds and scores read them there.

Bounded are the labelled rows that start the views (LABELLED) and the rows that change sides in a round (GAIN a view); whatever is searched
or scored is every row. Null text counts as empty, null metadata as a value of its own. Without labels of both kinds the score
is the share of good labels (0.5 without any). Several labels of one id count as several rows. Rows with a label, a null id or an id
that other unlabelled rows have too are scored but not exchanged; of labelled rows with one id the one with the greatest features
teaches. Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from karyoflux.llm.common import small_batches
from karyoflux.runtime import discard, materialize

#: Labelled rows that training starts from at most; hashed buckets of words and of metadata values.
LABELLED = 3000
WORDS, META = 2048, 64
#: Numbers of the text's layout, and classes of stated lengths.
LAYOUT, LENGTHS = 7, 24
ROUNDS, GAIN, SURE = 4, 200, 0.9


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the text view: square roots of the shares of hashed words, of length 1, then the layout: lengths in
    characters and lines, characters a line, and the shares of kinds of characters."""
    t = text or ""
    raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    kinds = np.bincount(_TABLE[raw], minlength=6) if len(raw) else np.zeros(6, np.int64)
    layout = np.array([np.log1p(len(t)) / 10, np.log1p(kinds[4]) / 10, np.log1p(n / (1 + kinds[4])) / 10, 4 * kinds[1] / n, 4 * kinds[2] / n, 4 * kinds[3] / n, 4 * kinds[0] / n])
    words = t.split()
    if not words:
        return WORDS + np.arange(LAYOUT), layout
    seen = Counter(words)
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in seen), np.int64, len(seen))
    share = np.fromiter(seen.values(), np.float64, len(seen)) / len(words)
    total = np.bincount(at, share, WORDS)
    at = np.flatnonzero(total)
    return np.append(at, WORDS + np.arange(LAYOUT)), np.append(np.sqrt(total[at]), layout)


def meta_features(lang, source, n_chars) -> np.ndarray:
    """The metadata view, which never sees the text: hashed language, source and both together, then the stated length, as a number
    and by powers of two, or that it is missing."""
    out = np.zeros(META + LENGTHS + 3)
    for word in (f"lang={lang}", f"source={source}", f"both={lang}\0{source}"):
        out[zlib.crc32(word.encode("utf-8", "surrogatepass")) % META] = 1.0
    if n_chars is None or n_chars != n_chars:
        out[-2] = 1.0
    else:
        size = max(0.0, float(n_chars))
        out[META + min(LENGTHS - 1, int(np.log2(1 + size)))] = 1.0
        out[-3] = np.log1p(size) / 10
    out[-1] = 1.0
    return out


def _kind_table() -> np.ndarray:
    """Class of each byte: 0 white, 1 upper case, 2 digit, 3 sign, 4 line end, 5 other."""
    table = np.full(256, 5, np.uint8)
    for b in range(128):
        ch = chr(b)
        table[b] = 4 if ch == "\n" else 0 if ch.isspace() else 1 if ch.isupper() else 2 if ch.isdigit() else 5 if ch.isalpha() else 3
    return table


_TABLE = _kind_table()


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 150, l2: float = 1e-4, rate: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression by Adam steps over all rows; x ends in a column of ones, w weighs rows."""
    beta, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    w = w / w.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - y)) + l2 * beta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        beta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return beta


def _odds(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.clip(x @ beta, -30, 30)


def _calibrated(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and shift (Platt) that make odds those of y."""
    return logistic(np.column_stack([odds, np.ones(len(y))]), y, np.ones(len(y)), 300, 1e-3, 0.1)


@dataclass
class Views:
    """The two views' weights with their calibrations (slope, shift), and the combination's weights."""

    text: np.ndarray | None
    meta: np.ndarray | None
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray
    share: float = 0.5


def text_width() -> int:
    return WORDS + LAYOUT + 1


def meta_width() -> int:
    return META + LENGTHS + 3


class Training:
    """The training rows of both views, "t" and "m", and what comes of them. Every fourth labelled row only calibrates."""

    def __init__(self, xt: np.ndarray, xm: np.ndarray, y: np.ndarray) -> None:
        self.share = float(y.mean()) if len(y) else 0.5
        hold = np.arange(len(y)) % 4 == 3
        self.possible = len(set(y[~hold])) == 2 and len(set(y[hold])) == 2
        self.known = y[hold]
        self.held = {"t": xt[hold], "m": xm[hold]}
        self.own = {k: (x[~hold], y[~hold], np.ones((~hold).sum())) for k, x in (("t", xt), ("m", xm))}

    def fitted(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Weights and calibration (slope, shift) of each view."""
        beta = {k: logistic(*rows) for k, rows in self.own.items()}
        return {k: (b, _calibrated(_odds(self.held[k], b), self.known)) for k, b in beta.items()}

    def give(self, view: str, x: np.ndarray, label: float) -> None:
        """Rows that the other view is sure of; they weigh half."""
        old, y, w = self.own[view]
        self.own[view] = np.vstack([old, x]), np.append(y, np.full(len(x), label)), np.append(w, np.full(len(x), 0.5))

    def views(self) -> Views:
        if not self.possible:
            return Views(None, None, np.ones(2), np.ones(2), np.ones(3), self.share)
        (text, text_scale), (meta, meta_scale) = (self.fitted()[k] for k in "tm")
        z = np.column_stack([_odds(self.held["t"], text) * text_scale[0] + text_scale[1], _odds(self.held["m"], meta) * meta_scale[0] + meta_scale[1], np.ones(len(self.known))])
        return Views(text, meta, text_scale, meta_scale, logistic(z, self.known, np.ones(len(self.known)), 300, 1e-3, 0.1), self.share)


def numbers(share: float, good: int, bad: int, gain: int) -> tuple[int, int]:
    """How many good and bad rows change sides: as the labelled ones are mixed, gain at most, as far as both kinds reach."""
    total = min(float(gain), good / share, bad / (1 - share))
    return round(total * share), round(total * (1 - share))


# -- features kept as sparse rows -------------------------------------------------------------------------------------------
_FEATURES = "struct<at: array<smallint>, share: array<float>, meta_at: array<smallint>, meta_share: array<float>>"


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, at, share, meta_at, meta_share) of every row of docs, written to the scratch folder."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(_FEATURES)
    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, s, c in zip(text, lang, source, n, strict=True):
            at, share = text_features(t)
            meta = meta_features(a, s, c)
            some = np.flatnonzero(meta)
            rows.append((at.astype(np.int16), share.astype(np.float32), some.astype(np.int16), meta[some].astype(np.float32)))
        return pd.DataFrame(rows, columns=["at", "share", "meta_at", "meta_share"])

    kept = docs.select("doc_id", run("text", "lang", "source", "n_chars").alias("_f")).select("doc_id", "_f.*")
    return materialize(kept, "quality-features")


def _dense(at: list, share: list, width: int) -> np.ndarray:
    """Rows of a width whose last place is one."""
    x = np.zeros((len(at), width))
    x[:, -1] = 1.0
    for k, (i, v) in enumerate(zip(at, share, strict=True)):
        x[k, np.asarray(i, np.int64)] = v
    return x


def _matrices(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return _dense([r["at"] for r in rows], [r["share"] for r in rows], text_width()), _dense([r["meta_at"] for r in rows], [r["meta_share"] for r in rows], meta_width())


def _rows_of(kept: DataFrame, ids: list) -> dict:
    """Features by id, of a bounded list of ids; of rows with one id the greatest."""
    if not ids:
        return {}
    wanted = F.broadcast(kept.sparkSession.createDataFrame([(i,) for i in ids], kept.select("doc_id").schema))
    one = kept.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("at", "share", "meta_at", "meta_share")).alias("f"))
    return {r["doc_id"]: r["f"] for r in one.collect()}


def _linear(at: pa.ListArray, share: pa.ListArray, beta: np.ndarray, add: float) -> np.ndarray:
    """Rows times weights. No row is empty: layout and a constant are always there."""
    ends = np.asarray(at.offsets)
    products = beta[at.flatten().to_numpy()] * share.flatten().to_numpy()
    return np.clip(np.add.reduceat(products, ends[:-1] - ends[0]) + add if len(at) else np.empty(0), -30, 30)


def _log_odds(kept: DataFrame, models: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc_id, t, m): calibrated log-odds of both views for every row."""
    (text, ts), (meta, ms) = models["t"], models["m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, m = _linear(b.column(1), b.column(2), text, text[-1]), _linear(b.column(3), b.column(4), meta, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t * ts[0] + ts[1]), pa.array(m * ms[0] + ms[1])], names=["doc_id", "t", "m"])

    shape = kept.select("doc_id").schema.add("t", DoubleType()).add("m", DoubleType())
    return kept.select("doc_id", "at", "share", "meta_at", "meta_share").mapInArrow(run, shape)


def train(kept: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, gain: int = GAIN, sure: float = SURE) -> Views:
    """Views from features() of documents and labels (doc_id, label 0 or 1); the labelled rows are those with the least hashes."""
    known = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("double").alias("label"))
    first = known.join(kept.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit("labelled")), "doc_id", "label").limit(labelled).collect()
    first.sort(key=lambda r: (r["doc_id"], r["label"]))
    by_id = _rows_of(kept, list({r["doc_id"] for r in first}))
    state = Training(*_matrices([by_id[r["doc_id"]] for r in first]), np.array([r["label"] for r in first], dtype=float))
    given: dict[str, list] = {"t": [], "m": []}
    limit = float(np.log(sure / (1 - sure)))
    for _ in range(rounds if state.possible else 0):
        odds = _log_odds(kept, state.fitted()).where(F.col("doc_id").isNotNull())
        alone = odds.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("t").alias("t"), F.max("m").alias("m")).where("n = 1")
        free = alone.join(labels.select("doc_id"), "doc_id", "left_anti").where((F.abs("t") >= limit) | (F.abs("m") >= limit))
        free = materialize(free.select("doc_id", "t", "m"), "quality-free")
        tops = []
        for view, other in (("t", "m"), ("m", "t")):
            own = free.where(~F.col("doc_id").isin(given[other])) if given[other] else free
            for good in (1, -1):
                order = F.col(view) * -good
                tops.append(own.where(order <= -limit).orderBy(order, "doc_id").limit(gain).select("doc_id", order.alias("order"), F.lit(other).alias("to"), F.lit(good).alias("good")))
        lists: dict[tuple, list] = {}
        for r in sorted(reduce(DataFrame.union, tops).collect(), key=lambda r: (r["order"], r["doc_id"])):
            lists.setdefault((r["to"], r["good"]), []).append(r["doc_id"])
        discard(free)
        chosen = {}
        for to in "mt":
            good, bad = lists.get((to, 1), []), lists.get((to, -1), [])
            n = numbers(state.share, len(good), len(bad), gain)
            chosen[to] = (good[: n[0]], bad[: n[1]])
        found = _rows_of(kept, list({i for pair in chosen.values() for ids in pair for i in ids}))
        for to, pair in chosen.items():
            for label, ids in zip((1.0, 0.0), pair, strict=True):
                if ids:
                    state.give(to, _matrices([found[i] for i in ids])[to == "m"], label)
                    given[to] += ids
    return state.views()


def score(kept: DataFrame, views: Views) -> DataFrame:
    """(doc_id, p_text, p_meta, score) for every row of features()."""
    p = lambda c: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), c))))
    if views.text is None:
        return kept.select("doc_id", *[F.lit(views.share).alias(n) for n in ("p_text", "p_meta", "score")])
    odds = _log_odds(kept, {"t": (views.text, views.text_scale), "m": (views.meta, views.meta_scale)})
    both = F.col("t") * float(views.both[0]) + F.col("m") * float(views.both[1]) + float(views.both[2])
    return odds.select("doc_id", p(F.col("t")).alias("p_text"), p(F.col("m")).alias("p_meta"), p(both).alias("score"))
