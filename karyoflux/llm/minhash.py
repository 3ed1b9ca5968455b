"""Near-duplicates by the similarity of shingle sets: SimHash blocks and MinHash bands propose pairs, the sets themselves decide.

A text is the set of the hashes of its runs of SHINGLE words (A-Z in lower case; a text with fewer words is one run). Two texts
are linked if their sets have a Jaccard similarity of SIMILARITY or more, and components of links are near-duplicate groups.
Texts with equal sets are one node, so copies never multiply.

Candidates come from two sources. SimHashes of the sets within simhash.DISTANCE bits are linked by pigeonhole blocks (simhash_pairs,
through simhash.links). That can't find all alone: at that similarity fingerprints of 64 bits mostly lie 3 to 11 bits apart, and no
choice of blocks that finds all pairs within 11 bits has keys of more than a few bits. For the rest, candidates share a band,
ROWS_OF_BAND least values of their sets under BANDS * ROWS_OF_BAND hash functions. A pair of similarity s shares one of the bands
with probability 1 - (1 - s ** ROWS_OF_BAND) ** BANDS, which is 0.99992 at 0.8 and more above it.
Candidates are pruned by the sizes of their sets, which loses none, and by sketches, and then their sets are compared in full.

In a band's key that more than HOT_KEY nodes share, pairs are left out only if their nodes are in one component already or can't
be similar: in each of STARS rounds all nodes are compared with one of them and components are formed, so a large group of near
copies falls into one. What is in other components then is paired by prefix filters (prefix_pairs), which are exact and which a
large group of texts that are only half alike passes without a pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyoflux.llm import simhash
from karyoflux.llm.common import keep_rows, small_batches, with_row_ids
from karyoflux.operators.components import connected_components
from karyoflux.runtime import cleaned, materialize

SHINGLE, SIMILARITY, BANDS, ROWS_OF_BAND, SEED = 5, 0.8, 24, 5, 42
#: Nodes of one key that are all compared in pairs, and rounds of comparing with one node where there are more.
HOT_KEY, STARS = 64, 3
#: Bytes of a sketch, and equal ones of two from which on their sets are compared.
SKETCH, LEAST_EQUAL = 256, 173
#: Shingles whose uses are broadcast at most, to order the others' sets by.
KNOWN = 200_000
#: Shingles whose uses a task counts at once, which bounds its memory.
COUNTED = 1 << 20
#: Shingles whose least values are taken at once, which keeps them in a processor's cache.
AT_ONCE = 1 << 15

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, SHINGLE + BANDS * ROWS_OF_BAND + SKETCH), np.uint64)
_FLIPS, _FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(SEED)), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = _mix(out ^ hashes[i : i + n], _FACTORS[i])
    return np.unique(out)


def _mix(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = x * factor
    return x ^ (x >> np.uint64(31))


def fingerprint(found: np.ndarray) -> int:
    """One signed 64-bit hash of a whole set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set one key a band, which holds the band's number; an empty set has none."""
    return _by_set(sets, lambda some: _keys(_least(some, SHINGLE, BANDS * ROWS_OF_BAND)))


def simhashes(sets: list[np.ndarray]) -> list[int]:
    """For each set the SimHash of its shingles as a signed 64-bit integer: a bit is 1 if set in over half; an empty set has zero."""
    return [int(x[0]) if len(x) else 0 for x in _by_set(sets, _majorities)]


def sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    """For each set the low bytes of its least values under SKETCH other hash functions, eight to a long."""
    return _by_set(sets, lambda some: _least(some, SHINGLE + BANDS * ROWS_OF_BAND, SKETCH).astype(np.uint8).T.copy().view(np.int64))


def _by_set(sets: list[np.ndarray], of) -> list[np.ndarray]:
    """The rows of of(sets) for the sets that aren't empty, those of AT_ONCE shingles side by side."""
    out = [np.empty(0, np.int64)] * len(sets)
    some, size = [], 0
    for k, found in enumerate(sets):
        if len(found):
            some.append(k)
            size += len(found)
        if some and (size >= AT_ONCE or k == len(sets) - 1):
            for at, row in zip(some, of([sets[i] for i in some]), strict=True):
                out[at] = row
            some, size = [], 0
    return out


def _least(sets: list[np.ndarray], first: int, count: int) -> np.ndarray:
    """(function, set): the least values of sets that aren't empty under `count` hash functions from number first on."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    least, room = np.empty((count, len(sets)), np.uint64), np.empty_like(flat)
    for k in range(count):
        np.bitwise_xor(flat, _FLIPS[first + k], out=room)
        np.multiply(room, _FACTORS[first + k], out=room)
        np.minimum.reduceat(room, starts, out=least[k])
    return least


def _majorities(sets: list[np.ndarray]) -> np.ndarray:
    flat, starts, half = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]), np.array([len(x) // 2 for x in sets])
    out, room = np.zeros(len(sets), np.uint64), np.empty_like(flat)
    for bit in map(np.uint64, range(64)):
        np.right_shift(flat, bit, out=room)
        np.bitwise_and(room, np.uint64(1), out=room)
        out |= (np.add.reduceat(room, starts) > half).astype(np.uint64) << bit
    return out.view(np.int64)[:, None]


def _keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS_OF_BAND, -1)
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], rows.shape[2], axis=1)
    for r in range(ROWS_OF_BAND):
        keys = _mix(keys ^ rows[:, r], _FACTORS[r])
    return keys.T.copy().view(np.int64)


def with_signatures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with _s: fp (hash of the whole set), sim (its SimHash) and keys."""

    @F.pandas_udf("struct<fp: long, sim: long, keys: array<long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            sets = [shingles(t) for t in s]
            yield pd.DataFrame({"fp": [fingerprint(x) for x in sets], "sim": simhashes(sets), "keys": band_keys(sets)})

    small_batches(df.sparkSession)
    return df.withColumn("_s", of(F.col(text)))


def sets_of(df: DataFrame, text: str = "text") -> DataFrame:
    """(fp, set, n, sketch) of each row of df, n the set's size."""

    @F.pandas_udf("struct<fp: long, set: array<long>, n: long, sketch: array<long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            sets = [shingles(t) for t in s]
            yield pd.DataFrame({"fp": [fingerprint(x) for x in sets], "set": [x.view(np.int64) for x in sets], "n": [len(x) for x in sets], "sketch": sketches(sets)})

    small_batches(df.sparkSession)
    return df.select(of(F.col(text)).alias("_s")).select("_s.*")


def equal_bytes(a: Column, b: Column) -> Column:
    """How many bytes of two arrays of longs agree: each long's differing bits are folded onto the lowest bit of their byte."""

    def equal(p: Column, q: Column) -> Column:
        x = p.bitwiseXOR(q)
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return 8 - F.bit_count(x)

    return F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda n, k: n + k)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, each once.

    Sets are moved only for pairs of similar sizes and sketches: the intersection is the smaller set at most, and of the sketches'
    bytes of a similar pair 205 of 256 are equal on average, LEAST_EQUAL or more but for one pair in five million.
    """
    for side in "ab":
        pairs = (pairs.distinct() if side == "a" else pairs).join(sets.select(F.col("fp").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    sizes = F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= SIMILARITY
    close = materialize(pairs.where(sizes & (equal_bytes(F.col("sketch_a"), F.col("sketch_b")) >= LEAST_EQUAL)).select("a", "b"), "close")
    wanted = close.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = sets.select("fp", "set").join(wanted, "fp", "left_semi")
    for side in "ab":
        close = close.join(wanted.select(F.col("fp").alias(side), F.col("set").alias(f"set_{side}")), side)
    met, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return materialize(close.where(met / (total - met) >= SIMILARITY).select("a", "b"), "links")


def components(pairs: DataFrame, members: DataFrame, sets: DataFrame, hot_key: int = HOT_KEY, stars: int = STARS) -> DataFrame:
    """(node, component) over the similar ones of pairs (a, b) and of all pairs of members (key, fp) that share a key."""
    sizes = materialize(members.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    few = members.join(sizes.where(F.col("size") <= hot_key).select("key"), "key", "left_semi")
    hot = materialize(members.join(sizes.where(F.col("size") > hot_key).select("key"), "key", "left_semi"), "hot")
    if hot.isEmpty():
        return connected_components(verified(pairs.unionByName(_paired(few.withColumn("component", F.col("fp")))), sets))
    # large groups fall into one component here, so the small keys of their members make fewer pairs
    stars_of = hot.groupBy("key").agg(F.min_by("fp", F.xxhash64("fp")).alias("star"))
    met = hot.join(stars_of, "key").where("fp <> star").select(F.greatest("fp", "star").alias("a"), F.least("fp", "star").alias("b"))
    named = materialize(connected_components(verified(pairs.unionByName(met), sets)), "named")
    found = verified(_paired(_placed(few, named)), sets)
    named = connected_components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    for k in range(stars + 1):
        named = materialize(named, "named")
        now = materialize(_placed(hot, named), "open")
        ends = now.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.min_by(F.struct("fp", "component"), F.xxhash64("fp", F.lit(k))).alias("star"))
        ends = materialize(ends.where("first < last").select("key", "star"), "ends")
        if ends.isEmpty():
            break
        if k < stars:
            met = now.join(ends, "key").where(F.col("component") != F.col("star.component"))
            pairs = met.select(F.greatest("fp", "star.fp").alias("a"), F.least("fp", "star.fp").alias("b"))
        else:
            pairs = prefix_pairs(now.join(ends.select("key"), "key", "left_semi").select("fp", "component").distinct(), sets)
        found = verified(pairs, sets)
        if not found.isEmpty():
            named = connected_components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
    return named


class Order:
    """One order of all shingles: by uses where they are known, those of unknown uses first, and then by hash.

    Any order that is the same for all sets is exact; putting frequent shingles last is what keeps prefixes apart. The KNOWN most
    used ones are known; if those are all that two sets share, the others meet nothing and are left out of prefixes.
    """

    def __init__(self, shingles: np.ndarray, uses: np.ndarray):
        self.complete = len(shingles) <= KNOWN
        by_hash = np.argsort(shingles[:KNOWN])
        self.shingles, self.uses = shingles[:KNOWN][by_hash], uses[:KNOWN][by_hash]

    def prefix(self, found: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(n, places, shingles) of the first n - ceil(s n) + 1 shingles of a set."""
        found = np.asarray(found, np.int64)
        n, uses = len(found), np.zeros(len(found), np.int64)
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
            uses = np.where(self.shingles[at] == found, self.uses[at], 0)
        order = np.lexsort((found, uses))[: n - math.ceil(n * SIMILARITY - 1e-9) + 1]
        places = np.flatnonzero(uses[order] > 0) if self.complete else np.arange(len(order))
        return n, places.astype(np.int32), found[order[places]]


def use_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, uses) over a task's sets, counted before any row is made: near copies share most shingles, so a large group of them
    makes few rows. A shingle may come again after every COUNTED shingles read."""
    held, size = [], 0
    for flat in itertools.chain((b.column(0).flatten().to_numpy(zero_copy_only=False) for b in batches), [None]):
        if flat is not None:
            held.append(flat)
            size += len(flat)
        if size and (flat is None or size >= COUNTED):
            found, uses = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_pydict({"shingle": found.astype(np.int64), "uses": uses.astype(np.int64)})
            held, size = [], 0


def prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (fp, component) of two components that may be similar enough, by prefix filters, which lose none.

    Shingles are put in one order for all, rare ones first. Of a similar pair, the larger set's first n - ceil(s n) + 1 and the
    smaller set's first n - ceil(2 s n / (1 + s)) + 1 share a shingle, s the least similarity: else too few are left to meet. From
    their first common shingle on there must be as many left in both as a similar pair has in common. Texts that share a passage
    but are less than similar have their own words in those places, however many they are.
    """
    open_sets = materialize(sets.select("fp", "set").join(members, "fp"), "open-sets")
    uses = open_sets.select("set").mapInArrow(use_counts, "shingle long, uses long").groupBy("shingle").agg(F.sum("uses").alias("uses")).where("uses > 1")
    known = uses.orderBy(F.desc("uses"), "shingle").limit(KNOWN + 1).toArrow()
    sent = sets.sparkSession.sparkContext.broadcast(Order(known["shingle"].to_numpy(), known["uses"].to_numpy()))

    @F.pandas_udf("struct<n: long, at: array<int>, shingle: array<long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([sent.value.prefix(x) for x in s], columns=["n", "at", "shingle"])

    own = materialize(open_sets.select("fp", "component", of("set").alias("p")).select("fp", "component", "p.*"), "prefixes")
    n = F.col("n")
    larger, smaller = (n - F.ceil(n * share - 1e-9) + 1 for share in (SIMILARITY, 2 * SIMILARITY / (1 + SIMILARITY)))

    def side(name: str, size: Column) -> DataFrame:
        """(shingle, component, fp, n, left) of each set's first `size` shingles; left is how many of the set are not before this one."""
        found = own.select("fp", "component", "n", F.explode(F.arrays_zip("at", "shingle")).alias("s")).where(F.col("s.at") < size)
        columns = {"component": F.col("component"), "fp": F.col("fp"), "n": F.col("n"), "left": F.col("n") - F.col("s.at")}
        return found.select(F.col("s.shingle").alias("shingle"), *[c.alias(f"{name}_{k}") for k, c in columns.items()])

    def fits(i: dict[str, Column], p: dict[str, Column]) -> Column:
        """Whether an index row (of least and greatest n and greatest left) and a probe row may be of a similar pair: what is left in
        both from this shingle on, against what must be in common."""
        sizes = (p["most"] >= i["least"]) & (i["most"] / p["least"] >= SIMILARITY)
        return sizes & (F.least(i["left"], p["left"]) >= (i["least"] + p["least"]) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)

    row = lambda x: {"least": F.col(f"{x}_n"), "most": F.col(f"{x}_n"), "left": F.col(f"{x}_left")}
    bound = lambda x: {k: F.col(f"{x}_{k}_all") for k in ("least", "most", "left")}
    sides = {x: side(x, size) for x, size in (("p", larger), ("i", smaller))}
    whole = {x: d.groupBy("shingle", f"{x}_component").agg(F.min(f"{x}_n").alias(f"{x}_least_all"), F.max(f"{x}_n").alias(f"{x}_most_all"), F.max(f"{x}_left").alias(f"{x}_left_all")) for x, d in sides.items()}
    # components meet first, so the members of one are never paired among themselves, and only where their bounds allow a pair
    i, p = whole["i"].alias("wi"), whole["p"].alias("wp")
    apart = i.join(p, (F.col("wi.shingle") == F.col("wp.shingle")) & (F.col("i_component") != F.col("p_component")) & fits(bound("i"), bound("p")))
    apart = apart.select(F.col("wi.shingle").alias("w"), F.col("i_component").alias("wi_component"), F.col("p_component").alias("wp_component"), *[F.col(f"p_{k}_all") for k in ("least", "most", "left")])
    near = apart.join(sides["i"], (F.col("w") == F.col("shingle")) & (F.col("wi_component") == F.col("i_component")) & fits(row("i"), bound("p"))).select("w", "wp_component", "i_fp", "i_n", "i_left")
    pairs = near.join(sides["p"], (F.col("w") == F.col("shingle")) & (F.col("wp_component") == F.col("p_component")) & fits(row("i"), row("p")))
    return pairs.select(F.greatest("i_fp", "p_fp").alias("a"), F.least("i_fp", "p_fp").alias("b"))


def _placed(members: DataFrame, named: DataFrame) -> DataFrame:
    """members (key, fp) with the component of each, which is the node itself where it has no link."""
    return members.join(named.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def _paired(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members (key, fp, component) that share a key and are in two components."""
    left, right = (members.select("key", F.col("fp").alias(f"{side}_fp"), F.col("component").alias(f"{side}_component")) for side in "xy")
    return left.join(right, "key").where("x_fp > y_fp and x_component <> y_component").select(F.col("x_fp").alias("a"), F.col("y_fp").alias("b"))


def decide(numbered: DataFrame, rid: str, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(rid, doc_id, fp, component_id, keep_rid) for each row of a table of with_row_ids. how: hot_key, stars of components()."""
    slim = numbered.select(F.col(rid).alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(with_signatures(slim).select("rid", "doc_id", "_s.*"), "signatures")
    with cleaned():
        found = materialize(components(*candidates(numbered, rid, text, rows), **how), "components", keep=True)
    return simhash.groups(rows.select("rid", "doc_id", "fp"), found)


def candidates(numbered: DataFrame, rid: str, text: str, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, members, sets) of components(): nodes that are alone with one other under a key or linked by their SimHashes, nodes of
    larger keys, all their sets."""
    keyed = rows.select("fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.max("fp").alias("a"), F.min("fp").alias("b")).where("a > b")
    shared = materialize(shared, "shared")
    pairs = materialize(shared.where("size = 2").select("a", "b").unionByName(simhash_pairs(rows)), "pairs")
    members = materialize(keyed.join(shared.where("size > 2").select("key"), "key", "left_semi").distinct(), "members")
    met = pairs.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(members.select("fp")).distinct()
    wanted = rows.select("fp", "rid").join(met, "fp", "left_semi").groupBy("fp").agg(F.min("rid").alias(rid)).select(rid)
    sets = materialize(sets_of(keep_rows(numbered.select(rid, f"{rid}_block", F.col(text).alias("text")), rid, wanted)), "sets")
    return pairs, members, sets


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (fp, sim), repeated or not, that join all whose SimHashes are within simhash.DISTANCE bits: by links() of
    the distinct SimHashes, each standing for the least of its nodes, and from the other nodes of one SimHash to that."""
    ends = materialize(rows.groupBy("sim").agg(F.min("fp").alias("b"), F.max("fp").alias("top")), "sims")
    same = rows.select("sim", F.col("fp").alias("a")).join(ends.where("b < top"), "sim").where("a > b").select("a", "b").distinct()
    found = simhash.links(ends.select(F.col("sim").alias("fp")))
    for side in "ab":
        found = found.withColumnRenamed(side, "sim").join(ends.select("sim", F.col("b").alias(f"{side}_fp")), "sim").drop("sim")
    return same.unionByName(found.select(F.greatest("a_fp", "b_fp").alias("a"), F.least("a_fp", "b_fp").alias("b")))


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """decide() over a table without row ids."""
    return decide(*with_row_ids(df.select(doc_id, text), "near"), doc_id, text, **how).drop("rid", "keep_rid")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with one row of each near-duplicate group, the one with the least id, all columns as they were."""
    numbered, rid = with_row_ids(df, "near")
    kept = decide(numbered, rid, doc_id, text, **how).where("rid = keep_rid").select(F.col("rid").alias(rid))
    return keep_rows(numbered, rid, kept)
