"""Filter audit, URL filter and whitening against plain versions over all rows, on small hard tables."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyoflux.llm import filter_audit, urls, whitening
from karyoflux.llm import queries as llm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- filter audit -----------------------------------------------------------------------------------------------------------
def brute_fails(docs):
    """Set of letters that each (doc_id, text) fails."""
    out = []
    for doc_id, text in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A"} if len(w) < 100 else set()
        fails |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u in docs) else set()
        out.append(fails)
    return out


def brute_steps(rows, letters):
    """Applies every order to rows of (part, fails, good, toxic) filter by filter."""
    found = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys(letters, 0)
        for order in itertools.permutations(letters):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                out, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[f] += len(out)
                found[part, "".join(order), step] = [len(left), len(out), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in out), sum(r[3] for r in out)]
                gone += out
        for key in found:
            if key[0] == part:
                found[key].append(shapley[key[1][key[2] - 1]])
    return found


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_hard_rows(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    many = " ".join(r.sample(words, 120))
    texts = [None, "", " \t\n", many, many + " $", many.upper(), f"\n{many}\r", " ".join(["same"] * 150), "é中 " * 40, "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, " ".join(words * 300), "x" * 200_000]
    ids = [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    docs = [(r.choice(ids), r.choice(texts), r.choice(["en", "", None, "de"])) for _ in range(150)]
    docs += docs[:10] + [(8 + i, many, "en") for i in range(60)]
    labels = [(1, 1, None), (1, 0, 0), (2, None, 1), (None, 1, 1), (5, 1, 1), (6, 0, 0), (99, 1, 1), (9, 1, 0)]
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    want = brute_steps([(lang or "", fails, d in good, d in toxic) for (d, _, lang), fails in zip(docs, brute_fails([x[:2] for x in docs]), strict=True)], "ABCDE")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("part", "mask", "digest", "n", "key", "good", "step")})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash"))
    got = filter_audit.audit(df, said).collect()
    assert {(g.part, g.filter_order, g.step): [g[c] for c in COUNTS] for g in got} == want and len(got) == len(want) == 3 * 600
    assert filter_audit.audit(df.limit(0), said).count() == 0
    assert {g.toxic_lost + g.good_lost for g in filter_audit.audit(df, said.limit(0)).collect()} == {0}


def test_steps_of_three_filters(spark):
    r = random.Random(2)
    rows = [(r.choice("pq"), frozenset(f for f in "XYZ" if r.random() < 0.4), r.random() < 0.3, r.random() < 0.1) for _ in range(200)]
    mask = lambda fails: sum(1 << "XYZ".index(f) for f in fails)
    df = spark.createDataFrame([(p, mask(f), int(g), int(t)) for p, f, g, t in rows], "part string, mask int, good int, toxic int")
    counts = df.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    got = {(g.part, g.filter_order, g.step): [g[c] for c in COUNTS] for g in filter_audit.order_steps(counts, "XYZ").collect()}
    assert got == brute_steps(rows, "XYZ")
    with pytest.raises(ValueError):
        filter_audit.order_steps(counts, "XX")


def test_zeta(spark):
    values = [random.Random(1).randrange(100) for _ in range(32)]
    got = filter_audit.zeta(spark.createDataFrame([(values,)], "v array<long>"), ["v"], 5).first().v
    assert got == [sum(values[m] for m in range(32) if m & s == m) for s in range(32)]


# -- URL filter -------------------------------------------------------------------------------------------------------------
URLS = [
    None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?b=2&a=1#f", "http://example.com/en/", "http://example.com/en", "http://xexample.com/en/1", "https://com/",
    "http://b.net/es/1", "http://b.net/fr/", "http://b.net/de/1", "http://net/es/", "http://b.org/1/?utm_source=x&ref=y", "http://www.b.org:80/1", "http://b.org/1?z=&ref", "http://B.org/1#top", "http://b.org/2?reference=1",
    "http://b.org/2", "x://y.org?q=/en/", "http://b.org//3//", "http://b.org/3", "a://b://c.com/d", "http://\u00dc.com/\u00e4", "http://deep." + "x." * 400 + "com/" + "p/" * 2000, "http://a.com/\nen/", "http://b.org./1", "http://m.b.org/p%20q/",
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("NET", "/fr/", "block"), ("b.net", "/fr/", "allow"), ("b.net", "/fr/", "block"), (None, "/", "block"), ("deep.org", None, "block")]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def brute_canonical(url):
    if url is None or "://" not in url:
        return None
    host, path = brute_parts(url)
    rest = url.split("://", 1)[1].split("#")[0]
    query = rest.split("?", 1)[1] if "?" in rest else ""
    params = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|gclid|fbclid|ref)(=|\Z)", p))
    host = re.sub(r":(80|443)\Z", "", host.removeprefix("www."))
    return host + path.rstrip("/") + ("?" + "&".join(params) if params else "")


def brute_verdict(url, blocked):
    host, path = brute_parts(url)
    fits = [(len(h) + len(p or ""), len(h), v, h.lower() + (p or "")) for h, p, v in RULES if h is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "") and url and "://" in url]
    if fits:
        return max(fits)[3], max(fits)[2]
    c = brute_canonical(url)
    return None, "block" if c is not None and c in {brute_canonical(b) for b in blocked} else "allow"


@pytest.mark.parametrize(("hot_share", "most_blocks"), [(1000, 1 << 17), (1, 1 << 17), (20, 1)])
def test_url_verdicts(spark, hot_share, most_blocks):
    blocked = ["https://b.org/1/", "http://b.org/3", None, "b.org/2", "http://zzz.org/" + "q" * 3000] + [f"http://list.org/{i}" for i in range(500)]
    seen = URLS + URLS[:7] + ["http://hot.a.com/1"] * 50
    pages = [(i if i % 7 else None, u) for i, u in enumerate(seen)] + [(3, "http://b.org/1")] * 3
    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "path", "key", "rule", "block", "w0", "verdict")})
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([(b,) for b in blocked], "url string")
    got = sorted(((g.page_id, g.url, g.host, g.path, g.rule, g.verdict) for g in urls.judge(df, rules, listed, hot_share, most_blocks).collect()), key=str)
    assert got == sorted(((i, u, *brute_parts(u), *brute_verdict(u, blocked)) for i, u in pages), key=str)
    none = urls.judge(df, rules.limit(0), listed.limit(0), hot_share, most_blocks)
    assert {(g.rule, g.verdict) for g in none.collect()} == {(None, "allow")} and none.count() == len(pages)
    assert urls.judge(df.limit(0), rules, listed).count() == 0


def test_canonical(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", urls.canonical(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == {u: brute_canonical(u) for u in URLS}


def test_bloom_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("url k"), F.col("id").cast("string")).alias("key"), "id")
    blocks = urls.filter_size(10_000)
    passed = urls.possible_hits(keys, urls.bloom_blocks(keys.where("id < 10000"), blocks), blocks)
    counts = {r.listed: r["count"] for r in passed.groupBy((F.col("id") < 10_000).alias("listed")).count().collect()}
    assert counts[True] == 10_000 and counts.get(False, 0) < 100
    assert urls.filter_size(10**12) == urls.MOST_BLOCKS and urls.filter_size(0) == 1


def test_url_query_is_the_rules_of_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in llm.op12_url_filter(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect():
        host, path = brute_parts(r.url)
        fits = [h + p for h, p, _ in llm.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, max(fits, key=len, default=None))


# -- whitening --------------------------------------------------------------------------------------------------------------
def brute_whitening(vectors, k=4):
    """(n, S, V's eigenvalues and vectors) over distinct integer vectors, by a covariance of exactly centred rows."""
    x = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors})
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    rows = np.array([[(n * a - s) / n for a, s in zip(v, total, strict=True)] for v in x])
    e, w = np.linalg.eigh(rows.T @ rows / n)
    return n, total, e[::-1], w[:, ::-1].T


def vectors_frame(spark, vectors, parts=5):
    rows = [(i, [float(c) if c is not None else None for c in v] if v is not None else None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts).withColumns({c: F.lit("clash") for c in ("x", "n", "whitened", "part")})


@pytest.mark.parametrize("shift", [0.0, 4000.0])
def test_whitening_is_the_eigenbasis(spark, shift):
    rng = np.random.default_rng(3)
    clean = rng.normal(size=(400, 7)) * np.array([5, 3, 2, 1, 0.5, 0.2, 0.1]) + shift
    vectors = [*clean.tolist(), *clean[:100].tolist(), *[clean[0].tolist()] * 300]
    bad = [None, [], [1.0, None] + [0.0] * 5, [float("nan")] * 7, [float("inf")] + [0.0] * 6, [1e30] * 7, [1.0, 2.0]]
    got = whitening.components(vectors_frame(spark, vectors + bad)).collect()
    assert len(got) == 4 * len(vectors) and {g.vec_id for g in got} == set(range(len(vectors)))
    n, total, e, w = brute_whitening(vectors)
    sign = {}
    for g in got:
        x = [math.floor(256 * c) for c in vectors[g.vec_id]]
        assert g.n == n and g.deviation == sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
        want = float(np.dot([(n * a - s) / n for a, s in zip(x, total, strict=True)], w[g.component - 1]) / np.sqrt(e[g.component - 1]))
        if abs(want) > 1e-3:
            sign.setdefault(g.component, np.sign(want) * np.sign(g.whitened))
        assert abs(sign.get(g.component, 1) * g.whitened - want) < 1e-6
        assert abs(g.explained - e[g.component - 1] / e.sum()) < 1e-9 and 0 <= g.identity_error < 1e-9
    assert len({g.identity_error for g in got}) == 1


def test_whitening_of_few_and_flat_vectors(spark):
    same = whitening.components(vectors_frame(spark, [[0.5, 0.25, 1.0]] * 9)).collect()
    assert len(same) == 27 and {(g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in same} == {(1, 0, None, None, None)}
    line = whitening.components(vectors_frame(spark, [[float(i), 2.0 * i, 0.0] for i in range(50)])).collect()
    assert {(g.component, g.whitened is None, round(g.explained, 9)) for g in line} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)} and line[0].identity_error < 1e-9
    empty = whitening.components(vectors_frame(spark, [[1.0]]).limit(0))
    assert empty.count() == 0 and "identity_error" in empty.columns


def test_merging_loses_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, size=(900, 12)) + 10**9
    x[:, 3] = x[:, 2]  # rank deficient
    parts = [whitening.summary_of(p) for p in np.array_split(x, [1, 2, 10, 400, 402])]
    total = parts[0]
    for p in parts[1:]:
        total = whitening.merged(total, p)
    rows = x - 10**9 - (x - 10**9).mean(axis=0)
    assert total.n == 900 and total.sums == [int(v) for v in x.sum(axis=0)] and total.scaled.shape == (12, 12)
    assert np.allclose(total.scaled.T @ total.scaled, rows.T @ rows, rtol=1e-11, atol=1e-3)


def test_deviations_beyond_a_long():
    assert whitening.deviations(np.array([[3, -1], [0, 0]]), 2, [3, -1]) == [10, 10]
    assert whitening.deviations(np.array([[1 << 40, 0]]), 1 << 30, [0, 0]) == [None]
    assert whitening.deviations(np.array([[1 << 20, 0]]), 1 << 11, [1, 0]) == [((1 << 31) - 1) ** 2]
