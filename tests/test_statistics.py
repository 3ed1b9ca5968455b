"""Exact tests, null tables, adjusted p-values and hazards against plain versions."""

import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyoflux.functions import nulls, ranked, stats, tails
from karyoflux.operators import chromothripsis, cohort, survival


def cells(a, b, c, d):
    """Exact probability of every first cell with these margins."""
    m, n, k = a + b, c + d, a + c
    return {i: Fraction(math.comb(m, i) * math.comb(n, k - i), math.comb(m + n, k)) for i in range(max(0, k - n), min(m, k) + 1)}


def test_tables_of_two_by_two(spark):
    r = random.Random(1)
    rows = [(0, 0, 0, 0), (3, 1, 1, 3), (0, 5, 5, 0), (300, 2, 1, 250)] + [tuple(r.choice([0, 1, 3, 8, 40, 120]) for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    table = [F.col(c) for c in "abcd"]
    got = tails.with_odds_ratio(df, "odds", *table).withColumns({"up": tails.fisher_greater(*table), "two": tails.fisher_two_sided(*table)}).collect()
    assert len(got) == len(rows)
    for g in got:
        p = cells(g.a, g.b, g.c, g.d)
        assert g.up == pytest.approx(float(sum(v for i, v in p.items() if i >= g.a)), rel=1e-9)
        assert g.two == pytest.approx(float(sum(v for v in p.values() if v <= p[g.a] * Fraction(10_000_001, 10_000_000))), rel=1e-9)
        if g.a == min(p):
            assert g.odds == 0
        elif g.a == max(p):
            assert math.isinf(g.odds)
        else:  # the mean under that ratio is the cell
            w = {i: float(v) * math.exp((i - g.a) * math.log(g.odds)) for i, v in p.items()}
            assert sum(i * v for i, v in w.items()) / sum(w.values()) == pytest.approx(g.a, rel=1e-9)


def test_binomial_and_special_functions(spark):
    rows = [(x, n, p) for n, p in ((1, 0.5), (10, 0.5), (10, 0.01), (60, 0.37), (7, 0.0), (7, 1.0)) for x in {0, n // 2, n}] + [(0, 0, 0.5)]
    for g in spark.createDataFrame(rows, "x long, n long, p double").withColumn("v", tails.binomial_two_sided(F.col("x"), F.col("n"), F.col("p"))).collect():
        probs = [math.comb(g.n, i) * g.p**i * (1 - g.p) ** (g.n - i) for i in range(g.n + 1)]
        assert (g.v is None) if g.n == 0 else g.v == pytest.approx(sum(q for q in probs if q <= probs[g.x] * (1 + 1e-7)), rel=1e-9, abs=1e-300)
    x = [k / 20 for k in range(300)]
    for g in spark.createDataFrame([(v,) for v in x], "x double").select("x", tails.erfc(F.col("x")).alias("e"), tails.log_gamma(F.col("x") + 0.25).alias("g"), tails.chi2_1_upper(F.col("x")).alias("c")).collect():
        assert g.e == pytest.approx(math.erfc(g.x), rel=1e-11, abs=1e-300) and g.g == pytest.approx(math.lgamma(g.x + 0.25), rel=1e-12, abs=1e-12) and g.c == pytest.approx(math.erfc(math.sqrt(g.x / 2)), rel=1e-11)
    (g,) = spark.sql("SELECT cast(null AS double) AS x").select(tails.chi2_1_upper(F.col("x")).alias("one"), tails.chi2_3_upper(F.col("x")).alias("three"), tails.chi2_1_upper(F.lit(0.0)).alias("zero")).collect()
    assert tuple(g) == (None, None, 1.0)
    # I_x(a, b) for whole a and b is a binomial tail; rank correlations have a half as b
    (g,) = spark.range(1).select(tails.beta_inc(F.lit(3), F.lit(5), F.lit(0.3)).alias("v"), tails.correlation_pvalue(F.lit(0.5), F.lit(12)).alias("t"), tails.correlation_pvalue(F.lit(0.5), F.lit(2)).alias("one"), tails.correlation_pvalue(F.lit(-1.0), F.lit(9)).alias("zero")).collect()
    assert g.v == pytest.approx(sum(math.comb(7, k) * 0.3**k * 0.7 ** (7 - k) for k in range(3, 8)), rel=1e-12)
    t = 0.5 * math.sqrt(10 / 0.75)
    area = sum((1 + (t + (k + 0.5) / 1000) ** 2 / 10) ** -5.5 for k in range(200_000)) / 1000
    assert g.t == pytest.approx(2 * area * math.gamma(5.5) / math.gamma(5) / math.sqrt(10 * math.pi), rel=1e-5) and (g.one, g.zero) == (1, 0)


def test_leading(spark):
    rows = [(list(range(n)), v) for n in (0, 1, 2, 7, 8, 9) for v in (-1, 0, 3, 100)]
    got = spark.createDataFrame(rows, "a array<int>, v int").select("a", "v", tails.leading(F.col("a"), 9, lambda x: x < F.col("v")).alias("n")).collect()
    assert all(g.n == sum(x < g.v for x in g.a) for g in got)


def test_equal_shares(spark):
    null = {(r.n, r.squares): r.pvalue for r in nulls.equal_shares(spark.createDataFrame([(n,) for n in (1, 2, 5, 8)], "n long")).collect()}
    for n in (1, 2, 5, 8):
        sums = Counter(sum(v * v for v in (w.count(k) for k in range(4))) for w in itertools.product(range(4), repeat=n))
        assert {q for m, q in null if m == n} == set(sums)
        assert all(null[n, q] == pytest.approx(sum(c for k, c in sums.items() if k >= q) / 4**n, rel=1e-12) for q in sums)
    df = spark.createDataFrame([(0, 0, 0, 0), (5, 0, 0, 0), (2, 1, 1, 1), (200, 150, 180, 170)], "a long, b long, c long, d long")
    got = {g.a: g.p for g in nulls.with_equal_shares_p(df, list("abcd"), "p").collect()}
    assert got[0] is None and got[5] == pytest.approx(4 / 4**5) and got[2] == pytest.approx(1.0)
    chi = sum((x - 175) ** 2 / 175 for x in (200, 150, 180, 170))  # above ENUMERATED: chi-square
    assert got[200] == pytest.approx(math.erfc(math.sqrt(chi / 2)) + math.sqrt(2 * chi / math.pi) * math.exp(-chi / 2), rel=1e-9)


def test_gaps_null_is_near_another_simulation(spark):
    df = spark.createDataFrame([(d / 40, n) for n in (5, 30) for d in range(4, 20)] + [(None, 5), (0.2, None)], "d double, n long")
    rng = np.random.default_rng(1)
    for g in nulls.with_gaps_p(df, "d", "n", "p").collect():
        if g.d is None or g.n is None:
            assert g.p is None
            continue
        x = np.sort(rng.exponential(size=(4000, g.n)), axis=1)
        cdf, i = 1 - np.exp(-x / x.mean(axis=1, keepdims=True)), np.arange(1, g.n + 1)
        d = np.maximum((i / g.n - cdf).max(axis=1), (cdf - (i - 1) / g.n).max(axis=1))
        assert abs(g.p - (d >= g.d).mean()) < 0.06


def brute_bh(p):
    known = sorted(v for v in p if v is not None)
    return [None if v is None else min(1.0, min(q * len(known) / sum(w <= q for w in known) for q in known if q >= v)) for v in p]


@pytest.mark.parametrize("in_task", [0, 100_000])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_adjusted_p(spark, keys, in_task):
    r = random.Random(4)
    rows = [(i, r.choice(["x", "y", None]), r.choice([None, 1.0, 1.0, 0.01, r.random(), round(r.random(), 1)])) for i in range(300)]
    got = {g.i: g.q for g in ranked.with_bh(spark.createDataFrame(rows, "i long, g string, p double"), "p", "q", keys, ranges=7, ordered_in_task=in_task).collect()}
    want = {}
    for g in {x[1] for x in rows} if keys else {0}:
        own = [x for x in rows if not keys or x[1] == g]
        want |= dict(zip([x[0] for x in own], brute_bh([x[2] for x in own]), strict=True))
    assert got.keys() == want.keys() and all((got[i] is None) == (want[i] is None) and (got[i] is None or got[i] == pytest.approx(want[i], rel=1e-12)) for i in want)
    none = spark.createDataFrame([(1, "x", None)], "i long, g string, p double")
    assert [x.q for x in ranked.with_bh(none, "p", "q", keys).collect()] == [None] and ranked.with_bh(none.limit(0), "p", "q", keys).count() == 0


def test_running_sums(spark):
    rows = [(g, v, v % 5) for g in ("a", "b") for v in range(100)]
    for down in (False, True):
        got = ranked.running(spark.createDataFrame(rows, "g string, v long, w long"), ["g"], "v", {"s": F.col("w")}, down, ranges=9).collect()
        assert all(x.s == sum(w for g, v, w in rows if g == x.g and (v >= x.v if down else v <= x.v)) for x in got) and len(got) == 200


def log_likelihood(beta, time, event, x):
    """Efron's partial likelihood, written out."""
    total = 0.0
    for t in sorted(set(time[event == 1])):
        dead, risk = np.flatnonzero((time == t) & (event == 1)), np.flatnonzero(time >= t)
        total += (x[dead] @ beta).sum()
        total -= sum(math.log(np.exp(x[risk] @ beta).sum() - k / len(dead) * np.exp(x[dead] @ beta).sum()) for k in range(len(dead)))
    return total


def test_hazards_maximise_the_likelihood():
    rng = np.random.default_rng(3)
    time, event, x = rng.integers(1, 12, 80).astype(float), (rng.random(80) < 0.7).astype(int), rng.normal(size=(80, 2))
    beta, se = stats.cox(time, event, x)
    at = log_likelihood(beta, time, event, x)
    h = 1e-4
    step = np.eye(2) * h
    assert all(at > log_likelihood(beta + d, time, event, x) for s in step for d in (s * 50, -s * 50))
    hess = np.array([[(log_likelihood(beta + a + b, time, event, x) - log_likelihood(beta + a - b, time, event, x) - log_likelihood(beta - a + b, time, event, x) + log_likelihood(beta - a - b, time, event, x)) / (4 * h * h) for b in step] for a in step])
    assert np.sqrt(np.diag(np.linalg.inv(-hess))) == pytest.approx(se, rel=1e-3)
    assert np.isnan(stats.cox(time, event, np.c_[x[:, :1], x[:, :1]])[0]).all() or np.isfinite(stats.cox(time, event, np.c_[x[:, :1], x[:, :1]])[0]).all()  # collinear: no crash


def test_hazards_in_rounds_are_those_of_one_task(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", float(rng.integers(1, 30)), int(rng.random() < 0.6), f, v) for i in range(200) for f, v in (("a", float(i % 2)), ("b", float(rng.normal())), ("flat", 1.0))]
    x = spark.createDataFrame(rows, "sample_id string, time double, event int, feature string, value double")
    covariates = spark.createDataFrame([(f"s{i}", float(rng.normal()), None if i == 3 else float(i % 5)) for i in range(200)], "sample_id string, c1 double, c2 double")
    one, many = ({(r.feature, r.model): r for r in survival.cox_tests(x, covariates, fitted_in_task=n).collect()} for n in (1000, 0))
    assert one.keys() == many.keys() == {(f, m) for f in "ab" for m in ("univariable", "multivariable")}
    for k, r in one.items():
        assert all(many[k][c] == pytest.approx(r[c], rel=1e-9) for c in ("hazard_ratio", "conf_low", "conf_high", "pvalue", "fdr"))
        assert r.hazard_ratio is not None and (r.n, r.covariates) == ((199, "c1,c2") if k[1] == "multivariable" else (200, ""))


def test_hazards_without_an_estimate(spark):
    """All who have the feature die first: the estimate runs away and says nothing. A flat covariate leaves none at all."""
    rows = [(f"s{i}", float(i + 1), 1, "a", float(i < 5)) for i in range(10)]
    x = spark.createDataFrame(rows, "sample_id string, time double, event int, feature string, value double")
    flat = spark.createDataFrame([(f"s{i}", 1.0) for i in range(10)], "sample_id string, c double")
    for n in (1000, 0):
        got = {r.model: r for r in survival.cox_tests(x, flat, fitted_in_task=n).collect()}
        assert got["univariable"].pvalue > 0.9 and got["univariable"].hazard_ratio > 1e6
        r = got["multivariable"]
        assert (r.n, r.hazard_ratio, r.conf_low, r.conf_high, r.pvalue, r.fdr) == (10, None, None, None, None, None)


def test_crossings():
    r = random.Random(1)
    for _ in range(400):
        a = [r.randrange(15) for _ in range(r.randrange(12))]
        b = [p + r.randrange(-1, 9) for p in a]
        cross = lambda i, j: a[i] < a[j] <= b[i] + 2 and b[i] < b[j]  # noqa: B023, E731
        assert chromothripsis.crossings(a, b) == [sum(cross(i, j) or cross(j, i) for j in range(len(a))) for i in range(len(a))]


def test_comparison_of_groups(spark):
    summary = spark.createDataFrame([(f"s{i}", int(i < 6), int(i % 2), int(i < 3), 0, 1, 0) for i in range(12)], "sample_id string, chromothripsis_high_confidence int, chromothripsis_low_confidence int, chromoplexy_likely int, chromoplexy_possible int, chromoanasynthesis_likely int, chromoanasynthesis_possible int")
    clinical = spark.createDataFrame([(f"s{i}", "x" if i < 7 else "y" if i < 11 else None) for i in range(12)], "sample_id string, grp string")
    counts, tests = cohort.compare_mechanisms(summary, clinical)
    got = {t.mechanism: t for t in tests.collect()}
    assert set(got) == {"chromothripsis", "chromoplexy"}  # all samples have the third, so it has no test
    p = cells(6, 0, 1, 4)
    assert got["chromothripsis"].test == "Fisher's Exact" and got["chromothripsis"].pvalue == pytest.approx(float(sum(v for v in p.values() if v <= p[6]))) and got["chromothripsis"].stars == "*" and got["chromoplexy"].stars == ""
    loose = {c.mechanism: c.n_positive for c in cohort.compare_mechanisms(summary, clinical, stringency="inclusive")[0].where("grp = 'y'").collect()}
    assert loose["chromothripsis"] == 2 and {c.n_samples for c in counts.where("grp = 'x'").collect()} == {7}
    many = clinical.withColumn("grp", F.concat("grp", F.substring("sample_id", 2, 1).cast("int") % 2))
    assert {t.test for t in cohort.compare_mechanisms(summary, many)[1].collect()} == {"Chi-squared"}
    with pytest.raises(ValueError):
        cohort.mechanism_status(summary, "loose")
