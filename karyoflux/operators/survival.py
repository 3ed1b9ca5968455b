"""Survival: features of samples, proportional hazards, product-limit curves and log-rank tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.functions import stats
from karyoflux.functions.ranked import running, with_bh, with_range
from karyoflux.functions.tails import chi2_1_upper
from karyoflux.runtime import materialize

# Words that stand for an event and for none.
EVENT_WORDS = ("1", "true", "t", "yes", "y", "event", "dead", "deceased", "progressed", "progression", "relapsed")
NO_EVENT_WORDS = ("0", "false", "f", "no", "n", "censored", "alive", "none", "no event")


def event_flag(c: Column) -> Column:
    """0 or 1 from a boolean, a number or text, words or numbers; null for anything else."""
    t = F.lower(F.trim(c.cast("string")))
    number = t.try_cast("double")
    return F.when(t.isin(*EVENT_WORDS) | (number == 1), 1).when(t.isin(*NO_EVENT_WORDS) | (number == 0), 0)


def feature_name(name: str) -> str:
    import re

    return re.sub("_+", "_", re.sub("[^A-Za-z0-9]+", "_", name)).strip("_").lower()


def features(summary: DataFrame, event: DataFrame | None = None, fusion: DataFrame | None = None, detail: DataFrame | None = None) -> DataFrame:
    """One row a sample: the integrated summary's counts, the chain events, the genes at them (detail) and the fusions.

    Counts of what is absent are 0; scores of samples without events are null, and skipped like other nulls.
    """
    num = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in summary.columns else F.lit(0)
    flag = lambda c: c.cast("int")
    mode = F.col("analysis_mode") if "analysis_mode" in summary.columns else F.lit(None).cast("string")
    s = summary.select(
        "sample_id", mode.alias("analysis_mode"), num("chromothripsis_high_confidence").alias("ct_high_confidence"), num("chromothripsis_low_confidence").alias("ct_low_confidence"),
        num("chromoplexy_likely").alias("cp_likely_chains"), num("chromoplexy_possible").alias("cp_possible_chains"), (F.col("chromoplexy_chains") if "chromoplexy_chains" in summary.columns else F.lit(None).cast("long")).alias("cp_total_chains"),
        num("chromoanasynthesis_likely").alias("cs_likely_events"), num("chromoanasynthesis_possible").alias("cs_possible_events"),
    )
    counts = {"High": "n_high_confidence_chromoplexy_events", "Moderate": "n_moderate_confidence_chromoplexy_events", "Low": "n_low_confidence_chromoplexy_events"}
    zero = ["n_chromoplexy_events", *counts.values(), "total_event_svs", "total_event_breakpoints", "max_n_svs", "max_n_breakpoints", "max_n_chromosomes", "cycles"]
    if event is None:
        s = s.select("*", *[F.lit(0).alias(c) for c in zero], F.lit(None).cast("double").alias("mean_event_qc_score"), F.lit(None).cast("double").alias("max_event_qc_score"))
    else:
        e = event.groupBy("sample_id").agg(
            F.count("*").alias("n_chromoplexy_events"), *[F.count_if(F.col("event_confidence") == k).alias(v) for k, v in counts.items()], F.sum("n_unique_svs").alias("total_event_svs"), F.sum("n_breakpoints").alias("total_event_breakpoints"),
            F.max("n_unique_svs").alias("max_n_svs"), F.max("n_breakpoints").alias("max_n_breakpoints"), F.max("n_chromosomes").alias("max_n_chromosomes"), F.count_if(F.col("has_cycle")).alias("cycles"),
            F.avg("event_qc_score").alias("mean_event_qc_score"), F.max("event_qc_score").alias("max_event_qc_score"),
        )
        s = s.join(e, "sample_id", "left").na.fill(0, zero)
    if detail is None:
        s = s.select("*", F.lit(0).alias("n_chromoplexy_genes"), F.lit(0).alias("n_chromoplexy_driver_genes"), F.lit("").alias("affected_chromoplexy_genes"), F.lit("").alias("chromoplexy_driver_genes"))
    else:
        names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
        driver = F.when(F.col("is_driver"), F.col("symbol"))
        g = detail.groupBy("sample_id").agg(F.countDistinct("symbol").alias("n_chromoplexy_genes"), F.countDistinct(driver).alias("n_chromoplexy_driver_genes"), names("symbol").alias("affected_chromoplexy_genes"), names(driver).alias("chromoplexy_driver_genes"))
        s = s.join(g, "sample_id", "left").na.fill(0, ["n_chromoplexy_genes", "n_chromoplexy_driver_genes"]).na.fill("", ["affected_chromoplexy_genes", "chromoplexy_driver_genes"])
    if fusion is None:
        s = s.withColumn("n_fusions", F.lit(0))
    else:
        s = s.join(fusion.groupBy("sample_id").agg(F.count("*").alias("n_fusions")), "sample_id", "left").na.fill(0, ["n_fusions"])
    ct, cp, cs = F.col("ct_high_confidence") + F.col("ct_low_confidence"), F.col("cp_likely_chains") + F.col("cp_possible_chains"), F.col("cs_likely_events") + F.col("cs_possible_events")
    some = F.col("n_chromoplexy_events") > 0
    return s.select(
        "sample_id", "analysis_mode", flag(F.coalesce(F.col("analysis_mode").contains("SV-only"), F.lit(False))).alias("is_sv_only"), "ct_high_confidence", "ct_low_confidence", flag(ct > 0).alias("has_chromothripsis"),
        "cp_likely_chains", "cp_possible_chains", F.coalesce("cp_total_chains", cp).alias("cp_total_chains"), flag((cp > 0) | some).alias("has_chromoplexy"), "cs_likely_events", "cs_possible_events", flag(cs > 0).alias("has_chromoanasynthesis"),
        flag((ct + cp + cs > 0) | some).alias("has_chromoanagenesis"), "n_chromoplexy_events", *counts.values(), flag(F.col(counts["High"]) > 0).alias("has_high_confidence_chromoplexy_event"), "mean_event_qc_score", "max_event_qc_score",
        "total_event_svs", "total_event_breakpoints", "max_n_svs", "max_n_breakpoints", "max_n_chromosomes", flag(F.col("max_n_chromosomes") >= 2).alias("has_multichromosomal_chromoplexy_event"), flag(F.col("cycles") > 0).alias("has_cycle_chromoplexy_event"),
        "n_chromoplexy_genes", "n_chromoplexy_driver_genes", flag(F.col("n_chromoplexy_driver_genes") > 0).alias("has_chromoplexy_driver_gene"), "n_fusions", "affected_chromoplexy_genes", "chromoplexy_driver_genes",
    )


def two_levels(f: DataFrame, columns: list[str]) -> DataFrame:
    """f with text columns of exactly two values as 0 and 1 in order of the values; empty text is missing. Other text stays."""
    if not columns:
        return f
    clean = {c: F.nullif(F.col(c), F.lit("")) for c in columns}
    ends = f.agg(*[F.min(v).alias(f"lo{k}") for k, v in enumerate(clean.values())], *[F.max(v).alias(f"hi{k}") for k, v in enumerate(clean.values())]).first()
    lo, hi = ends[: len(columns)], ends[len(columns) :]
    only = f.agg(*[F.coalesce(F.bool_and(clean[c].isin(lo[k], hi[k])), F.lit(False)).alias(f"c{k}") if lo[k] is not None and lo[k] < hi[k] else F.lit(False).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return f.withColumns({c: F.when(clean[c].isNotNull(), (clean[c] == hi[k]).cast("int")) for k, c in enumerate(columns) if only[k]})


def pathway_hits(genes: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """(sample_id, set_name, hits): genes of a sample (sample_id, symbol) in each set, whatever their case."""
    g = genes.select("sample_id", F.upper("symbol").alias("symbol")).distinct()
    return g.join(gene_sets.select("set_name", F.upper("symbol").alias("symbol")).distinct(), "symbol").groupBy("sample_id", "set_name").agg(F.count("*").alias("hits"))


def long_form(f: DataFrame, clinical: DataFrame, columns: list[str] | None = None, time: str = "os_time", event: str = "os_event") -> DataFrame:
    """(sample_id, time, event, feature, value) of samples with a positive time and a known event; numbers, truth values and text of
    two values are features."""
    f = two_levels(f, [c for c, t in f.dtypes if c != "sample_id" and t == "string" and (columns is None or c in columns)])
    names = columns or [c for c, t in f.dtypes if c != "sample_id" and t in ("int", "bigint", "double", "boolean")]
    c = clinical.select("sample_id", F.col(time).cast("double").alias("time"), event_flag(F.col(event)).alias("event")).where("time > 0 AND event IS NOT NULL")
    x = f.select("sample_id", F.explode(F.array(*[F.struct(F.lit(feature_name(n)).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("f")).select("sample_id", "f.*")
    return x.join(c, "sample_id").where(F.col("value").isNotNull())


def groups(x: DataFrame) -> DataFrame:
    """long_form with grp: Absent or Present for features of 0 and 1, else Low up to the median and High above it.

    The exact median comes from counts of values, a row a feature, and meets the samples in a join.
    """
    per = x.groupBy("feature").agg(F.min(F.col("value").isin(0.0, 1.0).cast("int")).alias("binary"), F.percentile("value", F.lit(0.5)).alias("cutpoint"))
    per = per.withColumn("cutpoint", F.when(F.col("binary") == 0, F.col("cutpoint")))
    x = x.join(F.broadcast(per), "feature")  # features are columns of a table
    kind = F.when(F.col("binary") == 1, F.when(F.col("value") == 1, "Present").otherwise("Absent")).otherwise(F.when(F.col("value") > F.col("cutpoint"), "High").otherwise("Low"))
    return x.withColumn("grp", kind).drop("binary")


def km_curve(g: DataFrame) -> DataFrame:
    """Product-limit curves by feature and group: (feature, grp, time, n_risk, n_event, survival) at each event time."""
    t = g.groupBy("feature", "grp", "time").agg(F.count("*").alias("n"), F.sum("event").alias("n_event"))
    later = Window.partitionBy("feature", "grp").orderBy(F.desc("time"))
    t = t.withColumn("n_risk", F.sum("n").over(later)).where("n_event > 0")
    up = Window.partitionBy("feature", "grp").orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = F.max((F.col("n_event") == F.col("n_risk")).cast("int")).over(up)
    s = F.exp(F.sum(F.when(F.col("n_event") < F.col("n_risk"), F.log(1 - F.col("n_event") / F.col("n_risk"))).otherwise(0.0)).over(up))
    return t.select("feature", "grp", "time", "n_risk", "n_event", F.when(gone == 1, 0.0).otherwise(s).alias("survival"))


def logrank(g: DataFrame, min_group: int = 5, min_events: int = 3) -> DataFrame:
    """Log-rank test of the two groups of each feature with enough samples and events."""
    first = F.min("grp").over(Window.partitionBy("feature"))
    x = g.withColumn("one", (F.col("grp") == first).cast("int"))
    ok = x.groupBy("feature").agg(F.count("*").alias("n"), F.sum("event").alias("n_events"), F.sum("one").alias("n1"), F.countDistinct("grp").alias("n_groups"), F.max("cutpoint").alias("cutpoint"))
    ok = ok.where((F.col("n_groups") == 2) & (F.col("n1") >= min_group) & (F.col("n") - F.col("n1") >= min_group) & (F.col("n_events") >= min_events))
    t = x.groupBy("feature", "time").agg(F.count("*").alias("n"), F.sum("one").alias("n1"), F.sum("event").alias("d"), F.sum(F.col("one") * F.col("event")).alias("d1"))
    later = Window.partitionBy("feature").orderBy(F.desc("time"))
    t = t.withColumn("r", F.sum("n").over(later)).withColumn("r1", F.sum("n1").over(later)).where("d > 0")
    e = F.col("d") * F.col("r1") / F.col("r")
    v = F.when(F.col("r") > 1, F.col("d") * F.col("r1") * (F.col("r") - F.col("r1")) * (F.col("r") - F.col("d")) / (F.col("r") * F.col("r") * (F.col("r") - 1))).otherwise(0.0)
    s = t.groupBy("feature").agg(F.sum(F.col("d1") - e).alias("o_e"), F.sum(v).alias("v"))
    s = ok.join(s, "feature").withColumn("chisq", F.when(F.col("v") > 0, F.col("o_e") * F.col("o_e") / F.col("v")))
    return s.select("feature", "n", "n_events", "cutpoint", "chisq")


def km_tests(g: DataFrame, **limits) -> DataFrame:
    """logrank with p, adjusted p and groups: the samples and events of each group as text."""
    per = g.groupBy("feature", "grp").agg(F.count("*").alias("n"), F.sum("event").cast("long").alias("e"))
    text = F.concat(F.col("grp"), F.lit(" n="), F.col("n").cast("string"), F.lit(" events="), F.col("e").cast("string"))
    per = per.groupBy("feature").agg(F.array_join(F.sort_array(F.collect_list(text)), "; ").alias("groups"))
    t = logrank(g, **limits).join(per, "feature").withColumn("pvalue", chi2_1_upper(F.col("chisq")))
    return with_bh(t, "pvalue", "fdr")


COX = "feature string, model string, n long, n_events long, hazard_ratio double, conf_low double, conf_high double, pvalue double"
_ESTIMATE = "feature string, model string, beta double, se double"
#: Samples of one feature and model that a task fits; features of more are fitted by rounds of sums over all tasks.
FITTED_IN_TASK = 200_000


def cox_tests(x: DataFrame, covariates: DataFrame | None = None, min_events: int = 3, fitted_in_task: int = FITTED_IN_TASK) -> DataFrame:
    """Proportional hazards of each feature alone, and with numeric covariates (sample_id, ...) if given; adjusted p by model.

    Rows with a missing value count for no model that needs it. Features with one value, or with fewer than min_events events, have
    no row; models that don't settle have no estimates. covariates: their names, comma-joined.
    """
    extra = [c for c in covariates.columns if c != "sample_id"] if covariates is not None else []
    rows = x.select("feature", F.lit("univariable").alias("model"), "time", "event", F.array(F.col("value").cast("double")).alias("z"))
    if extra:
        both = x.join(covariates, "sample_id").select("feature", F.lit("multivariable").alias("model"), "time", "event", F.array(F.col("value").cast("double"), *[F.col(c).cast("double") for c in extra]).alias("z"))
        rows = rows.unionByName(both)
    rows = materialize(rows.where("time IS NOT NULL AND event IS NOT NULL").where(F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v))), "cox-rows")
    z = F.col("z")[0]
    sizes = rows.groupBy("feature", "model").agg(F.count("*").alias("n"), F.sum("event").cast("long").alias("n_events"), (F.min(z) < F.max(z)).alias("varies"))
    sizes = materialize(sizes.where((F.col("n") >= 2) & (F.col("n_events") >= min_events) & F.col("varies")).drop("varies"), "cox-sizes")  # a row a model
    small, large = (sizes.where(F.col("n") <= fitted_in_task), sizes.where(F.col("n") > fitted_in_task))
    found = rows.join(small.select("feature", "model"), ["feature", "model"], "left_semi").groupBy("feature", "model").applyInPandas(_fit, _ESTIMATE)
    if not large.isEmpty():
        found = found.unionByName(_fit_in_rounds(rows.join(large.select("feature", "model"), ["feature", "model"], "left_semi")))
    b, se = F.col("beta"), F.col("se")
    ratio = lambda v: F.when(v.isNotNull(), F.exp(F.least(v, F.lit(700.0))))  # noqa: E731  least() skips nulls
    out = sizes.join(found, ["feature", "model"], "left").select(
        "feature", "model", "n", "n_events", ratio(b).alias("hazard_ratio"), ratio(b - _Z95 * se).alias("conf_low"), ratio(b + _Z95 * se).alias("conf_high"),
        chi2_1_upper(b * b / (se * se)).alias("pvalue"), F.when(F.col("model") == "multivariable", ",".join(extra)).otherwise("").alias("covariates"),
    )
    return with_bh(out, "pvalue", "fdr", ["model"])


#: Quantile of the normal distribution for an interval of 95 %.
_Z95 = 1.959963984540054


def _fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    b, s = stats.cox(pdf["time"].to_numpy(float), pdf["event"].to_numpy(int), np.stack(pdf["z"].to_numpy()))
    return pd.DataFrame([(*key, *(float(v[0]) if np.isfinite(v[0]) else None for v in (b, s)))], columns=["feature", "model", "beta", "se"])


def _fit_in_rounds(rows: DataFrame, rounds: int = 30) -> DataFrame:
    """Estimates of models too large for a task: each Newton step is one aggregation of the sums over risk sets.

    Samples of one time are added up first, so that times differ; sums over all later times are running sums in ranges of time. One row a
    model, its sums, reaches the driver in each round.
    """
    spark, keys = rows.sparkSession, ["feature", "model"]
    shape = {(r["feature"], r["model"]): r["p"] for r in rows.groupBy(*keys).agg(F.max(F.size("z")).alias("p")).collect()}
    p = max(shape.values())
    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)), F.lit(0.0))
    moments = rows.groupBy(*keys).agg(*[f(at("z", i)).alias(f"{n}{i}") for i in range(p) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()
    scale = {(r["feature"], r["model"]): ([r[f"m{i}"] for i in range(p)], [r[f"s{i}"] for i in range(p)]) for r in moments}
    fits = {k: (np.zeros(n), np.eye(n), all(v > 0 for v in scale[k][1][:n])) for k, n in shape.items()}  # coefficients, information, whether to go on
    base = materialize(with_range(rows, "time", "_range"), "cox-ranges")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for _ in range(rounds):
        on = {k: f for k, f in fits.items() if f[2]}
        if not on:
            break
        now = spark.createDataFrame([(*k, *scale[k], [float(v) for v in f[0]] + [0.0] * (p - len(f[0]))) for k, f in on.items()], "feature string, model string, m array<double>, s array<double>, b array<double>")
        z = F.array(*[F.when(at("s", i) > 0, (at("z", i) - at("m", i)) / at("s", i)).otherwise(0.0) for i in range(p)])
        r = base.join(F.broadcast(now), keys).withColumn("z", z)  # a row a model
        risk = F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), sum((at("z", i) * at("b", i) for i in range(1, p)), at("z", 0) * at("b", 0)))))
        r = r.withColumn("r", risk)
        sums = {"s": F.col("r"), **{f"s{i}": F.col("r") * at("z", i) for i in range(p)}, **{f"s{i}_{j}": F.col("r") * at("z", i) * at("z", j) for i, j in pairs}}
        t = r.groupBy(*keys, "time", "_range").agg(F.sum("event").cast("long").alias("d"), *[F.sum(F.col("event") * at("z", i)).alias(f"z{i}") for i in range(p)], *[F.sum(c).alias(n) for n, c in sums.items()], *[F.sum(F.col("event") * c).alias(f"d{n}") for n, c in sums.items()])
        t = running(t, keys, "time", {f"c{n}": F.col(n) for n in sums}, down=True).where("d > 0")
        # each of d deaths at one time is at risk with the share of the others that Efron's method leaves
        left = lambda n, k: F.col(f"c{n}") - k / F.col("d") * F.col(f"d{n}")
        mean = lambda i, k: left(f"s{i}", k) / left("s", k)
        deaths = F.sequence(F.lit(0).cast("long"), F.col("d") - 1)
        over = lambda f: F.aggregate(deaths, F.lit(0.0), lambda acc, k: acc + f(k))
        u = [F.sum(F.col(f"z{i}") - over(lambda k, i=i: mean(i, k))).alias(f"u{i}") for i in range(p)]
        info = [F.sum(over(_covariance(left, mean, i, j))).alias(f"i{i}_{j}") for i, j in pairs]
        for row in t.groupBy(*keys).agg(*u, *info).collect():
            k = (row["feature"], row["model"])
            n = shape[k]
            matrix = np.array([[row[f"i{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
            beta, settled = stats.cox_step(fits[k][0], np.array([row[f"u{i}"] for i in range(n)]), matrix)
            fits[k] = (beta, matrix, not settled and np.isfinite(beta).all())
    out = []
    for k, (beta, matrix, _) in fits.items():
        b, s = stats.cox_result(beta, matrix, np.array(scale[k][1][: shape[k]])) if all(v > 0 for v in scale[k][1][: shape[k]]) else ([math.nan], [math.nan])
        out.append((*k, *(float(v[0]) if math.isfinite(v[0]) else None for v in (b, s))))
    return spark.createDataFrame(out, _ESTIMATE)


def _covariance(left, mean, i: int, j: int):
    """Of values i and j over a risk set, as a function of the number of deaths taken off."""
    return lambda k: left(f"s{i}_{j}", k) / left("s", k) - mean(i, k) * mean(j, k)


def top_hazards(cox: DataFrame, n: int = 20) -> DataFrame:
    """The n rows with least p of finite positive estimates, for a forest plot."""
    return cox.where("hazard_ratio > 0 AND conf_low > 0 AND conf_high < 1e6").orderBy("pvalue", "feature").limit(n)


