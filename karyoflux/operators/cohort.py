"""Cohorts: recurrence, artifacts, group comparison, enrichment, prevalence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from karyoflux.functions.ranked import with_bh
from karyoflux.functions.tails import fisher_greater, fisher_two_sided, with_odds_ratio


def _names(c: str):
    return F.array_join(F.sort_array(F.collect_set(c)), ",")


def with_event_id(df: DataFrame) -> DataFrame:
    """cohort_event_id: sample and event."""
    return df.withColumn("cohort_event_id", F.concat_ws(":", "sample_id", "collapsed_event_id"))


def bin_start(pos, width: int):
    return (F.floor((pos - 1) / width) * width + 1).cast("long")


def recurrent_regions(points: DataFrame, width: int = 1_000_000, min_samples: int = 1) -> DataFrame:
    """Breakpoints (sample_id, event, chrom, pos) by fixed windows of the chromosome, in at least min_samples samples."""
    b = points.withColumn("window_start", bin_start(F.col("pos"), width))
    g = b.groupBy("chrom", "window_start").agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("cohort_event_id").alias("n_collapsed_events"), F.count("*").alias("n_breakpoints"), _names("sample_id").alias("samples"), _names("cohort_event_id").alias("cohort_event_ids"))
    g = g.where(F.col("n_samples") >= min_samples)
    return g.select("chrom", "window_start", (F.col("window_start") + width - 1).alias("window_end"), "n_samples", "n_collapsed_events", "n_breakpoints", "samples", "cohort_event_ids")


def flag_artifacts(event: DataFrame, points: DataFrame, width: int = 1000, min_samples: int = 2) -> DataFrame:
    """Events with a breakpoint in a narrow window that min_samples samples share are flagged and their confidence lowered a step."""
    b = points.withColumn("window_start", bin_start(F.col("pos"), width))
    shared = b.groupBy("chrom", "window_start").agg(F.countDistinct("sample_id").alias("n"))
    hit = b.join(shared, ["chrom", "window_start"]).groupBy("sample_id", "collapsed_event_id").agg(F.max("n").alias("max_shared_samples"))
    e = event.join(hit, ["sample_id", "collapsed_event_id"], "left").withColumn("is_artifact", F.coalesce(F.col("max_shared_samples") >= min_samples, F.lit(False)))
    lower = F.when(F.col("event_confidence") == "High", "Moderate").otherwise("Low")
    return e.withColumn("event_confidence", F.when(F.col("is_artifact"), lower).otherwise(F.col("event_confidence")))


def recurrent_genes(detail: DataFrame, n_samples: int) -> DataFrame:
    """A row a gene hit by events: samples, their share of the cohort, recurrence score (of three), events and their quality."""
    g = detail.groupBy("symbol").agg(
        F.min("gene_id").alias("gene_id"), F.min("gene_type").alias("gene_type"), F.bool_or("is_driver").alias("is_driver"), F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("cohort_event_id").alias("n_collapsed_events"),
        _names("sample_id").alias("samples"), _names("cohort_event_id").alias("cohort_event_ids"), _names("chrom").alias("chromosomes"), F.avg("event_qc_score").alias("mean_event_qc_score"), F.max("event_qc_score").alias("max_event_qc_score"),
    )
    return g.withColumn("recurrence_fraction", F.col("n_samples") / n_samples).withColumn("recurrence_score", F.least(F.col("n_samples") / 3, F.lit(1.0)))


def recurrent_chromosomes(points: DataFrame) -> DataFrame:
    return points.groupBy("chrom").agg(F.countDistinct("sample_id").alias("n_samples"), F.countDistinct("cohort_event_id").alias("n_collapsed_events"), F.count("*").alias("n_breakpoints"))


def cohort_priority(event: DataFrame, region: DataFrame) -> DataFrame:
    """Events with the greatest recurrence of their windows and priority 0.7 quality, 0.2 drivers, 0.1 recurrence."""
    r = region.select(F.explode(F.split("cohort_event_ids", ",")).alias("cohort_event_id"), "n_samples").groupBy("cohort_event_id").agg(F.max("n_samples").alias("max_recurrence"))
    e = event.join(r, "cohort_event_id", "left").na.fill(0, ["max_recurrence"])
    return e.withColumn("cohort_priority_score", 0.70 * F.col("event_qc_score") + 0.20 * F.col("driver_impact_score") + 0.10 * F.least(F.col("max_recurrence") / 3, F.lit(1.0)))


def sample_burden(summary: DataFrame, event: DataFrame, detail: DataFrame | None = None) -> DataFrame:
    """A row for every sample of the integrated summary: chains by class, events by confidence and quality, and the genes at them."""
    e = event.groupBy("sample_id").agg(F.count("*").alias("n_collapsed_events"), F.count_if(F.col("event_confidence") == "High").alias("n_high_confidence_events"), F.avg("event_qc_score").alias("mean_event_qc_score"), F.max("event_qc_score").alias("max_event_qc_score"))
    num = lambda c: (F.coalesce(F.col(c), F.lit(0)) if c in summary.columns else F.lit(0)).cast("long")
    mode = F.col("analysis_mode") if "analysis_mode" in summary.columns else F.lit(None).cast("string")
    out = summary.select("sample_id", mode.alias("analysis_mode"), num("chromoplexy_chains").alias("total_chains"), num("chromoplexy_likely").alias("likely_chains"), num("chromoplexy_possible").alias("possible_chains"))
    out = out.join(e, "sample_id", "left").na.fill(0, ["n_collapsed_events", "n_high_confidence_events"])
    if detail is None:
        return out.withColumns({"n_genes": F.lit(0).cast("long"), "n_driver_genes": F.lit(0).cast("long"), "driver_genes": F.lit("")})
    driver = F.when(F.col("is_driver"), F.col("symbol"))
    g = detail.groupBy("sample_id").agg(F.countDistinct("symbol").alias("n_genes"), F.countDistinct(driver).alias("n_driver_genes"), F.array_join(F.sort_array(F.collect_set(driver)), ",").alias("driver_genes"))
    return out.join(g, "sample_id", "left").na.fill(0, ["n_genes", "n_driver_genes"]).na.fill("", ["driver_genes"])


def prevalence(summary: DataFrame) -> DataFrame:
    """Samples with each mechanism and their share."""
    n = F.count("*")
    cols = {"chromothripsis": "chromothripsis_high_confidence", "chromoplexy": "chromoplexy_likely", "chromoanasynthesis": "chromoanasynthesis_likely"}
    x = summary.select("sample_id", F.explode(F.array(*[F.struct(F.lit(k).alias("mechanism"), (F.col(v) > 0).alias("has")) for k, v in cols.items()])).alias("m")).select("sample_id", "m.*")
    return x.groupBy("mechanism").agg(F.count_if("has").alias("n_positive"), n.alias("n_samples"), (F.count_if("has") / n).alias("fraction"))


def cooccurrence(has: DataFrame) -> DataFrame:
    """Samples that have both of each two mechanisms, itself included, from distinct (sample_id, mechanism)."""
    a = has.select("sample_id", F.col("mechanism").alias("mechanism1")).distinct()
    b = has.select("sample_id", F.col("mechanism").alias("mechanism2")).distinct()
    return a.join(b, "sample_id").groupBy("mechanism1", "mechanism2").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of every pair of values, zero cells included."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.select(row).distinct().crossJoin(F.broadcast(n.select(column).distinct())).join(n, [row, column], "left").na.fill(0, ["n"])


def gene_enrichment(hits: DataFrame, positive: DataFrame, samples: DataFrame) -> DataFrame:
    """Per gene, hits (distinct sample_id, symbol) among positive samples and the others: one-sided Fisher, odds ratio, adjusted p."""
    s = samples.select("sample_id").distinct().join(positive.select("sample_id").distinct().withColumn("pos", F.lit(True)), "sample_id", "left").withColumn("pos", F.coalesce("pos", F.lit(False)))
    total = s.agg(F.count_if("pos").alias("n_pos"), F.count_if(~F.col("pos")).alias("n_neg"))
    g = hits.select("sample_id", "symbol").distinct().join(s, "sample_id").groupBy("symbol").agg(F.count_if("pos").alias("mech_pos_hits"), F.count_if(~F.col("pos")).alias("mech_neg_hits"))
    g = g.crossJoin(F.broadcast(total))
    cells = [F.col("mech_pos_hits"), F.col("mech_neg_hits"), F.col("n_pos") - F.col("mech_pos_hits"), F.col("n_neg") - F.col("mech_neg_hits")]
    g = g.withColumn("mech_pos_freq", F.when(F.col("n_pos") > 0, F.col("mech_pos_hits") / F.col("n_pos"))).withColumn("mech_neg_freq", F.when(F.col("n_neg") > 0, F.col("mech_neg_hits") / F.col("n_neg")))
    g = with_odds_ratio(g, "odds_ratio", *cells).withColumn("pvalue", fisher_greater(*cells)).drop("n_pos", "n_neg")
    return with_bh(g, "pvalue", "fdr")


def mechanism_status(summary: DataFrame, stringency: str = "strict") -> DataFrame:
    """(sample_id, mechanism) of the mechanisms that each sample of the integrated summary has: strict counts sure calls, inclusive
    those of less confidence too."""
    if stringency not in ("strict", "inclusive"):
        raise ValueError("stringency must be 'strict' or 'inclusive'")
    columns = {
        "chromothripsis": ("chromothripsis_high_confidence", "chromothripsis_low_confidence"), "chromoplexy": ("chromoplexy_likely", "chromoplexy_possible"),
        "chromoanasynthesis": ("chromoanasynthesis_likely", "chromoanasynthesis_possible"),
    }
    calls = {m: [F.coalesce(F.col(c), F.lit(0)) for c in pair[: 1 if stringency == "strict" else 2] if c in summary.columns] for m, pair in columns.items()}
    has = F.array_compact(F.array(*[F.when(sum(c, F.lit(0)) > 0, m) for m, c in calls.items()]))
    return summary.select("sample_id", F.explode(has).alias("mechanism"))


def compare_groups(has: DataFrame, clinical: DataFrame, group: str = "grp") -> tuple[DataFrame, DataFrame]:
    """(counts, tests) of mechanisms (sample_id, mechanism) by clinical group; samples without a group are left out.

    Two groups are held against each other by Fisher's exact test, more by a chi-square whose p comes from 2000 seeded tables with the
    same margins. A mechanism that all samples have, or one group alone, has no test.
    """
    mech = has.select("mechanism").distinct()
    grouped = clinical.select("sample_id", F.col(group).cast("string").alias("grp")).where("grp IS NOT NULL")
    frame = grouped.crossJoin(F.broadcast(mech)).join(has.select("sample_id", "mechanism").distinct().withColumn("has", F.lit(1)), ["sample_id", "mechanism"], "left").na.fill(0, ["has"])
    counts = frame.groupBy("mechanism", "grp").agg(F.sum("has").alias("n_positive"), F.count("*").alias("n_samples"), F.avg("has").alias("fraction"))
    per = counts.groupBy("mechanism").agg(F.sort_array(F.collect_list(F.struct("grp", "n_positive", "n_samples"))).alias("g"))  # a cell a group
    total = lambda c: F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s + x[c])
    per = per.where((F.size("g") > 1) & (total("n_positive") > 0) & (total("n_positive") < total("n_samples")))
    yes, no = (lambda i: F.get("g", F.lit(i))["n_positive"]), (lambda i: F.get("g", F.lit(i))["n_samples"] - F.get("g", F.lit(i))["n_positive"])
    two = per.where(F.size("g") == 2).select("mechanism", F.lit("Fisher's Exact").alias("test"), fisher_two_sided(yes(0), yes(1), no(0), no(1)).alias("pvalue"))
    more = per.where(F.size("g") > 2).select("mechanism", F.lit("Chi-squared").alias("test"), _simulated(F.col("g.n_positive"), F.col("g.n_samples")).alias("pvalue"))
    p = F.col("pvalue")
    return counts, two.unionByName(more).withColumn("stars", F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


@F.pandas_udf(DoubleType())
def _simulated(positive: pd.Series, size: pd.Series) -> pd.Series:
    """Share of 2000 seeded tables with the margins of a table of groups that are as far from independence, the seen one counted in."""

    def p(y: np.ndarray, n: np.ndarray) -> float:
        expected = n * (y.sum() / n.sum())
        chi = lambda v: ((v - expected) ** 2 * (1 / expected + 1 / (n - expected))).sum(-1)
        draws = np.random.default_rng(1).multivariate_hypergeometric(n, int(y.sum()), size=2000)
        return float(((chi(draws) >= chi(y) * (1 - 1e-12)).sum() + 1) / 2001)

    return pd.Series([p(np.asarray(y, dtype=np.int64), np.asarray(n, dtype=np.int64)) for y, n in zip(positive, size, strict=True)])


def compare_mechanisms(summary: DataFrame, clinical: DataFrame, group: str = "grp", stringency: str = "strict") -> tuple[DataFrame, DataFrame]:
    """compare_groups of the samples of the integrated summary, by how sure their calls are."""
    return compare_groups(mechanism_status(summary, stringency), clinical.join(summary.select("sample_id"), "sample_id", "left_semi"), group)


def over_representation(genes: DataFrame, gene_sets: DataFrame, universe: int, top: int = 10) -> DataFrame:
    """Gene sets (source, set_name, symbol) that hold more of genes (symbol) than chance: hypergeometric tail, best `top` a source."""
    hit = gene_sets.withColumn("symbol", F.upper("symbol")).distinct()
    size = hit.groupBy("source", "set_name").agg(F.count("*").alias("set_size"))
    g = genes.select(F.upper("symbol").alias("symbol")).distinct()
    n = g.agg(F.count("*").alias("n_genes"))
    k = hit.join(g, "symbol").groupBy("source", "set_name").agg(F.count("*").alias("hits"), F.array_join(F.sort_array(F.collect_list("symbol")), "/").alias("symbols"))
    x = k.join(size, ["source", "set_name"]).crossJoin(F.broadcast(n))
    x = x.withColumn("pvalue", fisher_greater(F.col("hits"), F.col("n_genes") - F.col("hits"), F.col("set_size") - F.col("hits"), F.lit(universe) - F.col("n_genes") - F.col("set_size") + F.col("hits")))
    x = with_bh(x, "pvalue", "fdr", ["source"])
    return x.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("pvalue", "set_name"))).where(F.col("place") <= top)


def results(summary: DataFrame, fusion: DataFrame | None = None) -> DataFrame:
    """One row a sample: its class, the sure calls of each module and its fusions; what wasn't run counts as 0."""
    num = lambda c: (F.coalesce(F.col(c), F.lit(0)) if c in summary.columns else F.lit(0)).cast("double")
    s = summary if fusion is None else summary.join(fusion.groupBy("sample_id").agg(F.count("*").alias("_fusions")), "sample_id", "left")
    n = F.lit(0).cast("long") if fusion is None else F.coalesce("_fusions", F.lit(0).cast("long"))
    return s.select(
        "sample_id", F.coalesce("overall_classification", F.lit("Unknown")).alias("classification"), num("chromothripsis_high_confidence").alias("ct_hc"), num("chromoplexy_likely").alias("cp_likely"), num("chromoanasynthesis_likely").alias("cs_likely"), n.alias("n_fusions"),
    )


def score_distribution(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, mean, sd, min, max) of each metric over all rows, nulls left out."""
    x = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("m.*")
    return x.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))


def top_genes(hits: DataFrame, n: int = 20) -> DataFrame:
    """The n genes with most hits (sample_id, symbol), ties by name."""
    g = hits.groupBy("symbol").agg(F.count("*").alias("n_hits"), F.countDistinct("sample_id").alias("n_samples"))
    return g.orderBy(F.desc("n_hits"), "symbol").limit(n)


def gene_symbols(df: DataFrame, driver_only: bool = False) -> DataFrame:
    """(symbol): the distinct genes of a table, from its symbol column or its lists of genes (genes, driver_genes)."""
    if "symbol" in df.columns:
        found = df.where("is_driver").select("symbol") if driver_only and "is_driver" in df.columns else df.select("symbol")
    else:
        lists = [c for c in (["driver_genes"] if driver_only else ["genes", "affected_chromoplexy_genes"]) if c in df.columns]
        if not lists:
            raise ValueError("the table has neither a symbol column nor a list of genes")
        found = df.select(F.explode(F.split(lists[0], "[,;]")).alias("symbol"))
    return found.select(F.trim(F.col("symbol").cast("string")).alias("symbol")).where(F.length("symbol") > 0).distinct()


#: Orders of the cohort's tables.
ORDERS = {
    "gene": [F.desc, "n_samples", F.desc, "n_collapsed_events", F.desc, "is_driver", F.asc, "symbol"],
    "chromosome": [F.desc, "n_samples", F.asc, "chrom"],
    "region": [F.desc, "n_samples", F.desc, "n_collapsed_events", F.asc, "chrom", F.asc, "window_start"],
    "event": [F.desc, "cohort_priority_score", F.asc, "sample_id"],
}


def ordered(df: DataFrame, kind: str) -> DataFrame:
    """A recurrence table in its order, by a range sort."""
    o = ORDERS[kind]
    return df.orderBy(*[f(c) for f, c in zip(o[::2], o[1::2], strict=True)])
