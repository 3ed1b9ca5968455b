"""Queries of the rules alone, over input tables that any engine can make, with their SQL.

The classes, scores and flags of the modules are plain rules over counts and p-values. Here those inputs are laid out from all
variants so that every rule, threshold, tie and null occurs, which the modules' own outputs seldom do. A column is one expression
that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from karyoflux.operators import chromoanasynthesis as cs
from karyoflux.operators import chromoplexy as cp
from karyoflux.operators import chromothripsis as ct
from karyoflux.operators import cohort, genes, integrate, layouts, survival, variants
from karyoflux.sources import fixtures as fx

_P = "CAST((sv_no * {}) % {} AS DOUBLE) / 1000"


def _or_null(every: int, value: str) -> str:
    return f"CASE WHEN sv_no % {every} = 0 THEN NULL ELSE {value} END"


CRITERIA = {
    "sample_id": "sample_id", "chrom": "sv_id", "cluster_size": "sv_no % 12", "cluster_size_including_tra": _or_null(5, "sv_no % 12 + sv_no % 3"), "number_tra": _or_null(13, "sv_no % 7"),
    "osc2_cluster": _or_null(11, "(sv_no * 7) % 13"), "osc3_cluster": "(sv_no * 5) % 10", "pval_fragment_joins": _or_null(6, _P.format(7919, 200)), "inter_pval_fragment_joins": _or_null(3, _P.format(104729, 110)),
    "pval_exp_cluster": _or_null(7, _P.format(31, 120)), "pval_exp_chr": _P.format(37, 100), "chr_breakpoint_enrichment": _or_null(4, _P.format(41, 60)),
}
CHAINS = {
    "sample_id": "sample_id", "chain_id": "sv_no", "n_chromosomes": "sv_no % 6", "n_translocations": "(sv_no * 3) % 7", "complexity_score": _P.format(17, 700), "is_statistically_significant": _or_null(4, "sv_no % 3 > 0"),
    "cn_stability_score": _or_null(5, _P.format(29, 1000)), "deletion_bridge_fraction": _or_null(9, _P.format(23, 400)), "combined_score": _P.format(97, 1000),
}
REGIONS = {
    "sample_id": "sample_id", "region_id": "sv_no", "gradient_correlation": _or_null(5, _P.format(29, 1000)), "variation_score": "CAST((sv_no * 7) % 40 AS DOUBLE) / 10", "n_tandem_dups": "sv_no % 7", "max_chain_length": "(sv_no * 5) % 8",
    "n_total_svs": "sv_no % 5", "n_fold_backs": "(sv_no * 3) % 4", "n_inter_chr_svs": "(sv_no * 11) % 6",
}
EVENTS = {
    "sample_id": "sample_id", "collapsed_event_id": "concat('CE', chrom1, '.', sv_id)", "representative_combined_score": _or_null(7, _P.format(7919, 1001)), "n_unique_svs": "sv_no % 9", "n_chromosomes": "sv_no % 7", "n_chains": "sv_no % 5",
    "has_cycle": "sv_no % 3 = 0",
}
TESTS = {c: e for c, e in CRITERIA.items() if c in ("sample_id", "chrom", "pval_fragment_joins", "pval_exp_cluster", "pval_exp_chr", "chr_breakpoint_enrichment")}
CHAIN_TESTS = {"sample_id": "sample_id", "chain_id": "sv_no", "pvalue": _or_null(8, _P.format(53, 900))}
# one row a sample's chromosome; samples of a seventh have no calls at all, of others one or two kinds
_NONE = "CAST(substr(sample_id, 2) AS INT) % 7"
CALLED_CT = {
    "sample_id": "sample_id", "chrom": "chrom1", "confidence_score": "CAST(min(sv_no) * 37 % 20 AS DOUBLE) / 20",
    "classification": f"CASE WHEN {_NONE} IN (0, 1, 4, 5) THEN 'Not chromothripsis' WHEN {_NONE} <> 6 AND min(sv_no) % 3 = 0 THEN 'High confidence' WHEN {_NONE} <> 2 AND min(sv_no) % 2 = 0 THEN 'Low confidence' ELSE 'Not chromothripsis' END",
}
CALLED_CT_REST = "GROUP BY sample_id, chrom1"
CALLED_CP = {
    "sample_id": "sample_id", "chain_id": "sv_no", "c1": "chrom1", "c2": "chrom2", "combined_score": "CAST(sv_no * 41 % 13 AS DOUBLE) / 13",
    "classification": f"CASE WHEN {_NONE} > 1 AND sv_no % 5 = 0 THEN 'Likely chromoplexy' WHEN sv_no % 5 = 1 THEN 'Possible chromoplexy' ELSE 'Unlikely chromoplexy' END",
}
CALLED_CS = {
    "sample_id": "sample_id", "region_id": "sv_no * 31 % 1009", "chrom": "chrom1",
    "classification": f"CASE WHEN {_NONE} IN (1, 3, 5) AND sv_no % 3 = 0 THEN 'Likely chromoanasynthesis' WHEN sv_no % 3 = 1 THEN 'Possible chromoanasynthesis' ELSE 'Unlikely chromoanasynthesis' END",
}
SUMMARY = {
    "sample_id": "sample_id", "chromothripsis_high_confidence": "count(CASE WHEN sv_no % 97 = 0 THEN 1 END)", "chromothripsis_low_confidence": "count(CASE WHEN sv_no % 53 = 0 THEN 1 END)",
    "chromoplexy_likely": "count(CASE WHEN sv_no % 61 = 0 THEN 1 END)", "chromoplexy_possible": "count(CASE WHEN sv_no % 41 = 0 THEN 1 END)", "chromoplexy_chains": "count(CASE WHEN sv_no % 29 = 0 THEN 1 END)",
    "chromoanasynthesis_likely": "count(CASE WHEN sv_no % 71 = 0 THEN 1 END)", "chromoanasynthesis_possible": "count(CASE WHEN sv_no % 43 = 0 THEN 1 END)",
    "overall_classification": "CASE WHEN count(CASE WHEN sv_no % 97 = 0 THEN 1 END) > 0 THEN 'Chromothripsis only' ELSE 'No chromoanagenesis detected' END",
}


def _spark(s, d, columns: dict[str, str]):
    return fx.sv(s, d).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def _sql(columns: dict[str, str], source: str = "sv", rest: str = "") -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source} {rest}"


def _summary(s, d):
    fx.sv(s, d).createOrReplaceTempView("_rules_sv")
    return s.sql(_sql(SUMMARY, "_rules_sv", "GROUP BY sample_id"))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


# -- Spark ------------------------------------------------------------------------------------------------------------------
_SCORES = ["cluster_score", "cn_oscillation_score", "fragment_joins_score", "clustering_score", "enrichment_score", "confidence_score"]


def ct_rules(s, d):
    return _rounded(ct.classify(_spark(s, d, CRITERIA)).select("sample_id", "chrom", *_SCORES, "confidence_category", "classification"), "confidence_score")


def ct_diagnosis_rules(s, d):
    return ct.diagnose(_spark(s, d, CRITERIA)).select("sample_id", "chrom", "could_be_high1", "could_be_high2", "could_be_low", "final_classification", "blocking_reasons")


def ct_sample_rules(s, d):
    return _rounded(ct.summarize(_spark(s, d, CRITERIA)), "max_score")


def ct_order_rules(s, d):
    return ct.ordered(ct.classify(_spark(s, d, CRITERIA))).select("sample_id", "chrom", F.col("place").cast("long").alias("place"))


def cp_order_rules(s, d):
    return cp.ordered(_spark(s, d, CHAINS)).select("sample_id", "chain_id", F.col("place").cast("long").alias("place"))


def cp_rules(s, d):
    c = _spark(s, d, CHAINS)
    kinds = {"with_test": {}, "without_test": {"statistical": False}, "sv_only": {"sv_only": True}, "sv_only_without_test": {"statistical": False, "sv_only": True}}
    for name, how in kinds.items():
        c = cp.classify(c, **how).withColumnRenamed("classification", name)
    return c.select("sample_id", "chain_id", *kinds)


def cp_diagnosis_rules(s, d):
    return _rounded(cp.diagnose(cp.classify(_spark(s, d, CHAINS))), "combined_score")


def cs_rules(s, d):
    return _rounded(cs.classify(_spark(s, d, REGIONS)).select("sample_id", "region_id", "complexity_score", "bfb_risk", "classification"), "complexity_score", "bfb_risk")


def event_rules(s, d):
    e = cp.score_events(_spark(s, d, EVENTS)).select("sample_id", "collapsed_event_id", "graph_complexity_score", "event_qc_score", "event_confidence")
    return _rounded(e, "graph_complexity_score", "event_qc_score")


def _scored(s, d):
    return cp.score_events(_spark(s, d, EVENTS))


def _event_points(s, d):
    b = variants.breakpoints(fx.sv(s, d)).join(fx.sv(s, d).select("sample_id", "sv_id", F.col("chrom1").alias("c")), ["sample_id", "sv_id"])
    return cohort.with_event_id(b.select("sample_id", F.concat(F.lit("CE"), "c", F.lit("."), "sv_id").alias("collapsed_event_id"), "chrom", "pos"))


def event_gene_rules(s, d):
    hit = genes.at_breakpoints(_event_points(s, d), fx.gene(s, d))
    e = genes.event_genes(_scored(s, d), hit).select("sample_id", "collapsed_event_id", "n_genes", "genes", "n_driver_genes", "driver_genes", "driver_impact_score", "event_priority_score")
    return _rounded(e, "driver_impact_score", "event_priority_score")


def gene_event_rules(s, d):
    return genes.gene_events(genes.at_breakpoints(_event_points(s, d), fx.gene(s, d)))


def artifact_rules(s, d):
    return cohort.flag_artifacts(_scored(s, d), _event_points(s, d)).select("sample_id", "collapsed_event_id", "max_shared_samples", "is_artifact", "event_confidence")


def priority_rules(s, d):
    p = _event_points(s, d)
    e = cohort.with_event_id(genes.event_genes(_scored(s, d), genes.at_breakpoints(p, fx.gene(s, d))))
    return _rounded(cohort.cohort_priority(e, cohort.recurrent_regions(p)).select("cohort_event_id", "max_recurrence", "cohort_priority_score"), "cohort_priority_score")


def burden_rules(s, d):
    few = _scored(s, d).where("n_chains > 3 AND n_unique_svs > 6")  # so that some samples have no event
    x = _rounded(cohort.sample_burden(_summary(s, d), few, genes.at_breakpoints(_event_points(s, d), fx.gene(s, d))), "max_event_qc_score")
    return x.withColumn("mean_event_qc_score", F.round("mean_event_qc_score", 9))


def global_fdr_rules(s, d):
    x = integrate.global_fdr(_spark(s, d, TESTS), _spark(s, d, CHAIN_TESTS))
    return _rounded(x.withColumn("adjusted_pvalue", F.round("adjusted_pvalue", 9)), "original_pvalue")


def summary_rules(s, d):
    """The integrated summary of clusters, chains and regions laid out from the variants, so that every text occurs."""
    fx.sv(s, d).createOrReplaceTempView("_rules_sv")
    ct_calls = s.sql(_sql(CALLED_CT, "_rules_sv", CALLED_CT_REST))
    chains = s.sql(_sql(CALLED_CP, "_rules_sv", "WHERE chrom1 <> chrom2")).withColumn("chromosomes", F.array("c1", "c2"))
    regions = s.sql(_sql(CALLED_CS, "_rules_sv", "WHERE sv_no % 5 = 0"))
    events = fx.sv(s, d).where("sv_no % 19 = 0").select("sample_id", "sv_no").distinct()
    return integrate.summary(fx.sv(s, d), ct_calls, chains, events, regions, genes.at_breakpoints(_event_points(s, d), fx.gene(s, d)))


def result_rules(s, d):
    """Results of laid-out summaries with the fusions of all variants."""
    return cohort.results(summary_rules(s, d), genes.fusions(fx.sv(s, d), fx.gene(s, d)))


def prevalence_rules(s, d):
    return _rounded(cohort.prevalence(_summary(s, d)), "fraction")


def landscape_rules(s, d):
    x = layouts.landscape(_summary(s, d), fx.clinical(s, d))
    return x.select("grp", F.col("place").cast("long").alias("place"), "sample_id", F.col("order_score").cast("long").alias("order_score"), "overall_classification")


def feature_rules(s, d):
    hit = genes.at_breakpoints(_event_points(s, d), fx.gene(s, d))
    e = _scored(s, d).withColumn("n_breakpoints", F.lit(2).cast("long"))
    f = survival.features(_summary(s, d).withColumn("analysis_mode", F.lit("SV+CNV integrated")), e, genes.fusions(fx.sv(s, d), fx.gene(s, d)), hit)
    f = f.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in f.dtypes])
    return _rounded(f, "max_event_qc_score").withColumn("mean_event_qc_score", F.round("mean_event_qc_score", 12))


def impact_rules(s, d):
    r = fx.calls(s, d)
    points = variants.breakpoints(variants.inter(fx.sv(s, d))).select("sample_id", "chrom", "pos")
    region = lambda m: r.where(F.col("mechanism") == m).select("sample_id", "chrom", "start", "end")
    return genes.impact(region("chromothripsis"), points, region("chromoanasynthesis"), fx.gene(s, d))


def top_genes(s, d):
    points = variants.breakpoints(fx.sv(s, d)).select("sample_id", "sv_id", "chrom", "pos")
    return cohort.top_genes(genes.at_breakpoints(points, fx.gene(s, d)))


def gene_symbols(s, d):
    points = variants.breakpoints(fx.sv(s, d)).select("sample_id", "sv_id", "chrom", "pos")
    hit = genes.at_breakpoints(points, fx.gene(s, d))
    lists = hit.groupBy("sample_id").agg(F.array_join(F.collect_set("symbol"), ", ").alias("genes"))
    return cohort.gene_symbols(lists)


def score_distribution(s, d):
    x = cohort.score_distribution(cs.windows(fx.cnv(s, d)), ["slope", "variation_score", "cn_mean"])
    return _rounded(x, "mean", "sd", "min", "max")


def quality_warnings_by_type(s, d):
    """Samples cut small, by chromosome and type, so that every warning occurs."""
    cut = fx.sv(s, d).withColumn("sample_id", F.concat_ws("-", "sample_id", "chrom1", "svtype"))
    cnv = fx.cnv(s, d).withColumn("sample_id", F.concat_ws("-", "sample_id", "chrom", F.element_at(F.array(*[F.lit(t) for t in ("DEL", "DUP", "TRA")]), (F.col("seg_no") % 3 + 1).cast("int"))))
    return variants.quality_warnings(cut, cnv)


# -- SQL --------------------------------------------------------------------------------------------------------------------
_CT = f"""SELECT *, 0.20e0 * cluster_score + 0.25e0 * cn_oscillation_score + 0.20e0 * fragment_joins_score + 0.20e0 * clustering_score + 0.15e0 * enrichment_score AS total,
  (coalesce(pval_exp_cluster < 0.05, false) OR coalesce(chr_breakpoint_enrichment < 0.05, false)) AS clustered, coalesce(osc2_cluster, osc3_cluster) AS osc, coalesce(pval_fragment_joins > 0.05, false) AS joins FROM (
  SELECT *, CASE WHEN n >= 10 THEN 1.0 WHEN n >= 6 THEN 0.6 WHEN n >= 3 THEN 0.3 ELSE 0.1 END AS cluster_score,
    CASE WHEN osc2_cluster >= 4 THEN 1.0 WHEN osc3_cluster >= 4 THEN 0.8 WHEN osc2_cluster >= 2 THEN 0.4 ELSE 0.0 END AS cn_oscillation_score,
    CASE WHEN pval_fragment_joins > 0.05 THEN 1.0 WHEN pval_fragment_joins > 0.01 THEN 0.5 ELSE 0.0 END AS fragment_joins_score,
    CASE WHEN pval_exp_cluster < 0.05 THEN 1.0 WHEN pval_exp_chr < 0.05 THEN 0.7 WHEN pval_exp_cluster < 0.1 THEN 0.5 ELSE 0.0 END AS clustering_score,
    CASE WHEN chr_breakpoint_enrichment < 0.001 THEN 1.0 WHEN chr_breakpoint_enrichment < 0.01 THEN 0.7 WHEN chr_breakpoint_enrichment < 0.05 THEN 0.4 ELSE 0.0 END AS enrichment_score
  FROM (SELECT *, coalesce(cluster_size_including_tra, cluster_size) AS n FROM ({_sql(CRITERIA)})))"""
_CLASSED = f"""SELECT *, CASE WHEN (cluster_size >= 6 AND osc >= 7 AND joins AND clustered) OR (cluster_size >= 3 AND coalesce(number_tra, 0) >= 4 AND osc >= 7 AND coalesce(inter_pval_fragment_joins, pval_fragment_joins) > 0.05 AND joins IS NOT NULL) THEN 'High confidence'
  WHEN cluster_size >= 6 AND osc BETWEEN 4 AND 6 AND joins AND clustered THEN 'Low confidence' ELSE 'Not chromothripsis' END AS classification FROM ({_CT})"""


def criteria_sql() -> str:
    """The laid-out criteria, as they stand in the SQL of the rules over them."""
    return _sql(CRITERIA)


def classed(source: str) -> str:
    """The SQL of scores and classes over another table of criteria."""
    return _CLASSED.replace(_sql(CRITERIA), source)


_DIAGNOSED = f"""SELECT *, coalesce(osc2_cluster >= 7, false) OR coalesce(osc3_cluster >= 7, false) AS o_high, coalesce(osc2_cluster BETWEEN 4 AND 6, false) OR coalesce(osc3_cluster BETWEEN 4 AND 6, false) AS o_low FROM ({_CT})"""
_CHAINED = f"""SELECT *, CAST(n_chromosomes >= 3 AS INT) + CAST(n_translocations >= 3 AS INT) + CAST(complexity_score >= 0.3 AS INT) AS core, coalesce(is_statistically_significant, false) AS sig,
  CAST(coalesce(cn_stability_score >= 0.7, false) AS INT) + CAST(coalesce(deletion_bridge_fraction >= 0.2, false) AS INT) AS rest FROM ({_sql(CHAINS)})"""
_TESTED = "CASE WHEN sig AND core + rest + 1 >= 5 THEN 'Likely chromoplexy' WHEN core + rest + CAST(sig AS INT) >= 4 THEN 'Possible chromoplexy' WHEN core + rest + CAST(sig AS INT) >= 3 THEN 'Unlikely chromoplexy' ELSE 'Not chromoplexy' END"
_EVENT = f"""SELECT *, CASE WHEN qc >= 0.75 THEN 'High' WHEN qc >= 0.5 THEN 'Moderate' ELSE 'Low' END AS confidence FROM (
  SELECT *, greatest(0.0, least(1.0, e * 0.40e0 + v * 0.20e0 + (v + c + k + y) / 4 * 0.15e0 + c * 0.15e0 + k * 0.10e0)) AS qc FROM (
    SELECT *, coalesce(representative_combined_score, 0.0) AS e, least(n_unique_svs / 6, 1.0) AS v, least(n_chromosomes / 5, 1.0) AS c, least(n_chains / 3, 1.0) AS k, CASE WHEN has_cycle THEN 1.0 ELSE 0.0 END AS y FROM ({_sql(EVENTS)})))"""
_EPOINTS = "SELECT b.sample_id, 'CE' || s.chrom1 || '.' || b.sv_id AS collapsed_event_id, b.chrom, b.pos, b.sample_id || ':CE' || s.chrom1 || '.' || b.sv_id AS cohort_event_id FROM bps b JOIN sv s USING (sample_id, sv_id)"
_EHITS = f"""SELECT p.*, g.symbol, g.gene_id, g.is_driver, greatest(0, g.start - p.pos, p.pos - g."end") AS distance FROM ({_EPOINTS}) p JOIN gene g ON p.chrom = g.chrom AND p.pos + 1000 >= g.start AND p.pos - 1000 <= g."end" """
_EGENES = f"""SELECT e.*, coalesce(n_genes, 0) AS n_genes, coalesce(genes, '') AS genes, coalesce(n_driver_genes, 0) AS n_driver_genes, coalesce(driver_genes, '') AS driver_genes, least(coalesce(n_driver_genes, 0) / 3, 1.0) AS impact
FROM ({_EVENT}) e LEFT JOIN (SELECT sample_id, collapsed_event_id, count(DISTINCT symbol) AS n_genes, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS genes, count(DISTINCT symbol) FILTER (is_driver) AS n_driver_genes,
  string_agg(DISTINCT symbol, ',' ORDER BY symbol) FILTER (is_driver) AS driver_genes FROM ({_EHITS}) GROUP BY ALL) h USING (sample_id, collapsed_event_id)"""
_SUMMED = _sql(SUMMARY, rest="GROUP BY sample_id")
_WINDOWS = "(pos - 1) // {w} * {w} + 1"
_FUSED = """SELECT sample_id, count(*) AS n FROM (SELECT s.sample_id, s.sv_id, h1.symbol AS g1, h2.symbol AS g2 FROM sv s LEFT JOIN gs h1 ON h1.sample_id = s.sample_id AND h1.sv_id = s.sv_id AND h1.bp_no = 1
  LEFT JOIN gs h2 ON h2.sample_id = s.sample_id AND h2.sv_id = s.sv_id AND h2.bp_no = 2 WHERE (h1.symbol IS NOT NULL OR h2.symbol IS NOT NULL) AND (h1.symbol IS NULL OR h2.symbol IS NULL OR h1.symbol <> h2.symbol)) GROUP BY sample_id"""



SQL = {
    "ct_rules": (f"SELECT sample_id, chrom, {', '.join(_SCORES[:-1])}, round(total, 6) AS confidence_score, CASE WHEN total >= 0.7 THEN 'High' WHEN total >= 0.4 THEN 'Moderate' ELSE 'Low' END AS confidence_category, classification FROM ({_CLASSED})", "sv"),
    "ct_sample_rules": (
        f"""SELECT sample_id, count(*) FILTER (classification = 'High confidence') AS n_high, count(*) FILTER (classification = 'Low confidence') AS n_low, count(*) FILTER (classification = 'Not chromothripsis') AS n_not, round(max(total), 6) AS max_score,
  coalesce(string_agg(chrom, ',' ORDER BY total DESC, chrom) FILTER (classification = 'High confidence'), '') AS high_chromosomes, coalesce(string_agg(chrom, ',' ORDER BY total DESC, chrom) FILTER (classification = 'Low confidence'), '') AS low_chromosomes
FROM ({_CLASSED}) GROUP BY sample_id""", "sv"),
    "ct_order_rules": (
        f"SELECT sample_id, chrom, row_number() OVER (PARTITION BY sample_id ORDER BY CASE classification WHEN 'High confidence' THEN 1 WHEN 'Low confidence' THEN 2 ELSE 3 END, total DESC, chrom) AS place FROM ({_CLASSED})", "sv"),
    "cp_order_rules": (f"SELECT sample_id, chain_id, row_number() OVER (PARTITION BY sample_id ORDER BY combined_score DESC, chain_id) AS place FROM ({_sql(CHAINS)})", "sv"),
    # the wording is that of the reasons in operators/chromothripsis.py
    "ct_diagnosis_rules": (
        f"""SELECT sample_id, chrom, high1 AS could_be_high1, high2 AS could_be_high2, low AS could_be_low, CASE WHEN high1 OR high2 THEN 'High confidence' WHEN low THEN 'Low confidence' ELSE 'Not chromothripsis' END AS final_classification,
  concat_ws('; ', CASE WHEN tra AND inter_pval_fragment_joins IS NOT NULL THEN CASE WHEN NOT inter_joins THEN 'Fragment joins FAILED (intra+TRA p=' || printf('%.3f', inter_pval_fragment_joins) || ', need >0.05)' END
    WHEN NOT joins THEN 'Fragment joins FAILED (p=' || coalesce(printf('%.3f', pval_fragment_joins), 'NA') || ', need >0.05)' END,
    CASE WHEN NOT o_high AND NOT o_low THEN 'CN oscillations insufficient (' || coalesce(CAST(osc AS VARCHAR), 'NA') || ', need >=4)' WHEN NOT o_high THEN 'CN oscillations=' || osc || ' (in low conf range 4-6, not high >=7)' END,
    CASE WHEN cluster_size < 6 THEN 'Too few intrachromosomal SVs (' || cluster_size || ', need >=6)' END, CASE WHEN NOT clustered THEN 'Clustering tests FAILED (both p>=0.05)' END) AS blocking_reasons
FROM (SELECT *, cluster_size >= 6 AND o_high AND joins AND clustered AS high1, cluster_size >= 3 AND tra AND o_high AND inter_joins AS high2, cluster_size >= 6 AND o_low AND joins AND clustered AS low FROM (
  SELECT *, coalesce(number_tra >= 4, false) AS tra, CASE WHEN inter_pval_fragment_joins IS NULL THEN joins ELSE inter_pval_fragment_joins > 0.05 END AS inter_joins FROM ({_DIAGNOSED}) WHERE cluster_size > 0))""", "sv"),
    "cp_rules": (
        f"""SELECT sample_id, chain_id, {_TESTED} AS with_test,
  CASE WHEN core + rest >= 4 THEN 'Likely chromoplexy' WHEN core + rest >= 3 THEN 'Possible chromoplexy' WHEN core + rest >= 2 THEN 'Unlikely chromoplexy' ELSE 'Not chromoplexy' END AS without_test,
  CASE WHEN core = 3 AND sig THEN 'Likely chromoplexy' WHEN core = 3 THEN 'Possible chromoplexy' WHEN core >= 2 THEN 'Unlikely chromoplexy' ELSE 'Not chromoplexy' END AS sv_only,
  CASE WHEN core = 3 THEN 'Likely chromoplexy' WHEN core >= 2 THEN 'Unlikely chromoplexy' ELSE 'Not chromoplexy' END AS sv_only_without_test FROM ({_CHAINED})""", "sv"),
    "cp_diagnosis_rules": (
        f"""SELECT sample_id, chain_id, {_TESTED} AS classification, round(combined_score, 6) AS combined_score, concat_ws('; ', CASE WHEN n_chromosomes < 3 THEN 'fewer than 3 chromosomes' END, CASE WHEN n_translocations < 3 THEN 'fewer than 3 translocations' END,
  CASE WHEN cn_stability_score IS NULL THEN 'no copy numbers' WHEN cn_stability_score < 0.7 THEN 'copy numbers not stable' END, CASE WHEN complexity_score < 0.3 THEN 'low complexity' END, CASE WHEN deletion_bridge_fraction < 0.2 THEN 'few deletion bridges' END,
  CASE WHEN NOT sig THEN 'not significant' END) AS lacks FROM ({_CHAINED})""", "sv"),
    "cs_rules": (
        f"""SELECT sample_id, region_id, round(0.2 * rho + 0.2 * least(variation_score / 3, 1.0) + 0.2 * least(n_tandem_dups / 5, 1.0) + 0.4 * least(max_chain_length / 5, 1.0), 6) AS complexity_score, round(bfb, 6) AS bfb_risk,
  CASE WHEN (max_chain_length >= 4 AND bfb < 0.3 AND n_inter_chr_svs < 3) OR met = 4 THEN 'Likely' WHEN met = 3 THEN 'Possible' WHEN met = 2 THEN 'Unlikely' ELSE 'Not' END || ' chromoanasynthesis' AS classification FROM (
  SELECT *, CAST(rho >= 0.4 OR variation_score >= 1.5 AS INT) + CAST(max_chain_length >= 3 OR n_tandem_dups >= 3 AS INT) + CAST(bfb < 0.3 AS INT) + CAST(n_inter_chr_svs < 3 AS INT) AS met FROM (
    SELECT *, coalesce(gradient_correlation, 0.0) AS rho, CASE WHEN n_total_svs > 0 THEN n_fold_backs / n_total_svs ELSE 0.0 END AS bfb FROM ({_sql(REGIONS)})))""", "sv"),
    "event_rules": (f"SELECT sample_id, collapsed_event_id, round((v + c + k + y) / 4, 6) AS graph_complexity_score, round(qc, 6) AS event_qc_score, confidence AS event_confidence FROM ({_EVENT})", "sv"),
    "event_gene_rules": (f"SELECT sample_id, collapsed_event_id, n_genes, genes, n_driver_genes, driver_genes, round(impact, 6) AS driver_impact_score, round(0.8 * qc + 0.2 * impact, 6) AS event_priority_score FROM ({_EGENES})", "sv", "bps", "gene"),
    "gene_event_rules": (
        f"SELECT sample_id, symbol, min(gene_id) AS gene_id, bool_or(is_driver) AS is_driver, count(DISTINCT collapsed_event_id) AS n_events, string_agg(DISTINCT collapsed_event_id, ',' ORDER BY collapsed_event_id) AS events, min(distance) AS min_distance FROM ({_EHITS}) GROUP BY ALL", "sv", "bps", "gene"),
    "artifact_rules": (
        f"""SELECT e.sample_id, e.collapsed_event_id, max_shared_samples, coalesce(max_shared_samples >= 2, false) AS is_artifact,
  CASE WHEN coalesce(max_shared_samples >= 2, false) THEN CASE confidence WHEN 'High' THEN 'Moderate' ELSE 'Low' END ELSE confidence END AS event_confidence FROM ({_EVENT}) e LEFT JOIN (
  SELECT p.sample_id, collapsed_event_id, max(n) AS max_shared_samples FROM (SELECT *, {_WINDOWS.format(w=1000)} AS w FROM ({_EPOINTS})) p JOIN (
    SELECT chrom, {_WINDOWS.format(w=1000)} AS w, count(DISTINCT sample_id) AS n FROM ({_EPOINTS}) GROUP BY ALL) q USING (chrom, w) GROUP BY ALL) h USING (sample_id, collapsed_event_id)""", "sv", "bps"),
    "priority_rules": (
        f"""SELECT e.sample_id || ':' || e.collapsed_event_id AS cohort_event_id, coalesce(top, 0) AS max_recurrence, round(0.70 * qc + 0.20 * impact + 0.10 * least(coalesce(top, 0) / 3, 1.0), 6) AS cohort_priority_score FROM ({_EGENES}) e LEFT JOIN (
  SELECT p.sample_id, collapsed_event_id, max(n) AS top FROM (SELECT *, {_WINDOWS.format(w=1000000)} AS w FROM ({_EPOINTS})) p JOIN (
    SELECT chrom, {_WINDOWS.format(w=1000000)} AS w, count(DISTINCT sample_id) AS n FROM ({_EPOINTS}) GROUP BY ALL) q USING (chrom, w) GROUP BY ALL) h USING (sample_id, collapsed_event_id)""", "sv", "bps", "gene"),
    "burden_rules": (
        f"""SELECT s.sample_id, CAST(NULL AS VARCHAR) AS analysis_mode, chromoplexy_chains AS total_chains, chromoplexy_likely AS likely_chains, chromoplexy_possible AS possible_chains, coalesce(n, 0) AS n_collapsed_events, coalesce(n_high, 0) AS n_high_confidence_events,
  round(mean_qc, 9) AS mean_event_qc_score, round(max_qc, 6) AS max_event_qc_score, coalesce(n_genes, 0) AS n_genes, coalesce(n_drivers, 0) AS n_driver_genes, coalesce(drivers, '') AS driver_genes FROM ({_SUMMED}) s
LEFT JOIN (SELECT sample_id, count(*) AS n, count(*) FILTER (confidence = 'High') AS n_high, avg(qc) AS mean_qc, max(qc) AS max_qc FROM ({_EVENT}) WHERE n_chains > 3 AND n_unique_svs > 6 GROUP BY sample_id) e USING (sample_id)
LEFT JOIN (SELECT sample_id, count(DISTINCT symbol) AS n_genes, count(DISTINCT symbol) FILTER (is_driver) AS n_drivers, string_agg(DISTINCT symbol, ',' ORDER BY symbol) FILTER (is_driver) AS drivers FROM ({_EHITS}) GROUP BY sample_id) g USING (sample_id)""", "sv", "bps", "gene"),
    "global_fdr_rules": (
        f"""SELECT sample_id, mechanism, event_id, round(p, 6) AS original_pvalue, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(p * m / r) OVER (PARTITION BY sample_id, p IS NULL ORDER BY p DESC)), 9) END AS adjusted_pvalue,
  CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / r) OVER (PARTITION BY sample_id, p IS NULL ORDER BY p DESC)) < 0.05 END AS is_significant_fdr FROM (SELECT *, count(p) OVER (PARTITION BY sample_id) AS m, count(p) OVER (PARTITION BY sample_id ORDER BY p) AS r FROM (
  SELECT sample_id, 'chromothripsis' AS mechanism, 'CT_' || chrom AS event_id, least(coalesce(pval_fragment_joins, 1), coalesce(pval_exp_chr, 1), coalesce(pval_exp_cluster, 1), coalesce(chr_breakpoint_enrichment, 1)) AS p FROM ({_sql(TESTS)})
  UNION ALL SELECT sample_id, 'chromoplexy', 'CP_' || chain_id, pvalue FROM ({_sql(CHAIN_TESTS)})))""", "sv"),
    "summary_rules": (
        f"""WITH ct AS ({_sql(CALLED_CT, rest=CALLED_CT_REST)}), cp AS ({_sql(CALLED_CP, rest="WHERE chrom1 <> chrom2")}), cs AS ({_sql(CALLED_CS, rest="WHERE sv_no % 5 = 0")}), ev AS (SELECT DISTINCT sample_id, sv_no FROM sv WHERE sv_no % 19 = 0),
drivers AS (SELECT h.sample_id, string_agg(DISTINCT symbol, ', ' ORDER BY symbol) AS names FROM ({_EHITS}) h WHERE is_driver GROUP BY ALL),
a AS (SELECT sample_id, count(*) FILTER (classification = 'High confidence') AS h, count(*) FILTER (classification = 'Low confidence') AS l, string_agg(chrom, ', ' ORDER BY confidence_score DESC, chrom) FILTER (classification = 'High confidence') AS hn,
  string_agg(chrom, ', ' ORDER BY confidence_score DESC, chrom) FILTER (classification = 'Low confidence') AS ln FROM ct GROUP BY ALL),
b AS (SELECT sample_id, count(*) FILTER (classification = 'Likely chromoplexy') AS k, count(*) FILTER (classification = 'Possible chromoplexy') AS p, count(*) AS n FROM cp GROUP BY ALL),
bn AS (SELECT sample_id, string_agg(c, ', ' ORDER BY first) AS names FROM (SELECT sample_id, c, min((-combined_score, chain_id, i)) AS first FROM (SELECT *, unnest([c1, c2]) AS c, unnest([1, 2]) AS i FROM cp WHERE classification = 'Likely chromoplexy') GROUP BY ALL) GROUP BY ALL),
d AS (SELECT sample_id, count(*) FILTER (classification LIKE 'Likely%') AS k, count(*) FILTER (classification LIKE 'Possible%') AS p, count(*) AS n FROM cs GROUP BY ALL),
dn AS (SELECT sample_id, string_agg(chrom, ', ' ORDER BY first) AS names FROM (SELECT sample_id, chrom, min(region_id) AS first FROM cs WHERE classification LIKE 'Likely%' GROUP BY ALL) GROUP BY ALL),
f AS (SELECT s.sample_id, coalesce(h, 0) AS h, coalesce(l, 0) AS l, hn, ln, coalesce(b.k, 0) AS bk, coalesce(b.p, 0) AS bp, coalesce(b.n, 0) AS bn_, bn.names AS bnames, coalesce(d.k, 0) AS dk, coalesce(d.p, 0) AS dp, coalesce(d.n, 0) AS dn_, dn.names AS dnames, coalesce(e.n, 0) AS e, drivers.names AS dr,
    list_filter([CASE WHEN h + l > 0 THEN 'chromothripsis' END, CASE WHEN b.k > 0 THEN 'chromoplexy' END, CASE WHEN d.k > 0 THEN 'chromoanasynthesis' END], lambda x: x IS NOT NULL) AS m
  FROM (SELECT DISTINCT sample_id FROM sv) s LEFT JOIN a USING (sample_id) LEFT JOIN b USING (sample_id) LEFT JOIN bn USING (sample_id) LEFT JOIN d USING (sample_id) LEFT JOIN dn USING (sample_id) LEFT JOIN drivers USING (sample_id) LEFT JOIN (SELECT sample_id, count(*) AS n FROM ev GROUP BY ALL) e USING (sample_id))
SELECT sample_id, 'SV+CNV integrated' AS analysis_mode, h AS chromothripsis_high_confidence, l AS chromothripsis_low_confidence, CASE WHEN h > 0 AND l > 0 THEN hn || ' (high); ' || ln || ' (low)' WHEN h > 0 THEN hn WHEN l > 0 THEN ln || ' (low confidence)' ELSE 'None' END AS chromothripsis_chromosomes,
  bk AS chromoplexy_likely, bp AS chromoplexy_possible, bn_ AS chromoplexy_chains, coalesce(bnames, 'None') AS chromoplexy_chromosomes, e AS chromoplexy_collapsed_events, CASE WHEN e = 0 THEN 'Not annotated' ELSE coalesce(dr, 'None') END AS chromoplexy_driver_genes,
  dk AS chromoanasynthesis_likely, dp AS chromoanasynthesis_possible, dn_ AS chromoanasynthesis_regions, coalesce(dnames, 'None') AS chromoanasynthesis_chromosomes,
  CASE len(m) WHEN 0 THEN 'No chromoanagenesis detected' WHEN 1 THEN upper(m[1][1]) || m[1][2:] || ' only' ELSE 'Multiple mechanisms: ' || array_to_string(m, ', ') END AS overall_classification FROM f""", "sv", "bps", "gene"),
    "prevalence_rules": (
        f"""SELECT mechanism, count(*) FILTER (n > 0) AS n_positive, count(*) AS n_samples, round(count(*) FILTER (n > 0) / count(*), 6) AS fraction FROM (
  SELECT sample_id, unnest(['chromothripsis', 'chromoplexy', 'chromoanasynthesis']) AS mechanism, unnest([chromothripsis_high_confidence, chromoplexy_likely, chromoanasynthesis_likely]) AS n FROM ({_SUMMED})) GROUP BY mechanism""", "sv"),
    "landscape_rules": (
        f"""SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY order_score DESC, sample_id) AS place, sample_id, order_score, overall_classification FROM (
  SELECT s.*, c.grp, CAST(1000 * (CAST(chromothripsis_high_confidence > 0 AS INT) + CAST(chromoplexy_likely > 0 AS INT) + CAST(chromoanasynthesis_likely > 0 AS INT)) + chromothripsis_high_confidence AS BIGINT) AS order_score FROM ({_SUMMED}) s LEFT JOIN clinical c USING (sample_id))""", "sv", "clinical"),
    "feature_rules": (
        f"""SELECT s.sample_id, 'SV+CNV integrated' AS analysis_mode, CAST(0 AS BIGINT) AS is_sv_only, ch AS ct_high_confidence, cl AS ct_low_confidence, CAST(ch + cl > 0 AS BIGINT) AS has_chromothripsis, pl AS cp_likely_chains, pp AS cp_possible_chains, chromoplexy_chains AS cp_total_chains,
  CAST(pl + pp > 0 OR e.n > 0 AS BIGINT) AS has_chromoplexy, al AS cs_likely_events, ap AS cs_possible_events, CAST(al + ap > 0 AS BIGINT) AS has_chromoanasynthesis, CAST(ch + cl + pl + pp + al + ap > 0 OR e.n > 0 AS BIGINT) AS has_chromoanagenesis,
  e.n AS n_chromoplexy_events, n_high AS n_high_confidence_chromoplexy_events, n_moderate AS n_moderate_confidence_chromoplexy_events, n_low AS n_low_confidence_chromoplexy_events, CAST(n_high > 0 AS BIGINT) AS has_high_confidence_chromoplexy_event,
  round(mean_qc, 12) AS mean_event_qc_score, round(max_qc, 6) AS max_event_qc_score, svs AS total_event_svs, 2 * e.n AS total_event_breakpoints, max_svs AS max_n_svs, CAST(2 AS BIGINT) AS max_n_breakpoints, max_chroms AS max_n_chromosomes,
  CAST(max_chroms >= 2 AS BIGINT) AS has_multichromosomal_chromoplexy_event, CAST(cyc AS BIGINT) AS has_cycle_chromoplexy_event, coalesce(n_genes, 0) AS n_chromoplexy_genes, coalesce(n_drivers, 0) AS n_chromoplexy_driver_genes,
  CAST(coalesce(n_drivers, 0) > 0 AS BIGINT) AS has_chromoplexy_driver_gene, coalesce(f.n, 0) AS n_fusions, coalesce(genes, '') AS affected_chromoplexy_genes, coalesce(drivers, '') AS chromoplexy_driver_genes
FROM (SELECT *, chromothripsis_high_confidence AS ch, chromothripsis_low_confidence AS cl, chromoplexy_likely AS pl, chromoplexy_possible AS pp, chromoanasynthesis_likely AS al, chromoanasynthesis_possible AS ap FROM ({_SUMMED})) s
JOIN (SELECT sample_id, count(*) AS n, count(*) FILTER (confidence = 'High') AS n_high, count(*) FILTER (confidence = 'Moderate') AS n_moderate, count(*) FILTER (confidence = 'Low') AS n_low, avg(qc) AS mean_qc, max(qc) AS max_qc, CAST(sum(n_unique_svs) AS BIGINT) AS svs,
  max(n_unique_svs) AS max_svs, max(n_chromosomes) AS max_chroms, bool_or(has_cycle) AS cyc FROM ({_EVENT}) GROUP BY sample_id) e USING (sample_id)
LEFT JOIN (SELECT sample_id, count(DISTINCT symbol) AS n_genes, count(DISTINCT symbol) FILTER (is_driver) AS n_drivers, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS genes, string_agg(DISTINCT symbol, ',' ORDER BY symbol) FILTER (is_driver) AS drivers FROM ({_EHITS}) GROUP BY sample_id) g USING (sample_id)
LEFT JOIN ({_FUSED}) f USING (sample_id)""", "sv", "bps", "gene", "gs"),
    "impact_rules": (
        """SELECT DISTINCT *, CASE WHEN gene_type = 'Unknown' THEN 'Unknown' WHEN impact_type = 'Amplification_Target' THEN CASE gene_type WHEN 'ONCOGENE' THEN 'Consistent (Oncogene Amp)' ELSE 'Inconsistent (TSG Amp)' END
  WHEN gene_type = 'TSG' THEN 'Consistent (TSG Loss)' ELSE 'Potential Fusion/Disruption' END AS mechanism_consistency FROM (
  SELECT c.sample_id, g.symbol, g.gene_type, g.is_driver, CASE c.mechanism WHEN 'chromothripsis' THEN 'Chromothripsis' ELSE 'Chromoanasynthesis' END AS mechanism, CASE c.mechanism WHEN 'chromothripsis' THEN 'Region_Overlap' ELSE 'Amplification_Target' END AS impact_type,
    c.chrom || ':' || c.start || '-' || c."end" AS region FROM calls c JOIN gene g ON g.chrom = c.chrom AND g."end" >= c.start AND g.start <= c."end" WHERE c.mechanism <> 'chromoplexy'
  UNION ALL SELECT s.sample_id, g.symbol, g.gene_type, g.is_driver, 'Chromoplexy', 'Breakpoint_Disruption', s.chrom || ':' || s.pos FROM sides s JOIN gene g ON g.chrom = s.chrom AND s.pos + 500 >= g.start AND s.pos - 500 <= g."end")""", "calls", "gene", "sides"),
    "top_genes": ("SELECT symbol, count(*) AS n_hits, count(DISTINCT sample_id) AS n_samples FROM hit GROUP BY symbol ORDER BY n_hits DESC, symbol LIMIT 20", "hit"),
    "gene_symbols": ("SELECT DISTINCT symbol FROM hit", "hit"),
    "quality_warnings_by_type": (
        """SELECT sample_id, unnest(list_filter([CASE WHEN n_intra < 5 THEN 'few_intra_svs' END, CASE WHEN n_types = 1 THEN 'single_sv_type' END, CASE WHEN n_segments = 0 THEN 'no_segments' WHEN n_segments < 10 THEN 'few_segments' END, CASE WHEN same > 0 THEN 'unmerged_segments' END], lambda x: x IS NOT NULL)) AS issue
FROM (SELECT sample_id || '-' || chrom1 || '-' || svtype AS sample_id, count(*) FILTER (chrom1 = chrom2) AS n_intra, count(DISTINCT svtype) AS n_types FROM sv GROUP BY ALL) LEFT JOIN (
  SELECT sample_id, count(*) AS k, count(*) FILTER (e >= nxt AND total_cn = nxt_cn) AS same FROM (SELECT *, lead(start) OVER w AS nxt, lead(total_cn) OVER w AS nxt_cn FROM (SELECT *, "end" AS e, sample_id || '-' || chrom || '-' || ['DEL', 'DUP', 'TRA'][seg_no % 3 + 1] AS sid FROM cnv)
    WINDOW w AS (PARTITION BY sid ORDER BY start, seg_no)) x(sample_id0, chrom, start, "end", total_cn, seg_no, e, sample_id, nxt, nxt_cn) GROUP BY sample_id) USING (sample_id), LATERAL (SELECT coalesce(k, 0) AS n_segments)""", "sv", "cnv"),
}

SQL["result_rules"] = (
    f"""SELECT s.sample_id, overall_classification AS classification, CAST(chromothripsis_high_confidence AS DOUBLE) AS ct_hc, CAST(chromoplexy_likely AS DOUBLE) AS cp_likely, CAST(chromoanasynthesis_likely AS DOUBLE) AS cs_likely, coalesce(f.n, 0) AS n_fusions
FROM ({SQL["summary_rules"][0]}) s LEFT JOIN ({_FUSED}) f USING (sample_id)""", *SQL["summary_rules"][1:], "gs")

QUERIES = [ct_rules, ct_order_rules, cp_order_rules, ct_diagnosis_rules, ct_sample_rules, cp_rules, cp_diagnosis_rules, cs_rules, event_rules, event_gene_rules, gene_event_rules, artifact_rules, priority_rules, burden_rules, global_fdr_rules, summary_rules, result_rules, prevalence_rules, landscape_rules, feature_rules, impact_rules, top_genes, gene_symbols, score_distribution, quality_warnings_by_type]
