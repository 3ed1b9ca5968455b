"""All modules over one cohort, as the tables of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from karyoflux.model import GENOME_SIZE, genome_table
from karyoflux.operators import chromoanasynthesis as cs
from karyoflux.operators import chromoplexy as cp
from karyoflux.operators import chromothripsis as ct
from karyoflux.operators import cohort, genes, integrate, survival, variants
from karyoflux.runtime import materialize


def analyze(sv: DataFrame, cnv: DataFrame | None = None, gene: DataFrame | None = None, genome: str = "hg19", neighbors: int = 3, germline: bool = False, **limits) -> dict[str, DataFrame]:
    """Tables by name: quality, chains and events, summary and results; with segments also clusters, regions, locations and overlaps;
    with genes also hits, fusions and impact. limits: of the chain search (max_paths, max_depth, ...).

    Calls are written once to the shared folder, since several tables are made from each.
    """
    chromosomes = genome_table(sv.sparkSession, genome)
    find = cp.detect_germline if germline else cp.detect
    chains = materialize(find(sv, cnv, neighbors=2 if germline else neighbors, genome_size=GENOME_SIZE[genome], **limits), "chains")
    events = materialize(cp.events(chains, sv), "events")
    out = {"chains": chains, "events": events, "event_edges": cp.event_edges(chains, cp.collapse(chains))}
    shattered = regions = where = None
    if cnv is not None:
        shattered = materialize(ct.classify(ct.criteria(sv, cnv, chromosomes)), "criteria")
        regions = materialize(cs.detect(sv, cnv), "regions")
        where = materialize(integrate.locations(shattered, chains, regions), "locations")
        met = integrate.overlaps(where)
        out |= {"quality": variants.qc_metrics(sv, cnv), "clusters": shattered, "regions": regions, "locations": where, "overlaps": met}
    fusions = hits = None
    if gene is not None:
        fusions = genes.fusions(sv, gene)
        hits = genes.at_breakpoints(cp.event_breakpoints(events), gene)
        out |= {"fusions": fusions, "gene_hits": hits, "event_genes": genes.event_genes(events, hits)}
    summary = materialize(integrate.summary(sv, shattered, chains, events, regions, hits), "summary")
    out |= {"dominance": integrate.dominance(summary), "fdr": integrate.global_fdr(shattered, chains)}
    if where is not None:
        out |= {"sample_class": integrate.sample_class(summary, where, met), "complexity": integrate.complexity(summary, where, met)}
    return out | {"summary": summary, "results": cohort.results(summary, fusions), "features": survival.features(summary, events, fusions, hits)}
