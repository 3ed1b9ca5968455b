"""SQL of the domain tables and of the registered queries, for another engine over the same parquet tables."""

from __future__ import annotations

from karyoflux.model import CHROM_SIZES

_TABLES = {
    "sv": """
SELECT 'S' || user_id AS sample_id, 'sv' || event_id AS sv_id, CAST((event_id * 7 + user_id) % 6 + 1 AS VARCHAR) AS chrom1,
  1000000 + ((event_id * 104729) % 20000) * 1000 AS pos1,
  CASE event_type WHEN 'click' THEN '+' WHEN 'view' THEN '-' WHEN 'signup' THEN '+' WHEN 'error' THEN '-' ELSE CASE WHEN event_id % 4 < 2 THEN '+' ELSE '-' END END AS strand1,
  CASE WHEN event_type = 'purchase' THEN CAST((event_id * 7 + user_id + 1 + event_id % 5) % 6 + 1 AS VARCHAR) ELSE CAST((event_id * 7 + user_id) % 6 + 1 AS VARCHAR) END AS chrom2,
  CASE WHEN event_type = 'purchase' THEN 1000000 + ((event_id * 15485863) % 20000) * 1000
       ELSE 1000000 + ((event_id * 104729) % 20000) * 1000 + CAST(floor(value * 40000) AS BIGINT) + 2000 END AS pos2,
  CASE event_type WHEN 'click' THEN '-' WHEN 'view' THEN '+' WHEN 'signup' THEN '+' WHEN 'error' THEN '-' ELSE CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END END AS strand2,
  CASE event_type WHEN 'click' THEN 'DEL' WHEN 'view' THEN 'DUP' WHEN 'signup' THEN 'h2hINV' WHEN 'error' THEN 't2tINV' ELSE 'TRA' END AS svtype,
  event_id AS sv_no
FROM events""",
    "cnv": """
SELECT sample_id, chrom, start, "end", total_cn, CAST(row_number() OVER (PARTITION BY sample_id, chrom ORDER BY start) AS INTEGER) AS seg_no FROM (
  SELECT 'S' || user_id AS sample_id, chrom, start, nx - 1 AS "end",
    CAST(CASE user_id % 3 WHEN 0 THEN 1 + rn % 2 WHEN 1 THEN least(rn, 8) ELSE 1 + (event_id * 31) % 3 END AS DOUBLE) AS total_cn
  FROM (SELECT *, row_number() OVER w AS rn, lead(start) OVER w AS nx FROM (
      SELECT event_id, user_id, CAST((event_id * 7 + user_id) % 6 + 1 AS VARCHAR) AS chrom, 1000000 + ((event_id * 104729) % 20000) * 1000 AS start FROM events)
    WINDOW w AS (PARTITION BY user_id, chrom ORDER BY start, event_id)) WHERE nx > start)""",
    "gene": """
SELECT 'G' || p_partkey AS symbol, 'G' || p_partkey AS gene_id, CAST(p_partkey % 6 + 1 AS VARCHAR) AS chrom, 1000000 + ((p_partkey * 9973) % 20000) * 1000 AS start,
  1000000 + ((p_partkey * 9973) % 20000) * 1000 + p_size * 2000 AS "end", CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, 'gene' AS type,
  CASE p_partkey % 3 WHEN 0 THEN 'ONCOGENE' WHEN 1 THEN 'TSG' ELSE 'Unknown' END AS gene_type, p_partkey % 5 = 0 AS is_driver
FROM part WHERE p_partkey < 300""",
    "clinical": """
SELECT 'S' || c_custkey AS sample_id, round(c_acctbal + 1000, 2) AS os_time, CAST(c_nationkey % 2 AS INTEGER) AS os_event, c_mktsegment AS grp
FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""",
    "flank": """
SELECT 'S' || user_id AS sample_id, 'sv' || event_id AS sv_id,
  repeat('A', k) || translate(md5('a' || event_id), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s1_disc,
  translate(md5('b' || event_id), '0123456789abcdef', 'ACGTACGTACGTACGT') || repeat('A', k) AS s2_disc,
  translate(md5('c' || event_id), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s1_kept,
  translate(md5('d' || event_id), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s2_kept
FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN (event_id // 4) % 24 ELSE 0 END AS k FROM events)""",
    # breakpoints of interchromosomal variants, one row a node: the first variant that has it
    "bp": """
SELECT sample_id, chrom, pos, sv_no, bp_no FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id, chrom, pos ORDER BY sv_no, bp_no) AS k FROM (
    SELECT sample_id, chrom1 AS chrom, pos1 AS pos, sv_no, 1 AS bp_no FROM sv WHERE chrom1 <> chrom2
    UNION ALL SELECT sample_id, chrom2, pos2, sv_no, 2 FROM sv WHERE chrom1 <> chrom2)) WHERE k = 1""",
    # interleaving pairs of intrachromosomal variants
    "pair": """
SELECT a.sample_id, a.chrom1 AS chrom, a.sv_id AS a, b.sv_id AS b FROM sv a JOIN sv b ON a.sample_id = b.sample_id AND a.chrom1 = b.chrom1
WHERE a.chrom1 = a.chrom2 AND b.chrom1 = b.chrom2 AND a.pos1 < b.pos1 AND b.pos1 - 1 <= a.pos2 + 1 AND a.pos2 < b.pos2""",
    "component": """
SELECT sample_id, chrom, sv_id, min(root) AS component FROM (
  WITH RECURSIVE reach(sample_id, chrom, sv_id, root) AS (
    SELECT sample_id, chrom1, sv_id, sv_id FROM sv WHERE chrom1 = chrom2
    UNION SELECT r.sample_id, r.chrom, CASE WHEN p.a = r.sv_id THEN p.b ELSE p.a END, r.root
    FROM reach r JOIN pair p ON p.sample_id = r.sample_id AND (p.a = r.sv_id OR p.b = r.sv_id))
  SELECT * FROM reach) GROUP BY ALL""",
    "member": """
SELECT sample_id, chrom, sv_id, n FROM (
  SELECT *, max(n) OVER (PARTITION BY sample_id, chrom) AS top FROM (SELECT *, count(*) OVER (PARTITION BY sample_id, chrom, component) AS n FROM component)) WHERE n = top""",
    "cluster": """
SELECT m.sample_id, m.chrom, max(m.n) AS cluster_size, min(least(s.pos1, s.pos2)) AS start, max(greatest(s.pos1, s.pos2)) AS "end",
  count(*) FILTER (s.svtype = 'DEL') AS number_del, count(*) FILTER (s.svtype = 'DUP') AS number_dup, count(*) FILTER (s.svtype = 'h2hINV') AS number_h2hinv,
  count(*) FILTER (s.svtype = 't2tINV') AS number_t2tinv
FROM member m JOIN sv s USING (sample_id, sv_id) GROUP BY ALL""",
}
_NEEDS = {"bp": ["sv"], "pair": ["sv"], "component": ["sv", "pair"], "member": ["component"], "cluster": ["member", "sv"]}


def with_tables(body: str, *names: str) -> str:
    """body with the domain tables it needs in front as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    if not order:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED ({_TABLES[n]})" for n in order)
    more = body.lstrip()
    if more.upper().startswith("WITH "):
        return f"WITH {head},\n{more[5:]}"
    return f"WITH {head}\n{body}"



_BOTH = """SELECT sample_id, sv_id, sv_no, 1 AS bp_no, chrom1 AS chrom, pos1 AS pos, strand1 AS strand FROM sv
UNION ALL SELECT sample_id, sv_id, sv_no, 2, chrom2, pos2, strand2 FROM sv"""

_SIDES = """SELECT sample_id, sv_id, chrom1 AS chrom, pos1 AS pos, chrom2 AS other, strand1, strand2 FROM sv WHERE chrom1 <> chrom2
UNION ALL SELECT sample_id, sv_id, chrom2, pos2, chrom1, strand1, strand2 FROM sv WHERE chrom1 <> chrom2"""

_OSC = """SELECT sample_id, chrom, count(*) AS n_segments,
  CASE WHEN count(*) >= 4 THEN coalesce(max(r2), 0) + 2 END AS osc2, CASE WHEN count(*) >= 4 THEN coalesce(max(r3), 0) + 2 END AS osc3
FROM (SELECT *, CASE WHEN v2 = 1 THEN count(*) OVER (PARTITION BY sample_id, chrom, v2, g2) END AS r2, CASE WHEN v3 = 1 THEN count(*) OVER (PARTITION BY sample_id, chrom, v3, g3) END AS r3
  FROM (SELECT *, k - row_number() OVER (PARTITION BY sample_id, chrom, v2 ORDER BY start) AS g2, k - row_number() OVER (PARTITION BY sample_id, chrom, v3 ORDER BY start) AS g3
    FROM (SELECT *, row_number() OVER w AS k, coalesce(CAST(round_even(total_cn, 0) = round_even(lead(total_cn, 2) OVER w, 0) AS INT), -1) AS v2,
        coalesce(CAST(abs(round_even(total_cn, 0) - round_even(lead(total_cn, 2) OVER w, 0)) <= 1 AS INT), -1) AS v3
      FROM {0} WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY start))))
GROUP BY sample_id, chrom"""

_CLUSTER_SEGS = """SELECT c.* FROM cnv c JOIN (
  SELECT c.sample_id, c.chrom, coalesce(max(seg_no) FILTER (c.start <= k.start), min(seg_no) FILTER (c.start >= k.start)) AS a,
    coalesce(min(seg_no) FILTER (c."end" >= k."end"), max(seg_no) FILTER (c."end" <= k."end")) AS b
  FROM cnv c JOIN cluster k USING (sample_id, chrom) GROUP BY ALL) r USING (sample_id, chrom) WHERE c.seg_no BETWEEN r.a AND r.b"""

_CALLS = """SELECT sample_id, CASE sv_no // 6 % 3 WHEN 0 THEN 'chromothripsis' WHEN 1 THEN 'chromoplexy' ELSE 'chromoanasynthesis' END AS mechanism, sv_no // 6 % 3 AS rank,
  chrom1 AS chrom, pos1 AS start, pos1 + 500000 + (sv_no * 7919 % 4000) * 1000 - 1 AS "end", round(0.3 + (sv_no % 7) / 10.0, 2) AS confidence,
  CASE WHEN sv_no % 4 = 0 THEN 'Possible call' ELSE 'Likely call' END AS classification, 'E' || (sv_no // 36) || '.' || (sv_no // 6 % 3) AS event_id FROM sv"""

_OVERLAPS = """SELECT a.sample_id, a.chrom, a.mechanism AS mechanism1, b.mechanism AS mechanism2, a.event_id AS event_id1, b.event_id AS event_id2,
  least(a."end", b."end") - greatest(a.start, b.start) + 1 AS overlap_size, a.confidence AS confidence1, b.confidence AS confidence2, least(a.mechanism, b.mechanism) || '+' || greatest(a.mechanism, b.mechanism) AS mechanism_pair
FROM calls a JOIN calls b ON a.sample_id = b.sample_id AND a.chrom = b.chrom AND a.rank < b.rank WHERE least(a."end", b."end") - greatest(a.start, b.start) + 1 >= 1000000"""

_GENOME = "SELECT CASE WHEN k = 23 THEN 'X' ELSE CAST(k AS VARCHAR) END AS chrom, k AS chrom_no, size FROM (SELECT unnest(range(1, 24)) AS k, unnest([{}]) AS size)".format(
    ", ".join(map(str, CHROM_SIZES["hg19"]))
)

_MH = """SELECT f.sample_id, f.sv_id, s.svtype, f.s1_kept,
  (SELECT coalesce(min(k) - 1, least(length(s1_disc), length(s2_disc), 25)) FROM range(1, 26) r(k) WHERE k <= least(length(s1_disc), length(s2_disc)) AND substr(s1_disc, 1, k) <> right(s2_disc, k)) AS run_length,
  (SELECT coalesce(max(k), 0) FROM range(1, 26) r(k) WHERE k <= least(length(s1_disc), length(s2_disc)) AND substr(s1_disc, 1, k) = right(s2_disc, k)) AS longest
FROM flank f JOIN sv s USING (sample_id, sv_id)"""

_REPAIR = """SELECT sample_id, sv_id, svtype, run_length AS mh_length, run_length >= 2 AS has_microhomology,
  CASE WHEN svtype = 'DUP' AND run_length BETWEEN 2 AND 5 THEN 'MMBIR/FoSTeS' WHEN run_length > 20 THEN 'SSA' WHEN run_length >= 2 THEN 'MMEJ' ELSE 'NHEJ' END AS repair_mechanism,
  CASE WHEN svtype = 'DUP' AND run_length BETWEEN 2 AND 5 THEN 'Moderate' WHEN run_length >= 2 THEN 'High' ELSE 'Moderate' END AS confidence,
  'MH: ' || run_length || ' bp, Ins: 0 bp' AS evidence FROM mh"""

_POINTS = """SELECT sample_id, 'CE' || chrom AS collapsed_event_id, chrom, pos, sample_id || ':CE' || chrom AS cohort_event_id FROM sides"""

_FEATURES = """SELECT sample_id, feature, value FROM (SELECT sample_id, CAST(count(*) AS DOUBLE) AS n_svs, CAST(count(*) FILTER (chrom1 <> chrom2) AS DOUBLE) AS n_inter,
  CAST(CAST(count(*) FILTER (chrom1 <> chrom2) >= 13 AS INT) AS DOUBLE) AS many_inter FROM sv GROUP BY sample_id) UNPIVOT (value FOR feature IN (n_svs, n_inter, many_inter))"""

_LONG = """SELECT sample_id, feature, value, time, event, cutpoint, CASE WHEN cutpoint IS NULL THEN CASE WHEN value = 1 THEN 'Present' ELSE 'Absent' END WHEN value > cutpoint THEN 'High' ELSE 'Low' END AS grp
FROM (SELECT f.*, os_time AS time, os_event AS event, CASE WHEN min(CAST(value IN (0, 1) AS INT)) OVER (PARTITION BY feature) = 0 THEN quantile_cont(value, 0.5) OVER (PARTITION BY feature) END AS cutpoint
  FROM feat f JOIN clinical c USING (sample_id) WHERE os_time > 0)"""

_TABLES |= {
    "bps": _BOTH, "sides": _SIDES, "calls": _CALLS, "overlap": _OVERLAPS, "genome": _GENOME, "mh": _MH, "repair": _REPAIR, "points": _POINTS, "feat": _FEATURES, "long": _LONG, "cluster_segs": _CLUSTER_SEGS,
    "osc": _OSC.format("cnv"), "osc_cluster": _OSC.format("cluster_segs"),
    "linear": "SELECT chrom, CAST(coalesce(sum(size) OVER (ORDER BY chrom_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM genome",
    "jc": """SELECT k.*, coalesce(number_tra, 0) AS number_tra, number_del + coalesce(t1, 0) AS join_del, number_h2hinv + coalesce(t2, 0) AS join_h2hinv, number_t2tinv + coalesce(t3, 0) AS join_t2tinv, number_dup + coalesce(t4, 0) AS join_dup
FROM cluster k LEFT JOIN (SELECT k.sample_id, k.chrom, count(DISTINCT sv_id) AS number_tra, count(*) FILTER (strand1 || strand2 = '+-') AS t1, count(*) FILTER (strand1 || strand2 = '++') AS t2,
    count(*) FILTER (strand1 || strand2 = '--') AS t3, count(*) FILTER (strand1 || strand2 = '-+') AS t4
  FROM cluster k JOIN sides USING (sample_id, chrom) WHERE pos BETWEEN k.start AND k."end" GROUP BY ALL) USING (sample_id, chrom)""",
    "bridge": """SELECT b.sample_id, b.chrom, b.sv_id, b.sv_no, b.bp_no, b.pos, d.start AS deletion_start, d."end" AS deletion_end, d.total_cn AS deletion_cn,
  CASE WHEN pos BETWEEN d.start AND d."end" THEN 0 ELSE least(abs(d.start - pos), abs(d."end" - pos)) END AS distance_to_breakpoint, d."end" - d.start AS deletion_size
FROM (SELECT b.* FROM bps b JOIN sv USING (sample_id, sv_id) WHERE chrom1 <> chrom2) b JOIN cnv d USING (sample_id, chrom)
WHERE d.total_cn < 2 AND CASE WHEN pos BETWEEN d.start AND d."end" THEN 0 ELSE least(abs(d.start - pos), abs(d."end" - pos)) END <= 1000000""",
    "bridged": """SELECT *, 0.5 * exp(-distance_to_breakpoint / 2e5) + 0.3 * CASE WHEN deletion_size < 100 THEN deletion_size / 100.0 WHEN deletion_size <= 10000 THEN 1.0 ELSE exp(-(deletion_size - 10000) / 1e4) END + 0.2 * exp(-deletion_cn) AS confidence FROM bridge""",
    "adjacent": """SELECT sample_id, chrom, pos, to_pos FROM (SELECT sample_id, chrom, pos, unnest([lead(pos, 1) OVER w, lead(pos, 2) OVER w, lead(pos, 3) OVER w]) AS to_pos FROM bp WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY pos)) WHERE to_pos - pos - 1 <= 10000000""",
    "hit": """SELECT b.sample_id, b.sv_id, b.bp_no, b.chrom, b.pos, g.symbol, g.gene_id, g.gene_type, g.is_driver, greatest(0, g.start - b.pos, b.pos - g."end") AS distance_to_breakpoint
FROM bps b JOIN gene g ON b.chrom = g.chrom AND b.pos + 1000 >= g.start AND b.pos - 1000 <= g."end" """,
}
_NEEDS |= {
    "bps": ["sv"], "sides": ["sv"], "calls": ["sv"], "overlap": ["calls"], "mh": ["flank", "sv"], "repair": ["mh"], "points": ["sides"], "feat": ["sv"], "long": ["feat", "clinical"], "cluster_segs": ["cnv", "cluster"],
    "osc": ["cnv"], "osc_cluster": ["cluster_segs"], "linear": ["genome"], "jc": ["cluster", "sides"], "bridge": ["bps", "sv", "cnv"], "bridged": ["bridge"], "adjacent": ["bp"], "hit": ["bps", "gene"],
}

_SQL: dict[str, tuple] = {
    "sv_table": ("SELECT * FROM sv", "sv"),
    "cnv_table": ("SELECT sample_id, chrom, start, \"end\", total_cn, CAST(seg_no AS BIGINT) AS seg_no FROM cnv", "cnv"),
    "canonical_sv": ("SELECT * FROM sv WHERE chrom1 <> chrom2 OR pos2 - pos1 >= 5000", "sv"),
    "breakpoint_unpivot": ("SELECT * FROM bps", "bps"),
    "breakpoint_nodes": ("SELECT b.sample_id, s.sv_id, b.sv_no, b.bp_no, b.chrom, b.pos FROM bp b JOIN sv s USING (sample_id, sv_no)", "bp"),
    "qc_metrics": (
        """SELECT s.*, coalesce(n_segments, 0) AS n_segments, mean_segment, small_rate FROM (SELECT sample_id, count(*) AS n_svs, count(*) FILTER (chrom1 = chrom2) AS n_intra, count(*) FILTER (chrom1 <> chrom2) AS n_inter,
  count(DISTINCT svtype) AS n_types, round(avg(CAST(chrom1 <> chrom2 AS INT)), 6) AS inter_rate FROM sv GROUP BY ALL) s LEFT JOIN (SELECT sample_id, count(*) AS n_segments, round(avg("end" - start + 1), 6) AS mean_segment,
  round(avg(CAST("end" - start + 1 < 10000 AS INT)), 6) AS small_rate FROM cnv GROUP BY ALL) USING (sample_id)""", "sv", "cnv"),
    "overlap_rate": (
        """SELECT sample_id, count(*) AS n_svs, round(avg(CAST(coalesce(pos1 - p <= 1000, false) OR coalesce(n - pos1 <= 1000, false) AS INT)), 6) AS overlap_rate
FROM (SELECT *, lag(pos1) OVER w AS p, lead(pos1) OVER w AS n FROM sv WINDOW w AS (PARTITION BY sample_id, chrom1 ORDER BY pos1, sv_no)) GROUP BY ALL""", "sv"),
    "flag_clustered_breakpoints": (
        """SELECT sample_id, chrom, min(pos) AS start, max(pos) AS "end", count(*) AS n_breakpoints, count(DISTINCT sv_id) AS n_svs, string_agg(DISTINCT sv_id, ',' ORDER BY sv_id) AS sv_ids FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY sample_id, chrom ORDER BY pos, sv_no, bp_no) AS session FROM (
    SELECT b.*, CASE WHEN pos - lag(pos) OVER (PARTITION BY b.sample_id, chrom ORDER BY pos, b.sv_no, bp_no) <= 200000 THEN 0 ELSE 1 END AS fresh FROM bps b JOIN sv USING (sample_id, sv_id) WHERE chrom1 <> chrom2))
GROUP BY sample_id, chrom, session HAVING count(DISTINCT sv_id) >= 2""", "bps"),
    "merge_segments": (
        """SELECT sample_id, chrom, start, "end", total_cn, n_merged, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY start) AS seg_no FROM (
  SELECT sample_id, chrom, min(start) AS start, max("end") AS "end", any_value(total_cn) AS total_cn, count(*) AS n_merged FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY sample_id, chrom ORDER BY start) AS run FROM (
      SELECT *, CASE WHEN lag(total_cn) OVER w = total_cn AND start <= max("end") OVER (PARTITION BY sample_id, chrom ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh
      FROM cnv WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY start))) GROUP BY sample_id, chrom, run)""", "cnv"),
    "cn_oscillation": ("SELECT * FROM osc", "osc"),
    "linear_positions": (
        """SELECT sample_id, sv_id, pos1 + a.shift AS x1, pos2 + b.shift AS x2, CASE WHEN chrom1 = chrom2 THEN abs(pos2 - pos1) END AS span,
  CASE WHEN chrom1 <> chrom2 THEN 'translocation' WHEN abs(pos2 - pos1) < 1000000 THEN 'short' WHEN abs(pos2 - pos1) < 10000000 THEN 'medium' ELSE 'long' END AS curvature
FROM sv JOIN linear a ON a.chrom = chrom1 JOIN linear b ON b.chrom = chrom2""", "sv", "linear"),
    "region_clip": ("""SELECT sample_id, chrom, greatest(start, 5000000) AS start, least("end", 12000000) AS "end", total_cn, CAST(seg_no AS BIGINT) AS seg_no FROM cnv WHERE chrom = '1' AND "end" >= 5000000 AND start <= 12000000""", "cnv"),
    "ct_interleaving_pairs": ("SELECT * FROM pair", "pair"),
    "ct_components": ("SELECT sample_id, chrom, sv_id, component, count(*) OVER (PARTITION BY sample_id, chrom, component) AS n FROM component", "component"),
    "ct_cluster_summary": (
        """SELECT k.*, r.n_segments AS number_cnv_segments, r.osc2 AS osc2_cluster, r.osc3 AS osc3_cluster, o.osc2 AS osc2_chr, o.osc3 AS osc3_chr
FROM cluster k LEFT JOIN osc_cluster r USING (sample_id, chrom) LEFT JOIN osc o USING (sample_id, chrom)""", "cluster", "osc", "osc_cluster"),
    "ct_chromosome_counts": ("SELECT s.sample_id, g.chrom, (SELECT count(*) FROM sv v WHERE v.sample_id = s.sample_id AND v.chrom1 = g.chrom AND v.chrom2 = g.chrom) AS n_svs FROM (SELECT DISTINCT sample_id FROM sv) s, genome g", "sv", "genome"),
    "ct_join_counts": (
        """SELECT * EXCLUDE (e), join_del + join_h2hinv + join_t2tinv + join_dup AS cluster_size_including_tra, round((pow(join_del - e, 2) + pow(join_h2hinv - e, 2) + pow(join_t2tinv - e, 2) + pow(join_dup - e, 2)) / e, 6) AS joins_chi2
FROM (SELECT *, (join_del + join_h2hinv + join_t2tinv + join_dup) / 4.0 AS e FROM jc)""", "jc"),
    "ct_breakpoint_gaps": (
        """SELECT sample_id, chrom, max(n_breaks) AS n_breaks, max(n) AS n_gaps, round(max(mean), 6) AS mean_gap, round(greatest(max(i / n - cdf), max(cdf - (i - 1) / n)), 6) AS ks_d FROM (
  SELECT *, 1 - exp(-gap / mean) AS cdf, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY gap, pos) AS i FROM (
    SELECT *, count(*) OVER (PARTITION BY sample_id, chrom) AS n, sum(gap) OVER (PARTITION BY sample_id, chrom) / count(*) OVER (PARTITION BY sample_id, chrom) AS mean FROM (
      SELECT *, pos - lag(pos) OVER (PARTITION BY sample_id, chrom ORDER BY pos) AS gap, count(*) OVER (PARTITION BY sample_id, chrom) AS n_breaks FROM (
        SELECT m.sample_id, m.chrom, pos1 AS pos FROM member m JOIN sv USING (sample_id, sv_id) UNION SELECT m.sample_id, m.chrom, pos2 FROM member m JOIN sv USING (sample_id, sv_id)
        UNION SELECT s.sample_id, s.chrom, s.pos FROM sides s JOIN cluster k USING (sample_id, chrom) WHERE s.pos BETWEEN k.start AND k."end"))
    WHERE gap > 0 AND n_breaks >= 6) WHERE n >= 5) GROUP BY sample_id, chrom""", "member", "sv", "sides", "cluster"),
    "cp_deletion_bridges": ("SELECT * REPLACE (round(confidence, 6) AS confidence) FROM bridged", "bridged"),
    "cp_adjacency_edges": ("SELECT sample_id, chrom || ':' || pos AS from_node, chrom || ':' || to_pos AS to_node, to_pos - pos AS distance, round(exp(-(to_pos - pos) / 2e6), 6) AS evidence_strength FROM adjacent", "adjacent"),
    "cp_edges": (
        """SELECT sample_id, chrom1 || ':' || pos1 AS from_node, chrom2 || ':' || pos2 AS to_node, 'TRANSLOCATION' AS edge_type, sv_no, CAST(NULL AS BIGINT) AS distance, 1.0 AS evidence_strength FROM sv WHERE chrom1 <> chrom2
UNION ALL SELECT sample_id, chrom || ':' || pos, chrom || ':' || to_pos, 'ADJACENCY', NULL, to_pos - pos, round(exp(-(to_pos - pos) / 2e6), 6) FROM adjacent
UNION ALL SELECT b.sample_id, b.chrom || ':' || b.pos, b.chrom || ':' || o.pos, 'DELETION_BRIDGE', b.sv_no, b.deletion_size, round(b.confidence, 6) FROM bridged b JOIN bp o USING (sample_id, chrom)
WHERE o.pos BETWEEN b.deletion_start - 1000 AND b.deletion_end + 1000 AND o.pos <> b.pos""", "sv", "adjacent", "bridged", "bp"),
    "cp_adjacency_list": (
        """SELECT sample_id, node, count(*) AS n_neighbors, string_agg(other, ',' ORDER BY other) AS neighbors FROM (
  SELECT sample_id, chrom1 || ':' || pos1 AS node, chrom2 || ':' || pos2 AS other FROM sv WHERE chrom1 <> chrom2 UNION ALL SELECT sample_id, chrom2 || ':' || pos2, chrom1 || ':' || pos1 FROM sv WHERE chrom1 <> chrom2
  UNION ALL SELECT sample_id, chrom || ':' || pos, chrom || ':' || to_pos FROM adjacent UNION ALL SELECT sample_id, chrom || ':' || to_pos, chrom || ':' || pos FROM adjacent) GROUP BY ALL""", "sv", "adjacent"),
    "cp_gene_hits": ("SELECT sample_id, sv_id, chrom, pos, symbol, distance_to_breakpoint, is_driver FROM hit WHERE bp_no = 1", "hit"),
    "mu_rates": (
        """SELECT s.sample_id, g.chrom, coalesce(n, 0) AS n_bp, round(least(coalesce(n, 0) / 10, 1.0) * coalesce(n, 0) / (g.size / 1e6) + (1 - least(coalesce(n, 0) / 10, 1.0)) * total / ((SELECT sum(size) FROM genome) / 1e6), 9) AS mu
FROM (SELECT sample_id, count(*) AS total FROM sides GROUP BY ALL) s CROSS JOIN genome g LEFT JOIN (SELECT sample_id, chrom, count(*) AS n FROM sides GROUP BY ALL) c ON c.sample_id = s.sample_id AND c.chrom = g.chrom""", "sides", "genome"),
    "mechanism_overlaps": ("SELECT * FROM overlap", "overlap"),
    "mechanism_matrix": (
        """SELECT s.sample_id, g.chrom, m.mechanism, (SELECT count(*) FROM calls c WHERE c.sample_id = s.sample_id AND c.chrom = g.chrom AND c.mechanism = m.mechanism) AS n_events
FROM (SELECT DISTINCT sample_id FROM calls) s, genome g, (SELECT DISTINCT mechanism FROM calls) m""", "calls", "genome"),
    "bh_adjust": (
        """SELECT sample_id, sv_id, round(p, 9) AS p, round(least(1.0, min(p * m / r) OVER (PARTITION BY sample_id ORDER BY p DESC)), 9) AS fdr FROM (SELECT *, count(*) OVER (PARTITION BY sample_id) AS m, count(*) OVER (PARTITION BY sample_id ORDER BY p) AS r
  FROM (SELECT sample_id, sv_id, CAST((sv_no * 7919) % 10007 + 1 AS DOUBLE) / CAST(10008.0 AS DOUBLE) AS p FROM sv))""", "sv"),
    "microhomology": ("SELECT sample_id, sv_id, CAST(run_length AS BIGINT) AS run_length, CAST(longest AS BIGINT) AS longest, reverse(translate(s1_kept, 'ACGT', 'TGCA')) AS rc FROM mh", "mh"),
    "repair_class": ("SELECT * FROM repair", "repair"),
    "repair_text": (
        """SELECT sample_id, string_agg(repair_mechanism || ' (' || CAST(round_even(100 * n / total, 0) AS INT) || '%)', ', ' ORDER BY k) AS repair_summary FROM (
  SELECT *, sum(n) OVER (PARTITION BY sample_id) AS total, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, repair_mechanism) AS k FROM (SELECT sample_id, repair_mechanism, count(*) AS n FROM repair GROUP BY ALL)) WHERE k <= 2 GROUP BY sample_id""", "repair"),
    "repair_by_type": ("SELECT svtype, repair_mechanism, n, round(n / sum(n) OVER (PARTITION BY svtype), 6) AS fraction FROM (SELECT svtype, repair_mechanism, count(*) AS n FROM repair GROUP BY ALL)", "repair"),
    "microhomology_histogram": ("SELECT CAST(mh_length AS BIGINT) AS mh_length, count(*) AS n FROM repair WHERE mh_length > 0 GROUP BY ALL", "repair"),
    "recurrent_regions": (
        """SELECT chrom, w AS window_start, w + 999999 AS window_end, count(DISTINCT sample_id) AS n_samples, count(DISTINCT cohort_event_id) AS n_collapsed_events, count(*) AS n_breakpoints, string_agg(DISTINCT sample_id, ',' ORDER BY sample_id) AS samples,
  string_agg(DISTINCT cohort_event_id, ',' ORDER BY cohort_event_id) AS cohort_event_ids FROM (SELECT *, (pos - 1) // 1000000 * 1000000 + 1 AS w FROM points) GROUP BY chrom, w HAVING count(DISTINCT sample_id) >= 2""", "points"),
    "recurrent_chromosomes": ("SELECT chrom, count(DISTINCT sample_id) AS n_samples, count(DISTINCT cohort_event_id) AS n_collapsed_events, count(*) AS n_breakpoints FROM points GROUP BY ALL", "points"),
    "mechanism_crosstab": (
        """SELECT a.grp, b.mechanism, (SELECT count(*) FROM calls JOIN clinical USING (sample_id) WHERE grp = a.grp AND mechanism = b.mechanism) AS n
FROM (SELECT DISTINCT grp FROM calls JOIN clinical USING (sample_id)) a, (SELECT DISTINCT mechanism FROM calls JOIN clinical USING (sample_id)) b""", "calls", "clinical"),
    "cooccurrence": ("SELECT a.mechanism AS mechanism1, b.mechanism AS mechanism2, count(*) AS n FROM (SELECT DISTINCT sample_id, mechanism FROM calls) a JOIN (SELECT DISTINCT sample_id, mechanism FROM calls) b USING (sample_id) GROUP BY ALL", "calls"),
    "group_counts": (
        """SELECT mechanism, grp, CAST(sum(h) AS BIGINT) AS n_positive, count(*) AS n_samples, round(avg(h), 6) AS fraction FROM (SELECT c.grp, m.mechanism, CAST((c.sample_id, m.mechanism) IN (SELECT (sample_id, mechanism) FROM calls) AS INT) AS h
FROM clinical c, (SELECT DISTINCT mechanism FROM calls) m) GROUP BY ALL""", "calls", "clinical"),
    "survival_long": ("SELECT sample_id, feature, value, time, CAST(event AS BIGINT) AS event, cutpoint, grp FROM long", "long"),
    "km_curve": (
        """SELECT feature, grp, time, n_risk, n_event, round(CASE WHEN max(CAST(n_event = n_risk AS INT)) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk) ELSE 0.0 END) OVER w) END, 6) AS survival FROM (
  SELECT feature, grp, time, CAST(sum(n) OVER (PARTITION BY feature, grp ORDER BY time DESC) AS BIGINT) AS n_risk, n_event FROM (SELECT feature, grp, time, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_event FROM long GROUP BY ALL)) WHERE n_event > 0
WINDOW w AS (PARTITION BY feature, grp ORDER BY time ROWS UNBOUNDED PRECEDING)""", "long"),
    "logrank": (
        """SELECT feature, n, n_events, cutpoint, round(chisq, 6) AS chisq FROM (SELECT feature, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_events, max(cutpoint) AS cutpoint, sum(one) AS n1, count(DISTINCT grp) AS k FROM lr GROUP BY feature) JOIN (
  SELECT feature, CASE WHEN sum(v) > 0 THEN sum(d1 - d * r1 / r) * sum(d1 - d * r1 / r) / sum(v) END AS chisq FROM (SELECT *, CASE WHEN r > 1 THEN d * r1 * (r - r1) * (r - d) / (r * r * (r - 1)) ELSE 0.0 END AS v FROM (
    SELECT feature, time, d, d1, CAST(sum(n) OVER w AS DOUBLE) AS r, CAST(sum(n1) OVER w AS DOUBLE) AS r1 FROM (SELECT feature, time, count(*) AS n, sum(one) AS n1, sum(event) AS d, sum(one * event) AS d1 FROM lr GROUP BY ALL)
    WINDOW w AS (PARTITION BY feature ORDER BY time DESC)) WHERE d > 0) GROUP BY feature) USING (feature) WHERE k = 2 AND n1 >= 5 AND n - n1 >= 5 AND n_events >= 3""", "lr"),
    "sv_density": (
        """SELECT a.sample_id, a.chrom, t.svtype, (SELECT count(*) FROM bt b WHERE b.sample_id = a.sample_id AND b.chrom = a.chrom AND b.svtype = t.svtype) AS n FROM (SELECT DISTINCT sample_id, chrom FROM bt) a, (SELECT DISTINCT svtype FROM bt) t""", "bt"),
    "genome_copy_numbers": (
        """SELECT sample_id, chrom, start + shift AS x1, "end" + shift AS x2, least(total_cn, 6.0) AS shown_cn, CASE WHEN total_cn < 2 THEN 'loss' WHEN total_cn > 2 THEN 'gain' ELSE 'neutral' END AS state FROM cnv JOIN linear USING (chrom)""", "cnv", "linear"),
    "scaled_segments": (
        """SELECT sample_id, chrom, start, "end", total_cn, CAST(seg_no AS BIGINT) AS seg_no, round(CASE WHEN max(total_cn) OVER w > min(total_cn) OVER w THEN (total_cn - min(total_cn) OVER w) / (max(total_cn) OVER w - min(total_cn) OVER w) ELSE 0.5 END, 6) AS scaled_cn
FROM cnv WINDOW w AS (PARTITION BY sample_id, chrom)""", "cnv"),
    "pathway_hits": (
        """SELECT sample_id, set_name, count(*) AS hits FROM (SELECT DISTINCT sample_id, symbol FROM hit) JOIN (SELECT 'chr' || chrom AS set_name, symbol FROM gene UNION SELECT gene_type, symbol FROM gene) USING (symbol) GROUP BY ALL""", "hit", "gene"),
    "vcf_bnd_parse": (
        """SELECT sample_id, sv_id, chrom1, pos1, CASE WHEN strand1 = '+' THEN '+' ELSE '-' END AS strand1, chrom2, pos2, CASE WHEN strand1 = '+' THEN '+' ELSE '-' END AS strand2, svtype FROM sv WHERE chrom1 <> chrom2""", "sv"),
    "vcf_delly_parse": (
        """SELECT sample_id, sv_id, chrom1, pos1, strand1, chrom2, pos2, CASE WHEN chrom1 <> chrom2 THEN strand1 ELSE strand2 END AS strand2, svtype FROM sv WHERE chrom1 <> chrom2 OR pos2 - pos1 >= 50""", "sv"),
    "fusions": (
        """SELECT sample_id, sv_id, CASE WHEN p5 = 'intergenic' THEN '(intergenic)' ELSE p5 END || '::' || CASE WHEN p3 = 'intergenic' THEN '(intergenic)' ELSE p3 END AS fusion_name, p5 AS gene_5p, p3 AS gene_3p, CASE WHEN both_ends THEN 'Fusion' ELSE 'Disruption' END AS type,
  CASE WHEN NOT both_ends THEN 'Intron disruption' WHEN f OR b THEN 'Canonical (Intronic)' ELSE 'Non-canonical (Intronic)' END AS status, CASE WHEN both_ends THEN f OR b END AS orientation_compatible, svtype AS sv_type, chrom1, pos1, chrom2, pos2,
  round(100 * p1, 1) AS gene1_pos_pct, round(100 * p2, 1) AS gene2_pos_pct, coalesce(d1, false) OR coalesce(d2, false) AS is_driver_involved
FROM (SELECT *, CASE WHEN b THEN g2 ELSE coalesce(g1, 'intergenic') END AS p5, CASE WHEN b THEN g1 ELSE coalesce(g2, 'intergenic') END AS p3 FROM (
  SELECT *, both_ends AND s1 = strand1 AND s2 <> strand2 AS f, both_ends AND NOT (s1 = strand1 AND s2 <> strand2) AND s2 = strand2 AND s1 <> strand1 AS b FROM (
    SELECT sv.*, h1.symbol AS g1, h2.symbol AS g2, h1.strand AS s1, h2.strand AS s2, h1.p AS p1, h2.p AS p2, h1.is_driver AS d1, h2.is_driver AS d2, h1.symbol IS NOT NULL AND h2.symbol IS NOT NULL AS both_ends
    FROM sv LEFT JOIN gs h1 ON h1.sample_id = sv.sample_id AND h1.sv_id = sv.sv_id AND h1.bp_no = 1 LEFT JOIN gs h2 ON h2.sample_id = sv.sample_id AND h2.sv_id = sv.sv_id AND h2.bp_no = 2
    WHERE (h1.symbol IS NOT NULL OR h2.symbol IS NOT NULL) AND (h1.symbol IS NULL OR h2.symbol IS NULL OR h1.symbol <> h2.symbol))))""", "sv", "gs"),
    "cs_windows": (
        """SELECT sample_id, chrom, win_size, start_idx, start, "end", size, n_segments, CASE WHEN levels > 1 THEN round(rho, 6) + 0.0 END AS gradient_correlation, round(slope, 6) + 0.0 AS slope, round(CASE WHEN cn_mean > 0 THEN jumps / cn_mean ELSE 0.0 END, 6) AS variation_score, round(cn_mean, 6) AS cn_mean, cn_range FROM (
  SELECT sample_id, chrom, win_size, start_idx, min(start) AS start, max("end") AS "end", max("end") - min(start) AS size, count(*) AS n_segments, count(DISTINCT total_cn) AS levels, corr(i, r) AS rho, regr_slope(total_cn, i) AS slope, sum(jump) AS jumps, avg(total_cn) AS cn_mean, max(total_cn) - min(total_cn) AS cn_range FROM (
    SELECT *, rank() OVER (PARTITION BY sample_id, chrom, win_size, start_idx ORDER BY total_cn) + (count(*) OVER (PARTITION BY sample_id, chrom, win_size, start_idx, total_cn) - 1) / 2.0 AS r,
      abs(total_cn - lag(total_cn) OVER (PARTITION BY sample_id, chrom, win_size, start_idx ORDER BY seg_no)) AS jump, CAST(seg_no - start_idx + 1 AS BIGINT) AS i FROM (
        SELECT f.win_size, f.start_idx, c.* FROM frame f JOIN cnv c ON c.sample_id = f.sample_id AND c.chrom = f.chrom AND c.seg_no BETWEEN f.start_idx AND f.start_idx + f.win_size - 1))
  GROUP BY sample_id, chrom, win_size, start_idx) WHERE size <= 10000000""", "cnv", "frame"),
}
_TABLES |= {
    "lr": "SELECT *, CAST(grp = min(grp) OVER (PARTITION BY feature) AS INT) AS one FROM long",
    "bt": "SELECT b.*, s.svtype FROM bps b JOIN sv s USING (sample_id, sv_id)",
    "gs": """SELECT b.sample_id, b.sv_id, b.bp_no, g.symbol, g.strand, g.is_driver, greatest(0.0, least(1.0, CASE WHEN g.strand = '-' THEN g."end" - b.pos ELSE b.pos - g.start END / (g."end" - g.start))) AS p
FROM bps b JOIN gene g ON g.chrom = b.chrom AND g.strand = b.strand AND g.start - b.pos - 1 <= 1000 AND b.pos - g."end" - 1 <= 1000""",
    "frame": """SELECT sample_id, chrom, win_size, unnest(range(1, n - win_size + 2, greatest(1, win_size // 4))) AS start_idx FROM (
  SELECT DISTINCT sample_id, chrom, n, CAST(round_even(5 + (least(n, 25) - 5) * (i / 4.0), 0) AS BIGINT) AS win_size FROM (SELECT sample_id, chrom, max(seg_no) AS n FROM cnv GROUP BY ALL HAVING max(seg_no) >= 5), range(0, 5) t(i))""",
}
_NEEDS |= {"lr": ["long"], "bt": ["bps"], "gs": ["bps", "gene"], "frame": ["cnv"]}


_SQL["germline_filter"] = (
    f"""SELECT sv.* FROM sv ANTI JOIN (SELECT sample_id, unnest(string_split(sv_ids, ',')) AS sv_id FROM ({_SQL["flag_clustered_breakpoints"][0]})) USING (sample_id, sv_id)""", "bps")
_SQL["recurrent_genes"] = (
    """SELECT symbol, min(gene_id) AS gene_id, min(gene_type) AS gene_type, bool_or(is_driver) AS is_driver, count(DISTINCT sample_id) AS n_samples, count(DISTINCT cohort_event_id) AS n_collapsed_events, string_agg(DISTINCT sample_id, ',' ORDER BY sample_id) AS samples,
  string_agg(DISTINCT cohort_event_id, ',' ORDER BY cohort_event_id) AS cohort_event_ids, string_agg(DISTINCT chrom, ',' ORDER BY chrom) AS chromosomes, round(avg(pos % 100 / 100.0), 6) AS mean_event_qc_score, round(max(pos % 100 / 100.0), 6) AS max_event_qc_score,
  round(count(DISTINCT sample_id) / (SELECT count(DISTINCT sample_id) FROM sv), 6) AS recurrence_fraction, round(least(count(DISTINCT sample_id) / 3, 1.0), 6) AS recurrence_score
FROM (SELECT p.*, g.* EXCLUDE (chrom) FROM points p JOIN gene g ON p.chrom = g.chrom AND p.pos + 1000 >= g.start AND p.pos - 1000 <= g."end") GROUP BY symbol""", "points", "gene", "sv")
_SQL["score_distribution"] = (
    f"""SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max FROM (
  SELECT unnest(['slope', 'variation_score', 'cn_mean']) AS metric, unnest([slope, variation_score, cn_mean]) AS value FROM ({_SQL["cs_windows"][0].replace("round(slope, 6) + 0.0 AS slope", "slope").replace("round(CASE WHEN cn_mean > 0 THEN jumps / cn_mean ELSE 0.0 END, 6)", "CASE WHEN cn_mean > 0 THEN jumps / cn_mean ELSE 0.0 END").replace("round(cn_mean, 6) AS cn_mean", "cn_mean")})) GROUP BY metric""", *_SQL["cs_windows"][1:])
_SQL["circular_arcs"] = (
    """SELECT sample_id, sv_id, round(a, 9) AS turn1, round(b, 9) AS turn2, round(least(abs(b - a), 1 - abs(b - a)), 9) AS between FROM (
  SELECT sample_id, sv_id, (pos1 + l1.shift) / (SELECT sum(size) FROM genome) AS a, (pos2 + l2.shift) / (SELECT sum(size) FROM genome) AS b FROM sv JOIN linear l1 ON l1.chrom = chrom1 JOIN linear l2 ON l2.chrom = chrom2 WHERE chrom1 <> chrom2)""", "sv", "genome", "linear")
_SQL["region_links"] = (
    """SELECT b.sample_id, b.sv_id, c.mechanism, count(DISTINCT bp_no) AS ends FROM bps b JOIN sv USING (sample_id, sv_id) JOIN calls c ON c.sample_id = b.sample_id AND c.chrom = b.chrom AND b.pos BETWEEN c.start AND c."end" WHERE chrom1 <> chrom2 GROUP BY ALL""", "bps", "sv", "calls")
_SQL["fusion_repair"] = (
    f"""SELECT f.sample_id, f.sv_id, fusion_name, type, status, repair_mechanism, mh_length FROM ({_SQL["fusions"][0]}) f LEFT JOIN repair r ON r.sample_id = f.sample_id AND r.sv_id = f.sv_id""", *_SQL["fusions"][1:], "repair")
_KEPT = "WHERE chrom1 <> chrom2 OR pos2 - pos1 >= 50"
_MATED = """CASE WHEN chrom1 <= chrom2 THEN sv_id || 'o' ELSE sv_id || 'h' END AS sv_id, least(chrom1, chrom2) AS chrom1, CASE WHEN chrom1 <= chrom2 THEN pos1 ELSE pos2 END AS pos1,
  CASE WHEN chrom1 <= chrom2 THEN strand1 ELSE strand2 END AS strand1, greatest(chrom1, chrom2) AS chrom2, CASE WHEN chrom1 <= chrom2 THEN pos2 ELSE pos1 END AS pos2, CASE WHEN chrom1 <= chrom2 THEN strand2 ELSE strand1 END AS strand2, svtype"""
_OWN = "sv_id, chrom1, pos1, strand1, chrom2, pos2, strand2, svtype"
_SQL |= {
    "vcf_gridss_parse": (f"SELECT sample_id, {_MATED} FROM sv {_KEPT}", "sv"),
    "vcf_manta_parse": (f"SELECT sample_id, {_OWN} FROM sv WHERE chrom1 = chrom2 AND pos2 - pos1 >= 50 UNION ALL SELECT sample_id, {_MATED} FROM sv WHERE chrom1 <> chrom2", "sv"),
    "vcf_lumpy_parse": (f"SELECT sample_id, {_OWN} FROM sv {_KEPT}", "sv"),
    "vcf_generic_parse": (
        f"""SELECT sample_id, sv_id, chrom1, pos1, CASE WHEN svtype = 'DUP' THEN '-' ELSE '+' END AS strand1, chrom2, pos2, CASE WHEN svtype IN ('DUP', 'h2hINV', 't2tINV') THEN '+' ELSE '-' END AS strand2,
  CASE WHEN svtype LIKE '%INV' THEN 'h2hINV' ELSE svtype END AS svtype FROM sv {_KEPT}""", "sv"),
    "vcf_auto_parse": (
        f"""SELECT sample_id, {_OWN} FROM sv WHERE (chrom1 <> chrom2 OR pos2 - pos1 >= 50) AND CAST(substr(sample_id, 2) AS INT) % 2 = 0
UNION ALL SELECT sample_id, {_MATED} FROM sv WHERE (chrom1 <> chrom2 OR pos2 - pos1 >= 50) AND CAST(substr(sample_id, 2) AS INT) % 2 = 1""", "sv"),
    "vcf_copy_numbers": ('SELECT sample_id, chrom, start, "end", total_cn, CAST(seg_no AS BIGINT) AS seg_no FROM cnv', "cnv"),
    "standard_types": (
        """SELECT * EXCLUDE (sv_no_, by_strand), CASE WHEN chrom1 <> chrom2 THEN 'TRA' WHEN sv_no_ IN (0, 1, 2, 3, 4, 5, 11, 12, 13) THEN by_strand WHEN sv_no_ = 6 THEN 'DEL' WHEN sv_no_ = 7 THEN 'DUP'
  WHEN sv_no_ = 8 THEN CASE by_strand WHEN 'h2hINV' THEN 'h2hINV' WHEN 't2tINV' THEN 't2tINV' ELSE 'INV' END WHEN sv_no_ = 9 THEN 'DUP' ELSE 'TRA' END AS svtype
FROM (SELECT *, CASE strand1 || strand2 WHEN '+-' THEN 'DEL' WHEN '-+' THEN 'DUP' WHEN '++' THEN 'h2hINV' WHEN '--' THEN 't2tINV' ELSE 'UNKNOWN' END AS by_strand FROM (
  SELECT sample_id, sv_id, ['DEL', '<DUP:TANDEM>', 'dup', 'INV', 'INS', 'BND', 'DEL:ME', 'DUP:INT', 'INV:X', 'INS:ME', 'BND2', 'TRANSLOCATION', 'CNV', ''][sv_no % 14 + 1] AS raw, sv_no % 14 AS sv_no_,
    chrom1, chrom2, ['+', '-', '+', '.', '-'][sv_no % 7 % 5 + 1] AS strand1, ['+', '-', '+', '.', '-'][sv_no % 11 % 5 + 1] AS strand2 FROM sv))""", "sv"),
    "event_flags": (
        """SELECT c_custkey, word, CASE WHEN k < 11 OR k IN (20, 21, 23) THEN 1 WHEN k < 20 OR k = 22 THEN 0 END AS event, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS by_truth, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS by_number
FROM (SELECT c_custkey, c_custkey % 27 AS k, ['1', 'true', 't', 'yes', 'y', 'event', 'dead', 'deceased', 'progressed', 'progression', 'relapsed', '0', 'false', 'f', 'no', 'n', 'censored', 'alive', 'none', 'no event',
  ' Dead ', '1.0', '0.0', '1e0', '2', 'maybe', ''][c_custkey % 27 + 1] AS word FROM customer)""",),
}


def text(name: str) -> str:
    """The body of a query's SQL, to build others on."""
    return _SQL[name][0]


def queries() -> dict[str, str]:
    return {name: with_tables(*spec) for name, spec in _SQL.items()}
