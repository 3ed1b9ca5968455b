"""SQL of the queries of exact tests, null tables, adjusted p-values and of the three mechanisms together."""

from __future__ import annotations

from karyoflux.model import CENTROMERES
from karyoflux.plans import oracle, rules

_HITS = """SELECT DISTINCT b.sample_id, g.symbol FROM bps b JOIN gene g ON b.chrom = g.chrom AND b.pos + 1000 >= g.start AND b.pos - 1000 <= g."end" """
# log probability of cell i of a 2 x 2 table with margins m, n and k
_LOG_CELL = "(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n + 1) - lgamma(k - i + 1) - lgamma(n - k + i + 1) - lgamma(m + n + 1) + lgamma(k + 1) + lgamma(m + n - k + 1))"
_TABLE = "a + b AS m, c + d AS n, a + c AS k, greatest(0, a - d) AS lo, least(a + b, a + c) AS hi"
_GREATER = f"least(1.0, list_sum(list_transform(range(a, hi + 1), lambda i: exp({_LOG_CELL}))))"
_TWO_SIDED = f"least(1.0, list_sum(list_transform(range(lo, hi + 1), lambda i: CASE WHEN {_LOG_CELL} <= {_LOG_CELL.replace('i +', 'a +').replace('- i', '- a').replace('+ i', '+ a')} + ln(1 + 1e-7) THEN exp({_LOG_CELL}) ELSE 0.0e0 END)))"
_BH = "round(least(1.0, min({p} * m_ / r_) OVER ({part} ORDER BY {p} DESC)), {d})"
# upper tail of chi-square with one degree of freedom, by the series of the error function
_CHI1 = "1 - 2 / sqrt(pi()) * exp(-chisq / 2) * list_sum(list_transform(range(0, 200), lambda k: exp(k * ln(2.0e0) + (2 * k + 1) * ln(sqrt(chisq / 2)) - (lgamma(2 * k + 2.0e0) - k * ln(2.0e0) - lgamma(k + 1.0e0)))))"

_GAPS = oracle.text("ct_breakpoint_gaps").replace("round(max(mean), 6)", "max(mean)").replace("round(greatest(max(i / n - cdf), max(cdf - (i - 1) / n)), 6)", "greatest(max(i / n - cdf), max(cdf - (i - 1) / n))")
_ALL_CELLS = """SELECT n, a * a + b * b + c * c + (n - a - b - c) * (n - a - b - c) AS squares, exp(lgamma(n + 1) - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(n - a - b - c + 1) - n * ln(4.0e0)) AS p
FROM (SELECT *, unnest(range(0, n - a - b + 1)) AS c FROM (SELECT *, unnest(range(0, n - a + 1)) AS b FROM (SELECT n, unnest(range(0, n + 1)) AS a FROM {})))"""
_LAID = "SELECT * FROM calls WHERE CAST(substr(sample_id, 2) AS INT) % 7 > 0"
_LAID_COUNTS = f"""SELECT s.sample_id, s1, l1, s2, l2, s3, l3 FROM (SELECT DISTINCT sample_id FROM sv) s LEFT JOIN (
  SELECT sample_id, {", ".join(f"count(DISTINCT event_id) FILTER (rank = {r} AND {w} classification LIKE 'Possible%') AS {n}{r + 1}" for r in range(3) for n, w in (("s", "NOT"), ("l", "")))} FROM ({_LAID}) GROUP BY sample_id) c USING (sample_id)"""
_PRESENT = f"""SELECT sample_id, coalesce(s1, 0) + coalesce(l1, 0) AS e1, coalesce(s2, 0) + coalesce(l2, 0) AS e2, coalesce(s3, 0) + coalesce(l3, 0) AS e3,
  list_filter([CASE WHEN s1 + l1 > 0 THEN 'chromothripsis' END, CASE WHEN s2 > 0 THEN 'chromoplexy' END, CASE WHEN s3 > 0 THEN 'chromoanasynthesis' END], lambda x: x IS NOT NULL) AS names FROM ({_LAID_COUNTS})"""
_PLACED = f"""SELECT p.*, CAST(len(names) AS BIGINT) AS n_mechanisms, coalesce(c.n, 0) AS n_chromosomes, coalesce(mixed, 0) AS n_mixed_chromosomes, coalesce(k, 0) AS n_overlaps FROM ({_PRESENT}) p
LEFT JOIN (SELECT sample_id, count(*) AS n, count(*) FILTER (m > 1) AS mixed FROM (SELECT sample_id, chrom, count(DISTINCT mechanism) AS m FROM ({_LAID}) GROUP BY ALL) GROUP BY sample_id) c USING (sample_id)
LEFT JOIN (SELECT sample_id, count(*) AS k FROM overlap WHERE CAST(substr(sample_id, 2) AS INT) % 7 > 0 GROUP BY sample_id) o USING (sample_id)"""
_SHARES = f"""SELECT sample_id, unnest(['chromothripsis', 'chromoplexy', 'chromoanasynthesis']) AS mechanism, unnest([e1, e2, e3]) AS n_events,
  unnest(CASE WHEN e1 + e2 + e3 > 0 THEN [e1 / (e1 + e2 + e3), e2 / (e1 + e2 + e3), e3 / (e1 + e2 + e3)] ELSE [0.0e0, 0.0e0, 0.0e0] END) AS p,
  CASE WHEN e1 + e2 + e3 = 0 THEN 'none' WHEN greatest(e1, e2, e3) / (e1 + e2 + e3) <= 0.5 THEN 'balanced' WHEN e1 >= e2 AND e1 >= e3 THEN 'chromothripsis' WHEN e2 >= e3 THEN 'chromoplexy' ELSE 'chromoanasynthesis' END AS dominant FROM ({_PRESENT})"""
_GENE_SETS = "SELECT 'chromosome' AS source, 'chr' || chrom AS set_name, symbol FROM gene UNION ALL SELECT 'role', gene_type, symbol FROM gene"

# two-sided p of a rank correlation rho with df = n - 2, by the finite sums for even and odd degrees of freedom
_RHO_P = """CASE WHEN rho IS NULL AND n_segments >= 3 THEN NULL WHEN n_segments < 3 THEN 1.0 WHEN abs(rho) >= 1 THEN 0.0 ELSE round(1 - CASE WHEN df % 2 = 0 THEN
    abs(rho) * list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5e0) - lgamma(0.5e0) - lgamma(k + 1.0e0)) * pow(1 - rho * rho, k)))
  ELSE 2 / pi() * (asin(abs(rho)) + CASE WHEN df = 1 THEN 0.0e0 ELSE abs(rho) * sqrt(1 - rho * rho) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: exp(lgamma(k + 1.0e0) + lgamma(1.5e0) - lgamma(k + 1.5e0)) * pow(1 - rho * rho, k))) END) END, 9) + 0.0 END"""
_WINDOWS = oracle.text("cs_windows").replace("round(rho, 6) + 0.0 END", "rho END").replace("round(slope, 6) + 0.0 AS slope", "slope").replace("round(CASE WHEN cn_mean > 0 THEN jumps / cn_mean ELSE 0.0 END, 6)", "CASE WHEN cn_mean > 0 THEN jumps / cn_mean ELSE 0.0 END")

# what the classes of chromosomes are made from: linked translocation ends, tests of gaps, joins and enrichment, links to other clusters
_LINKED = """lk AS (SELECT * FROM (SELECT *, bool_or(near) OVER (PARTITION BY sample_id, chrom) AS any_near FROM (
  SELECT s.*, s.pos BETWEEN k.start - 10000 AND k."end" + 10000 AS near FROM sides s JOIN cluster k USING (sample_id, chrom))) WHERE near OR NOT any_near)"""
_INTER = """link AS (SELECT t.sample_id, t.chrom, t.other, t.strand1, t.strand2, f.pos AS far_pos FROM sides t JOIN cluster k USING (sample_id, chrom) JOIN sides f ON f.sample_id = t.sample_id AND f.sv_id = t.sv_id AND f.chrom = t.other
  WHERE t.pos BETWEEN k.start - 10000 AND k."end" + 10000),
chosen AS (SELECT w.sample_id, w.chrom, w.other, o.start AS o_start, o."end" AS o_end FROM (SELECT sample_id, chrom, other, count(*) AS n, min(far_pos) AS lo, max(far_pos) AS hi FROM link GROUP BY ALL) w
  JOIN cluster o ON o.sample_id = w.sample_id AND o.chrom = w.other WHERE n >= 2 AND (lo >= o.start - 10000 OR hi <= o."end" + 10000)),
kinds AS (SELECT c.sample_id, c.chrom, s.svtype FROM chosen c JOIN member m ON m.sample_id = c.sample_id AND m.chrom = c.other JOIN sv s ON s.sample_id = m.sample_id AND s.sv_id = m.sv_id
  UNION ALL SELECT l.sample_id, l.chrom, CASE strand1 || strand2 WHEN '+-' THEN 'DEL' WHEN '-+' THEN 'DUP' WHEN '++' THEN 'h2hINV' ELSE 't2tINV' END FROM link l JOIN chosen c ON c.sample_id = l.sample_id AND c.chrom = l.chrom AND c.other = l.other),
ij AS (SELECT * FROM (SELECT sample_id, chrom, count(*) FILTER (svtype = 'DEL') AS inter_number_del, count(*) FILTER (svtype = 'h2hINV') AS inter_number_h2hinv, count(*) FILTER (svtype = 't2tINV') AS inter_number_t2tinv, count(*) FILTER (svtype = 'DUP') AS inter_number_dup FROM kinds GROUP BY ALL)
  JOIN (SELECT sample_id, chrom, string_agg(other, '_' ORDER BY other) AS inter_other_chroms, string_agg(other || ':' || o_start || '-' || o_end, ';' ORDER BY other || ':' || o_start || '-' || o_end) AS inter_other_chroms_coords_all FROM chosen GROUP BY ALL) USING (sample_id, chrom))"""
_BREAKS = _GAPS[_GAPS.index("SELECT m.sample_id, m.chrom, pos1") : _GAPS.index("))\n    WHERE gap > 0")]
_NULL_GAPS = """x AS (SELECT n, s, -ln((CAST('0x' || substr(md5('1:' || n || ':' || s || ':' || i), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496) AS v FROM (
  SELECT n, s, unnest(range(1, n + 1)) AS i FROM ns, range(1, 1001) r(s))),
y AS (SELECT *, 1 - exp(-v / (sum(v) OVER (PARTITION BY n, s) / n)) AS cdf, row_number() OVER (PARTITION BY n, s ORDER BY v) AS i FROM x),
z AS (SELECT n, s, greatest(max(i / n - cdf), max(cdf - (i - 1) / n)) AS d FROM y GROUP BY n, s)"""
_CRITERIA = f"""WITH {_LINKED}, {_INTER}, g1 AS ({_GAPS}), g2 AS ({_GAPS.replace(_BREAKS, "SELECT DISTINCT sample_id, chrom, pos FROM lk")}),
ns AS (SELECT DISTINCT n_gaps AS n FROM (FROM g1 UNION ALL FROM g2)), {_NULL_GAPS},
jn AS (SELECT *, join_del + join_h2hinv + join_t2tinv + join_dup AS n, join_del * join_del + join_h2hinv * join_h2hinv + join_t2tinv * join_t2tinv + join_dup * join_dup AS q FROM jc),
inr AS (SELECT *, inter_number_del + inter_number_h2hinv + inter_number_t2tinv + inter_number_dup AS n, inter_number_del * inter_number_del + inter_number_h2hinv * inter_number_h2hinv + inter_number_t2tinv * inter_number_t2tinv + inter_number_dup * inter_number_dup AS q FROM ij),
sizes AS (SELECT n FROM jn WHERE n > 0 UNION SELECT n FROM inr WHERE n > 0), cells AS ({_ALL_CELLS.format("sizes")}), sq AS (SELECT n, squares, sum(p) AS p FROM cells GROUP BY ALL),
tail AS (SELECT n, squares, sum(p) OVER (PARTITION BY n ORDER BY squares DESC) AS p FROM sq),
here AS (SELECT h.*, CASE WHEN windowed THEN n_here ELSE t.n END AS n_all, g.size / (SELECT sum(size) FROM genome) AS w FROM (SELECT sample_id, chrom, count(DISTINCT sv_id) AS n_here, bool_or(near) AS windowed FROM lk GROUP BY ALL) h
  JOIN (SELECT sample_id, count(*) AS n FROM sv WHERE chrom1 <> chrom2 GROUP BY ALL) t USING (sample_id) JOIN genome g USING (chrom)),
enr AS (SELECT sample_id, chrom, least(1.0, list_sum(list_filter(ps, lambda p: p <= ps[n_here + 1] * (1 + 1e-7)))) AS chr_breakpoint_enrichment FROM (
  SELECT *, list_transform(range(0, n_all + 1), lambda i: exp(lgamma(n_all + 1) - lgamma(i + 1) - lgamma(n_all - i + 1) + i * ln(w) + (n_all - i) * ln(1 - w))) AS ps FROM here)),
crit AS (SELECT s.sample_id, g.chrom, k.* EXCLUDE (sample_id, chrom, cluster_size), coalesce(k.cluster_size, 0) AS cluster_size, jn.number_tra, jn.n AS cluster_size_including_tra, CASE WHEN t1.p IS NOT NULL THEN least(1.0, t1.p) END AS pval_fragment_joins,
    CASE WHEN g1.ks_d IS NOT NULL THEN ((SELECT count(*) FROM z WHERE z.n = g1.n_gaps AND z.d >= g1.ks_d) + 1) / 1001 END AS pval_exp_cluster, CASE WHEN g2.ks_d IS NOT NULL THEN ((SELECT count(*) FROM z WHERE z.n = g2.n_gaps AND z.d >= g2.ks_d) + 1) / 1001 END AS pval_exp_chr,
    chr_breakpoint_enrichment, inr.* EXCLUDE (sample_id, chrom, n, q), CASE WHEN t2.p IS NOT NULL THEN least(1.0, t2.p) END AS inter_pval_fragment_joins, s.number_svs_sample
  FROM (SELECT sample_id, count(*) AS number_svs_sample FROM sv GROUP BY ALL) s CROSS JOIN genome g LEFT JOIN ({oracle.text("ct_cluster_summary")}) k ON k.sample_id = s.sample_id AND k.chrom = g.chrom LEFT JOIN jn ON jn.sample_id = s.sample_id AND jn.chrom = g.chrom
  LEFT JOIN tail t1 ON t1.n = jn.n AND t1.squares = jn.q LEFT JOIN g1 ON g1.sample_id = s.sample_id AND g1.chrom = g.chrom LEFT JOIN g2 ON g2.sample_id = s.sample_id AND g2.chrom = g.chrom LEFT JOIN enr ON enr.sample_id = s.sample_id AND enr.chrom = g.chrom
  LEFT JOIN inr ON inr.sample_id = s.sample_id AND inr.chrom = g.chrom LEFT JOIN tail t2 ON t2.n = inr.n AND t2.squares = inr.q)"""
_CRITERIA_TABLES = ("member", "sv", "sides", "cluster", "jc", "osc", "osc_cluster", "genome")

# Chains as all simple paths: edges of a part of translocations that the small graphs are made of, then a recursion over paths.
_FEW = """few AS (SELECT sample_id, sv_no, chrom1, pos1, chrom2, pos2 FROM sv WHERE chrom1 <> chrom2 AND sv_no % {every} = 0),
ends AS (SELECT sample_id, sv_no, chrom1 AS chrom, pos1 AS pos FROM few UNION ALL SELECT sample_id, sv_no, chrom2, pos2 FROM few), node AS (SELECT DISTINCT sample_id, chrom, pos FROM ends),
lost AS (SELECT e.*, c.start AS a, c."end" AS b FROM ends e JOIN cnv c ON c.sample_id = e.sample_id AND c.chrom = e.chrom AND c.total_cn < 2 AND c.start <= e.pos + 1000000 AND c."end" >= e.pos - 1000000),
tra AS (SELECT sample_id, chrom1 || ':' || pos1 AS x, chrom2 || ':' || pos2 AS y, 'T' AS kind, sv_no FROM few),
bridge AS (SELECT l.sample_id, l.chrom || ':' || l.pos AS x, n.chrom || ':' || n.pos AS y, 'B' AS kind, l.sv_no FROM lost l JOIN node n ON n.sample_id = l.sample_id AND n.chrom = l.chrom AND n.pos <> l.pos AND n.pos BETWEEN a - {pad} AND b + {pad})"""
_RATES = """total AS (SELECT sample_id, count(*) AS k FROM {ends} GROUP BY ALL),
mu AS (SELECT t.sample_id, g.chrom, least(coalesce(n, 0) / 10, 1.0e0) * coalesce(n, 0) / (g.size / 1e6) + (1 - least(coalesce(n, 0) / 10, 1.0e0)) * k / ((SELECT sum(size) FROM genome) / 1e6) AS mu
  FROM total t CROSS JOIN genome g LEFT JOIN (SELECT sample_id, chrom, count(*) AS n FROM {ends} GROUP BY ALL) c ON c.sample_id = t.sample_id AND c.chrom = g.chrom),
close AS (SELECT * FROM (SELECT a.sample_id, a.chrom, a.pos, b.pos AS to_pos, b.pos - a.pos AS distance, 1 - exp((b.pos - a.pos) * -(2 * mu / 1e6 + 2 * mu * mu / 1e12 + 8 * mu * mu * mu / 3e18)) AS p FROM {node} a JOIN {node} b ON b.sample_id = a.sample_id AND b.chrom = a.chrom AND b.pos > a.pos AND b.pos - a.pos <= 10000000
  JOIN mu m ON m.sample_id = a.sample_id AND m.chrom = a.chrom) WHERE p < 0.01)"""
_PATHS = """steps AS (SELECT * FROM edge UNION SELECT sample_id, y, x, kind, sv_no FROM edge),
path AS (WITH RECURSIVE walk(sample_id, nodes, svs, tra, streak) AS (
    SELECT DISTINCT sample_id, [chrom || ':' || pos], CAST([] AS BIGINT[]), 0, 0 FROM node UNION ALL
    SELECT w.sample_id, list_append(nodes, y), CASE WHEN sv_no IS NULL THEN svs ELSE list_append(svs, sv_no) END, tra + CAST(kind = 'T' AS INT), CASE WHEN kind = 'A' THEN streak + 1 ELSE 0 END
    FROM walk w JOIN steps e ON e.sample_id = w.sample_id AND e.x = w.nodes[-1] WHERE len(nodes) < 10 AND NOT list_contains(nodes, y) AND NOT (kind = 'A' AND streak >= 3))
  SELECT * FROM walk WHERE tra >= 3 AND len(list_distinct(list_transform(nodes, lambda n: string_split(n, ':')[1]))) >= 3)"""

_SQL = {
    "ct_inter_joins": (f"WITH {_INTER} FROM ij", "sides", "cluster", "member", "sv"),
    "ct_classification": (
        f"""{_CRITERIA} SELECT * EXCLUDE (n, total, clustered, osc, joins) REPLACE ({", ".join(f"round({c} + 1e-10, 6) AS {c}" for c in ("pval_fragment_joins", "pval_exp_cluster", "pval_exp_chr", "chr_breakpoint_enrichment", "inter_pval_fragment_joins"))}),
  round(total, 6) AS confidence_score, CASE WHEN total >= 0.7 THEN 'High' WHEN total >= 0.4 THEN 'Moderate' ELSE 'Low' END AS confidence_category FROM ({rules.classed("FROM crit")})""", *_CRITERIA_TABLES),
    "ct_diagnostics": (f"""{_CRITERIA} {rules.SQL["ct_diagnosis_rules"][0].replace(rules.criteria_sql(), "FROM crit")}""", *_CRITERIA_TABLES),
    "ct_sample_summary": (
        f"""{_CRITERIA} SELECT sample_id, count(*) FILTER (classification = 'High confidence') AS n_high, count(*) FILTER (classification = 'Low confidence') AS n_low, count(*) FILTER (classification = 'Not chromothripsis') AS n_not, round(max(total), 6) AS max_score,
  coalesce(string_agg(chrom, ',' ORDER BY total DESC, chrom) FILTER (classification = 'High confidence'), '') AS high_chromosomes, coalesce(string_agg(chrom, ',' ORDER BY total DESC, chrom) FILTER (classification = 'Low confidence'), '') AS low_chromosomes
FROM ({rules.classed("FROM crit")}) GROUP BY sample_id""", *_CRITERIA_TABLES),
    "stat_adjacency_edges": (
        f"""WITH ends AS (SELECT sample_id, chrom, pos FROM sides), node AS (SELECT DISTINCT sample_id, chrom, pos FROM ends), {_RATES.format(ends="ends", node="node")}
SELECT sample_id, chrom, pos, to_pos, distance, round(p, 9) AS pvalue FROM close""", "sides", "genome"),
    "cp_chains_small": (
        f"""WITH {_FEW.format(pad=1000, every=4)}, near AS (SELECT sample_id, chrom, pos, unnest([lead(pos, 1) OVER w, lead(pos, 2) OVER w, lead(pos, 3) OVER w]) AS to_pos FROM node WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY pos)),
edge AS (FROM tra UNION FROM bridge UNION SELECT sample_id, chrom || ':' || pos, chrom || ':' || to_pos, 'A', NULL FROM near WHERE to_pos - pos - 1 <= 10000000), {_PATHS}
SELECT DISTINCT sample_id, array_to_string(list_sort(list_distinct(svs)), ',') AS variants FROM path""", "sv", "cnv"),
    # stretches of rate edges have no bound
    "cp_rate_chains_small": (
        f"""WITH {_FEW.format(pad=0, every=3)}, {_RATES.format(ends="ends", node="node")}, edge AS (FROM tra UNION FROM bridge UNION SELECT sample_id, chrom || ':' || pos, chrom || ':' || to_pos, 'S', NULL FROM close), {_PATHS}
SELECT DISTINCT sample_id, array_to_string(list_sort(nodes), ',') AS nodes FROM path""", "sv", "cnv", "genome"),
    # five blocks of 32 bases around each breakpoint, of which kept and discarded ones are cut
    "junction_flanks": (
        """WITH v AS (SELECT sample_id, sv_id, chrom1, pos1 // 100 AS pos1, strand1, chrom2, pos2 // 100 AS pos2, strand2 FROM sv), size AS (SELECT (max(greatest(pos1, pos2)) // 32 + 2) * 32 AS n FROM v),
e AS (SELECT sample_id, sv_id, 1 AS side, chrom1 AS chrom, pos1 AS pos, strand1 AS strand FROM v UNION ALL SELECT sample_id, sv_id, 2, chrom2, pos2, strand2 FROM v),
b AS (SELECT *, pos - 32 * ((pos - 1) // 32 - 2) AS i, array_to_string(list_transform(range((pos - 1) // 32 - 2, (pos - 1) // 32 + 3), lambda k: translate(md5('fa:' || chrom || ':' || k), '0123456789abcdef', 'ACGTACGTACGTACGT')), '') AS s FROM e, size),
k AS (SELECT *, CASE WHEN strand = '+' THEN substr(s, i - 49, 50) ELSE substr(s, i, 50) END AS kept, CASE WHEN strand = '+' THEN substr(s, i + 1, 50) ELSE substr(s, i - 50, 50) END AS disc,
  (strand = '+') = (side = 2) AS turned, CASE WHEN strand = '+' THEN pos <= n AND pos >= 50 ELSE pos + 49 <= n END AS kept_in, CASE WHEN strand = '+' THEN pos + 50 <= n ELSE pos > 50 END AS disc_in FROM b),
t AS (SELECT sample_id, sv_id, side, chrom <> '6' AS has, CASE WHEN kept_in THEN CASE WHEN turned THEN reverse(translate(kept, 'ACGT', 'TGCA')) ELSE kept END END AS kept, CASE WHEN disc_in THEN CASE WHEN turned THEN reverse(translate(disc, 'ACGT', 'TGCA')) ELSE disc END END AS disc FROM k)
SELECT a.sample_id, a.sv_id, a.has AND b.has AS has_sequence, CASE WHEN a.has AND b.has THEN a.kept ELSE '' END AS s1_kept, CASE WHEN a.has AND b.has THEN a.disc ELSE '' END AS s1_disc,
  CASE WHEN a.has AND b.has THEN b.kept ELSE '' END AS s2_kept, CASE WHEN a.has AND b.has THEN b.disc ELSE '' END AS s2_disc FROM t a JOIN t b ON a.sample_id = b.sample_id AND a.sv_id = b.sv_id AND a.side = 1 AND b.side = 2""", "sv"),
    "ct_gap_tests": (
        f"""WITH g AS ({_GAPS}),
x AS (SELECT n, s, -ln((CAST('0x' || substr(md5('1:' || n || ':' || s || ':' || i), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496) AS v FROM (
  SELECT n, s, unnest(range(1, n + 1)) AS i FROM (SELECT DISTINCT n_gaps AS n FROM g), range(1, 1001) r(s))),
y AS (SELECT *, 1 - exp(-v / (sum(v) OVER (PARTITION BY n, s) / n)) AS cdf, row_number() OVER (PARTITION BY n, s ORDER BY v) AS i FROM x),
z AS (SELECT n, s, greatest(max(i / n - cdf), max(cdf - (i - 1) / n)) AS d FROM y GROUP BY n, s)
SELECT sample_id, chrom, n_gaps, round(ks_d, 6) AS ks_d, round(((SELECT count(*) FROM z WHERE z.n = g.n_gaps AND z.d >= g.ks_d) + 1) / 1001, 6) AS pvalue FROM g""", "member", "sv", "sides", "cluster"),
    "ct_join_tests": (
        f"""WITH j AS (SELECT sample_id, chrom, join_del, join_h2hinv, join_t2tinv, join_dup, join_del + join_h2hinv + join_t2tinv + join_dup AS n, join_del * join_del + join_h2hinv * join_h2hinv + join_t2tinv * join_t2tinv + join_dup * join_dup AS q FROM jc),
cells AS ({_ALL_CELLS.format("(SELECT DISTINCT n FROM j WHERE n > 0)")}), tail AS (SELECT n, squares, sum(p) AS p FROM cells GROUP BY ALL)
SELECT sample_id, chrom, join_del, join_h2hinv, join_t2tinv, join_dup, CASE WHEN n > 0 THEN round(ln(least(1.0, (SELECT sum(p) FROM tail t WHERE t.n = j.n AND squares >= q))), 9) + 0.0 END AS log_pvalue FROM j""", "jc"),
    "equal_shares_null": (
        f"""WITH ns AS (SELECT unnest(range(1, k + 1)) AS n FROM (SELECT least(max(k), 60) AS k FROM (SELECT count(*) AS k FROM sv GROUP BY sample_id))),
cells AS ({_ALL_CELLS.format("ns")}) SELECT n, squares, round(ln(least(1.0, sum(sum(p)) OVER (PARTITION BY n ORDER BY squares DESC))), 9) + 0.0 AS log_pvalue FROM cells GROUP BY n, squares""", "sv"),
    "ct_enrichment_tests": (
        """SELECT sample_id, chrom, x AS n_here, n AS n_all, round(list_sum(list_transform(list_filter(ps, lambda p: p <= ps[x + 1] * (1 + 1e-7)), lambda p: p)), 9) AS pvalue FROM (
  SELECT *, list_transform(range(0, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(w) + (n - i) * ln(1 - w))) AS ps FROM (
    SELECT h.*, t.n, g.size / (SELECT sum(size) FROM genome) AS w FROM (SELECT sample_id, chrom, count(DISTINCT sv_id) AS x FROM sides GROUP BY ALL) h
    JOIN (SELECT sample_id, count(*) AS n FROM sv WHERE chrom1 <> chrom2 GROUP BY ALL) t USING (sample_id) JOIN genome g USING (chrom)))""", "sides", "sv", "genome"),
    "ct_degrees": ("""SELECT sample_id, chrom1 AS chrom, sv_id, (SELECT count(*) FROM pair p WHERE p.sample_id = sv.sample_id AND (p.a = sv.sv_id OR p.b = sv.sv_id)) AS degree FROM sv WHERE chrom1 = chrom2""", "sv", "pair"),
    "cs_window_tests": (
        f"""SELECT sample_id, chrom, win_size, start_idx, n_segments, round(rho, 9) + 0.0 AS gradient_correlation, {_RHO_P} AS pvalue
FROM (SELECT * EXCLUDE (gradient_correlation), gradient_correlation AS rho, n_segments - 2 AS df FROM ({oracle.text("cs_windows").replace("round(rho, 6) + 0.0 END", "rho END")}))""", "cnv", "frame"),
    "cs_candidates": (
        f"""SELECT sample_id, chrom, win_size, start_idx, n_segments FROM (SELECT *, coalesce({_RHO_P}, 1.0) AS p FROM (SELECT *, gradient_correlation AS rho, n_segments - 2 AS df, variation_score AS v FROM ({_WINDOWS})))
WHERE (coalesce(n_segments >= 6 AND p < 0.05 AND rho > 0.3, false) OR coalesce(rho >= 0.8, false) OR coalesce(rho > 0.3 AND v > 1.8, false)) AND (slope > 0.05 OR v > 2.0)""", "cnv", "frame"),
    "cs_topology": (
        """WITH r AS (SELECT sample_id, sv_no AS region_id, chrom1 AS chrom, pos1 AS start, pos1 + 500000 + (sv_no * 7919 % 4000) * 1000 - 1 AS "end" FROM sv WHERE sv_no // 6 % 3 = 2),
i AS (SELECT r.sample_id, r.region_id, s.sv_no, s.svtype, s.pos1, s.pos2 FROM r JOIN sv s ON s.sample_id = r.sample_id AND s.chrom1 = r.chrom AND s.chrom2 = r.chrom AND s.pos1 BETWEEN r.start AND r."end" AND s.pos2 BETWEEN r.start AND r."end"),
e AS (SELECT sample_id, region_id, sv_no, unnest([pos1, pos2]) AS pos FROM i), n AS (SELECT *, lead(pos) OVER w AS next_pos, lead(sv_no) OVER w AS next_no FROM e WINDOW w AS (PARTITION BY sample_id, region_id ORDER BY pos, sv_no)),
l AS (SELECT sample_id, region_id, sv_no AS a, next_no AS b FROM n WHERE next_pos - pos - 1 <= 2000 UNION SELECT sample_id, region_id, next_no, sv_no FROM n WHERE next_pos - pos - 1 <= 2000),
c AS (SELECT sample_id, region_id, sv_no, min(root) AS root FROM (WITH RECURSIVE reach(sample_id, region_id, sv_no, root) AS (SELECT sample_id, region_id, sv_no, sv_no FROM i UNION
  SELECT q.sample_id, q.region_id, l.b, q.root FROM reach q JOIN l ON l.sample_id = q.sample_id AND l.region_id = q.region_id AND l.a = q.sv_no) FROM reach) GROUP BY ALL),
k AS (SELECT sample_id, region_id, count(*) AS n_linked_chains, max(m) AS longest FROM (SELECT sample_id, region_id, root, count(*) AS m FROM c GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL),
t AS (SELECT sample_id, region_id, count(*) FILTER (svtype = 'DUP' AND abs(pos2 - pos1) < 1000000) AS n_tandem_dups, count(*) FILTER (svtype LIKE '%INV' AND abs(pos2 - pos1) < 20000) AS n_fold_backs, count(*) AS n_total_svs FROM i GROUP BY ALL),
x AS (SELECT r.sample_id, r.region_id, count(DISTINCT s.sv_id) AS n_inter FROM r JOIN sides s ON s.sample_id = r.sample_id AND s.chrom = r.chrom AND s.pos BETWEEN r.start AND r."end" GROUP BY ALL)
SELECT r.*, coalesce(n_tandem_dups, 0) AS n_tandem_dups, coalesce(n_fold_backs, 0) AS n_fold_backs, coalesce(n_total_svs, 0) AS n_total_svs, coalesce(n_linked_chains, 0) AS n_linked_chains, coalesce(longest, 0) AS max_chain_length, coalesce(n_inter, 0) AS n_inter_chr_svs
FROM r LEFT JOIN t USING (sample_id, region_id) LEFT JOIN k USING (sample_id, region_id) LEFT JOIN x USING (sample_id, region_id)""", "sv", "sides"),
    "oscillation_permutations": (
        """WITH c AS (SELECT sample_id, chrom, row_number() OVER w - 1 AS i, CAST(round_even(total_cn, 0) AS BIGINT) AS v FROM cnv WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY start, seg_no)),
o AS (SELECT *, 0 AS time, i AS spot FROM c UNION ALL SELECT c.*, t.time, row_number() OVER (PARTITION BY sample_id, chrom, t.time ORDER BY md5('1:' || t.time || ':' || i)) - 1 FROM c, range(1, 201) t(time)),
s AS (SELECT *, coalesce(v = lead(v, 2) OVER w, false) AS same FROM o WINDOW w AS (PARTITION BY sample_id, chrom, time ORDER BY spot)),
g AS (SELECT *, spot - row_number() OVER (PARTITION BY sample_id, chrom, time, same ORDER BY spot) AS island FROM s),
b AS (SELECT sample_id, chrom, time, coalesce(max(n) FILTER (same), 0) AS best FROM (SELECT sample_id, chrom, time, same, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL)
SELECT b.sample_id, b.chrom, (SELECT count(*) FROM c WHERE c.sample_id = b.sample_id AND c.chrom = b.chrom) AS n_segments, max(z.best) AS observed, round(avg(CAST(b.best >= z.best AS INT)), 6) AS pvalue
FROM b JOIN b z ON z.sample_id = b.sample_id AND z.chrom = b.chrom AND z.time = 0 WHERE b.time > 0 GROUP BY b.sample_id, b.chrom""", "cnv"),
    "chromosome_bounds": (
        f"""SELECT chrom, chrom_no, CAST(shift AS BIGINT) AS start, CAST(shift + size AS BIGINT) AS end, shift + size / 2 AS middle, CAST(shift + mid AS BIGINT) AS centromere, n AS n_breakpoints FROM (
  SELECT *, coalesce(sum(size) OVER (ORDER BY chrom_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift, [{", ".join(map(str, CENTROMERES["hg19"]))}][chrom_no] AS mid FROM genome) JOIN (SELECT chrom, count(*) AS n FROM bps GROUP BY ALL) USING (chrom)""", "genome", "bps"),
    "position_texts": (
        """SELECT *, CASE WHEN pos >= 1000000 THEN printf('%.2f Mb', pos / 1e6) WHEN pos >= 1000 THEN printf('%.1f Kb', pos / 1e3) ELSE pos || ' bp' END AS text FROM (
  SELECT sample_id, sv_id, pos1 // CASE sv_no % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 100000 END * 10 + 3 AS pos FROM sv)""", "sv"),
    "recurrence_order": (f"SELECT chrom, window_start, n_samples, n_collapsed_events FROM ({oracle.text('recurrent_regions')}) ORDER BY n_samples DESC, n_collapsed_events DESC, chrom, window_start", "points"),
    "gene_enrichment": (
        f"""WITH h AS ({_HITS}), s AS (SELECT DISTINCT sample_id, CAST(substr(sample_id, 2) AS INT) % 3 = 0 AS pos FROM sv),
t AS (SELECT symbol, count(*) FILTER (pos) AS a, count(*) FILTER (NOT pos) AS b FROM h JOIN s USING (sample_id) GROUP BY symbol),
x AS (SELECT *, {_TABLE} FROM (SELECT *, (SELECT count(*) FROM s WHERE pos) - a AS c, (SELECT count(*) FROM s WHERE NOT pos) - b AS d FROM t)),
w AS (SELECT symbol, a, lo, hi, list_transform(range(lo, hi + 1), lambda i: {_LOG_CELL}) AS logs, {_GREATER} AS p FROM x),
o AS (WITH RECURSIVE halved(symbol, step, low, high) AS (
    SELECT symbol, 0, -50.0e0, 50.0e0 FROM w UNION ALL
    SELECT symbol, step + 1, CASE WHEN mean < a THEN mid ELSE low END, CASE WHEN mean < a THEN high ELSE mid END FROM (
      SELECT h.*, a, (low + high) / 2 AS mid, list_sum(list_transform(range(lo, hi + 1), lambda i: i * exp(logs[i - lo + 1] + i * (low + high) / 2 - top))) / list_sum(list_transform(range(lo, hi + 1), lambda i: exp(logs[i - lo + 1] + i * (low + high) / 2 - top))) AS mean
      FROM (SELECT h.*, w.* EXCLUDE (symbol), list_max(list_transform(range(lo, hi + 1), lambda i: logs[i - lo + 1] + i * (low + high) / 2)) AS top FROM halved h JOIN w USING (symbol) WHERE step < 70) h))
  SELECT symbol, exp((low + high) / 2) AS ratio FROM halved WHERE step = 70),
r AS (SELECT w.*, ratio, count(*) OVER () AS m_, count(*) OVER (ORDER BY p) AS r_ FROM w JOIN o USING (symbol))
SELECT symbol, x.a AS mech_pos_hits, x.b AS mech_neg_hits, round(x.a / (x.a + x.c), 6) AS mech_pos_freq, round(x.b / (x.b + x.d), 6) AS mech_neg_freq,
  CASE WHEN x.a = x.lo THEN 0.0 WHEN x.a = x.hi THEN CAST('infinity' AS DOUBLE) ELSE round(ratio, 6) END AS odds_ratio, round(p, 6) AS pvalue, {_BH.format(p="p", part="", d=6)} AS fdr FROM r JOIN x USING (symbol)""", "bps", "gene", "sv"),
    "over_representation": (
        f"""WITH sets AS ({_GENE_SETS}), picked AS (SELECT symbol FROM gene WHERE is_driver OR chrom = '2'),
z AS (SELECT source, set_name, count(*) AS set_size, count(*) FILTER (symbol IN (FROM picked)) AS hits, string_agg(symbol, '/' ORDER BY symbol) FILTER (symbol IN (FROM picked)) AS symbols FROM sets GROUP BY ALL HAVING hits > 0),
x AS (SELECT *, {_TABLE} FROM (SELECT *, hits AS a, n_genes - hits AS b, set_size - hits AS c, 20000 - n_genes - set_size + hits AS d FROM (SELECT z.*, g.n_genes FROM z, (SELECT count(*) AS n_genes FROM picked) g))),
t AS (SELECT *, {_GREATER} AS p FROM x), r AS (SELECT *, count(*) OVER (PARTITION BY source) AS m_, count(*) OVER (PARTITION BY source ORDER BY p) AS r_ FROM t)
SELECT source, set_name, hits, symbols, set_size, n_genes, round(p, 9) AS pvalue, {_BH.format(p="p", part="PARTITION BY source", d=9)} AS fdr, row_number() OVER (PARTITION BY source ORDER BY p, set_name) AS place FROM r""", "gene"),
    "group_pair_tests": (
        f"""WITH f AS (SELECT m.mechanism, CAST(c.os_event AS VARCHAR) AS grp, EXISTS (SELECT 1 FROM ({_LAID}) k WHERE k.sample_id = c.sample_id AND k.mechanism = m.mechanism) AS has FROM clinical c, (SELECT DISTINCT mechanism FROM calls) m),
x AS (SELECT mechanism, {_TABLE}, a, b, c, d FROM (SELECT mechanism, count(*) FILTER (grp = '0' AND has) AS a, count(*) FILTER (grp = '1' AND has) AS b, count(*) FILTER (grp = '0' AND NOT has) AS c, count(*) FILTER (grp = '1' AND NOT has) AS d FROM f GROUP BY mechanism)),
t AS (SELECT mechanism, {_TWO_SIDED} AS p FROM x WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0)
SELECT mechanism, 'Fisher''s Exact' AS test, round(p, 9) AS pvalue, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM t""", "calls", "clinical"),
    "bh_adjust_all": (
        f"""SELECT * EXCLUDE (q, m_, r_, m2_, r2_), round(q, 9) AS p, CASE WHEN q IS NOT NULL THEN {_BH.format(p="q", part="PARTITION BY q IS NULL", d=9)} END AS fdr, CASE WHEN q IS NOT NULL THEN {_BH.format(p="q", part="PARTITION BY svtype, q IS NULL", d=9).replace("m_", "m2_").replace("r_", "r2_")} END AS fdr_by_type
FROM (SELECT *, count(q) OVER () AS m_, count(q) OVER (ORDER BY q) AS r_, count(q) OVER (PARTITION BY svtype) AS m2_, count(q) OVER (PARTITION BY svtype ORDER BY q) AS r2_
  FROM (SELECT sample_id, sv_id, svtype, CASE WHEN sv_no % 17 = 0 THEN NULL WHEN sv_no % 4 = 0 THEN 1.0e0 ELSE CAST(sv_no * 7919 % 2003 + 1 AS DOUBLE) / 2004.0e0 END AS q FROM sv))""", "sv"),
    "km_tests": (
        f"""WITH t AS (SELECT feature, n, n_events, cutpoint, chisq, {_CHI1} AS p FROM ({oracle.text("logrank").replace("round(chisq, 6) AS chisq", "chisq")})),
g AS (SELECT feature, string_agg(grp || ' n=' || n || ' events=' || e, '; ' ORDER BY grp) AS groups FROM (SELECT feature, grp, count(*) AS n, CAST(sum(event) AS BIGINT) AS e FROM long GROUP BY ALL) GROUP BY feature),
r AS (SELECT *, count(p) OVER () AS m_, count(p) OVER (ORDER BY p) AS r_ FROM t)
SELECT feature, n, n_events, cutpoint, round(chisq, 6) AS chisq, groups, round(p, 6) AS pvalue, {_BH.format(p="p", part="", d=6)} AS fdr FROM r JOIN g USING (feature)""", "lr", "long"),
    # Newton steps of Efron's partial likelihood on standardised values; each death k of d at one time leaves k / d of the others' deaths out
    "hazard_forest": (
        f"""WITH x AS (SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY sample_id) AS id, time, event, (value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature) AS z, stddev_pop(value) OVER (PARTITION BY feature) AS sd FROM long),
d AS (SELECT *, row_number() OVER (PARTITION BY feature, time ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY feature, time) AS n FROM x WHERE event = 1),
f AS (WITH RECURSIVE newton(feature, step, beta, info) AS (
    SELECT DISTINCT feature, 0, 0.0e0, 0.0e0 FROM x UNION ALL
    SELECT feature, step + 1, any_value(beta) + sum(z - m1 / m0) / sum(m2 / m0 - (m1 / m0) * (m1 / m0)), sum(m2 / m0 - (m1 / m0) * (m1 / m0)) FROM (
      SELECT b.feature, b.step, b.beta, d.id, any_value(d.z) AS z, sum(w * r) AS m0, sum(w * r * jz) AS m1, sum(w * r * jz * jz) AS m2 FROM (
        SELECT b.*, d.id, d.z, j.z AS jz, exp(b.beta * j.z) AS r, 1 - CASE WHEN j.time = d.time AND j.event = 1 THEN d.k / d.n ELSE 0 END AS w FROM newton b JOIN d ON d.feature = b.feature JOIN x j ON j.feature = d.feature AND j.time >= d.time WHERE b.step < 12) b
      , LATERAL (SELECT b.id, b.z) d GROUP BY b.feature, b.step, b.beta, d.id) GROUP BY feature, step)
  SELECT feature, beta, info FROM newton WHERE step = 12),
e AS (SELECT feature, beta / sd AS b, 1 / sqrt(info) / sd AS se, n, n_events, beta * beta * info AS chisq FROM f JOIN (SELECT feature, any_value(sd) AS sd, count(*) AS n, CAST(sum(event) AS BIGINT) AS n_events FROM x GROUP BY feature) USING (feature)),
p AS (SELECT *, {_CHI1} AS p FROM e), r AS (SELECT *, count(*) OVER () AS m_, count(*) OVER (ORDER BY p) AS r_ FROM p)
SELECT feature, 'univariable' AS model, n, n_events, round(exp(b), 6) AS hazard_ratio, round(exp(b - 1.959963984540054 * se), 6) AS conf_low, round(exp(b + 1.959963984540054 * se), 6) AS conf_high, round(p, 6) AS pvalue, '' AS covariates, {_BH.format(p="p", part="", d=6)} AS fdr
FROM r ORDER BY p, feature LIMIT 20""", "long"),
    "chrom_class": (
        """SELECT sample_id, chrom, string_agg(mechanism, '+' ORDER BY mechanism) AS mechanisms, arg_min(mechanism, (-best, mechanism)) AS dominant_mechanism, count(*) AS n_mechanisms, max(best) AS max_confidence, CAST(sum(k) AS BIGINT) AS n_events, count(*) > 1 AS is_mixed
FROM (SELECT sample_id, chrom, mechanism, max(confidence) AS best, count(*) AS k FROM calls GROUP BY ALL) GROUP BY ALL""", "calls"),
    "chrom_status": (
        """SELECT sample_id, chrom, CASE WHEN count(*) > 1 THEN 'mixed' ELSE max(mechanism) END AS dominant_mechanism, CAST(sum(CASE WHEN mechanism = 'chromoplexy' THEN 1 ELSE n END) AS BIGINT) AS n_events, string_agg(mechanism, ', ' ORDER BY rank) AS mechanisms_list
FROM (SELECT sample_id, chrom, mechanism, rank, count(*) AS n FROM calls GROUP BY ALL) GROUP BY ALL""", "calls"),
    "sample_class": (
        f"""SELECT sample_id, CASE WHEN n_mechanisms = 0 THEN 'No chromoanagenesis' WHEN n_mechanisms = 1 THEN 'Pure ' || names[1] WHEN n_overlaps > 0 THEN 'Mixed mechanisms with spatial overlap (' || array_to_string(names, '+') || ')'
  ELSE 'Multiple independent mechanisms (' || array_to_string(names, '+') || ')' END AS classification, CASE WHEN n_mechanisms = 0 THEN 'normal' WHEN n_mechanisms = 1 THEN 'single_mechanism' WHEN n_overlaps > 0 THEN 'mixed_overlapping' ELSE 'mixed_independent' END AS category,
  n_mechanisms, n_mixed_chromosomes, n_overlaps > 0 AS has_spatial_overlap, n_overlaps FROM ({_PLACED})""", "calls", "overlap"),
    "complexity": (
        f"""SELECT * EXCLUDE (s), round(s, 6) AS score, CASE WHEN s < 0.3 THEN 'Low' WHEN s < 0.6 THEN 'Moderate' WHEN s < 0.8 THEN 'High' ELSE 'Very High' END AS level FROM (
  SELECT sample_id, n_mechanisms, n_chromosomes, n_mixed_chromosomes, e1 + e2 + e3 AS n_events, n_overlaps, n_mechanisms / 3 * 0.30e0 + least(n_overlaps / 5, 1) * 0.25e0 + least(n_chromosomes / 10, 1) * 0.25e0 + least((e1 + e2 + e3) / 10, 1) * 0.20e0 AS s FROM ({_PLACED}))""", "calls", "overlap"),
    "dominance": (f"SELECT sample_id, mechanism, n_events, round(p, 6) AS proportion, dominant FROM ({_SHARES})", "calls", "sv"),
    "dominance_labels": (f"SELECT sample_id, mechanism, round(sum(p) OVER (PARTITION BY sample_id ORDER BY mechanism) - p / 2, 6) AS label_at FROM ({_SHARES})", "calls", "sv"),
    "repair_summary": (
        """SELECT sample_id, count(*) AS n, count(*) FILTER (has_microhomology) AS n_microhomology, round(avg(CAST(has_microhomology AS INT)), 6) AS proportion, round(avg(mh_length), 6) AS mean_length, round(median(mh_length), 6) AS median_length, min(mh_length) AS min_length, max(mh_length) AS max_length,
  (SELECT repair_mechanism FROM repair q WHERE q.sample_id = r.sample_id GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_mechanism FROM repair r GROUP BY sample_id""", "repair"),
}


def queries() -> dict[str, str]:
    return {name: oracle.with_tables(*spec) for name, spec in _SQL.items()}
