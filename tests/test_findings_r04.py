"""Findings of round 4: what each one claims, held by a small case."""

import duckdb
import numpy as np

from karyoflux.llm import langid
from karyoflux.operators import chromoanasynthesis, integrate, rate_chains, segments
from karyoflux.operators import chromoplexy as cp
from karyoflux.operators.groups import map_groups
from karyoflux.plans import registry, rules


def test_chromosomes_count_their_calls(spark):
    loc = spark.createDataFrame([("s", "chromoplexy", "1", 0.7), ("s", "chromoplexy", "1", 0.6), ("s", "chromothripsis", "1", 0.7), ("s", "chromoplexy", "2", 0.7)], "sample_id string, mechanism string, chrom string, confidence double")
    assert {r.chrom: (r.n_events, r.n_mechanisms) for r in integrate.by_chromosome(loc).collect()} == {"1": (3, 2), "2": (1, 1)}


def test_viterbi_between_two_other_languages():
    assert langid.viterbi(np.array([[-6.0, -7.0, -8.0], [-9.0, -7.0, -6.0]]), 1.0).tolist() == [0, 2]


def test_small_groups_are_spread(spark):
    df = spark.range(40).selectExpr("cast(id as string) as k", "id")
    out = map_groups(df, ["k"], ["id"], lambda rows: [(rows[0][0], len(rows))], "k string, n long")
    assert out.count() == 40 and out.selectExpr("k", "spark_partition_id() as p").select("p").distinct().count() > 1


def test_linked_chains_of_regions_without_a_call_each(spark):
    inside = spark.createDataFrame([("s", 1, i, "DUP", 1000 * i, 1000 * i + 500) for i in range(1, 5)] + [("s", 2, 9, "DUP", 5, 90_000)], "sample_id string, region_id int, sv_no long, svtype string, pos1 long, pos2 long")
    out = chromoanasynthesis.linked_chains(inside)
    assert sorted(tuple(r) for r in out.collect()) == [("s", 1, 1, 4), ("s", 2, 0, 0)]
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_shuffles_make_no_rows(spark):
    cnv = spark.createDataFrame([("s", "1", 10 * i, 10 * i + 9, float(v), i) for i, v in enumerate((1, 2, 1, 2, 1, 3, 3), 1)], 'sample_id string, chrom string, start long, "end" long, total_cn double, seg_no int'.replace('"', "`"))
    out = segments.oscillation_test(cnv, times=300)
    assert "Generate" not in out._jdf.queryExecution().toString()
    r = out.first()
    assert (r.n_segments, r.observed) == (7, 3) and 0 < r.pvalue < 1


def test_chains_are_matched_without_pairs_as_rows(spark):
    chain = lambda rows: spark.createDataFrame(rows, "sample_id string, chain_id long, sv_nos array<long>, combined_score double")
    a, b = chain([("s", 1, [1, 2, 3], 0.1), ("s", 2, [1, 2, 3, 4], 0.9), ("t", 1, [7], 0.5)]), chain([("s", 1, [1, 2, 3, 70], 0.5), ("s", 2, [1, 2, 3, 4], None), ("t", 1, [8], 0.5)])
    out = rate_chains.match_chains(a, b)
    assert [tuple(r) for r in out.collect()] == [("s", 2, 1, 0.6), ("s", 1, 2, 0.75)]
    assert "Join" not in out._jdf.queryExecution().toString()


def test_calls_of_one_mechanism_never_meet(spark):
    loc = spark.createDataFrame([("s", m, "1", 1 + k, 9_000_000, 0.5, f"{m}{k}") for m in integrate.ORDER for k in range(2)], "sample_id string, mechanism string, chrom string, start long, end long, confidence double, event_id string")
    out = integrate.overlaps(loc)
    assert out.groupBy("mechanism1", "mechanism2").count().count() == 3 and out.count() == 12
    assert "_with#" in out._jdf.queryExecution().optimizedPlan().toString()


def test_event_chains_move_once(spark):
    c = spark.createDataFrame([("s", 1, ["1:5", "2:6"], [1], 0.5, 3, False, "SV+CNV", cp.LIKELY), ("s", 2, ["2:6", "3:7"], [2], 0.9, 4, True, "SV+CNV", cp.LIKELY), ("s", 3, ["4:1", "5:1"], [3], None, 3, False, "SV-only", cp.LIKELY)], "sample_id string, chain_id long, nodes array<string>, sv_nos array<long>, combined_score double, n_translocations long, is_cycle boolean, evidence_mode string, classification string")
    sv = spark.createDataFrame([("s", k, f"sv{k}") for k in (1, 2, 3)], "sample_id string, sv_no long, sv_id string")
    e = cp.events(c, sv)
    got = {r.raw_component_id: (r.n_chains, r.representative_chain_id, r.chain_ids, r.sv_ids, r.n_translocations, r.has_cycle, r.mean_combined_score) for r in e.collect()}
    assert got == {"1:5": (2, 2, "1,2", "sv1,sv2", 7, True, 0.7), "4:1": (1, 3, "3", "sv3", 3, False, None)}
    assert "FlatMapGroupsInPandas" not in e._jdf.queryExecution().toString()


def _walked(edges, max_paths=50, max_depth=10, max_streak=3):
    """Chains (nodes, variants) by the search written as plainly as can be."""
    order = sorted({x for e in edges for x in e[:2]})
    around = {n: sorted([(b if a == n else a, kind, v) for a, b, kind, v in edges if n in (a, b)], key=lambda x: {cp.TRA: 2, cp.BRIDGE: 1}.get(x[1], 0))[::-1] for n in order}
    degree = {n: sum(kind == cp.TRA for _, kind, _ in around[n]) for n in order}
    out, seen = [], set()

    def go(path, steps, left):
        for node, kind, v in around[path[-1]]:
            now = [*steps, (kind, v)]
            run = 0 if kind != cp.ADJACENT else next((i for i, s in enumerate(now[::-1]) if s[0] != cp.ADJACENT), len(now))
            if node in path or run > max_streak:
                continue
            own, tra = [*path, node], sum(k == cp.TRA for k, _ in now)
            if tra >= 2 and len(own) >= 3:
                used = frozenset(v for _, v in now if v is not None)
                if tra >= 3 and used not in seen and len({p.split(":")[0] for p in own}) >= 3:
                    seen.add(used)
                    out.append((own, sorted(used)))
                left[0] -= 1
                if not left[0]:
                    return
            if len(own) < max_depth and tra + max_depth - len(own) >= 2:
                go(own, now, left)
                if not left[0]:
                    return

    for start in sorted((n for n in order if degree[n]), key=lambda n: -degree[n]):
        go([start], [], [max_paths])
    return out


def test_search_is_that_of_the_plain_walk():
    rng = np.random.default_rng(3)
    for quota in (3, 50):
        places = [f"{c}:{p}" for c in range(1, 5) for p in range(1, 5)]
        edges = [(*(places[i] for i in rng.choice(16, 2, replace=False)), (cp.TRA, cp.BRIDGE, cp.ADJACENT)[k % 3], k // 2 if k % 3 < 2 else None) for k in range(40)]
        found = cp.search(edges, sorted({x for e in edges for x in e[:2]}), 3, 3, quota, 10, 3)
        assert [(c["nodes"], c["sv_nos"]) for c in found] == _walked(edges, quota) and found


def _chain_table(spark, rows):
    return spark.createDataFrame([(*r, cp.LIKELY) for r in rows], "sample_id string, chain_id long, nodes array<string>, sv_nos array<long>, combined_score double, n_translocations long, is_cycle boolean, evidence_mode string, classification string")


def test_events_read_their_chains_once(spark):
    """The chains behind an event are made once: its variants' names come from what is written."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    c = _chain_table(spark, [("s", 1, ["1:5", "2:6"], [1], 0.5, 3, False, "SV+CNV"), ("s", 2, ["3:1", "2:6"], [2], 0.9, 4, True, "SV+CNV")])
    sv = spark.createDataFrame([("s", k, f"sv{k}") for k in (1, 2)], "sample_id string, sv_no long, sv_id string")
    assert cp.events(c.coalesce(1).mapInArrow(counted, c.schema), sv, together=True).collect()[0].sv_ids == "sv1,sv2"
    assert made.value == 2


def test_events_of_many_samples_at_once(spark):
    """Long lines of chains, a name that other samples have too, groups longer than a batch, and chains without variants."""
    rows = [(f"s{i}", k, [f"{k}:1", f"{k + 1}:1"], [] if k == 2 else [k, 7], None if k == 1 else 0.1 * k, k, None, "SV+CNV") for i in range(3) for k in range(1, 30) if k != 10 + i]
    sv = spark.createDataFrame([(f"s{i}", k, f"sv{k}") for i in range(3) for k in range(30)], "sample_id string, sv_no long, sv_id string")
    c = _chain_table(spark, rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(r.sample_id, r.raw_component_id): r for r in cp.events(c, sv).collect()}
        members = {(r.sample_id, r.chain_id): r.raw_component_id for r in cp.collapse(c).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 6 and len(members) == len(rows)
    for i in range(3):
        for ks in (range(1, 10 + i), range(11 + i, 30)):
            name = min(f"{k}:1" for k in [*ks, ks[-1] + 1])
            e = got[f"s{i}", name]
            assert {members[f"s{i}", k] for k in ks} == {name} and e.nodes == sorted(f"{k}:1" for k in [*ks, ks[-1] + 1])
            assert e.sv_nos == sorted({k for k in ks if k != 2} | {7}) and (e.n_chains, e.representative_chain_id, e.n_translocations, e.has_cycle) == (len(ks), ks[-1], sum(ks), None)
            assert e.mean_combined_score == sum(0.1 * k for k in ks if k > 1) / len([k for k in ks if k > 1])


def test_prevalence_makes_no_events(spark, monkeypatch):
    from karyoflux.plans import registry

    expected = sorted(map(tuple, registry.cohort.prevalence(registry._summary(spark, "/root/testdata/sf0.001")).collect()))
    monkeypatch.setattr(cp, "events", None)
    assert sorted(map(tuple, registry.prevalence(spark, "/root/testdata/sf0.001").collect())) == expected


def test_segments_of_windows_move_once(spark):
    rows = [("s", "1", 10 * i, 10 * i + 9, float(v), i) for i, v in enumerate((1, 2, 2, 4, 3, 5, 6), 1)]
    w = chromoanasynthesis.windows(spark.createDataFrame(rows, "sample_id string, chrom string, start long, end long, total_cn double, seg_no int"))
    text = w._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
    got = {(r.win_size, r.start_idx): r for r in w.collect()}
    assert set(got) == {(5, 1), (5, 2), (5, 3), (6, 1), (6, 2), (7, 1)}
    assert abs(got[5, 1].gradient_correlation - np.corrcoef([1, 2, 3, 4, 5], [1, 2.5, 2.5, 5, 4])[0, 1]) < 1e-12 and (got[5, 1].start, got[5, 1].end, got[5, 1].cn_range) == (10, 59, 3.0)


def test_summary_counts_a_repeated_event_once(spark, tmp_path):
    """as its SQL, whose events are distinct variants of a sample."""
    for name in ("events", "part"):
        once = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (once.union(once) if name == "events" else once).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = rules.summary_rules(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("events", "part"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({registry.oracle_sql()['summary_rules']})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and any(r[out.columns.index("chromoplexy_collapsed_events")] for r in want)
