"""The pipeline and its stages on small documents against plain versions."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from karyoflux.llm import langid, minhash
from karyoflux.llm.common import with_row_ids
from karyoflux.llm.queries import tokenizer_path


def test_stages(spark, tmp_path):
    rows = [(i, f"the thing and word{i} " * (3 + i % 5) + f"number {i}", "en", f"s{i % 4}", 10) for i in range(60)]
    rows += [(100, rows[0][1].replace(" ", "  "), "en", "s0", 10), (101, rows[1][1].upper(), "en", "s1", 10), (102, "-- 12", None, "s2", 4), (103, None, "en", "s3", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixture", "tokens"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, str(tmp_path))
        after[name] = now.collect()
        if name != "tokens":
            assert now.columns == before.columns
            now = spark.createDataFrame(after[name], before.schema)
    ids = {n: sorted(r.doc_id for r in x) for n, x in after.items()}
    assert {102, 103} & set(ids["language"]) == set() and set(range(60)) <= set(ids["language"])
    assert len({re.sub(r"\s", "", r.text) for r in after["language"]}) == len(ids["exact"]) and 0 not in ids["exact"]
    sets = [set(minhash.shingles(r.text).tolist()) for r in after["near"]]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert set(ids["mixture"]) <= set(ids["near"]) and max(map(ids["mixture"].count, ids["mixture"])) <= 3
    assert ids["tokens"] == ids["mixture"] and all(len(r.ids_le) == 4 * r.n_tokens for r in after["tokens"])
    assert langid.UND not in {r.lang for r in after["language"]}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids["tokens"]


def plain_pipeline(rows, path):
    """run() over (doc_id, text, lang, source) in plain Python: {doc_id: [ids as bytes, ...]}, once for each time it is taken."""
    from tokenizers import Tokenizer

    model = langid.fit([(lang, text) for i, text, lang, _ in rows if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 4 != 2])
    kept = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and p[1] >= 0.2]
    same = {}
    for r in kept:
        same.setdefault(re.sub("[\x20\x09-\x0d]", "", r[1]), []).append(r)
    kept = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in same.values()]
    words = [[w for w in re.split("[\x20\x09-\x0d]+", r[1].lower()) if w] for r in kept]
    sets = [set(zip(*(w[i:] for i in range(5)), strict=False)) or {tuple(w)} for w in words]
    label = list(range(len(kept)))
    for b, a in itertools.combinations(range(len(kept)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            label = [label[b] if x == label[a] else x for x in label]
    groups = {}
    for r, k in zip(kept, label, strict=True):
        groups.setdefault(k, []).append(r)
    kept = [min(g) for g in groups.values()]
    size = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1])) for r in kept}
    sources = sorted({r[3] for r in kept}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    own = {s: sum(size[r[0]] for r in kept if r[3] == s) for s in sources}
    total, target, free = sum(own.values()), {}, set(sources)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * own[s]}
        target |= {s: 3 * own[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    turns = []
    for k, s in enumerate(sources):
        queue, served = sorted((hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest(), r[0]) for r in kept if r[3] == s), 0
        for epoch in range(3):
            for _, i in queue:
                served += size[i]
                turns.append((served / target[s], k, i))
    spent, out, text = 0, {}, {r[0]: r[1] for r in kept}
    tokenizer = Tokenizer.from_file(path)
    for _, _, i in sorted(turns):
        spent += size[i]
        if spent > total:
            break
        ids = tokenizer.encode(text[i], add_special_tokens=False).ids
        out.setdefault(i, []).append(struct.pack(f"<{len(ids)}I", *ids))
    return out


def test_run_by_brute_force(spark, tmp_path):
    """All five stages at once: unknown languages, copies but for white space, near copies in chains, sources of unlike sizes."""
    r = random.Random(11)
    parts = {"xx": ["ba", "do", "ki", "lu"], "yy": ["ze", "vro", "sna", "pli"], "zz": ["та", "ро", "не"]}
    make = lambda lang, n: [" ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(2, 4))) for _ in range(1)) for _ in range(n)]
    rows = []
    for i in range(90):
        lang = r.choice(list(parts))
        words = make(lang, r.randint(3, 60))
        rows.append((i, " ".join(words), lang if i % 9 else None, r.choice(["a", "a", "a", "b", "c", None])))
        if i % 6 == 0 and len(words) > 30:
            for k in range(3):  # each one word further from the last
                words[7 * k + 3] = make(lang, 1)[0]
                rows.append((1000 + 10 * i + k, " ".join(words), lang, "b"))
        if i % 7 == 0:
            rows.append((2000 + i, "  ".join(words) + "\n", lang, "c"))
    rows += [(3000, None, "xx", "a"), (3001, "12 -- 3", "xx", "a"), (3002, "", None, None), (3003, "日本語" * 30, None, "a")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(x.doc_id, []).append(bytes(x.ids_le))
    want = plain_pipeline(rows, tokenizer_path())
    assert got == want and len(want) > 40 and max(map(len, want.values())) > 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns_and_repeated_rows(docs, spark):
    """Extra columns with the operators' own names, null and repeated ids: every stage but the last returns the table's columns."""
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, "").cache()
        assert now.count() > 0 and (name == "tokens" or now.columns == before.columns)


@pytest.mark.parametrize("hot_key, known", [(64, 200_000), (3, 200_000), (3, 50)])
def test_near_finds_similar_sets(spark, monkeypatch, hot_key, known):
    """Components against all pairs, compared by brute force on sets of five words; the order of shingles needn't know all of them."""
    monkeypatch.setattr(minhash, "KNOWN", known)
    r = random.Random(9)
    word = lambda: f"w{r.randrange(5000)}"
    texts = ["", None, " \n", "one two three", "ONE  two three", "one two three four"]
    for size in (40, 150, 400):
        for family in range(6):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (1, 2, 4, 8, 12, 16):
                copy = list(base)
                for at in r.sample(range(size), max(1, changes * size // 400)):
                    copy[at] = word()
                texts.append(" ".join(copy))
            texts.append(" ".join(base[: size // 2] + [word() for _ in range(size // 2)]))
    base = [word() for _ in range(200)]
    texts += [" ".join([*base[:at], word(), *base[at + 1 :]]) for at in range(0, 200, 2)]
    sets = [set(zip(*((t or "").lower().split()[i:] for i in range(5)), strict=False)) or {tuple((t or "").lower().split())} for t in texts]
    label, pairs = list(range(len(texts))), 0
    for b, a in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            pairs += 1
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_dedup(docs, hot_key=hot_key).collect()}
    assert pairs > 1000 and got == dict(enumerate(label))
    kept = corpus_pipeline.near(spark, docs, "").collect() if hot_key == 64 else []
    assert not kept or sorted(x.doc_id for x in kept) == sorted(set(label))


def test_near_takes_candidates_by_simhash(spark):
    """Without any band, texts whose SimHashes are within two bits and whose sets are similar are linked, as by brute force."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(9000)}"
    texts = ["", None, "one two"]
    for size in (60, 300, 900):
        for _ in range(3):
            base = [word() for _ in range(size)]
            texts += [" ".join(base), " ".join([*base, word()]), *(" ".join([*base[:at], word(), *base[at + 1 :]]) for at in range(0, size, size // 12))]
    texts += texts[3:9]
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    sims = [sum(1 << bit for bit in range(64) if sum(x >> bit & 1 for x in s) * 2 > len(s)) for s in sets]
    label, linked, apart = list(range(len(texts))), 0, 0
    for b, a in itertools.combinations(range(len(texts)), 2):
        close, alike = (sims[a] ^ sims[b]).bit_count() <= 2, sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        apart += alike and not close
        if close and alike:
            linked += sets[a] != sets[b]
            label = [label[b] if x == label[a] else x for x in label]
    numbered, rid = with_row_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test")
    rows = minhash.with_signatures(numbered).select(numbered[rid].alias("rid"), "doc_id", "_s.*").withColumn("keys", F.expr("slice(keys, 1, 0)"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    found = {x.node: x.component for x in minhash.components(*minhash.candidates(numbered, rid, "text", rows)).collect()}
    got = {}
    for x in rows.collect():
        got.setdefault(found.get(x.fp, x.fp), set()).add(x.doc_id)
    want = {}
    for i, k in enumerate(label):
        want.setdefault(k, set()).add(i)
    assert linked > 20 and apart > 20 and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_uses_are_counted_before_rows_are_made(spark, monkeypatch):
    """A thousand near copies make hardly more rows than one text, and the counts are those of all shingles."""
    sets = [[*range(k % 7, 140), 1000 + k] for k in range(1000)] + [[], [5]]
    plain = Counter(x for s in sets for x in s)
    table = spark.createDataFrame([(s,) for s in sets], "set array<long>").coalesce(2)
    rows = table.mapInArrow(minhash.use_counts, "shingle long, uses long").collect()
    summed = Counter()
    for x in rows:
        summed[x.shingle] += x.uses
    assert summed == plain and len(rows) <= 1000 + 2 * 140 and sum(plain.values()) > 100_000
    monkeypatch.setattr(minhash, "COUNTED", 300)
    parts = [pa.RecordBatch.from_pydict({"set": pa.array(sets[at : at + 3], pa.list_(pa.int64()))}) for at in range(0, len(sets), 3)]
    found = list(minhash.use_counts(iter(parts)))
    summed = Counter()
    for part in found:
        summed.update(dict(zip(part["shingle"].to_pylist(), part["uses"].to_pylist(), strict=True)))
    assert summed == plain and len(found) > 100 and not list(minhash.use_counts(iter([])))


def test_small_keys_pair_no_members_of_one_component(spark):
    members = spark.createDataFrame([(1, 10, 10), (1, 11, 10), (1, 12, 12), (2, 11, 10), (2, 10, 10)], "key long, fp long, component long")
    assert sorted(tuple(x) for x in minhash._paired(members).collect()) == [(12, 10), (12, 11)]
