"""Exact top-k, near-duplicate groups, mixing and the pipeline against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from creditloom.llm import maxscore, mixing, simhash
from creditloom.llm.components import components

# --- MaxScore -------------------------------------------------------------------------------


def brute_top(rows, every, k):
    good = [
        (i, n, [math.floor(256 * x) for x in v])
        for i, (n, v) in enumerate(rows)
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, n, v in good:
        if n is not None and n % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), m is None, m or 0) for j, m, w in good if j != i and len(w) == len(v)]
            out += [(n, r + 1, None if s[1] else s[2], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("shard, block", [(7, 3), (1000, 1000)])
def test_top_k_equals_brute_force(spark, vectors_schema, shard, block):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(6)]) for i in range(60)]
    rows += [(0, rows[0][1]), (3, rows[0][1]), (5, None), (10, []), (10, [1.0, None] + [0.0] * 4), (15, [math.nan] * 6)]
    rows += [(20, [math.inf] + [0.0] * 5), (None, rows[0][1]), (25, [0.0] * 6), (30, [1.0, 2.0]), (31, [0.5, 3e4]), (35, [-1.0] * 6)]
    df = spark.createDataFrame(rows, vectors_schema).withColumn("at", F.lit("x")).withColumn("shard", F.lit(1))
    found = maxscore.top_k(df, every=5, k=4, shard_rows=shard, block_rows=block).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_top(rows, 5, 4)


def test_top_k_probes_fewer_terms_yet_finds_all():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(500, 32)) * np.geomspace(300, 1, 32)).astype(np.int64)
    shard = maxscore.Postings(rows, np.arange(500), np.arange(500))
    for q in range(0, 500, 25):
        places, scores = shard.best(rows[q], q, 5)
        exact = rows @ rows[q]
        order = [i for i in np.lexsort((np.arange(500), -exact)) if i != q][:5]
        assert shard.ids[places].tolist() == order and scores.tolist() == exact[order].tolist()


def test_top_k_of_nothing(spark, vectors_schema):
    empty = spark.createDataFrame([], vectors_schema)
    assert maxscore.top_k(empty).count() == 0
    assert maxscore.top_k(spark.createDataFrame([(50, [1.0])], vectors_schema)).count() == 0


# --- SimHash --------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes):
    """The smallest place each place reaches."""
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(codes))]


def test_groups_equal_brute_force(spark, sf_dir, edge_documents):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for docs in (real, edge_documents.where("doc_id is not null")):
        rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
        codes = [plain_fingerprint(t) for _, t in rows]
        want = Counter((rows[i][0], f"{codes[i]:016x}", rows[root][0]) for i, root in enumerate(plain_groups(codes)))
        got = simhash.groups(docs).collect()
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("wanted", [4000, 3])
def test_links_are_exactly_those_within_three_bits(spark, monkeypatch, wanted):
    monkeypatch.setattr(simhash, "BUCKET_FINGERPRINTS", wanted)
    rng = random.Random(7)
    codes = set()
    for _ in range(60):
        code = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            codes.add(code)
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                code ^= 1 << bit
    codes = sorted(codes)
    roots = plain_groups(codes)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"))
    found = {r.node: r.root for r in components(edges).collect()}
    classes = defaultdict(set)
    for code, root in zip(signed, roots):
        classes[root].add(code)
    for members in classes.values():
        assert {found.get(code, code) for code in members} == {min(members)}


def test_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5000, 5000), (7, 8), (8, 7)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_components_run_few_tasks_and_leave_one_table(spark):
    chain = [(i, i + 1) for i in range(200)]
    edges = spark.createDataFrame(chain, "a long, b long").repartition(2)
    context, folder = spark.sparkContext, Path(spark.conf.get("spark.checkpoint.dir"))
    setting = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key, None) for key in setting}
    tables = {path.parent for path in folder.glob("**/_SUCCESS")}
    try:
        for key, value in setting.items():
            spark.conf.set(key, value)
        context.setJobGroup("few-tasks", "components")
        found = components(edges)
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
        assert {r.node: r.root for r in found.collect()} == dict.fromkeys(range(201), 0)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    print("tasks:", tasks)
    assert 0 < tasks < 1_500
    left = {path.parent for path in folder.glob("**/_SUCCESS")} - tables
    assert len(left) == 1


def test_one_row_of_each_group_stays(edge_documents, no_documents):
    kept = simhash.deduplicated(edge_documents)
    assert kept.columns == edge_documents.columns
    rows = kept.collect()
    groups = {r.component_id for r in simhash.groups(edge_documents).collect()}
    assert {r.doc_id for r in rows} == groups and len(rows) == len(groups)
    assert simhash.deduplicated(no_documents).count() == 0 and simhash.groups(no_documents).count() == 0


def plain_shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def test_all_similar_texts_are_found(spark, sf_dir):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 200))]
        for changes in (0, 1, 2, 3, 4, 6):
            other = list(words)
            for place in rng.sample(range(len(words)), changes):
                other[place] = "changed"
            texts.append(" ".join(other))
    texts += ["", None, " ", "one", "One ", "two words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.select(F.xxhash64("text").alias("tie"), "text")
    sets = [plain_shingles(t) for t in texts]
    ties = [r.tie for r in keyed.collect()]
    want = {
        tuple(sorted((ties[i], ties[j])))
        for i in range(len(sets)) for j in range(i)
        if ties[i] != ties[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    }
    assert len(want) > 30
    found = simhash.similar(keyed, 5, 0.8).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    many = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(100)) + f" end{i}") for i in range(90)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, many, sf_dir).collect()] == [0]
    parent = {t: t for t in ties}
    for _ in ties:
        for a, b in want:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert kept == {min(i for i, t in enumerate(ties) if parent[t] == root) for root in set(parent.values())}


def changed(rng, words, times):
    """The words with some replaced, at least five places apart, so that each costs five shingles."""
    words = list(words)
    for place in rng.sample(range(5, len(words) - 5, 6), times):
        words[place] = f"new{rng.randrange(10**9)}"
    return words


def test_recall_by_similarity_and_in_a_crowd(spark):
    rng = random.Random(11)

    def fresh(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    # 196 shingles of which 5 a change differ: similarities of about 0.815, 0.858 and 0.903.
    pairs = [(times, words, changed(rng, words, times)) for times in (4, 3, 2) for words in (fresh(200) for _ in range(60))]
    template = fresh(120)  # about half of each text, so none of the 200 is similar to another one
    crowd = [template + fresh(60) for _ in range(200)]
    copies = [changed(rng, words, 2) for words in crowd[:50]]
    texts = [" ".join(words) for _, *both in pairs for words in both] + [" ".join(words) for words in crowd + copies]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(docs, 5, 0.8).collect()}
    found = Counter()
    for place, (times, one, other) in enumerate(pairs):
        left, right = plain_shingles(" ".join(one)), plain_shingles(" ".join(other))
        assert len(left & right) >= 0.8 * len(left | right) and 2 * place in kept
        found[times] += 2 * place + 1 not in kept
    assert all(found[times] >= 0.9 * 60 for times in (4, 3, 2)), found
    first = 2 * len(pairs)
    assert kept >= set(range(first, first + 200))  # the template alone makes nobody a copy
    assert len(kept & set(range(first + 200, first + 250))) <= 2
    print("found of 60:", dict(found), "of 50 in the crowd:", 50 - len(kept & set(range(first + 200, first + 250))))


def test_pairs_counted_do_not_grow_with_the_square_of_a_crowd(spark, monkeypatch):
    rng = random.Random(17)

    def fresh(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    base = fresh(150)
    family = [changed(rng, base, times) for times in (1, 2, 3, 4) for _ in range(40)]  # to base from 0.93 down to 0.76
    template = fresh(120)
    crowd = [template + fresh(25) for _ in range(150)]  # about 0.7 to each other
    texts = [" ".join(words) for words in [base, *family, *crowd]]
    sets = [plain_shingles(t) for t in texts]
    least = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    counted, plain = [], simhash._counted

    def recorded(pairs, *others):
        counted.append(pairs.count())
        return plain(pairs, *others)

    monkeypatch.setattr(simhash, "_counted", recorded)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(docs, 5, 0.8).collect()} == set(least)
    assert len(set(least)) > 150 and sum(counted) < 5 * len(texts), counted


# --- Mixing ---------------------------------------------------------------------------------


def shared_by_steps(sizes, weights, total):
    """Targets by sharing the excess again and again."""
    targets, open_ = {}, dict(sizes)
    while open_:
        level = total / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > 2 * sizes[s] + 1e-9]
        if not full:
            return targets | {s: level * weights[s] for s in open_}
        for s in full:
            targets[s] = 2 * sizes[s]
            total -= 2 * sizes[s]
            del open_[s]
    return targets


def test_targets_and_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = mixing.mix(docs, ["doc_id", "source"]).select("row.*", "size", "source_size", "target", "copies").collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = shared_by_steps(sizes, weights, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in rows:
        assert r.copies in (0, 1, 2) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source])
        taken[r.source] += r["size"] * r.copies
    assert all(abs(taken[s] - want[s]) < 0.12 * want[s] for s in sizes)
    assert abs(sum(taken.values()) - sum(want.values())) < 0.02 * sum(want.values())
    again = mixing.mix(docs.repartition(13), ["doc_id", "source"]).select("row.doc_id", "copies").collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in again}


def test_mix_on_edge_cases(edge_documents, no_documents):
    mixed = mixing.mix(edge_documents)
    assert mixed.count() == edge_documents.count()
    out = mixing.emitted(mixed)
    assert out.columns == edge_documents.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(no_documents).count() == 0


# --- Pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "byte-level bpe":
            assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4]
    assert len(kept[0] & toxic) <= len(toxic) / 2
    final = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert final == Counter((r.doc_id, r.ids_sha256) for r in docs.collect())


def test_pipeline_on_edge_cases(spark, edge_documents, no_documents, sf_dir):
    for docs in (edge_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            docs = spark.createDataFrame(out.collect(), out.schema)
