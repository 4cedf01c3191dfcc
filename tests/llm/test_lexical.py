from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from creditloom.llm import lexical
from tests.llm.conftest import DOCUMENTS

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def brute_force(docs, items, k=20):
    held = [(doc_id, plain_terms(text)) for doc_id, text in docs]
    held = [(doc_id, Counter(terms), len(terms)) for doc_id, terms in held if terms]
    count, length = len(held), sum(n for _, _, n in held)
    frequency = Counter(term for _, counts, _ in held for term in counts)
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) for t, df in frequency.items()}
    found = []
    for item_id, text in items:
        terms = plain_terms(text)
        scored = []
        for doc_id, counts, n in held:
            m = 100 - 25 + (25 * n * count) // length
            score = sum(
                weight[t] * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in terms if t in counts
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, unnamed, doc_id) in enumerate(sorted(scored)[:k], 1):
            found.append((item_id, rank, None if unnamed else doc_id, -score))
    return found


def key(row):
    return tuple(-1 if value is None else value for value in row)


def same(docs, items, k=20):
    found = lexical.search(docs, items, "item_id", k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(row) for row in found.collect()]
    plain = brute_force(
        [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()],
        [(r.item_id, r.text) for r in items.collect()],
        k,
    )
    assert sorted(rows, key=key) == sorted(plain, key=key)
    return rows


def expanded(plan):
    """Each query's terms with repeats, by following the plan's graph."""
    ends = [*plan.set_starts[1:], len(plan.terms)]
    nodes = [Counter(plan.terms[a:b]) for a, b in zip(plan.set_starts, ends)]
    for left, right in zip(plan.left, plan.right):
        nodes.append(nodes[left] + nodes[right])
    ends = [*plan.query_starts[1:], len(plan.query_nodes)]
    return {
        query: sum((nodes[node] for node in plan.query_nodes[a:b]), Counter())
        for query, a, b in zip(plan.queries, plan.query_starts, ends)
    }


def test_terms_are_those_of_the_pattern():
    draw = random.Random(3)
    signs = [chr(c) for c in range(0x80)] + ["É", "é", " ", "日", "🎉", "İ", " "]
    for _ in range(2_000):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(30)))
        assert [term.decode() for term in lexical.terms_of(text)] == plain_terms(text)


def test_a_plan_adds_up_every_query_with_fewer_additions():
    draw = random.Random(11)
    common = [f"c{i}".encode() for i in range(40)]
    passages = [draw.sample(common, 12) for _ in range(6)]
    queries = {}
    for query in range(60):
        terms = [t for p in draw.sample(passages, 2) for t in p]
        queries[query] = terms + [draw.choice(common) for _ in range(4)] + [f"own{query}".encode()]
    queries[60], queries[61] = [], [b"c1"] * 5
    plan = lexical.mine(queries)
    assert expanded(plan) == {query: Counter(terms) for query, terms in queries.items() if terms}
    additions = len(plan.terms) + len(plan.left) + len(plan.query_nodes)
    assert additions < sum(map(len, queries.values())) / 2
    assert all(plan.level[i] >= 1 for i in range(len(plan.left)))


def test_no_shared_pair_of_frequent_nodes_is_left():
    queries = {q: [f"t{(q * k) % 17}".encode() for k in range(1, 8)] for q in range(30)}
    plan = lexical.mine(queries)
    ends = [*plan.query_starts[1:], len(plan.query_nodes)]
    held = [set(plan.query_nodes[a:b]) for a, b in zip(plan.query_starts, ends)]
    assert max(len(x & y) for i, x in enumerate(held) for y in held[:i]) < 2


def test_accumulators_in_slices_equal_one_slice(monkeypatch):
    plan = lexical.mine({0: [b"a", b"b", b"a"], 1: [b"b", b"c"], 2: [b"a", b"b", b"c", b"d"]})
    distinct = sorted(set(plan.terms))
    places = np.array([distinct.index(t) for t in plan.terms])
    whole = lexical.Corpus(9, 90, np.array([5, 7, 11, 13]))
    terms, counts, owners = np.array([0, 1, 3, 2, 0]), np.array([2, 1, 1, 4, 1], np.int32), np.array([0, 0, 1, 2, 2])
    sizes = np.array([10, 3, 77])
    scorer = lexical.Accumulators(plan, places, whole.weights, whole)
    at_once = scorer.scores(sizes, terms, counts, owners)
    for doc in range(3):
        own = owners == doc
        alone = scorer.scores(sizes[doc : doc + 1], terms[own], counts[own], owners[own] - doc)
        assert (alone[:, 0] == at_once[:, doc]).all()
    monkeypatch.setattr(lexical, "SLICE_BYTES", 1)
    assert lexical.Accumulators(plan, places, whole.weights, whole).slice == 1


def test_edge_documents_and_items(spark, edge_documents):
    items = [
        (1, "the SAME text"), (1, "the SAME text"), (2, None), (3, ""), (4, "!!! ---"), (None, "one id"),
        (5, "ha ha words日本語 É ñ"), (6, "nowhere to be found zzz"), (7, "x" * 3000 + " long end"),
    ]
    found = same(edge_documents, spark.createDataFrame(items, ITEMS), k=3)
    assert {row[0] for row in found} == {1, None, 5, 7}


def test_ties_go_to_smaller_ids_and_copies_all_rank(spark):
    rows = [(i % 40, "equal words here", "en", "s", 1) for i in range(90)] + [(i, f"other {i}", "en", "s", 1) for i in range(30)]
    found = same(spark.createDataFrame(rows, DOCUMENTS).repartition(7), spark.createDataFrame([(1, "words")], ITEMS))
    assert [row[2] for row in sorted(found, key=lambda r: r[1])][:4] == [0, 0, 0, 1]


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_of_queries_change_nothing(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(3 * block)
    same(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.createDataFrame(items.collect(), items.schema))


def test_more_tasks_than_the_first_merge_takes(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lexical, "TASKS", 2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(11)
    same(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def test_without_documents_or_items(spark, sf_dir, no_documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert lexical.search(no_documents, items, "item_id", 20).collect() == []
    assert lexical.search(docs, items.where("false"), "item_id", 20).collect() == []
    assert lexical.search(docs.where("doc_id < 0"), items, "item_id", 20).collect() == []
