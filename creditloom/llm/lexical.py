"""Ranked lexical search of many queries at once, sharing common subexpressions.

A query's score of a document is a sum over its terms, so terms that several queries share need to
be summed up only once. The queries of a block are mined for shared term sets: terms held by exactly
the same queries become one set, then two sets that several queries both hold become one larger set,
most shared ones first, until no two are shared. That gives a graph whose leaves are term sets,
whose inner nodes add two others, and whose roots are queries with the nodes they still consist of.

Documents are cut into terms once. For each slice of documents every term set is summed up into a
partial accumulator, every inner node is one addition of two accumulators, level by level, and each
query adds up its few nodes. All of it is exact in 64-bit integers. Each task keeps the best
documents per query; the tasks' best are merged by rank in two steps.

Queries are the stated set: they go in blocks of ``BLOCK``, whose plan is mined in a task and is
bounded by the block, whatever the number of documents. What depends on the corpus (document count,
length, document frequencies of the block's terms) comes from one pass over all documents.

Null and empty texts have no terms: such a document does not count, such a query finds nothing. Each
query row is ranked on its own, also where ids repeat. Among equal scores smaller ids come first, a
null id last; rows with equal ids and scores are interchangeable. No queries or no documents give no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.operators.ordering import numbered
from creditloom.session import materialize

BLOCK = 512  # queries whose shared terms are mined together
NEIGHBOURS = 32  # a set is tried with so many others of its query, in order of frequency
SLICE_BYTES = 1 << 24  # of the accumulators of the documents scored at a time
TASKS = 64  # tasks whose best are merged in the first step

# A term is a run of ASCII letters, digits and any characters beyond ASCII; only A-Z
# change case. In UTF-8, all bytes of a character beyond ASCII are 0x80 or more.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

_FOUND = "query long, doc_id long, score long"
_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
_PLAN = (
    "block long, terms array<binary>, set_starts array<int>, left array<int>, right array<int>, level array<int>,"
    " queries array<long>, query_nodes array<int>, query_starts array<int>"
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


# --- The queries' shared plan ---------------------------------------------------------------


@dataclass
class SharedPlan:
    """Term sets, additions of two nodes, and the nodes each query adds up.

    Nodes are numbered: first the term sets, in the order of ``set_starts`` (places in ``terms``
    where they begin), then the additions ``left + right``, each one level above its parts.
    """

    terms: list[bytes] = field(default_factory=list)
    set_starts: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    queries: list[int] = field(default_factory=list)
    query_nodes: list[int] = field(default_factory=list)
    query_starts: list[int] = field(default_factory=list)


def mine(queries: dict[int, list[bytes]]) -> SharedPlan:
    """The plan of a block of queries, given as their terms with repeats."""
    # The second occurrence of a term in a query is a symbol of its own with the term's value.
    holders: dict[tuple[bytes, int], set[int]] = {}
    for query, terms in queries.items():
        for term, times in Counter(terms).items():
            for time in range(times):
                holders.setdefault((term, time), set()).add(query)
    sets: dict[frozenset[int], list[bytes]] = {}
    for (term, _), held_by in sorted(holders.items()):
        sets.setdefault(frozenset(held_by), []).append(term)
    plan = SharedPlan(queries=sorted(query for query, terms in queries.items() if terms))
    users: list[set[int]] = []
    for held_by, terms in sets.items():
        plan.set_starts.append(len(plan.terms))
        plan.terms += terms
        users.append(set(held_by))
    levels = [0] * len(users)
    while best := _shared_pairs(users, plan.queries):
        least = max(2, best[0][1] // 2)
        for (a, b), _ in best:
            both = users[a] & users[b]
            if len(both) >= least:  # less where an earlier pair took some of them
                plan.left.append(a)
                plan.right.append(b)
                levels.append(1 + max(levels[a], levels[b]))
                users[a] -= both
                users[b] -= both
                users.append(both)
    plan.level = levels[len(sets) :]
    nodes: dict[int, list[int]] = {query: [] for query in plan.queries}
    for node, used_by in enumerate(users):
        for query in used_by:
            nodes[query].append(node)
    for query in plan.queries:
        plan.query_starts.append(len(plan.query_nodes))
        plan.query_nodes += nodes[query]
    return plan


def _shared_pairs(users: list[set[int]], queries: list[int]) -> list[tuple[tuple[int, int], int]]:
    """Pairs of nodes that several queries hold, the most shared ones first, down to half of that."""
    held: dict[int, list[int]] = {query: [] for query in queries}
    for node in sorted((n for n, used_by in enumerate(users) if len(used_by) > 1), key=lambda n: (-len(users[n]), n)):
        for query in users[node]:
            held[query].append(node)
    pairs: Counter[tuple[int, int]] = Counter()
    for nodes in held.values():
        for place, a in enumerate(nodes):
            pairs.update((a, b) if a < b else (b, a) for b in nodes[place + 1 : place + 1 + NEIGHBOURS])
    most = max(pairs.values(), default=0)
    chosen = [(pair, times) for pair, times in pairs.items() if times >= max(2, most // 2)]
    return sorted(chosen, key=lambda x: (-x[1], x[0]))


def plans(queries: DataFrame) -> DataFrame:
    """The plan of each block of ``block, query, text``, one row a block."""

    def mined(pdf: pd.DataFrame) -> pd.DataFrame:
        plan = mine({query: terms_of(text) for query, text in zip(pdf["query"].tolist(), pdf["text"])})
        return pd.DataFrame([{"block": pdf["block"].iloc[0], **vars(plan)}])

    return queries.groupBy("block").applyInPandas(mined, _PLAN)


# --- Documents ------------------------------------------------------------------------------


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id``, the number ``n`` of terms, and which of the distinct ``terms`` occur how often.

    Documents without any term are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {term: place for place, term in enumerate(terms)}
        for batch in batches:
            kept, sizes, found, counts, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column("text")):
                own = terms_of(text.as_py())
                if own:
                    at = np.fromiter(map(places.get, own, repeat(-1)), np.int32, len(own))
                    known, times = np.unique(at[at >= 0], return_counts=True)
                    kept.append(row)
                    sizes.append(len(own))
                    found.append(known)
                    counts.append(times.astype(np.int32))
                    ends.append(ends[-1] + len(known))
            if not kept:
                continue
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(kept)),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found), pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts), pa.int32())),
                ],
                ["doc_id", "n", "terms", "counts"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, _POSTINGS)


@dataclass
class Corpus:
    """What scores need of all documents: how many, their terms, and each term's weight."""

    documents: int
    length: int
    weights: np.ndarray


def corpus(posted: DataFrame, n_terms: int) -> Corpus:
    totals = posted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    held = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(2 * totals.documents + 2).cast("double") / (2 * F.col("df") + 1)
    weights = np.zeros(n_terms, np.int64)
    for row in held.select("term", F.floor(1000 * F.log(ratio)).alias("weight")).collect():  # the block's terms
        weights[row.term] = row.weight
    return Corpus(totals.documents, totals.length or 0, weights)


class Accumulators:
    """Scores slices of documents for all queries of a plan."""

    def __init__(self, plan: SharedPlan, places: np.ndarray, weights: np.ndarray, whole: Corpus):
        self._whole, self._weights = whole, weights
        # ``places`` are the plan's symbols among the distinct terms; their rows are per symbol.
        self._symbols = places
        self._set_starts = np.array(plan.set_starts, np.int64)
        self._sets = len(plan.set_starts)
        self._nodes = self._sets + len(plan.left)
        left, right, level = (np.array(x, np.int64) for x in (plan.left, plan.right, plan.level))
        self._levels = []
        for height in np.unique(level):
            own = np.flatnonzero(level == height)
            self._levels.append((self._sets + own, left[own], right[own]))
        self._query_nodes = np.array(plan.query_nodes, np.int64)
        self._query_starts = np.array(plan.query_starts, np.int64)
        width = 8 * (len(weights) + len(places) + self._nodes + len(self._query_nodes) + 1)
        self.slice = max(1, SLICE_BYTES // width)

    def scores(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Scores by query and document; the postings of all documents lie end to end."""
        whole = self._whole
        lengths = 100 - 25 + (25 * sizes * whole.documents) // whole.length
        tf = counts.astype(np.int64)
        parts = np.zeros((len(self._weights), len(sizes)), np.int64)
        parts[terms, owners] = self._weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * lengths[owners]))
        nodes = np.empty((self._nodes, len(sizes)), np.int64)
        nodes[: self._sets] = np.add.reduceat(parts[self._symbols], self._set_starts, axis=0)
        for own, left, right in self._levels:
            nodes[own] = nodes[left] + nodes[right]
        return np.add.reduceat(nodes[self._query_nodes], self._query_starts, axis=0)


class _Best:
    """The ``k`` best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self._k = k
        self._least = np.ones(queries, np.int64)  # a score below cannot enter
        self.query = self.score = self.ids = np.zeros(0, np.int64)
        self.named = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        least = self._least
        if scores.shape[1] > self._k:
            least = np.maximum(least, np.partition(scores, -self._k, axis=1)[:, -self._k])
        query, column = np.nonzero(scores >= least[:, None])
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, scores[query[len(self.query) :], column]])
        found, known = np.concatenate([self.ids, ids[column]]), np.concatenate([self.named, named[column]])
        order = np.lexsort((found, ~known, -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        best = order[rank < self._k]
        full = order[rank == self._k - 1]
        self.score, self.ids, self.named = score[best], found[best], known[best]
        self.query = query[rank < self._k]
        self._least[query[rank == self._k - 1]] = score[full]


def _block_best(docs: DataFrame, plan: SharedPlan, k: int) -> DataFrame:
    """The best documents of every query of one block, with some that the merge leaves out."""
    distinct = sorted(set(plan.terms))
    spots = {term: place for place, term in enumerate(distinct)}
    places = np.array([spots[term] for term in plan.terms], np.int64)
    posted = materialize(postings(docs, distinct))
    whole = corpus(posted, len(distinct))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accumulators = Accumulators(plan, places, whole.weights, whole)
        best = _Best(len(plan.queries), k)
        for batch in batches:
            for first in range(0, batch.num_rows, accumulators.slice):
                part = batch.slice(first, accumulators.slice)
                ids, terms, counts = part.column("doc_id"), part.column("terms"), part.column("counts")
                held = np.diff(terms.offsets.to_numpy())
                scores = accumulators.scores(
                    part.column("n").to_numpy(),
                    terms.flatten().to_numpy(),
                    counts.flatten().to_numpy(),
                    np.repeat(np.arange(part.num_rows), held),
                )
                best.add(scores, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(plan.queries, np.int64)[best.query], pa.int64()),
                pa.array(best.ids, pa.int64(), mask=~best.named),
                pa.array(best.score, pa.int64()),
            ],
            ["query", "doc_id", "score"],
        )

    return posted.mapInArrow(rows, _FOUND)


def search(docs: DataFrame, queries: DataFrame, query_id: str, k: int) -> DataFrame:
    """``query_id, rank, doc_id, score`` of the ``k`` best documents with a score, for each row of queries."""
    stated = numbered(queries.select(F.col(query_id).alias("named"), "text"), [], "query")
    blocked = stated.withColumn("block", F.floor((F.col("query") - 1) / BLOCK))
    planned = materialize(plans(blocked))
    found = docs.sparkSession.createDataFrame([], _FOUND)
    blocks = planned.agg(F.max("block")).first()[0]
    for block in range(0 if blocks is None else blocks + 1):
        row = planned.where(F.col("block") == block).first().asDict()
        row.pop("block")
        plan = SharedPlan(**row | {"terms": [bytes(term) for term in row["terms"]]})
        if plan.queries:
            found = found.union(_block_best(docs, plan, k))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("tasks", F.floor(F.spark_partition_id() / TASKS))
    merged = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "tasks").orderBy(*order)))
    ranked = merged.where(F.col("rank") <= k).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))
    )
    return (
        ranked.where(F.col("rank") <= k)
        .join(stated.select("query", "named"), "query")
        .select(F.col("named").alias(query_id), "rank", "doc_id", "score")
    )
