"""A Merkle manifest of a table: one root for all rows, and each row's proof that it is part of it.

Rows are leaves, put in order within their group. While a group has several nodes, each run of
``arity`` consecutive nodes becomes one node of the next level, and so on up to the group's root;
the groups' roots, in the order of the groups, make a tree of the same kind up to the root.

Every level is a self-join by equality: a node finds its siblings at indexes computed from its own
(the index with its last bit flipped if the arity is two, slot offsets otherwise), and the node at
slot zero of each run then emits the parent. What a level's join found is written as a table, since
it is read again: on the way down a node's proof is its siblings followed by its parent's proof, handed
to the children by joins on the parent's index. Joins go by tree *and* index, so a group with most
of the rows spreads like any other, and no proof is gathered from a list of all levels.

A proof is the siblings' digests end to end, from the leaf upwards and left to right in each level;
a node alone in its run adds none. Which of them belong to which level follows from the leaf's
index and the number of leaves.

Null values, null ids and null groups are values like others and stand first in their order. Rows
with the same group and id are put in the order of their digests, equal rows stay, each with a
place of its own. One group alone, or a group of one row, has that node as its root without
hashing it again. An empty table has no root and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.llm.tables import written
from creditloom.operators.ordering import with_row_number

DIGEST = 32  # bytes


def text_digest(*values: Column) -> Column:
    """Lower-case hex sha256 of the values, each as its UTF-8 length, a colon and itself, null as a dash."""
    return F.sha2(
        F.concat(
            *[
                F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
                for v in values
            ]
        ),
        256,
    )


def _nothing() -> Column:
    return F.lit(b"")


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _node(*parts: Column) -> Column:
    """The digest of digests end to end, hashed as hex text."""
    return F.unhex(F.sha2(_hex(F.concat(*parts)), 256))


# --- Up: siblings and parents ---------------------------------------------------------------


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``others``, the digests of the node's siblings end to end, left to right."""
    slot = F.pmod("idx", F.lit(arity))
    if arity == 2:
        shifted = nodes.select("tree", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx"), F.col("digest").alias("others"))
        return nodes.join(shifted, ["tree", "idx"], "left").withColumn("others", F.coalesce("others", _nothing()))
    found = nodes
    for offset in range(1, arity):
        meets = F.col("idx") - slot + F.pmod(slot + arity - offset, F.lit(arity))
        shifted = nodes.select("tree", meets.alias("idx"), F.struct(slot.alias("slot"), "digest").alias(f"sibling_{offset}"))
        found = found.join(shifted, ["tree", "idx"], "left")
    siblings = [f"sibling_{offset}" for offset in range(1, arity)]
    in_order = F.array_sort(F.filter(F.array(*siblings), lambda x: x.isNotNull()))
    others = F.aggregate(in_order, _nothing(), lambda all_, x: F.concat(all_, x["digest"]))
    return found.withColumn("others", others).drop(*siblings)


@dataclass
class _Levels:
    """Nodes with siblings by level, and ``tree, height, digest`` of what each tree came to."""

    nodes: list[DataFrame]
    tops: DataFrame


def _climb(leaves: DataFrame, arity: int) -> _Levels:
    """All levels over ``tree, idx, n, digest``; ``n`` is the number of nodes of the tree's level."""
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    tops = leaves.where("n = 1").select("tree", F.lit(0).alias("height"), "digest")
    while largest > 1:
        level = written(_with_siblings(nodes.where("n > 1"), arity))
        levels.append(level)
        parent = F.floor(F.col("idx") / arity)
        nodes = level.where(F.pmod("idx", F.lit(arity)) == 0).select(
            "tree",
            parent.alias("idx"),
            F.ceil(F.col("n") / arity).alias("n"),
            _node(F.col("digest"), F.col("others")).alias("digest"),
        )
        largest = -(-largest // arity)
        tops = tops.union(nodes.where("n = 1").select("tree", F.lit(len(levels)), "digest"))
    return _Levels(levels, written(tops.repartition("tree")))  # a row or none in each of many partitions


# --- Down: proofs ---------------------------------------------------------------------------


def _descend(leaves: DataFrame, levels: _Levels, handed: DataFrame, arity: int) -> DataFrame:
    """The columns of ``leaves``, ``trail`` and the other columns ``handed`` to whole trees.

    ``handed`` has ``tree``, ``height`` and the ``trail`` that each tree's root starts with.
    """
    carried = [name for name in handed.columns if name not in ("tree", "height", "trail")]
    # Heights are as many as a tree has levels; most levels end no tree.
    ends = {row.height for row in handed.select("height").distinct().collect()}
    above = None
    for height in reversed(range(len(levels.nodes))):
        if height + 1 in ends:
            roots = handed.where(F.col("height") == height + 1).select("tree", F.lit(0).cast("long").alias("up"), "trail", *carried)
            above = roots if above is None else above.union(roots)
        nodes = levels.nodes[height].withColumn("up", F.floor(F.col("idx") / arity))
        met = nodes.join(above, ["tree", "up"]).withColumn("trail", F.concat("others", "trail"))
        above = met.select("tree", F.col("idx").alias("up"), "trail", *carried) if height else met.drop("up", "others")
    if 0 not in ends and above is not None:
        return above
    alone = leaves.where("n = 1").join(handed.where("height = 0").drop("height"), "tree")
    return alone if above is None else above.unionByName(alone)


# --- A table's manifest ---------------------------------------------------------------------


@dataclass
class Manifest:
    """``rows``: each row's digest, place and proof. ``root``: hex, None of an empty table.

    ``rows`` has ``key`` (the columns asked for), ``digest``, ``tree`` (the group's place), ``idx``
    and ``n`` (the row's place in the group and the group's rows), ``subroot`` and ``trail`` (the
    proof), digests as binary.
    """

    rows: DataFrame
    root: str | None
    trees: int
    arity: int
    depth: int
    top_depth: int

    def with_folded(self, digest: Column) -> DataFrame:
        """``rows`` with ``folded``, the root in hex that ``digest`` and the row's proof lead to."""
        in_group = _fold(digest, F.lit(1), F.col("idx"), F.col("n"), self.arity, self.depth)
        state = _fold(
            in_group["digest"], in_group["at"], F.col("tree"), F.lit(self.trees).cast("long"), self.arity, self.top_depth
        )
        return self.rows.withColumn("folded", _hex(state["digest"]))


def _fold(digest: Column, at: Column, idx: Column, n: Column, arity: int, depth: int) -> Column:
    start = F.struct(
        digest.alias("digest"), at.cast("int").alias("at"), idx.cast("long").alias("idx"), n.cast("long").alias("n")
    )
    if depth == 0:
        return start

    def step(state: Column, _: Column) -> Column:
        slot = F.pmod(state["idx"], F.lit(arity)).cast("int")
        siblings = (F.least(F.lit(arity), state["n"] - state["idx"] + slot) - 1).cast("int")
        left = F.substr(F.col("trail"), state["at"], slot * DIGEST)
        right = F.substr(F.col("trail"), state["at"] + slot * DIGEST, (siblings - slot) * DIGEST)
        parent = F.struct(
            _node(left, state["digest"], right).alias("digest"),
            (state["at"] + siblings * DIGEST).alias("at"),
            F.floor(state["idx"] / arity).alias("idx"),
            F.ceil(state["n"] / arity).alias("n"),
        )
        return F.when(state["n"] > 1, parent).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)


def _indexed(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Adds ``idx``, counted from 0 within ``groups``."""
    return with_row_number(rows, groups, order, "idx").withColumn("idx", F.col("idx") - 1)


def manifest(rows: DataFrame, group: str, order: str, digest: str, arity: int = 2) -> Manifest:
    """The manifest of ``rows``, leaves being the hex ``digest`` of each, in ``order`` per ``group``.

    All columns of ``rows`` are kept as ``key``; they should be few and narrow.
    """
    narrow = rows.select(
        F.col(group).alias("group"),
        F.col(order).alias("order"),
        F.unhex(digest).alias("digest"),
        F.struct("*").alias("key"),
        # Equal rows have no order of their own; this spreads very many of them over tasks.
        F.monotonically_increasing_id().alias("row"),
    )
    placed = _indexed(narrow, ["group"], ["order", "digest", "row"])
    sizes = placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    trees = written(_indexed(sizes, [], ["group"]).select("group", "n", F.col("idx").alias("tree")))
    named = trees.withColumnRenamed("group", "of")
    leaves = placed.join(named, F.col("group").eqNullSafe(F.col("of"))).select("tree", "idx", "n", "digest", "key")
    levels = _climb(leaves, arity)

    n_trees = trees.count()
    subroots = levels.tops.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"),
        "digest", "height",
    )
    top_levels = _climb(subroots, arity)
    root = top_levels.tops.first()
    whole = top_levels.tops.select("tree", "height", _nothing().alias("trail"))
    handed = _descend(subroots, top_levels, whole, arity).select(
        F.col("idx").alias("tree"), "height", "trail", F.col("digest").alias("subroot")
    )
    return Manifest(
        rows=_descend(leaves, levels, written(handed), arity),
        root=bytes(root.digest).hex() if root else None,
        trees=n_trees,
        arity=arity,
        depth=len(levels.nodes),
        top_depth=len(top_levels.nodes),
    )


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPARED = 7  # ids whose crc32 this divides are the ones a tampering is tried on


def proofs(docs: DataFrame, arity: int = 2) -> DataFrame:
    """Each document's leaf, roots and proof digest, and what folding its possibly forged leaf gives.

    Where ``SPARED`` divides the crc32 of the id, one is added to ``n_chars`` before folding; a null
    id or a null ``n_chars`` leaves the document as it is.
    """
    fields = {name: F.col(name) for name in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % SPARED == 0
    forged = text_digest(*(fields | {"n_chars": F.col("n_chars") + 1}).values())
    leaves = docs.select(
        F.col("doc_id"),
        F.col("lang"),
        text_digest(*fields.values()).alias("leaf"),
        F.when(chosen, F.unhex(forged)).alias("forged"),
    )
    made = manifest(leaves, "lang", "doc_id", "leaf", arity)
    checked = made.with_folded(F.coalesce(F.col("key.forged"), F.col("digest")))
    return checked.select(
        F.col("key.doc_id").alias("doc_id"),
        F.col("key.leaf").alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        F.lit(made.root).cast("string").alias("root"),
        F.sha2(_hex(F.col("trail")), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.lit(made.root)).alias("verified"),
    )
