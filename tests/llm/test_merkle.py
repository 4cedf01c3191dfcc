from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from creditloom.llm import merkle


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict) -> str:
    values = ["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS]
    return digest(*values)


def climb(digests: list[str], arity: int) -> tuple[str, list[list[str]], list[list[tuple[int, list[str]]]]]:
    """The root, and for each leaf its path: slot and siblings of each level."""
    paths = [[] for _ in digests]
    level, owners = list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        up, up_owners = [], []
        for first in range(0, len(level), arity):
            run = level[first : first + arity]
            for slot, members in enumerate(owners[first : first + arity]):
                for member in members:
                    paths[member].append((slot, run[:slot] + run[slot + 1 :]))
            up.append(digest(*run))
            up_owners.append([m for members in owners[first : first + arity] for m in members])
        level, owners = up, up_owners
    return level[0], paths


def brute_force(rows: list[dict], arity: int = 2) -> list[tuple]:
    groups: dict = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    made = []
    for name in names:
        members = sorted(
            groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))
        )
        made.append((members, *climb([leaf_of(r) for r in members], arity)))
    if not made:
        return []
    root, tops = climb([subroot for _, subroot, _ in made], arity)
    found = []
    for (members, subroot, paths), top in zip(made, tops):
        for row, path in zip(members, paths):
            node = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None:
                node["n_chars"] += 1
            folded = leaf_of(node)
            for slot, others in path + top:
                folded = digest(*others[:slot], folded, *others[slot:])
            proof = digest(*[other for _, others in path + top for other in others])
            found.append((row["doc_id"], leaf_of(row), subroot, root, proof, folded, folded == root))
    return found


def key(row):
    return tuple("" if value is None else str(value) for value in row)


def same(docs, arity=2):
    rows = [row.asDict() for row in docs.select(*merkle.FIELDS).collect()]
    found = [tuple(row) for row in merkle.proofs(docs, arity).collect()]
    assert sorted(found, key=key) == sorted(brute_force(rows, arity), key=key)
    return found


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_edge_rows_equal_plain_trees(edge_documents, arity):
    docs = edge_documents.withColumn("lang", F.expr("CASE WHEN doc_id % 5 = 0 THEN 'es' WHEN doc_id = 7 THEN 'é' ELSE lang END"))
    found = same(docs, arity)
    assert len(found) == docs.count()
    assert merkle.proofs(docs, arity).columns == COLUMNS


def test_forged_rows_and_no_others_fail(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for row in same(docs):
        assert row[-1] == (zlib.crc32(str(row[0]).encode()) % 7 != 0)


def test_one_row_is_its_own_root(spark, edge_documents):
    one = edge_documents.where("doc_id = 4")
    (row,) = same(one)
    assert row[1] == row[2] == row[3] and row[4] == digest("")


def test_one_group_and_groups_of_one(spark, edge_documents):
    same(edge_documents.withColumn("lang", F.lit("x")))
    same(edge_documents.where("doc_id < 9").withColumn("lang", F.col("doc_id").cast("string")))


def test_no_rows(no_documents):
    assert merkle.proofs(no_documents).collect() == []


def test_a_manifest_verifies_any_leaf_and_keeps_other_columns(spark):
    rows = spark.range(11).select(
        (F.col("id") % 3).alias("shard"), F.col("id").alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("sum"),
        F.lit("kept").alias("trail"),
    )
    made = merkle.manifest(rows, "shard", "file", "sum", arity=4)
    good = made.with_folded(F.col("digest")).select("key.*", "folded").collect()
    bad = made.with_folded(F.unhex(F.sha2(F.lit("other"), 256))).select("key.*", "folded").collect()
    assert len(good) == len(bad) == 11
    assert all(row.folded == made.root and row.trail == "kept" for row in good)
    assert all(row.folded != made.root for row in bad)
