from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from creditloom.plans import training
from creditloom.sources import files, revisions

SCHEMA = "name string"


def added(spark, name):
    return lambda rows: rows.union(spark.createDataFrame([(name,)], SCHEMA))


def names(spark, path, number=None):
    return sorted(row[0] for row in revisions.read_revision(spark, path, SCHEMA, number).collect())


def test_a_file_is_put_once(spark, tmp_path):
    path = f"{tmp_path}/new/one"
    assert files.put_if_absent(spark, path, "é")
    assert not files.put_if_absent(spark, path, "other")
    assert files.read_text(spark, path) == "é"
    assert files.names_in(spark, f"{tmp_path}/new") == ["one"]
    assert files.names_in(spark, f"{tmp_path}/none") == []
    files.delete(spark, path)
    assert files.put_if_absent(spark, path, "")


def test_revisions_are_numbered_and_stay(spark, tmp_path):
    path = str(tmp_path)
    assert names(spark, path) == []
    assert [revisions.commit(spark, path, SCHEMA, added(spark, n)) for n in "abc"] == [1, 2, 3]
    assert names(spark, path) == ["a", "b", "c"]
    assert names(spark, path, 2) == ["a", "b"]


def test_a_writer_that_was_overtaken_takes_in_the_newer_revision(spark, tmp_path):
    path = str(tmp_path)
    tries = []

    def overtaken(rows):
        if not tries:  # another writer commits between our reading and our commit
            revisions.commit(spark, path, SCHEMA, added(spark, "other"))
        tries.append(len(rows.collect()))
        return added(spark, "own")(rows)

    assert revisions.commit(spark, path, SCHEMA, overtaken) == 2
    assert tries == [0, 1]
    assert names(spark, path) == ["other", "own"]
    # The refused rows are gone: one folder per revision and the log.
    assert len([p for p in Path(path).iterdir() if p.is_dir()]) == 3


def test_writers_at_once_all_land(spark, tmp_path):
    path, errors = str(tmp_path), []

    def write(name):
        try:
            revisions.commit(spark, path, SCHEMA, added(spark, name))
        except Exception as error:  # handed to the test
            errors.append(error)

    threads = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(5)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert not errors
    assert names(spark, path) == [f"w{i}" for i in range(5)]
    assert revisions.revisions(spark, path) == [1, 2, 3, 4, 5]


def test_a_change_that_fails_commits_nothing(spark, tmp_path):
    path = str(tmp_path)
    revisions.commit(spark, path, SCHEMA, added(spark, "a"))
    broken = F.raise_error(F.lit("broken")).cast("string").alias("name")
    with pytest.raises(Exception, match="broken"):
        revisions.commit(spark, path, SCHEMA, lambda rows: rows.select(broken))
    assert names(spark, path) == ["a"]


def test_versions_that_are_saved_registered_or_claimed_are_not_given_again(spark, tmp_path):
    root = str(tmp_path)
    assert training.claim_version(spark, root, "m") == "m_v1"
    assert training.claim_version(spark, root, "m") == "m_v2"  # the first is still under way
    Path(root, "artifacts", "m_v3").mkdir(parents=True)  # saved, but lost from the registry
    assert training.claim_version(spark, root, "m") == "m_v4"
    blank = spark.createDataFrame([], training.REGISTRY_SCHEMA)
    row = spark.range(1).select(F.lit("m_v5").alias("model_version"))
    revisions.save_revision(
        blank.unionByName(row, allowMissingColumns=True), f"{root}/registry"
    )
    assert training.claim_version(spark, root, "m") == "m_v6"
    assert training.claim_version(spark, root, "other") == "other_v1"
