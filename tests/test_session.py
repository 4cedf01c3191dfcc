from __future__ import annotations

import contextlib
import os
import random
import time

from pyspark.sql import functions as F

from creditloom.llm import simhash
from creditloom.session import materialize

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_bytes(spark):
    """What lies in shuffle data files below the session's local folders."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = [os.path.join(top, f) for folder in folders for top, _, files in os.walk(folder) for f in files]
    sizes = {}
    for path in found:
        if os.path.basename(path).startswith("shuffle_"):
            with contextlib.suppress(FileNotFoundError):  # a file may go meanwhile
                sizes[path] = os.path.getsize(path)
    return sizes


def left_over(spark, before, allowed=0):
    """Bytes of shuffle files that came after ``before`` and stay; Spark removes files in the background."""
    for _ in range(50):
        left = sum(size for path, size in shuffle_bytes(spark).items() if path not in before)
        if left <= allowed:
            break
        time.sleep(0.1)
    return left


def test_shuffles_go_once_their_rows_are_written(spark):
    rows = spark.range(20_000).select((F.col("id") % 5_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    grouped = rows.groupBy("k").agg(F.max("v").alias("v"), F.count("*").alias("n"))
    joined = grouped.toDF("k", "most", "n").join(rows.hint("merge"), "k")
    want = sorted(map(tuple, joined.select("*").collect()))
    setting = spark.conf.get(CLEANUP, None)
    before = shuffle_bytes(spark)
    fixed = materialize(joined, drop_shuffles=True)
    assert left_over(spark, before) == 0
    assert spark.conf.get(CLEANUP, None) == setting
    assert fixed.dtypes == joined.dtypes
    assert sorted(map(tuple, fixed.collect())) == want
    assert sorted(map(tuple, joined.collect())) == want  # may still be run on its own


def test_near_duplicates_leave_no_shuffled_sets(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(100)]
    texts += [text.rsplit(" ", 1)[0] + f" end{i}" for i, text in enumerate(texts)]
    keyed = spark.createDataFrame(list(enumerate(texts)), "tie long, text string")
    before, left, plain = shuffle_bytes(spark), [], simhash.components

    def recorded(links):
        left.append(left_over(spark, before, 50_000))
        return plain(links)

    monkeypatch.setattr(simhash, "components", recorded)
    roots = {r.tie: r.root for r in simhash.classes(keyed, 5, 0.8).collect()}
    assert roots == {i: i % 100 for i in range(200)}
    # Texts and sets are in shuffles before; the sets alone hold 200 * 296 * 8 bytes of hashes.
    assert left[0] < 50_000, left
