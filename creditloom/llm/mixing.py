"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words to take, by weight, but at most ``MOST`` times its own
size; what is above that is shared again among the others. Every document of a source is expected
to be taken ``target / size`` times. The expected copies are summed up in order of document size,
one random offset is added, and a document is emitted once per whole number its interval crosses.
Ordered by size, neighbours can stand in for each other, so the words taken come near the target.
In a source of few documents the largest ones still weigh; so its offset is the one of ``DRAWS``
random ones whose words come nearest.

Equal sizes are ordered by ``doc_id`` (null last) and a hash of the text, so reruns agree on any
partitioning. A null text has no words; a source without words takes nothing. A null source is a
source of its own, ordered last. Repeated rows are separate documents. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.tables import words
from creditloom.session import materialize

# Parameters.
WEIGHTS = (5, 2, 1)  # of the sources in order, repeating
SHARE = 1.5  # of all words
MOST = 2  # times a source's size
SEED = 8
DRAWS = 16  # random offsets to choose from

_LOCAL_BITS = 33  # of monotonically_increasing_id


def sizes(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` and expected copies ``rate`` for rows ``source, source_size``, one a source.

    Sharing the excess again and again ends at one level: every source takes its weight times the
    level or its ceiling, whichever is less. Sources reach their ceilings in order of ceiling by
    weight, so the level is found by sums along that order.
    """
    everything = Window.partitionBy(F.lit(0))  # one row per source
    place = F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")) - 1
    weighed = by_source.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double").alias("weight"),
        (most * F.col("source_size")).cast("double").alias("ceiling"),
        (share * F.sum("source_size").over(everything)).alias("wanted"),
    )
    order = everything.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    stepped = weighed.withColumn("level", (F.col("wanted") - full) / open_)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level").alias("level")))
    levelled = stepped.withColumn("found", F.min(fits).over(everything)["level"])
    target = F.coalesce(F.least(F.col("found") * F.col("weight"), F.col("ceiling")), F.col("ceiling"))
    return levelled.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def offset(source: Column, draw: int, seed: int = SEED) -> Column:
    """A random offset of a source: a multiple of 2^-20 in [0, 1) from a hash of its name."""
    named = F.concat(F.lit(f"{seed}|{draw}|"), F.coalesce(source, F.lit("\0")))
    return F.conv(F.substring(F.md5(named), 1, 5), 16, 10).cast("double") / (1 << 20)


def mix(
    docs: DataFrame,
    columns: list[str] | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """Rows ``row``, ``size``, ``source_size``, ``target``, ``copies``.

    ``row`` holds the document's ``columns`` (all, if not given) as a struct; only those travel.

    A source may hold a third of all rows: documents are spread by source and size over all
    partitions, and what earlier partitions of a source hold comes from a table with one row per
    source and partition.
    """
    measured = docs.select(
        F.col("source").alias("source"),
        sizes(F.col("text")).alias("size"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id").alias("name"),
        F.xxhash64("text").alias("tie"),
        F.struct(*(columns or ["*"])).alias("row"),
    )
    order = ["source", F.desc("size"), "unnamed", "name", "tie"]
    placed = materialize(
        measured.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("source", "size", "row", F.monotonically_increasing_id().alias("at"))
        .withColumn("part", F.shiftright("at", _LOCAL_BITS))
    )
    runs = placed.groupBy("source", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("at").alias("first")
    )
    shares = targets(runs.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "source", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    known = _with(_with(placed, runs, "source", "part"), shares, "source")
    # Every document of a source has the same expectation, so the prefix sum is a multiple of it.
    numbered = known.withColumn("number", F.col("before") + F.col("at") - F.col("first"))

    def copies(shift: Column) -> Column:
        upper = F.floor((F.col("number") + 1) * F.col("rate") + shift)
        return upper - F.floor(F.col("number") * F.col("rate") + shift)

    taken = numbered.groupBy("source").agg(
        F.first("target").alias("wanted"),
        *[F.sum(F.col("size") * copies(offset(F.col("source"), i, seed))).alias(f"taken_{i}") for i in range(DRAWS)],
    )
    misses = F.array(
        *[
            F.struct(F.abs(F.col(f"taken_{i}") - F.col("wanted")).alias("miss"), offset(F.col("source"), i, seed).alias("shift"))
            for i in range(DRAWS)
        ]
    )
    shifts = taken.select("source", F.array_min(misses)["shift"].alias("shift"))
    return _with(numbered, shifts, "source").select(
        "row", "size", "source_size", "target", copies(F.col("shift")).cast("int").alias("copies")
    )


def _with(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Add the columns of ``right``, whose keys are unique and may be null."""
    named = right.withColumnsRenamed({key: f"_{key}" for key in keys})
    same = F.lit(True)
    for key in keys:
        same &= left[key].eqNullSafe(named[f"_{key}"])
    return left.join(named, same).drop(*[f"_{key}" for key in keys])


def emitted(mixed: DataFrame) -> DataFrame:
    """The documents themselves, each as often as it was taken."""
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
