"""Exact quantiles with linear interpolation, without bringing a column's values together.

Spark's ``percentile`` keeps every distinct value of a group in one task. The two operators here
find the same numbers from counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.functions.scores import number_or_null, right_closed_index
from creditloom.operators.ordering import with_running_totals
from creditloom.session import materialize

SKETCH_ACCURACY = 10_000


def even_fractions(parts: int) -> list[Fraction]:
    """0, 1/parts, …, 1."""
    return [Fraction(i, parts) for i in range(parts + 1)]


def _place(fraction: Fraction, rows: int) -> tuple[int, int, float]:
    """The two zero-based ranks around a quantile and the weight of the upper one."""
    low, rest = divmod(fraction.numerator * (rows - 1), fraction.denominator)
    return low, low + (rest > 0), rest / fraction.denominator


@dataclass
class _Column:
    """What the first reading of a column tells: its rows and cut points around each quantile."""

    rows: int
    cuts: list[float]
    near: set[int]  # the open intervals between the cut points of one quantile

    def part(self, value: Column) -> Column:
        """Odd numbers are the cut points themselves, even ones the open intervals below them."""
        at_cut = F.when(value.isin(self.cuts), 1).otherwise(0)
        return 2 * right_closed_index(value, self.cuts) + at_cut


def _sketched(values: DataFrame, fractions: Sequence[Fraction]) -> dict[str, _Column]:
    """First reading: counts, and a sketch that gives cut points on both sides of every quantile."""
    margin = 2 / SKETCH_ACCURACY
    around = [[min(max(float(f) + d, 0.0), 1.0) for d in (-margin, margin)] for f in fractions]
    places = sorted({place for pair in around for place in pair})
    sketches = [F.percentile_approx(name, places, SKETCH_ACCURACY).alias(f"c_{name}") for name in values.columns]
    counts = [F.count(name).alias(f"n_{name}") for name in values.columns]
    row = values.agg(*counts, *sketches).first()
    found = {}
    for name in values.columns:
        if not row[f"n_{name}"]:
            continue
        at = dict(zip(places, row[f"c_{name}"]))
        cuts = sorted(set(at.values()))
        near = {2 * i for low, high in around for i in range(cuts.index(at[low]) + 1, cuts.index(at[high]) + 1)}
        found[name] = _Column(row[f"n_{name}"], cuts, near)
    return found


def _counted(values: DataFrame, columns: Mapping[str, _Column]) -> DataFrame:
    """Second reading: ``name, part, value, rows``; the value is null outside the near intervals."""
    entries = []
    for name, column in columns.items():
        value, part = F.col(name), column.part(F.col(name))
        kept = F.when(part.isin(sorted(column.near)), value) if column.near else F.lit(None).cast("double")
        fields = F.struct(F.lit(name).alias("name"), part.alias("part"), kept.alias("value"))
        entries.append(F.when(value.isNotNull(), fields))
    return (
        values.select(F.inline(F.array_compact(F.array(*entries))))
        .groupBy("name", "part", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _ranked(
    values: DataFrame, columns: Mapping[str, _Column], ranks: Mapping[str, Sequence[int]]
) -> dict[tuple[str, int], float]:
    """Values at the given ranks of each column, in one reading.

    Rows are counted by part, and by value in the near intervals, where the sketch says that the
    wanted ranks are. A rank at a cut point is known by then; for the others the values of their
    interval are ordered. Should a rank lie elsewhere, its interval is read as well: the sketch
    decides how much is ordered, never the result.
    """
    collapsed = materialize(_counted(values, columns))
    counts = {
        (row["name"], row["part"]): row["rows"]
        for row in collapsed.groupBy("name", "part").agg(F.sum("rows").alias("rows")).collect()
    }
    found, targets, missed = {}, [], {}
    for name, wanted in ranks.items():
        column, before = columns[name], 0
        for part in range(2 * len(column.cuts) + 1):
            size = counts.get((name, part), 0)
            for rank in (r for r in wanted if before <= r < before + size):
                if part % 2:
                    found[(name, rank)] = column.cuts[part // 2]
                elif part in column.near:
                    targets.append((name, part, rank, rank - before))
                else:
                    missed.setdefault(name, set()).add(part)
            before += size
    if missed:
        wider = {n: replace(c, near=c.near | missed.get(n, set())) for n, c in columns.items()}
        return _ranked(values, wider, ranks)
    if not targets:
        return found
    # One row per column and wanted rank.
    wanted_ranks = values.sparkSession.createDataFrame(
        targets, "name string, part int, rank long, local long"
    )
    inside = (F.col("rows_before") <= F.col("local")) & (
        F.col("local") < F.col("rows_before") + F.col("rows")
    )
    near = collapsed.join(F.broadcast(wanted_ranks.select("name", "part")), ["name", "part"], "left_semi")
    picked = (
        with_running_totals(near, ["name", "part"], "value", ["rows"])
        .join(F.broadcast(wanted_ranks), ["name", "part"])
        .where(inside)
    )
    return found | {
        (row["name"], row["rank"]): row["value"]
        for row in picked.select("name", "rank", "value").collect()
    }


def column_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    fractions: Sequence[Fraction],
) -> dict[str, list[float] | None]:
    """Quantiles of several numeric columns; null and NaN are left out, no values gives None.

    Only counts and the found values reach the driver: columns × quantiles numbers. ``df`` is
    read twice, the wanted columns only: persist it when it is an expensive plan.
    """
    if not columns or not fractions:
        return {name: None for name in columns}
    labels = {f"v{i}": label for i, label in enumerate(columns)}
    values = df.select(*[number_or_null(columns[label]).alias(n) for n, label in labels.items()])
    sketched = _sketched(values, fractions)
    ranks = {
        name: sorted({rank for f in fractions for rank in _place(f, column.rows)[:2]})
        for name, column in sketched.items()
    }
    found = _ranked(values, sketched, ranks) if ranks else {}

    result: dict[str, list[float] | None] = {}
    for name, label in labels.items():
        if name not in sketched:
            result[label] = None
            continue
        result[label] = []
        for fraction in fractions:
            low, high, weight = _place(fraction, sketched[name].rows)
            lower, upper = found[(name, low)], found[(name, high)]
            result[label].append(lower if lower == upper else lower + (upper - lower) * weight)
    return result


def group_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: Column,
    fractions: Mapping[str, Fraction],
    rows: Column | None = None,
) -> DataFrame:
    """One row per group with the named quantiles of ``value``; null and NaN are left out.

    ``rows`` weighs pre-aggregated input.
    """
    weight = F.lit(1) if rows is None else rows
    collapsed = (
        df.select(*groups, number_or_null(value).alias("value"), weight.alias("rows"))
        .where(F.col("value").isNotNull())
        .groupBy(*groups, "value")
        .agg(F.sum("rows").alias("rows"))
    )
    placed = with_running_totals(collapsed, groups, "value", ["rows"])
    picks = []
    for i, fraction in enumerate(fractions.values()):
        over = f"(rows_total - 1) * {fraction.numerator}L"
        low = F.expr(f"({over}) div {fraction.denominator}L")
        rest = F.expr(f"({over}) % {fraction.denominator}L")
        high = low + (rest > 0).cast("long")

        def holds(rank: Column) -> Column:
            return (F.col("rows_before") <= rank) & (rank < F.col("rows_before") + F.col("rows"))

        picks += [
            F.max(F.when(holds(low), F.col("value"))).alias(f"__low{i}"),
            F.max(F.when(holds(high), F.col("value"))).alias(f"__high{i}"),
            F.max(rest / F.lit(float(fraction.denominator))).alias(f"__weight{i}"),
        ]
    wide = placed.groupBy(*groups).agg(*picks)
    columns = []
    for i, name in enumerate(fractions):
        low, high, weight = (F.col(f"__{part}{i}") for part in ("low", "high", "weight"))
        columns.append(F.when(low == high, low).otherwise(low + (high - low) * weight).alias(name))
    return wide.select(*groups, *columns)
