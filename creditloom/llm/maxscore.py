"""Exact top-k inner products by MaxScore over sharded postings.

A vector is a document whose terms are its components. In a shard, a term's postings are the
vectors with a component of the query's sign there, and its bound is the largest product the shard
can give it. Terms with small bounds are non-essential: as long as their bounds together stay
below the score of the shard's k-th best so far, a vector must appear in the postings of an
essential term to compete. Essential terms are summed up first; the others are probed from the
largest bound down, only for vectors whose sum plus the bounds still open can reach that score.
The best of all shards are merged by rank.

Every shard meets every block of queries: queries are the stated set, and both sides are cut into
blocks of bounded size, dealt by row number, so equal or frequent ids don't gather.

Components become ``floor(SCALE * x)``; sums of their products are exact in 64 bits. Vectors that
are null or hold a null, NaN or infinite component take no part, nor do empty ones. Vectors of
another dimension than the query's are not compared with it. A row is not compared with itself;
other rows with the same id are. A null id is never a query and ranks last among ties.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import materialize

SCALE = 256
SHARD_ROWS = 16_384
BLOCK_ROWS = 512

_FOUND = "query_row long, query_id long, vec_row long, vec_id long, score long"


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``at`` (a row number), ``vec_id`` and the whole-number ``terms`` of the rows that count."""
    terms = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))

    def whole(x: Column) -> Column:
        wide = x.cast("double")
        return x.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < float("inf"))

    return vectors.where(
        F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector), whole)
    ).select(
        F.monotonically_increasing_id().alias("at"),
        F.col(key).cast("long").alias("vec_id"),
        F.size(vector).alias("width"),
        terms.cast("array<long>").alias("terms"),
    )


class Postings:
    """One shard: its vectors by row, and by term the bounds of their components."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, at: np.ndarray):
        order = np.lexsort((at, ids))  # smaller ids first, so a stable order settles ties
        self.rows, self.ids, self.at = rows[order], ids[order], at[order]
        # Sums of products are exact in doubles up to 2^53; larger components use whole numbers.
        largest = int(np.abs(rows).max(initial=0))
        self._kind = np.float64 if rows.shape[1] * largest * largest < 1 << 52 else np.int64
        self.by_term = np.ascontiguousarray(self.rows.T).astype(self._kind)
        self.top = self.by_term.max(axis=1)
        self.low = self.by_term.min(axis=1)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best vectors, leaving out row number ``own``."""
        if self._kind is np.float64 and len(query) * int(np.abs(query).max()) * max(
            1, int(max(self.top.max(), -self.low.min()))
        ) >= 1 << 52:
            query, by_term = query.astype(np.int64), self.by_term.astype(np.int64)
        else:
            query, by_term = query.astype(self._kind), self.by_term
        bounds = np.maximum(query * self.top, query * self.low)
        order = np.argsort(-bounds, kind="stable")
        rest = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])  # of terms from here on
        # A first k: the best by the few strongest terms, scored in full.
        few = order[: max(1, len(order) // 8)]
        partial = query[few] @ by_term[few]
        tried = min(len(partial), 4 * k + 1)
        seeds = np.argpartition(-partial, tried - 1)[:tried]
        seeds = seeds[self.at[seeds] != own]
        scores = np.sort(query @ by_term[:, seeds])[::-1]
        least = scores[k - 1] if len(scores) >= k else None
        if least is None:
            essential, places = len(order), np.arange(len(partial))
            sums = query @ by_term
        else:
            essential = int(np.argmax(rest < least)) if (rest < least).any() else len(order)
            terms = order[:essential]
            if essential:
                sums = query[terms] @ by_term[terms]
                # Who is in none of these postings has no positive product among them; its sum is
                # then at most zero and its open bounds are below the k-th score.
                places = np.flatnonzero(sums + rest[essential] >= least)
                sums = sums[places]
            else:
                places, sums = np.zeros(0, np.int64), np.zeros(0, self._kind)
        while essential < len(order) and len(places):
            step = order[essential : essential + 4]
            sums = sums + query[step] @ by_term[np.ix_(step, places)]
            essential += len(step)
            able = sums + rest[essential] >= least
            places, sums = places[able], sums[able]
        other = self.at[places] != own
        places, sums = places[other], sums[other]
        chosen = np.lexsort((places, -sums))[:k]
        return places[chosen], sums[chosen].astype(np.int64)


def _search(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    found = []
    for _, same in pdf.groupby("width"):
        stored = same[~same["is_query"]]
        asked = same[same["is_query"]]
        if not len(stored) or not len(asked):
            continue
        # A null id becomes the largest number, so that it ranks last.
        ids = stored["vec_id"].astype("Int64").fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
        shard = Postings(np.stack(stored["terms"].to_numpy()), ids, stored["at"].to_numpy(np.int64))
        for own, name, terms in zip(asked["at"], asked["vec_id"], asked["terms"]):
            places, scores = shard.best(np.asarray(terms, np.int64), own, k)
            found.append(
                pd.DataFrame(
                    {
                        "query_row": own, "query_id": int(name), "vec_row": shard.at[places],
                        "vec_id": shard.ids[places], "score": scores,
                    }
                )
            )
    if not found:
        return pd.DataFrame({name: pd.Series(dtype="int64") for name in ("query_row", "query_id", "vec_row", "vec_id", "score")})
    return pd.concat(found, ignore_index=True)


def top_k(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 50,
    k: int = 5,
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each row whose id ``every`` divides.

    Ranks start at 1; equal scores go to the smaller id. A query with fewer candidates has fewer
    rows.
    """
    rows = materialize(quantised(vectors, key, vector))
    asked = rows.where(F.col("vec_id") % every == 0)
    counts = rows.agg(
        F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, True))
    ).first()
    shards, blocks = (max(1, -(-int(n) // size)) for n, size in zip(counts, (shard_rows, block_rows)))

    def dealt(side: DataFrame, own: int, other: int, own_name: str, other_name: str, is_query: bool) -> DataFrame:
        return side.select(
            F.pmod(F.xxhash64("at"), F.lit(own)).alias(own_name),
            F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(other_name),
            "at", "vec_id", "width", "terms", F.lit(is_query).alias("is_query"),
        )

    met = dealt(rows, shards, blocks, "shard", "block", False).unionByName(
        dealt(asked, blocks, shards, "block", "shard", True), allowMissingColumns=False
    )
    found = met.groupBy("shard", "block").applyInPandas(lambda pdf: _search(pdf, k), _FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    null_id = F.lit(int(np.iinfo(np.int64).max))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.nullif("vec_id", null_id).alias("vec_id"), "score")
    )
