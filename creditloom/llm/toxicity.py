"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic regression over words, word
beginnings and a few numbers of the text, and over the probabilities of the categories before it.
For training, those earlier probabilities are out-of-fold: each row's come from models that did
not see it. Folds are drawn by the text's hash, so copies of a text share a fold.

Which words count is chosen from the training rows of each model by a chi-square test. The models
are fitted in one task, on at most about ``MAX_ROWS`` labelled rows drawn by a hash of the id and
at most ``MAX_FEATURES`` words a category; scoring is a column expression over all documents.

Null and empty texts have no words and get the score of their numbers. A category with one class
only gets a constant, near zero if there are no labels at all. Labels of one id are merged by the largest value.
Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.session import materialize

# Parameters.
MAX_ROWS = 20_000  # labelled rows to learn from
MAX_FEATURES = 128  # words of a category
FOLDS = 3
MIN_CHI2 = 30.0
MIN_POSITIVES = 4  # of a word's training rows
BEGINNINGS = (4, 5, 6)  # letters
RIDGE = 0.3
THRESHOLD = 0.4
SEED = 4

NUMBERS = ("log_words", "symbol_share", "mark_share", "repeat_share")


@dataclass
class Link:
    """The model of one category: words, numbers (with their scaling) and earlier categories."""

    category: str
    bias: float = 0.0
    words: dict[str, float] = field(default_factory=dict)
    numbers: list[float] = field(default_factory=lambda: [0.0] * len(NUMBERS))
    earlier: list[float] = field(default_factory=list)


# --- Features -------------------------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda word: word != "")


def features(text: Column) -> Column:
    """Distinct words of a text and, marked by ``~``, their first letters."""
    def forms(word: Column) -> Column:
        return F.array(
            word, *[F.when(F.length(word) >= n, F.concat(F.substring(word, 1, n), F.lit("~"))) for n in BEGINNINGS]
        )

    return F.array_compact(F.array_distinct(F.flatten(F.transform(F.array_distinct(_words(text)), forms))))


def numbers(text: Column) -> Column:
    """The values of ``NUMBERS``."""
    found = _words(text)
    count = F.size(found)
    dense = F.greatest(F.length(F.regexp_replace(text, r"\s+", "")), F.lit(1))
    return F.array(
        F.log1p(count.cast("double")),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / dense,
        F.regexp_count(text, F.lit("[!?]")) / dense,
        1 - F.size(F.array_distinct(found)) / F.greatest(count, F.lit(1)),
    )


# --- Training -------------------------------------------------------------------------------


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias and not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    weights[-1] = np.log(rate / (1 - rate))
    if len(y) and 0 < y.sum() < len(y):
        penalty = np.full(x.shape[1], RIDGE)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x.T @ (p - y) + penalty * weights
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            weights -= step
            if np.abs(step).max() < 1e-3:
                break
    return weights


def _chosen(counts: pd.DataFrame, category: str, held_out: int | None) -> list[int]:
    """Places in ``counts`` of the words that tell a category apart, outside one fold."""
    folds = [k for k in range(FOLDS) if k != held_out]
    n = counts.attrs["n"][folds].sum()
    positives = counts.attrs[category][folds].sum()
    both = sum(counts[f"{category}_{k}"] for k in folds).to_numpy(float)
    word = sum(counts[f"n_{k}"] for k in folds).to_numpy(float)
    if not 0 < positives < n:
        return []
    expected = word * positives / n
    spread = expected * (1 - positives / n) * (1 - word / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.where(spread > 0, (both - expected) ** 2 / spread, 0.0)
    good = np.flatnonzero((chi2 >= MIN_CHI2) & (np.maximum(both, word - both) >= MIN_POSITIVES))
    order = np.lexsort((counts["feature"].to_numpy()[good], -chi2[good]))
    return good[order][:MAX_FEATURES].tolist()


def train(rows: pd.DataFrame, counts: pd.DataFrame, categories: list[str]) -> list[Link]:
    """``rows``: ``fold``, ``numbers``, ``hits`` (places in ``counts``) and a column per category."""
    n = len(rows)
    fold = rows["fold"].to_numpy()
    plain = np.array(rows["numbers"].tolist(), float).reshape(n, len(NUMBERS))
    mean, deviation = (plain.mean(0), plain.std(0)) if n else (np.zeros(len(NUMBERS)),) * 2
    deviation = np.where(deviation > 1e-9, deviation, 1.0)
    scaled = (plain - mean) / deviation
    counts.attrs["n"] = np.bincount(fold, minlength=FOLDS)
    at = np.repeat(np.arange(n), rows["hits"].map(len).to_numpy(int))
    hit = np.concatenate([*rows["hits"], []]).astype(int)
    earlier = np.zeros((n, 0))  # out-of-fold log odds of the categories so far
    chain = []
    for category in categories:
        y = rows[category].to_numpy(float)
        counts.attrs[category] = np.bincount(fold, weights=y, minlength=FOLDS)

        def design(places: list[int]) -> np.ndarray:
            column = np.full(len(counts) + 1, -1)
            column[places] = np.arange(len(places))
            present = np.zeros((n, len(places)))
            own = column[hit] >= 0
            present[at[own], column[hit[own]]] = 1.0
            return np.hstack([present, scaled, earlier])

        odds = np.zeros(n)
        for k in range(FOLDS):
            x = design(_chosen(counts, category, k))
            weights = _logistic(x[fold != k], y[fold != k])
            odds[fold == k] = x[fold == k] @ weights[:-1] + weights[-1]
        places = _chosen(counts, category, None)
        weights = _logistic(design(places), y)
        words, rest = weights[: len(places)], weights[len(places) : -1]
        slopes = rest[: len(NUMBERS)] / deviation
        chain.append(
            Link(
                category,
                float(weights[-1] - slopes @ mean),
                dict(zip(counts["feature"].to_numpy()[places].tolist(), words.tolist())),
                slopes.tolist(),
                rest[len(NUMBERS) :].tolist(),
            )
        )
        earlier = np.hstack([earlier, np.clip(odds, -30, 30)[:, None]])
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = MAX_ROWS) -> list[Link]:
    """A chain learnt from ``labels`` (``doc_id`` and a 0/1 column per category) on ``docs``."""
    given = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.col(c), F.lit(0)).cast("int")).alias(f"is_{c}") for c in categories]
    )
    n = given.count()
    if n > max_rows:
        share = int(max_rows / n * (1 << 30))
        given = given.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < share)
    text = F.coalesce(F.col("text"), F.lit(""))
    sample = materialize(
        docs.select("doc_id", text.alias("text"))
        .join(given, "doc_id")
        .withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    )
    sums = [F.count(F.when(F.col("fold") == k, 1)).alias(f"n_{k}") for k in range(FOLDS)] + [
        F.count(F.when((F.col("fold") == k) & (F.col(f"is_{c}") == 1), 1)).alias(f"{c}_{k}")
        for c in categories
        for k in range(FOLDS)
    ]
    totals = sample.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"is_{c}").alias(c) for c in categories]
    ).first()
    if not totals["n"]:
        return [Link(c, -30.0, earlier=[0.0] * i) for i, c in enumerate(categories)]
    words = sample.select(F.explode(features(F.col("text"))).alias("feature"), "fold", *[f"is_{c}" for c in categories])
    counted = words.groupBy("feature").agg(*sums)
    seen = sum(F.col(f"n_{k}") for k in range(FOLDS))
    telling = F.lit(0.0)
    for c in categories:  # the test over all folds, with room for the folds' own
        share = (totals[c] or 0) / totals["n"]
        both = sum(F.col(f"{c}_{k}") for k in range(FOLDS))
        if 0 < share < 1:
            chi2 = F.pow(both - seen * share, 2) / (seen * (share * (1 - share)))
            telling = F.greatest(telling, chi2)
    candidates = (
        counted.where((seen >= MIN_POSITIVES) & (telling >= MIN_CHI2 / 2))
        .orderBy(F.desc(telling), "feature")
        .limit(4 * MAX_FEATURES * len(categories))
        .toPandas()
    )
    vocabulary = F.array(*map(F.lit, candidates["feature"])) if len(candidates) else F.array().cast("array<string>")
    used = sample.select(
        "fold",
        numbers(F.col("text")).alias("numbers"),
        F.transform(
            F.array_intersect(features(F.col("text")), vocabulary),
            lambda word: F.array_position(vocabulary, word).cast("int") - 1,
        ).alias("hits"),
        *[F.col(f"is_{c}").alias(c) for c in categories],
    )

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        chain = train(pdf, candidates.copy(), categories)
        return pd.DataFrame(
            {
                "category": [link.category for link in chain],
                "bias": [link.bias for link in chain],
                "words": [list(link.words) for link in chain],
                "weights": [list(link.words.values()) for link in chain],
                "numbers": [link.numbers for link in chain],
                "earlier": [link.earlier for link in chain],
            }
        )

    # The sample is bounded, so one task may hold it.
    found = used.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(
        fitted,
        "category string, bias double, words array<string>, weights array<double>,"
        " numbers array<double>, earlier array<double>",
    ).collect()
    links = {
        row["category"]: Link(
            row["category"], row["bias"], dict(zip(row["words"], row["weights"])), row["numbers"], row["earlier"]
        )
        for row in found
    }
    return [links[c] for c in categories]


# --- Scoring --------------------------------------------------------------------------------


def _word_sum(hits: Column, words: dict[str, float]) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    own = F.transform(hits, lambda word: F.coalesce(F.try_element_at(weights, word), F.lit(0.0)))
    return F.aggregate(own, F.lit(0.0), lambda total, weight: total + weight)


def score(docs: DataFrame, chain: list[Link], columns: list[str]) -> DataFrame:
    """``columns`` of each row and ``p_<category>`` for each category of the chain."""
    vocabulary = sorted({word for link in chain for word in link.words})
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = F.array().cast("array<string>")
    if vocabulary:
        hits = F.array_intersect(features(text), F.array(*map(F.lit, vocabulary)))
    scored = docs.select(F.struct(*columns).alias("row"), hits.alias("hits"), numbers(text).alias("numbers"))
    for place, link in enumerate(chain):
        odds = F.lit(link.bias)
        for i, slope in enumerate(link.numbers):
            odds += F.col("numbers")[i] * slope
        if link.words:
            odds += _word_sum(F.col("hits"), link.words)
        for before, slope in enumerate(link.earlier):
            odds += F.col(f"odds_{before}") * slope
        bounded = F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))
        scored = scored.withColumn(f"odds_{place}", bounded)
    return scored.select(
        "row.*",
        *[(1 / (1 + F.exp(-F.col(f"odds_{i}")))).alias(f"p_{link.category}") for i, link in enumerate(chain)],
    )


# The categories that the label table gives, from the broad to the narrow one.
CATEGORIES = ["low_quality", "toxic", "toxic_prose"]


def categories(labels: DataFrame) -> DataFrame:
    """``doc_id`` and the categories of a ``doc_id, quality, toxic`` table."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    good = F.coalesce(F.col("quality"), F.lit(1)) == 1
    return labels.select(
        "doc_id",
        (~good).cast("int").alias("low_quality"),
        toxic.cast("int").alias("toxic"),
        (toxic & good).cast("int").alias("toxic_prose"),
    )


def judge(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, ``p_<category>`` and ``toxic`` for each document."""
    chain = fit(docs, categories(labels), CATEGORIES)
    return score(docs, chain, columns).withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
