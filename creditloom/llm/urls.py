"""URL verdicts by a rule list and by association rules mined with FP-growth.

A URL becomes a set of tokens: the labels of its host and the words of its path. FP-growth over
labelled URLs, each with its label as one more item, finds token combinations; those that imply a
label with enough support and confidence become rules, less those a shorter rule makes needless.
Rules are matched by an inverted index from each rule's rarest token to the rule: a URL looks up
only the rules filed under its own tokens and checks that it holds the other tokens.

Null URLs and URLs without ``://`` have an empty host and path and no tokens; they get the default
verdict. Repeated rows are judged alike. An empty or unlabelled table mines no rules. The list's own
verdicts are never mined: that would only restate its host endings and path words where it is silent.

Everything is a DataFrame expression. What reaches the driver is the mined rules. Their number is
bounded by the support: a combination is kept only if a share ``min_support`` of the labelled
URLs hold it, so of ``t``-token URLs at most ``2 ** t / min_support`` combinations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.9
DEFAULT = "allow"

_LABEL = "verdict="  # no URL token holds a "="


@dataclass(frozen=True)
class ListedRule:
    """``text`` is a host and a path prefix, such as ``net/`` or ``example.net/en/``."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class MinedRule:
    tokens: tuple[str, ...]
    verdict: str
    support: float
    confidence: float


# The list every query here judges by.
LISTED = (
    ListedRule("net/", "block"),
    ListedRule("example.net/en/", "allow"),
    ListedRule("example.com/de/", "block"),
    ListedRule("org/fr/", "allow"),
)


def host(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = _rest(url)
    cut = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    return F.when(at > 0, F.substr(known, at + 3)).otherwise(F.lit(""))


def listed_rule(host_: Column, path_: Column, rules=LISTED) -> Column:
    """The longest rule for the host or a domain above it whose path starts the URL's path."""
    choice = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda rule: len(rule.text)):  # the longest is tested first
        fits = (host_ == rule.host) | host_.endswith("." + rule.host)
        choice = F.when(fits & path_.startswith(rule.path), F.lit(rule.text)).otherwise(choice)
    return choice


def tokens(host_: Column, path_: Column) -> Column:
    """Distinct labels of the host and, marked by a slash, letter words of the path."""
    labels = F.split(host_, r"\.")
    parts = F.transform(F.split(F.lower(path_), r"[^\p{L}]+"), lambda part: F.concat(F.lit("/"), part))
    return F.array_distinct(
        F.filter(F.concat(labels, parts), lambda token: (token != "") & (token != "/"))
    )


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> list[MinedRule]:
    """Rules from ``tokens`` (array) and ``label`` (text or null); rows without a label don't count.

    A rule goes if a rule on part of its tokens has the same verdict and at least its confidence.
    """
    baskets = labelled.where(F.col("label").isNotNull()).select(
        F.concat("tokens", F.array(F.concat(F.lit(_LABEL), F.col("label")))).alias("items")
    )
    model = FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence,
        numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    ).fit(baskets)
    found = (
        model.associationRules.where(F.col("consequent")[0].startswith(_LABEL))
        .orderBy(F.size("antecedent"), F.desc("confidence"), F.desc("support"), F.sort_array("antecedent"))
        .collect()
    )
    kept: list[MinedRule] = []
    for row in found:
        rule = MinedRule(
            tuple(sorted(row["antecedent"])),
            row["consequent"][0].removeprefix(_LABEL),
            row["support"],
            row["confidence"],
        )
        if not any(
            set(old.tokens) <= set(rule.tokens)
            and old.verdict == rule.verdict
            and old.confidence >= rule.confidence
            for old in kept
        ):
            kept.append(rule)
    return kept


def mined_rule(tokens_: Column, rules: list[MinedRule]) -> Column:
    """The place in ``rules`` of the rule that judges a token set, or null.

    Of several matching rules the one with the highest confidence counts, then the highest
    support, then the first.
    """
    if not rules:
        return F.lit(None).cast("int")
    uses: dict[str, int] = {}
    for rule in rules:
        for token in rule.tokens:
            uses[token] = uses.get(token, 0) + 1
    index: dict[str, list[int]] = {}
    for place, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda token: (uses[token], token)), []).append(place)
    filed = F.create_map(
        *[part for token, places in index.items() for part in (F.lit(token), F.array(*map(F.lit, places)))]
    )
    needed = F.array(*[F.array(*map(F.lit, rule.tokens)) for rule in rules])
    best_first = sorted(
        range(len(rules)), key=lambda i: (-rules[i].confidence, -rules[i].support, i)
    )
    merit = F.array(*[F.lit(best_first.index(i)) for i in range(len(rules))])
    candidates = F.flatten(
        F.transform(
            F.array_intersect(tokens_, F.array(*map(F.lit, index))),
            lambda token: F.element_at(filed, token),
        )
    )
    matching = F.filter(
        candidates, lambda place: F.size(F.array_except(F.element_at(needed, place + 1), tokens_)) == 0
    )
    ranked = F.array_min(F.transform(matching, lambda place: F.element_at(merit, place + 1)))
    return F.when(F.size(matching) > 0, F.element_at(F.array(*map(F.lit, best_first)), ranked + 1))


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, label`` of the pages whose path ends in the number of a document in ``labels``.

    ``labels`` has ``doc_id, quality, toxic``; a page is to be blocked if any row of its document
    says that it is toxic or of low quality.
    """
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("number"))
        .agg(F.when(F.max(bad), F.lit("block")).otherwise(F.lit("allow")).alias("label"))
    )
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]+)(?:\.[a-z]+)?/?$", 1).try_cast("long")
    return pages.select("url", number.alias("number")).join(known, "number").select("url", "label")


def judge(pages: DataFrame, key: str = "page_id", listed=LISTED, labels: DataFrame | None = None) -> DataFrame:
    """A verdict for each row of ``pages`` (``key``, ``url``); other columns are ignored.

    ``labels`` (``url``, ``label``) are what rules are mined from. Without it, the list and the
    default judge alone.
    """
    verdicts = dict((rule.text, rule.verdict) for rule in listed)

    def of_rule(text: Column) -> Column:
        verdict = F.lit(None).cast("string")
        for name, value in verdicts.items():
            verdict = F.when(text == name, F.lit(value)).otherwise(verdict)
        return verdict

    def split(df: DataFrame, *more: str) -> DataFrame:
        cut = df.select(*more, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        return cut.withColumns(
            {
                "rule": listed_rule(F.col("host"), F.col("path"), listed),
                "tokens": tokens(F.col("host"), F.col("path")),
            }
        )

    judged = split(pages, key)
    rules = [] if labels is None else mine(split(labels, "label").select("tokens", "label"))
    found = judged.withColumn("place", mined_rule(F.col("tokens"), rules))
    by_rule = F.lit(None).cast("string")
    names = F.lit(None).cast("string")
    if rules:
        fits, at = F.col("place").isNotNull(), F.col("place") + 1
        # Spark takes an element of an array without nulls as never null, at a null place too.
        by_rule = F.when(fits, F.element_at(F.array(*[F.lit(rule.verdict) for rule in rules]), at))
        names = F.when(fits, F.element_at(F.array(*[F.lit(" ".join(rule.tokens)) for rule in rules]), at))
    return found.select(
        key,
        "host",
        "path",
        "rule",
        F.coalesce(of_rule(F.col("rule")), by_rule, F.lit(DEFAULT)).alias("verdict"),
        F.when(F.col("rule").isNull(), names).alias("mined_tokens"),
    )
