"""Line-first cleaning: bad lines go, then documents that lost too much.

A line with a word is judged by three rules.

* punctuation: too many of ``#*$%&|<>`` or repeated marks such as ``!!``, no letter, or a long
  line without any mark that ends or divides a sentence;
* navigation: a breadcrumb or menu, words between bars, bullets or arrows, or a bare link;
* boilerplate: a short line with a phrase of page furniture, such as a cookie notice.

What is kept of a text is its other lines in order, blank ones included. A document is rejected if
the base rules fail or if fewer than ``MIN_KEPT`` of its words are in kept lines. A null or empty
text has no words and fails. Every row is judged by itself, repeated rows alike; nothing is
shuffled and all rules are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parameters of the base rules.
MIN_WORDS = 10
MAX_REPEATED = 0.2  # share of words in repeated windows
WINDOW = 5

# Parameters of the line rules.
MIN_KEPT = 0.5  # share of words in kept lines
MAX_SYMBOLS = 0.1  # of a line's characters outside spaces
MAX_REPEATED_MARKS = 0.3  # of a line's words
LONG_LINE = 12  # words
SHORT_LINE = 25

# Phrases of page furniture.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here", "cookie policy",
    "enable javascript", "follow us on", "log in to", "lorem ipsum", "powered by",
    "privacy policy", "read more", "share on facebook", "share this", "sign in", "sign up",
    "skip to content", "subscribe now", "subscribe to our", "terms of service", "terms of use",
    "use cookies", "uses cookies",
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def repeated_words(words_: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that a word sequence holds twice or more, first ones included.

    Windows are compared by a 64-bit hash of their words' hashes, sorted with their places so that
    equal ones are neighbours; a sequence without equal windows skips that.
    """

    def hashes(found: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(found) - window),
            lambda at: F.xxhash64(*[F.get(found, at + i) for i in range(window)]),
        )

    def covered(codes: Column) -> Column:
        placed = F.sort_array(F.transform(codes, lambda code, at: F.struct(code.alias("code"), at.alias("at"))))

        def in_order(sorted_: Column) -> Column:
            def same(i: Column, j: Column) -> Column:
                return F.coalesce(F.get(sorted_, i)["code"] == F.get(sorted_, j)["code"], F.lit(False))

            return F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(sorted_, lambda row, i: F.struct(row["at"].alias("at"), i.alias("i"))),
                        lambda row: same(row["i"], row["i"] - 1) | same(row["i"], row["i"] + 1),
                    ),
                    lambda row: row["at"],
                )
            )

        def length(places: Column) -> Column:
            steps = F.transform(
                places, lambda at, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - at, F.lit(window)))
            )
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

        return _let(_let(placed, in_order), length)

    def counted(codes: Column) -> Column:
        return F.when(F.size(F.array_distinct(codes)) == F.size(codes), F.lit(0).cast("long")).otherwise(
            covered(codes)
        )

    return _let(
        words_,
        lambda found: F.when(F.size(found) <= window, F.lit(0).cast("long")).otherwise(
            _let(_let(F.transform(found, lambda word: F.xxhash64(word)), hashes), counted)
        ),
    )


def line_is_bad(line: Column, found: Column) -> Column:
    """Does a line fail a rule that holds the words ``found``, one or more?

    What is counted is counted only in lines that have such a character at all.
    """
    n_words = F.size(found)
    symbols = _count(line, r"[#*$%&|<>]")
    marks = _count(line, r"[!?#*$%&]{2,}")
    marked = line.rlike(r"[#*$%&|<>]|[!?]{2}") & (
        (symbols > MAX_SYMBOLS * F.length(F.array_join(found, "")))
        | (marks > MAX_REPEATED_MARKS * n_words)
    )
    unpunctuated = (n_words >= LONG_LINE) & ~line.rlike(r"[.!?,;:…。，！？؟۔।]")
    punctuation = marked | ~line.rlike(r"\p{L}") | unpunctuated

    def menu(dividers: Column) -> Column:
        return (dividers >= 2) & (3 * dividers >= n_words - dividers)

    divided = line.rlike(r"[|»›•·>]") & _let(_count(line, r"(?:^|\s)(?:[|»›•·>]|->)(?=\s|$)"), menu)
    navigation = divided | line.rlike(r"^\s*(?:https?://|www\.)\S+\s*$")
    furniture = F.lower(line).rlike(rf"\b(?:{'|'.join(BOILERPLATE)})\b")
    return punctuation | navigation | ((n_words <= SHORT_LINE) & furniture)


def clean(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts, the verdict and ``clean_text`` of each row of ``doc_id, text``."""
    spaces = F.coalesce(F.col("text"), F.lit(""))
    # Words are split once, by line; "\n" is a space, too, so the lines' words are the text's.
    spaced = F.split(F.regexp_replace("text", r"[\x09\x0B-\x0D]", " "), "\n")
    split = docs.select("doc_id", spaces.alias("text")).select(
        "doc_id",
        "text",
        F.split("text", "\n").alias("lines"),
        F.transform(spaced, lambda line: F.array_remove(F.split(line, " "), "")).alias("found"),
    )
    counted = split.select("*", F.flatten("found").alias("words"))

    # Bound by _let, as what a lambda names alone Spark may compute anew for each element.
    def full(found: Column) -> Column:
        return F.filter("lines", lambda line, i: F.size(F.get(found, i)) > 0)

    def good(both: Column) -> Column:
        def stays(i: Column) -> Column:
            found = F.get(both["found"], i)
            return (F.size(found) == 0) | ~line_is_bad(F.get(both["lines"], i), found)

        return F.filter(F.sequence(F.lit(0), F.size(both["lines"]) - 1), stays)

    def picked(lines: Column) -> Column:
        return F.transform("good", lambda i: F.get(lines, i))

    def picked_words(found: Column) -> Column:
        return F.aggregate("good", F.lit(0).cast("long"), lambda total, i: total + F.size(F.get(found, i)))

    judged = counted.select(
        "doc_id",
        "lines",
        "found",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(F.col("text"), r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        _let(_let(F.col("found"), full), lambda some: F.size(some) - F.size(F.array_distinct(some))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        _let(F.struct("lines", "found"), good).alias("good"),
    )
    kept = judged.withColumn("clean_text", F.array_join(_let(F.col("lines"), picked), "\n"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words")
    )
    kept_words = _let(F.col("found"), picked_words)
    return (
        kept.withColumn("base_failed", base_failed)
        .withColumn("kept_words", kept_words)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & (F.col("kept_words") >= MIN_KEPT * F.col("n_words"))).alias("kept"),
            "kept_words",
            "clean_text",
        )
    )
