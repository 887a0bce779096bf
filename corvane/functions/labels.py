"""Scores, classes and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that state relevance, and words that deny it.
TRUE_WORDS = ("true", "yes", "relevant", "positive", "entailment", "correct")
FALSE_WORDS = ("false", "no", "irrelevant", "negative", "not_relevant", "incorrect")

POSITIVE, HARD, EASY = "positive", "hard_negative", "easy_negative"


def verdict(score: Column, stated: Column | None = None) -> Column:
    """``pass`` from a score of 2; without a readable score, the stated verdict, else ``pass``."""
    s = score.cast("string").try_cast("int")
    stated = F.lower(F.trim(stated)) if stated is not None else F.lit(None).cast("string")
    return F.when(s >= 2, "pass").when(s < 2, "fail").otherwise(F.when(stated == "fail", "fail").otherwise("pass"))


def normal_label(x: Column, hyphens: bool = True) -> Column:
    """Lower case, spaces (and hyphens) as ``_``."""
    return F.regexp_replace(F.lower(F.trim(x)), "[ -]" if hyphens else " ", "_")


def three_class(score: Column) -> Column:
    return F.when(score.isin(2, 3), POSITIVE).when(score == 1, HARD).when(score == 0, EASY)


def two_class(label: Column) -> Column:
    return F.when(label == POSITIVE, POSITIVE).when(label.isin(HARD, EASY), "negative")


def relevance(x: Column, default: int = 1) -> Column:
    """Words, booleans and numbers as an integer relevance; what cannot be read is the default."""
    word = F.lower(F.trim(x.cast("string")))
    return F.when(word.isNull() | (word == "") | word.isin(*TRUE_WORDS), default).when(word.isin(*FALSE_WORDS), 0).otherwise(F.coalesce(word.try_cast("double").cast("int"), F.lit(default))).cast("int")
