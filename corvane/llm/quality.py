"""Quality rules: one table of thresholds, compiled into one Spark projection of built-in expressions.

Windows of three words stand as 64-bit hashes when repeats are counted. A text is judged inside its row: its words, and a
hash and a place for each, are held at once, about 150 bytes a word, and sorted there.

Nulls and edge cases: null text counts as empty: all counts are 0 and it is not kept. A text of white space only
likewise. A ratio whose denominator is 0 is 0. Lines are compared whole, with their white space. Rows are judged one by
one, so repeated rows are judged alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\\x20\\x09-\\x0D]+"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is for it with as was on by "
    "der die und das in zu den von ist mit nicht des auf ein "
    "le la les de et des en un une du que qui pour dans "
    "el los las y del que por con una para es se no su"
).split()


class Rule(NamedTuple):
    """A text passes if low <= measure <= high."""

    name: str
    measure: str  #: SQL over the counts
    low: float
    high: float


#: The threshold table.
RULES = (
    Rule("length", "n_words", 50, 1e9),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 2.0, 15.0),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", 0.0, 0.1),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", 0.02, 1.0),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", 0.0, 0.4),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", 0.0, 0.5),
)

# ``transform(array(x), s -> y)[0]`` names x inside y, so that it is computed once.
_REPEATS = """
CASE WHEN size(words) < 3 THEN 0 ELSE size(array_distinct(flatten(transform(
  array(sort_array(transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS g, i AS i)))),
  s -> transform(filter(s, (x, k) -> coalesce(x.g = get(s, k - 1).g, false) OR coalesce(x.g = get(s, k + 1).g, false)), x -> array(x.i, x.i + 1, x.i + 2))
)[0]))) END
"""


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_stop_words."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.selectExpr("doc_id", "text", f"regexp_extract_all(text, '{WORD}', 0) AS words", f"filter(split(text, '\\n', -1), x -> x RLIKE '{WORD}') AS lines")
    return rows.selectExpr(
        "doc_id",
        "cast(size(words) AS long) AS n_words",
        "cast(length(text) - length(regexp_replace(text, '[^\\\\x20\\\\x09-\\\\x0D]+', '')) AS long) AS word_chars",
        "cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '')) AS long) AS n_symbols",
        "cast(size(lines) AS long) AS n_lines",
        "cast(size(lines) - size(array_distinct(lines)) AS long) AS n_dup_lines",
        f"cast({_REPEATS} AS long) AS n_repeat_words",
        f"cast(size(filter(words, x -> lower(x) IN ({stops}))) AS long) AS n_stop_words",
    )


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one expression."""
    out = F.lit(True)
    for r in rules:
        out &= F.expr(r.measure).between(r.low, r.high)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts of each text, base_failed (under 50 words, or over half of them in repeats), kept, and failed, the names
    of the rules that it breaks."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = F.array_compact(F.array(*(F.when(~F.expr(r.measure).between(r.low, r.high), r.name) for r in rules)))
    return counts(docs).select("*", base.alias("base_failed"), (~base & passes(rules)).alias("kept"), names.alias("failed"))
