"""Calibration sets, and the loop that refines instructions until a check passes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import EASY, HARD, two_class
from ..functions.text import blank
from ..operators.relational import expected_and_predicted, numbered


def compare(expected: DataFrame, predicted: DataFrame, two: bool = False) -> DataFrame:
    """total, correct, mismatches and passed; a missing label is a mismatch, and so is an empty set. two: positives
    against negatives."""
    rows = expected_and_predicted(expected, predicted)
    side = two_class if two else (lambda c: c)
    same = F.coalesce(side(F.col("expected_label")) == side(F.col("predicted")), F.lit(False))
    out = rows.agg(F.count("*").alias("total"), F.count_if(same).alias("correct"), F.count_if(~same).alias("mismatches"))
    return out.withColumn("passed", (F.col("total") > 0) & (F.col("mismatches") == 0))


def draft_pools(annotated: DataFrame, positives: DataFrame, each: int) -> DataFrame:
    """Candidates (query_id, doc_id, doc, classification, rank) for human choice: the first ``each`` hard and easy ones of
    every query, none of them its positive by id or by text."""
    p = positives.select("query_id", F.col("doc_id").alias("_id"), F.trim("doc").alias("_doc"))
    rows = annotated.join(p, "query_id").where((F.col("doc_id") != F.col("_id")) & (F.trim("doc") != F.col("_doc")) & F.col("classification").isin(HARD, EASY))
    return numbered(rows, ["rank"], "place", ["query_id", "classification"]).where(F.col("place") <= each).select("query_id", "doc_id", "classification", "place")


def confirm(draft: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen candidates with their expected label, and queries that lack exactly one hard or easy choice."""
    chosen = draft.join(choices.select("query_id", "doc_id"), ["query_id", "doc_id"])
    counts = draft.select("query_id").distinct().join(chosen.groupBy("query_id").agg(F.count_if(F.col("classification") == HARD).alias("hard"), F.count_if(F.col("classification") == EASY).alias("easy")), "query_id", "left")
    bad = counts.where("coalesce(hard, 0) <> 1 or coalesce(easy, 0) <> 1").select("query_id")
    return chosen.select("query_id", "doc_id", F.col("classification").alias("expected_label")), bad


def positives_only(examples: DataFrame, position: str, count: int | None = None) -> DataFrame:
    """Query and positive of examples that have both, all expected to be positive."""
    rows = numbered(examples.where(~blank(F.col("query")) & ~blank(F.col("positive"))), [position], "place")
    rows = rows if count is None else rows.where(F.col("place") <= count)
    return rows.select("place", F.trim("query").alias("query"), F.trim("positive").alias("doc"), F.lit("positive").alias("expected_label"))


@dataclass
class Refinement:
    """What a refinement went through."""

    passed: bool
    artefact: str
    history: list[dict] = field(default_factory=list)


def refine(generate: Callable[[str], object], evaluate: Callable[[object], tuple[bool, str]], improve: Callable[[str, str], str], first: str = "", attempts: int = 3, review: Callable[[str, bool, str], tuple[bool, str] | None] | None = None) -> Refinement:
    """Generates with an instruction, checks the output, and improves the instruction by the feedback, at most
    ``attempts`` times; after the last failure nothing is improved. A review may overrule a check."""
    artefact, history = first, []
    for n in range(1, attempts + 1):
        ok, feedback = evaluate(generate(artefact))
        said = review(artefact, ok, feedback) if review else None
        if said is not None:
            ok, feedback = said
        history.append({"attempt": n, "artefact": artefact, "passed": ok, "feedback": feedback})
        if ok:
            return Refinement(True, artefact, history)
        if n < attempts:
            artefact = improve(artefact, feedback)
    return Refinement(False, artefact, history)


# The score from which an evaluation passes.
PASS_SCORES = {"attributes": 2, "query_instruction": 2, "annotation": 3}


def evaluation_passes(kind: str, score: object) -> bool:
    """What cannot be read as a number fails."""
    try:
        return int(float(str(score))) >= PASS_SCORES[kind]
    except (ValueError, OverflowError):
        return False


def newest_final(artefacts: DataFrame) -> DataFrame:
    """Of (task, kind, created_at, role, text) the newest final text of each task and kind; attempts and history do not
    count."""
    return artefacts.where("role = 'final'").groupBy("task", "kind").agg(F.max_by("text", "created_at").alias("text"), F.max("created_at").alias("created_at"))


def model_buckets(answer: list[dict] | None, fallback: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Length buckets that a model proposes: positive probabilities, made to add up to 1 to 6 digits; otherwise the
    fallback."""
    try:
        kept = [(str(b["label"]), float(b["probability"])) for b in answer or [] if float(b["probability"]) > 0]
        total = sum(p for _, p in kept)
        return [(x, round(p / total, 6)) for x, p in kept] if kept else fallback
    except (KeyError, TypeError, ValueError):
        return fallback
