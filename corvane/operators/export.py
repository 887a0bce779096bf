"""Training records from annotated queries.

Input rows hold query, candidates (doc_id, doc), annotations (doc_id, score) and the three lists of ids; see
``relational.resolve`` for how ids become texts. Output rows add pos and neg; the outcome says why a row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, first_then_rest, wrapped
from .relational import query_origins, resolve

_TEXTS = lambda c: resolve(F.col(c), F.col("candidates"))


def _record(rows: DataFrame, pos: Column, neg: Column) -> DataFrame:
    out = rows.withColumns({"pos": pos, "neg": neg, "query": F.trim("query")})
    return out.where(~blank(F.col("query")) & (F.size("pos") > 0) & (F.size("neg") > 0)).select("query_id", "query", "pos", "neg")


def positives_and_hard(rows: DataFrame) -> DataFrame:
    return _record(rows, _TEXTS("positive_doc_ids"), _TEXTS("hard_negative_doc_ids"))


def _either(rows: DataFrame) -> Column:
    hard = _TEXTS("hard_negative_doc_ids")
    return F.when(F.size(hard) > 0, hard).otherwise(_TEXTS("easy_negative_doc_ids"))


def hard_else_easy(rows: DataFrame) -> DataFrame:
    return _record(rows, _TEXTS("positive_doc_ids"), _either(rows))


def hard_filled(rows: DataFrame, target: int) -> DataFrame:
    """All hard negatives; fewer than ``target`` are filled with easy ones as far as there are."""
    hard, easy = _TEXTS("hard_negative_doc_ids"), _TEXTS("easy_negative_doc_ids")
    return _record(rows, _TEXTS("positive_doc_ids"), F.concat(hard, F.slice(easy, 1, F.greatest(F.lit(0), target - F.size(hard)))))


def scored(rows: DataFrame, score: int) -> Column:
    """Texts of ids annotated with a score, each id once."""
    ids = F.array_distinct(F.transform(F.filter("annotations", lambda a: a.score == score), lambda a: a.doc_id))
    return resolve(ids, F.col("candidates"))


def score_three(rows: DataFrame) -> DataFrame:
    return _record(rows, scored(rows, 3), _either(rows))


def score_three_else_two(rows: DataFrame) -> DataFrame:
    three = scored(rows, 3)
    return _record(rows, F.when(F.size(three) > 0, three).otherwise(scored(rows, 2)), _either(rows))


def outcome(rows: DataFrame) -> DataFrame:
    """Adds outcome: ok, or the first reason for which a row is skipped."""
    pos, hard, easy = (F.size(_TEXTS(c)) for c in ("positive_doc_ids", "hard_negative_doc_ids", "easy_negative_doc_ids"))
    why = F.when(blank(F.col("query")), "skip_query_empty").when(pos == 0, "skip_pos_empty").when(hard > 0, "ok").when(easy > 0, "ok_easy").otherwise("skip_neg_empty")
    return rows.withColumn("outcome", why)


def origin_only(records: DataFrame, batch: DataFrame, position: str, keep_others: bool) -> DataFrame:
    """Reduces pos to the document that a query was written for. Records without one, or whose pos lacks it, go, or stay
    as they are with ``keep_others``."""
    rows = query_origins(records, batch, position)
    found = F.coalesce(F.array_contains("pos", F.col("origin_doc")), F.lit(False))
    out = rows if keep_others else rows.where(found)
    return out.withColumn("pos", F.when(found, F.array("origin_doc")).otherwise(F.col("pos"))).select(*records.columns)


def median_split(records: DataFrame, batch: DataFrame, position: str, rounding: str = "ceil") -> DataFrame:
    """Each record x times with one positive each, x the rounded median of the lengths of pos: the origin document first,
    then the others, wrapping around. Adds split, from 0."""
    exact = F.median(F.size("pos"))
    x = {"ceil": F.ceil(exact), "floor": F.floor(exact), "round": F.floor(exact + 0.5)}[rounding]
    rows = query_origins(records, batch, position).crossJoin(F.broadcast(records.agg(F.greatest(F.lit(1), x).cast("int").alias("_x"))))
    known = F.coalesce(F.array_contains("pos", F.col("origin_doc")), F.lit(False))
    rows = rows.withColumn("_pos", F.when(known, first_then_rest(F.col("origin_doc"), F.col("pos"))).otherwise(F.col("pos")))
    rows = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("_x") - 1)))
    return rows.withColumn("pos", F.array(wrapped(F.col("_pos"), F.col("split")))).select(*records.columns, "split")


def first_slot(mined: DataFrame) -> DataFrame:
    """Mined documents (queries: query, pos, neg) to records of their first query, if it has both lists."""
    q = F.element_at("queries", 1)
    rows = mined.where(F.size("queries") > 0).select("doc_id", q.query.alias("query"), q.pos.alias("pos"), q.neg.alias("neg"))
    return rows.where(~blank(F.col("query")) & (F.size("pos") > 0) & (F.size("neg") > 0))
