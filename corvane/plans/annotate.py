"""Model-judged stages: prompts go out in chunks, answers come back as JSON and are parsed, checked and joined as columns.

Answers are stored where more than one result depends on them, so that a prompt is sent once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plans
from ..functions.json5 import json_problem, strict_json
from ..functions.labels import EASY, HARD, POSITIVE, normal_label, verdict
from ..functions.text import blank, cache_key, lenient_json
from ..operators.relational import chunked, numbered
from ..session import stored
from .models import Completer, ask

Client = Callable[[], Completer]


def _listing(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "\n")


def judged(df: DataFrame, key: str, shown: Column, task: str, size: int, client: Client, name: str) -> DataFrame:
    """``df`` with ``score``, from a model that sees rows in batches of ``size``; null where the answer lacks or garbles one.
    The answer is a list of {id, score}; ids are places in the batch, so that no real id leaves.

    Rows come out as they went in: what repeats a key with its text is shown once and shares its score, rows that share a
    key alone are judged each, and so are rows whose key is null.
    """
    digest = F.sha2(F.coalesce(shown, F.lit("")), 256)
    rows = df.withColumn("_digest", digest)
    # keys alone are sorted and numbered; whole texts meet once, in their batch, and do not come back from the model
    places = numbered(rows.select(F.col(key).alias("_key"), "_digest").distinct(), ["_key", "_digest"], "_n").select("_key", "_digest", F.floor((F.col("_n") - 1) / size).alias("_chunk"), ((F.col("_n") - 1) % size + 1).alias("_n"))
    texts = df.select(F.col(key).alias("_key"), digest.alias("_digest"), F.coalesce(shown, F.lit("")).alias("_shown")).dropDuplicates(["_key", "_digest"])
    item = F.struct(F.col("_n").alias("n"), F.col("_shown").alias("text"), F.col("p._key").alias("key"), F.col("p._digest").alias("digest"))
    prompts = places.alias("p").join(texts.alias("t"), _same("p", "t")).groupBy("_chunk").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    prompts = prompts.select(F.transform("_items", lambda x: F.struct(x.n.alias("n"), x.key.alias("key"), x.digest.alias("digest"))).alias("_items"), F.concat(F.lit(task + "\n"), _listing(F.col("_items"), lambda x: F.format_string("[%d] %s", x.n, x.text))).alias("_prompt"))
    answers = ask(prompts, "_prompt", "_answer", client).withColumn("_got", lenient_json(F.col("_answer"), "array<struct<id: string, score: string>>"))
    match = F.filter("_got", lambda g: g.id.try_cast("long") == F.col("x.n"))
    scores = answers.select(F.explode("_items").alias("x"), "_got").select(F.col("x.key").alias("_key"), F.col("x.digest").alias("_digest"), F.get(match, 0).score.try_cast("int").alias("score"))
    found = rows.withColumn("_key", F.col(key)).alias("r").join(stored(scores, name).alias("s"), _same("r", "s"), "left")
    return found.select(*(F.col(f"r.`{c}`") for c in df.columns), "s.score")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}._key").eqNullSafe(F.col(f"{b}._key")) & (F.col(f"{a}._digest") == F.col(f"{b}._digest"))


def filter_documents(df: DataFrame, task: str, size: int, client: Client) -> tuple[DataFrame, DataFrame]:
    """Documents that pass, and all with score and verdict; without a score a document fails only if the call failed."""
    every = judged(df, "doc_id", F.col("doc"), task, size, client, "judged-documents").withColumn("verdict", verdict(F.col("score")))
    return every.where("verdict = 'pass'").drop("score", "verdict"), every


def filter_queries(df: DataFrame, task: str, size: int, client: Client) -> tuple[DataFrame, DataFrame]:
    """Queries (doc_id, query_pos, query) that pass; documents that lose all of theirs are gone with them. A query without a
    readable score fails."""
    place = F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lpad(F.col("query_pos").cast("string"), 6, "0"))
    scored = judged(df.withColumn("_place", place), "_place", F.col("query"), task, size, client, "judged-queries")
    every = scored.withColumn("verdict", verdict(F.coalesce("score", F.lit(0)))).drop("_place")
    return every.where("verdict = 'pass'").drop("score", "verdict"), every


IDENTIFIER = "struct<type: string, identifier: string, label: string>"


def generate_attributes(df: DataFrame, task: str, client: Client) -> DataFrame:
    """Per document identifiers and attributes, normalised; a failed or garbled answer gives empty lists. An identifier may
    be an object or its text alone."""
    schema = "identifiers array<string>, attributes array<struct<dimension: string, options: array<string>>>"
    rows = ask(df.withColumn("_prompt", F.concat(F.lit(task + "\n"), "doc")), "_prompt", "_answer", client).withColumn("_j", lenient_json(F.col("_answer"), schema))
    text = lambda r: F.struct(F.lit(None).cast("string").alias("type"), F.trim(r).alias("identifier"), F.substring(F.trim(r), 1, 48).alias("label"))
    given = F.transform("_j.identifiers", lambda r: F.when(r.startswith("{"), F.from_json(r, IDENTIFIER)).otherwise(text(r)))
    ids = plans.identifiers(given, F.array().cast("array<string>"))
    none = F.array().cast("array<struct<dimension: string, options: array<string>>>")
    return rows.select(*df.columns, ids.alias("identifiers"), plans.attributes(F.coalesce("_j.attributes", none)).alias("attributes"))


#: What a chunk's answer may hold: a list of labels, or an object with one, or for a single document the label itself.
LABEL = "struct<doc_id: string, id: string, score: string, classification: string, reasoning: string>"
#: A second prompt carries the first answer and what is wrong with it.
AGAIN = "\n\nYour answer was:\n%s\n\nIt is not valid JSON of the required form (%s). Answer again, with the JSON alone."


def _read(answers: DataFrame, hide_ids: bool) -> DataFrame:
    """Adds ``_problem`` (null if the answer can be used) and ``_labels``."""
    text = F.col("_json")
    many = f"array<{LABEL}>"
    listed = F.when(text.startswith("["), F.from_json(text, many)).otherwise(F.coalesce(F.from_json(text, f"annotations {many}").annotations, F.array(F.from_json(text, LABEL)) if hide_ids else F.array().cast(many)))
    empty = F.regexp_replace(text, r"\s+", "").isin("{}", "[]")
    wrong = F.when(text.isNull(), json_problem(F.col("_answer"))).when(~text.rlike(r"^\s*[\[{]"), "neither a list nor an object").when(empty, "nothing in it")
    rows = answers.withColumn("_json", F.trim(strict_json(F.col("_answer"))))
    return rows.withColumn("_problem", wrong).withColumn("_labels", F.when(F.col("_problem").isNull(), listed)).drop("_json")


def annotate_chunks(df: DataFrame, task: str, size: int, client: Client, hide_ids: bool = False, retries: int = 1) -> DataFrame:
    """Labels candidates (query_id, query, doc_id, doc, rank) in chunks of ``size``: query_id, chunk, outcome, problem,
    annotations (array of doc_id, score, classification, reasoning in the order of the answer).

    outcome: ``usable`` at the first answer, ``repaired`` where a later prompt, which carries the answer and what is wrong
    with it, brought one, ``failed`` where no answer can be read or the call failed; then annotations is null. A readable
    answer that labels none of the chunk's documents gives an empty list. The model sees places in the chunk; ids that it
    makes up drop out. With ``hide_ids`` a chunk is one document and the answer needs no id.
    """
    size = 1 if hide_ids else size
    rows = chunked(df, ["rank", "doc_id"], size, "_chunk", ["query_id"])
    rows = numbered(rows, ["rank", "doc_id"], "_n", ["query_id", "_chunk"]).withColumn("_n", F.col("_n") - 1)
    prompts = rows.groupBy("query_id", "query", "_chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("_n").alias("n"), "doc", "doc_id"))).alias("_items"))
    line = (lambda x: x.doc) if hide_ids else (lambda x: F.format_string("[%d] %s", x.n, x.doc))
    prompts = prompts.withColumn("_prompt", F.concat(F.lit(task + "\n"), "query", F.lit("\n"), _listing(F.col("_items"), line)))
    prompts = prompts.withColumn("_items", F.transform("_items", lambda x: F.struct(x.n.alias("n"), x.doc_id.alias("doc_id"))))
    done = None
    for r in range(retries + 1):
        # what is used, what is asked again and what has failed all come from these answers
        answers = stored(_read(ask(prompts, "_prompt", "_answer", client), hide_ids), "annotated-chunks")
        asked_again = F.col("_problem").isNotNull() & F.col("_answer").isNotNull() & F.lit(r < retries)
        outcome = F.when(F.col("_problem").isNotNull(), "failed").otherwise("usable" if r == 0 else "repaired")
        settled = answers.where(~asked_again).withColumn("outcome", outcome)
        done = settled if done is None else done.unionByName(settled)
        prompts = answers.where(asked_again)
        if r == retries or prompts.isEmpty():
            break
        again = F.format_string(AGAIN, F.col("_answer"), F.col("_problem"))
        prompts = prompts.select("query_id", "query", "_chunk", "_items", F.concat("_prompt", again).alias("_prompt"))
    place = (lambda g: F.lit(0).cast("long")) if hide_ids else (lambda g: F.coalesce(g.id, g.doc_id).try_cast("long"))
    item = lambda g: F.get(F.filter("_items", lambda x: x.n == place(g)), 0)
    label = lambda g: F.struct(item(g).doc_id.alias("doc_id"), g.score.try_cast("int").alias("score"), normal_label(g.classification, hyphens=False).alias("classification"), g.reasoning.alias("reasoning"))
    known = F.transform(F.filter("_labels", lambda g: F.exists("_items", lambda x: x.n == place(g))), label)
    return done.select("query_id", F.col("_chunk").alias("chunk"), "outcome", F.col("_problem").alias("problem"), F.when(F.col("outcome") != "failed", F.coalesce(known, F.array().cast(known_type(done)))).alias("annotations"))


def known_type(rows: DataFrame) -> str:
    """The type of annotations; ids have that of the candidates."""
    items = rows.schema["_items"].dataType.elementType
    return f"array<struct<doc_id: {items['doc_id'].dataType.simpleString()}, score: int, classification: string, reasoning: string>>"


def annotate(df: DataFrame, task: str, size: int, client: Client, hide_ids: bool = False, retries: int = 1) -> DataFrame:
    """The labels of ``annotate_chunks`` as rows: query_id, doc_id, score, classification; failed chunks have none."""
    chunks = annotate_chunks(df, task, size, client, hide_ids, retries)
    return chunks.select("query_id", F.explode("annotations").alias("a")).select("query_id", "a.doc_id", "a.score", "a.classification")


def annotate_queries(df: DataFrame, task: str, size: int, client: Client, hide_ids: bool = False, retries: int = 1) -> DataFrame:
    """Per query: annotations and the three lists of ids, chunk by chunk, in the order of the answers; chunks, repaired and
    failed count chunks. All four are null where every chunk failed, and empty where no label matched."""
    chunks = annotate_chunks(df, task, size, client, hide_ids, retries)
    count = lambda outcome: F.count_if(F.col("outcome") == outcome).alias(outcome)
    parts = F.sort_array(F.collect_list(F.when(F.col("annotations").isNotNull(), F.struct("chunk", "annotations"))))
    rows = chunks.groupBy("query_id").agg(F.count("*").alias("chunks"), count("repaired"), count("failed"), parts.alias("_parts"))
    rows = rows.withColumn("annotations", F.when(F.col("failed") < F.col("chunks"), F.flatten(F.transform("_parts", lambda p: p.annotations)))).drop("_parts")
    ids = lambda kind: F.transform(F.filter("annotations", lambda a: a.classification == kind), lambda a: a.doc_id.cast("string"))
    return rows.select("*", ids(POSITIVE).alias("positive_doc_ids"), ids(HARD).alias("hard_negative_doc_ids"), ids(EASY).alias("easy_negative_doc_ids"))


def label_lists(annotations: DataFrame, position: DataFrame) -> DataFrame:
    """Per query the ids of each label, in rank order; other labels enter no list. position: query_id, doc_id, rank."""
    rows = annotations.join(position, ["query_id", "doc_id"])
    ids = lambda label: F.transform(F.sort_array(F.collect_list(F.when(F.col("classification") == label, F.struct("rank", F.col("doc_id").cast("string").alias("id"))))), lambda x: x.id)
    return rows.groupBy("query_id").agg(ids(POSITIVE).alias("positive_doc_ids"), ids(HARD).alias("hard_negative_doc_ids"), ids(EASY).alias("easy_negative_doc_ids"))


def prompt_key(df: DataFrame, *columns: str) -> DataFrame:
    """Adds the key under which an answer is cached."""
    return df.withColumn("cache_key", cache_key(*(F.col(c) for c in sorted(columns))))


def usable_answers(df: DataFrame, column: str) -> DataFrame:
    return df.where(~blank(F.col(column)))
