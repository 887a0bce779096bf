"""Model-judged stages under the offline judge, whose answers are a function of the prompt."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..operators import vectors
from ..plans import annotate, calibrate, models, planning
from ..plans.models import RuleCompleter
from ..session import folder
from . import fixtures
from .registry import each_row, query, table
from .scalars import words_sql

_L, _R = fixtures.labelled_sql(), fixtures.retrieved_sql()


def _items(prompt: str) -> list[tuple[int, str]]:
    return [(int(n), t) for n, t in re.findall(r"^\[(\d+)\] (.*)$", prompt, re.M)]


def _by_number(prompt: str) -> str:
    """Scores a listed text by the last number in it, modulo 4; now and then in a fence."""
    scores = [{"id": str(n), "score": int(re.findall(r"\d+", t)[-1]) % 4} for n, t in _items(prompt)]
    return "```json\n" + json.dumps(scores) + "\n```" if len(scores) % 2 else json.dumps(scores)


def _client():
    return RuleCompleter(_by_number)


def _doc_rows(spark, d):
    """Whole texts under a first line that names them."""
    return table(spark, d, "documents").select("doc_id", F.concat_ws("\n", F.concat(F.lit("d "), F.col("doc_id").cast("string")), "text").alias("doc"))


def _named(doc: str) -> tuple[str, str]:
    """First line and text."""
    name, _, text = doc.partition("\n")
    return name, text


def _by_text(prompt: str) -> str:
    """Scores a listed document by the length of its whole text, modulo 4; now and then in a fence."""
    parts = re.split(r"^\[(\d+)\] (?=d \d+$)", prompt, flags=re.M)[1:]
    docs = [(n, doc[:-1] if k + 1 < len(parts) // 2 else doc) for k, (n, doc) in enumerate(zip(parts[::2], parts[1::2], strict=True))]
    scores = [{"id": n, "score": len(_named(doc)[1]) % 4} for n, doc in docs]
    return "```json\n" + json.dumps(scores) + "\n```" if len(scores) % 2 else json.dumps(scores)


def _doc_client():
    return RuleCompleter(_by_text)


_N = "length(coalesce(text, ''))"


@query("l01_document_filter", f"SELECT doc_id, 'd ' || doc_id AS doc FROM documents WHERE {_N} % 4 >= 2")
def l01(spark, d):
    passed = annotate.filter_documents(_doc_rows(spark, d), "Score each document.", 7, _doc_client)[0]
    return passed.select("doc_id", F.concat(F.lit("d "), F.col("doc_id").cast("string")).alias("doc"))


@query("l01_document_scores", f"SELECT doc_id, CAST({_N} % 4 AS INTEGER) AS score, CASE WHEN {_N} % 4 >= 2 THEN 'pass' ELSE 'fail' END AS verdict FROM documents")
def l01_scores(spark, d):
    return annotate.filter_documents(_doc_rows(spark, d), "Score each document.", 7, _doc_client)[1].drop("doc")


@query("l01_repeated_documents", f"SELECT doc_id // 3 AS doc_id, CAST({_N} % 4 AS INTEGER) AS score FROM documents UNION ALL SELECT NULL, CAST({_N} % 4 AS INTEGER) FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT NULL, CAST({_N} % 4 AS INTEGER) FROM documents WHERE doc_id % 5 = 0")
def l01_repeated(spark, d):
    """Three texts under each id, others twice under none: rows come out as they went in."""
    rows = _doc_rows(spark, d)
    lost = rows.where("doc_id % 5 = 0").withColumn("doc_id", F.lit(None).cast("long"))
    shared = rows.withColumn("doc_id", F.expr("doc_id div 3"))
    return annotate.filter_documents(shared.unionByName(lost).unionByName(lost), "Score each document.", 7, _doc_client)[1].select("doc_id", "score")


def _attributes(prompt: str) -> str:
    name, text = _named(prompt.split("\n", 1)[1])
    length = f"{len(text)} [1,] // long"  # as much as looks like structure
    if len(text) % 2:
        return "{identifiers: ['%s', ], /* , */ attributes: [{dimension: 'size', options: ['big', 'small', '%s', ' ']}, ]}" % (name, length)
    return json.dumps({"identifiers": [{"type": "doc", "identifier": name, "label": name}] * 2, "attributes": [{"dimension": "size", "options": ["big", "small", length]}, {"dimension": "size", "options": ["late"]}]})


@query("l02_attributes", f"SELECT doc_id, 'd ' || doc_id AS identifiers, 'size=big|small|' || {_N} || ' [1,] // long' AS attributes FROM documents")
def l02(spark, d):
    rows = annotate.generate_attributes(_doc_rows(spark, d), "Find attributes.", lambda: RuleCompleter(_attributes))
    return rows.select("doc_id", F.array_join(F.transform("identifiers", lambda x: x.identifier), ",").alias("identifiers"), F.array_join(F.transform("attributes", lambda x: F.concat(x.dimension, F.lit("="), F.array_join(x.options, "|"))), ",").alias("attributes"))


def _writer(prompt: str) -> str:
    """Plans: at each round one that is new, one that is planned already, one of an unknown option and one of an unknown
    identifier. Queries: in any order, at the first asking none for big, in one answer an extra one; lenient now and then."""
    first, _, rest = prompt.partition("\n")
    if first.startswith("plan"):
        doc, have = rest.rsplit("\nplanned: ", 1)
        name, planned = _named(doc)[0], [p["used_attributes"]["size"] for p in json.loads(have)]
        options = json.loads(re.search(r"\[\{\"dimension\".*\]$", doc).group())[0]["options"]
        new = [o for o in options if o not in planned][:1]
        plan = lambda i, s: {"used_identifier": [i], "used_attributes": {"size": s}}
        return json.dumps({"plans": [*(plan(name, o) for o in planned + new), plan(name, "huge"), plan("other", "big"), {"used_identifier": name, "used_attributes": {"size": (new or planned)[0]}}]})
    doc, plans = rest.rsplit("\nplans: ", 1)
    name, text = _named(doc)
    wanted = [p for p in json.loads(plans)[::-1] if not (first.startswith("write 0") and p["used_attributes"]["size"] == "big")]
    answer = json.dumps({"queries": [{"query": f"ask {name}, {p['used_attributes']['size']}, of {len(text)} [2,] }}", **p} for p in wanted] + [{"query": "more", "used_identifier": [name], "used_attributes": {"size": "huge"}}]})
    return answer if len(text) % 2 else "```\n" + answer[:-1] + ", /* , */ }\n```"


@query("l04_diverse_queries", f"SELECT doc_id, CAST(i AS INTEGER) AS query_pos, 'ask d ' || doc_id || ', ' || [{_N} || ' [1,] // long', 'small', 'big'][i + 1] || ', of ' || {_N} || ' [2,] }}' AS query FROM documents, (VALUES (0), (1), (2)) v(i)")
def l04(spark, d):
    """Three rounds of planning give a plan each; big is written in the second round of queries."""
    docs = annotate.generate_attributes(_doc_rows(spark, d), "Find attributes.", lambda: RuleCompleter(_attributes))
    return planning.generate_queries(docs, "Write queries.", 3, lambda: RuleCompleter(_writer)).select("doc_id", "query_pos", "query")


@query("l05_query_filter", "SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS query_pos FROM conversations WHERE (conv_id + turn) % 4 >= 2")
def l05(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("query_pos"), F.concat(F.lit("q "), (F.col("conv_id") + F.col("turn")).cast("string")).alias("query"))
    return annotate.filter_queries(rows, "Score each query.", 5, _client)[0].select("doc_id", "query_pos")


@query("l06_query_to_passage", f"WITH {_R} SELECT query_id, doc_id, rank, round(score, 6) AS score, doc_id = query_id + 1 AS is_original, round((SELECT score FROM s WHERE s.query_id = r.query_id AND s.doc_id = r.query_id + 1), 6) AS pos_score FROM r")
def l06(spark, d):
    queries, corpus = fixtures.vector_sides(spark, d)
    own = queries.select("query_id", (F.col("query_id") + 1).alias("doc_id"))
    hits = vectors.dense_top_k(queries, corpus, 20).join(vectors.origin_scores(queries, corpus, own).select("query_id", "pos_score", F.col("doc_id").alias("_own")), "query_id", "left")
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), (F.col("doc_id") == F.col("_own")).alias("is_original"), F.round("pos_score", 6).alias("pos_score"))


def _labels(prompt: str) -> str:
    names = ["easy_negative", "hard_negative", "positive", "positive"]
    got = [(n, int(re.findall(r"\d+", t)[-1]) % 4) for n, t in _items(prompt)] or [(0, int(re.findall(r"\d+", prompt)[-1]) % 4)]
    return json.dumps([{"id": str(n), "score": s, "classification": names[s].replace("_", " ").title()} for n, s in got] + [{"id": "99", "score": 3, "classification": "positive"}] * (len(got) > 1))


def _candidates(spark, d):
    return fixtures.labelled(spark, d).select("query_id", "query", "doc_id", "doc", "rank")


_CLASS = "CASE doc_id % 4 WHEN 0 THEN 'easy_negative' WHEN 1 THEN 'hard_negative' ELSE 'positive' END"


@query("n08_annotate_chunks", f"WITH {_R} SELECT query_id, doc_id, CAST(doc_id % 4 AS INTEGER) AS score, {_CLASS} AS classification FROM r")
def n08(spark, d):
    return annotate.annotate(_candidates(spark, d), "Label.", 6, lambda: RuleCompleter(_labels))


@query("n09_annotate_queries", f"WITH {_R} SELECT query_id, coalesce(string_agg(doc_id, '|' ORDER BY rank) FILTER (doc_id % 4 >= 2), '') AS pos, coalesce(string_agg(doc_id, '|' ORDER BY rank) FILTER (doc_id % 4 = 1), '') AS hard, coalesce(string_agg(doc_id, '|' ORDER BY rank) FILTER (doc_id % 4 = 0), '') AS easy FROM r GROUP BY 1")
def n09(spark, d):
    rows = _candidates(spark, d)
    lists = annotate.label_lists(annotate.annotate(rows, "Label.", 6, lambda: RuleCompleter(_labels)), rows.select("query_id", "doc_id", "rank"))
    return lists.select("query_id", F.array_join("positive_doc_ids", "|").alias("pos"), F.array_join("hard_negative_doc_ids", "|").alias("hard"), F.array_join("easy_negative_doc_ids", "|").alias("easy"))


def _unsteady(prompt: str) -> str:
    """Labels; but a list that starts with a document of an id divisible by 3 is first answered in prose, one divisible by 7
    always is, and one divisible by 5 is answered with unknown ids alone."""
    asked, _, again = prompt.partition("\n\nYour answer was:\n")
    head = int(re.findall(r"\d+", _items(asked)[0][1])[-1])
    if head % 7 == 0 or (head % 3 == 0 and "is not valid JSON" not in again):
        return 'Sure: {"annotations": ['
    return json.dumps([{"id": "77", "score": 1, "classification": "positive"}]) if head % 5 == 0 else "{annotations: %s,}" % _labels(asked)


_HEADS = f"{_R}, h AS (SELECT *, CAST((rank - 1) // 6 AS BIGINT) AS chunk, first_value(doc_id) OVER (PARTITION BY query_id, (rank - 1) // 6 ORDER BY rank) AS head FROM r), o AS (SELECT *, CASE WHEN head % 7 = 0 THEN 'failed' WHEN head % 3 = 0 THEN 'repaired' ELSE 'usable' END AS outcome FROM h)"


@query("n08_chunk_outcomes", f"WITH {_HEADS} SELECT query_id, chunk, outcome, CASE WHEN outcome = 'failed' THEN NULL WHEN head % 5 = 0 THEN '' ELSE string_agg(doc_id || '=' || {_CLASS}, '|' ORDER BY rank) END AS labels FROM o GROUP BY query_id, chunk, outcome, head")
def n08_outcomes(spark, d):
    chunks = annotate.annotate_chunks(_candidates(spark, d), "Label.", 6, lambda: RuleCompleter(_unsteady))
    return chunks.select("query_id", "chunk", "outcome", F.array_join(F.transform("annotations", lambda a: F.concat_ws("=", a.doc_id.cast("string"), a.classification)), "|").alias("labels"))


@query("n09_query_outcomes", f"WITH {_HEADS} SELECT query_id, count(DISTINCT chunk) AS chunks, count(DISTINCT chunk) FILTER (outcome = 'repaired') AS repaired, count(DISTINCT chunk) FILTER (outcome = 'failed') AS failed, CASE WHEN count(*) FILTER (outcome <> 'failed') > 0 THEN coalesce(string_agg(doc_id, '|' ORDER BY rank) FILTER (outcome <> 'failed' AND head % 5 > 0 AND doc_id % 4 >= 2), '') END AS pos FROM o WHERE rank <= 6 OR query_id % 40 = 0 GROUP BY query_id")
def n09_outcomes(spark, d):
    """Null where all chunks failed, an empty list where none of the labels matched. Every second query has one chunk only."""
    rows = annotate.annotate_queries(_candidates(spark, d).where("rank <= 6 or query_id % 40 = 0"), "Label.", 6, lambda: RuleCompleter(_unsteady))
    return rows.select("query_id", "chunks", "repaired", "failed", F.array_join("positive_doc_ids", "|").alias("pos"))


@query("n10_hidden_ids", f"WITH {_R} SELECT query_id, doc_id, CAST(doc_id % 4 AS INTEGER) AS score, {_CLASS} AS classification FROM r")
def n10(spark, d):
    return annotate.annotate(_candidates(spark, d), "Label.", 6, lambda: RuleCompleter(_labels), hide_ids=True)


@query("l08_candidate_annotator", f"WITH {_R} SELECT {_CLASS} AS classification, count(*) AS n FROM r GROUP BY 1")
def l08(spark, d):
    return annotate.annotate(_candidates(spark, d), "Label.", 6, lambda: RuleCompleter(_labels)).groupBy("classification").agg(F.count("*").alias("n"))


def _expected(spark, d):
    rows = fixtures.labelled(spark, d)
    name = lambda c: F.when(c >= 2, "positive").when(c == 1, "hard_negative").otherwise("easy_negative")
    expected = rows.select("query_id", "doc_id", name(F.col("label")).alias("expected_label"))
    predicted = rows.where("rank < 20").select("query_id", "doc_id", name(F.col("doc_id") % 4).alias("classification"))
    return expected, predicted


_CAL = f"WITH {_L}, p AS (SELECT CASE WHEN label >= 2 THEN 'positive' WHEN label = 1 THEN 'hard_negative' ELSE 'easy_negative' END AS e, CASE WHEN rank < 20 THEN {_CLASS} ELSE 'missing' END AS p FROM l), cc AS (SELECT {{}} AS same FROM p) SELECT count(*) AS total, count(*) FILTER (same) AS correct, count(*) FILTER (NOT same) AS mismatches, false AS passed FROM cc"


@query("n11_calibration", _CAL.format("e = p"))
def n11(spark, d):
    return calibrate.compare(*_expected(spark, d))


@query("n11_calibration_two", _CAL.format("p <> 'missing' AND (e = 'positive') = (p = 'positive')"))
def n11_two(spark, d):
    return calibrate.compare(*_expected(spark, d), two=True)


def _pools(spark, d):
    rows = _candidates(spark, d)
    marked = annotate.annotate(rows, "Label.", 6, lambda: RuleCompleter(_labels)).join(rows.select("query_id", "doc_id", "doc", "rank"), ["query_id", "doc_id"])
    return calibrate.draft_pools(marked, rows.where("rank = 1").select("query_id", "doc_id", "doc"), 2)


_POOL = f"{_R}, d AS (SELECT query_id, doc_id, {_CLASS} AS classification, row_number() OVER (PARTITION BY query_id, doc_id % 4 ORDER BY rank) AS place FROM r WHERE rank > 1 AND doc_id % 4 < 2 QUALIFY place <= 2)"


@query("n12_draft_pools", f"WITH {_POOL} SELECT query_id, doc_id, classification, place FROM d")
def n12(spark, d):
    return _pools(spark, d)


@query("n13_confirmed", f"WITH {_POOL} SELECT query_id, doc_id, classification AS expected_label FROM d WHERE place = 1")
def n13(spark, d):
    draft = _pools(spark, d)
    return calibrate.confirm(draft, draft.where("place = 1"))[0]


@query("n14_positive_calibration", "SELECT row_number() OVER (ORDER BY item_id) AS place, 'q' || item_id AS query, trim(text) AS doc, 'positive' AS expected_label FROM benchmark WHERE item_id % 3 > 0 AND trim(text) <> '' QUALIFY place <= 10")
def n14(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 3 > 0, F.concat(F.lit(" q"), F.col("item_id").cast("string"))).alias("query"), F.col("text").alias("positive"))
    return calibrate.positives_only(rows, "item_id", 10)


@query("l10_refinement", "SELECT item_id, CAST(k AS INTEGER) AS attempt, repeat('x', CAST(k - 1 AS INTEGER)) AS artefact, k - 1 >= item_id % 5 AS passed FROM benchmark, range(1, 4) AS r(k) WHERE k - 2 < item_id % 5")
def l10(spark, d):
    """An instruction for each item, refined until it is as long as asked for, or three attempts are over."""

    def run(r):
        done = calibrate.refine(lambda a: len(a), lambda n: (n >= r["item_id"] % 5, f"{n} is short"), lambda a, f: a + "x")
        return [(r["item_id"], h["attempt"], h["artefact"], h["passed"]) for h in done.history]

    return each_row(table(spark, d, "benchmark").select("item_id"), "item_id long, attempt int, artefact string, passed boolean", run)


@query("l11_evaluators", "SELECT doc_id, kind, coalesce(TRY_CAST(score AS DOUBLE) >= least, false) AS passed FROM (SELECT doc_id, ['1', '2', CAST(n_chars AS VARCHAR) || '.0', 'n/a', NULL][doc_id % 5 + 1] AS score FROM documents), (VALUES ('attributes', 2), ('query_instruction', 2), ('annotation', 3)) k(kind, least)")
def l11(spark, d):
    score = F.get(F.array(F.lit("1"), F.lit("2"), F.concat("n_chars", F.lit(".0")), F.lit("n/a"), F.lit(None)), (F.col("doc_id") % 5).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", score.alias("score"))
    return each_row(rows, "doc_id long, kind string, passed boolean", lambda r: [(r["doc_id"], k, calibrate.evaluation_passes(k, r["score"])) for k in calibrate.PASS_SCORES])


@query("l19_model_buckets", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT *, CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS p FROM c), s AS (SELECT source, sum(p) AS total FROM p GROUP BY 1) SELECT source, lang AS label, round(p / total, 6) AS probability FROM p JOIN s USING (source) WHERE p > 0 UNION ALL SELECT source, 'medium', 1.0 FROM s WHERE total = 0")
def l19(spark, d):
    """For each source the buckets that a model proposes: a language each, those of odd counts without probability."""
    counts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    answers = counts.groupBy("source").agg(F.collect_list(F.struct(F.col("lang").alias("label"), F.when(F.col("n") % 2 == 0, F.col("n")).otherwise(0).alias("probability"))).alias("answer"))
    return each_row(answers, "source string, label string, probability double", lambda r: [(r["source"], *b) for b in calibrate.model_buckets(r["answer"], [("medium", 1.0)])])


@query("l20_newest_final", "SELECT source AS task, lang AS kind, max(doc_id) AS created_at, 't' || max(doc_id) AS text FROM documents WHERE doc_id % 3 = 0 GROUP BY 1, 2")
def l20(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("task"), F.col("lang").alias("kind"), F.col("doc_id").alias("created_at"), F.when(F.col("doc_id") % 3 == 0, "final").otherwise("attempt").alias("role"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("text"))
    return calibrate.newest_final(rows)


@query("l18_prompts", f"SELECT item_id, md5('Judge.' || chr(10) || text || chr(10) || CAST({words_sql('text')} AS VARCHAR)) AS prompt FROM benchmark")
def l18(spark, d):
    from ..functions.text import word_count

    return table(spark, d, "benchmark").select("item_id", F.md5(F.concat_ws("\n", F.lit("Judge."), "text", word_count(F.col("text")).cast("string")).cast("binary")).alias("prompt"))


def _task():
    from ..plans.instructions import Task

    return Task("t", "questions", "passages", "it answers the question")


def _examples(spark, d):
    rows = table(spark, d, "benchmark").orderBy("item_id").limit(3).collect()
    return [{"query": f"q{r.item_id}", "positive": r.text, "negative": ""} for r in rows]


@query("l03_query_instruction", "SELECT 't' AS task, 'query' AS kind, 'Query: of ' || least(3, count(*)) AS text FROM benchmark")
def l03(spark, d):
    from ..plans import instructions as i

    got = i.generate(i.query_prompt(_task(), _examples(spark, d)), ["Query:"], RuleCompleter(lambda p: f"Query: of {p.count('Example')}"))
    return spark.createDataFrame([("t", "query", got)], "task string, kind string, text string")


@query("l07_label_instruction", "SELECT 't' AS task, 'label' AS kind, 'Grade ' || least(3, count(*)) AS text FROM benchmark")
def l07(spark, d):
    from ..plans import instructions as i

    got = i.generate(i.label_prompt(_task(), _examples(spark, d), "old", "too short"), ["Grade"], RuleCompleter(lambda p: f"Grade {p.count('Example')}"))
    return spark.createDataFrame([("t", "label", got)], "task string, kind string, text string")


@query("l12_task_definition", "WITH d AS (SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 2) SELECT lang AS task, 'questions, [1,]' AS query_type, 'd ' || string_agg(doc_id, ' ' ORDER BY doc_id) AS doc_type, 'it answers' AS relevance, CAST((SELECT count(DISTINCT lang) FROM documents) AS INTEGER) AS calls FROM d GROUP BY lang")
def l12(spark, d):
    """A task for each language, from two documents each; asked for twice, and answered in lenient JSON in a fence."""
    from ..operators.relational import first_rows_per
    from ..plans import instructions as i

    cache: dict = {}
    model = RuleCompleter(lambda p: "```json\n{query_type: 'questions, [1,]', /* , */ doc_type: 'd %s', relevance: 'it answers',}\n```" % " ".join(re.findall(r"^Query: q(\d+)$", p, re.M)))
    examples: dict = {}
    for r in first_rows_per(table(spark, d, "documents"), ["lang"], ["doc_id"], 2).select("lang", "doc_id", "text").orderBy("lang", "doc_id").collect():  # two rows a language
        examples.setdefault(r.lang, []).append({"query": f"q{r.doc_id}", "positive": "text", "negative": ""})
    tasks = [i.define_task(lang, e, model, cache) for _ in range(2) for lang, e in examples.items()]
    return spark.createDataFrame([(t.name, t.query_type, t.doc_type, t.relevance, len(cache)) for t in tasks[: len(examples)]], "task string, query_type string, doc_type string, relevance string, calls int")


@query("l13_human_review", "SELECT item_id, 1 AS attempt, 'v1' AS artefact, item_id % 2 = 1 AS passed FROM benchmark UNION ALL SELECT item_id, 2, 'v1 shorter', true FROM benchmark WHERE item_id % 2 = 0")
def l13(spark, d):
    from ..plans.instructions import reviewed

    def run(r):
        answers = iter(["shorter", ""] if r["item_id"] % 2 == 0 else [""])
        done = calibrate.refine(lambda a: a, lambda x: (True, ""), lambda a, f: f"{a} {f}", "v1", review=reviewed(lambda a: next(answers)))
        return [(r["item_id"], h["attempt"], h["artefact"], h["passed"]) for h in done.history]

    return each_row(table(spark, d, "benchmark").select("item_id"), "item_id long, attempt int, artefact string, passed boolean", run)


@query("l14_concurrent_calls", f"SELECT doc_id, 'd ' || doc_id || ' ' || {_N} AS answer FROM documents")
def l14(spark, d):
    from ..plans.models import ask

    return ask(_doc_rows(spark, d), "doc", "answer", lambda: RuleCompleter(lambda p: f"{_named(p)[0]} {len(_named(p)[1])}"), threads=4).select("doc_id", "answer")


@query("l15_kept_answers", f"SELECT doc_id, 'd ' || doc_id || ' ' || {_N} AS answer FROM documents")
def l15(spark, d):
    """Half of the prompts are asked in a first run, which leaves its answers; the second run sends the others, in waves."""
    rows, store = _doc_rows(spark, d), folder(spark, "answers")
    model = lambda: RuleCompleter(lambda p: f"{_named(p)[0]} {len(_named(p)[1])}")
    models.ask_once(rows.where("doc_id % 2 = 0"), "doc", "answer", model, store)
    return models.ask_once(rows, "doc", "answer", model, store, wave=max(1, rows.count() // 5)).select("doc_id", "answer")


@query("l21_prompted_embeddings", "SELECT item_id, 64 AS dimensions FROM benchmark")
def l21(spark, d):
    from ..plans.instructions import PromptedEmbedder
    from ..plans.models import HashEmbedder, embed

    rows = embed(table(spark, d, "benchmark"), "text", lambda: PromptedEmbedder(HashEmbedder(), "query: "))
    return rows.select("item_id", F.size("embedding").alias("dimensions"))


@query("p22_preflight", "SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'output_dir is missing' END, CASE WHEN lang <> 'en' THEN 'task is unknown' END, CASE WHEN doc_id % 3 = 0 THEN 'input_path is a placeholder' END, CASE WHEN doc_id % 2 = 0 THEN 'api_key holds a secret; name an environment variable instead' END], lambda x: x IS NOT NULL)) AS problem FROM documents")
def p22(spark, d):
    """A configuration for each document's run, checked before anything starts."""
    from ..plans.checks import preflight

    def run(r):
        config = {"task": r["lang"], "input_path": "<path>" if r["doc_id"] % 3 == 0 else r["source"], "output_dir": "o" if r["doc_id"] % 5 else None, "api_key": "hidden" if r["doc_id"] % 2 == 0 else "env:KEY"}
        return [(r["doc_id"], x) for x in preflight(config, ["en"])]

    return each_row(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id long, problem string", run)
