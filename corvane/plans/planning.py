"""Query generation in two stages, each repeated on what is still missing: plans up to the wanted number, then a query for
each plan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plans
from ..functions.json5 import strict_json
from ..functions.text import blank
from ..operators.relational import first_per, numbered
from ..session import stored
from .models import Completer, ask

#: Plans that one prompt asks to be written out.
CHUNK = 12
#: One identifier may stand without its list.
USED = "used_identifier: string, used_attributes: map<string, string>"


def _identifiers(raw: Column) -> Column:
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def _key(ids: Column, used: Column) -> Column:
    """Equal for plans that use the same identifiers and options, in any order; nothing in them can make two keys meet."""
    return F.to_json(F.struct(F.array_sort(ids).alias("i"), F.array_sort(F.map_entries(used)).alias("a")))


def _items(answers: DataFrame, name: str, fields: str, *columns: str) -> DataFrame:
    """A row for each item of the answer's list ``name``, or of an answer that is that list, with its place ``_i``."""
    text = F.trim(strict_json(F.col("_answer")))
    kind = f"array<struct<{fields}>>"
    listed = F.when(text.startswith("["), F.from_json(text, kind)).otherwise(F.from_json(text, f"`{name}` {kind}")[name])
    rows = answers.select(*columns, F.posexplode(listed).alias("_i", "_item")).select(*columns, "_i", "_item.*")
    return rows.withColumn("used_identifier", _identifiers(F.col("used_identifier")))


def plan(docs: DataFrame, task: str, most: int, client: Callable[[], Completer], rounds: int = 3) -> DataFrame:
    """Plans for the stored table ``docs`` (_row, doc, identifiers, attributes), at most ``most`` a row: _row, place (1, 2, ...),
    used_identifier, used_attributes, key.

    Each round asks those rows that lack plans for the number that they lack, and tells the model which ones they have; a
    plan that is repeated, unknown or incomplete does not count. The rounds end when no row lacks any, or after ``rounds``.
    """
    none = F.array().cast("array<struct<place: int, used_identifier: array<string>, used_attributes: map<string, string>, key: string>>")
    frontier, found = docs.withColumn("_have", none), []
    for r in range(rounds):
        left = F.lit(most) - F.size("_have")
        shown = F.to_json(F.transform("_have", lambda p: F.struct(p.used_identifier.alias("used_identifier"), p.used_attributes.alias("used_attributes"))))
        prompt = F.concat(F.lit("plan "), left.cast("string"), F.lit(f": {task}\n"), F.coalesce("doc", F.lit("")), F.lit("\n"), F.to_json("identifiers"), F.to_json("attributes"), F.lit("\nplanned: "), shown)
        answers = ask(frontier.select("_row", prompt.alias("_prompt")), "_prompt", "_answer", client)
        rows = _items(answers, "plans", USED, "_row").join(frontier.select("_row", "_have", left.alias("_left"), "identifiers", "attributes"), "_row")
        known = F.transform("identifiers", lambda x: x.identifier)
        rows = rows.withColumn("used_identifier", F.filter("used_identifier", lambda i: F.array_contains(known, i)))
        rows = rows.where(plans.valid_plan(F.col("used_identifier"), F.col("used_attributes"), known, F.col("attributes")))
        rows = rows.withColumn("key", _key(F.col("used_identifier"), F.col("used_attributes")))
        rows = first_per(rows.where(~F.exists("_have", lambda p: p.key == F.col("key"))), ["_row", "key"], ["_i"])
        rows = numbered(rows, ["_i"], "_n", ["_row"]).where(F.col("_n") <= F.col("_left"))
        found.append(stored(rows.select("_row", (F.size("_have") + F.col("_n")).cast("int").alias("place"), "used_identifier", "used_attributes", "key"), "plans"))
        if r + 1 < rounds:
            # at most ``most`` plans a row meet
            have = reduce(DataFrame.unionByName, found).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("place", "used_identifier", F.map_entries("used_attributes").alias("used"), "key"))).alias("_have"))
            have = have.withColumn("_have", F.transform("_have", lambda p: F.struct(p.place.alias("place"), p.used_identifier.alias("used_identifier"), F.map_from_entries(p.used).alias("used_attributes"), p.key.alias("key"))))
            frontier = docs.join(have, "_row", "left").withColumn("_have", F.coalesce("_have", none)).where(F.size("_have") < most)
            if frontier.isEmpty():
                break
    return reduce(DataFrame.unionByName, found)


def write(docs: DataFrame, planned: DataFrame, task: str, client: Callable[[], Completer], rounds: int = 2, chunk: int = CHUNK) -> DataFrame:
    """A query for each plan of ``plan``, as far as the model gives one: _row, query_pos, query, used_identifier,
    used_attributes.

    Plans go out in chunks of ``chunk``; an answer's queries are matched to the plans of its chunk by what they use, not by
    their order, and the first one of a plan counts. Plans without a query are asked again.
    """
    open_plans, out = planned, []
    for r in range(rounds):
        rows = numbered(open_plans, ["place"], "_n", ["_row"]).withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk))
        entry = F.struct("place", "used_identifier", F.map_entries("used_attributes").alias("used"), "key")
        chunks = rows.groupBy("_row", "_chunk").agg(F.array_sort(F.collect_list(entry)).alias("_plans"))
        shown = F.to_json(F.transform("_plans", lambda p: F.struct(p.used_identifier.alias("used_identifier"), F.map_from_entries(p.used).alias("used_attributes"))))
        prompt = F.concat(F.lit(f"write {r}: {task}\n"), F.coalesce("doc", F.lit("")), F.lit("\nplans: "), shown)
        asked = chunks.join(docs.select("_row", "doc"), "_row").select("_row", "_chunk", prompt.alias("_prompt"))
        answers = ask(asked, "_prompt", "_answer", client)
        got = _items(answers, "queries", f"query: string, {USED}", "_row", "_chunk").join(chunks, ["_row", "_chunk"])
        got = got.withColumn("query", F.trim("query")).withColumn("key", _key(F.col("used_identifier"), F.col("used_attributes")))
        got = got.where(~blank(F.col("query")) & F.exists("_plans", lambda p: p.key == F.col("key")))
        got = first_per(got, ["_row", "key"], ["_chunk", "_i"])
        out.append(stored(got.select("_row", F.lit(r).alias("_round"), "_chunk", "_i", "query", "used_identifier", "used_attributes", "key"), "written"))
        if r + 1 < rounds:
            open_plans = stored(open_plans.join(out[-1].select("_row", "key"), ["_row", "key"], "left_anti"), "open-plans")
            if open_plans.isEmpty():
                break
    rows = numbered(reduce(DataFrame.unionByName, out), ["_round", "_chunk", "_i"], "query_pos", ["_row"])
    return rows.select("_row", (F.col("query_pos") - 1).cast("int").alias("query_pos"), "query", "used_identifier", "used_attributes")


def generate_queries(df: DataFrame, task: str, most: int, client: Callable[[], Completer], plan_rounds: int = 3, query_rounds: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Over (doc_id, doc, identifiers, attributes): doc_id, query_pos, query, used_identifier, used_attributes, at most ``most``
    a row. A document without identifiers or attributes gets no query; rows that share a doc_id are served each."""
    docs = stored(df.where((F.size("identifiers") > 0) & (F.size("attributes") > 0)).select("doc_id", "doc", "identifiers", "attributes", F.monotonically_increasing_id().alias("_row")), "planned-documents")
    queries = write(docs, plan(docs.drop("doc_id"), task, most, client, plan_rounds), task, client, query_rounds, chunk)
    return queries.join(docs.select("_row", "doc_id"), "_row").select("doc_id", "query_pos", "query", "used_identifier", "used_attributes")
