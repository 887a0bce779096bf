"""Validation of identifiers, attributes, plans and queries with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank


def first_by(items: Column, key) -> Column:
    """Items whose key no earlier item has, in order."""
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, 1, i), lambda y: key(y) == key(x)))


def identifiers(structs: Column, strings: Column) -> Column:
    """Structs (type, identifier, label), and bare strings whose label is their first 48 characters; first per identifier."""
    bare = F.transform(F.coalesce(strings, F.array().cast("array<string>")), lambda s: F.struct(F.lit(None).cast("string").alias("type"), F.trim(s).alias("identifier"), F.substring(F.trim(s), 1, 48).alias("label")))
    given = F.coalesce(structs, F.array().cast("array<struct<type:string,identifier:string,label:string>>"))
    return first_by(F.filter(F.concat(given, bare), lambda x: ~blank(x.identifier)), lambda x: x.identifier)


def attributes(items: Column) -> Column:
    """Structs (dimension, options) with a dimension and at least one option; first per dimension."""
    kept = F.filter(F.transform(items, lambda x: F.struct(F.trim(x.dimension).alias("dimension"), F.filter(x.options, lambda o: ~blank(o)).alias("options"))), lambda x: ~blank(x.dimension) & (F.size(x.options) > 0))
    return first_by(kept, lambda x: x.dimension)


def valid_plan(used_ids: Column, used: Column, known_ids: Column, known: Column) -> Column:
    """One known identifier, and for every known dimension a listed option; used: map of dimension to option."""
    one = (F.size(used_ids) == 1) & F.coalesce(F.array_contains(known_ids, F.get(used_ids, 0)), F.lit(False))
    dims = F.transform(known, lambda x: x.dimension)
    same = (F.size(F.array_except(dims, F.map_keys(used))) == 0) & (F.size(F.array_except(F.map_keys(used), dims)) == 0)
    listed = F.forall(known, lambda x: F.coalesce(F.array_contains(x.options, F.try_element_at(used, x.dimension)), F.lit(False)))
    return F.coalesce(one & same & listed, F.lit(False))


def known_only(used_ids: Column, known_ids: Column) -> Column:
    return F.array_intersect(used_ids, known_ids)


def valid_query(query: Column, used: Column, known: Column) -> Column:
    """Text, and at least one attribute, all of them known with a listed option."""
    fine = F.forall(F.map_entries(used), lambda e: F.exists(known, lambda x: (x.dimension == e.key) & F.array_contains(x.options, e.value)))
    return F.coalesce(~blank(query) & (F.size(used) > 0) & fine, F.lit(False))


def plan_key(ids: Column, used: Column) -> Column:
    """One text for plans that use the same identifiers and attribute values."""
    pairs = F.transform(F.array_sort(F.map_entries(used)), lambda e: F.concat(e.key, F.lit("="), e.value))
    return F.concat(F.array_join(F.array_sort(ids), ","), F.lit("|"), F.array_join(pairs, ","))
