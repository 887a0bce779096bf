"""The few functions that built-in expressions cannot state: recursive JSON, brace matching, broken surrogates."""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .json5 import strict_json

# Keys whose text stands for a whole record, in this order.
TEXT_KEYS = ("title", "text", "content", "contents", "abstract", "body", "answer", "evidence", "snippet", "summary", "description", "judgment", "judgement", "fact", "facts")


def flat_text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, dict):
        known = [t for k in TEXT_KEYS if k in value and (t := flat_text(value[k]))]
        return "\n".join(known or [f"{k}: {t}" for k, v in value.items() if (t := flat_text(v))])
    if isinstance(value, list):
        return "\n".join(t for v in value if (t := flat_text(v)))
    return str(value)


@F.pandas_udf(StringType())
def textify(values: pd.Series) -> pd.Series:
    """Any JSON value as text; what is no JSON is text already."""

    def one(raw):
        try:
            return flat_text(json.loads(raw)) if raw is not None else ""
        except ValueError:
            return raw.strip()

    return values.map(one)


def last_balanced(raw: str | None) -> str | None:
    """From the last ``}`` back to the ``{`` that closes the count of braces; none if the count never closes."""
    braces = [(m.start(), 1 if m.group() == "{" else -1) for m in re.finditer(r"[{}]", raw or "")]
    while braces and braces[-1][1] > 0:
        braces.pop()
    depth = accumulate(d for _, d in reversed(braces))
    start = next((place for (place, _), d in zip(reversed(braces), depth, strict=True) if d == 0), None)
    return None if start is None else raw[start : braces[-1][0] + 1]


@F.pandas_udf(StringType())
def balanced(values: pd.Series) -> pd.Series:
    return values.map(last_balanced)


def last_object(raw: Column) -> Column:
    """The last balanced ``{...}``, if it can be read as an object: with single quotes, bare keys, comments and trailing
    commas too. Nothing before it is tried."""
    found = balanced(raw)
    return F.when(strict_json(found).isNotNull(), found)


@F.pandas_udf(StringType())
def repair(values: pd.Series) -> pd.Series:
    """Lone surrogates, as escapes in JSON may leave them, become U+FFFD."""
    return values.map(lambda x: x if x is None else x.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
