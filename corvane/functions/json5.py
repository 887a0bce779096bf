"""JSON5 as strict JSON: what language models write where JSON was asked for.

Texts that are strict JSON already stay in the JVM; only the others go, in Arrow batches, to a reader with states for
strings, escapes, comments and numbers. Nothing inside a string is ever taken for structure.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_GAP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_STRING = re.compile(r""""((?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*)"|'((?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*)'""")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|[\n\r\u2028\u2029])|(0(?![0-9]))|([\s\S]))")
_NUMBER = re.compile(r"([+-]?)(?:(0[xX][0-9A-Fa-f]+)|((?:0|[1-9][0-9]*)(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)|(Infinity)|(NaN))(?![\w$.])")
_NAME = re.compile(r"(?:[^\W\d]|\$|\\u[0-9A-Fa-f]{4})(?:[\w$\u200c\u200d]|\\u[0-9A-Fa-f]{4})*")
_WORDS = {"null": None, "true": True, "false": False}
_SINGLE = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_FENCE = re.compile(r"```[ \t]*(?:[A-Za-z][\w+-]*)?")


class _Reader:
    """One value from a place in a text on; lists and objects that are open stand on a stack."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def gap(self) -> str:
        """Past white space and comments; the sign there, or nothing at the end."""
        self.at = _GAP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def fail(self) -> ValueError:
        return ValueError(f"unexpected {self.text[self.at : self.at + 12]!r} at {self.at}" if self.at < len(self.text) else "unexpected end")

    def string(self) -> str:
        found = _STRING.match(self.text, self.at)
        if not found:
            raise self.fail()
        inner = found.group(1) if found.group(1) is not None else found.group(2)
        if "\\" in inner:
            inner = _ESCAPE.sub(self._escaped, inner)
            # halves of a pair become one character; a half alone has no meaning
            inner = inner.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        self.at = found.end()
        return inner

    def _escaped(self, m: re.Match) -> str:
        code, byte, line, zero, other = m.groups()
        if code or byte:
            return chr(int(code or byte, 16))
        if line:
            return ""
        if zero:
            return "\0"
        if other in "123456789ux0":
            raise ValueError(f"bad escape \\{other} at {self.at}")
        return _SINGLE.get(other, other)

    def key(self) -> str:
        if self.gap() in ('"', "'"):
            return self.string()
        found = _NAME.match(self.text, self.at)
        if not found:
            raise self.fail()
        self.at = found.end()
        return _ESCAPE.sub(self._escaped, found.group())

    def plain(self) -> object:
        """A string, number or word."""
        if self.text[self.at : self.at + 1] in ('"', "'"):
            return self.string()
        number = _NUMBER.match(self.text, self.at)
        if number:
            self.at = number.end()
            sign, whole, decimal, infinity, _ = number.groups()
            if whole or decimal:
                value = int(whole, 16) if whole else int(decimal) if decimal.isdigit() else float(decimal)
            else:
                value = float("inf") if infinity else float("nan")
            return -value if sign == "-" else value
        word = _NAME.match(self.text, self.at)
        if not word or word.group() not in _WORDS:
            raise self.fail()
        self.at = word.end()
        return _WORDS[word.group()]

    def value(self) -> object:
        stack: list[tuple[dict | list, str | None]] = []
        while True:
            sign = self.gap()
            if sign in ("{", "[") and sign:
                self.at += 1
                held: dict | list = {} if sign == "{" else []
                if self.gap() == ("}" if sign == "{" else "]"):
                    self.at += 1
                    done: object = held
                else:
                    stack.append((held, self._named(held)))
                    continue
            else:
                done = self.plain()
            while stack:
                held, name = stack.pop()
                if isinstance(held, dict):
                    held[name] = done
                else:
                    held.append(done)
                end, sign = "}" if isinstance(held, dict) else "]", self.gap()
                if sign == ",":
                    self.at += 1
                    sign = self.gap()
                    if sign != end:
                        stack.append((held, self._named(held)))
                        break
                if sign != end:
                    raise self.fail()
                self.at += 1
                done = held
            else:
                return done

    def _named(self, held: dict | list) -> str | None:
        """The key of the next member, with its colon; items of lists have none."""
        if isinstance(held, list):
            return None
        name = self.key()
        if self.gap() != ":":
            raise self.fail()
        self.at += 1
        return name


def loads(text: str) -> object:
    """The value that a whole text is; raises ValueError with the place where it is not. Of equal keys the last counts."""
    reader = _Reader(text)
    found = reader.value()
    if reader.gap():
        raise reader.fail()
    return found


def fenced(text: str) -> object:
    """The value of a whole text, or else the first value that stands, with nothing else, in a Markdown code fence. Where
    neither can be read, raises what is wrong with the first fence, or else with the text."""
    try:
        return loads(text)
    except ValueError as e:
        wrong = e
    fence, first = _FENCE.search(text), True
    while fence:
        reader = _Reader(text, fence.end())
        try:
            found = reader.value()
            if reader.gap() == "`" and text.startswith("```", reader.at):
                return found
            raise reader.fail()
        except ValueError as e:
            wrong, first = (e if first else wrong), False
        fence = _FENCE.search(text, fence.end())
    raise wrong


def strict(text: str | None) -> str | None:
    """The text's value as strict JSON, but for Infinity and NaN; null if it has none."""
    if text is None:
        return None
    try:
        return json.dumps(fenced(text), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def problem(text: str | None) -> str | None:
    """Why no value can be read; null if one can."""
    if text is None:
        return "no answer"
    try:
        fenced(text)
    except ValueError as e:
        return str(e)
    return None


@F.pandas_udf(StringType())
def _strict(values: pd.Series) -> pd.Series:
    return values.map(strict, na_action="ignore")


@F.pandas_udf(StringType())
def _problem(values: pd.Series) -> pd.Series:
    return values.map(problem, na_action="ignore")


def is_strict(x: Column) -> Column:
    """Whether a text is one JSON value as it stands. Spark's parser stops behind the first value, so the text is put into a
    list, which has to end where it should."""
    listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit(", 0]")))
    ends = (F.try_variant_get(listed, "$[1]", "int") == 0) & F.variant_get(listed, "$[2]", "variant").isNull()
    return F.coalesce(ends, F.lit(False))


def strict_json(x: Column) -> Column:
    """JSON5, bare or in a code fence, as strict JSON; strict JSON stays as it is, null where no value can be read."""
    return F.when(is_strict(x), x).otherwise(_strict(F.when(~is_strict(x), x)))


def json_problem(x: Column) -> Column:
    """Why a text has no JSON5 value; null where it has one."""
    return F.when(x.isNull(), "no answer").otherwise(_problem(F.when(~is_strict(x), x)))
