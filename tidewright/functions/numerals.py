"""JSON texts whose numerals survive: written as they stand, whatever their length and scale.

Variants keep a number's value in 38 digits or a double and forget how it was written. `keep` therefore turns each
numeral outside strings into a marked string before the text becomes a variant; `json_text` turns it back.
`canonical` is the sorted form of a text that a hash is taken of. Both go over Arrow batches of texts.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A NUL, which no accepted document holds, and a sign: what a kept numeral's string begins with.
MARK = "\0#"
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*', re.S)
_NUMERAL = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"} | {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in "\n\r\t"}
_ESCAPED = re.compile('["\\\\\x00-\x1f]')


def _kept(text: str | None) -> str | None:
    def mark(found: re.Match) -> str:
        token = found[0]
        return f'"\\u0000#{token}"' if token[0] != '"' and _NUMERAL.fullmatch(token) else token

    return None if text is None else _TOKEN.sub(mark, text)


class _Numeral(str):
    """A numeral of a parsed text."""


def _object(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a name stands twice")
    return found


def _refuse(_: str) -> None:
    raise ValueError("not a JSON number")


def _numeral(text: str) -> str:
    """Numerals without an exponent stay as written; minus zero has no sign; an exponent is written as exact decimals are."""
    if "e" in text or "E" in text:
        return str(Decimal(text))
    return "0" if text == "-0" else text


def _written(value: object) -> str:
    if isinstance(value, _Numeral):
        return _numeral(value)
    if isinstance(value, str):
        return '"' + _ESCAPED.sub(lambda m: _ESCAPES[m[0]], value) + '"'
    if isinstance(value, dict):
        names = sorted(value, key=lambda n: n.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_written(n)}:{_written(value[n])}" for n in names) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    return {None: "null", True: "true", False: "false"}[value]


def canonical_json(text: str | None) -> str | None:
    """Names sorted by UTF-16 units, no spacing, numerals as written; None for what is no JSON text with single names."""
    if text is None:
        return None
    try:
        return _written(json.loads(text, parse_int=_Numeral, parse_float=_Numeral, parse_constant=_refuse, object_pairs_hook=_object))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _keep(texts: pd.Series) -> pd.Series:
    return texts.map(_kept)


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_json)


def keep(text: Column) -> Column:
    """The JSON text with each numeral as a marked string."""
    return _keep(text)


def canonical(text: Column) -> Column:
    """The canonical text; null for null and for what is no JSON."""
    return _canonical(text)


def marked(text: Column) -> Column:
    """Whether a variant's string is a kept numeral."""
    return text.startswith(MARK)


def written(text: Column) -> Column:
    """A kept numeral as it was written."""
    return F.substring(text, len(MARK) + 1, 2_147_483_647)


def json_text(value: Column) -> Column:
    """A variant as JSON text, its kept numerals as numerals again; null if missing."""
    return F.regexp_replace(F.to_json(value), r'"\\u0000#([-+.eE0-9]+)"', "$1")
