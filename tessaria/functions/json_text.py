"""TXT-29: rows that a model gave as JSON somewhere in its prose, in one Arrow function.

Every bracket that opens a readable JSON value is a start; the first value with a container of rows decides. Containers
are a list, one row, a list under a key, and any of these in an envelope, three envelopes deep at most.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys of lists of rows, the first of which may be a list written as a string, and of envelopes.
LISTS = ("candidates", "items", "results", "records")
ENVELOPES = ("data", "result", "output", "payload", "response")
_OPENS, _READER = re.compile(r"[\[{]"), json.JSONDecoder()


def _read(text: str, at: int = 0):
    """The JSON value that starts there, or None (as for null) if there is none or it nests too deeply to be read."""
    try:
        return _READER.raw_decode(text, at)[0]
    except (ValueError, RecursionError):
        return None


def _unwrapped(value, envelopes, depth: int) -> Iterator:
    yield value
    if isinstance(value, dict) and depth:
        for key in envelopes:
            if key in value:
                yield from _unwrapped(value[key], envelopes, depth - 1)


def _rows_of(text: str, fields: tuple[str, str], lists, envelopes) -> list[dict]:
    def whole(row) -> bool:
        return isinstance(row, dict) and all(str(row.get(f) or "").strip() for f in fields)

    def held(value):
        if isinstance(value, dict):
            first = value.get(lists[0])
            first = _read(first.strip()) if isinstance(first, str) else first
            if isinstance(first, list):
                return [r for r in first if whole(r)]
            if whole(value):
                return [value]
        options = [value] if isinstance(value, list) else [value.get(k) for k in lists[1:]] if isinstance(value, dict) else []
        for option in options:
            if isinstance(option, list) and (not option or any(map(whole, option))):
                return [r for r in option if whole(r)]
        return None

    for start in _OPENS.finditer(text):
        for value in _unwrapped(_read(text, start.start()), envelopes, 3):
            rows = held(value)
            if rows is not None:
                return rows
    return []


def json_rows(c: Column, fields: tuple[str, str] = ("evidence_id", "exact_quote"), lists: tuple[str, ...] = LISTS, envelopes: tuple[str, ...] = ENVELOPES) -> Column:
    """array<struct<evidence_id, quote, row>>: the rows that have both fields, row as JSON. Fields that are no strings are
    written as Python writes them. Null text, text without JSON and JSON without such rows give an empty array."""

    @F.pandas_udf("array<struct<evidence_id:string,quote:string,row:string>>")
    def read(texts: pd.Series) -> pd.Series:
        give = lambda r: {"evidence_id": str(r[fields[0]]), "quote": str(r[fields[1]]), "row": json.dumps(r, ensure_ascii=False)}
        return pd.Series([[] if t is None else [give(r) for r in _rows_of(t, fields, lists, envelopes)] for t in texts], dtype=object)

    return read(c)
