"""Free-form JSON at any depth: a walk over its parts, repeated keys, recursive redaction.

Built-in functions see the top level of a free-form text, or refuse a repeated
key without saying where. A text is parsed once, its pairs kept in order and
with their repeats, and walked with a stack. Only that walk is Python; which
keys repeat, and where, is counted by Spark from its rows.

A path is a JSON pointer. A text that does not parse, or nests deeper than the
parser goes, is one row of kind `malformed`; NULL is malformed. Numbers keep
their digits. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridlark.functions.text import BEARER_PATTERN, EMAIL_PATTERN, LONG_TEXT, MANY_LINES, SENSITIVE_KEYS, SENSITIVE_MARKERS

WALK = "path string, parent string, key string, position int, depth int, kind string, value string"


class Pairs(list):
    """An object's (key, value) pairs in order, repeats kept."""


class Digits(str):
    """A number as it is written."""


def parsed(text: str | None) -> object:
    """The parts of a JSON text; ValueError where it is none."""
    if text is None:
        raise ValueError("no text")
    try:
        return json.loads(text, object_pairs_hook=Pairs, parse_int=Digits, parse_float=Digits, parse_constant=Digits)
    except RecursionError as deep:
        raise ValueError("nested too deep") from deep


def _kind(part: object) -> str:
    if isinstance(part, Pairs):
        return "object"
    if isinstance(part, list):
        return "array"
    if isinstance(part, Digits):
        return "number"
    return {str: "string", bool: "boolean", type(None): "null"}[type(part)]


def walked(text: str | None) -> Iterator[tuple]:
    """WALK rows of one text in document order."""
    try:
        stack: list[tuple] = [("", None, None, 0, 0, parsed(text))]
    except ValueError:
        yield ("", None, None, 0, 0, "malformed", None)
        return
    while stack:
        path, parent, key, position, depth, part = stack.pop()
        kind = _kind(part)
        plain = json.dumps(part) if kind in ("boolean", "null") else str(part) if kind in ("string", "number") else None
        yield (path, parent, key, position, depth, kind, plain)
        inner = part if kind == "object" else [(str(i), p) for i, p in enumerate(part)] if kind == "array" else []
        for place in range(len(inner) - 1, -1, -1):
            name, value = inner[place]
            step = name.replace("~", "~0").replace("/", "~1")
            stack.append((f"{path}/{step}", path, name if kind == "object" else None, place, depth + 1, value))


def walk(df: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """A row per part of the JSON texts in `body`, with the columns to keep."""
    rows = df.select(*keep, F.col(body).cast("string").alias("_body"))
    schema = T.StructType([*(rows.schema[c] for c in keep), *T._parse_datatype_string(WALK).fields])
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                found, source = [], []
                for i, text in enumerate(part["_body"].to_pylist()):
                    made = list(walked(text))
                    found += made
                    source += [i] * len(made)
                kept = [part[c].take(pa.array(source, pa.int32())) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([f[j] for f in found], k) for j, k in enumerate(kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def repeated_keys(df: DataFrame, body: str, keep: Sequence[str]) -> DataFrame:
    """keep..., parent, key, copies of every key that an object holds more than once, at any depth.

    ``keep`` tells the texts apart. An object below a repeated key shares its
    path with its twin; their keys are told apart by the twins' positions.
    """
    parts = walk(df, body, keep).filter("key is not null")
    return parts.groupBy(*keep, "parent", "key").agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct("position").alias("_places")
    ).filter("_places > 1").drop("_places")


def _repeats(part: object) -> bool:
    stack = [part]
    while stack:
        now = stack.pop()
        if isinstance(now, Pairs):
            if len({k for k, _ in now}) < len(now):
                return True
            stack += [v for _, v in now]
        elif isinstance(now, list):
            stack += now
    return False


def shape(body: Column) -> Column:
    """MALFORMED, KEY_REPEATED (at any depth) or OK."""

    def judge(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                out.append("KEY_REPEATED" if _repeats(parsed(text)) else "OK")
            except ValueError:
                out.append("MALFORMED")
        return pd.Series(out)

    return F.pandas_udf(judge, "string")(body)


_BEARER, _EMAIL = re.compile(BEARER_PATTERN), re.compile(EMAIL_PATTERN)


def _sensitive(key: str) -> bool:
    plain = key.lower().replace("-", "_")
    return plain in SENSITIVE_KEYS or any(marker in plain for marker in SENSITIVE_MARKERS)


def _safe_text(text: str) -> str:
    clean = _EMAIL.sub("[REDACTED_EMAIL]", _BEARER.sub("Bearer [REDACTED]", text))
    if len(clean) > LONG_TEXT or clean.count("\n") > MANY_LINES:
        return f"[REDACTED_TEXT sha256={hashlib.sha256(clean.encode('utf-8', 'replace')).hexdigest()}]"
    return clean


def _written(part: object) -> str:
    """Canonical text of a redacted part: names in order, of repeated ones the last."""
    if isinstance(part, Pairs):
        last = dict(part)
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{'\"[REDACTED]\"' if _sensitive(k) else _written(last[k])}" for k in sorted(last)) + "}"
    if isinstance(part, list):
        return "[" + ",".join(map(_written, part)) + "]"
    if isinstance(part, Digits):
        return str(part)
    return json.dumps(_safe_text(part) if isinstance(part, str) else part, ensure_ascii=False)


def redacted_text(text: str | None) -> str | None:
    """One JSON text, safe for the standard log; NULL where it is none."""
    try:
        return _written(parsed(text))
    except (ValueError, RecursionError):
        return None


def redact_json(body: Column) -> Column:
    """Redaction of keys and texts at every depth of a JSON text; NULL where it does not parse, so nothing unread gets through."""
    return F.pandas_udf(lambda texts: pd.Series([redacted_text(t) for t in texts], dtype=object), "string")(body)
