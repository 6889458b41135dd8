"""JSON texts: canonical form, paths, and keys at any depth."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _each(texts: pd.Series, make: Callable[[object], str | None]) -> pd.Series:
    """make of every JSON of the texts; null for what is no JSON, or cannot be written as UTF-8."""

    def one(text: str | None) -> str | None:
        try:
            out = None if text is None else make(json.loads(text))
            return out if out is None else out.encode().decode()
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def canonical(text: Column) -> Column:
    """The JSON with its keys sorted by code point and no white space, numbers in
    the form they have (1.0 is not 1), the last of repeated keys; null if it is no JSON."""

    @F.pandas_udf(T.StringType())
    def write(texts: pd.Series) -> pd.Series:
        return _each(texts, lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")))

    return write(text)


def canonical_sha(text: Column) -> Column:
    """SHA-256 of the canonical form, the same for every order of keys and spacing."""
    return F.sha2(canonical(text), 256)


def at_path(text: Column, path: str) -> Column:
    """The value at a dotted path: a part is a key where it stands on an object, a
    place where it stands on a list and is of digits. Text as it is, other values
    as JSON; null where there is none."""
    parts = path.split(".")

    def walk(value: object) -> str | None:
        for part in parts:
            if isinstance(value, dict):
                value = value.get(part)
            elif isinstance(value, list) and part.isdecimal() and int(part) < len(value):
                value = value[int(part)]
            else:
                return None
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf(T.StringType())
    def find(texts: pd.Series) -> pd.Series:
        return _each(texts, walk)

    return find(text)


def _values(found: object, key: str) -> Iterator[object]:
    inner = found.values() if isinstance(found, dict) else found if isinstance(found, list) else ()
    if isinstance(found, dict) and key in found:
        yield found[key]
    for one in inner:
        yield from _values(one, key)


def values_of(text: Column, key: str) -> Column:
    """All values of a key anywhere in the JSON, as JSON texts; none where it is no JSON."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def find(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            try:
                return [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in _values(json.loads(t or "null"), key)]
            except ValueError:
                return []

        return pd.Series([one(t) for t in texts])

    return find(text)


def round_trip(text: Column) -> Column:
    """Whether a JSON text comes back the same after it was kept as a variant
    column: what the variant writes has the stored text's canonical form."""
    return F.coalesce(canonical(F.to_json(F.try_parse_json(text))) == canonical(text), F.lit(False))
