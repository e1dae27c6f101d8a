"""Nested values: JSON and literals that may be neither, flattening, and hashes that don't depend on key order."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pantrylake.functions.fixed import VOLATILE_KEYS

READERS = (json.loads, ast.literal_eval)


def loose_object(text: str | None) -> dict[str, Any]:
    """An object written as JSON or as a Python literal, or a string that holds one; else {}."""
    left = [text]
    while left:
        value = left.pop()
        if isinstance(value, dict):
            return value
        if not value or not isinstance(value, str):
            continue
        found = []
        for read in READERS:
            try:
                found.append(read(value))
            except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
                continue
        left += [v for v in reversed(found) if v != value]
    return {}


def model_answer(text: str | None) -> dict[str, Any]:
    """A model's answer: the whole text or what stands between its outer braces as JSON, else the text as a name at 0.6."""
    text = (text or "").strip()
    for part in (text, text[text.find("{") : text.rfind("}") + 1]):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return {"canonical_name": text.strip('"'), "confidence_score": 0.6, "explanation": "free-text model response"} if text else {}


def leaves(value: Any) -> list[str]:
    """All values inside lists and objects as strings, in order; nulls left out."""
    if value is None:
        return []
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else None
    return [str(value)] if inner is None else [x for v in inner for x in leaves(v)]


def without_volatile(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: without_volatile(v) for k, v in value.items() if k not in VOLATILE_KEYS}
    return [without_volatile(v) for v in value] if isinstance(value, list) else value


def _each(kind: T.DataType, f):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield v.map(f, na_action="ignore")

    return run


def _digest(text: str) -> str:
    body = json.dumps(without_volatile(json.loads(text)), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()


_hash = _each(T.StringType(), _digest)
_object = _each(T.StringType(), lambda s: json.dumps(loose_object(s), default=str))
_answer = _each(T.StringType(), lambda s: json.dumps(model_answer(s), default=str))
_leaves = _each(T.ArrayType(T.StringType()), lambda s: leaves(json.loads(s)))


def stable_hash(c: Column) -> Column:
    """SHA-256 of a JSON text without volatile keys at any depth, keys sorted, compact, in ASCII."""
    return _hash(c)


def as_object(c: Column) -> Column:
    """JSON text of the object that c holds in some spelling, "{}" where it holds none; proper JSON objects stay in the JVM."""
    plain = F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    return F.when(plain, F.to_json(F.try_parse_json(c))).otherwise(F.coalesce(_object(F.when(~plain, c)), F.lit("{}")))


def as_answer(c: Column) -> Column:
    return _answer(c)


def flat_strings(c: Column) -> Column:
    """The values of a JSON text as an array of strings."""
    return _leaves(c)


def scrape_hash(title: Column, url: Column, ingredients: Column, steps: Column) -> Column:
    """SHA-256 of a scraped record's JSON, keys in order, as other tools write it (", " and ": " between, no escapes)."""

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    listed = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, quoted), ", "), F.lit("]"))
    body = F.concat(
        F.lit('{"ingredients": '), listed(ingredients), F.lit(', "source_url": '), quoted(F.trim(url)), F.lit(', "steps": '), listed(steps), F.lit(', "title": '), quoted(F.lower(F.trim(title))), F.lit("}")
    )
    return F.sha2(body, 256)


def token_cost(prompt: Column, answer: Column, in_per_1k: float, out_per_1k: float, prompt_tokens: Column | None = None, answer_tokens: Column | None = None) -> Column:
    """Cost by token counts, or a quarter of the characters where there are none."""
    guess = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4))
    tokens = [F.coalesce(n, guess(c)) if n is not None else guess(c) for n, c in ((prompt_tokens, prompt), (answer_tokens, answer))]
    return F.round(tokens[0] / 1000 * in_per_1k + tokens[1] / 1000 * out_per_1k, 8)
