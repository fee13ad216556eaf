"""Values of loose JSON: language maps flattened to text, addresses collected."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Fixed value: keys of a language map, the preferred first. A present key wins even if its value is empty.
LANGUAGES = ("swe", "sv", "SWE", "eng", "en", "ENG")
_ADDRESS = re.compile(r"https?://[^\s\"'<>|]+")


def flatten(value) -> str:
    """Text of a JSON value: strings trimmed, numbers as written, lists and maps joined by `` | `` without blanks."""
    match value:
        case None:
            return ""
        case str():
            return value.strip()
        case list():
            parts = value
        case dict():
            chosen = next((k for k in LANGUAGES if k in value), None)
            if chosen is not None:
                return flatten(value[chosen])
            parts = list(value.values())
        case _:
            return str(value)
    return " | ".join(filter(None, map(flatten, parts)))


def addresses(value) -> list[str]:
    """All HTTP(S) addresses within a JSON value, in order, without repeats."""
    found: dict[str, None] = {}
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            found.update(dict.fromkeys(_ADDRESS.findall(v)))
        elif isinstance(v, (list, dict)):
            stack.extend(reversed(v if isinstance(v, list) else list(v.values())))
    return list(found)


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def flatten_json(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`flatten` of JSON text; null and broken JSON give an empty string."""
    for s in values:
        yield s.map(lambda v: flatten(_load(v)) if isinstance(v, str) else "")


@F.pandas_udf(ArrayType(StringType()))
def json_addresses(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in values:
        yield s.map(lambda v: addresses(_load(v)) if isinstance(v, str) else [])


def output_of(text: str | None) -> dict:
    """``{"output", "error"}`` of a stored model response: anything but a completed one with text is an error."""
    body = _load(text) if text else None
    if not isinstance(body, dict):
        return {"output": None, "error": "unreadable response"}
    if body.get("status") != "completed":
        return {"output": None, "error": f"status {body.get('status')}"}
    parts = [c for item in body.get("output") or [] if isinstance(item, dict) for c in item.get("content") or [] if isinstance(c, dict)]
    if any(c.get("type") == "refusal" for c in parts):
        return {"output": None, "error": "refusal"}
    found = "".join(c.get("text") or "" for c in parts if c.get("type") == "output_text")
    return {"output": found or None, "error": None if found else "empty output"}


@F.pandas_udf(StructType().add("output", StringType()).add("error", StringType()))
def decode_response(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([output_of(v) for v in values], columns=["output", "error"])


def cited_addresses(text: str | None) -> list[dict]:
    """``[{"url", "title"}]`` of a search response, out of its sources and citations, never out of prose.

    An address keeps its first place and takes its last title.
    """
    found: dict[str, str] = {}

    def visit(value):
        if isinstance(value, dict):
            if value.get("type") in ("url_citation", "url") and isinstance(value.get("url"), str):
                found[value["url"]] = value.get("title") or found.get(value["url"], "")
            for v in value.values():
                visit(v)
        elif isinstance(value, list):
            for v in value:
                visit(v)

    visit(_load(text) if text else None)
    return [{"url": u, "title": t} for u, t in found.items()]


@F.pandas_udf(ArrayType(StructType().add("url", StringType()).add("title", StringType())))
def search_results(values: pd.Series) -> pd.Series:
    return values.map(lambda v: cited_addresses(v) if isinstance(v, str) else [])
