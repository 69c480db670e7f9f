"""Repair of malformed JSON from language models: parsers for whole columns."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that may hold the reasoning, in order; the first is the expected one
THINK_KEYS = ("think", "reasoning", "thinking", "thought", "analysis", "rationale")
LIST_KEYS = ("data", "translations", "results", "items")


def strict(s: str) -> Any:
    try:
        return json.loads(s)
    except (ValueError, RecursionError):
        return None


def unfenced(s: str) -> str:
    """Without a surrounding code fence and its language tag."""
    m = re.match(r"\s*```[A-Za-z]*\s*", s)
    return re.sub(r"\s*`*\s*$", "", s[m.end() :]) if m else s.strip()


def span(s: str, opening: str, closing: str) -> str | None:
    """From the first opening bracket to the last closing one, or to the end if none follows."""
    start = s.find(opening)
    if start < 0:
        return None
    end = s.rfind(closing)
    return s[start : end + 1] if end > start else s[start:]


def without_trailing_commas(s: str) -> str:
    """Commas inside strings stay."""
    return re.sub(r'("(?:[^"\\]|\\.)*(?:"|$))|,\s*(?=[}\]])', lambda m: m[1] or "", s, flags=re.S)


def closed(s: str) -> str:
    """With the quote and brackets that a cut-off text still owes."""
    owed: list[str] = []
    for m in re.finditer(r'"(?:[^"\\]|\\.)*("|$)|[{}\[\]]', s, re.S):
        token = m[0]
        if token[0] == '"':
            if not m[1]:
                s += '"'
        elif token in "{[":
            owed.append("}" if token == "{" else "]")
        elif owed and owed[-1] == token:
            owed.pop()
    return s + "".join(reversed(owed))


def lenient(s: str) -> Any:
    """Single quotes and bare keys, as JSON5 has them; null where a string holds a quote of the other kind."""
    if '"' in s:
        return strict(re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', s))
    return strict(re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', s.replace("'", '"')))


def loads_robust(text: str | None) -> dict | None:
    """A JSON object from a messy text: strict, then the outermost object without its fence, then without trailing commas, then closed. Null if all fail."""
    if not text or not text.strip():
        return None
    whole = strict(text)
    if isinstance(whole, dict):
        return whole
    part = span(unfenced(text), "{", "}")
    if part is None:
        return None
    shut = closed(part)
    for s in dict.fromkeys((part, without_trailing_commas(part), shut, without_trailing_commas(shut))):
        for parse in (strict, lenient):
            found = parse(s)
            if isinstance(found, dict):
                return found
    return None


def extract_think(text: str | None, keys: tuple[str, ...] = THINK_KEYS) -> tuple[str | None, str]:
    """The reasoning and ''; or null and `empty_think` (an object without it) or `json_parse_failed`."""
    found = loads_robust(text)
    for k in keys if found else ():
        if isinstance(found.get(k), str) and found[k].strip():
            return found[k].strip(), ""
    for k in keys:
        m = re.search(rf'"{k}"\s*:\s*"((?:[^"\\]|\\.)*)"', text or "", re.S)
        if m:
            value = strict(f'"{m[1]}"')
            value = value if isinstance(value, str) else m[1]
            if value.strip():
                return value.strip(), ""
    return None, "json_parse_failed" if found is None else "empty_think"


def parse_array(text: str | None, keys: tuple[str, ...] = LIST_KEYS, wrap: bool = True) -> list | None:
    """A list from a response: a bare list, a list under one of the keys, an object alone (if wrap), or the outermost list in the text, repaired."""
    s = unfenced(text or "")
    whole = strict(s)
    if isinstance(whole, list):
        return whole
    if isinstance(whole, dict):
        inner = next((whole[k] for k in keys if isinstance(whole.get(k), list)), None)
        return inner if inner is not None else [whole] if wrap else next((v for v in whole.values() if isinstance(v, list)), [])
    part = span(s, "[", "]")
    if part is None:
        return None
    for x in (part, without_trailing_commas(part)):
        if isinstance(found := strict(x), list):
            return found
    cut = without_trailing_commas(part)
    last = cut.rfind("},")
    found = strict(cut[: last + 1] + "]") if last >= 0 else None  # without the object that was cut off
    return found if isinstance(found, list) else None


def repaired(col: str) -> Column:
    """The repaired object as JSON with sorted keys, or null."""

    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (d := loads_robust(t)) is None else json.dumps(d, ensure_ascii=False, sort_keys=True))

    return F.pandas_udf(f, "string")(col)


def think(col: str) -> Column:
    """struct of think and reason."""

    def f(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_think(t) for t in texts], columns=["think", "reason"])

    return F.pandas_udf(f, "struct<think: string, reason: string>")(col)


def array_items(col: str) -> Column:
    """The items of a response's list, each as JSON; null if there is none."""

    def f(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (a := parse_array(t)) is None else [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in a])

    return F.pandas_udf(f, "array<string>")(col)
