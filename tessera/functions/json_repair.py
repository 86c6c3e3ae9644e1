"""JSON objects in answers that are not quite JSON: with words around them, in fences, with Python's
quotes, loose commas, bare control characters, or several at once."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"^\s*```\w*[ \t]*\n?|```\s*$", re.MULTILINE)
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_TYPOGRAPHIC = str.maketrans("„“”‟«»‘’‚‛", '""""""\'\'\'\'')
_WORDS = {"True": "true", "False": "false", "None": "null"}


def _object(text: str) -> dict | None:
    try:
        out = json.loads(text, strict=False)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def spans(text: str) -> list[tuple[int, int]]:
    """Balanced `{...}` that no other one holds. Braces within strings are none; quotes outside of
    braces are just quotes. A brace that is never closed is passed over, and what it holds is looked at."""
    out, at = [], 0
    while (at := text.find("{", at)) >= 0:
        depth, i, quoted = 0, at, False
        while i < len(text):
            c = text[i]
            if quoted:
                i += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    break
            i += 1
        if i < len(text) and not depth:
            out.append((at, i + 1))
            at = i + 1
        else:
            at += 1
    return out


def repaired(text: str) -> str:
    """Strings in double quotes whichever they had, no comma before a closing bracket, JSON's names
    for true, false and null. A quote ends a string if a mark of JSON or the end follows."""
    out: list[str] = []
    i = 0
    while i < len(text):
        c = text[i]
        if c in "\"'":
            j, held = i + 1, []
            while j < len(text):
                if text[j] == "\\" and j + 1 < len(text):
                    held.append("'" if text[j + 1] == "'" else text[j : j + 2])
                    j += 2
                    continue
                if text[j] == c and re.match(r"\s*(?:[,:}\]]|$)", text[j + 1 : j + 40]):
                    break
                held.append('\\"' if text[j] == '"' else text[j])
                j += 1
            out.append('"' + "".join(held) + '"')
            i = j + 1
        elif c.isalpha():
            word = re.match(r"\w+", text[i:])[0]
            out.append(_WORDS.get(word, word))
            i += len(word)
        elif c in "}]":
            while out and out[-1].isspace():
                out.pop()
            if out and out[-1] == ",":
                out.pop()
            out.append(c)
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def parsed(text: str | None) -> dict | None:
    """The object in an answer: as it is, without fences, the longest balanced one that parses, what
    is between the first and the last brace, and then the same as Python writes it, and repaired."""
    if not text or "{" not in text:
        return None
    bare = _FENCE.sub("", text).strip()
    for whole in (text.strip(), bare):
        if (out := _object(whole)) is not None:
            return out
    inner = sorted((text[a:b] for a, b in spans(text)), key=len, reverse=True)
    first, last = text.find("{"), text.rfind("}")
    if last > first:
        inner.append(_CONTROL.sub(" ", text[first : last + 1]))
    for part in inner:
        if (out := _object(part)) is not None:
            return out
    for part in inner:
        try:
            made = ast.literal_eval(part)
            if isinstance(made, dict):
                return json.loads(json.dumps(made, default=str))
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            pass
        for version in (part, part.translate(_TYPOGRAPHIC)):
            if (out := _object(repaired(version))) is not None:
                return out
    return None


def _robust(answers: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in answers:
        yield batch.map(lambda t: None if (out := parsed(t)) is None else json.dumps(out, ensure_ascii=False))


def robust_json(answer: Column) -> Column:
    """The object in an answer as JSON, or null."""
    return F.pandas_udf(_robust, StringType())(answer)
