"""Parameters for, and answers from, language services."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import outside_tags

# Fixed values: (role, block type) to (added temperature, cap); no cap means a set temperature.
WARMER = {
    ("LEKTOR", "dijalog"): (0.15, 0.72), ("LEKTOR", "poetski"): (0.25, 0.82), ("LEKTOR", "opis"): (0.05, 0.55),
    ("GUARDIAN", "dijalog"): (0.15, 0.72), ("GUARDIAN", "poetski"): (0.25, 0.82), ("GUARDIAN", "opis"): (0.05, 0.55),
    ("POLISH", "poetski"): (0.85, None), ("POLISH", "dijalog"): (0.75, None), ("POLISH", "opis"): (0.60, None),
    ("PREVODILAC", "dijalog"): (0.08, 0.30), ("PREVODILAC", "poetski"): (0.15, 0.38),
}


def temperature(role: Column, kind: Column, base: Column) -> Column:
    out = base
    for (r, k), (value, cap) in WARMER.items():
        fits = (role == r) & (kind == k)
        out = F.when(fits, F.least(base + value, F.lit(cap)) if cap is not None else F.lit(value)).otherwise(out)
    return out


def provider_of(model: Column, known: list[str]) -> Column:
    """The provider in a model's name: after a version prefix, or the first known one within."""
    named = F.upper(F.nullif(F.regexp_extract(model, r"^v\d+/([^/]+)/", 1), F.lit("")))
    found = F.lit(None).cast("string")
    for name in reversed(known):
        found = F.when(F.upper(model).contains(name), name).otherwise(found)
    return F.coalesce(named, found, F.lit("unknown"))


def response_text(body: Column) -> Column:
    """The answer in a service's JSON, whichever of three shapes it has."""
    parts = F.from_json(F.get_json_object(body, "$.candidates[0].content.parts"), "array<struct<text:string,thought:boolean>>")
    spoken = F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: p["text"]), "")
    return F.coalesce(F.nullif(spoken, F.lit("")), F.get_json_object(body, "$.message.content[0].text"), F.get_json_object(body, "$.choices[0].message.content"), F.lit(""))


def tokens_used(body: Column) -> Column:
    paths = ["$.usageMetadata.totalTokenCount", "$.usage.total_tokens", "$.meta.tokens.output_tokens"]
    return F.coalesce(*(F.get_json_object(body, p).try_cast("long") for p in paths), F.lit(0).cast("long"))


def judged_score(answer: Column) -> Column:
    """`ocjena` of the first JSON object if within 1 to 10, else the mean of its criteria."""
    found = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    score = F.get_json_object(found, "$.ocjena").try_cast("double")
    parts = F.map_values(F.from_json(F.get_json_object(found, "$.kriteriji"), "map<string,double>"))
    mean = F.round(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts)), 1)
    return F.when(score.between(1, 10), score).otherwise(mean)


def cleaned(text: Column) -> Column:
    """Without fenced blocks, placeholders, page wrappers and chat markers."""
    out = F.regexp_replace(text, r"(?s)```.*?```", "")
    out = F.regexp_replace(out, "<OVDJE_IDI_[^>]*>", "")
    body = F.regexp_extract(out, r"(?is)<body[^>]*>(.*)</body>", 1)
    out = F.when(F.length(F.trim(body)) > 0, body).otherwise(out)
    return F.btrim(F.regexp_replace(out, r"(?m)^\s*(user|assistant|system):\s*", ""), F.lit(" \t\n\r"))


def joined_words(text: Column) -> Column:
    """A gap between a small and a capital letter, none after a lone capital, single spaces."""
    out = F.regexp_replace(text, r"(?<=[a-zčćšžđ])(?=[A-ZČĆŠŽĐ])", " ")
    out = F.regexp_replace(out, r"(?U)\b([A-ZČĆŠŽĐ])\s+([a-zčćšžđ]{2,})", "$1$2")
    return F.regexp_replace(out, r"[^\S\n]{2,}", " ")


def renamed(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole-word replacement of names, longest first, that keeps capitals: ALL, Title or as given."""
    forms = [f for old, new in sorted(pairs, key=lambda p: (-len(p[0]), p[0])) for f in ((old.upper(), new.upper()), (old.lower(), new.lower()), (old, new))]

    def change(piece: Column) -> Column:
        for form, to in forms:
            piece = F.regexp_replace(piece, rf"(?U)\b\Q{form}\E\b", to)
        return piece

    return outside_tags(text, change)
