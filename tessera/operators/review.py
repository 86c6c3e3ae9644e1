"""Rules with counts and protected terms, gender clues, characters, and models that chat."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessera.functions import text as T
from tessera.operators.rules import fixed_parts

# A word with what tells the start of a sentence: an end mark and white space, or a line break.
TOKEN = r"([.!?]\s|\n)?[\p{L}\p{N}_]+"
CHARACTER = "^[A-ZČĆŠĐŽА-Я][a-zčćšđžа-я]{2,}$"
# Capitalised words that are not names.
NOT_NAMES = [
    "ali", "jer", "dok", "kad", "što", "koji", "koja",
    "koje", "ovaj", "ova", "ovo", "taj", "ta", "to",
    "jedan", "jedna", "jedne", "ovdje", "tamo", "gdje",
]
NAME = r"[A-ZČĆŠĐŽА-Я][a-zA-ZčćšđžА-Я\-]{1,24}"


def characters(docs: DataFrame, keys: list[str], text: str = "text", least: int = 3) -> DataFrame:
    """keys, name and count of capitalised words inside sentences, from `least` on."""
    tokens = docs.select(*keys, F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("name"))
    named = tokens.where(F.col("name").rlike(CHARACTER) & ~F.lower("name").isin(NOT_NAMES))
    return named.groupBy(*keys, "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def counted_rewrite(docs: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Applies (pattern, replacement) pairs in order; adds `counts`, how often each one matched."""
    names = [f"_n{i}" for i in range(len(rules))]
    for name, (pattern, new) in zip(names, rules, strict=True):
        docs = docs.withColumn(name, F.regexp_count(text, F.lit(pattern)).cast("long")).withColumn(text, F.regexp_replace(text, pattern, new))
    return docs.withColumn("counts", F.array(*names)).drop(*names)


def protected(text: Column, terms: list[str], change) -> Column:
    """Applies a change to what lies between the terms of a glossary: whole words, whatever the case,
    longest first."""
    fixed = F.lit(fixed_parts(terms, tags=False))
    kept = F.regexp_extract_all(text, fixed, F.lit(0))
    return F.array_join(F.zip_with(F.transform(F.split(text, fixed, -1), change), kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def gender_clues(docs: DataFrame, verbs: dict[str, str], titles: dict[str, str], text: str = "text", stop: list[str] = ()) -> DataFrame:
    """name, clue ('M' or 'Ž') and place (the order of a text's clues) of every `Name je verb`, `verb je
    Name` and, whatever its case, `title Name`, with the columns of docs. verbs: male to female forms; titles: title to
    gender; stop: capitalised words that are not names."""
    found = []
    for gender, forms in (("M", list(verbs)), ("Ž", list(verbs.values()))):
        either = "|".join(sorted(forms, key=lambda v: (-len(v), v)))
        called = "|".join(t.replace(".", r"\.") for t in sorted((t for t, g in titles.items() if g == gender), key=lambda t: (-len(t), t)))
        patterns = [rf"(?U)\b({NAME})\s+(?:se\s+)?je\s+(?:{either})\b", rf"(?U)\b(?:{either})\s+je\s+({NAME})\b"]
        for pattern in patterns + ([rf"(?U)\b(?iu:{called})\s+({NAME})\b"] if called else []):
            names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
            found.append(F.arrays_zip(names.alias("name"), F.array_repeat(F.lit(gender), F.size(names)).alias("clue")))
    rows = docs.select(*(c for c in docs.columns if c != text), F.posexplode(F.concat(*found)).alias("place", "_c")).select("*", "_c.*").drop("_c")
    return rows.where(~F.col("name").isin(*stop)) if stop else rows


# Parts of names of models that do not chat.
NOT_CHAT = [
    "embed", "embedding", "rerank", "reranking", "whisper", "tts", "speech", "transcrib", "guard", "moderat",
    "imagen", "veo", "lyria", "aqa", "vision-only", "retrieval", "bert",
]
# What the names of a provider's chat models must hold, one of each list, and must not hold.
PROVIDER_WORDS = {
    "OPENROUTER": ([["%:free"]], []),
    "GEMINI": ([["%flash%", "%gemma-4%"]], ["pro", "ultra", "embed"]),
    "MISTRAL": ([], ["embed"]),
    "COHERE": ([["%command%"]], ["embed", "rerank"]),
    "FIREWORKS": ([], ["embedding"]),
    "TOGETHER": ([], ["embed", "rerank", "moderat"]),
    "GROQ": ([], ["whisper", "guard", "tts"]),
    "GITHUB": ([], ["embed", "text-embedding", "evaluation", "azureml://", "/registries/", "/versions/"]),
}


def chats(provider: Column, model: Column) -> Column:
    """Whether a provider's model is one to talk to, by its name."""
    name = F.lower(model)
    out = ~F.exists(F.array(*map(F.lit, NOT_CHAT)), lambda w: F.contains(name, w))
    for known, (wanted, unwanted) in PROVIDER_WORDS.items():
        fits = F.lit(True)
        for either in wanted:
            fits = fits & F.array_contains(F.array(*(name.like(w) for w in either)), True)
        for word in unwanted:
            fits = fits & ~F.contains(name, F.lit(word))
        out = out & ((F.upper(provider) != known) | fits)
    return out


def living(models: DataFrame, dead: DataFrame) -> DataFrame:
    """Models that are not dead; all models of a provider of which none is alive. Both: provider, model."""
    marked = models.join(dead.select("provider", "model", F.lit(True).alias("dead")).distinct(), ["provider", "model"], "left")
    alive = marked.groupBy("provider").agg(F.count_if(F.col("dead").isNull()).alias("alive"))
    return marked.join(alive, "provider").where(F.col("dead").isNull() | (F.col("alive") == 0)).drop("dead", "alive")


# What a text must score, how many of its words may have changed, how alike it must still be.
SKIP_SCORE, SKIP_CHANGE, SKIP_ALIKE = 8.5, 0.05, 0.92


def reaches(before: str, after: str, least: float) -> bool:
    """Whether difflib's ratio of two whole texts is `least` or more. Its matching blocks are found largest gaps
    first, until what is matched is enough, or all that is left could not be."""
    if before == after:
        return True
    total = len(before) + len(after)
    pairs = difflib.SequenceMatcher(None, before, after)
    if pairs.real_quick_ratio() < least or pairs.quick_ratio() < least:
        return False
    # Any order finds the same blocks: each gap is matched on its own.
    most = lambda gap: min(gap[1] - gap[0], gap[3] - gap[2])
    whole = (0, len(before), 0, len(after))
    gaps, matched, left = [(-most(whole), whole)], 0, most(whole)
    while 2.0 * matched / total < least <= 2.0 * (matched + left) / total:
        gap = heapq.heappop(gaps)[1]
        left -= most(gap)
        i, j, n = pairs.find_longest_match(*gap)
        if n:
            matched += n
            for part in ((gap[0], i, gap[2], j), (i + n, gap[1], j + n, gap[3])):
                if most(part):
                    heapq.heappush(gaps, (-most(part), part))
                    left += most(part)
    return 2.0 * matched / total >= least


def _alike(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([x is not None and y is not None and reaches(x, y, SKIP_ALIKE) for x, y in zip(a, b, strict=True)], dtype="bool")


def skips_corrector(score: Column, before: Column, after: Column) -> Column:
    """Whether a text that an editor hardly touched needs no corrector: by score, changed words, and
    likeness of the whole texts, which is looked at for the few that are left. No text, no score: no."""
    slight = (score >= SKIP_SCORE) & (F.length(before) > 0) & (F.length(after) > 0) & (T.word_change(before, after) <= SKIP_CHANGE)
    # Texts that changed more are not sent, and so not alike: the change is worked out below the function only.
    # Of equal texts nothing need be sent: two empty ones are equal, too.
    sent = lambda c: F.when(slight, F.when(before != after, c).otherwise(""))
    return F.pandas_udf(_alike, BooleanType())(sent(before), sent(after))
