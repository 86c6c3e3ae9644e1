"""Quality rules with limits that adapt to each language and source. DataFrame functions only.

Every document gets a few measures. Per (lang, source), KLL sketches hold the distribution of
each measure over the documents that pass the base rule; the sketches are built per partition and
merged. A group of fewer than MIN_GROUP documents takes the merged sketches of its language, and a
language of fewer those of all documents. Limits are median +- WIDTH * max(q75 - q50, floor), so a
source where symbols or repeated lines are usual has wider limits than one where they are not;
nothing is cut at a fixed share. The limits, one row per group, are joined back and decide.

Null or empty texts have no words and fail the base rule. Null lang or source form groups of their
own. An empty table gives no rows. Repeated rows are judged each for itself, alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import fresh, materialise

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_GROUP = 50
SKETCH_K = 4096
# Measure: (least spread, width in spreads, whether the lower side counts too).
RULES = {
    "symbol_rate": (0.005, 4.0, False),
    "dup_line_rate": (0.1, 4.0, False),
    "repeat_rate": (0.05, 5.0, False),  # at least 0.25, within what the base rule lets pass
    "word_length": (0.25, 8.0, True),
}


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words within windows that occur twice or more: sorted by hash, equal windows are neighbours."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(pairs: Column) -> Column:
        marked = F.filter(
            pairs,
            lambda x, j: (F.get(pairs, j - 1)["h"] == x["h"]) & (j > 0) | F.coalesce(F.get(pairs, j + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(marked, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    # One-element transforms bind each array once.
    bound = F.transform(F.array(pairs), twice)
    counted = F.transform(bound, covered)[0]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), counted).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, into: str, text_column: str = "text") -> DataFrame:
    """Adds a struct of counts and rates. The intermediate arrays are gone from the result."""
    text, words, hashes, lines = (fresh(docs, f"_{into}_{x}") for x in ("text", "words", "hashes", "lines"))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*keep, F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias(text))
    out = out.select(*keep, F.col(text), F.regexp_extract_all(text, F.lit(WORD), 0).alias(words))
    windows = F.size(words) - (WINDOW - 1)
    out = out.select(
        *keep, text, words,
        F.when(windows > 1, F.transform(F.sequence(F.lit(1), windows), lambda i: F.xxhash64(F.slice(F.col(words), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias(hashes),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias(lines),
    )
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(words), F.col(hashes)),
    }
    out = out.select(*keep, F.struct(*(v.alias(k) for k, v in counts.items())).alias(into))
    m = F.col(into)
    rates = {
        "base_failed": (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"]),
        "symbol_rate": m["n_symbols"] / F.greatest(m["word_chars"], F.lit(1)),
        "dup_line_rate": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "repeat_rate": m["n_repeat_words"] / F.greatest(m["n_words"], F.lit(1)),
        "word_length": m["word_chars"] / F.greatest(m["n_words"], F.lit(1)),
    }
    return out.withColumn(into, F.struct(f"{into}.*", *(v.alias(k) for k, v in rates.items())))


def limits(measured: DataFrame, into: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, and lower and upper limits of every measure, from merged sketches."""
    names = list(RULES)
    sketch = lambda x: F.kll_sketch_agg_double(x, F.lit(SKETCH_K))
    merge = lambda x: F.kll_merge_agg_double(x, F.lit(SKETCH_K))
    groups = measured.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(
        F.count_if(~F.col(into)["base_failed"]).alias("n"),
        *(sketch(F.when(~F.col(into)["base_failed"], F.col(into)[m].cast("double"))).alias(m) for m in names),
    )
    groups = materialise(groups, "sketches")  # a row per group: merged twice more below
    filled = groups.where("n > 0")
    by_lang = filled.groupBy("lang").agg(F.sum("n").alias("lang_n"), *(merge(F.col(m)).alias(f"lang_{m}") for m in names))
    overall = filled.agg(*(merge(F.col(m)).alias(f"all_{m}") for m in names))
    joined = groups.alias("g").join(by_lang.alias("l"), F.col("g.lang").eqNullSafe(F.col("l.lang")), "left").crossJoin(F.broadcast(overall))
    columns = []
    for m, (floor, width, both) in RULES.items():
        chosen = F.when(F.col("n") >= MIN_GROUP, F.col(m)).when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}"))
        middle, upper = (F.kll_sketch_get_quantile_double(chosen, F.lit(q)) for q in (0.5, 0.75))
        reach = width * F.greatest(upper - middle, F.lit(floor))
        columns.append((middle + reach).alias(f"max_{m}"))
        columns.append(((middle - reach) if both else F.lit(float("-inf"))).alias(f"min_{m}"))
    return joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), *columns)


def judge(measured: DataFrame, into: str, verdict: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds a boolean: whether the document passes the base rule and the limits of its group.

    The limits are a written table, so Spark knows its size when it plans the join: it broadcasts
    them if they are small and splits hot groups of a shuffled join otherwise."""
    table = materialise(limits(measured, into, lang, source), "limits")
    within = F.lit(True)
    for m in RULES:
        within = within & (F.col(f"d.{into}.{m}") <= F.col(f"t.max_{m}")) & (F.col(f"d.{into}.{m}") >= F.col(f"t.min_{m}"))
    on = F.col(f"d.{lang}").eqNullSafe(F.col("t.lang")) & F.col(f"d.{source}").eqNullSafe(F.col("t.source"))
    return measured.alias("d").join(table.alias("t"), on, "left").select("d.*", (~F.col(f"d.{into}.base_failed") & F.coalesce(within, F.lit(True))).alias(verdict))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row per document."""
    measured = measures(docs.select("doc_id", "text", "lang", "source"), "m").drop("text")
    judged = judge(materialise(measured, "measures"), "m", "kept")
    return judged.select("doc_id", "m.*", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    into = fresh(docs, "quality")
    measured = materialise(measures(docs, into), "measured")
    verdict = fresh(measured, "kept")
    return judge(measured, into, verdict).where(F.col(verdict)).select(*(F.col(f"`{c}`") for c in docs.columns))
