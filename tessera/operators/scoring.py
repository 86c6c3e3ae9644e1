"""Explainable scores of text blocks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Fixed values: (pattern, weight, label) of poor constructions and English residue.
PHRASES = [
    (r"\bbio je u stanju da\b", 0.8, "kalk: 'bio je u stanju da'"),
    (r"\bnije bio u mogu[ćc]nosti\b", 0.8, "kalk: 'nije bio u mogućnosti'"),
    (r"\buspio je da uradi\b", 0.8, "kalk: 'uspio je da uradi'"),
    (r"\bpokušao je da\b", 0.3, "kalk: 'pokušao je da'"),
    (r"\bu pogledu toga\b", 0.2, "kalk: 'u pogledu toga'"),
    (r"\bod strane\s+\w+a\b", 0.4, "kalk: 'od strane X-a'"),
    (r"\bpo pitanju\s+", 0.2, "kalk: 'po pitanju'"),
    (r"\bu odnosu na to\b", 0.2, "kalk: 'u odnosu na to'"),
    (r"\bkoristeći se\b", 0.2, "kalk: 'koristeći se'"),
    (r"\bna taj način\b", 0.1, "kalk: 'na taj način'"),
    (r"\bimati u vidu\b", 0.2, "kalk: 'imati u vidu'"),
    (r"\buzeti u obzir to da\b", 0.2, "kalk: 'uzeti u obzir to da'"),
    (r"\bin order to\b", 2.0, "eng: 'in order to'"),
    (r"\bnevertheless\b", 2.0, "eng: 'nevertheless'"),
    (r"\bhowever\b", 2.0, "eng: 'however'"),
    (r"\bmoreover\b", 2.0, "eng: 'moreover'"),
    (r"\bfurthermore\b", 2.0, "eng: 'furthermore'"),
    (r"\bconsequently\b", 2.0, "eng: 'consequently'"),
]
# Verbs of speech.
SPEECH = ["reče", "rekla", "rekao", "upita", "odgovori", "viknu", "šapnu", "nastavi", "doda", "uzviknu", "prošaputa", "promrmlja"]
QUOTES = '["“”„‘’]'

# Patterns and weights of the block report, by kind.
EKAVIAN = [
    r"\bvreme\b", r"\bniko\b", r"\bčovek\b", r"\bdete\b", r"\bdecu\b", r"\bdevojka\b", r"\bdevojke\b", r"\bdevojku\b",
    r"\blepo\b", r"\blepše\b", r"\blepota\b", r"\bposedujem?\b", r"\bposeduje\b", r"\bopšte\b", r"\bsvakome\b",
]
CALQUES = [
    r"\bbio je u stanju da\b", r"\bnije bio u mogu[ćc]nosti\b", r"\buspio je da\b", r"\bpokušao je da\b", r"\bu pogledu toga\b",
    r"\bod strane\s+\w+a\b", r"\bpo pitanju\s+", r"\bu odnosu na to\b", r"\bkoristeći se\b", r"\bimati u vidu\b",
    r"\buzeti u obzir to da\b", r"\bu svjetlu toga\b", r"\bna osnovu toga\b", r"\biz razloga što\b", r"\bimajući u vidu\b",
    r"\bprema tome\b", r"\bu cilju\b", r"\bs ciljem da\b", r"\bsa svrhom\b", r"\bna neki način\b",
]
TYPOGRAPHIC = [r'"[^"]{1,80}"', r"\s,", r"\s\.", r"  +", r"\.{4,}", r"--", r"\s—\s*$", r"^\s*—\s*$"]
ENGLISH = [
    r"\bin order to\b", r"\bnevertheless\b", r"\bhowever\b", r"\bmoreover\b", r"\bfurthermore\b", r"\bconsequently\b",
    r"\btherefore\b", r"\bthus\b", r"\bhence\b", r"\bregarding\b", r"\bwhereas\b", r"\bthereof\b", r"\bherein\b",
    r"\bhereby\b", r"\baforesaid\b", r"\bnotwithstanding\b",
]
REPORT = {"ekavian": (EKAVIAN, 2.0, True), "calques": (CALQUES, 1.5, True), "typography": (TYPOGRAPHIC, 0.5, False), "english": (ENGLISH, 3.0, True)}


def matches(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    found = [F.when(T.holds(text, p), 1).otherwise(0) for p in patterns]
    total = F.lit(0)
    for f in found:
        total = total + f
    return total.cast("long")


def heuristic_score(rows: DataFrame, text: str = "text", score: str = "score", reasons: str = "reasons") -> DataFrame:
    """Adds a score from 1 to 10 and the reasons for its penalties."""
    keep = rows.columns
    plain = F.col("_plain")
    out = rows.withColumn("_plain", F.col(text)).withColumn("_length", F.length(F.btrim(plain, F.lit(" \t\n\r"))))
    out = out.withColumn("_english", T.english_share(plain)).withColumn("_lower", F.lower(plain)).withColumn("_repeat", T.max_trigram(plain))
    n, english, lower, repeat = (F.col(c) for c in ("_length", "_english", "_lower", "_repeat"))
    out = out.withColumn("_quotes", T.count_of(plain, QUOTES))  # used twice
    quotes, dashes = F.col("_quotes"), T.count_of(plain, "—")
    speaks = reduce(or_, (lower.contains(w) for w in SPEECH))
    # Used twice, so Spark keeps it as a column of its own: each pattern is looked for once.
    out = out.withColumn("_found", F.array(*(T.holds(lower, p) for p, _, _ in PHRASES)))
    weights = F.lit(0.0)
    for i, (_, weight, _) in enumerate(PHRASES):
        weights = weights + F.when(F.get("_found", F.lit(i)), weight).otherwise(0.0)
    labels = F.slice(F.array_compact(F.array(*(F.when(F.get("_found", F.lit(i)), F.lit(label)) for i, (_, _, label) in enumerate(PHRASES)))), 1, 3)
    heading = F.btrim(plain, F.lit(" \t\n\r")).rlike(r"(?i)^(Chapter|Part|Section)\s+\d+")
    dialogue = F.when((quotes >= 4) & (dashes == 0) & speaks, 1.5).when((quotes >= 6) & (dashes == 0), 1.0).otherwise(0.0)
    penalty = (
        F.when(n < 50, 2.0).otherwise(0.0)
        + F.when(english > 0.15, 5.0).when(english > 0.08, 3.0).when(english > 0.03, 1.5).otherwise(0.0)
        + weights
        + dialogue
        + F.when(repeat > 4, 3.0).when(repeat > 2, 1.0).otherwise(0.0)
        + F.when(heading, 1.5).otherwise(0.0)
        + F.when(plain.rlike("  +"), 0.3).otherwise(0.0)
        + F.when(plain.rlike(r"\.{4,}"), 0.4).otherwise(0.0)
    )
    foreign = (english > 0.25) & (n >= 120)
    out = out.withColumn(score, F.when((n < 20) | foreign, 1.0).otherwise(F.round(F.greatest(F.lit(1.0), F.least(F.lit(10.0), 9.8 - penalty)), 1)))
    why = F.array_compact(
        F.array(
            F.when(n < 50, "short"),
            F.when(english > 0.15, "critical english").when(english > 0.08, "high english").when(english > 0.03, "some english"),
            F.when(F.size(labels) > 0, F.array_join(labels, ", ")),
            F.when(dialogue > 0, "dialogue without dashes"),
            F.when(repeat > 4, "repeated phrases").when(repeat > 2, "some repeated phrases"),
            F.when(heading, "untranslated heading"),
            F.when(plain.rlike(r"\.{4,}"), "many dots"),
        )
    )
    out = out.withColumn(reasons, F.when(n < 20, F.array(F.lit("empty or too short"))).when(foreign, F.array(F.lit("untranslated"))).otherwise(why))
    return out.select(*keep, score, reasons)


def composite_score(heuristic: Column, judged: Column, nonprose: Column, penalty: Column) -> Column:
    """A quarter heuristic, three quarters judged; without a judge the heuristic stands."""
    mixed = F.when(nonprose, 10.0).when((heuristic <= 2) | judged.isNull(), heuristic).otherwise(F.round(0.25 * heuristic + 0.75 * judged, 1))
    return F.greatest(F.lit(1.0), F.least(F.lit(10.0), mixed - penalty))


def unchanged_penalty(similarity: Column) -> Column:
    return F.when(similarity > 0.97, 2.0).when(similarity > 0.90, 0.8).otherwise(0.0)


def loss_cap(score: Column, ratio: Column) -> Column:
    """Caps the score of a text that lost length."""
    return F.least(score, F.when(ratio < 0.60, 4.8).when(ratio < 0.72, 6.0).when(ratio < 0.82, 7.0).otherwise(10.0))


def block_report(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of findings by kind, their total and a score."""
    lower = F.lower(F.col(text))
    total, fined = F.lit(0).cast("long"), F.lit(0.0)
    for name, (patterns, weight, folded) in REPORT.items():
        rows = rows.withColumn(f"n_{name}", matches(lower if folded else F.col(text), patterns))
        total, fined = total + F.col(f"n_{name}"), fined + F.col(f"n_{name}") * weight
    return rows.withColumn("n_findings", total).withColumn("report_score", F.round(F.greatest(F.lit(0.0), 10.0 - fined), 1))


def mean_of_tenths(score: Column, places: int) -> Column:
    """The mean of scores that are tenths, rounded half up. In whole numbers, so that neither the order
    of the rows nor binary fractions move a result across a rounding edge."""
    total, n = F.sum(F.round(score * 10).cast("long")), F.count(score)
    whole = F.call_function("div", total * (2 * 10 ** (places - 1)) + n, n * 2)
    return F.when(n > 0, whole / 10.0**places)


def bands(score: Column) -> dict[str, Column]:
    """Summary aggregates of a score column."""
    share = lambda c: F.round(100 * F.try_divide(F.count_if(c), F.count(score)), 1)
    return {
        "avg_score": mean_of_tenths(score, 2), "min_score": F.min(score), "max_score": F.max(score), "n": F.count(score),
        "excellent": F.count_if(score >= 8.5), "good": F.count_if((score >= 6.5) & (score < 8.5)),
        "poor": F.count_if((score >= 4.0) & (score < 6.5)), "critical": F.count_if(score < 4.0), "pct_excellent": share(score >= 8.5),
    }
