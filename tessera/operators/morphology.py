"""Forms of words: doubtful ones found, wrong ones mended, participles that do not fit a name's gender.

A text is cut once into words and the gaps between them. Findings and changes are places of words,
so a text is put together again from its own words but the changed ones, whose capitals stay. Null texts stay
null and have no findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.forms import DOUBTFUL, FEMALE_FORMS, RIGHT, WRONG_FORMS

WORD = r"(?U)[\w]+(?:-[\w]+)*"
CONTEXT = 40


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def gaps_of(text: Column) -> Column:
    """What stands before, between and after the words: one more than there are words."""
    return F.split(text, WORD, -1)


def like(old: Column, new: Column) -> Column:
    """A word with the capitals of another: all, the first, or none of its own."""
    first = F.concat(F.upper(F.left(new, F.lit(1))), F.substr(new, F.lit(2)))
    capital = F.left(old, F.lit(1))
    return (
        F.when((F.length(old) > 1) & (F.upper(old) == old) & (F.lower(old) != old), F.upper(new))
        .when((F.upper(capital) == capital) & (F.lower(capital) != capital), first)
        .otherwise(new)
    )


def put_together(words: Column, gaps: Column) -> Column:
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def start_of(words: Column, gaps: Column, place: Column) -> Column:
    """Characters before the word at a place (from 0)."""
    add = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))
    return add(F.slice(gaps, F.lit(1), place + 1)) + add(F.slice(words, F.lit(1), place))


def doubtful_forms(docs: DataFrame, key: str, text: str = "text", patterns: list[str] = DOUBTFUL, right: list[str] = RIGHT) -> DataFrame:
    """key, pattern (its number), form, position (from 0) and context of every word that a pattern
    fits as a whole and that is not known to be right."""
    known = F.array(*map(F.lit, right))
    cut = docs.select(key, text, words_of(F.col(text)).alias("_w"), gaps_of(F.col(text)).alias("_g"))
    placed = F.transform("_w", lambda w, k: F.struct(w.alias("form"), k.alias("place")))
    # Most words fit no pattern: one search leaves them out, unless patterns count groups and cannot be joined.
    apart = any("\\k<" in p or any(f"\\{d}" in p for d in range(1, 10)) for p in patterns)
    either = "(?s).*" if apart else "|".join(f"(?:{p})" for p in patterns)
    cut = cut.withColumn("_c", F.filter(placed, lambda x: x["form"].rlike(f"(?iU)^(?:{either})$")))

    def hits(i: int, pattern: str) -> Column:
        """Words that one pattern finds, with their places."""
        fits = F.filter("_c", lambda x: x["form"].rlike(f"(?iU)^(?:{pattern})$") & ~F.array_contains(known, F.lower(x["form"])))
        return F.transform(fits, lambda x: F.struct(F.lit(i).alias("pattern"), x["form"].alias("form"), x["place"].alias("place")))

    found = [hits(i, p) for i, p in enumerate(patterns)]
    rows = cut.withColumn("_hit", F.explode(F.concat(*found))).select(key, text, "_hit.*", start_of(F.col("_w"), F.col("_g"), F.col("_hit.place")).alias("position"))
    context = F.substr(text, F.greatest(F.col("position") - CONTEXT, F.lit(0)) + 1, F.least(F.col("position"), F.lit(CONTEXT)) + F.length("form") + CONTEXT)
    return rows.select(key, "pattern", "form", "position", F.replace(context, F.lit("\n"), F.lit(" ")).alias("context"))


def mended_forms(text: Column, forms: dict[str, str] = WRONG_FORMS) -> Column:
    """A struct of the text with wrong forms replaced, and `changes`: array of (old, new) in order."""
    table = F.create_map(*(F.lit(x) for pair in forms.items() for x in pair))
    new = lambda w: like(w, F.try_element_at(table, F.lower(w)))
    made = F.transform(F.array(words_of(text)), lambda ws: F.struct(ws.alias("old"), F.transform(ws, lambda w: F.coalesce(new(w), w)).alias("new")))[0]
    changes = lambda m: F.filter(F.arrays_zip(m["old"].alias("old"), m["new"].alias("new")), lambda c: c["old"] != c["new"])
    done = F.transform(F.array(made), lambda m: F.struct(put_together(m["new"], gaps_of(text)).alias("text"), changes(m).alias("changes")))[0]
    return F.when(text.isNotNull(), done)


def told_participles(text: Column) -> Column:
    """Array of (place, name, form): participles (by their place among the words) of `Name [se] je
    form`, and of `form je Name` where no name stands before."""

    def found(x: Column) -> Column:
        words, gaps = x["words"], x["gaps"]
        at = lambda i: F.get(words, i)
        joined = lambda i: F.get(gaps, i).rlike(r"(?U)^\s+$")  # noqa: E731  between words i - 1 and i
        is_word = lambda i, w: F.lower(at(i)) == w

        def look(i: Column) -> Column:
            straight = is_word(i - 1, "je") & joined(i) & joined(i - 1)
            self_form = straight & is_word(i - 2, "se") & joined(i - 2)
            name = F.when(self_form & (i >= 3), at(i - 3)).when(straight & (i >= 2) & ~is_word(i - 2, "se"), at(i - 2))
            after = F.when(is_word(i + 1, "je") & joined(i + 1) & joined(i + 2), at(i + 2))
            return F.struct(i.alias("place"), name.alias("before"), after.alias("after"), F.lower(at(i)).alias("form"))

        every = F.transform(words, lambda _, i: look(i))
        return F.filter(every, lambda f: f["before"].isNotNull() | f["after"].isNotNull())

    cut = F.array(F.struct(words_of(text).alias("words"), gaps_of(text).alias("gaps")))
    return F.transform(cut, found)[0]


def gender_corrected(docs: DataFrame, key: str, book: str, registry: DataFrame, text: str = "text", forms: dict[str, str] = FEMALE_FORMS) -> DataFrame:
    """The documents with participles in the gender of the name that they tell of, and `n_corrected`.

    registry: book, name, gender ('M', 'Ž' or null), one row a name. The name before a participle decides;
    where it is not known, the one after. Only places travel: documents meet their changes by `key`, which must tell
    them apart."""
    of = registry.where(F.col("gender").isin("M", "Ž")).select(F.col("book").alias("_book"), F.lower("name").alias("_name"), "gender")
    of = of.groupBy("_book", "_name").agg(F.min("gender").alias("gender"))
    told = docs.select(key, F.col(book).alias("_book"), F.explode(told_participles(F.col(text))).alias("_t")).select(key, "_book", "_t.*")
    to_male = {f: m for m, f in forms.items()}
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    wrong = told.where(F.try_element_at(table(forms), "form").isNotNull() | F.try_element_at(table(to_male), "form").isNotNull())
    named = lambda c: of.select("_book", F.col("_name").alias(f"_{c}"), F.col("gender").alias(f"gender_{c}"))
    for c in ("before", "after"):
        wrong = wrong.withColumn(f"_{c}", F.lower(c)).join(named(c), ["_book", f"_{c}"], "left")
    gender = F.coalesce("gender_before", "gender_after")
    right = F.when(gender == "Ž", F.try_element_at(table(forms), "form")).when(gender == "M", F.try_element_at(table(to_male), "form"))
    changes = wrong.withColumn("right", right).where("right IS NOT NULL").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "right"))).alias("_changes"))
    joined = docs.join(changes, key, "left")
    words = F.transform(words_of(F.col(text)), lambda w, i: F.coalesce(like(w, F.try_element_at("_changes", i)), w))
    new = F.when(F.col("_changes").isNotNull(), put_together(words, gaps_of(F.col(text)))).otherwise(F.col(text))
    return joined.withColumn(text, new).withColumn("n_corrected", F.coalesce(F.size("_changes"), F.lit(0)).cast("long")).drop("_changes")
