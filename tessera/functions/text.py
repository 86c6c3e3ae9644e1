"""Column expressions over texts: markup, languages, artefacts, scores."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words counted as English residue, and South-Slavic diacritics.
ENGLISH_WORDS = [
    "the", "and", "was", "for", "with", "his", "they",
    "have", "from", "this", "that", "are", "not", "but",
    "had", "her", "she", "him", "been", "when", "into",
    "there", "then", "than", "would", "could", "their",
]
DIACRITICS = "čćšžđČĆŠŽĐ"

# Length bounds of a rewrite, relative to its original, by role.
LENGTH_BOUNDS = {"LEKTOR": (0.92, 1.12), "RETRO": (0.75, 1.35), "PREVODILAC": (0.70, 1.50)}

# Parts of the names of files that are front or back matter, and what these score.
PARATEXT_FILES = [
    "halftitle", "title", "otherbyauthor", "alsoby", "seriespage", "copyright", "dedication", "contents", "toc", "colophon",
    "frontmatter", "backmatter", "epigraph", "acknowledgment", "aboutauthor", "cover", "insert",
]
PARATEXT_SCORE = 8.5
# Phrases of front and back matter.
PARATEXT = [
    "copyright", "isbn", "cip -", "katalogizacija", "cataloguing",
    "sva prava pridrzana", "sva prava pridržana", "all rights reserved",
    "stampano u", "štampano u", "printed in", "first published",
    "prvo izdanje", "o autoru", "about the author", "o autorica",
    "biljeska o prijevodu", "bilješka o prijevodu", "napomena prevodioca",
    "zahvalnice", "acknowledgements", "acknowledgments",
    "posveta", "dedication", "epigraf",
    "sadrzaj", "sadržaj", "table of contents", "kazalo",
    "indeks", "index", "glosar pojmova", "glossary",
    "bibliografija", "bibliography", "literatura",
    "recenzija", "endorsement", "also by", "by the same author",
    "o knjizi", "about this book", "about the book",
]


# A list whose first entries are links. Three are enough to tell: the third may span the others.
LINK_LIST = r"<(ul|ol)[^>]*>(?:\s*<li[^>]*>\s*<a[^>]*>[^<]{1,120}</a>.*?</li>\s*){3}</(?:ul|ol)>"


def no_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def html_text(html: Column) -> Column:
    """Visible words: tags and entities become spaces, white space collapses."""
    spaced = F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "&[a-z]+;", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def visible_text(html: Column) -> Column:
    """As html_text, without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    bare = F.regexp_replace(bare, r"(?is)<style[^>]*>.*?</style>", " ")
    return html_text(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def english_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(no_tags(text)), F.lit(r"(?U)\b[a-z]{2,}\b"), F.lit(0))


def english_hits(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(ENGLISH_WORDS))).cast("long")


def diacritics(text: Column) -> Column:
    return count_of(text, f"[{DIACRITICS}]")


def english_ratio(tokens: Column, hits: Column, marks: Column, length: Column) -> Column:
    """Share of English words; South-Slavic letters above half a percent damp it."""
    raw = F.try_divide(hits, F.size(tokens))
    share = marks / F.greatest(length, F.lit(1))
    damped = F.when(share > 0.005, raw * F.greatest(F.lit(0.0), 1 - share / 0.01)).otherwise(raw)
    return F.coalesce(F.round(damped, 4), F.lit(0.0))


def english_share(text: Column) -> Column:
    plain = no_tags(text)
    # Bound by a one-element transform: an expression would be evaluated for each use.
    parts = F.struct(english_tokens(text).alias("tokens"), diacritics(plain).alias("marks"), F.length(plain).alias("n"))
    return F.get(F.transform(F.array(parts), lambda p: english_ratio(p["tokens"], english_hits(p["tokens"]), p["marks"], p["n"])), F.lit(0))


def safe_name(name: Column) -> Column:
    """File name of ASCII letters, digits, dot, dash and underscore."""
    latin = F.translate(name, "čćšžČĆŠŽ", "ccszCCSZ")
    latin = F.replace(F.replace(latin, F.lit("đ"), F.lit("dj")), F.lit("Đ"), F.lit("Dj"))
    base = F.regexp_extract(latin, r"([^/\\]*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9_.-]", "_"), "_+", "_")
    kept = F.regexp_replace(kept, "^[_.]+|[_.]+$", "")
    return F.when(F.coalesce(F.length(name), F.lit(0)) == 0, "nepoznato.epub").when(kept == "", "knjiga.epub").otherwise(kept)


def block_type(html: Column) -> Column:
    """dijalog, poetski, opis or naracija, by marks of speech, breaks and sentence length."""
    plain = no_tags(html)
    sentences = F.filter(F.transform(F.split(plain, "[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: s != "")
    n = F.size(sentences)
    speech = F.size(F.filter(F.split(plain, "\n"), lambda s: s.rlike(r'^\s*[—"„]')))
    marks = count_of(plain, "[—–-]{1,2}") + count_of(plain, "[„\"']+ ")
    average = F.coalesce(F.try_divide(F.aggregate(sentences, F.lit(0), lambda a, s: a + F.length(s)), n), F.lit(0.0))
    breaks = count_of(html, r"(?i)<br\s*/?>")
    emphasis = html.rlike(r"(?is)<(?:em|i)[^>]*>.*?</(?:em|i)>")
    verbs = count_of(plain, r"(?iU)\b(?:said|told|asked|replied|whispered|shouted|answered|reče|odvrati|upita|prošaputa)\b")
    return (
        F.when((n > 0) & ((speech > 0.25 * n) | (marks > n * 0.4)), "dijalog")
        .when((breaks >= 3) | (emphasis & (average < 60)), "poetski")
        .when((average < 40) & (n >= 3), "poetski")
        .when((average > 120) & (verbs == 0), "opis")
        .otherwise("naracija")
    )


def length_flag(original: Column, candidate: Column, role: Column) -> Column:
    """Whether the candidate's length is out of its role's bounds."""
    a, b = (F.length(F.btrim(no_tags(x), F.lit(" \t\n\r"))) for x in (original, candidate))
    ratio = F.try_divide(b, a)
    out = F.lit(False)
    for name, (low, high) in LENGTH_BOUNDS.items():
        out = F.when(role == name, (ratio < low) | (ratio > high)).otherwise(out)
    return F.coalesce(F.when((a == 0) | (b < 15), F.lit(False)).otherwise(out), F.lit(False))


def text_loss(original: Column, candidate: Column, translated: Column) -> Column:
    """Whether a rewrite lost too much of a long original."""
    a, b = F.length(original), F.length(candidate)
    return (a >= 120) & (b >= 20) & (b < a * F.when(translated, 0.62).otherwise(0.80))


def max_trigram(text: Column) -> Column:
    """Greatest count of one run of three words, for texts of more than 20 words. 64-bit hashes stand
    for the runs."""

    def longest(items: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
            return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        return F.aggregate(items, start, step, lambda acc: acc["best"])

    def counted(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def most(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(1)).otherwise(longest(F.sort_array(grams)))

    # One-element transforms bind an array once; an expression would be evaluated for each element.
    grams = F.transform(F.filter(F.array(words(text)), lambda w: F.size(w) > 20), counted)
    return F.coalesce(F.get(F.transform(grams, most), F.lit(0)), F.lit(0)).cast("long")


def unwrap_json(text: Column, keys: list[str]) -> Column:
    """The first filled value among some keys of a JSON text, else the text."""
    plain = F.translate(text, "„“”‘’‚‛", '"""""""')
    values = [F.get_json_object(x, f"$.{k}") for x in (text, plain) for k in keys]
    filled = [F.when(F.length(F.trim(v)) > 0, v) for v in values]
    return F.coalesce(*filled, text)


def strip_fence(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""), F.lit(" \t\n\r"))


def review_reason(score: Column) -> Column:
    return (
        F.when(score.isNull(), "no score").when(score < 4.0, "critical").when(score < 6.5, "poor").when(score < 8.5, "good").otherwise("excellent")
    )


def bigram_set(text: Column) -> Column:
    """The distinct pairs of neighbouring characters; a lookahead finds them in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))


def set_change(a: Column, b: Column) -> Column:
    """Size of the symmetric difference of two sets, relative to the first."""
    return F.coalesce(F.try_divide(F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)), F.size(a)), F.lit(0.0))


def word_change(before: Column, after: Column) -> Column:
    """Symmetric difference of the word sets, relative to the first."""
    return set_change(word_set(before), word_set(after))


def homoglyphs(text: Column) -> Column:
    """Cyrillic look-alikes to Latin, if at most a tenth of the characters are Cyrillic."""
    share = count_of(text, "[Ѐ-ӿ]") / F.greatest(F.length(text), F.lit(1))
    # Cyrillic letters and their Latin counterparts.
    one = F.translate(text, "абвгдђежзијклмнопрстћуфхцчшАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ", "abvgdđežzijklmnoprstćufhcčšABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ")
    for cyrillic, latin in (("љ", "lj"), ("њ", "nj"), ("џ", "dž"), ("Љ", "Lj"), ("Њ", "Nj"), ("Џ", "Dž")):
        one = F.replace(one, F.lit(cyrillic), F.lit(latin))
    return F.when(share <= 0.10, one).otherwise(text)


# Typographic rewrites, in order.
TYPOGRAPHY = [
    (r"(?<!\.)\.\.\.(?!\.)", "…"),
    (r"(?<![.…])\.\.(?![.…])", "."),
    (r"\.{4,}", "…"),
    (r"(?m)^\s*--\s*", "— "),
    (r'(?m)^\s*-\s+(?=[A-ZČĆŠŽĐ„"])', "— "),
    (r"(?<=[^\s\n])--(?=[^\s\n])", "—"),
    (r"\s+--\s+", " — "),
    (r"(\d)\s*-\s*(\d)", "$1–$2"),
    (r"(?<=[^\s\n—])—(?=[^\s\n—])", " — "),
    (r'"([^"<>\n\r]{1,400})"', '„$1"'),
    (r'“([^"“”<>\n\r]{1,400})”', '„$1"'),
    (r"\s+([,;:!?])", "$1"),
    (r"  +", " "),
]


def typography(text: Column) -> Column:
    for pattern, new in TYPOGRAPHY:
        text = F.regexp_replace(text, "(?U)" + pattern, new)
    return text


def outside_tags(text: Column, change: Callable[[Column], Column]) -> Column:
    """Applies a change to the pieces of a text that lie outside tags. Split at `<`, a chunk is a tag
    up to its last `>`; so each character is looked at once, however many matches there are."""
    first = lambda c: F.regexp_extract(c, r"(?s)^(.*>)?(.*)$", 1)
    rest = lambda c: F.regexp_extract(c, r"(?s)^(.*>)?(.*)$", 2)
    parts = F.transform(F.split(text, "<"), lambda c: F.when(c.contains(">"), F.concat(first(c), change(rest(c)))).otherwise(change(c)))
    return F.array_join(parts, "<")


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Applies (pattern, replacement) pairs in order, outside tags, whatever the case."""

    def change(piece: Column) -> Column:
        for pattern, new in rules:
            piece = F.regexp_replace(piece, "(?iU)" + pattern, new)
        return piece

    return outside_tags(text, change)


def rewrite_by(text: Column, rules: Column) -> Column:
    """The same for an array column of (pattern, replacement), as a table of rules gives."""

    def change(piece: Column) -> Column:
        return F.aggregate(rules, piece, lambda acc, r: F.regexp_replace(acc, F.concat(F.lit("(?iU)"), r["pattern"]), r["replacement"]))

    return outside_tags(text, change)


_SPECIAL = re.compile(r"\\.|\[[^]]*\]|.\?|[][(){}*+.|^$]")


def holds(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs. Patterns of words are first looked for by their longest literal piece."""
    found = text.rlike("(?U)" + pattern)
    literal = max(_SPECIAL.split(pattern), key=len) if pattern.startswith(r"\b") else ""
    return text.contains(literal) & found if literal else found


def paratext_file(name: Column) -> Column:
    """Whether a file is front or back matter, by its name."""
    plain = F.replace(F.replace(F.lower(name), F.lit("_"), F.lit("")), F.lit("-"), F.lit(""))
    return F.exists(F.array(*map(F.lit, PARATEXT_FILES)), lambda w: plain.contains(w))
