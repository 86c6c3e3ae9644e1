"""An ordered engine for tables of rewrite rules: hundreds of them, whatever the case, outside tags, counted.

Rules are configuration: a table (seq, pattern, replacement, category) that the driver reads, checks
once and sends along as one constant. A pattern that is no regular expression, or a replacement that
names a group which its pattern lacks, is left out and reported. Each rule is known by a text that
all its matches hold, if the pattern has one: a block meets a rule only if its text, as rewritten so far,
holds that text. So what a rule makes, later rules see, and hundreds of rules cost a search each.

A text is cut once into what no rule may touch (tags, and terms of a glossary as whole words,
longest first) and what lies between, so each character is looked at once. Null texts stay null and have no hits.

If no match of any rule can hold white space or depend on what is beyond it, as with rules for words and
parts of words, the text between is cut at white space too: the rules then see one word at a time, and only
words that hold a known text. A rewrite costs a word, not the whole text again. Rules go in blocks, and a word is
looked at once a block for all known texts of it.

If, besides, all patterns are plain letters and digits and no replacement takes groups, what the rules make of a word is kept
by each task, WORDS words at most at a time: a text costs a look at each word, and rules only meet words that the task has not seen.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import re._constants as sre
import re._parser as sre_parser
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGS = "(?iU)"
LEAST_LITERAL = 2
BLOCKS = 6  # blocks of rules; each takes Spark's analyzer a few of its hundred rounds
_RULE = "array<struct<seq:int,pattern:string,replacement:string,known:string,place:int>>"
_HITS = "array<struct<place:int,n:bigint>>"
WORDS = 1 << 18
LONG_WORD = 100  # of longer words, patterns are searched one by one
# What case-blind patterns take for ASCII letters.
_ASCII_CASES = str.maketrans("\u017f\u212a\u0131\u0130", "skii")
_DONE = f"struct<free:array<string>,hits:{_HITS}>"
_GAP = r"[ \t\r\n]+"
# A tag, or what stands before a stray `>`.
_TAG = r"(?:^|<)[^<]*>"
Rule = tuple[int, str, str, str]


def folded(text: Column) -> Column:
    """Texts that differ by case only become equal, in every way that case-blind patterns allow."""
    return F.upper(F.lower(F.translate(text, "İ", "I")))


def _folded(text: str) -> str:
    return text.replace("İ", "I").lower().upper()


def java_replacement(new: str) -> str:
    r"""A replacement with groups as \1 or \g<1>, for Java, where they are $1."""
    found = re.compile(r"\\(?:g<(\d+)>|(\d)|(\\))|([\\$])")
    return found.sub(lambda m: f"${m[1] or m[2]}" if m[1] or m[2] else "\\" + (m[3] or m[4]), new)


def _needed(tree: Iterable, runs: list[str]) -> None:
    """Runs of characters that each match of a parsed pattern holds."""
    open_run = ""
    for kind, value in tree:
        if kind is sre.LITERAL and not (0xD800 <= value < 0xE000):
            open_run += chr(value)
            continue
        if kind is sre.AT:
            continue  # an anchor takes no characters
        runs.append(open_run)
        open_run = ""
        if kind is sre.SUBPATTERN:
            _needed(value[3], runs)
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
            _needed(value[2], runs)
    runs.append(open_run)


def known_by(pattern: str) -> str:
    """The longest text that all matches of a pattern hold, folded; empty if none is known."""
    runs: list[str] = []
    try:
        _needed(sre_parser.parse(pattern, re.IGNORECASE), runs)
    except (re.error, OverflowError, RecursionError):
        return ""
    best = max(runs, key=len, default="")
    return _folded(best) if len(best) >= LEAST_LITERAL else ""


def _in_words(tree: Iterable) -> bool:
    """Whether no match of a parsed pattern holds white space or looks beyond it."""
    for kind, value in tree:
        if kind is sre.LITERAL:
            fits = chr(value) not in " \t\r\n"
        elif kind is sre.AT:
            fits = value in (sre.AT_BOUNDARY, sre.AT_NON_BOUNDARY)
        elif kind is sre.IN:  # for Java, a bracket inside begins a class of its own
            fits = all(
                (k is sre.LITERAL and chr(v) not in " \t\r\n[&") or (k is sre.RANGE and (v[0] > 32 or v[1] < 9) and not v[0] <= ord("[") <= v[1])
                or (k is sre.CATEGORY and v in (sre.CATEGORY_WORD, sre.CATEGORY_DIGIT)) for k, v in value
            )
        elif kind is sre.SUBPATTERN:
            fits = not value[1] and not value[2] and _in_words(value[3])
        elif kind is sre.BRANCH:
            fits = all(map(_in_words, value[1]))
        else:
            fits = kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and _in_words(value[2])
        if not fits:
            return False
    return True


def in_words(pattern: str) -> bool:
    """Whether a rule does the same to a text and to its words, cut at white space, one by one."""
    try:
        tree = sre_parser.parse(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return False
    return tree.getwidth()[0] > 0 and not tree.state.flags & (re.VERBOSE | re.ASCII) and _in_words(tree)


def any_of(texts: Iterable[str]) -> str:
    """A pattern that finds any of the texts; what they begin with in common is looked at once."""
    heads: dict[str, list[str]] = {}
    for t in texts:
        if not t:
            return ""
        heads.setdefault(t[0], []).append(t[1:])
    ways = [re.sub(r"([^\w\s])", r"\\\1", c) + any_of(rest) for c, rest in sorted(heads.items())]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def _flaw(spark: SparkSession, pattern: str, new: str) -> str | None:
    """Why Java cannot use a rule."""
    regex = spark._jvm.java.util.regex.Pattern
    try:
        groups = regex.compile(FLAGS + pattern).matcher("").groupCount()
    except Exception as e:  # noqa: BLE001  the gateway wraps the error
        return str(e).split("\n")[0].split("PatternSyntaxException: ")[-1] or "no pattern"
    asked = [int(g) for g in re.findall(r"(?<!\\)\$(\d)", new)]
    return f"no group {max(asked)}" if asked and max(asked) > groups else None


def checked(rules: DataFrame) -> tuple[list[Rule], list[tuple[int, str, str]]]:
    """Usable rules (seq, pattern, replacement for Java, known text) in order, and (seq, pattern, flaw) of the rest."""
    spark, good, bad = rules.sparkSession, [], []
    for r in rules.select("seq", "pattern", "replacement").orderBy("seq").collect():
        new = java_replacement(r["replacement"] or "")
        flaw = "no pattern" if not r["pattern"] else _flaw(spark, r["pattern"], new)
        if flaw:
            bad.append((r["seq"], r["pattern"], flaw))
        else:
            good.append((r["seq"], r["pattern"], new, known_by(r["pattern"])))
    return good, bad


def fixed_parts(terms: list[str], tags: bool = True) -> str:
    """A pattern of what rules may not touch: tags, and terms as whole words, longest first."""
    words = [re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted({t for t in terms if t.strip()}, key=lambda t: (-len(t), t))]
    whole = [rf"(?iU)(?<!\w)(?:{'|'.join(words)})(?!\w)"] if words else []
    return "|".join([_TAG] * tags + whole) or "(?!)"


def _summed(hits: Column) -> Column:
    """Hits of many words, one a rule, in order."""
    empty = F.struct(F.array().cast(_HITS).alias("done"), F.lit(-1).alias("place"), F.lit(0).cast("long").alias("n"))
    closed = lambda acc: F.when(acc["place"] < 0, acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["place"].alias("place"), acc["n"].alias("n"))))

    def step(acc: Column, h: Column) -> Column:
        more = F.struct(acc["done"].alias("done"), acc["place"].alias("place"), (acc["n"] + h["n"]).alias("n"))
        return F.when(acc["place"] == h["place"], more).otherwise(F.struct(closed(acc).alias("done"), h["place"].alias("place"), h["n"].alias("n")))

    return F.aggregate(F.sort_array(hits), empty, step, closed)


def plain(rules: list[Rule]) -> bool:
    """Whether all rules replace plain texts by plain texts. Python and Java find such texts alike, whatever the case."""
    return bool(rules) and all(re.fullmatch("[A-Za-z0-9]+", pattern) and not set(new) & set("$\\") for _, pattern, new, _ in rules)


class Words:
    """What plain rules make of words, and how often each rule changes one."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(re.compile(pattern, re.IGNORECASE), new) for _, pattern, new, _ in rules]
        self.places: dict[str, list[int]] = {}
        for place, (_, pattern, _, _) in enumerate(rules):
            self.places.setdefault(pattern.lower(), []).append(place)
        self.patterns, self.sizes = set(self.places), sorted({len(p) for p in self.places})
        self.gap = re.compile(f"({_GAP})")
        self.made: dict[str, str] = {}
        self.hits: dict[str, list[tuple[int, int]]] = {}

    def following(self, word: str, last: int) -> int:
        """The first rule after `last` whose pattern a word holds; all that there are, if none does."""
        seen = word.lower() if word.isascii() else word.translate(_ASCII_CASES).lower()
        size, first = len(seen), len(self.rules)
        if size > LONG_WORD:
            held = [p for p in self.places if p in seen]
        else:
            held = self.patterns.intersection([seen[i : i + n] for n in self.sizes if n <= size for i in range(size - n + 1)])
        for p in held:
            for place in self.places[p]:
                if last < place < first:
                    first = place
        return first

    def learn(self, word: str) -> None:
        new, hits = word, []
        place = self.following(word, -1)
        while place < len(self.rules):
            pattern, by = self.rules[place]
            new, n = pattern.subn(lambda _, by=by: by, new)
            hits.append((place, n))
            place = self.following(new, place)
        self.made[word] = new
        if hits:
            self.hits[word] = hits

    def rewrite(self, free: list[str | None]) -> tuple[list[str | None], list[tuple[int, int]]]:
        """Pieces of a text, rewritten, and (place, n) of the rules that changed them, in order."""
        if len(self.made) > WORDS:
            self.made.clear()
            self.hits.clear()
        cut = [self.gap.split(piece) for piece in free]
        words, sums = Counter(w for ws in cut for w in ws), Counter()
        for w, often in words.items():
            if w not in self.made:
                self.learn(w)
            for place, n in self.hits.get(w, ()):
                sums[place] += n * often
        return ["".join(map(self.made.__getitem__, ws)) for ws in cut], sorted(sums.items())


def _by_words(free: Column, rules: list[Rule]) -> Column:
    """Pieces of texts and the rules that changed them, (place, n), by plain rules."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(rules)
        for batch in batches:
            made = (words.rewrite(x) if x is not None else None for x in (row.as_py() for row in batch))
            rows = [x and {"free": x[0], "hits": [{"place": p, "n": n} for p, n in x[1]]} for x in made]
            yield pa.array(rows, pa.struct([("free", pa.list_(pa.string())), ("hits", pa.list_(pa.struct([("place", pa.int32()), ("n", pa.int64())])))]))

    return F.arrow_udf(run, _DONE)(free)


def rewritten(text: Column, rules: list[Rule], terms: list[str] = ()) -> Column:
    """A struct of the rewritten `text` and `hits`, an array of (seq, n) of the rules that changed it, in order."""
    names = ("seq", "pattern", "replacement", "known", "place")
    placed = [dict(zip(names, (*r, i), strict=True)) for i, r in enumerate(rules)]
    table = lambda some: F.from_json(F.lit(json.dumps(some)), _RULE)
    fixed = F.lit(fixed_parts(list(terms)))

    def step(acc: Column, r: Column) -> Column:
        pattern = F.concat(F.lit(FLAGS), r["pattern"])
        count = F.aggregate(F.transform(acc["free"], lambda p: F.regexp_count(p, pattern).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

        def made(n: Column) -> Column:
            """After n rewrites; arrays of one bind what is used twice."""
            new = F.array(F.transform(acc["free"], lambda p: F.regexp_replace(p, pattern, r["replacement"])))
            hits = F.array_append(acc["hits"], F.struct(r["place"].alias("place"), n.alias("n")))
            after = F.transform(new, lambda f: F.struct(f.alias("free"), folded(F.array_join(f, "\u0000")).alias("seen"), hits.alias("hits")))[0]
            return F.when(n > 0, after).otherwise(acc)

        return F.when(acc["seen"].contains(r["known"]), F.transform(F.array(count), made)[0]).otherwise(acc)

    def run(pieces: Column, size: int) -> Column:
        """All rules in turn over an array of pieces of text, in blocks of so many."""
        acc = F.struct(pieces.alias("free"), folded(F.array_join(pieces, "\u0000")).alias("seen"), F.array().cast(_HITS).alias("hits"))
        for k in range(0, len(placed), size):
            some = placed[k : k + size]
            block = lambda a: F.when(a["seen"].rlike(any_of(r["known"] for r in some)), F.aggregate(table(some), a, step)).otherwise(a)  # noqa: B023, E731  built at once
            acc = F.transform(F.array(acc), block)[0]
        return acc

    def by_word(piece: Column) -> Column:
        """A piece whose words are rewritten one by one."""
        untouched = lambda w: F.struct(w.alias("text"), F.array().cast(_HITS).alias("hits"))
        ran = lambda w: F.transform(F.array(run(F.array(w), block)), lambda d: F.struct(d["free"][0].alias("text"), d["hits"].alias("hits")))[0]
        words = F.transform(F.split(piece, _GAP, -1), lambda w: F.when(folded(w).rlike(may), ran(w)).otherwise(untouched(w)))
        whole = lambda ws: F.array_join(F.zip_with(ws["text"], F.regexp_extract_all(piece, F.lit(_GAP), F.lit(0)), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.transform(F.array(words), lambda ws: F.struct(whole(ws).alias("text"), F.flatten(ws["hits"]).alias("hits")))[0]

    free = F.split(text, fixed, -1)
    if plain(rules):
        done = _by_words(free, rules)
    elif rules and all(in_words(pattern) for _, pattern, _, _ in rules):
        may, block = any_of(known for _, _, _, known in rules), -(-len(rules) // BLOCKS)
        pieces = F.transform(F.array(F.transform(free, by_word)), lambda ps: F.struct(ps["text"].alias("free"), _summed(F.flatten(ps["hits"])).alias("hits")))
        done = pieces[0]
    else:
        done = run(free, max(1, len(rules)))
    kept = F.regexp_extract_all(text, fixed, F.lit(0))

    def joined(d: Column) -> Column:
        parts = F.zip_with(d["free"], kept, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        seqs = F.transform(d["hits"], lambda h: F.struct(F.get(table(placed), h["place"])["seq"].alias("seq"), h["n"].alias("n")))
        return F.struct(F.array_join(parts, "").alias("text"), seqs.alias("hits"))

    return F.when(text.isNotNull(), F.transform(F.array(done), joined)[0])


def apply_rules(docs: DataFrame, rules: DataFrame, text: str = "text", terms: list[str] = ()) -> DataFrame:
    """The documents with `text` rewritten, and `hits` (seq, n)."""
    good, _ = checked(rules)
    made = docs.withColumn("_made", rewritten(F.col(text), good, terms))
    return made.withColumn(text, F.col("_made.text")).withColumn("hits", F.col("_made.hits")).drop("_made")


def rule_counts(applied: DataFrame, rules: DataFrame) -> DataFrame:
    """seq, category, n (rewrites) and n_docs of every rule that was used."""
    hits = applied.select(F.inline("hits")).groupBy("seq").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))
    return rules.select("seq", "category").join(hits, "seq")
