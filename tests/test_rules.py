import random
import re

from pyspark.sql import functions as F

from tessera.operators import rules as U


def _rules(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "seq int, pattern string, replacement string, category string")


def _plain(text, rules, terms=()):
    """Pieces outside tags and terms, rules in order."""
    words = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    fixed = re.compile(r"(?:\A|<)[^<]*>" + (rf"|(?i:(?<!\w)(?:{words})(?!\w))" if words else ""))
    free, kept, hits = fixed.split(text), fixed.findall(text), []
    for seq, pattern, new in sorted(rules):
        made = [re.subn("(?i)" + pattern, new, p) for p in free]
        free, n = [m[0] for m in made], sum(m[1] for m in made)
        if n:
            hits.append((seq, n))
    return "".join(a + b for a, b in zip(free, [*kept, ""], strict=True)), hits


def test_rules_equal_plain_ones_on_random_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abčDEž") for _ in range(rng.randint(1, 4)))
    rules = [(i, p, n) for i, (p, n) in enumerate([
        (r"\bab\b", "ba"), ("b(a|č)", r"<\1>"), ("(ab)+", "x$"), ("č{2,}", "c"), ("a?b", "Q"), ("(?<=a)d", ""), (r"e\s+d", "e_d"), ("[žŽ]a", "z\\\\a"), ("q", "ab"), (r"(\w)-\1", r"\1"), ("x", "D"),
    ])]
    texts = []
    for _ in range(120):
        parts = [rng.choice([word(), word(), "<b>", '<i c="ab">', ">", "<", "a-a", "\n"]) for _ in range(rng.randint(0, 25))]
        texts.append(rng.choice(["", " "]).join(parts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "i int, text string").repartition(4)
    for terms in ([], ["ab", "abE", "žč"]):
        got = {r["i"]: (r["text"], [tuple(h) for h in r["hits"]] if r["hits"] is not None else None) for r in U.apply_rules(docs, _rules(spark, rules), terms=terms).collect()}
        assert got.pop(-1) == (None, None) and got.pop(-2) == ("", [])
        plain = [(s, p, n) for s, p, n in rules]
        for i, t in enumerate(texts):
            assert got[i] == _plain(t, plain, terms), (t, terms)


def test_a_rule_sees_what_an_earlier_one_made(spark):
    docs = spark.createDataFrame([("alpha",)], "text string")
    made = U.apply_rules(docs, _rules(spark, [(2, "beta", "gamma"), (1, "alpha", "beta"), (3, "alpha", "never")])).head()
    assert (made["text"], [tuple(h) for h in made["hits"]]) == ("gamma", [(1, 1), (2, 1)])


def test_bad_rules_are_left_out_and_reported(spark):
    rules = _rules(spark, [(1, "(", "x"), (2, "ok", r"\1"), (3, None, "x"), (4, "", "x"), (5, "(o)k", r"\1"), (6, "$", "$")])
    good, bad = U.checked(rules)
    assert [r[0] for r in good] == [5, 6] and [b[0] for b in bad] == [1, 2, 3, 4] and "group" in bad[1][2]


def test_known_texts():
    cases = {r"\bčovek\b": "ČOVEK", "a(bc|d)ef": "EF", "(abc)+x": "ABC", "(abc)?xy": "XY", "[ab]": "", "ab?cde": "CDE", "x{0,3}": "", "(?:foo|bar)": "", "(": "", "mogu da (\\w+)": "MOGU DA "}
    assert {p: U.known_by(p) for p in cases} == cases
    # Case-blind matching goes beyond lower case.
    assert U._folded("Kelvin ſ Σς İ") == "KELVIN S ΣΣ I"


def test_terms_keep_their_case_digits_and_bounds(spark):
    docs = spark.createDataFrame([("Ana ima 3 psa, ANABELA i Anatolija. ana 12.",)], "text string")
    made = U.apply_rules(docs, _rules(spark, [(1, "[0-9]+", "#"), (2, "an", "on")]), terms=["Ana", "Anabela"]).head()
    assert made["text"] == "Ana ima # psa, ANABELA i onatolija. ana #."


def test_counts_per_rule(spark):
    docs = spark.createDataFrame([("aa b",), ("a c",), ("<a>",)], "text string")
    rules = _rules(spark, [(1, "a", "x"), (2, "b", "y"), (3, "zz", "y")])
    got = U.rule_counts(U.apply_rules(docs, rules), rules).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [(1, "c", 3, 2), (2, "c", 1, 1)]


def test_hundreds_of_rules_fit_one_plan(spark):
    rules = _rules(spark, [(i, rf"\bw{i} (\w+)\b", rf"v{i} \1") for i in range(700)])
    docs = spark.range(50).select(F.concat_ws(" ", F.transform(F.sequence(F.col("id"), F.col("id") + 20), lambda x: F.concat(F.lit("w"), x.cast("string"), F.lit(" q")))).alias("text"))
    rows = U.apply_rules(docs, rules).collect()
    assert all("w" not in r["text"] and len(r["hits"]) == 21 for r in rows)


def test_rules_in_words_equal_plain_ones_and_rules_on_whole_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abčDEž-.") for _ in range(rng.randint(1, 6)))
    rules = [(i, p, n) for i, (p, n) in enumerate([
        ("ab", "ba"), ("b(a|č)", r"<\1> a"), ("(ab)+", "x b"), ("č{2,}", ""), (r"\bd\w*", "Q"), ("[žŽ]a", "bab"), ("q", "ab"), (r"a\b", "ab"), ("ba", "d+"), ("x", ""),
    ])]
    assert all(U.in_words(p) for _, p, _ in rules)
    texts = ["".join(rng.choice([word() + " ", word(), "  ", "\n", "\t ", "\u00a0", "<b>", '<i c="ab">', ">", "<"]) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, ""), (-3, " ")], "i int, text string").repartition(4)
    # A rule that never matches, but might match white space: all rules see whole texts.
    more = [*rules, (len(rules), "never seen", "x")]
    for terms in ([], ["ab", "a b", "žč"]):
        got, whole = ({r["i"]: (r["text"], r["hits"]) for r in U.apply_rules(docs, _rules(spark, x), terms=terms).collect()} for x in (rules, more))
        assert got == whole
        for i, t in enumerate(texts):
            assert (got[i][0], [tuple(h) for h in got[i][1]]) == _plain(t, rules, terms), (t, terms)


def test_which_rules_stay_in_words():
    inside = ["word", r"\bword\b", "a(b|c)+d", "[a-zž]x", r"\w+x", "x{2,}", "(?:ab)?c"]
    beyond = ["a b", r"a\s+b", "^a", "a$", "a.b", "[^a]b", "(?<= )a", "a(?! )", "a*", "", "(", r"a\Wb", "[a[^b]]", r"(a)\1", "[ -z]a", "(?x)a b", "a(?-i:b)"]
    assert all(map(U.in_words, inside)) and not any(map(U.in_words, beyond))


def test_any_of_finds_each_of_many_texts():
    found = re.compile(U.any_of(["THAT", "THIS", "TH.", "WITH", "WITHOUT"])).search
    assert all(found(f"x{t}x") for t in ("THAT", "THIS", "TH.", "WITH")) and not any(map(found, ("THE", "WIT", "")))
    assert U.any_of(["AB", ""]) == ""


def test_plain_rules_are_kept_by_word_and_equal_rules_on_whole_texts(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abki\u017f\u212a\u0131\u0130čDE+-.'") for _ in range(rng.randint(1, 6)))
    rules = [(i, p, n) for i, (p, n) in enumerate([("ab", "BA"), ("ba", "x ab"), ("k", "AB+"), ("DE", "de de"), ("ki", ""), ("i", "č"), ("s", "k"), ("x", "ba")])]
    more = [*rules, (len(rules), "never seen", "x")]  # all rules see whole texts, in the JVM
    texts = ["".join(rng.choice([word() + " ", word(), "  ", "\n", "\t ", " ", "<b>", '<i c="ab">', ">", "<"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, ""), (-3, " ")], "i int, text string").repartition(2)
    monkeypatch.setattr(U, "WORDS", 3)
    for terms in ([], ["ab", "a b", "ki"]):
        got, whole = ({r["i"]: (r["text"], r["hits"]) for r in U.apply_rules(docs, _rules(spark, x), terms=terms).collect()} for x in (rules, more))
        assert got == whole and sum(map(bool, (h for _, h in got.values()))) > 100
    plan = U.apply_rules(docs, _rules(spark, rules))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "ArrowEvalPython" in plan


def test_python_and_java_find_plain_letters_alike(spark):
    letters = "abcdefghijklmnopqrstuvwxyz0"
    every = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "utf-32").alias("c"))
    found = every.where(F.length(F.regexp_replace("c", f"(?iU)[{letters}]", "")) == 0).select(F.col("id"), *(F.col("c").rlike(U.FLAGS + x).alias(x) for x in letters)).collect()
    java = {(x, chr(r["id"])) for r in found for x in letters if r[x]}
    python = {(x, chr(i)) for x in letters for i in range(1, 0x110000) if not 55296 <= i <= 57343 and re.fullmatch(x, chr(i), re.IGNORECASE)}
    assert java == python and ("k", "K") in java


def test_which_rules_are_plain():
    rule = lambda pattern, new: (1, pattern, new, "")
    words = U.Words([(0, "ab", "", ""), (1, "cd", "x", ""), (2, "xb", "y", "")])
    assert words.rewrite(["q" * 200 + "aCDb", "cdb CDB"]) == (["q" * 200 + "ay", "y y"], [(1, 3), (2, 3)])
    assert U.plain([rule("abc1", "x +"), rule("D", "")])
    assert not any(U.plain([rule("ab", "x"), r]) for r in (rule("a.", "x"), rule("ž", "x"), rule("a", "$0"), rule("a", r"\\"), rule("a b", "x"))) and not U.plain([])
