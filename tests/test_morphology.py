import random
import re

from pyspark.sql import functions as F

from tessera.functions.forms import DOUBTFUL, FEMALE_FORMS, RIGHT, WRONG_FORMS
from tessera.operators import morphology as M


def _capitals(old, new):
    if len(old) > 1 and old.upper() == old and old.lower() != old:
        return new.upper()
    return new[0].upper() + new[1:] if old[0].isupper() else new


def _texts(seed, n, words):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(words)
            parts.append(rng.choice([w, w, w.capitalize(), w.upper()]) + rng.choice([" ", " ", "  ", ", ", ". ", "\n", "-", ""]))
        out.append("".join(parts))
    return out


def test_doubtful_forms_equal_a_plain_scan(spark):
    texts = _texts(1, 80, ["gledavao", "poznavao", "hodavala", "uzdisnuo", "sijedio", "popivajući", "kuća", "radivao", "Ivao", "čitavao", "je"])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "i int, text string")
    want = []
    for i, t in enumerate(texts):
        for m in re.finditer(M.WORD.replace("(?U)", ""), t):
            for k, p in enumerate(DOUBTFUL):
                if re.fullmatch(p, m[0], re.I) and m[0].lower() not in RIGHT:
                    want.append((i, k, m[0], m.start(), t[max(0, m.start() - 40) : m.end() + 40].replace("\n", " ")))
    got = M.doubtful_forms(docs, "i").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
    assert all(texts[r["i"]][r["position"] :].startswith(r["form"]) for r in got)


def test_mended_forms_equal_word_by_word(spark):
    texts = _texts(2, 80, [*list(WRONG_FORMS)[:12], "kuća", "VOLJEVAO", "x"])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, text string")
    got = {r["i"]: r["m"] for r in docs.select("i", M.mended_forms(F.col("text")).alias("m")).collect()}
    assert got[-1] is None
    for i, t in enumerate(texts):
        changes = []

        def mend(m, changes=changes):
            new = WRONG_FORMS.get(m[0].lower())
            if new is None:
                return m[0]
            changes.append((m[0], _capitals(m[0], new)))
            return changes[-1][1]

        assert got[i]["text"] == re.sub(M.WORD.replace("(?U)", ""), mend, t)
        assert [tuple(c) for c in got[i]["changes"]] == changes


def _corrected(text, genders):
    """By hand: words and gaps, the name before first."""
    pattern = re.compile(M.WORD.replace("(?U)", ""))
    words, gaps = pattern.findall(text), pattern.split(text)
    male = {f: m for m, f in FEMALE_FORMS.items()}
    out, n = list(words), 0
    white = lambda i: i < len(gaps) and re.fullmatch(r"\s+", gaps[i])
    low = [w.lower() for w in words]
    for i, w in enumerate(low):
        if w not in FEMALE_FORMS and w not in male:
            continue
        gender = None
        if i >= 2 and low[i - 1] == "je" and white(i) and white(i - 1):
            j = i - 3 if low[i - 2] == "se" else i - 2
            if j >= 0 and (j == i - 2 or white(i - 2)):
                gender = genders.get(low[j])
        if gender is None and i + 2 < len(words) and low[i + 1] == "je" and white(i + 1) and white(i + 2):
            gender = genders.get(low[i + 2])
        new = FEMALE_FORMS.get(w) if gender == "Ž" else male.get(w) if gender == "M" else None
        if new:
            out[i], n = _capitals(words[i], new), n + 1
    return "".join(g + w for g, w in zip(gaps, [*out, ""], strict=True)), n


def test_gender_is_corrected_by_the_registry_of_the_book(spark):
    texts = [
        "Ana je rekao da je došao. Rekao je Ana.", "ANA se je VIDIO, a Marko je bila tu.", "Nitko je rekao Ana je bio", "Ana, je rekao", "Ana-Marija je rekao", "", "Marko je rekla je Ana",
        *_texts(3, 150, ["Ana je rekao", "Marko se je bila", "rekla je Iva", "bio je Ana", "Iva", "Ana", "je rekla je", "rekao"]),
    ]
    rows = [(i, f"b{i % 2}", t) for i, t in enumerate(texts)] + [(-1, "b0", None)]
    docs = spark.createDataFrame(rows, "i int, book string, text string").repartition(4)
    registry = [("b0", "Ana", "Ž"), ("b0", "Marko", "M"), ("b0", "Iva", None), ("b1", "Ana", "M"), ("b1", "Iva", "Ž")]
    got = {r["i"]: (r["text"], r["n_corrected"]) for r in M.gender_corrected(docs, "i", "book", spark.createDataFrame(registry, "book string, name string, gender string")).collect()}
    assert got.pop(-1) == (None, 0)
    for i, book, t in rows[:-1]:
        assert got[i] == _corrected(t, {n.lower(): g for b, n, g in registry if b == book and g}), t
    assert got[0] == ("Ana je rekla da je došao. Rekla je Ana.", 2)
    assert sum(n for _, n in got.values()) > 30


def test_words_that_fit_no_pattern_are_left_out_by_one_search(spark):
    from tessera.operators import morphology

    docs = spark.createDataFrame([(1, "aa ab ba bb abab"), (2, None)], "k int, text string")
    found = morphology.doubtful_forms(docs, "k", patterns=["a.", ".b", "abab"], right=["ba"])
    assert sorted((r["pattern"], r["form"], r["position"]) for r in found.collect()) == [(0, "aa", 0), (0, "ab", 3), (1, "ab", 3), (1, "bb", 9), (2, "abab", 12)]
    assert "a.)|(?:.b)|(?:abab" in found._jdf.queryExecution().optimizedPlan().toString()
    twice = morphology.doubtful_forms(docs, "k", patterns=["x", r"(ab)\1"], right=[])
    assert [(r["pattern"], r["form"]) for r in twice.collect()] == [(1, "abab")]
