"""Operators over rules, characters, clues and keys, on awkward rows."""

import difflib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import key_state as K
from tessera.operators import review as V


def test_characters_stand_inside_sentences(spark):
    text = "Tamo Marko ide. Marko stoji.\nMarko i Marko, te Marko. ali Ali Ali Ali Ali"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, text string")
    assert [tuple(r) for r in V.characters(rows, ["i"]).collect()] == [(1, "Marko", 3)]


def test_rules_are_counted_in_order(spark):
    rows = spark.createDataFrame([(1, "aab"), (2, None), (3, "")], "i int, text string")
    got = {r["i"]: (r["text"], r["counts"]) for r in V.counted_rewrite(rows, [("a", "b"), ("b", "c")]).collect()}
    assert got == {1: ("ccc", [2, 3]), 2: (None, [None, None]), 3: ("", [0, 0])}


def test_protected_terms_keep_their_letters(spark):
    rows = spark.createDataFrame([("Ana Anabela na",), (None,)], "t string")
    got = rows.select(V.protected(F.col("t"), ["Ana", "Anabela"], lambda t: F.regexp_replace(t, "a", "o"))).collect()
    assert [r[0] for r in got] == ["Ana Anabela no", None]


def test_gender_clues(spark):
    rows = spark.createDataFrame([(1, "Ana se je smijala. smijao je Ivo! gospodin Kos; Ana je smijalac"), (2, None)], "i int, text string")
    got = sorted((r["i"], r["name"], r["clue"]) for r in V.gender_clues(rows, {"smijao": "smijala"}, {"gospodin": "M"}).collect())
    assert got == [(1, "Ana", "Ž"), (1, "Ivo", "M"), (1, "Kos", "M")]


def test_key_states(spark):
    start = datetime(2024, 1, 1)
    answers = [(0, 200, 0), (1, 429, 30), (20, 200, 0), (40, 401, 0), (400, 403, 0), (5000, 200, 0)]
    rows = [("P", 1, start + timedelta(seconds=s), i, code, after, 45) for i, (s, code, after) in enumerate(answers)]
    calls = spark.createDataFrame(rows, "provider string, key int, ts timestamp_ntz, seq int, code int, retry_after int, usual int")
    got = sorted(K.key_states(calls, 2.0).collect(), key=lambda r: r["seq"])
    assert [r["free"] for r in got] == [True, False, False, True, True, False]
    first = got[1]["resting_until"] - 31_000_000
    assert got[0]["resting_until"] == 0
    assert [(r["resting_until"] - first) // 1_000_000 for r in got[1:]] == [31, 31, 340, 86800, 86800]


def test_models(spark):
    rows = spark.createDataFrame([("GEMINI", "Gemini-Flash"), ("GEMINI", "flash-pro"), ("X", "y"), ("X", "bert"), ("X", None), ("openrouter", "a:free"), ("OPENROUTER", "a")], "provider string, model string")
    assert [r[0] for r in rows.where(V.chats(F.col("provider"), F.col("model"))).select("model").collect()] == ["Gemini-Flash", "y", "a:free"]
    models = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1")], "provider string, model string")
    dead = spark.createDataFrame([("A", "1"), ("B", "1"), ("A", "1")], "provider string, model string")
    assert sorted(map(tuple, V.living(models, dead).collect())) == [("A", "2"), ("B", "1")]


def test_change_is_worked_out_once_for_the_corrector(spark):
    from tessera.operators import review

    rows = [(9.0, "a b", "a b"), (9.0, "a b", "c d"), (None, "a b", "a b"), (9.0, None, "a"), (9.0, "", ""), (1.0, "a b", "a b")]
    docs = spark.createDataFrame(rows, "score double, before string, after string")
    made = docs.select(review.skips_corrector(F.col("score"), F.col("before"), F.col("after")).alias("skips"))
    assert [r["skips"] for r in made.collect()] == [True, False, False, False, False, False]
    above, below = made._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")
    assert "array_except" in below and "array_except" not in above


def test_corrector_is_skipped_by_whole_texts(spark):
    text = " ".join(f"rijec{i}" for i in range(3000))
    turned = text[:600] + " ".join(reversed(text[600:].split(" ")))
    rows = [(9.0, text, turned), (9.0, text, text), (9.0, text[:300], text[:280] + text[280:300].upper())]
    got = spark.createDataFrame(rows, "score double, before string, after string").coalesce(1).select(V.skips_corrector(F.col("score"), F.col("before"), F.col("after"))).collect()
    want = [difflib.SequenceMatcher(None, b, a).ratio() >= 0.92 for _, b, a in rows]
    assert [r[0] for r in got] == want == [False, True, True]


def test_reaching_a_likeness_equals_the_ratio():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgxyzqž") for _ in range(rng.randint(1, 7)))
    found = set()
    for k in range(150):
        words = [word() for _ in range(rng.choice([0, 1, 5, 40, 200]))]
        edited = [word() if rng.random() < k / 1500 else w for w in words]
        a, b = " ".join(words), " ".join(edited)
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        for least in (0.5, 0.92, ratio, min(1.0, ratio + 1e-12)):
            assert V.reaches(a, b, least) == (ratio >= least), (a, b, least)
        found.add(ratio >= 0.92)
    assert found == {True, False}
