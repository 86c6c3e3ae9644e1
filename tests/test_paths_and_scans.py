import difflib
import re

from pyspark.sql import functions as F

from tessera.operators import mining as M
from tessera.operators import paths
from tessera.operators import review as V


def test_files_of_blocks(spark):
    files = ["a.html_blok_1", "a_blok_1", "b_blok_2", "x_b_y_blok_3", "zz_blok_3", "q_blok_4", "_c_blok_5", "d_x_blok_6", "e.htm_blok_7x", "B_blok_8", "p_blok_8"]
    stems = {
        "a.html_blok_1": ("a.html_blok_1", 1), "a_blok_1": ("a_blok_1", 1), "b.xhtml_blok_2": ("b_blok_2", 2), "b.htm_blok_3": ("x_b_y_blok_3", 5), "w.html_blok_4": ("q_blok_4", 6),
        "d.html_x_blok_6": ("d_x_blok_6", 3), "e.htm_blok_7": (None, None), "b.HTML_blok_8": ("B_blok_8", 6), "nothing": (None, None), "a.html_blok_9": (None, None),
    }
    asked = [("f", s) for s in [*stems, "a_blok_1"]] + [("g", "a_blok_1"), ("f", None)]
    got = paths.resolved(spark.createDataFrame(asked, "folder string, stem string"), spark.createDataFrame([("f", n) for n in [*files, files[0]]], "folder string, name string"))
    rows = {(r["folder"], r["stem"]): (r["name"], r["rank"]) for r in got.collect()}
    assert rows.pop(("g", "a_blok_1")) == (None, None) and rows.pop(("f", None), (None, None)) == (None, None)
    assert rows == {("f", s): w for s, w in stems.items()}


def _seen(spark, rows):
    return spark.createDataFrame(rows, "pattern string, kind string, book string, chunk long, score double, context string")


def test_a_repeated_scan_replaces_itself(spark, tmp_path):
    rows = [("p", "k", f"b{i % 3}", i, 5.0 + i, f"c{i}") for i in range(6)] + [("q", "k", "b0", 0, None, "x")]
    once, twice = M.SightingStore(str(tmp_path / "1")), M.SightingStore(str(tmp_path / "2"))
    once.write(_seen(spark, rows), 7)
    for part in (rows[:2], rows, rows):  # a first attempt that came only so far
        twice.write(_seen(spark, part), 7)
    table = lambda s: sorted(map(tuple, s.read(spark).collect()))
    assert table(once) == table(twice) and len(table(once)) == 7
    # A newer scan replaces what it sees again, and the rest stays.
    twice.write(_seen(spark, [("p", "k", "b0", 0, 9.0, "new"), ("r", "k", "b9", 1, 1.0, "y")]), 8)
    got = {(r["pattern"], r["book"], r["chunk"]): (r["score"], r["context"], r["first_scan"], r["scan"]) for r in twice.read(spark).collect()}
    assert got["p", "b0", 0] == (9.0, "new", 7, 8) and got["p", "b1", 1] == (6.0, "c1", 7, 7) and len(got) == 8
    by = {r["pattern"]: (r["n"], r["score_sum"], r["n_books"]) for r in M.patterns_of(twice.read(spark)).collect()}
    assert by == {"p": (6, 9.0 + 6 + 7 + 8 + 9 + 10, 3), "q": (1, 0.0, 1), "r": (1, 1.0, 1)}
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "pattern string")
    assert [r["pattern"] for r in M.unapplied(M.patterns_of(twice.read(spark)), names("p"), names("r", "s")).collect()] == ["q"]


def test_skip_corrector_equals_plain_rules(spark):
    text = " ".join(f"rijec{i}" for i in range(60))
    rows = [(8.5, text, text), (8.4, text, text), (9.0, text, text.replace("rijec3 ", "nova ")), (9.0, text, text.replace("rijec3", "nova")), (9.0, "", text), (9.0, text, None), (None, text, text), (9.0, text, " ".join(reversed(text.split())))]
    got = [r["s"] for r in spark.createDataFrame(rows, "a double, b string, c string").coalesce(1).select(V.skips_corrector(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()]

    def plain(score, b, c):
        if score is None or score < 8.5 or not b or not c:
            return False
        x, y = (set(re.findall(r"\w+", t.lower())) for t in (b, c))
        return len(x ^ y) / len(x) <= 0.05 and difflib.SequenceMatcher(None, b[:500], c[:500]).ratio() >= 0.92

    assert got == [plain(*r) for r in rows] and sum(got) >= 1
