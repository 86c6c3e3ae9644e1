import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocks as B
from tessera.operators import scoring as S


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).head()[0]


def test_typography(spark):
    assert _one(spark, 'a ... b -- c "d" 3 - 4 , e', T.typography) == 'a … b — c „d" 3–4, e'
    assert _one(spark, "x.....y", T.typography) == "x…y"


def test_homoglyphs_only_below_a_tenth(spark):
    assert _one(spark, "Dоbar dan svima", T.homoglyphs) == "Dobar dan svima"
    assert _one(spark, "Добар дан", T.homoglyphs) == "Добар дан"


def test_safe_name(spark):
    assert _one(spark, "Čudna Knjiga.epub", T.safe_name) == "Cudna_Knjiga.epub"
    assert _one(spark, "", T.safe_name) == "nepoznato.epub"
    assert _one(spark, "...", T.safe_name) == "knjiga.epub"
    assert _one(spark, None, T.safe_name) == "nepoznato.epub"


def test_max_trigram_against_counting(spark):
    text = "a b c d " * 5 + " ".join(f"w{i}" for i in range(10))
    words = text.split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert _one(spark, text, T.max_trigram) == max(map(grams.count, grams))
    assert _one(spark, "a a a", T.max_trigram) == 0
    assert _one(spark, "", T.max_trigram) == 0


def test_heuristic_score_cases(spark):
    rows = [("kratko",), ("Lijepa rečenica bez ijedne engleske riječi, dovoljno duga da prođe.",), ("the and was for with his they have from this that are not but had her she him been when into there then than would could their the and was",)]
    got = S.heuristic_score(spark.createDataFrame(rows, "text string")).collect()
    assert [r["score"] for r in got] == [1.0, 9.8, 1.0]
    assert got[0]["reasons"] == ["empty or too short"] and got[2]["reasons"] == ["untranslated"]


def test_blocks_pack_greedily(spark):
    text = "\n".join(["a b c", "", "d e", "f g h i j k", "l"])
    rows = B.blocks(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text", 5).orderBy("block").collect()
    assert [(r["id"], r["n_words"], r["text"]) for r in rows] == [(1, 5, "a b c\n\nd e"), (1, 6, "f g h i j k"), (1, 1, "l")]


def test_rewrite_skips_tags(spark):
    rules = F.array(F.struct(F.lit("dom").alias("pattern"), F.lit("kuća").alias("replacement")))
    for change in (lambda t: T.rewrite(t, [("dom", "kuća")]), lambda t: T.rewrite_by(t, rules)):
        assert _one(spark, '<a title="dom">Dom je dom</a>', change) == '<a title="dom">kuća je kuća</a>'
        assert _one(spark, "dom > dom <b>dom</b> dom", change) == "dom > kuća <b>kuća</b> kuća"
        assert _one(spark, "dom < dom", change) == "kuća < kuća"
        assert _one(spark, None, change) is None


def test_holds_looks_for_whole_words(spark):
    assert _one(spark, "od strane čovjeka", lambda t: T.holds(t, r"\bod strane\s+\w+a\b"))
    assert not _one(spark, "od stranex čovjeka", lambda t: T.holds(t, r"\bod strane\s+\w+a\b"))
    assert _one(spark, "posedujem", lambda t: T.holds(t, r"\bposedujem?\b")) and not _one(spark, "posedujemo", lambda t: T.holds(t, r"\bposedujem?\b"))


def test_max_trigram_counts_the_commonest_run(spark):
    assert _one(spark, "a b c " * 8, T.max_trigram) == 8 and _one(spark, " ".join(map(str, range(30))), T.max_trigram) == 1
    assert _one(spark, "a b c " * 6, T.max_trigram) == 0 and _one(spark, "", T.max_trigram) == 0


def test_length_flag_bounds(spark):
    row = spark.createDataFrame([("x" * 100, "y" * 91, "LEKTOR"), ("x" * 100, "y" * 92, "LEKTOR"), ("x" * 100, "y" * 14, "LEKTOR"), ("", "y" * 50, "RETRO")], "a string, b string, r string")
    assert [r[0] for r in row.select(T.length_flag(F.col("a"), F.col("b"), F.col("r"))).collect()] == [True, False, False, False]


def test_block_type(spark):
    assert _one(spark, "<p>a</p><br><br/><br />", T.block_type) == "poetski"
    assert _one(spark, "— Da.\n— Ne.", T.block_type) == "dijalog"
    assert re.match("opis|naracija", _one(spark, "x" * 130 + ".", T.block_type))


def test_duplicate_heading_goes(spark, tmp_path):
    from tessera.plans import catalog

    rows = [(1, "A heading\nand text"), (2, "ab\nshort lines stay doubled"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in catalog.QUERIES["duplicate_heading"](spark, str(tmp_path)).collect()}
    assert got[1] == "A heading\nand text" and got[2] == "ab\nab\nshort lines stay doubled"
