import random

import pytest

from tessera.plans import catalog
from tests.oracle import SF_DIR, compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"similar_exemplars", "exemplar_lookup"}))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_glossaries_equal_plain_search(spark):
    from tessera.operators.glossary import contained

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB ž") for _ in range(n))
    docs = [(i, word(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 5000 + "Kuća")]
    terms = [(i, word(rng.choice([1, 2, 3, 5, 8, 12]))) for i in range(40)] + [(50, None), (51, ""), (52, "KUĆA"), (53, docs[3][1] or "a"), (54, "x" * 40)]
    found = contained(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(terms, "term_id int, term string"))
    want = sorted((d, t) for d, x in docs for t, y in terms if x is not None and y and y.lower() in x.lower())
    assert sorted(map(tuple, found.collect())) == want and len(want) > 100


def test_name_distance_of_ids_with_gaps_matches_sql(spark, tmp_path):
    rows = [(i, f"name{'abc' * (i % 4)} of an item") for i in (3, 7, 8, 900, -5)]
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/b")
    next((tmp_path / "b").glob("*.parquet")).rename(tmp_path / "benchmark.parquet")
    compare(spark, catalog.QUERIES["name_distance"], catalog.ORACLES["name_distance"], str(tmp_path))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_on_scores_do_not_work_them_out_again(spark):
    plan = lambda name: catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    once = plan("heuristic_score").count("nevertheless")
    for name in ("bad_blocks", "blocks_by_file", "review_merge", "top_candidates", "status_report"):
        assert plan(name).count("nevertheless") == once, name
    for name in ("upsert_candidates", "promote_candidates", "ready_patterns"):  # texts are read once, too
        assert plan(name).count("parquet") == 1 and "Join" not in plan(name), name


def test_trigrams_are_counted_where_a_text_is_read_and_ids_of_many_rows_together(spark, tmp_path):
    def plan(folder):
        return catalog.QUERIES["repeated_trigrams"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()

    assert "Aggregate [" not in plan(SF_DIR)
    text = "one two three four " * 2 + "x" * 200
    rows = [(1, text), (1, text), (2, text), (2, text + " one two three"), (3, text + " one two three"), (None, text), (None, text), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    compare(spark, catalog.QUERIES["repeated_trigrams"], catalog.ORACLES["repeated_trigrams"], str(tmp_path))
    assert catalog.QUERIES["repeated_trigrams"](spark, str(tmp_path)).where("doc_id = 3").count() == 1


def test_patterns_of_a_score_are_searched_once_a_text(spark):
    from tessera.operators.scoring import QUOTES

    plan = catalog.QUERIES["bad_blocks"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-z]{2,}") == 1 and plan.count(QUOTES) == 1


def test_rows_of_one_id_and_full_bitmaps_lose_and_double_no_terms(spark):
    from tessera.operators.glossary import contained

    docs = spark.createDataFrame([(1, "Aaa needle bbb"), (1, "x NEEDLE"), (2, "nothing " * 500), (None, "needles")], "doc_id int, text string")
    terms = spark.createDataFrame([(7, "needle"), (8, "zzzzzzzzzzzz"), (7, "s")], "term_id int, term string")
    want = [("1", 7), ("1", 7), ("None", 7), ("None", 7)]
    for bits in (20, 1):
        assert sorted((str(d), t) for d, t in contained(docs, terms, bits).collect()) == want
