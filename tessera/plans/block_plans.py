"""Queries over blocks, names and mined rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import blocks as B
from tessera.operators import mining as M
from tessera.operators import names as N
from tessera.operators.glossary import contained
from tessera.operators.ordering import first_rows
from tessera.plans.registry import Registry
from tessera.plans.score_plans import SCORE_CTE, scored
from tessera.plans.text_plans import _WORDS
from tessera.sources.tables import table

R = Registry()
MAX_WORDS = 120

CHUNK_CTE = f"""p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
pw AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS t FROM p),
pc AS (SELECT doc_id, i, t, len({_WORDS.format("t")}) AS w FROM pw)"""
_CHUNKS = f"""WITH RECURSIVE {CHUNK_CTE},
r AS (SELECT doc_id, i, w AS n, 0 AS block FROM pc WHERE i = 1
  UNION ALL SELECT c.doc_id, c.i, CASE WHEN r.n > 0 AND r.n + c.w > {MAX_WORDS} THEN c.w ELSE r.n + c.w END, r.block + CASE WHEN r.n > 0 AND r.n + c.w > {MAX_WORDS} THEN 1 ELSE 0 END
  FROM r JOIN pc c ON c.doc_id = r.doc_id AND c.i = r.i + 1),
g AS (SELECT r.doc_id, block, sum(w) AS n_words, string_agg(t, chr(10) ORDER BY r.i) AS text FROM r JOIN pc ON r.doc_id = pc.doc_id AND r.i = pc.i GROUP BY ALL HAVING sum(w) > 0),
bl AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1)::INT AS block, n_words::BIGINT AS n_words, text FROM g)"""


@R.add(f"{_CHUNKS} SELECT doc_id, block, n_words, text FROM bl")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.blocks(table(spark, sf_dir, "documents"), "doc_id", "text", MAX_WORDS)


@R.add(f"""{_CHUNKS} SELECT doc_id, block, coalesce(right(lag(text) OVER w, 600), '') AS before, coalesce(left(lead(text) OVER w, 400), '') AS after
FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY block)""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_context(chunk_words(spark, sf_dir), "doc_id", "block", "text").select("doc_id", "block", "before", "after")


@R.add(f"{_CHUNKS} SELECT doc_id, string_agg(CASE WHEN block % 3 = 1 THEN left(text, 50) || '*' ELSE text END, chr(10) ORDER BY block) AS text, count(*) AS n_blocks FROM bl GROUP BY doc_id")
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_words(spark, sf_dir).withColumn("edited", F.when(F.col("block") % 3 == 1, F.concat(F.left("text", F.lit(50)), F.lit("*"))))
    return B.reassemble(rows, "doc_id", "block", "edited", "text")


@R.add(f"{_CHUNKS} SELECT count(*) AS n_blocks, sum(n_words)::BIGINT AS n_words, max(n_words) AS longest FROM bl")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_words(spark, sf_dir).agg(F.count("*").alias("n_blocks"), F.sum("n_words").alias("n_words"), F.max("n_words").alias("longest"))


@R.add("SELECT source, doc_id, coalesce(lag(left(text, 100)) OVER (PARTITION BY source ORDER BY doc_id), 'Početak') AS previous FROM documents")
def previous_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.left("text", F.lit(100)).alias("summary"))
    earlier = F.lag("summary").over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select("source", "doc_id", F.coalesce(earlier, F.lit("Početak")).alias("previous"))


@R.add("""WITH w AS (SELECT source, doc_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents)
SELECT source, doc_id, used::BIGINT AS used FROM w WHERE used <= 20000""")
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").cast("long").alias("n"))
    return B.within_budget(docs, "source", "doc_id", "n", 20000).select("source", "doc_id", "used")


_NOUNS = f"WITH t AS (SELECT source, unnest(regexp_extract_all(text, '{N.NAME}')) AS name FROM documents), c AS (SELECT source, name, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 2)"


@R.add(f"{_NOUNS} SELECT source, name, n FROM c")
def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.proper_nouns(table(spark, sf_dir, "documents"), ["source"])


@R.add(f"{_NOUNS} SELECT source, name, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, name) AS k FROM c) WHERE k <= 3")
def top_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(proper_nouns(spark, sf_dir), ["source"], [F.desc("n"), F.asc("name")], 3)


@R.add(f"{_NOUNS}, a AS (SELECT name, sum(n)::BIGINT AS n FROM c GROUP BY name) SELECT left(name, 4) AS prefix, name, n, ((row_number() OVER (PARTITION BY left(name, 4) ORDER BY n DESC, name) - 1) // 8)::BIGINT AS batch FROM a")
def name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = proper_nouns(spark, sf_dir).groupBy("name").agg(F.sum("n").alias("n")).withColumn("prefix", F.left("name", F.lit(4)))
    number = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("n"), "name"))
    return totals.select("prefix", "name", "n", F.floor((number - 1) / 8).alias("batch"))


@R.add("SELECT source, list_sort(list_distinct(flatten(list(regexp_extract_all(text, '[A-Z]{3,}'))))) AS names FROM documents WHERE regexp_matches(text, '[A-Z]{3,}') GROUP BY source")
def name_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Z]{3,}"), F.lit(0))).alias("t"))
    return tokens.distinct().groupBy("source").agg(F.array_sort(F.collect_list("t")).alias("names"))


def _often(items: Column, least: int) -> Column:
    """item and n of the items that an array holds so often."""
    start = F.struct(F.lit("").alias("item"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<item:string,n:bigint>>").alias("out"))
    closed = lambda acc: F.when(acc["n"] >= least, F.array_append(acc["out"], F.struct(acc["item"].alias("item"), acc["n"].alias("n")))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        more = F.struct(acc["item"].alias("item"), (acc["n"] + 1).alias("n"), acc["out"].alias("out"))
        return F.when((acc["n"] > 0) & (acc["item"] == x), more).otherwise(F.struct(x.alias("item"), F.lit(1).cast("long").alias("n"), closed(acc).alias("out")))

    return F.aggregate(F.sort_array(items), start, step, closed)


_DECLINED = ", ".join(f"'{c}': CASE WHEN ends_with(name, 'a') THEN left(name, length(name) - 1) || '{f}' ELSE name || '{m}' END" for c, m, f in zip(B.CASES, B.MALE, B.FEMALE, strict=True))


@R.add(f"{_NOUNS}, x AS (SELECT DISTINCT name FROM c WHERE n >= 5) SELECT name, {{{_DECLINED}}}['G'] AS genitive, {{{_DECLINED}}}['I'] AS instrumental FROM x")
def decline_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = proper_nouns(spark, sf_dir).where("n >= 5").select("name").distinct().withColumn("forms", B.decline(F.col("name")))
    return names.select("name", F.col("forms")["G"].alias("genitive"), F.col("forms")["I"].alias("instrumental"))


@R.add("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zäöüßàâçéèêëîïôûùáíóúñ]+') AS w FROM documents WHERE length(text) > 200),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS gram FROM t WHERE len(w) >= 3)
SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 3""")
def repeated_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüßàâçéèêëîïôûùáíóúñ]+"), F.lit(0))
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 200).select("doc_id", w.alias("w")).where(F.size("w") >= 3)
    made = F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat_ws(" ", F.slice("w", i, 3)))
    few = docs.select("doc_id", F.inline(_often(made, 3)).alias("gram", "n"))
    twice = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("id"))
    if not twice.limit(1).count():
        return few
    # Rows of one id count together, so their runs, rare or not, must meet.
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    grams = docs.join(twice, same, "left_semi").select("doc_id", F.explode(made).alias("gram"))
    return few.join(twice, same, "left_anti").union(grams.groupBy("doc_id", "gram").agg(F.count("*").alias("n")).where("n >= 3"))


RULES = [("idiot\\w*", "en_kalk"), ("clown", "en_kalk"), ("tion of the", "ekavizam"), ("der die", "ekavizam"), ("licensed under", "info")]
_RULE_ROWS = "(VALUES " + ", ".join(f"('{p}', '{k}')" for p, k in RULES) + ") AS ru(pattern, kind)"
_HITS = f"h AS (SELECT doc_id, source, pattern, kind, regexp_extract(text, pattern, 0, 'i') AS match FROM documents, {_RULE_ROWS} WHERE regexp_matches(text, pattern, 'i'))"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hits(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), RULES)


@R.add(f"WITH {_HITS} SELECT doc_id, pattern, kind, match FROM h")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id", "pattern", "kind", "match")


_CANDIDATES = f"""WITH {SCORE_CTE}, {_HITS},
ca AS (SELECT pattern, kind, count(*) AS n, sum(score) AS score_sum, list_sort(list(DISTINCT h.source)) AS books, max(h.doc_id) AS seq FROM h JOIN sc ON h.doc_id = sc.doc_id WHERE score >= 4.0 GROUP BY pattern, kind)"""


def _scored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in texts that score 4 or more, with the score: each text is read and scored once, and nothing is joined."""
    return M.hits(scored(spark, sf_dir).where("score >= 4.0 AND doc_id IS NOT NULL"), RULES)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_hits(spark, sf_dir)
    seen = rows.select("pattern", "kind", F.lit(1).cast("long").alias("n"), F.col("score").alias("score_sum"), F.array("source").alias("books"), "context", F.col("doc_id").alias("seq"))
    return M.upsert(seen.limit(0), seen)


@R.add(f"{_CANDIDATES} SELECT pattern, kind, n, round(score_sum, 6) AS score_sum, books, seq FROM ca")
def upsert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("pattern", "kind", "n", F.round("score_sum", 6).alias("score_sum"), "books", "seq")


@R.add(f"{_CANDIDATES} SELECT pattern, n FROM ca WHERE n >= 3 AND len(books) >= 2")
def ready_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).where((F.col("n") >= M.MIN_SEEN) & (F.size("books") >= M.MIN_BOOKS)).select("pattern", "n")


@R.add(f"{_CANDIDATES} SELECT pattern, CASE WHEN kind IN ('rod_mijesanje', 'info') THEN 'info' WHEN score_sum / n > 8.8 THEN 'odbijen' WHEN n >= 5 AND len(books) >= 2 AND score_sum / n <= 8.2 THEN 'na_cekanju' ELSE 'kandidat' END AS state FROM ca")
def validate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = M.validated(F.col("n"), F.size("books"), F.col("score_sum") / F.col("n"), F.col("kind"))
    return _candidates(spark, sf_dir).select("pattern", state.alias("state"))


@R.add(f"{_CANDIDATES} SELECT pattern, CASE WHEN seq % 3 >= 2 THEN 'odbijen' WHEN score_sum / n < 7.5 THEN 'aktivan:strong' WHEN score_sum / n < 8.2 THEN 'aktivan' ELSE 'odbijen' END AS state FROM ca")
def promote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("pattern", M.promoted(F.col("score_sum") / F.col("n"), F.col("seq") % 3).alias("state"))


@R.add(f"{_CANDIDATES} SELECT kind, count(*) AS n_patterns, sum(n)::BIGINT AS n FROM ca GROUP BY kind")
def candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n_patterns"), F.sum("n").alias("n"))


@R.add(f"{_CANDIDATES} SELECT pattern, n, round(score_sum / n, 6) AS average FROM ca WHERE n >= 2 ORDER BY n DESC, score_sum / n, pattern LIMIT 3")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    average = F.round(F.col("score_sum") / F.col("n"), 6).alias("average")
    ordered = _candidates(spark, sf_dir).where("n >= 2").orderBy(F.desc("n"), F.col("score_sum") / F.col("n"), "pattern").limit(3)
    return ordered.select("pattern", "n", average)


@R.add(f"WITH {_HITS} SELECT pattern, count(DISTINCT source) AS n_books, count(*) AS n FROM h GROUP BY pattern ORDER BY n DESC, pattern LIMIT 20")
def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = _hits(spark, sf_dir).groupBy("pattern").agg(F.count_distinct("source").alias("n_books"), F.count("*").alias("n"))
    return grouped.orderBy(F.desc("n"), "pattern").limit(20)


@R.add("WITH o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM documents) SELECT source, doc_id FROM o WHERE k <= 20")
def sample_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return first_rows(docs, ["source"], ["h", "doc_id"], 20).drop("h")


@R.add("""WITH e AS (SELECT lang, doc_id, text, quality, row_number() OVER (PARTITION BY lang, text ORDER BY d.doc_id DESC) AS k FROM documents d JOIN labels l USING (doc_id)),
t AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, doc_id) AS r FROM e WHERE k = 1) SELECT lang, doc_id FROM t WHERE r <= 20""")
def exemplars_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("same", F.md5("text"))
    latest = docs.groupBy("lang", "same").agg(F.max(F.struct("doc_id", "quality")).alias("e")).select("lang", "e.*")
    return first_rows(latest, ["lang"], [F.desc("quality"), F.asc("doc_id")], 20).select("lang", "doc_id")


@R.add("""WITH t AS (SELECT item_id, text AS term FROM benchmark UNION ALL SELECT 1000000 + item_id, left(text, 4 + (item_id % 9)::INT) FROM benchmark)
SELECT item_id, doc_id FROM t JOIN documents d ON contains(lower(d.text), lower(term)) WHERE length(term) > 0""")
def relevant_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that texts contain: whole benchmark texts, and their first words."""
    items = table(spark, sf_dir, "benchmark")
    short = items.select((F.lit(1000000) + F.col("item_id")).alias("term_id"), F.left("text", (F.lit(4) + F.col("item_id") % 9).cast("int")).alias("term"))
    terms = items.select(F.col("item_id").alias("term_id"), F.col("text").alias("term")).union(short)
    return contained(table(spark, sf_dir, "documents").select("doc_id", "text"), terms).select(F.col("term_id").alias("item_id"), "doc_id")


@R.add("SELECT lang, list_sort(list_distinct(list_concat(list(DISTINCT source) FILTER (doc_id % 2 = 0), list(DISTINCT source) FILTER (doc_id % 2 = 1)))) AS merged FROM documents GROUP BY lang")
def merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = table(spark, sf_dir, "documents").groupBy("lang").agg(F.collect_set(F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("a"), F.collect_set(F.when(F.col("doc_id") % 2 == 1, F.col("source"))).alias("b"))
    return halves.select("lang", F.array_sort(F.array_union("a", "b")).alias("merged"))
