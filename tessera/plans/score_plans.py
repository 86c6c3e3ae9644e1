"""Queries that score blocks and roll scores up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import scoring as S
from tessera.operators.ordering import first_rows
from tessera.plans.registry import Registry
from tessera.plans.text_plans import _WORDS, EN_CTE
from tessera.sources.tables import table

R = Registry()


def _hit(column: str, pattern: str) -> str:
    """RE2's word boundary is ASCII, so letters beyond it are spelled out."""
    p = pattern
    if p.startswith("\\b"):
        p = r"(^|[^\p{L}\p{N}_])" + p[2:]
    if p.endswith("\\b"):
        p = p[:-2] + r"($|[^\p{L}\p{N}_])"
    return f"""regexp_matches({column}, '{p.replace("'", "''")}')"""


_PHRASE = " + ".join(f"CASE WHEN {_hit('low', p)} THEN {w} ELSE 0 END" for p, w, _ in S.PHRASES)
_SPEAKS = " OR ".join(f"contains(low, '{w}')" for w in S.SPEECH)
SCORE_CTE = f"""{EN_CTE},
tri AS (SELECT doc_id, max(c) AS rep FROM (SELECT doc_id, g, count(*) AS c FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS g
  FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents) WHERE len(w) > 20) GROUP BY ALL) GROUP BY doc_id),
b AS (SELECT en.doc_id, lang, source, text, lower(text) AS low, ratio, length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS l, coalesce(rep, 0) AS rep,
  len(regexp_extract_all(text, '["“”„‘’]')) AS q, len(regexp_extract_all(text, '—')) AS d FROM en LEFT JOIN tri ON en.doc_id = tri.doc_id),
pen AS (SELECT *, CASE WHEN l < 50 THEN 2.0 ELSE 0 END + CASE WHEN ratio > .15 THEN 5.0 WHEN ratio > .08 THEN 3.0 WHEN ratio > .03 THEN 1.5 ELSE 0 END + ({_PHRASE})
  + CASE WHEN q >= 4 AND d = 0 AND ({_SPEAKS}) THEN 1.5 WHEN q >= 6 AND d = 0 THEN 1.0 ELSE 0 END
  + CASE WHEN rep > 4 THEN 3.0 WHEN rep > 2 THEN 1.0 ELSE 0 END
  + CASE WHEN regexp_matches(trim(text), '(?i)^(Chapter|Part|Section)\\s+\\d+') THEN 1.5 ELSE 0 END
  + CASE WHEN regexp_matches(text, '  +') THEN .3 ELSE 0 END + CASE WHEN regexp_matches(text, '\\.{{4,}}') THEN .4 ELSE 0 END AS fine FROM b),
sc AS (SELECT doc_id, lang, source, text, rep, CASE WHEN l < 20 OR (ratio > .25 AND l >= 120) THEN 1.0 ELSE round(greatest(1.0, least(10.0, 9.8 - fine)), 1) END::DOUBLE AS score FROM pen)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, text and heuristic score of the documents.

    The score comes out of a generator: a filter on it stays above, where Spark would otherwise put the
    whole expression into the filter, once for each use of its parts, and work it out again for the rows that stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return S.heuristic_score(docs).select("doc_id", "lang", "source", "text", F.explode(F.array("score")).alias("score"))


@R.add(f"WITH {SCORE_CTE} SELECT doc_id, score FROM sc")
def heuristic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", "score")


@R.add(f"WITH {SCORE_CTE} SELECT doc_id, rep::BIGINT AS max_repeat FROM sc")
def max_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.max_trigram(F.col("text")).alias("max_repeat"))


def mean_sql(score: str, places: int) -> str:
    """The mean of tenths as `mean_of_tenths` has it."""
    return f"CASE WHEN count({score}) > 0 THEN ((sum(round({score} * 10)::BIGINT) * {2 * 10 ** (places - 1)} + count({score})) // (2 * count({score})))::BIGINT / {10.0**places} END"


_BANDS = f"""{mean_sql("score", 2)} AS avg_score, min(score) AS min_score, max(score) AS max_score, count(score) AS n,
  count(*) FILTER (score >= 8.5) AS excellent, count(*) FILTER (score >= 6.5 AND score < 8.5) AS good,
  count(*) FILTER (score >= 4 AND score < 6.5) AS poor, count(*) FILTER (score < 4) AS critical,
  round(100 * count(*) FILTER (score >= 8.5) / nullif(count(score), 0), 1) AS pct_excellent"""


@R.add(f"WITH {SCORE_CTE} SELECT {_BANDS} FROM sc")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(*(c.alias(k) for k, c in S.bands(F.col("score")).items()))


@R.add(f"WITH {SCORE_CTE} SELECT source, {_BANDS} FROM sc GROUP BY source")
def quality_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("source").agg(*(c.alias(k) for k, c in S.bands(F.col("score")).items()))


@R.add(f"WITH {SCORE_CTE} SELECT source, list(doc_id || ':' || score ORDER BY doc_id) AS blocks FROM sc WHERE score < 6.5 GROUP BY source")
def blocks_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = scored(spark, sf_dir).where("score < 6.5")
    entry = F.struct("doc_id", F.concat_ws(":", "doc_id", F.col("score").cast("string")).alias("t"))
    return low.groupBy("source").agg(F.sort_array(F.collect_list(entry)).getField("t").alias("blocks"))


@R.add(f"WITH {SCORE_CTE} SELECT source, lang, count(*) AS n, {mean_sql("score", 4)} AS avg_score FROM sc GROUP BY ROLLUP (source, lang)")
def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).rollup("source", "lang").agg(F.count("*").alias("n"), S.mean_of_tenths(F.col("score"), 4).alias("avg_score"))


@R.add(f"WITH {SCORE_CTE} SELECT source, count(*) FILTER (score < 6.5)::DOUBLE / count(*) AS bad_share, CASE WHEN count(*) FILTER (score < 6.5)::DOUBLE / count(*) > .30 THEN 'AUTO-RETRO' WHEN count(*) >= 40 THEN 'RESUME' ELSE 'DETECT' END AS strategy FROM sc GROUP BY source")
def choose_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.count_if(F.col("score") < 6.5) / F.count("*")
    chosen = F.when(share > 0.30, "AUTO-RETRO").when(F.count("*") >= 40, "RESUME").otherwise("DETECT")
    return scored(spark, sf_dir).groupBy("source").agg(share.alias("bad_share"), chosen.alias("strategy"))


@R.add(f"""WITH {SCORE_CTE} SELECT doc_id, score, CASE WHEN score < 4 THEN 'critical' WHEN score < 6.5 THEN 'poor' WHEN score < 8.5 THEN 'good' ELSE 'excellent' END AS reason,
  CASE WHEN score >= 8.5 THEN 'A' WHEN score >= 6.5 THEN 'B' WHEN score >= 4 THEN 'C' ELSE 'D' END AS grade FROM sc""")
def review_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    grade = F.when(s >= 8.5, "A").when(s >= 6.5, "B").when(s >= 4, "C").otherwise("D")
    return scored(spark, sf_dir).select("doc_id", "score", T.review_reason(s).alias("reason"), grade.alias("grade"))


_JUDGED = "CASE WHEN l.quality = 1 THEN 8.0 + (s.doc_id % 3) * 0.5 WHEN l.quality = 0 THEN 3.0 END"


def _with_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    judged = F.when(F.col("quality") == 1, 8.0 + (F.col("doc_id") % 3) * 0.5).when(F.col("quality") == 0, 3.0)
    return scored(spark, sf_dir).join(labels, "doc_id", "left").withColumn("judged", judged)


def _count(column: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {_hit(column, p)} THEN 1 ELSE 0 END" for p in patterns) + ")"


_REPORT = f"""SELECT doc_id, source, {_count("low", S.EKAVIAN)} AS e, {_count("low", S.CALQUES)} AS c, {_count("text", S.TYPOGRAPHIC)} AS t, {_count("low", S.ENGLISH)} AS g
FROM (SELECT doc_id, source, text, lower(text) AS low FROM reported)"""
# Documents hold no South-Slavic text, so a few findings are planted.
_PLANTED = "SELECT doc_id, source, text || CASE doc_id % 5 WHEN 0 THEN ' Lepo vreme , čovek.' WHEN 1 THEN ' Uspio je da u cilju toga -- however.' WHEN 2 THEN ' Hence  \"x\" ....' ELSE '' END AS text FROM documents"


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("doc_id") % 5 == 0, " Lepo vreme , čovek.").when(F.col("doc_id") % 5 == 1, " Uspio je da u cilju toga -- however.").when(F.col("doc_id") % 5 == 2, ' Hence  "x" ....').otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("text", more).alias("text"))
    return S.block_report(docs).drop("text")


@R.add(f"WITH reported AS ({_PLANTED}), r AS ({_REPORT}) SELECT doc_id, source, e::BIGINT AS n_ekavian, c::BIGINT AS n_calques, t::BIGINT AS n_typography, g::BIGINT AS n_english, (e + c + t + g)::BIGINT AS n_findings, round(greatest(0.0, 10.0 - (e * 2.0 + c * 1.5 + t * .5 + g * 3.0)), 1)::DOUBLE AS report_score FROM r")
def qa_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reported(spark, sf_dir)


_QA = f"count(*) AS n, {mean_sql('greatest(0.0, 10.0 - (e * 2.0 + c * 1.5 + t * .5 + g * 3.0))', 2)} AS avg_score, count(*) FILTER (e + c + t + g = 0) AS n_clean, round(100 * count(*) FILTER (e > 0) / count(*), 1) AS pct_ekavian, round(100 * count(*) FILTER (t > 0) / count(*), 1) AS pct_typography, round(100 * count(*) FILTER (c > 0) / count(*), 1) AS pct_calques, round(100 * count(*) FILTER (g > 0) / count(*), 1) AS pct_english"


def _qa(rows: DataFrame) -> list:
    share = lambda c: F.round(100 * F.count_if(F.col(c) > 0) / F.count("*"), 1)
    return [F.count("*").alias("n"), S.mean_of_tenths(F.col("report_score"), 2).alias("avg_score"), F.count_if(F.col("n_findings") == 0).alias("n_clean"), share("n_ekavian").alias("pct_ekavian"), share("n_typography").alias("pct_typography"), share("n_calques").alias("pct_calques"), share("n_english").alias("pct_english")]


@R.add(f"WITH reported AS ({_PLANTED}), r AS ({_REPORT}) SELECT {_QA} FROM r")
def qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reported(spark, sf_dir)
    return rows.agg(*_qa(rows))


@R.add(f"""WITH reported AS ({_PLANTED}), r AS ({_REPORT}), s AS (SELECT source, {_QA} FROM r GROUP BY source),
d AS (SELECT source, avg_score, round(avg_score - lag(avg_score) OVER (ORDER BY source), 2) AS delta FROM s)
SELECT source, avg_score, delta, CASE WHEN delta > 0 THEN '↑' WHEN delta < 0 THEN '↓' WHEN delta = 0 THEN '→' END AS trend FROM d""")
def qa_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reported(spark, sf_dir)
    runs = rows.groupBy("source").agg(*_qa(rows)).select("source", "avg_score")
    delta = F.round(F.col("avg_score") - F.lag("avg_score").over(Window.orderBy("source")), 2)  # a row per run
    return runs.withColumn("delta", delta).withColumn("trend", F.when(F.col("delta") > 0, "↑").when(F.col("delta") < 0, "↓").when(F.col("delta") == 0, "→"))


def _beside(docs: DataFrame, own: str, next_to: str) -> DataFrame:
    """doc_id, a value of the document and of the next one of its source. Only ids go through the
    window; the values, made once per document, meet by id."""
    order = docs.select("source", "doc_id").withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")))
    values = docs.select("doc_id", F.col("value").alias(own))
    following = docs.select(F.col("doc_id").alias("next_id"), F.col("value").alias(next_to))
    return order.where("next_id IS NOT NULL").join(values, "doc_id").join(following, "next_id").select("doc_id", own, next_to)


_PAIRS_OF = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || {0}[i + 1]))"


@R.add(f"""
WITH c AS (SELECT doc_id, source, string_split(text, '') AS c FROM documents),
s AS (SELECT doc_id, source, {_PAIRS_OF.format("c")} AS x FROM c),
p AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY source ORDER BY doc_id) AS y FROM s)
SELECT doc_id, len(list_intersect(x, y))::DOUBLE / greatest(len(list_distinct(list_concat(x, y))), 1) AS likeness FROM p WHERE y IS NOT NULL""")
def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.bigram_set(F.col("text")).alias("value"))
    return _beside(docs, "x", "y").select("doc_id", T.jaccard(F.col("x"), F.col("y")).alias("likeness"))


@R.add(f"""WITH {SCORE_CTE}, li AS ({R.oracles["bigram_jaccard"]}) SELECT s.doc_id, greatest(1.0, least(10.0, (CASE WHEN length(text) < 20 THEN 10.0 WHEN score <= 2 OR {_JUDGED} IS NULL THEN score
  ELSE round(.25 * score + .75 * {_JUDGED}, 1) END) - CASE WHEN likeness > .97 THEN 2.0 WHEN likeness > .9 THEN .8 ELSE 0 END))::DOUBLE AS composite
FROM sc s LEFT JOIN labels l ON s.doc_id = l.doc_id LEFT JOIN li ON s.doc_id = li.doc_id""")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic and judged score, less for a text that is all but the next one's of its source."""
    rows = _with_judge(spark, sf_dir).join(bigram_jaccard(spark, sf_dir), "doc_id", "left")
    penalty = F.coalesce(S.unchanged_penalty(F.col("likeness")), F.lit(0.0))
    return rows.select("doc_id", S.composite_score(F.col("score"), F.col("judged"), F.length("text") < 20, penalty).alias("composite"))


@R.add(f"""WITH {SCORE_CTE}, p AS (SELECT doc_id, score, length(text)::DOUBLE / lag(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS ratio FROM sc)
SELECT doc_id, least(score, CASE WHEN ratio < .60 THEN 4.8 WHEN ratio < .72 THEN 6.0 WHEN ratio < .82 THEN 7.0 ELSE 10.0 END)::DOUBLE AS capped FROM p""")
def score_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores capped by what a text has lost against the one before it in its source."""
    rows = scored(spark, sf_dir).select("doc_id", "source", "score", F.length("text").alias("n"))
    before = F.lag("n").over(Window.partitionBy("source").orderBy("doc_id"))
    return rows.withColumn("ratio", F.try_divide(F.col("n").cast("double"), before)).select("doc_id", S.loss_cap(F.col("score"), F.col("ratio")).alias("capped"))


_SET = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]+'))"


@R.add(f"""
WITH p AS (SELECT doc_id, text AS a, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
s AS (SELECT doc_id, a, b, {_SET.format("a")} AS x, {_SET.format("b")} AS y FROM p WHERE b IS NOT NULL),
c AS (SELECT doc_id, (len(list_filter(x, lambda w: NOT list_contains(y, w))) + len(list_filter(y, lambda w: NOT list_contains(x, w))))::DOUBLE / nullif(len(x), 0) AS ch FROM s)
SELECT doc_id, coalesce(ch, 0.0) AS change, coalesce(ch, 0) <= .05 AS skip FROM c""")
def word_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", T.word_set(F.col("text")).alias("value"))
    changed = _beside(docs, "x", "y").select("doc_id", T.set_change(F.col("x"), F.col("y")).alias("change"))
    return changed.withColumn("skip", F.col("change") <= 0.05)


@R.add(f"WITH {SCORE_CTE} SELECT s.doc_id, coalesce(score, 10.0) AS score FROM sc s WHERE coalesce(score, 10.0) < 6.5")
def bad_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.coalesce("score", F.lit(10.0)).alias("score")).where("score < 6.5")


@R.add("""SELECT d.doc_id, source, coalesce(quality, -1)::INT AS quality, l.doc_id IS NULL AS unscored FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def blocks_with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return out.select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("quality").isNull().alias("unscored"))


@R.add(f"""WITH {SCORE_CTE}, rv AS (SELECT doc_id, 'heuristic' AS severity FROM labels WHERE toxic = 1)
SELECT doc_id, severity FROM rv UNION ALL SELECT doc_id, 'score' FROM sc WHERE score < 6.5 AND doc_id NOT IN (SELECT doc_id FROM rv)""")
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("heuristic").alias("severity"))
    low = scored(spark, sf_dir).where("score < 6.5").select("doc_id", F.lit("score").alias("severity"))
    return reviews.unionByName(low.join(reviews, "doc_id", "left_anti"))


@R.add("SELECT doc_id, 'selected' AS state FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT l.doc_id + 1000000, 'missing' FROM labels l WHERE (l.doc_id + 1000000) NOT IN (SELECT doc_id FROM documents)")
def selected_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    moved = labels.select((F.col("doc_id") + 1000000).alias("doc_id"))
    found = docs.join(labels, "doc_id", "left_semi").withColumn("state", F.lit("selected"))
    return found.unionByName(moved.join(docs, "doc_id", "left_anti").withColumn("state", F.lit("missing")))


@R.add(f"WITH {SCORE_CTE} SELECT sc.doc_id, ratio < .08 AND (l.quality IS NULL OR l.quality = 1) AS hit FROM sc JOIN en ON sc.doc_id = en.doc_id LEFT JOIN labels l ON sc.doc_id = l.doc_id")
def cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.english_share(F.col("text")).alias("ratio"))
    out = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return out.select("doc_id", ((F.col("ratio") < 0.08) & (F.col("quality").isNull() | (F.col("quality") == 1))).alias("hit"))


@R.add("""
WITH a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
t AS (SELECT user_id, max(value) FILTER (attempt = 1) AS original, max(value) FILTER (attempt <= 3) AS best FROM a GROUP BY user_id)
SELECT user_id, original, best, best > original AS improved FROM t""")
def retry_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = first_rows(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], 3)
    out = tries.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("original"), F.max("value").alias("best"))
    return out.withColumn("improved", F.col("best") > F.col("original"))


@R.add("""
WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
t AS (SELECT user_id, max(value) FILTER (attempt = 1) AS o, max(value) FILTER (attempt <= 3) AS b FROM a GROUP BY user_id)
SELECT count(*) AS total, count(*) FILTER (b > o) AS improved, round(sum(b - o) FILTER (b > o) / greatest(1, count(*) FILTER (b > o)), 4) AS avg_gain FROM t""")
def retry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    gained = F.count_if("improved")
    gain = F.sum(F.when(F.col("improved"), F.col("best") - F.col("original"))) / F.greatest(F.lit(1), gained)
    return retry_best(spark, sf_dir).agg(F.count("*").alias("total"), gained.alias("improved"), F.round(gain, 4).alias("avg_gain"))
