"""Queries around language services: parameters, answers, cleaning, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import exemplars as E
from tessera.operators import prompts as P
from tessera.operators import scoring as S
from tessera.plans.registry import Registry
from tessera.plans.models import MODELS_CTE, models
from tessera.plans.score_plans import SCORE_CTE, mean_sql, scored
from tessera.plans.text_plans import R as TEXT_PLANS
from tessera.plans.text_plans import block_type
from tessera.sources.tables import table

R = Registry()


def _values(rows: list[tuple], names: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({names})"


_WARM = " ".join(f"WHEN role = '{r}' AND kind = '{k}' THEN " + (f"least(base + {v}, {c})" if c is not None else f"{v}") for (r, k), (v, c) in P.WARMER.items())
_ROLES = ["LEKTOR", "POLISH", "PREVODILAC", "GUARDIAN"]


@R.add(f"WITH bt AS ({TEXT_PLANS.oracles['block_type']}), a AS (SELECT doc_id, kind, unnest({_ROLES}) AS role, (2 + doc_id % 5) / 10.0 AS base FROM bt) SELECT doc_id, role, kind, round((CASE {_WARM} ELSE base END)::DOUBLE, 6) AS temperature FROM a")
def adaptive_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature of every document for each role, by its type of block and a base of its own."""
    rows = block_type(spark, sf_dir).select("doc_id", "kind", F.explode(F.array(*map(F.lit, _ROLES))).alias("role"), ((2 + F.col("doc_id") % 5) / 10.0).alias("base"))
    return rows.select("doc_id", "role", "kind", F.round(P.temperature(F.col("role"), F.col("kind"), F.col("base")), 6).alias("temperature"))


# Families of models: place in the search, part of the name, factor, most tokens.
_FAMILY = [(1, "gemini", 0.9, 2200), (2, "groq", 1.1, 2600), (3, "gem", 0.5, 100)]


@R.add(f"""WITH {MODELS_CTE}, f AS (SELECT * FROM {_values(_FAMILY, "seq, family, factor, cap")}), e AS (SELECT model_id, role, .3 AS t, 64 AS k FROM mo WHERE model_id % 10 = 3 AND role = 'POLISH'),
w AS (SELECT model_id, role, model, rpm / 30.0 AS temp, rpm * 60 AS tokens FROM mo),
m AS (SELECT w.*, (SELECT struct_pack(factor := factor, cap := cap) FROM f WHERE contains(w.model, family) ORDER BY seq LIMIT 1) AS fam FROM w)
SELECT m.model_id, m.role, round(least(1, greatest(0, coalesce(e.t, m.temp * coalesce(fam.factor, 1)))), 6)::DOUBLE AS temperature, greatest(128, coalesce(e.k, least(m.tokens, coalesce(fam.cap, m.tokens))))::INT AS tokens
FROM m LEFT JOIN e ON m.model_id = e.model_id AND m.role = e.role""")
def gen_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature and tokens of every model and role: an exact setting, else those of the first family in its name."""
    wanted = models(spark, sf_dir).select("model_id", "role", "model", (F.col("rpm") / 30.0).alias("temp"), (F.col("rpm") * 60).alias("tokens"))
    exact = wanted.where("model_id % 10 = 3 AND role = 'POLISH'").select("model_id", "role", F.lit(0.3).alias("t"), F.lit(64).alias("k"))
    factor, cap = F.lit(1.0), F.col("tokens")
    for _, family, by, most in sorted(_FAMILY, reverse=True):
        factor = F.when(F.col("model").contains(family), by).otherwise(factor)
        cap = F.when(F.col("model").contains(family), F.least(F.lit(most), F.col("tokens"))).otherwise(cap)
    warm = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("t", F.col("temp") * factor)))
    tokens = F.greatest(F.lit(128), F.coalesce(F.col("k"), cap))
    return wanted.join(exact, ["model_id", "role"], "left").select("model_id", "role", F.round(warm, 6).alias("temperature"), tokens.alias("tokens"))


_KNOWN = ["GEMINI", "GROQ", "MISTRAL", "COHERE"]


@R.add(f"""WITH {MODELS_CTE}, n AS (SELECT model_id, role, CASE WHEN model_id % 3 = 0 THEN 'v2/' || split_part(model, '-', 1) || '/' || model ELSE model END AS model FROM mo),
p AS (SELECT *, coalesce(upper(nullif(regexp_extract(model, '^v\\d+/([^/]+)/', 1), '')), CASE {" ".join(f"WHEN contains(upper(model), '{k}') THEN '{k}'" for k in _KNOWN)} END, 'unknown') AS provider FROM n)
SELECT model, provider, list_filter({_KNOWN}, lambda x: x <> provider)[1] AS scorer, count(*) AS n FROM p GROUP BY ALL""")
def provider_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider that a model's name tells, the first other one to judge it, and how often it is used."""
    versioned = F.concat(F.lit("v2/"), F.split_part("model", F.lit("-"), F.lit(1)), F.lit("/"), "model")
    rows = models(spark, sf_dir).select(F.when(F.col("model_id") % 3 == 0, versioned).otherwise(F.col("model")).alias("model"))
    rows = rows.withColumn("provider", P.provider_of(F.col("model"), _KNOWN))
    other = F.filter(F.array(*map(F.lit, _KNOWN)), lambda x: x != F.col("provider"))
    return rows.groupBy("model", "provider", other[0].alias("scorer")).agg(F.count("*").alias("n"))


# Answers of three kinds of services, with a turn of a conversation as what is said; and none.
_BODY_SQL = """CASE (conv_id + turn) % 4 WHEN 0 THEN '{"candidates": [{"content": {"parts": [{"text": "skip", "thought": true}, {"text": ' || to_json(text) || '}]}}], "usageMetadata": {"totalTokenCount": ' || length(text) || '}}'
  WHEN 1 THEN '{"message": {"content": [{"text": ' || to_json(text) || '}]}, "meta": {"tokens": {"output_tokens": ' || length(text) || '}}}'
  WHEN 2 THEN '{"choices": [{"message": {"content": ' || to_json(text) || '}}], "usage": {"total_tokens": ' || length(text) || '}}' ELSE '{}' END"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, size = F.to_json(F.struct(F.col("text").alias("x"))), F.length("text").cast("string")
    said = F.substr(said, F.lit(6), F.length(said) - 6)  # the value of {"x":...}
    joined = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    shapes = [
        joined('{"candidates": [{"content": {"parts": [{"text": "skip", "thought": true}, {"text": ', said, '}]}}], "usageMetadata": {"totalTokenCount": ', size, "}}"),
        joined('{"message": {"content": [{"text": ', said, '}]}, "meta": {"tokens": {"output_tokens": ', size, "}}}"),
        joined('{"choices": [{"message": {"content": ', said, '}}], "usage": {"total_tokens": ', size, "}}"),
    ]
    kind = (F.col("conv_id") + F.col("turn")) % 4
    body = F.when(kind == 0, shapes[0]).when(kind == 1, shapes[1]).when(kind == 2, shapes[2]).otherwise("{}")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("b"))


@R.add("SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 3 THEN '' ELSE text END AS answer, CASE WHEN (conv_id + turn) % 4 = 3 THEN 0 ELSE length(text) END::BIGINT AS tokens FROM conversations")
def response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said in every answer, and its tokens; the SQL knows what was put in."""
    return _answers(spark, sf_dir).select("conv_id", "turn", P.response_text(F.col("b")).alias("answer"), P.tokens_used(F.col("b")).alias("tokens"))


@R.add(f"""WITH {SCORE_CTE} SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL WHEN 0 THEN score ELSE (round(score * 10)::BIGINT + 61) // 2 / 10.0 END::DOUBLE AS score FROM sc""")
def judged_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score in a judge's answer about each document: given, out of bounds beside its criteria, by
    criteria alone, and none."""
    score = F.col("score").cast("string")
    parts = F.concat(F.lit('"kriteriji": {"a": '), score, F.lit(', "b": 6.0}}'))
    kind = F.col("doc_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit('well {"ocjena": '), score, F.lit("} so"))).when(kind == 1, F.concat(F.lit('{"ocjena": 70, '), parts)).when(kind == 2, F.concat(F.lit("{"), parts)).otherwise("none")
    return scored(spark, sf_dir).select("doc_id", P.judged_score(answer).alias("score"))


@R.add(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace('user: ' || text || '<OVDJE_IDI_TEKST>', '<OVDJE_IDI_[^>]*>', '', 'g'), '(?m)^\s*(user|assistant|system):\s*', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM conversations""")
def aggressive_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("user: "), "text", F.lit("<OVDJE_IDI_TEKST>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.cleaned(raw).alias("text"))


@R.add(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([a-zčćšžđ])([A-ZČĆŠŽĐ])', '\1 \2', 'g'), '(^|[^\p{L}\p{N}_])([A-ZČĆŠŽĐ])\s+([a-zčćšžđ]{2,})', '\1\2\3', 'g'), '[^\S\n]{2,}', ' ', 'g') AS text FROM documents""")
def joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.joined_words(F.col("text")).alias("text"))


@R.add(r"""SELECT page_id, regexp_replace(html, ' style="[^"]*"', '', 'g') AS html, trim(regexp_extract(html, '<body[^>]*>(.*)</body>', 1, 'is')) <> '' AS wrapped FROM pages""")
def strip_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.trim(F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1)) != ""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", ' style="[^"]*"', "").alias("html"), wrapped.alias("wrapped"))


@R.add(None)
def duplicate_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.concat_ws("\n", F.split("text", "\n")[0], F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(doubled, r"(?s)^([^\n]{3,200})\s{1,2}\1", "$1").alias("text"))


@R.add(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\bTHE\b', 'LE', 'g'), '\bthe\b', 'le', 'g'), '\bThe\b', 'Le', 'g') AS text FROM documents""")
def name_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.renamed(F.col("text"), [("The", "Le")]).alias("text"))


@R.add(r"""SELECT page_id, regexp_matches(lower(url), 'cover|title|copyright|toc|index|about|dedication|glossary|notes|promo') AS paratext, regexp_matches(url, '^https?://(www|m)\.') AS listed FROM pages""")
def paratext_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = "cover|title|copyright|toc|index|about|dedication|glossary|notes|promo"
    return table(spark, sf_dir, "pages").select("page_id", F.lower("url").rlike(pattern).alias("paratext"), F.col("url").rlike(r"^https?://(www|m)\.").alias("listed"))


@R.add("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN (SELECT min(event_type) FROM events) GROUP BY event_type")
def dead_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    dead = events.agg(F.min("event_type").alias("event_type"))
    return events.join(dead, "event_type", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@R.add(f"""WITH {SCORE_CTE}, runs AS (SELECT source, arg_max(doc_id, doc_id) FILTER (score >= 4) AS newest, {mean_sql('CASE WHEN doc_id % 2 = 0 THEN score END', 4)} - {mean_sql('CASE WHEN doc_id % 2 = 1 THEN score END', 4)} AS fall FROM sc GROUP BY source)
SELECT source, newest, CASE WHEN fall > .3 THEN 'rollback' ELSE 'aktivan' END AS state FROM runs""")
def rollback_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    runs = scored(spark, sf_dir).groupBy("source").agg(F.max(F.when(F.col("score") >= 4, F.col("doc_id"))).alias("newest"), (S.mean_of_tenths(F.when(even, F.col("score")), 4) - S.mean_of_tenths(F.when(~even, F.col("score")), 4)).alias("fall"))
    return runs.select("source", "newest", F.when(F.col("fall") > 0.3, "rollback").otherwise("aktivan").alias("state"))


@R.add(f"WITH {SCORE_CTE} SELECT doc_id, score, (row_number() OVER (ORDER BY coalesce(score, 10), doc_id))::INT AS place FROM sc ORDER BY coalesce(score, 10), doc_id LIMIT 180")
def worst_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = scored(spark, sf_dir).orderBy(F.coalesce("score", F.lit(10.0)), "doc_id").limit(180).select("doc_id", "score")
    return worst.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("score", F.lit(10.0)), "doc_id")))  # 180 rows


@R.add("SELECT source, 'Poglavlje (' || sum(n_chars)::BIGINT || ' znakova). Jezici: ' || string_agg(DISTINCT lang, ', ' ORDER BY lang) || '.' AS summary FROM documents GROUP BY source")
def fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = F.array_join(F.array_sort(F.collect_set("lang")), ", ")
    text = F.concat(F.lit("Poglavlje ("), F.sum("n_chars").cast("string"), F.lit(" znakova). Jezici: "), langs, F.lit("."))
    return table(spark, sf_dir, "documents").groupBy("source").agg(text.alias("summary"))


@R.add("SELECT user_id, string_agg('<navPoint playOrder=\"' || event_id || '\"/>', '' ORDER BY event_id) AS toc FROM events GROUP BY user_id")
def contents_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.format_string('<navPoint playOrder="%d"/>', "event_id").alias("t")).alias("p"))
    return points.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("p")).getField("t"), "").alias("toc"))


@R.add("SELECT doc_id, coalesce(quality, 0.0)::DOUBLE AS score FROM documents LEFT JOIN labels USING (doc_id)")
def score_map_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    raw = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("quality").alias("score")))).otherwise(F.col("quality").cast("string")).alias("v"))
    return raw.select("doc_id", F.coalesce(F.col("v").try_cast("double"), F.get_json_object("v", "$.score").try_cast("double"), F.lit(0.0)).alias("score"))


@R.add(f"WITH {SCORE_CTE} SELECT sc.doc_id, length(sc.text) >= 100 AND ratio <= .03 AS skip FROM sc JOIN en ON sc.doc_id = en.doc_id")
def skip_editor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length("text") >= 100) & (T.english_share(F.col("text")) <= 0.03)).alias("skip"))


@R.add(None)
def similar_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and benchmark texts whose beginnings are alike at 0.75 or more."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), E.head(F.col("text")).alias("t"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), E.head(F.col("text")).alias("t"))
    return E.alike(docs, items, E.ALIKE).select(F.col("exemplar_id").alias("item_id"), F.col("text_id").alias("doc_id"), "likeness")


@R.add(None)
def exemplar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three exemplars most like each document, of its type of block."""
    of = lambda name, key: table(spark, sf_dir, name).select(F.col(key).alias("id"), T.block_type(F.col("text")).alias("kind"), E.normalised(F.col("text")).alias("t"))
    return E.lookup(of("documents", "doc_id"), of("benchmark", "item_id"))


@R.add(None)
def exemplar_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best two hundred documents whose beginnings are not too alike: a store of examples."""
    rows = scored(spark, sf_dir).select(F.col("doc_id").alias("id"), "score", E.head(F.col("text")).alias("t"))
    return E.stored(rows).select(F.col("id").alias("doc_id"), "score", "place")
