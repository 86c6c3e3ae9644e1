"""Queries that derive values from texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import json_repair as J
from tessera.functions import text as T
from tessera.operators.ordering import global_row_number
from tessera.plans.registry import Registry
from tessera.sources.tables import table

R = Registry()

_TAGS = r"regexp_replace({0}, '<[^>]+>', '', 'g')"
_HTML = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g'))"
_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs')"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.ENGLISH_WORDS) + ")"
_TOKENS = r"list_filter(regexp_extract_all(lower(" + _TAGS + r"), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{2,}}$'))"
EN_CTE = f"""en AS (
  SELECT *, CASE WHEN nt = 0 THEN 0 WHEN marks / greatest(n, 1) > 0.005
           THEN round(hits / nt * greatest(0, 1 - marks / greatest(n, 1) / 0.01), 4) ELSE round(hits / nt, 4) END AS ratio
  FROM (SELECT *, len(tk)::DOUBLE AS nt, len(list_filter(tk, lambda w: w IN {_STOP}))::DOUBLE AS hits,
               len(regexp_extract_all(p, '[{T.DIACRITICS}]'))::DOUBLE AS marks, length(p)::DOUBLE AS n
        FROM (SELECT *, {_TOKENS.format("text")} AS tk, {_TAGS.format("text")} AS p FROM documents))
)"""


@R.add(f"SELECT page_id, {_HTML.format('html')} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@R.add(f"SELECT page_id, {_HTML.format(_BARE)} AS text, len({_WORDS.format(_HTML.format(_BARE))})::BIGINT AS n_words FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", T.visible_text(F.col("html")).alias("text"))
    return out.withColumn("n_words", T.word_count(F.col("text")))


_TITLE = "coalesce(" + ", ".join(f"nullif({_HTML.format(f'''regexp_extract(html, '<{t}[^>]*>(.*?)</{t}>', 1, 'is')''')}, '')" for t in ("title", "h1", "h2", "h3"))


@R.add(f"SELECT page_id, {_TITLE}, 'Poglavlje ' || (page_id + 1)) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [F.nullif(T.html_text(F.regexp_extract("html", f"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit("")) for t in ("title", "h1", "h2", "h3")]
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(*found, F.concat(F.lit("Poglavlje "), (F.col("page_id") + 1).cast("string"))).alias("title"))


@R.add(f"SELECT page_id, length({_HTML.format(_BARE)})::BIGINT AS n FROM pages WHERE NOT regexp_matches(lower(url), 'cover|titlepage|copyright|colophon') AND length({_HTML.format(_BARE)}) > 200")
def content_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(~F.lower("url").rlike("cover|titlepage|copyright|colophon"))
    return pages.select("page_id", F.length(T.visible_text(F.col("html"))).cast("long").alias("n")).where("n > 200")


@R.add(f"SELECT page_id, chapter, n FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS chapter, length({_HTML.format(_BARE)})::BIGINT AS n FROM pages WHERE length({_HTML.format(_BARE)}) >= 50)")
def chapter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.ordering import global_row_number

    pages = table(spark, sf_dir, "pages").select("page_id", F.length(T.visible_text(F.col("html"))).cast("long").alias("n")).where("n >= 50")
    return global_row_number(pages, "page_id", "chapter")


@R.add(f"WITH {EN_CTE} SELECT doc_id, nt::BIGINT AS n_tokens, hits::BIGINT AS n_english, marks::BIGINT AS n_marks, ratio FROM en")
def en_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = T.no_tags(F.col("text"))
    out = table(spark, sf_dir, "documents").select("doc_id", T.english_tokens(F.col("text")).alias("tk"), T.diacritics(plain).alias("n_marks"), F.length(plain).alias("n"))
    out = out.withColumn("n_english", T.english_hits(F.col("tk")))
    return out.select("doc_id", F.size("tk").cast("long").alias("n_tokens"), "n_english", "n_marks", T.english_ratio(F.col("tk"), F.col("n_english"), F.col("n_marks"), F.col("n")).alias("ratio"))


@R.add(f"WITH {EN_CTE} SELECT doc_id, CASE WHEN marks > 0 THEN 'HR' WHEN ratio > 0.08 THEN 'EN' ELSE 'HR' END AS detected FROM en")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = T.english_share(F.col("text"))
    marked = T.diacritics(T.no_tags(F.col("text"))) > 0
    return table(spark, sf_dir, "documents").select("doc_id", F.when(marked, "HR").when(share > 0.08, "EN").otherwise("HR").alias("detected"))


@R.add(f"""
WITH head AS (SELECT source, doc_id, left(text, 5000) AS t FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5),
b AS (SELECT source, string_agg(t, ' ' ORDER BY doc_id) AS text FROM head GROUP BY source),
en AS (SELECT source, len(tk) AS nt, len(list_filter(tk, lambda w: w IN {_STOP})) AS hits, marks, n
  FROM (SELECT source, {_TOKENS.format("text")} AS tk, len(regexp_extract_all(text, '[{T.DIACRITICS}]')) AS marks, length(text) AS n FROM b))
SELECT source, CASE WHEN marks / n > 0.003 OR hits / nt < 0.08 THEN 'LEKTURA' ELSE 'PREVOD' END AS mode FROM en""")
def book_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.ordering import first_rows

    head = first_rows(table(spark, sf_dir, "documents").select("source", "doc_id", F.substring("text", 1, 5000).alias("t")), ["source"], ["doc_id"], 5)
    books = head.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "t"))), lambda x: x["t"]), " ").alias("text"))
    tokens = T.english_tokens(F.col("text"))
    few = F.try_divide(T.english_hits(tokens), F.size(tokens)) < 0.08
    marked = T.diacritics(F.col("text")) / F.length("text") > 0.003
    return books.select("source", F.when(marked | few, "LEKTURA").otherwise("PREVOD").alias("mode"))


_SENT = r"list_filter(list_transform(regexp_split_to_array(p, '[.!?]+'), lambda s: trim(s, chr(32) || chr(9) || chr(10) || chr(13))), lambda s: s <> '')"


@R.add(rf"""
WITH a AS (SELECT doc_id, text, {_TAGS.format("text")} AS p FROM documents),
s AS (SELECT *, {_SENT} AS ss FROM a),
c AS (SELECT *, len(ss) AS n, coalesce(list_sum(list_transform(ss, lambda x: length(x))), 0) / greatest(1, len(ss)) AS av,
  len(list_filter(string_split(p, chr(10)), lambda x: regexp_matches(x, '^\s*[—"„]'))) AS speech,
  len(regexp_extract_all(p, '[—–-]{{1,2}}')) + len(regexp_extract_all(p, '[„"'']+ ')) AS marks FROM s)
SELECT doc_id, CASE WHEN n > 0 AND (speech > 0.25 * n OR marks > n * 0.4) THEN 'dijalog'
  WHEN len(regexp_extract_all(text, '(?i)<br\s*/?>')) >= 3 THEN 'poetski'
  WHEN regexp_matches(text, '(?is)<(?:em|i)[^>]*>.*?</(?:em|i)>') AND av < 60 THEN 'poetski'
  WHEN av < 40 AND n >= 3 THEN 'poetski'
  WHEN av > 120 AND NOT regexp_matches(p, '(?i)\b(?:said|told|asked|replied|whispered|shouted|answered|reče|odvrati|upita|prošaputa)\b') THEN 'opis'
  ELSE 'naracija' END AS kind FROM c""")
def block_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.block_type(F.col("text")).alias("kind"))


@R.add(f"SELECT doc_id, len({_WORDS.format('text')})::BIGINT AS n_words, left(text, 80) AS preview, CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS teaser FROM documents")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    teaser = F.when(F.length("text") > 120, F.concat(F.left("text", F.lit(120)), F.lit("..."))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.left("text", F.lit(80)).alias("preview"), teaser.alias("teaser"))


_NAMES = ["Čudna Knjiga.epub", "", "...", "a/b/ Đorđe  š!.mobi", "x\\y\\z.epub", "__a__b__", "plain-name_1.epub"]
_NAME_ROWS = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_NAMES)) + ") AS t(i, name)"


@R.add(rf"""
WITH n AS (SELECT i::BIGINT AS i, name FROM {_NAME_ROWS} UNION ALL SELECT 100 + page_id, regexp_replace(url, '[?#].*$', '') FROM pages),
l AS (SELECT i, name, regexp_extract(replace(replace(translate(name, 'čćšžČĆŠŽ', 'ccszCCSZ'), 'đ', 'dj'), 'Đ', 'Dj'), '([^/\\]*)$', 1) AS b FROM n),
k AS (SELECT i, name, regexp_replace(regexp_replace(regexp_replace(b, '[^a-zA-Z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g') AS k FROM l)
SELECT i, CASE WHEN name = '' THEN 'nepoznato.epub' WHEN k = '' THEN 'knjiga.epub' ELSE k END AS safe,
       regexp_replace(name, '[^a-zA-Z0-9_-]', '', 'g') AS book_id FROM k""")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(list(enumerate(_NAMES)), "i long, name string")
    urls = table(spark, sf_dir, "pages").select((F.col("page_id") + 100).alias("i"), F.regexp_replace("url", "[?#].*$", "").alias("name"))
    names = fixed.unionByName(urls)
    return names.select("i", T.safe_name(F.col("name")).alias("safe"), F.regexp_replace("name", "[^a-zA-Z0-9_-]", "").alias("book_id"))


UNWRAP_KEYS = ["finalno_polirano", "korektura", "translated", "tekst", "text"]
_SAID = "regexp_replace(text, '[^a-zA-Z ]', '', 'g')"


@R.add(f"""SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN coalesce(nullif(trim(s), ''), 'c') WHEN 1 THEN s WHEN 2 THEN s WHEN 3 THEN s WHEN 4 THEN '{{"other": "' || s || '"}}' ELSE '' END AS text
FROM (SELECT *, trim({_SAID}) || 'x' AS s FROM conversations)""")
def json_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns wrapped in answers of six shapes: plain, in typographic quotes, behind an empty first key,
    without JSON, under no known key, and empty."""
    said = F.concat(F.btrim(F.regexp_replace("text", "[^a-zA-Z ]", "")), F.lit("x"))
    kind = (F.col("conv_id") + F.col("turn")) % 6
    wrapped = lambda a, b: F.concat(F.lit(a), said, F.lit(b))
    answer = F.when(kind == 0, wrapped('{"tekst": "', '", "text": "c"}')).when(kind == 1, wrapped("{„text“: „", "“}")).when(kind == 2, wrapped('{"finalno_polirano": "", "korektura": "', '"}'))
    answer = answer.when(kind == 3, said).when(kind == 4, wrapped('{"other": "', '"}')).otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.unwrap_json(answer, UNWRAP_KEYS).alias("text"))


@R.add(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace('```json' || chr(10) || text || chr(10) || '```', '^\s*```[a-zA-Z]*\s*', ''), '\s*```\s*$', ''), chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM conversations""")
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("text"), F.lit("\n```"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_fence(fenced).alias("text"))


@R.add("""
SELECT conv_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system,
  coalesce(string_agg(CASE role WHEN 'user' THEN '[KORISNIK] ' ELSE '[ASISTENT] ' END || text, chr(10) ORDER BY turn) FILTER (role <> 'system'), '') AS body
FROM conversations GROUP BY conv_id""")
def flatten_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    tag = F.when(F.col("role") == "user", "[KORISNIK] ").otherwise("[ASISTENT] ")
    both = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))).alias("s"),
        F.sort_array(F.collect_list(F.when(F.col("role") != "system", F.struct("turn", F.concat(tag, "text").alias("text"))))).alias("o"),
    )
    return both.select("conv_id", F.array_join(F.col("s.text"), "\n\n").alias("system"), F.array_join(F.col("o.text"), "\n").alias("body"))


@R.add("""
WITH c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'system') AS sys, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS usr FROM conversations GROUP BY conv_id),
m AS (SELECT c.*, model FROM c, (VALUES ('gemma-3-27b-it'), ('gpt-4o')) AS t(model))
SELECT conv_id, model, CASE WHEN model LIKE '%gemma%' OR sys IS NULL THEN 1 ELSE 2 END AS n_messages,
  CASE WHEN model LIKE '%gemma%' AND sys IS NOT NULL THEN '[INSTRUKCIJE]' || chr(10) || sys || chr(10) || chr(10) || coalesce(usr, '') ELSE coalesce(usr, '') END AS user_message FROM m""")
def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    def said(role: str):
        return F.nullif(F.array_join(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))).getField("text"), " "), F.lit(""))

    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said("system").alias("sys"), said("user").alias("usr"))
    models = turns.withColumn("model", F.explode(F.array(F.lit("gemma-3-27b-it"), F.lit("gpt-4o"))))
    merged = F.col("model").contains("gemma")
    user = F.coalesce("usr", F.lit(""))
    return models.select(
        "conv_id", "model", F.when(merged | F.col("sys").isNull(), 1).otherwise(2).alias("n_messages"),
        F.when(merged & F.col("sys").isNotNull(), F.concat(F.lit("[INSTRUKCIJE]\n"), "sys", F.lit("\n\n"), user)).otherwise(user).alias("user_message"),
    )


@R.add(r"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-zäöüßàâçéèêëîïôûùáíóúñ]{3,}')) AS w FROM documents)
SELECT lang, w AS word, count(*) AS n FROM t WHERE regexp_matches(w, '[qwxy]|bb|cc|dd|ff|gg|kk|ll|mm|nn|pp|rr|ss|tt|zz') GROUP BY ALL""")
def foreign_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüßàâçéèêëîïôûùáíóúñ]{3,}"), F.lit(0))
    out = table(spark, sf_dir, "documents").select("lang", F.explode(tokens).alias("word"))
    return out.where(F.col("word").rlike("[qwxy]|bb|cc|dd|ff|gg|kk|ll|mm|nn|pp|rr|ss|tt|zz")).groupBy("lang", "word").agg(F.count("*").alias("n"))


_SAID = ["Lektorisani tekst ovdje", "<p>korigirani tekst ovdje </p>", "1. **Interpunkcija:** a\n2. **Stil:** b", "— Dodano: x i jos dvadeset slova", "obican tekst"]
_SAID_ROWS = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_SAID)) + ") AS t(i, text)"
# Forms of notes about changes.
NOTES = r"(?:^\d+\.\s+\*\*[^\n*]{1,60}:?\*\*|→\s+(?:\*\*|„)|\*\*[A-ZŠĆČŽĐ][a-zšćčžđA-ZŠĆČŽĐ\s]{1,40}:\*\*|^[-—]\s+(?:Dodan|Ispravlj|Zamijen))"


@R.add(f"""SELECT i::BIGINT AS i, trim(lower({_TAGS.format("text")})) IN ('lektorisani tekst ovdje', 'korigirani tekst ovdje') AS placeholder,
  length(text) >= 20 AND len(regexp_extract_all(text, '(?m){NOTES}')) >= 2 AS annotation
FROM (SELECT i, text FROM {_SAID_ROWS} UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations)""")
def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(list(enumerate(_SAID)), "i long, text string")
    said = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("i"), "text")
    empty = F.trim(F.lower(T.no_tags(F.col("text")))).isin("lektorisani tekst ovdje", "korigirani tekst ovdje")
    notes = (F.length("text") >= 20) & (T.count_of(F.col("text"), "(?m)" + NOTES) >= 2)
    return fixed.unionByName(said).select("i", empty.alias("placeholder"), notes.alias("annotation"))


_PAIR = "SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations"


@R.add(f"""
WITH p AS ({_PAIR}), r AS (SELECT p.*, role, length(trim(text)) AS a, length(trim(reply)) AS b FROM p, (VALUES ('LEKTOR', .92, 1.12), ('RETRO', .75, 1.35), ('PREVODILAC', .70, 1.50)) AS t(role, lo, hi) WHERE reply IS NOT NULL),
b AS (SELECT r.*, lo, hi FROM r JOIN (VALUES ('LEKTOR', .92, 1.12), ('RETRO', .75, 1.35), ('PREVODILAC', .70, 1.50)) AS t(role, lo, hi) USING (role))
SELECT conv_id, turn, role, CASE WHEN a = 0 OR b < 15 THEN false ELSE b / a < lo OR b / a > hi END AS flagged,
  length(text) >= 120 AND length(reply) >= 20 AND length(reply) < length(text) * CASE role WHEN 'PREVODILAC' THEN .62 ELSE .80 END AS lost FROM b""")
def length_ratio_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    reply = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("reply", reply).where("reply IS NOT NULL").withColumn("role", F.explode(F.array(*(F.lit(r) for r in T.LENGTH_BOUNDS))))
    return pairs.select(
        "conv_id", "turn", "role", T.length_flag(F.col("text"), F.col("reply"), F.col("role")).alias("flagged"),
        T.text_loss(F.col("text"), F.col("reply"), F.col("role") == "PREVODILAC").alias("lost"),
    )


_MATTER = " OR ".join(f"contains(lower(p), '{w}')" for w in T.PARATEXT)


@R.add(rf"""
WITH t AS (SELECT page_id, html, {_HTML.format(_BARE)} AS p FROM pages)
SELECT page_id, p = '' OR regexp_matches(html, '(?i)^\s*<(img|figure|svg)') OR {_MATTER}
  OR (regexp_matches(html, '(?i)<img') AND length(trim(regexp_replace(html, '<[^>]+>', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13))) < 10)
  OR regexp_matches(html, '(?is){T.LINK_LIST}')
  OR (len({_WORDS.format("p")}) < 55 AND NOT regexp_matches(p, '(?s)[a-zA-Zšđžčć]{{4,}}.*[.,!?;]')) AS nonprose FROM t""")
def nonprose(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html", T.visible_text(F.col("html")).alias("p"))
    matter = F.exists(F.array(*map(F.lit, T.PARATEXT)), lambda w: F.lower("p").contains(w))
    short = (T.word_count(F.col("p")) < 55) & ~F.col("p").rlike("(?s)[a-zA-Zšđžčć]{4,}.*[.,!?;]")
    picture = F.col("html").rlike(r"(?i)^\s*<(img|figure|svg)")
    alone = F.col("html").rlike("(?i)<img") & (F.length(F.btrim(T.no_tags(F.col("html")), F.lit(" \t\n\r"))) < 10)
    links = F.col("html").rlike("(?is)" + T.LINK_LIST)
    return pages.select("page_id", ((F.col("p") == "") | picture | matter | alone | links | short).alias("nonprose"))


_CYR = ["Dоbar dan svima ovdje i tamo", "Добар дан", "latinica", "Љубав њива џак"]


_LETTERS = "translate(text, 'абвгдђежзијклмнопрстћуфхцчшАБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ', 'abvgdđežzijklmnoprstćufhcčšABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ')"
for _c, _l in (("љ", "lj"), ("њ", "nj"), ("џ", "dž"), ("Љ", "Lj"), ("Њ", "Nj"), ("Џ", "Dž")):
    _LETTERS = f"replace({_LETTERS}, '{_c}', '{_l}')"


@R.add(f"""WITH r AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_CYR))}) AS v(i, text) UNION ALL SELECT doc_id + 100, text FROM documents)
SELECT i::BIGINT AS i, CASE WHEN len(regexp_extract_all(text, '[Ѐ-ӿ]')) / greatest(length(text), 1) <= .1 THEN {_LETTERS} ELSE text END AS text FROM r""")
def homoglyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(_CYR)), "i long, text string")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("i"), "text")
    return rows.unionByName(docs).select("i", T.homoglyphs(F.col("text")).alias("text"))


@R.add(None)
def typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.typography(F.col("text")).alias("text"))


_RULES = [("the ", "THE "), ("tion([a-z])", "cion$1"), (" und ", " i "), (" de la ", " iz ")]


@R.add(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'the ', 'THE ', 'gi'), 'tion([a-z])', 'cion\1', 'gi'), ' und ', ' i ', 'gi'), ' de la ', ' iz ', 'gi') AS text FROM documents""")
def rule_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.rewrite(F.col("text"), _RULES).alias("text"))


@R.add("SELECT doc_id, replace(text, 'tion', 'cija') AS text, ((length(text) - length(replace(text, 'tion', ''))) / 4)::BIGINT AS n FROM documents")
def literal_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.replace("text", F.lit("tion"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("tion"), F.lit("cija")).alias("text"), ((F.length("text") - F.length(cut)) / 4).cast("long").alias("n"))


@R.add(r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: trim(x)), lambda x: x <> ''), lambda x: '<p>' || x || '</p>'), chr(10)) AS html FROM documents""")
def paragraph_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(parts, lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "\n").alias("html"))


@R.add(r"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +', ' ', 'g'), '^ | $', '', 'g') AS norm,
  levenshtein(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), regexp_replace(lead(text) OVER (ORDER BY item_id), '[^a-zA-Z ]', '', 'g'))::BIGINT AS to_next FROM benchmark""")
def name_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Neighbours by id, gaps or not: joined on row numbers rather than by one window over everything.
    items = table(spark, sf_dir, "benchmark").withColumn("head", F.regexp_replace("text", "[^a-zA-Z ]", ""))
    numbered = global_row_number(items.where("item_id IS NOT NULL"), "item_id", "place")
    following = numbered.select((F.col("place") - 1).alias("place"), F.col("head").alias("following"))
    without = items.where("item_id IS NULL").withColumns({"place": F.lit(None).cast("long"), "following": F.lit(None).cast("string")})
    paired = numbered.join(following, "place", "left").unionByName(without)
    norm = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +", " "), "^ | $", "")
    return paired.select("item_id", norm.alias("norm"), F.levenshtein("head", "following").cast("long").alias("to_next"))


_PUT = "regexp_replace(text, '[^a-zA-Z0-9 .,]', '', 'g')"


@R.add(f"SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 8 < 6 THEN {_PUT} END AS text FROM conversations")
def robust_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns planted in answers of eight shapes: plain, fenced, in typographic quotes, as Python writes
    them with a loose comma, with other objects and braces around, with braces and quotes inside, cut off, and without an object."""
    said = F.regexp_replace("text", "[^a-zA-Z0-9 .,]", "")
    around = lambda a, b: F.concat(F.lit(a), said, F.lit(b))
    shapes = [
        around('{"text": "', '", "more": {"a": "}"}}'), around('```json\n{"text": "', '"}\n```'), around("{„text“: „", "“}"), around("{'done': True, 'text': '", "', }"),
        around('{"a": 1} an open { and {"text": "', '"} so.'), around('{"note": "a \\"quote\\" and }{", "text": "', '"}'), around('{"text": "', ""), said,
    ]
    kind = (F.col("conv_id") + F.col("turn")) % 8
    answer = shapes[-1]
    for i, shape in enumerate(shapes[:-1]):
        answer = F.when(kind == i, shape).otherwise(answer)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get_json_object(J.robust_json(answer), "$.text").alias("text"))
