"""Queries over rules, characters, gender clues, review lists and states of service keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.forms import DOUBTFUL, FEMALE_FORMS, RIGHT, STOP_NAMES, WRONG_FORMS
from tessera.operators import mining as M
from tessera.operators import morphology as M2
from tessera.operators import names as N
from tessera.operators import paths
from tessera.operators import pages as P
from tessera.operators import review as V
from tessera.operators import rules as U
from tessera.operators import scoring as S
from tessera.operators.ordering import first_rows
from tessera.plans.block_plans import _CANDIDATES, _DECLINED, _NOUNS, _candidates, _hits, _scored_hits, decline_names
from tessera.plans.fleet_plans import _CALLS, _KEYS, calls
from tessera.plans.models import MODELS_CTE, SCORE_SQL, _OWNER, model_fitness, models, owner
from tessera.plans.registry import Registry
from tessera.plans.score_plans import _BANDS, SCORE_CTE, scored
from tessera.sources.tables import table
from tessera.sources.work import work_dir

R = Registry()
_PAGE_WORDS = 60


@R.add(f"WITH {SCORE_CTE}, f AS (SELECT unnest(['src1', 'src2', 'none']) AS prefix) SELECT prefix, {_BANDS} FROM f LEFT JOIN sc ON starts_with(source, prefix) GROUP BY prefix")
def prefix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score bands of all blocks whose name starts with a prefix; overlapping prefixes each count."""
    prefixes = F.array(*map(F.lit, ("src1", "src2", "none")))
    rows = scored(spark, sf_dir).select("score", F.explode(F.filter(prefixes, lambda p: F.col("source").startswith(p))).alias("prefix"))
    asked = spark.range(1).select(F.explode(prefixes).alias("prefix"))
    return asked.join(rows, "prefix", "left").groupBy("prefix").agg(*(c.alias(k) for k, c in S.bands(F.col("score")).items()))


_STATE = "CASE WHEN kind IN ('rod_mijesanje', 'info') THEN 'info' WHEN score_sum / n > 8.8 THEN 'odbijen' WHEN n >= 5 AND len(books) >= 2 AND score_sum / n <= 8.2 THEN 'na_cekanju' ELSE 'kandidat' END"


@R.add(f"{_CANDIDATES} SELECT state, n, '  ' || rpad(state, 15, ' ') || ': ' || n AS line FROM (SELECT {_STATE} AS state, count(*) AS n FROM ca GROUP BY 1)")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = M.validated(F.col("n"), F.size("books"), F.col("score_sum") / F.col("n"), F.col("kind"))
    counts = _candidates(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"))
    return counts.withColumn("line", F.concat(F.lit("  "), F.rpad("state", 15, " "), F.lit(": "), F.col("n").cast("string")))


@R.add(f"{_NOUNS}, x AS (SELECT DISTINCT name FROM c WHERE n >= 5) SELECT name, {{{_DECLINED}}}['G'] AS genitive, {{{_DECLINED}}}['I'] AS instrumental FROM x ORDER BY name LIMIT 20")
def glossary_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty terms of the glossary, by name: what a prompt has room for."""
    return decline_names(spark, sf_dir).orderBy("name").limit(20)


@R.add(rf"""WITH t AS (SELECT source, unnest(regexp_extract_all(text, '{V.TOKEN}')) AS name FROM documents)
SELECT source, name, count(*) AS n FROM t WHERE regexp_matches(name, '{V.CHARACTER}') AND lower(name) NOT IN ({", ".join(f"'{w}'" for w in V.NOT_NAMES)}) GROUP BY ALL HAVING count(*) >= 3""")
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.characters(table(spark, sf_dir, "documents").select("source", "text"), ["source"])


@R.add(r"""WITH b AS (SELECT conv_id, turn, '{"finalno_polirano": "' || text || ' "quoted" end"} ' AS raw FROM conversations)
SELECT conv_id, turn, regexp_extract(raw, '"finalno_polirano"\s*:\s*"(.+)"\s*\}?\s*$', 1, 's') AS text FROM b""")
def greedy_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of JSON that no parser takes, since quotes inside are not escaped: up to the last quote."""
    raw = F.concat(F.lit('{"finalno_polirano": "'), "text", F.lit(' "quoted" end"} '))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract(raw, r'(?s)"finalno_polirano"\s*:\s*"(.+)"\s*\}?\s*\z', 1).alias("text"))


_RULES = [("tion", "cija"), ("ci[aj]+", "ca"), ("  +", " "), ("nd ", "nt ")]


def _rule_sql() -> str:
    text, counts = "text", []
    for pattern, new in _RULES:
        counts.append(f"len(regexp_extract_all({text}, '{pattern}'))::BIGINT")
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return f"r AS (SELECT doc_id, {text} AS text, [{', '.join(counts)}] AS counts FROM documents)"


@R.add(f"WITH {_rule_sql()} SELECT i::INT AS rule, sum(counts[i + 1])::BIGINT AS n, count(*) FILTER (counts[i + 1] > 0) AS n_docs FROM r, (SELECT unnest(range({len(_RULES)})) AS i) GROUP BY i")
def rule_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule of an ordered list rewrote something, and in how many texts."""
    counts = V.counted_rewrite(table(spark, sf_dir, "documents").select("text"), _RULES).select(F.posexplode("counts").alias("rule", "n"))
    return counts.groupBy("rule").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("n_docs"))


# Terms of the glossary: words of all documents; the SQL rewrites word by word, by the same bounds.
_TERMS = ["tion", "the", "und", "de"]


@R.add(rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+') AS ws, regexp_split_to_array(text, '[\p{{L}}\p{{M}}\p{{N}}_]+') AS gaps FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: regexp_replace(gaps[i], '[ti][io]|[0-9]', '_', 'g') || coalesce(CASE WHEN lower(ws[i]) IN ({", ".join(f"'{t}'" for t in _TERMS)}) THEN ws[i] ELSE regexp_replace(ws[i], '[ti][io]|[0-9]', '_', 'g') END, '')), '') AS text FROM p""")
def protected_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that may not touch the terms of a glossary."""
    text = V.protected(F.col("text"), _TERMS, lambda t: F.regexp_replace(t, "[ti][io]|[0-9]", "_"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


_RULE_COUNT = 300
# The commonest words are rules; each adds a mark, so the length tells how often it was used.
_COMMON = rf"""co AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{{4,}}')) AS w FROM benchmark) GROUP BY w),
ru AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS seq FROM co QUALIFY seq <= {_RULE_COUNT}), al AS (SELECT list(w ORDER BY seq) AS ws FROM ru)"""


@R.add(f"""WITH {_COMMON}, r AS (SELECT doc_id, text AS old, list_reduce(list_prepend(text, ws), lambda acc, w: regexp_replace(acc, w, upper(w) || '+', 'gi')) AS text FROM documents, al)
SELECT doc_id, '<p class="' || (SELECT ws[1] FROM al) || '">' || text || '</p>' AS text, (length(text) - length(old))::BIGINT AS n FROM r""")
def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hundred rules from a table, in order; tags, which hold words of rules, stay."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    common = words.orderBy(F.desc("n"), "w").limit(_RULE_COUNT)
    order = Window.orderBy(F.desc("n"), "w")  # the rules of one engine
    rules = common.select(F.row_number().over(order).alias("seq"), F.col("w").alias("pattern"), F.concat(F.upper("w"), F.lit("+")).alias("replacement"), F.lit("word").alias("category"))
    first = rules.where("seq = 1").head()
    opening = F.lit(f'<p class="{first["pattern"] if first else ""}">')
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(opening, "text", F.lit("</p>")).alias("text"))
    made = U.apply_rules(docs, rules)
    n = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["n"])
    return made.select("doc_id", "text", n.alias("n"))


_MATTER = " OR ".join(f"contains(file, '{w}')" for w in T.PARATEXT_FILES)


@R.add(f"WITH {SCORE_CTE}, f AS (SELECT page_id, replace(replace(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '_', ''), '-', '') AS file, page_id AS doc_id FROM pages) SELECT f.page_id, CASE WHEN {_MATTER} THEN 8.5 ELSE score END::DOUBLE AS score FROM f LEFT JOIN sc USING (doc_id)")
def paratext_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front and back matter is known by its file's name and has a fixed score; the rest its own."""
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", T.paratext_file(path).alias("matter"), F.col("page_id").alias("doc_id"))
    own = pages.join(scored(spark, sf_dir).select("doc_id", "score"), "doc_id", "left")
    return own.select("page_id", F.when(F.col("matter"), T.PARATEXT_SCORE).otherwise(F.col("score")).alias("score"))


_VERBS = {"rekao": "rekla", "bio": "bila", "vidio": "vidjela", "pogledao": "pogledala"}
_TITLES = {"gospodin": "M", "gospođa": "Ž"}
# Documents hold no South-Slavic text, so clues are planted.
_TOLD = ["Marko je rekao. Ana se je vidjela.", "Tu bila je Ana; gospođa Kos i gospodin Marko.", "Marko je pogledala. vidio je Ivo.", ""]


def _clue_sql() -> str:
    # RE2's word boundary is ASCII, so letters beyond it are spelled out.
    start, end, parts = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])", []
    for gender, forms in (("M", list(_VERBS)), ("Ž", list(_VERBS.values()))):
        either, called = "|".join(sorted(forms, key=lambda v: (-len(v), v))), "|".join(t for t, g in _TITLES.items() if g == gender)
        for p in (rf"{start}({V.NAME})\s+(?:se\s+)?je\s+(?:{either}){end}", rf"{start}(?:{either})\s+je\s+({V.NAME}){end}", rf"{start}(?i:{called})\s+({V.NAME}){end}"):
            parts.append(f"SELECT source, doc_id, {len(parts)} AS part, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS name, '{gender}' AS clue FROM (SELECT *, regexp_extract_all(told, '{p}', 1) AS x FROM p)")
    told = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TOLD)) + " END"
    stop = ", ".join(f"'{n}'" for n in STOP_NAMES)
    return f"p AS (SELECT source, doc_id, text || ' ' || {told} AS told FROM documents), cl AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE name NOT IN ({stop}))"


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.element_at(F.array(*map(F.lit, _TOLD)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.concat_ws(" ", "text", told).alias("text"))


def _clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.gender_clues(_told(spark, sf_dir), _VERBS, _TITLES, stop=STOP_NAMES)


@R.add(f"WITH {_clue_sql()} SELECT source, name, count(*) FILTER (clue = 'M') AS clue_m, count(*) FILTER (clue = 'Ž') AS clue_f FROM cl GROUP BY ALL")
def gender_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clues(spark, sf_dir).groupBy("source", "name").agg(F.count_if(F.col("clue") == "M").alias("clue_m"), F.count_if(F.col("clue") == "Ž").alias("clue_f"))


_DECIDED = """k AS (SELECT *, count(*) FILTER (clue = 'M') OVER w AS m, count(*) FILTER (clue = 'Ž') OVER w AS f FROM cl WINDOW w AS (PARTITION BY source, name ORDER BY doc_id, part, i ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN m >= 3 AND m > f THEN 'M' WHEN f >= 3 AND f > m THEN 'Ž' END AS verdict FROM k),
de AS (SELECT source, name, count(*) FILTER (clue = 'M') AS clue_m, count(*) FILTER (clue = 'Ž') AS clue_f, first(verdict ORDER BY doc_id, part, i) FILTER (verdict IS NOT NULL) AS gender FROM v GROUP BY ALL),
gl AS (SELECT source, unnest(['Iva', 'Marko']) AS name, CASE WHEN source < 'src12' THEN 'Ž' ELSE '?' END AS given FROM (SELECT DISTINCT source FROM documents)),
ge AS (SELECT source, name, greatest(coalesce(clue_m, 0), CASE WHEN g = 'M' THEN 3 ELSE 0 END)::BIGINT AS clue_m, greatest(coalesce(clue_f, 0), CASE WHEN g = 'Ž' THEN 3 ELSE 0 END)::BIGINT AS clue_f, coalesce(g, gender) AS gender
  FROM de FULL JOIN (SELECT source, name, given AS g FROM gl WHERE given IN ('M', 'Ž')) USING (source, name))"""


@R.add(f"WITH {_clue_sql()}, {_DECIDED} SELECT * FROM ge")
def gender_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gender of every name of a book: the glossary's, else by its clues in order, once decided for good."""
    clues = _clues(spark, sf_dir)
    decided = N.gender(clues, ["source", "name"], ["doc_id", "place"])
    names = F.explode(F.array(F.lit("Iva"), F.lit("Marko"))).alias("name")
    glossary = table(spark, sf_dir, "documents").select("source").distinct().select("source", names, F.when(F.col("source") < "src12", "Ž").otherwise("?").alias("gender"))
    return N.with_glossary(decided, glossary, ["source", "name"])


@R.add(f"WITH {_clue_sql()}, {_DECIDED} SELECT count(*) AS total, count(*) FILTER (gender = 'M') AS m, count(*) FILTER (gender = 'Ž') AS f, count(*) FILTER (gender IS NULL) AS unknown FROM ge")
def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("gender")
    return gender_decide(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(g == "M").alias("m"), F.count_if(g == "Ž").alias("f"), F.count_if(g.isNull()).alias("unknown"))


_WS = r"[\p{L}\p{M}\p{N}_]+(?:-[\p{L}\p{M}\p{N}_]+)*"
_PAIRS = ", ".join(f"('{m}', '{f}')" for m, f in FEMALE_FORMS.items())
_JOINED = "array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce({}, '')), '')"


@R.add(rf"""WITH {_clue_sql()}, {_DECIDED}, fo AS (SELECT map_from_entries(list((m, f))) AS fem, map_from_entries(list((f, m))) AS mal FROM (VALUES {_PAIRS}) AS t(m, f)),
w AS (SELECT source, doc_id, regexp_extract_all(told, '{_WS}') AS ws, regexp_split_to_array(told, '{_WS}') AS gaps FROM p),
i AS (SELECT source, doc_id, ws, gaps, unnest(range(1, len(ws) + 1)) AS i FROM w),
c AS (SELECT source, doc_id, i, lower(ws[i]) AS form, ws[i] AS old,
  CASE WHEN i > 2 AND lower(ws[i-1]) = 'je' AND regexp_full_match(gaps[i], '\s+') AND regexp_full_match(gaps[i-1], '\s+') THEN CASE WHEN lower(ws[i-2]) <> 'se' THEN ws[i-2] WHEN i > 3 AND regexp_full_match(gaps[i-2], '\s+') THEN ws[i-3] END END AS before,
  CASE WHEN lower(ws[i+1]) = 'je' AND regexp_full_match(gaps[i+1], '\s+') AND regexp_full_match(gaps[i+2], '\s+') THEN ws[i+2] END AS after FROM i),
g AS (SELECT c.*, coalesce(b.gender, a.gender) AS gender FROM c LEFT JOIN ge b ON b.source = c.source AND lower(b.name) = lower(c.before) LEFT JOIN ge a ON a.source = c.source AND lower(a.name) = lower(c.after) WHERE before IS NOT NULL OR after IS NOT NULL),
n AS (SELECT source, doc_id, i, CASE WHEN old = upper(old) THEN upper(x) WHEN left(old, 1) = upper(left(old, 1)) THEN upper(left(x, 1)) || substr(x, 2) ELSE x END AS new FROM (SELECT g.*, CASE gender WHEN 'Ž' THEN fem[form] WHEN 'M' THEN mal[form] END AS x FROM g, fo) WHERE x IS NOT NULL),
m AS (SELECT doc_id, map_from_entries(list((i, new))) AS ch, count(*) AS k FROM n GROUP BY doc_id)
SELECT doc_id, {_JOINED.format("coalesce(ch[i], ws[i])")} AS text, coalesce(k, 0) AS n_corrected FROM w LEFT JOIN m USING (doc_id)""")
def gender_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participles in the gender that their book's registry has for the name that they tell of."""
    made = M2.gender_corrected(_told(spark, sf_dir), "doc_id", "source", gender_decide(spark, sf_dir).select(F.col("source").alias("book"), "name", "gender"))
    return made.select("doc_id", "text", "n_corrected")


_ODD = ["Hodavao je, i Voljevala; poznavao je.", "On je radivao. UZDISNUO je čitavao", "x", ""]
_ODD_SQL = "text || chr(10) || CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_ODD)) + " END"


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.element_at(F.array(*map(F.lit, _ODD)), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), more).alias("text"))


def _doubtful_sql() -> str:
    letter = r"[\p{L}\p{M}\p{N}_-]"
    right = ", ".join(f"'{w}'" for w in RIGHT)
    parts = [f"SELECT doc_id, i, f AS form, {i}::INT AS pattern FROM u WHERE regexp_full_match(f, '(?i){p.replace(chr(92) + 'w', letter)}')" for i, p in enumerate(DOUBTFUL)]
    return rf"""WITH d AS (SELECT doc_id, {_ODD_SQL} AS text FROM documents), w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WS}') AS ws, regexp_split_to_array(text, '{_WS}') AS gaps FROM d),
u AS (SELECT doc_id, unnest(ws) AS f, unnest(range(1, len(ws) + 1)) AS i FROM w), x AS ({" UNION ALL ".join(parts)}),
h AS (SELECT doc_id, text, pattern, form, (length(array_to_string(gaps[1:i], '')) + length(array_to_string(ws[1:i - 1], '')))::INT AS position FROM x JOIN w USING (doc_id) WHERE lower(form) NOT IN ({right}))
SELECT doc_id, pattern, form, position, replace(substr(text, greatest(position - 40, 0) + 1, least(position, 40) + length(form) + 40), chr(10), ' ') AS context FROM h"""


@R.add(_doubtful_sql())
def morph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful forms with where they stand and what is around them."""
    return M2.doubtful_forms(_odd(spark, sf_dir), "doc_id")


@R.add(rf"""WITH fo AS (SELECT map_from_entries(list((m, f))) AS fix FROM (VALUES {", ".join(f"('{m}', '{f}')" for m, f in WRONG_FORMS.items())}) AS t(m, f)), d AS (SELECT doc_id, {_ODD_SQL} AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{_WS}') AS ws, regexp_split_to_array(text, '{_WS}') AS gaps FROM d),
n AS (SELECT doc_id, ws, gaps, list_transform(ws, lambda x: coalesce(CASE WHEN length(x) > 1 AND x = upper(x) THEN upper(fix[lower(x)]) WHEN left(x, 1) = upper(left(x, 1)) THEN upper(left(fix[lower(x)], 1)) || substr(fix[lower(x)], 2) ELSE fix[lower(x)] END, x)) AS ns FROM w, fo)
SELECT doc_id, {_JOINED.format("ns[i]")} AS text, len(list_filter(range(1, len(ws) + 1), lambda i: ws[i] <> ns[i]))::BIGINT AS n_changes FROM n""")
def morph_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that do not exist, replaced."""
    made = _odd(spark, sf_dir).select("doc_id", M2.mended_forms(F.col("text")).alias("m"))
    return made.select("doc_id", "m.text", F.size("m.changes").cast("long").alias("n_changes"))


def _chat_sql() -> str:
    tests = ["NOT (" + " OR ".join(f"contains(lower(model), '{w}')" for w in V.NOT_CHAT) + ")"]
    for provider, (wanted, unwanted) in V.PROVIDER_WORDS.items():
        fits = ["(" + " OR ".join(f"lower(model) LIKE '{w}'" for w in either) + ")" for either in wanted]
        fits += [f"NOT contains(lower(model), '{w}')" for w in unwanted]
        tests.append(f"(provider <> '{provider}' OR ({' AND '.join(fits)}))")
    return " AND ".join(tests)


@R.add(f"WITH {MODELS_CTE} SELECT DISTINCT model_id, provider, model FROM mo WHERE {_chat_sql()}")
def model_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).where(V.chats(F.col("provider"), F.col("model"))).select("model_id", "provider", "model").distinct()


_HEALTH = """ok AS (SELECT l_partkey AS model_id, count(*) FILTER (l_returnflag <> 'R') / count(*) AS health, count(*) AS n FROM lineitem GROUP BY l_partkey)"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stand for answers of models, returned ones for failures."""
    good = F.count_if(F.col("l_returnflag") != "R") / F.count("*")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("model_id")).agg(good.alias("health"))


@R.add(f"WITH {MODELS_CTE}, {_HEALTH}, d AS (SELECT provider, model, bool_or(coalesce(health < .7, false) OR provider < 'D') AS dead FROM mo LEFT JOIN ok USING (model_id) GROUP BY ALL), a AS (SELECT *, count(*) FILTER (NOT dead) OVER (PARTITION BY provider) AS alive FROM d) SELECT provider, model FROM a WHERE NOT dead OR alive = 0 GROUP BY ALL")
def living_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that answer, and all those of providers of which none does."""
    known = models(spark, sf_dir).select("model_id", "provider", "model")
    dead = known.join(_health(spark, sf_dir), "model_id", "left").where((F.col("health") < 0.7) | (F.col("provider") < "D"))
    return V.living(known, dead.select("provider", "model")).select("provider", "model").distinct()


@R.add(f"""{_CALLS}, {_KEYS}, {MODELS_CTE}, {_HEALTH},
rest AS (SELECT provider, key, max(seq) FILTER (code IN (401, 402, 403)) AS refused, max(seq) FILTER (code = 200) AS good FROM calls GROUP BY ALL),
fr AS (SELECT {_OWNER} AS provider, count(*) FILTER (coalesce(good, -1) > coalesce(refused, -1)) AS n_keys FROM (SELECT DISTINCT key, max(refused) OVER (PARTITION BY key) AS refused, max(good) OVER (PARTITION BY key) AS good FROM rest) GROUP BY 1),
s AS (SELECT mo.*, {SCORE_SQL} * coalesce(health, 1) AS fitness, health FROM mo LEFT JOIN ok USING (model_id) WHERE {_chat_sql()}),
r AS (SELECT s.*, n_keys, row_number() OVER (PARTITION BY role ORDER BY round(fitness, 9) DESC, model_id) AS place FROM s JOIN fr USING (provider) WHERE fitness >= 0 AND coalesce(health, 1) >= .1 AND n_keys > 0)
SELECT role, model_id, provider, model, round(fitness, 6) AS fitness, n_keys, place::INT AS place FROM r WHERE place <= 20""")
def route_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best models of each role: fitness for it times health, of providers that have a key
    whose last word was not a refusal."""
    last = calls(table(spark, sf_dir, "events")).groupBy("key").agg(F.max(F.when(F.col("code").isin(401, 402, 403), F.col("seq"))).alias("refused"), F.max(F.when(F.col("code") == 200, F.col("seq"))).alias("good"))
    usable = F.coalesce("good", F.lit(-1)) > F.coalesce("refused", F.lit(-1))
    keys = last.groupBy(owner(F.col("key")).alias("provider")).agg(F.count_if(usable).alias("n_keys")).where("n_keys > 0")
    fit = models(spark, sf_dir).where(V.chats(F.col("provider"), F.col("model"))).withColumn("score", model_fitness())
    rated = fit.join(_health(spark, sf_dir), "model_id", "left").where((F.col("score") >= 0) & (F.coalesce("health", F.lit(1.0)) >= 0.1)).join(keys, "provider")
    rated = rated.withColumn("fitness", F.col("score") * F.coalesce("health", F.lit(1.0)))
    order = [F.desc(F.round("fitness", 9)), F.asc("model_id")]
    best = first_rows(rated, ["role"], order, 20)
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy(*order)))  # twenty rows each
    return placed.select("role", "model_id", "provider", "model", F.round("fitness", 6).alias("fitness"), "n_keys", "place")


_TOKEN = P.TOKEN.replace("(?is)", "")
_VOID = ", ".join(f"'{v}'" for v in P.VOID)
# The tags of each page in turn, with the stack of those that are open.
_NODES = rf"""WITH RECURSIVE b AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<body\b[^>]*>.*</body\s*>') THEN regexp_extract(html, '(?is)<body\b[^>]*>(.*)</body\s*>', 1) ELSE html END AS body FROM pages),
k AS (SELECT page_id, regexp_extract_all(body, '(?is){_TOKEN}') AS ts FROM b),
t AS (SELECT page_id, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS tok FROM k),
n AS (SELECT *, CASE WHEN regexp_matches(tok, '(?is)^<(script|style|!)') OR ends_with(tok, '/>') THEN '' ELSE lower(regexp_extract(tok, '(?s)^<([a-zA-Z][^\s/>]*)', 1)) END AS op, lower(regexp_extract(tok, '(?s)^</\s*([a-zA-Z][^\s/>]*)', 1)) AS cl FROM t),
st AS (SELECT page_id, 0::BIGINT AS i, []::VARCHAR[] AS stack, 0::BIGINT AS node FROM k
  UNION ALL SELECT n.page_id, n.i,
    CASE WHEN op <> '' AND op NOT IN ({_VOID}) THEN list_append(stack, op) WHEN cl <> '' AND list_contains(stack, cl) THEN stack[:len(stack) - list_position(list_reverse(stack), cl)] ELSE stack END,
    CASE WHEN len(stack) = 0 THEN st.node + 1 ELSE st.node END
  FROM st JOIN n ON n.page_id = st.page_id AND n.i = st.i + 1),
no AS (SELECT st.page_id, node, string_agg(tok, '' ORDER BY st.i) AS html, string_agg(CASE WHEN tok = '<' OR NOT starts_with(tok, '<') THEN tok ELSE '' END, '' ORDER BY st.i) AS said FROM st JOIN n ON st.page_id = n.page_id AND st.i = n.i GROUP BY ALL),
wo AS (SELECT page_id, node, html, len(list_filter(regexp_split_to_array(said, '[\s\x0B\x1C-\x1F\x85\x{{A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda w: w <> '')) AS w FROM no),
pk AS (SELECT page_id, 0::BIGINT AS node, 0::BIGINT AS words, 0::BIGINT AS block FROM k
  UNION ALL SELECT wo.page_id, wo.node, CASE WHEN wo.w > 0 AND pk.words > 0 AND pk.words + wo.w > {_PAGE_WORDS} THEN wo.w ELSE pk.words + wo.w END, pk.block + CASE WHEN wo.w > 0 AND pk.words > 0 AND pk.words + wo.w > {_PAGE_WORDS} THEN 1 ELSE 0 END
  FROM pk JOIN wo ON wo.page_id = pk.page_id AND wo.node = pk.node + 1),
bl AS (SELECT pk.page_id, block, sum(w)::BIGINT AS n_words, string_agg(html, '' ORDER BY pk.node) AS html FROM pk JOIN wo ON pk.page_id = wo.page_id AND pk.node = wo.node GROUP BY ALL HAVING regexp_matches(string_agg(html, ''), '\S'))"""


@R.add(f"{_NODES} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY block) - 1)::INT AS block, n_words, html FROM bl")
def chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as blocks of whole top-level nodes."""
    return P.page_blocks(table(spark, sf_dir, "pages"), "page_id", most=_PAGE_WORDS)


@R.add(None)
def skip_corrector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose edited version needs no corrector; every third is untouched, every third has one word
    changed in forty, and the rest many."""
    docs = scored(spark, sf_dir)
    few, many = F.regexp_replace("text", r"((?:\S+\s+){39})\S+", "$1novo"), F.regexp_replace("text", "[aeiou]n", "x")
    after = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, few).otherwise(many)
    edited = docs.select("doc_id", "score", F.col("text").alias("before"), after.alias("after"))
    return edited.select("doc_id", V.skips_corrector(F.col("score"), F.col("before"), F.col("after")).alias("skips"))


_STEMS = """st AS (SELECT source AS folder, doc_id, 'c' || (doc_id % 7) || '.html_blok_' || doc_id AS stem FROM documents),
fi AS (SELECT DISTINCT folder, unnest(CASE doc_id % 5 WHEN 0 THEN [stem] WHEN 1 THEN [replace(stem, '.html', ''), stem || 'x'] WHEN 2 THEN ['aaa_blok_' || doc_id, 'King_c' || (doc_id % 7) || '_v2_blok_' || doc_id, replace(stem, '.html', CASE WHEN doc_id % 2 = 0 THEN '' ELSE '_' END)] WHEN 3 THEN ['zz_blok_' || doc_id, 'other_blok_' || doc_id] ELSE ['c1_blok_x'] END) AS name FROM st)"""


@R.add(f"""WITH {_STEMS}, j AS (SELECT st.folder, stem, name, CASE WHEN name = stem THEN 1 WHEN name = replace(stem, '.html', '') THEN 2
    WHEN contains(split_part(name, '_blok_', 1), split_part(stem, '.', 1)) THEN 5 ELSE 6 END AS rank
  FROM st JOIN fi ON st.folder = fi.folder AND regexp_extract(stem, '_blok_([0-9]+)$', 1) = regexp_extract(name, '_blok_([0-9]+)$', 1))
SELECT st.folder, st.stem, b.name, b.rank FROM st LEFT JOIN (SELECT folder, stem, arg_min(name, (rank, name)) AS name, min(rank)::INT AS rank FROM j GROUP BY ALL) b ON st.folder = b.folder AND st.stem = b.stem""")
def chunk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each block: of its own name, stripped of the page's ending, alike in name and number, or of the same number."""
    i = F.col("doc_id")
    number, page = i.cast("string"), F.concat(F.lit("c"), (i % 7).cast("string"))
    stems = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), "doc_id", F.concat(page, F.lit(".html_blok_"), number).alias("stem"))
    plain = lambda by: F.replace("stem", F.lit(".html"), by)
    names = F.when(i % 5 == 0, F.array("stem")).when(i % 5 == 1, F.array(plain(F.lit("")), F.concat("stem", F.lit("x"))))
    names = names.when(i % 5 == 2, F.array(F.concat(F.lit("aaa_blok_"), number), F.concat(F.lit("King_"), page, F.lit("_v2_blok_"), number), plain(F.when(i % 2 == 0, "").otherwise("_"))))
    names = names.when(i % 5 == 3, F.array(F.concat(F.lit("zz_blok_"), number), F.concat(F.lit("other_blok_"), number))).otherwise(F.array(F.lit("c1_blok_x")))
    return paths.resolved(stems, stems.select("folder", F.explode(names).alias("name")))


@R.add(f"{_CANDIDATES}, sn AS (SELECT DISTINCT pattern, kind, h.source AS book, h.doc_id AS chunk, score FROM h JOIN sc ON h.doc_id = sc.doc_id WHERE score >= 4.0) SELECT pattern, kind, count(*) AS n, round(sum(score), 6) AS score_sum, count(DISTINCT book) AS n_books FROM sn WHERE pattern NOT IN ('clown', 'der die') GROUP BY ALL")
def retro_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns by what three scans saw, the second a part and the third a repetition of the first: each place once.
    What is applied already, or in the base list, goes."""
    folder = work_dir(spark, "sightings")
    made = _scored_hits(spark, sf_dir).select("pattern", "kind", F.col("source").alias("book"), F.col("doc_id").alias("chunk"), "score", "context")
    made.write.parquet(f"{folder}/seen")  # the texts are scored once, for all scans
    seen = spark.read.schema(made.schema).parquet(f"{folder}/seen")
    store = M.SightingStore(f"{folder}/store")
    store.write(seen, 1)
    store.write(seen.where("chunk % 2 = 0"), 2)
    store.write(seen, 1)
    rules = lambda *names: spark.createDataFrame([(n,) for n in names], "pattern string")
    found = M.unapplied(M.patterns_of(store.read(spark)), rules("clown"), rules("der die"))
    return found.withColumn("score_sum", F.round("score_sum", 6))
