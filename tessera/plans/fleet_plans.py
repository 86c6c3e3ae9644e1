"""Queries over service calls. Events stand for calls: the type is the provider, the user the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import fleet
from tessera.operators.ordering import first_rows
from tessera.plans.models import _OWNER, _PROVIDERS, MODELS_CTE, SCORE_SQL, model_fitness, models, owner
from tessera.plans.registry import Registry
from tessera.sources.tables import table
from tessera.streaming import calls as stream_calls

R = Registry()

_CALLS = """WITH calls AS (SELECT upper(event_type) AS provider, user_id % 20 AS key, ts, event_id AS seq, value,
  CASE event_id % 10 WHEN 6 THEN 429 WHEN 7 THEN 401 WHEN 8 THEN 401 WHEN 9 THEN 500 ELSE 200 END AS code, (event_id % 4) * 30 AS seconds FROM events)"""


def calls(events: DataFrame) -> DataFrame:
    kind = F.col("event_id") % 10
    code = F.when(kind == 6, 429).when(kind.isin(7, 8), 401).when(kind == 9, 500).otherwise(200)
    return events.select(F.upper("event_type").alias("provider"), (F.col("user_id") % 20).alias("key"), "ts", F.col("event_id").alias("seq"), "value", code.alias("code"), ((F.col("event_id") % 4) * 30).alias("seconds"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(table(spark, sf_dir, "events"))


_KEYS = """k AS (SELECT provider, key, count(*) FILTER (code < 400) AS ok, count(*) FILTER (code >= 500) AS failed, count(*) FILTER (code >= 400 AND code < 500) AS rejected FROM calls GROUP BY ALL),
kr AS (SELECT *, round(ok / (ok + failed + rejected), 4) AS rate FROM k)"""


@R.add(f"{_CALLS}, {_KEYS} SELECT * FROM kr")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.key_counts(_calls(spark, sf_dir))


@R.add(f"{_CALLS}, {_KEYS} SELECT provider, count(*) AS n_keys, sum(ok)::BIGINT AS ok, sum(failed)::BIGINT AS failed, round(avg(rate), 4) AS rate FROM kr GROUP BY provider")
def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.provider_counts(_calls(spark, sf_dir))


@R.add(f"{_CALLS} SELECT provider, code, count(*) AS n FROM calls WHERE code >= 400 GROUP BY ALL")
def rejections_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).where("code >= 400").groupBy("provider", "code").agg(F.count("*").alias("n"))


@R.add(f"{_CALLS} SELECT provider, key, seq, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY provider, key ORDER BY ts, seq))) / 1e6 AS gap FROM calls")
def call_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.gaps(_calls(spark, sf_dir)).select("provider", "key", "seq", "gap")


@R.add(f"{_CALLS} SELECT provider, key, seq, (max(epoch_us(ts) + seconds * 1000000) OVER (PARTITION BY provider, key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS until FROM calls")
def cooldown_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.cooldowns(_calls(spark, sf_dir)).select("provider", "key", "seq", "until")


@R.add(f"""{_CALLS}, e AS (SELECT *, count(*) FILTER (code = 200) OVER (PARTITION BY provider, key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS era FROM calls)
SELECT provider, key, seq, count(*) FILTER (code = 401) OVER (PARTITION BY provider, key, era ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS streak FROM e""")
def consecutive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.consecutive_errors(_calls(spark, sf_dir)).select("provider", "key", "seq", "streak")


@R.add(f"""{_CALLS}, g AS (SELECT provider, key, seq, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY provider, key ORDER BY ts, seq))) / 1e6 AS gap FROM calls),
l AS (SELECT provider, key, list(gap ORDER BY ts, seq) FILTER (gap IS NOT NULL) AS gs FROM g GROUP BY ALL)
SELECT provider, key, round(CASE WHEN len(gs) > 0 THEN list_reduce(gs, lambda a, x: .7 * a + .3 * x) END, 3) AS smoothed FROM l""")
def ewma_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.smoothed_gap(_calls(spark, sf_dir)).withColumn("smoothed", F.round("smoothed", 3))


@R.add(f"{_CALLS} SELECT provider, seq, ((row_number() OVER (PARTITION BY provider ORDER BY ts, seq) - 1) % 3)::INT AS turn FROM calls")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.rotation(_calls(spark, sf_dir), 3).select("provider", "seq", "turn")


@R.add(f"{_CALLS}, l AS (SELECT provider, key, max(ts) AS last, arg_max(code, seq) AS code FROM calls GROUP BY ALL) SELECT provider, count(*) AS n_keys, count(*) FILTER (code < 400) AS active FROM l GROUP BY provider")
def active_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _calls(spark, sf_dir).groupBy("provider", "key").agg(F.max_by("code", "seq").alias("code"))
    return last.groupBy("provider").agg(F.count("*").alias("n_keys"), F.count_if(F.col("code") < 400).alias("active"))


@R.add(f"""{_CALLS}, k AS (SELECT {_OWNER} AS provider, count(*) AS n_keys FROM (SELECT DISTINCT user_id AS key FROM events) GROUP BY 1)
SELECT provider, n_keys, n_keys * provider_rpm AS per_minute, CASE WHEN rpd <> 0 THEN n_keys * rpd END AS per_day FROM k JOIN {_PROVIDERS} USING (provider)""")
def fleet_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the keys in use allow each provider in a minute and a day; no limit a day: null."""
    keys = table(spark, sf_dir, "events").select("user_id").distinct().groupBy(owner(F.col("user_id")).alias("provider")).agg(F.count("*").alias("n_keys"))
    known = spark.createDataFrame(fleet.PROVIDERS, "provider string, rpm int, rpd int, tier int")
    return keys.join(known, "provider").select("provider", "n_keys", (F.col("n_keys") * F.col("rpm")).alias("per_minute"), F.when(F.col("rpd") != 0, F.col("n_keys") * F.col("rpd")).alias("per_day"))


_TALKING = "NOT regexp_matches(model, 'whisper|tts|embed|guard|image')"


def _scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = models(spark, sf_dir).where(~F.col("model").rlike("whisper|tts|embed|guard|image"))
    return usable.select("role", "model_id", "model", model_fitness().alias("score"))


@R.add(f"WITH {MODELS_CTE} SELECT role, model_id, model, round({SCORE_SQL}, 6) AS score FROM mo WHERE {_TALKING}")
def model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_models(spark, sf_dir).withColumn("score", F.round("score", 6))


@R.add(f"WITH {MODELS_CTE}, s AS (SELECT *, round({SCORE_SQL}, 9) AS score FROM mo WHERE {_TALKING}) SELECT role, model_id, model, (row_number() OVER (PARTITION BY role ORDER BY score DESC, model_id))::INT AS place FROM s WHERE score >= 0 QUALIFY place <= 100")
def rank_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best models of each role."""
    order = [F.desc("score"), F.asc("model_id")]
    best = first_rows(_scored_models(spark, sf_dir).withColumn("score", F.round("score", 9)).where("score >= 0"), ["role"], order, 100)
    place = F.row_number().over(Window.partitionBy("role").orderBy(*order))  # a hundred rows each
    return best.select("role", "model_id", "model", place.alias("place"))


@R.add(f"WITH {MODELS_CTE} SELECT DISTINCT model_id, round(coalesce(list_max(list_transform(regexp_extract_all(model, '([0-9]+)b', 1), lambda x: least(18, x::DOUBLE ** .6))), 0), 9)::DOUBLE AS strength FROM mo")
def model_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.transform(F.regexp_extract_all("model", F.lit("([0-9]+)b"), F.lit(1)), lambda x: F.least(F.lit(18.0), F.pow(x.cast("double"), F.lit(0.6))))
    named = models(spark, sf_dir).select("model_id", "model").distinct()
    return named.select("model_id", F.round(F.coalesce(F.array_max(sizes), F.lit(0.0)), 9).alias("strength"))


@R.add(f"""{_CALLS}, u AS (SELECT key, 'key-' || (key * 7919 + 100000) || provider AS k, avg(value) AS v, min(seq) AS s FROM calls GROUP BY ALL)
SELECT k AS name, left(k, 4) || '…' || right(k, 4) AS masked, lpad((s // 3600 % 24)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS eta FROM u""")
def key_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _calls(spark, sf_dir).groupBy("provider", "key").agg(F.min("seq").alias("s"))
    name = F.concat(F.lit("key-"), (F.col("key") * 7919 + 100000).cast("string"), "provider")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    eta = F.concat_ws(":", two(F.expr("s div 3600 % 24")), two(F.expr("s % 3600 div 60")), two(F.expr("s % 60")))
    return first.select(name.alias("name"), fleet.masked(name).alias("masked"), eta.alias("eta"))


@R.add(f"{_CALLS} SELECT provider, date_trunc('day', ts) AS start, count(*) AS n, count(*) FILTER (code >= 400) AS bad FROM calls GROUP BY ALL")
def call_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_calls.windowed_health(_calls(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@R.add(f"""{_CALLS}, o AS (SELECT key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, seq) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM calls),
s AS (SELECT key, ts, sum(new) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM o) SELECT key, min(ts) AS start, count(*) AS n FROM s GROUP BY key, id""")
def use_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_calls.use_sessions(_calls(spark, sf_dir)).withColumn("start", F.col("start").cast("timestamp_ntz"))
