"""Queries over the states of service keys: rests, renewals, what is worth keeping, and waits asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import key_state as K
from tessera.operators import scoring as S
from tessera.plans.fleet_plans import _CALLS, calls
from tessera.plans.registry import Registry
from tessera.plans.score_plans import SCORE_CTE
from tessera.sources.tables import table
from tessera.sources.work import work_dir
from tessera.streaming import calls as stream_calls
from tessera.streaming import key_state as stream_state
from tessera.streaming.results import BlockSink, run_blocks

R = Registry()

_CONTROLS = "[" + ", ".join(f"'{c}'" for c in K.CONTROLS) + "]"
# Each event of a key in turn: the rules of one step, from the state before it.
_STATES = f"""{_CALLS.replace("WITH calls", "WITH RECURSIVE calls")},
ev AS (SELECT provider, key::VARCHAR AS key, seq, epoch_us(ts) AS us, CASE WHEN seq % 97 <> 5 THEN CASE WHEN seq % 50 = 7 THEN 402 ELSE code END END AS code, CASE WHEN seq % 97 = 5 THEN {_CONTROLS}[(seq // 97) % 4 + 1] END AS control,
  CASE seq % 5 WHEN 0 THEN 5000 WHEN 1 THEN 90 WHEN 2 THEN 30 ELSE 0 END::DOUBLE AS asked, row_number() OVER (PARTITION BY provider, key ORDER BY ts, seq) AS n FROM calls),
st AS (
  SELECT provider, key, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::INT AS code, NULL::VARCHAR AS control, 0::BIGINT AS until, 0::BIGINT AS last, 0::BIGINT AS refusals, true AS free, 0::BIGINT AS ok, 0::BIGINT AS failed, 0::BIGINT AS rejected FROM (SELECT DISTINCT provider, key FROM ev)
  UNION ALL
  SELECT provider, key, n, seq, code, control,
    CASE WHEN control IS NOT NULL THEN 0 WHEN rest > 0 THEN greatest(until, us + (rest * 1000000)::BIGINT) ELSE until END,
    CASE WHEN control IS NULL THEN us WHEN control = 'unban' THEN last ELSE 0 END,
    CASE WHEN control IN ('rpd_reset', 'full_reset', 'unban') THEN 0 ELSE now END,
    until <= us AND (last = 0 OR us - last >= 2000000),
    CASE WHEN control = 'full_reset' THEN 0 ELSE ok + (coalesce(code < 400, false))::BIGINT END, CASE WHEN control = 'full_reset' THEN 0 ELSE failed + (coalesce(code >= 500, false))::BIGINT END,
    CASE WHEN control = 'full_reset' THEN 0 ELSE rejected + (coalesce(code >= 400 AND code < 500, false))::BIGINT END
  FROM (SELECT x.*, CASE WHEN code IN (401, 402, 403) THEN CASE WHEN code = 402 OR now >= 2 THEN 86400 ELSE 300 END
      WHEN code = 429 THEN CASE WHEN asked > 3600 THEN least(asked, 90000) WHEN asked > 60 THEN least(asked, 86400) WHEN asked > 0 THEN least(asked, 120) ELSE 45 END ELSE 0 END AS rest
    FROM (SELECT ev.*, st.until, st.last, st.ok, st.failed, st.rejected, CASE WHEN ev.code = 200 THEN 0 WHEN ev.code IN (401, 402, 403) THEN st.refusals + 1 ELSE st.refusals END AS now
      FROM st JOIN ev ON st.provider = ev.provider AND st.key = ev.key AND ev.n = st.n + 1) x)
)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("seq")
    control = F.when(seq % 97 == 5, F.element_at(F.array(*map(F.lit, K.CONTROLS)), (F.floor(seq / 97) % 4 + 1).cast("int")))
    asked = F.when(seq % 5 == 0, 5000.0).when(seq % 5 == 1, 90.0).when(seq % 5 == 2, 30.0).otherwise(0.0)
    code = F.when(control.isNull(), F.when(seq % 50 == 7, 402).otherwise(F.col("code")))
    return calls(table(spark, sf_dir, "events")).select("provider", "key", "ts", "seq", code.alias("code"), asked.alias("retry_after"), F.lit(45.0).alias("usual"), control.alias("control"))


@R.add(f"{_STATES} SELECT provider, key, seq, code, control, until AS resting_until, free, ok, failed, rejected FROM st WHERE n > 0")
def cooldown_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer and control with the state of its key after it, and whether the key was free."""
    return K.key_states(_events(spark, sf_dir), 2.0)


@R.add(f"{_STATES} SELECT provider, key, seq, code, control, until AS resting_until, free, ok, failed, rejected FROM st WHERE n > 0")
def cooldown_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the transition that the stream runs."""
    return K.replay(_events(spark, sf_dir), 2.0)


@R.add(f"{_STATES}, l AS (SELECT provider, key, arg_max(until, seq) AS until FROM st WHERE n > 0 GROUP BY ALL) SELECT * FROM l WHERE until > (SELECT max(us) FROM ev)")
def kept_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rests that still run at the end of the table: what a restart would restore."""
    events = _events(spark, sf_dir)
    now = events.select(F.max(K._micros(F.col("ts")))).head()[0]
    return K.kept_rests(K.key_states(events, 2.0), F.lit(now or 0))


_BODY = """CASE event_id % 8 WHEN 2 THEN '{"error": {"details": [{"reason": "x"}, {"retryDelay": "' || (event_id % 90000) || 's"}]}}' WHEN 3 THEN '{"error": {"status": "RESOURCE_EXHAUSTED"}}'
  WHEN 4 THEN '{"error": {"message": "Your Quota"}}' WHEN 5 THEN '{"error": {"message": "rate limit"}}' WHEN 6 THEN '{"error": {}}' WHEN 7 THEN 'none' END"""


@R.add(f"""WITH b AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN 403 ELSE 429 END AS code, CASE event_id % 8 WHEN 0 THEN value::VARCHAR WHEN 1 THEN 'soon' END AS header, {_BODY} AS body FROM events),
j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS js FROM b)
SELECT event_id, CASE WHEN try_cast(header AS DOUBLE) IS NOT NULL THEN header::DOUBLE WHEN code <> 429 THEN NULL
  WHEN contains(js, 'retryDelay') THEN rtrim(json_extract_string(js, '$.error.details[1].retryDelay'), 's')::DOUBLE
  WHEN json_extract_string(js, '$.error.status') = 'RESOURCE_EXHAUSTED' OR contains(lower(json_extract_string(js, '$.error.message')), 'quota') THEN (epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts)) / 1e6 + 60
  WHEN contains(lower(json_extract_string(js, '$.error.message')), 'rate limit') THEN 15 END::DOUBLE AS seconds FROM j""")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each answer asks to wait, by its header or its body."""
    i = F.col("event_id")
    said = F.when(i % 8 == 0, F.col("value").cast("string")).when(i % 8 == 1, "soon")
    error = lambda text: F.lit('{"error": ' + text + "}")
    delay = F.concat(F.lit('{"error": {"details": [{"reason": "x"}, {"retryDelay": "'), (i % 90000).cast("string"), F.lit('s"}]}}'))
    body = F.when(i % 8 == 2, delay).when(i % 8 == 3, error('{"status": "RESOURCE_EXHAUSTED"}')).when(i % 8 == 4, error('{"message": "Your Quota"}'))
    body = body.when(i % 8 == 5, error('{"message": "rate limit"}')).when(i % 8 == 6, error("{}")).when(i % 8 == 7, "none")
    headers = F.when(said.isNotNull(), F.create_map(F.lit("Retry-After"), said)).otherwise(F.create_map().cast("map<string,string>"))
    code = F.when(i % 11 == 0, 403).otherwise(429)
    made = K.retry_after(code, headers, body, F.col("ts"), F.lit(15))
    return table(spark, sf_dir, "events").select("event_id", made.alias("seconds"))


@R.add(f"{_STATES} SELECT provider, key, seq, code, control, until AS resting_until, free, ok, failed, rejected FROM st WHERE n > 0")
def cooldown_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states again, from a stream of the events; an event of no key far behind them closes it."""
    folder = work_dir(spark, "states")
    source = _events(spark, sf_dir)
    end = source.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    closing = end.select(*((F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias(c) if c == "ts" else F.lit("-" if t == "string" else 0).cast(t).alias(c) for c, t in source.dtypes))
    stamped = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))  # noqa: E731  watermarks need a zone
    stamped(source).write.parquet(f"{folder}/in/events")
    stamped(closing).write.parquet(f"{folder}/in/closing")
    stream = spark.readStream.schema(stamped(source).schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    stream_calls.run_to_table(stream_state.follow(stream, 2.0, "1 day"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(K.OUTPUT).parquet(f"{folder}/out").where("key <> '0' OR provider <> '-'")


@R.add(f"WITH {SCORE_CTE} SELECT source || '_blok_' || doc_id AS stem, source AS file, doc_id AS block, score, text FROM sc")
def block_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of blocks, scored exactly once each."""
    folder = work_dir(spark, "results")
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    named = docs.withColumn("stem", F.concat("source", F.lit("_blok_"), F.col("doc_id").cast("string")))
    model = lambda rows: S.heuristic_score(rows).select("stem", F.col("source").alias("file"), F.col("doc_id").alias("block"), "score", "text")
    sink = BlockSink(folder, model)
    run_blocks(named, sink, f"{folder}/checkpoint")
    return sink.results(spark).drop("batch")
