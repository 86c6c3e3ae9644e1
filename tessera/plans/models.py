"""Models of language services, derived from the table of parts: its rows stand for models, brands
for providers, sizes for calls a minute, types for kinds of model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fleet
from tessera.sources.tables import table

NAMES = [p[0] for p in fleet.PROVIDERS]
# Type of part to (end of the model's name, role that it prefers, role that it avoids, bonus).
KINDS = {
    "ECONOMY": ("-flash", "LEKTOR", "", 0.10), "MEDIUM": ("-it", "PREVODILAC", "LEKTOR", 0.0), "LARGE": ("-command", "PREVODILAC", "", 0.05),
    "SMALL": (":free", "", "POLISH", 0.0), "STANDARD": ("-embed", "", "", 0.0), "PROMO": ("-gemma-4", "POLISH", "", 0.15),
}
ROLES = ["LEKTOR", "PREVODILAC", "POLISH"]
_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_OWNER = f"{_LIST}[key % {len(NAMES)} + 1]"
_PROVIDERS = "(VALUES " + ", ".join(f"('{p}', {m}, {d}, {t})" for p, m, d, t in fleet.PROVIDERS) + ") AS pr(provider, provider_rpm, rpd, tier)"
_KINDS = "(VALUES " + ", ".join(f"('{k}', '{e}', '{g}', '{a}', {b}::DOUBLE)" for k, (e, g, a, b) in KINDS.items()) + ") AS ki(p_type, ending, prefers, avoids, bonus)"
MODELS_CTE = f"""mo AS (SELECT p_partkey AS model_id, provider, lower(provider) || '-' || replace(p_name, ' ', '-') || '-' || p_size || 'b' || ending AS model, p_size AS rpm, rpd, tier,
  prefers, avoids, bonus, role FROM (SELECT *, {_LIST}[regexp_extract(p_brand, '[0-9]+')::INT % {len(NAMES)} + 1] AS provider FROM part) JOIN {_PROVIDERS} USING (provider) JOIN {_KINDS} USING (p_type), (SELECT unnest({ROLES}) AS role))"""
SCORE_SQL = "(CASE WHEN avoids = role THEN -1.0::DOUBLE ELSE CASE WHEN prefers = role THEN .4::DOUBLE ELSE 0 END + bonus + .25::DOUBLE * least(rpm / 30, 1) + greatest(0, (4 - tier) * .04::DOUBLE) END)"


def _place(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def owner(key: Column) -> Column:
    """The provider that a key belongs to."""
    return _place(NAMES, key % len(NAMES))


def models(spark: SparkSession, folder: str) -> DataFrame:
    """model_id, provider, model, rpm, rpd, tier, prefers, avoids, bonus and role: a row for each role."""
    at = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") % len(NAMES)
    kind = lambda i: F.coalesce(*(F.when(F.col("p_type") == k, F.lit(v[i])) for k, v in KINDS.items()))
    of = lambda i: _place([p[i] for p in fleet.PROVIDERS], at)
    name = F.concat(F.lower(of(0)), F.lit("-"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"), F.lit("b"), kind(0))
    return table(spark, folder, "part").where(F.col("p_type").isin(*KINDS)).select(
        F.col("p_partkey").alias("model_id"), of(0).alias("provider"), name.alias("model"), F.col("p_size").alias("rpm"), of(2).alias("rpd"), of(3).alias("tier"),
        kind(1).alias("prefers"), kind(2).alias("avoids"), kind(3).alias("bonus"), F.explode(F.array(*map(F.lit, ROLES))).alias("role"),
    )


def model_fitness() -> Column:
    return fleet.model_score(F.col("avoids") == F.col("role"), F.col("prefers") == F.col("role"), F.col("bonus"), F.col("rpm"), F.col("tier"))
