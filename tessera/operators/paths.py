"""Which file of a folder holds a block, when names have been changed on the way.

A block is known as `{file}_blok_{n}`, with or without an ending of a page's name. In order: the file
of just that name; without the ending before `_blok_`; with `.htm_` and `.html_` as `_`; without the
ending and what follows it; one of the same number whose name holds that of the page; any one of
the same number. All keys of a block meet those of its folder's files in one join, and the least rank wins, then the least name.
Nulls and blocks without any file have none. Names are without `.chk`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDING = r"(?i)\.(x?html?)"
NUMBER = r"_blok_(\d+)$"
HOLDS_NAME, SAME_NUMBER = 5, 6


def _keys(stem: Column) -> Column:
    """Array of (rank, key) by which a block may be found."""
    named = [stem, F.regexp_replace(stem, ENDING + "(_blok_)", "$2"), F.replace(F.replace(stem, F.lit(".htm_"), F.lit("_")), F.lit(".html_"), F.lit("_")), F.ltrim(F.regexp_replace(stem, ENDING + "(_.+)?$", "$2"), F.lit("_"))]
    by_name = [F.struct(F.lit(i).alias("rank"), F.concat(F.lit("="), k).alias("key")) for i, k in enumerate(named, 1)]
    number = F.regexp_extract(stem, NUMBER, 1)
    by_number = F.when(number != "", F.struct(F.lit(SAME_NUMBER).alias("rank"), F.concat(F.lit("#"), number).alias("key")))
    return F.array_compact(F.array(*by_name, by_number))


def resolved(stems: DataFrame, files: DataFrame) -> DataFrame:
    """folder, stem, name (of its file, or null) and rank. stems: folder, stem; files: folder, name."""
    base = F.regexp_replace(F.split_part("stem", F.lit("_blok_"), F.lit(1)), ENDING + "$", "")
    asked = stems.select("folder", "stem").distinct()
    keyed = asked.select("folder", "stem", base.alias("base"), F.inline(_keys(F.col("stem"))))
    number = F.regexp_extract("name", NUMBER, 1)
    held = files.select("folder", "name").distinct().select("folder", "name", F.explode(F.array_compact(F.array(F.concat(F.lit("="), "name"), F.when(number != "", F.concat(F.lit("#"), number))))).alias("key"))
    found = keyed.join(held, ["folder", "key"])
    rank = F.when((F.col("rank") == SAME_NUMBER) & F.split_part("name", F.lit("_blok_"), F.lit(1)).contains(F.col("base")), HOLDS_NAME).otherwise(F.col("rank"))
    best = found.withColumn("rank", rank).groupBy("folder", "stem").agg(F.min(F.struct("rank", "name")).alias("best"))
    return asked.join(best, ["folder", "stem"], "left").select("folder", "stem", "best.name", "best.rank")
