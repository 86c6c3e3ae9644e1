"""Blocks through a model, each exactly once, and previews of the texts as they grow.

A sink for `foreachBatch`. What a batch makes goes to a folder of its number, which a replay of the batch
writes again; blocks that an earlier batch has made are skipped. So a batch that ran before a
crash, and runs again after it, changes nothing, whether or not it had been written. Results of a
batch are there as soon as it ends: nothing waits to be flushed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

Model = Callable[[DataFrame], DataFrame]


class BlockSink:
    """stem names a block, file and block its place; `model` adds columns, `text` among them, to rows with these columns.

    A file's preview is made anew when `every` blocks have come since the last one, or any and `seconds` have passed."""

    def __init__(self, path: str, model: Model, every: int = 10, seconds: int = 300, now: Callable[[], Column] = F.current_timestamp):
        self.path, self.model, self.every, self.seconds, self.now = path.rstrip("/"), model, every, seconds, now

    def _read(self, spark: SparkSession, folder: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None  # nothing written yet
            raise

    def results(self, spark: SparkSession) -> DataFrame | None:
        """All results so far, one row per block."""
        return self._read(spark, "results")

    def previews(self, spark: SparkSession) -> DataFrame | None:
        """file, text, n_blocks and made_at of the newest preview of each file."""
        made = self._read(spark, "previews")
        if made is None:
            return None
        columns = [c for c in made.columns if c not in ("batch", "file")]
        return made.groupBy("file").agg(F.max_by(F.struct(*columns), "batch").alias("p")).select("file", "p.*")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh, before = batch.dropDuplicates(["stem"]), self.results(spark)
        if before is not None:
            fresh = fresh.join(before.where(F.col("batch") < batch_id).select("stem"), "stem", "left_anti")
        self.model(fresh).write.mode("overwrite").parquet(f"{self.path}/results/batch={batch_id}")
        self._preview(spark, batch_id)

    def _preview(self, spark: SparkSession, batch_id: int) -> None:
        results, old = self.results(spark), self._read(spark, "previews")
        if results is None:
            return
        have = results.where(F.col("batch") <= batch_id).groupBy("file").agg(F.count("*").alias("n_blocks"))
        last = None if old is None else old.where(F.col("batch") < batch_id).groupBy("file").agg(F.max("n_blocks").alias("shown"), F.max("made_at").alias("shown_at"))
        due = have.withColumn("shown", F.lit(0)).withColumn("shown_at", F.lit(None).cast("timestamp")) if last is None else have.join(last, "file", "left")
        more = F.col("n_blocks") - F.coalesce("shown", F.lit(0))
        waited = F.timestamp_diff("SECOND", F.col("shown_at"), self.now()) >= self.seconds
        due = due.where((more >= self.every) | ((more > 0) & (F.col("shown_at").isNull() | waited)))
        parts = results.where(F.col("batch") <= batch_id).join(due.select("file", "n_blocks"), "file").groupBy("file", "n_blocks")
        ordered = F.sort_array(F.collect_list(F.struct("block", "text"))).getField("text")
        made = parts.agg(F.array_join(ordered, "\n").alias("text")).withColumn("made_at", self.now())
        made.write.mode("overwrite").parquet(f"{self.path}/previews/batch={batch_id}")


def run_blocks(stream: DataFrame, sink: BlockSink, checkpoint: str) -> None:
    """Runs what is there through the model and stops; a rerun continues from the checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
