from pyspark.sql import functions as F

from tessera.streaming.results import BlockSink, run_blocks


def _model(rows):
    return rows.select("stem", "file", "block", F.upper("text").alias("text"), F.length("text").alias("score"))


def _source(spark, path, parts=4):
    rows = [(f"f{i % 3}_blok_{i}", f"f{i % 3}", i, f"text {i}") for i in range(48)]
    for p in range(parts):
        # A block may come again, in the same file or a later one.
        mine = rows[p * 12 : p * 12 + 12] + rows[:2] + rows[p * 12 : p * 12 + 1]
        spark.createDataFrame(mine, "stem string, file string, block int, text string").coalesce(1).write.parquet(f"{path}/{p}")
    return spark.readStream.schema("stem string, file string, block int, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path), rows


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    stream, rows = _source(spark, str(tmp_path / "in"))
    plain = BlockSink(str(tmp_path / "plain"), _model)
    run_blocks(stream, plain, str(tmp_path / "plain_ck"))

    class Dies(BlockSink):
        """Stops once, after batch 2 was written and before it was committed."""

        died = False

        def __call__(self, batch, batch_id):
            super().__call__(batch, batch_id)
            if batch_id == 2 and not Dies.died:
                Dies.died = True
                raise RuntimeError("killed")

    sink = Dies(str(tmp_path / "killed"), _model)
    try:
        run_blocks(stream, sink, str(tmp_path / "killed_ck"))
        raise AssertionError("it should have stopped")
    except Exception as e:
        assert "killed" in str(e)
    assert sink.results(spark).count() == 36
    run_blocks(stream, sink, str(tmp_path / "killed_ck"))
    run_blocks(stream, sink, str(tmp_path / "killed_ck"))  # nothing is left to do
    columns = ["stem", "file", "block", "text", "score", "batch"]
    got, want = (sorted(map(tuple, s.results(spark).select(columns).collect())) for s in (sink, plain))
    assert got == want and [r[:4] for r in got] == sorted((s, f, b, t.upper()) for s, f, b, t in rows)
    assert sorted(map(tuple, sink.previews(spark).drop("made_at").collect())) == sorted(map(tuple, plain.previews(spark).drop("made_at").collect()))


def test_previews_come_every_ten_blocks_or_after_a_while(spark, tmp_path):
    batch = lambda at, n: spark.createDataFrame([(f"f_{i}", "f", i, f"t{i}") for i in range(at, at + n)], "stem string, file string, block int, text string")
    clock = [0]
    sink = BlockSink(str(tmp_path / "s"), _model, now=lambda: F.timestamp_seconds(F.lit(clock[0])))
    seen = []
    for number, (at, n, time) in enumerate([(0, 3, 0), (3, 4, 100), (7, 5, 200), (12, 1, 499), (13, 1, 500), (14, 0, 9000)]):
        clock[0] = time
        sink(batch(at, n) if n else batch(0, 1).limit(0), number)
        seen.append(sink.previews(spark).head()["n_blocks"])
    # At once; four are too few; nine are too few; ten; one more is too early, and is shown after a while.
    assert seen == [3, 3, 3, 13, 13, 14]
    clock[0] = 9301
    sink(batch(14, 1), 6)
    assert sink.previews(spark).head()["n_blocks"] == 15 and sink.previews(spark).head()["text"].startswith("T0\nT1\nT2")
