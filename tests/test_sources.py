import zipfile

from tessera.sources import books
from tessera.streaming import calls


def test_epub_chapters_follow_the_spine(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.epub", "w") as z:
        z.writestr("OEBPS/b.opf", '<manifest><item id="x" href="one.html"/><item id="y" href="two.html"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine>')
        z.writestr("OEBPS/one.html", "<html><body><h1>One</h1><p>first</p><script>no()</script></body></html>")
        z.writestr("OEBPS/two.html", "<html><head><title>Two</title></head><body><p>second</p></body></html>")
        z.writestr("OEBPS/empty.html", "<html><body></body></html>")
    (tmp_path / "b (LIVE).epub").write_bytes(b"")
    (tmp_path / "c.mobi").write_bytes(b"x")
    rows = books.read_chapters(spark, str(tmp_path / "a.epub")).orderBy("position").collect()
    assert [(r["title"], r["plain"]) for r in rows] == [("Two", "second"), ("One", "One first")]
    assert sorted(r["name"] for r in books.list_books(spark, str(tmp_path)).collect()) == ["a.epub", "c.mobi"]


def test_checkpoints_and_scores(spark, tmp_path):
    (tmp_path / "ch.html_blok_3.lektura.chk").write_text('{"tekst": "dovoljno dug tekst"}')
    (tmp_path / "ch.html_blok_4.chk").write_text("<p>korigirani tekst ovdje</p>")
    (tmp_path / "ch.html_blok_5.chk").write_text("obican dug tekst bloka")
    rows = books.read_checkpoints(spark, str(tmp_path)).orderBy("block").collect()
    assert [(r["file"], r["block"], r["stage"], r["text"]) for r in rows] == [("ch.html", 3, "lektura", "dovoljno dug tekst"), ("ch.html", 5, "final", "obican dug tekst bloka")]
    (tmp_path / "s.json").write_text('{"a": 7.4, "b": {"score": 3}, "c": {}}')
    got = {r["stem"]: r["score"] for r in books.read_scores(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"a": 7.4, "b": 3.0, "c": None}


def test_replacements_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("Bob", "Robert"), ("Bobby", "Robert"), ("x", "x")], "variant string, canonical string")
    books.write_replacements(pairs, str(tmp_path / "r"))
    assert {tuple(r) for r in books.read_replacements(spark, str(tmp_path / "r")).collect()} == {("Bob", "Robert"), ("Bobby", "Robert")}


def test_stream_equals_batch(spark, tmp_path):
    schema = "provider string, key string, ts timestamp, code int"
    rows = spark.sql("SELECT concat('p', id % 3) AS provider, concat('k', id % 5) AS key, timestamp_seconds(1700000000 + id * 4000) AS ts, CAST(IF(id % 4 = 0, 500, 200) AS int) AS code FROM range(300)")
    # An event far behind the others closes all windows.
    closing = spark.sql("SELECT 'end' AS provider, 'end' AS key, timestamp_seconds(1800000000) AS ts, 200 AS code")
    rows.unionByName(closing).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    calls.run_to_table(calls.windowed_health(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = {tuple(r) for r in calls.windowed_health(rows).collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
