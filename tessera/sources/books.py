"""Readers of EPUB books, checkpoint texts and score maps."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape
from posixpath import dirname, join, normpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

_CHAPTER = "book string, position int, file string, title string, html string, plain string"


def list_books(spark: SparkSession, folder: str) -> DataFrame:
    """path, name and size of books, without finished copies marked (LIVE)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{epub,mobi}").load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("size")).where(~F.col("name").contains("(LIVE)"))


def spine(opf: str, base: str) -> list[str]:
    """Chapter files in reading order; without a spine, in the order of the manifest."""
    items = {}
    for tag in re.findall(r"<item\b[^>]*>", opf):
        name, href, kind = (re.search(rf'\b{a}="([^"]*)"', tag) for a in ("id", "href", "media-type"))
        if name and href and (not kind or "html" in kind[1]):
            items[name[1]] = normpath(join(base, unescape(href[1])))
    order = [items[x] for x in re.findall(r'<itemref\b[^>]*\bidref="([^"]*)"', opf) if x in items]
    return order or list(items.values())


def members(content: bytes) -> list[tuple[str, str]]:
    """(file, html) of a book's chapters in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        read = lambda x: book.read(x).decode("utf-8", "replace")
        opf = next((n for n in names if n.endswith(".opf")), None)
        if opf is None and "META-INF/container.xml" in names:
            found = re.search(r'full-path="([^"]+)"', read("META-INF/container.xml"))
            opf = found[1] if found and found[1] in names else None
        order = spine(read(opf), dirname(opf)) if opf else []
        files = [f for f in order if f in names] or sorted(n for n in names if n.lower().endswith((".html", ".xhtml", ".htm")))
        return [(f, read(f)) for f in files]


def read_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """A row per chapter with text: book, position, file, title, html and plain text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(folder).select("path", "content")

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path.rsplit("/", 1)[-1], i, f, html) for i, (f, html) in enumerate(members(content))]
                yield pd.DataFrame(rows, columns=["book", "position", "file", "html"])

    pages = files.mapInPandas(open_, "book string, position int, file string, html string")
    title = F.coalesce(*(F.nullif(T.html_text(F.regexp_extract("html", f"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit("")) for t in ("title", "h1", "h2", "h3")), F.concat(F.lit("Poglavlje "), (F.col("position") + 1).cast("string")))
    body = F.coalesce(F.nullif(F.regexp_extract("html", "(?is)<body[^>]*>(.*)</body>", 1), F.lit("")), F.col("html"))
    return pages.select("book", "position", "file", title.alias("title"), "html", T.visible_text(body).alias("plain")).where("plain <> ''")


CHECKPOINT_KEYS = ["finalno_polirano", "korektura", "translated", "tekst", "text"]


def read_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """file, block, stage and text of saved blocks named {file}_blok_{n}[.stage].chk; JSON wrappers
    are taken off, empty and placeholder blocks left out."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.chk").option("recursiveFileLookup", True).text(folder).withColumn("path", F.input_file_name())
    name = r"([^/]+)_blok_(\d+)(?:\.(prevod|lektura))?\.chk$"
    out = files.select(
        F.regexp_extract("path", name, 1).alias("file"), F.regexp_extract("path", name, 2).try_cast("int").alias("block"),
        F.coalesce(F.nullif(F.regexp_extract("path", name, 3), F.lit("")), F.lit("final")).alias("stage"),
        T.unwrap_json(F.col("value"), CHECKPOINT_KEYS).alias("text"),
    )
    holder = F.trim(F.lower(T.no_tags(F.col("text")))).isin("lektorisani tekst ovdje", "korigirani tekst ovdje")
    return out.where((F.length("text") > 10) & ~holder & (F.col("file") != ""))


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """stem and score of score maps: {stem: number} or {stem: {"score": number}}."""
    files = spark.read.option("wholetext", True).text(folder)
    entries = files.select(F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e"))
    return entries.select(F.col("e.key").alias("stem"), F.coalesce(F.expr("try_cast(e.value AS double)"), F.get_json_object("e.value", "$.score").try_cast("double")).alias("score"))


def write_replacements(pairs: DataFrame, path: str) -> None:
    """One line `variant#->#canonical` a pair, longest variant first."""
    ordered = pairs.orderBy(F.desc(F.length("variant")), "variant")
    ordered.select(F.concat_ws("#->#", "variant", "canonical").alias("value")).write.mode("overwrite").text(path)


def read_replacements(spark: SparkSession, path: str) -> DataFrame:
    """variant and canonical of a replacement file; blank lines, comments and identities go."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#(?!->)|$)"))
    parts = F.split("value", r"\s*(?:#->#|→|->)\s*", 2)
    pairs = lines.select(F.trim(parts[0]).alias("variant"), F.trim(F.get(parts, F.lit(1))).alias("canonical"))
    return pairs.where("canonical <> '' AND variant <> canonical")
