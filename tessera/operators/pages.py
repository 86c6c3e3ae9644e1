"""Pages as blocks of whole nodes: the children of the body, packed up to a number of words.

Tags are read in order with the stack of those that are open: an end tag closes the last one of its
name with all that opened after it, one without a start is passed over, void tags (and those that end in `/>`)
open nothing, and what nobody closes reaches to the end. A node is what stands between two moments
at which nothing is open; text outside of tags is a node too. Scripts, styles and comments are
one token each, without words. Null pages have no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|[^<]+|<"
SILENT = r"(?is)^<(script|style|!)"
START, END = r"(?s)^<([a-zA-Z][^\s/>]*)", r"(?s)^</\s*([a-zA-Z][^\s/>]*)"
# Tags that hold nothing.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]


def body_of(html: Column) -> Column:
    """What is inside the body, or all of a page without one."""
    inner = F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*)</body\s*>", 1)
    return F.when(html.rlike(r"(?is)<body\b[^>]*>.*</body\s*>"), inner).otherwise(html)


def _opens(token: Column) -> Column:
    """The name of the tag that a token opens, else empty."""
    name = F.lower(F.regexp_extract(token, START, 1))
    return F.when(token.rlike(SILENT) | name.isin(*VOID) | token.endswith("/>"), "").otherwise(name)


def node_starts(tokens: Column) -> Column:
    """Places (from 1) at which nodes start."""
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))

    def step(acc: Column, token: Column) -> Column:
        place = acc["at"] + 1
        opens, closes = _opens(token), F.lower(F.regexp_extract(token, END, 1))
        last = F.size(acc["open"]) - F.array_position(F.reverse(acc["open"]), closes).cast("int") + 1  # of the open ones of the name
        after = F.when(opens != "", F.array_append(acc["open"], opens)).when((closes != "") & F.array_contains(acc["open"], closes), F.slice(acc["open"], F.lit(1), last - 1)).otherwise(acc["open"])
        starts = F.when(F.size(acc["open"]) == 0, F.array_append(acc["starts"], place)).otherwise(acc["starts"])
        return F.struct(after.alias("open"), starts.alias("starts"), place.alias("at"))

    return F.aggregate(tokens, start, step, lambda acc: acc["starts"])


def words_of(tokens: Column) -> Column:
    """Number of words in the text of tokens: tags leave no gap."""
    text = F.array_join(F.filter(tokens, lambda t: ~t.startswith("<") | (t == "<")), "")
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def nodes_of(html: Column) -> Column:
    """Array of (html, words) of the nodes of a page."""

    def cut(x: Column) -> Column:
        tokens, starts = x["tokens"], x["starts"]
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(tokens) + 1))
        parts = F.zip_with(starts, ends, lambda a, b: F.slice(tokens, a, b - a))
        return F.transform(F.when(F.size(starts) > 0, parts).otherwise(F.array().cast("array<array<string>>")), lambda p: F.struct(F.array_join(p, "").alias("html"), words_of(p).alias("words")))

    tokens = F.array(F.regexp_extract_all(body_of(html), F.lit(TOKEN), F.lit(0)))
    with_starts = F.transform(tokens, lambda t: F.struct(t.alias("tokens"), node_starts(t).alias("starts")))
    return F.transform(with_starts, cut)[0]


def packed(nodes: Column, most: int) -> Column:
    """Array of (html, words): nodes in order, a new block before the one that would take a block that
    has words over `most`. A longer node stays whole; blocks of white space only go."""
    kind = "array<struct<html:array<string>,words:bigint>>"
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast(kind).alias("done"), none.alias("open"), F.lit(0).cast("long").alias("words"))

    def step(acc: Column, node: Column) -> Column:
        closes = (node["words"] > 0) & (acc["words"] > 0) & (acc["words"] + node["words"] > most)
        return F.struct(
            F.when(closes, F.array_append(acc["done"], F.struct(acc["open"].alias("html"), acc["words"].alias("words")))).otherwise(acc["done"]).alias("done"),
            F.when(closes, F.array(node["html"])).otherwise(F.array_append(acc["open"], node["html"])).alias("open"),
            F.when(closes, node["words"]).otherwise(acc["words"] + node["words"]).alias("words"),
        )

    def finish(acc: Column) -> Column:
        every = F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], F.struct(acc["open"].alias("html"), acc["words"].alias("words")))).otherwise(acc["done"])
        joined = F.transform(every, lambda b: F.struct(F.array_join(b["html"], "").alias("html"), b["words"].alias("words")))
        return F.filter(joined, lambda b: b["html"].rlike(r"\S"))

    return F.aggregate(nodes, start, step, finish)


def page_blocks(pages: DataFrame, key: str, html: str = "html", most: int = 800) -> DataFrame:
    """key, block (from 0), n_words and html of every block of every page."""
    made = pages.select(key, F.posexplode(packed(nodes_of(F.col(html)), most)).alias("block", "b"))
    return made.select(key, "block", F.col("b.words").alias("n_words"), F.col("b.html").alias("html"))
