import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tessera.operators import pages as P


def _nodes(spark, html):
    row = spark.createDataFrame([(html,)], "html string").select(P.nodes_of(F.col("html")).alias("n")).head()
    return [(r["html"], r["words"]) for r in row["n"]]


def test_nodes(spark):
    cases = {
        "<p>one two</p><p>three</p>": ["<p>one two</p>", "<p>three</p>"],
        "bare text <b>x</b> tail": ["bare text ", "<b>x</b>", " tail"],
        "<ul><li>a<li>b <ul><li>c</ul></ul><p>d</p>": ["<ul><li>a<li>b <ul><li>c</ul></ul>", "<p>d</p>"],
        "a<br>b<img src='x'/><hr>c": ["a", "<br>", "b", "<img src='x'/>", "<hr>", "c"],
        "<div><p>open</div><p>x</p>": ["<div><p>open</div>", "<p>x</p>"],
        "<p>never closed <b>x</b> <p>more": ["<p>never closed <b>x</b> <p>more"],
        "</p>stray<DIV>x</div >": ["</p>", "stray", "<DIV>x</div >"],
        "<script>if (a < b) { x('</p>') }</script><!-- <p> --><p>y</p>": ["<script>if (a < b) { x('</p>') }</script>", "<!-- <p> -->", "<p>y</p>"],
        "<html><head><title>t</title></head><body class='x'>\n<p>a</p></body></html>": ["\n", "<p>a</p>"],
        "": [],
    }
    for html, want in cases.items():
        assert [h for h, _ in _nodes(spark, html)] == want, html
    assert _nodes(spark, "<p>one <b>two</b>three four</p><style>p { a: b }</style><!-- c d -->") == [("<p>one <b>two</b>three four</p>", 3), ("<style>p { a: b }</style>", 0), ("<!-- c d -->", 0)]


def test_blocks(spark):
    words = lambda n: " ".join("w" * n)
    html = f"<p>{words(3)}</p><hr><p>{words(3)}</p>\n<p>{words(9)}</p><p>{words(1)}</p><br>"
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, " \n "), (5, "<hr>")], "page_id int, html string")
    got = [tuple(r) for r in P.page_blocks(rows, "page_id", most=5).orderBy("page_id", "block").collect()]
    assert [r[:3] for r in got] == [(1, 0, 3), (1, 1, 3), (1, 2, 9), (1, 3, 1), (5, 0, 0)]
    assert "".join(r[3] for r in got if r[0] == 1) == html and got[0][3].endswith("<hr>")


class _Plain(HTMLParser):
    """Starts of nodes, with a stack of open tags."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.stack, self.starts, self.silent = [], [], None
        lines = html.split("\n")
        self.before = [0]
        for x in lines:
            self.before.append(self.before[-1] + len(x) + 1)
        self.feed(html)
        self.close()

    def mark(self):
        line, column = self.getpos()
        if not self.stack and not self.silent:
            self.starts.append(self.before[line - 1] + column)

    def handle_starttag(self, tag, attrs):
        self.mark()
        if tag in ("script", "style"):
            self.silent = tag
        elif tag not in P.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.mark()

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = None
            return
        self.mark()
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        self.mark()

    handle_comment = handle_decl = handle_pi = handle_data


def test_given_pages_equal_a_parser_with_a_stack(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    for r in pages.withColumn("n", P.nodes_of(F.col("html"))).collect():
        inner = re.search(r"(?is)<body\b[^>]*>(.*)</body\s*>", r["html"])
        text = inner[1] if inner else r["html"]
        if "&" in text:  # the parser hands references over apart
            text = text.replace("&", "+")
        starts, at = [], 0
        for n in r["n"]:
            starts.append(at)
            at += len(n["html"])
        assert starts == _Plain(text).starts and at == len(text)
