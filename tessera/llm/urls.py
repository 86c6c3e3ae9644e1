"""URL filters by a path-template tree per host. DataFrame functions only.

Distinct (host, path) pairs carry their row counts and labels. Level by level, each node (host,
prefix) of the tree counts its children; digits within a segment, and all segments below a node
with many, mostly rare children, become wildcards. The tree grows until no node that could still
get a wildcard has a further segment. Templates are the leaves. Labelled urls give
each template, branch (first segment) and host a rate of bad urls. Labels may be all of one kind on
a host, as those of block rules are; so a url without a label counts as a small part, UNLABELLED, of
a good one, and templates that no bad url was seen of are told from those that have many. Branches whose rate does not
differ from their host's by a two-sided test merge into one; the smoothed purity of a template
shrinks to its branch, the branch to the host, the host to all labelled urls. A template of purity
REJECT or more is blocked. Rules given as text decide first: the longest that fits wins.

Counts are aggregated before they are joined, so a hot host is no hot task; all joins are on (host,
path) or (host, prefix) and left to Spark, which splits skewed sides. Null urls and urls without
`://` have an empty host and path and take part as such. Repeated urls count once each time. An
empty table gives no rows; without labels every template has the prior, one half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._spark import materialise

LEVELS = 3  # of the SQL beside, which equals the tree on paths of so many segments
MIN_CHILDREN = 8
RARE_SHARE = 0.3
MIN_LABELLED = 5
UNLABELLED = 1 / 16  # what a url without a label counts as a good one
Z = 1.96
STRENGTH = 8.0
REJECT = 0.8
# (verdict, host, path)
Rule = tuple[str, str, str]


def parse(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    at = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(at(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), at(2)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def templates(paths: DataFrame) -> DataFrame:
    """Adds branch and template to distinct (host, path) rows with a count `n`."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    out = paths.withColumn("_segments", F.transform(segments, lambda s: F.regexp_replace(s, "[0-9]+", "*"))).withColumn("_prefix", F.lit(""))
    done, level = None, 0
    while True:
        out = out.withColumn("_segment", F.get("_segments", F.lit(level)))
        children = out.where(F.col("_segment").isNotNull()).groupBy("host", "_prefix", "_segment").agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        nodes = (
            children.groupBy("host", "_prefix")
            .agg(F.count("*").alias("_children"), F.sum("n").alias("_rows"), F.sum("paths").alias("_paths"))
            .select(
                "host", "_prefix",
                ((F.col("_children") >= MIN_CHILDREN) & (F.col("_children") >= RARE_SHARE * F.col("_rows"))).alias("_wild"),
                (F.col("_paths") < MIN_CHILDREN).alias("_few"),
            )
        )
        step = F.when(F.col("_segment").isNull(), "").when(F.col("_wild"), "/*").otherwise(F.concat(F.lit("/"), "_segment"))
        out = out.join(nodes, ["host", "_prefix"], "left").withColumn("_step", F.concat("_prefix", step))
        if level == 0:
            out = out.withColumn("branch", F.col("_step"))
        level += 1
        # Below a node of few paths no node has enough children for a wildcard: its paths stay as they are.
        rest = F.when(F.col("_few"), F.array_join(F.transform(F.slice("_segments", level + 1, 1 << 30), lambda s: F.concat(F.lit("/"), s)), "")).otherwise("")
        ended = F.coalesce("_few", F.lit(False)) | (F.size("_segments") <= level)
        out = out.withColumn("_prefix", F.concat("_step", rest)).withColumn("_ended", ended).drop("_wild", "_few", "_step", "_segment")
        out = materialise(out, f"level{level}")
        part = out.where("_ended").withColumn("template", F.col("_prefix")).drop("_segments", "_prefix", "_ended")
        done = part if done is None else done.union(part)
        out = out.where("NOT _ended").drop("_ended")
        if not out.limit(1).count():
            return done


def purities(tree: DataFrame) -> DataFrame:
    """host, branch, template and purity: the smoothed share of bad among labelled urls."""
    shrink = lambda bad, n, to: (bad + STRENGTH * to) / (n + STRENGTH)
    add = lambda: (F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    leaves = materialise(tree.groupBy("host", "branch", "template").agg(*add()), "leaves")
    branches = leaves.groupBy("host", "branch").agg(*add())
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    everything = leaves.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("labelled"), F.lit(0)) + 2)).alias("_prior"))
    rate = F.try_divide("host_bad", "host_labelled")
    differs = (F.col("labelled") >= MIN_LABELLED) & (F.abs(F.try_divide("bad", "labelled") - rate) > Z * F.sqrt(F.try_divide(rate * (1 - rate), F.col("labelled"))))
    marked = branches.join(hosts, "host").withColumn("merged", F.when(F.coalesce(differs, F.lit(False)), F.col("branch")).otherwise("~"))
    marked = materialise(marked, "branches")
    pooled = marked.groupBy("host", "merged").agg(F.sum("labelled").alias("pool_labelled"), F.sum("bad").alias("pool_bad"))
    out = leaves.join(marked.select("host", "branch", "merged", "host_labelled", "host_bad"), ["host", "branch"]).join(pooled, ["host", "merged"])
    out = out.crossJoin(F.broadcast(everything))  # one row
    host_rate = shrink(F.col("host_bad"), F.col("host_labelled"), F.col("_prior"))
    branch_rate = shrink(F.col("pool_bad"), F.col("pool_labelled"), host_rate)
    return out.select("host", "branch", "template", "merged", shrink(F.col("bad"), F.col("labelled"), branch_rate).alias("purity"))


def judge_urls(pages: DataFrame, rules: list[Rule], label: Column | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, template, purity and verdict of every row. `label` is true for bad
    urls, false for good and null for unlabelled ones; by default the rules label what they cover."""
    host, path = parse(F.col(url_column).cast("string"))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(None).cast("boolean") if label is None else label).alias("_label"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text).withColumn("_ruled", verdict)
    if label is None:
        rows = rows.withColumn("_label", F.col("_ruled") == "block")
    labelled = F.count("_label") + UNLABELLED * (F.count("*") - F.count("_label"))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), labelled.alias("labelled"), F.count_if(F.coalesce("_label", F.lit(False))).alias("bad"))
    tree = templates(materialise(paths, "paths"))
    judged = tree.select("host", "path", "branch", "template").join(purities(tree), ["host", "branch", "template"])
    out = rows.join(judged.drop("branch", "merged"), ["host", "path"], "left")
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", method).alias("verdict"), "template", "purity")
