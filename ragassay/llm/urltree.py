"""URL filter: a tree of path templates per host, judged by labelled purity.

From the root on, the children of a node get the names that their templates carry:

* Children that differ by their digits only, two of them at least, share one name with `*`
  for each run of digits.
* Of the other children those with few different paths below them are rare. FAN_OUT rare
  children or more are one wildcard; children with more paths keep their own names, so
  that a large section beside them changes nothing.

What counts are different paths, not pages: captures and queries that come again do not
change the tree. Children with one name are one node, whose own children are named
together. There is no depth limit: stretches that all paths of a node share are passed at
once, and the tree ends where paths no longer part.

Templates with one parent are merged with their siblings if their share of bad labels does
not differ from the parent's by more than two standard errors. A template is rejected if
its smoothed share of bad labels, drawn towards its host's and the corpus's share, is above
one half. Host and path rules go before the tree. All is done by column functions and
aggregates over the different paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragassay.llm.common import durable, lower_ascii, sorted_join

#: siblings that differ by digits only and become one
SAME_BUT_DIGITS = 2
#: a child with so many different paths or fewer is rare; so many rare children are one wildcard
RARE, FAN_OUT = 2, 8
#: labels that the shares of the corpus and of the host count for
CORPUS_WEIGHT, HOST_WEIGHT = 10.0, 5.0

#: (host, start of the path, verdict)
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Add host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("host", lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    )


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def _shared(lo: Column, hi: Column) -> Column:
    """How many segments the smallest and the largest of some arrays have in common, and so all."""
    differ = F.array_position(F.zip_with(lo, hi, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(lo), F.size(hi))).cast("int")


def templates(paths: DataFrame) -> DataFrame:
    """Add the template to different paths (host, segments and further columns)."""
    kept = paths.columns
    rows = durable(paths.withColumn("done", F.lit(0)).withColumn("template", F.lit("")))
    finished = [rows.filter(F.size("segments") == 0).select(*kept, "template")]
    rows = rows.filter(F.size("segments") > 0)
    node = ["host", "template"]
    while not rows.isEmpty():
        rest = F.slice("segments", F.col("done") + 1, F.size("segments"))
        common = durable(
            rows.withColumn("rest", rest).groupBy(*node)
            .agg(_shared(F.min("rest"), F.max("rest")).alias("common"))
        )
        passed = F.slice("segments", F.col("done") + 1, F.col("common"))
        rows = sorted_join(rows, common, node).select(
            *kept,
            (F.col("done") + F.col("common")).alias("done"),
            F.concat_ws("/", F.array("template"), passed).alias("template"),
        )
        rows = durable(rows.withColumn("own", F.get("segments", F.col("done"))))
        finished.append(rows.filter("own IS NULL").select(*kept, "template"))
        rows = rows.filter("own IS NOT NULL").withColumn("mask", F.regexp_replace("own", "[0-9]+", "*"))
        alike = (
            rows.filter("mask <> own").select(*node, "mask", "own").distinct()
            .groupBy(*node, "mask").agg(F.count(F.lit(1)).alias("alike"))
            .filter(F.col("alike") >= SAME_BUT_DIGITS)
        )
        rows = sorted_join(rows, durable(alike), [*node, "mask"], "left")
        merged = F.col("alike").isNotNull()
        rows = durable(
            rows.select(
                *kept, "done", "template", merged.alias("merged"),
                F.when(merged, F.col("mask")).otherwise(F.col("own")).alias("child"),
            )
        )
        children = rows.groupBy(*node, "child", "merged").agg(F.count(F.lit(1)).alias("paths"))
        rare = durable(children.filter(~F.col("merged") & (F.col("paths") <= RARE)).select(*node, "child", "merged"))
        wide = rare.groupBy(*node).agg(F.count(F.lit(1)).alias("rare")).filter(F.col("rare") >= FAN_OUT)
        wild = sorted_join(rare, durable(wide), node).select(*node, "child", "merged", F.lit("*").alias("wild"))
        rows = sorted_join(rows, durable(wild), [*node, "child", "merged"], "left").select(
            *kept,
            (F.col("done") + 1).alias("done"),
            F.concat("template", F.lit("/"), F.coalesce("wild", "child")).alias("template"),
        )
        rows = durable(rows)
        finished.append(rows.filter(F.size("segments") == F.col("done")).select(*kept, "template"))
        rows = rows.filter(F.size("segments") > F.col("done"))
    return reduce(DataFrame.union, finished)


def judged_templates(pages: DataFrame) -> DataFrame:
    """host, key, template, says (allow or block) for each different path.

    pages: host, key (the path), segments, bad (0, 1 or null without label).
    """
    raw = pages.groupBy("host", "key", "segments").agg(
        F.count("bad").alias("labelled"), F.sum("bad").alias("bad")
    )
    tree = templates(raw.fillna(0, ["bad"]))
    tree = durable(tree.withColumn("parent", F.regexp_replace("template", "/[^/]*$", "")))

    def sums(*keys: str) -> DataFrame:
        of = tree if keys != ("host", "branch") else merged
        return durable(of.groupBy(*keys).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")))

    own = sums("host", "parent", "template").withColumnsRenamed({"l": "tl", "b": "tb"})
    over = sums("host", "parent").withColumnsRenamed({"l": "pl", "b": "pb"})
    share = F.when(F.col("pl") > 0, F.col("pb") / F.col("pl")).otherwise(F.lit(0.0))
    off = F.abs(F.col("tb") - F.col("tl") * share)
    # the error squared, so that both sides are exact to the last bit on any engine
    alike = off * off <= F.col("tl") * share * (1 - share) * 4
    branches = sorted_join(own, over, ["host", "parent"]).select(
        "host",
        "template",
        "parent",
        F.when(alike, F.concat("parent", F.lit("/~"))).otherwise(F.col("template")).alias("branch"),
    )
    merged = durable(sorted_join(tree, durable(branches), ["host", "parent", "template"]))
    total = tree.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).first()
    corpus = float(total["b"] or 0) / float(total["l"]) if total["l"] else 0.0
    hosts = sums("host").select(
        "host",
        ((F.col("b") + F.lit(CORPUS_WEIGHT * corpus)) / (F.col("l") + F.lit(CORPUS_WEIGHT))).alias("prior"),
    )
    scored = sorted_join(sums("host", "branch"), hosts, "host").select(
        "host",
        "branch",
        ((F.col("b") + F.lit(HOST_WEIGHT) * F.col("prior")) / (F.col("l") + F.lit(HOST_WEIGHT))).alias("impurity"),
    )
    return sorted_join(merged, durable(scored), ["host", "branch"]).select(
        "host", "key", "template", F.when(F.col("impurity") > 0.5, "block").otherwise("allow").alias("says")
    )


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """page_id, host, path, rule, verdict, template for every row of pages.

    labels: doc_id and quality (0 is bad). A page shows the document whose number is the
    first number of its path, and has its label; numbers above 18 digits are none, nor
    are null labels or labels that differ between rows of a doc_id. A null url, or one
    without ://, has empty host and path and is judged with others of that kind. Repeated
    rows are judged as often as they come. An empty table gives an empty result, an
    empty label table allows all that no rule blocks; further columns are not read.
    Rules are a list in the program and become part of the expression.
    """
    rows = with_host_and_path(pages.select("page_id", F.col("url").cast("string").alias("url")))
    number = F.regexp_extract("path", "[0-9]+", 0)
    number = F.when(F.length(number).between(1, 18), number).cast("bigint")
    parts = segments(F.col("path"))
    rows = rows.select(
        "page_id", "host", "path", number.alias("number"), parts.alias("segments"), F.array_join(parts, "/").alias("key")
    )
    marks = (
        labels.filter("quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("bigint").alias("number"))
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
        .select("number", (1 - F.col("low")).cast("bigint").alias("bad"))
    )
    marked = sorted_join(rows.select("host", "key", "segments", "number"), durable(marks), "number", "left")
    found = durable(judged_templates(marked.drop("number")))
    rule, verdict = rule_of(rules)
    return (
        sorted_join(rows, found, ["host", "key"], "left")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "says").alias("verdict"), "template")
    )
