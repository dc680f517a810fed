"""URL filter: a tree of path templates for each host, judged by smoothed labelled purity.

1.  Fixed rules come first: the longest rule whose host is the url's host or a
    parent domain and whose path begins the url's path.
2.  Otherwise the path is generalised segment by segment: numbers, hexadecimal
    ids and long mixed segments become wildcards at once.  Then, level by
    level, a node of the tree with more than ``FANOUT`` different children
    gets one wildcard child instead.
3.  Branches of a node that differ in one segment and are statistically alike
    (each one's bad rate within ``ALIKE`` standard errors of their pooled rate)
    are merged; others stay apart.
4.  A template's purity is the share of bad labels among its labelled pages,
    smoothed towards its host's, which is smoothed towards the overall share.
    A template is blocked if the odds of a bad page are ``LIFT`` times the
    overall odds or more.  Without labels all purities are alike and nothing is
    blocked.

The tree is built on counts by host and path shape, which partial sums shrink
before any shuffle; a hot host is a few rows there.  Pages meet their template
by a join on host and shape.

A null url, or one without ``://``, has an empty host and path and is judged as
such.  Null labels count as none.  Repeated rows count as often as they occur.
Paths of any depth are handled; levels that no host can change are left out.  A
fan of exactly ``FANOUT`` stays.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, written

#: Rules as (verdict, host, path) (fixed values).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
FANOUT = 20
ALIKE = 2.0
STRENGTH = 10.0
LIFT = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does."""
    name, verdict = None, None
    for kind, of, begin in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(begin)
        name = F.when(fits, F.lit(of + begin)) if name is None else name.when(fits, F.lit(of + begin))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    none = F.lit(None).cast("string")
    return none if name is None else name, none if verdict is None else verdict


def shape_of(path: Column) -> Column:
    """Segments of a path, with those that plainly vary replaced by wildcards; an extension stays."""

    def one(x: Column) -> Column:
        stem, ext = F.regexp_extract(x, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(x, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        varies = stem.rlike(r"^[0-9]+$") | stem.rlike(r"^[0-9a-fA-F-]*[0-9][0-9a-fA-F-]{7,}$") | ((F.length(stem) > 24) & stem.rlike("[0-9]"))
        return F.when(varies, F.concat(F.lit("*"), ext)).otherwise(x)

    return F.transform(F.split(path, "/"), one)


def _node(upto: int) -> Column:
    """The first ``upto`` segments of a template as one string."""
    return F.array_join(F.slice("template", 1, upto), "/")


def _levels(t: DataFrame) -> tuple[int, int]:
    """Up to which level any node of the shapes can have too many children, and any two branches can be merged."""
    sizes = t.groupBy("host", F.size("shape").alias("size")).agg(F.count("*").alias("c"))
    reach = sizes.withColumn("r", F.sum("c").over(Window.partitionBy("host").orderBy(F.desc("size"))))  # shapes of that size or more
    found = reach.agg(F.max(F.when(F.col("r") > FANOUT, F.col("size"))).alias("wide"), F.max(F.when(F.col("c") > 1, F.col("size"))).alias("alike")).first()
    return found["wide"] or 0, found["alike"] or 0


def build_templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template, purity, lift) from ``pages`` (host, shape, good, bad): counts by host and shape."""
    t = written(pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("template", F.col("shape")), "shapes")
    wide_depth, alike_depth = _levels(t)
    wild = lambda level: F.transform("template", lambda x, k: F.when(k == level, F.lit("*")).otherwise(x))
    for level in range(1, wide_depth):  # the segment before the first slash is empty
        child = F.get("template", F.lit(level))
        keyed = t.withColumns({"_node": _node(level), "_child": child})
        wide = keyed.filter("_child is not null").select("host", "_node", "_child").distinct().groupBy("host", "_node").agg(F.count("*").alias("_fan"))
        t = keyed.join(wide, ["host", "_node"], "left").withColumn("template", F.when(F.col("_fan") > FANOUT, wild(level)).otherwise(F.col("template"))).drop("_node", "_child", "_fan")
        t = written(t, "grown")  # each level is written, so that plans stay short whatever the depth
    for level in range(1, alike_depth):
        rest = F.array_join(wild(level), "/")
        keyed = t.withColumns({"_rest": F.concat(F.size("template").cast("string"), F.lit(":"), rest), "_child": F.get("template", F.lit(level))})
        branch = keyed.filter("_child is not null").groupBy("host", "_rest", "_child").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        pooled = branch.groupBy("host", "_rest").agg((F.sum("b") / F.greatest(F.sum(F.col("g") + F.col("b")), F.lit(1))).alias("p"), F.count("*").alias("c"))
        both = branch.join(pooled, ["host", "_rest"]).withColumn("m", F.col("g") + F.col("b"))
        # A rule of succession keeps the error above 0 where all labels agree.
        error = F.sqrt(F.greatest(F.col("p") * (1 - F.col("p")), F.lit(0.01)) / F.greatest(F.col("m"), F.lit(1)))
        alike = (F.col("m") == 0) | (F.abs(F.col("b") / F.greatest(F.col("m"), F.lit(1)) - F.col("p")) <= ALIKE * error)
        merge = both.filter((F.col("c") > 1) & alike).select("host", "_rest", "_child", F.lit(True).alias("_merge"))
        t = keyed.join(merge, ["host", "_rest", "_child"], "left").withColumn("template", F.when(F.col("_merge"), wild(level)).otherwise(F.col("template"))).drop("_rest", "_child", "_merge")
        t = written(t, "merged")
    sums = t.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hosts = sums.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb"))
    total = sums.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("g"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b")).first()
    overall = (total["b"] + 1) / (total["g"] + total["b"] + 2)
    of_host = (F.col("hb") + STRENGTH * overall) / (F.col("hg") + F.col("hb") + STRENGTH)
    purity = (F.col("bad") + STRENGTH * of_host) / (F.col("good") + F.col("bad") + STRENGTH)
    judged = sums.join(hosts, "host").select("host", "template", purity.alias("purity"))
    judged = judged.withColumn("lift", F.col("purity") * (1 - overall) / ((1 - F.col("purity")) * overall))  # purity is under 1, as overall is
    return written(t.select("host", "shape", "template").join(judged, ["host", "template"]).select("host", "shape", F.array_join("template", "/").alias("template"), "purity", "lift"), "templates")


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity and lift for each row of ``pages`` (page_id, url).

    ``labels`` has page_id and bad (boolean); several labels of a page all count.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = written(split.withColumn("shape", shape_of(F.col("path"))), "split")
    of_page = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(1)).alias("good"))
    counted = split.join(of_page, "page_id", "left").select("host", "shape", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("good", "bad")])
    templates = build_templates(counted)
    both = split.join(small(templates, most=100_000), ["host", "shape"], "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lift") >= LIFT, F.lit("block")).otherwise(F.lit("allow"))
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("purity", 6).alias("purity"), F.round("lift", 6).alias("lift"))


def labels_by_path(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Page labels from document labels: the first number in a url's path names the document; bad: not good, or toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1)
    named = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id")).filter("doc_id is not null")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    return named.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
