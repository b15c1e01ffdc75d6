"""URL filter: explicit rules first, else a path-template tree per host.

Every path becomes typed segments: numbers (with or without a file ending) and long hexadecimal names are wildcards
at once. Level by level, as deep as enough paths go, a node whose children are mostly distinct literals has them
generalised to one wildcard.
The leaves are templates with the counts of labelled pages: a label is what a rule, or a table of labels, says of a
page. Sibling templates of one shape on one host whose share of blocked pages does not differ significantly from
the shape's are merged, and a template is rejected where its smoothed purity of blocked pages is high enough. All
tree work is done on counts per distinct typed path, aggregated before anything is shuffled. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER_TO_LOWER, broadcast_if_small, stored

#: The rules of the query: (rule, action). A rule is a host suffix and a path prefix.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

MIN_CHILDREN, MIN_DISTINCT_SHARE = 20, 0.5
Z, SMOOTHING, PRIOR, PURITY, MIN_LABELLED = 1.96, 2.0, 0.5, 0.9, 3
NUMBER, HEX = r"^[0-9]+(\.[a-z0-9]+)?$", r"^[0-9a-f]{8,}$"


def host_of(url: Column) -> Column:
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(at, *UPPER_TO_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    h, p = rule.split("/", 1)
    return ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)


def typed(path: Column) -> Column:
    """Segments of a path: '#' a number, '%' a long hexadecimal name, else '=' and the literal."""
    one = lambda s: F.when(s.rlike(NUMBER), F.lit("#")).when(s.rlike(HEX) & s.rlike("[0-9]"), F.lit("%")).otherwise(F.concat(F.lit("="), s))
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one)


def template_counts(paths: DataFrame) -> DataFrame:
    """paths: (host, segs, n, n_block, n_allow) by distinct typed path. Adds template and shape.

    The levels end where fewer than MIN_CHILDREN distinct paths go deeper, for then no node there has enough children.
    """
    out, k = paths.withColumn("prefix", F.lit("")).withColumn("shape", F.lit("")), 0
    while out.filter(F.size("segs") > k).limit(MIN_CHILDREN).count() >= MIN_CHILDREN:
        out = out.withColumn("seg", F.get("segs", F.lit(k)))
        node = out.filter("seg LIKE '=%'").groupBy("host", "prefix", "seg").agg(F.sum("n").alias("n")).groupBy("host", "prefix").agg(F.count("*").alias("children"), F.sum("n").alias("pages"))
        wild = node.filter((F.col("children") >= MIN_CHILDREN) & (F.col("children") >= MIN_DISTINCT_SHARE * F.col("pages"))).select("host", "prefix", F.lit(True).alias("wild"))
        out = out.join(wild, ["host", "prefix"], "left")
        out = out.withColumn("part", F.when(F.col("wild") & F.col("seg").startswith("="), F.lit("*")).otherwise(F.col("seg")))
        out = _grown(out, F.col("part")).drop("wild", "part", "seg")
        out, k = stored(out), k + 1
    for_rest = F.slice("segs", k + 1, F.greatest(F.size("segs") - k, F.lit(0)))
    kinds = F.transform(for_rest, lambda x: F.when(x.startswith("="), F.lit("=")).otherwise(x))
    tail = lambda x: F.when(F.size("segs") > k, F.concat(F.lit("/"), F.array_join(x, "/"))).otherwise(F.lit(""))
    return out.withColumn("template", F.concat("prefix", tail(for_rest))).withColumn("shape", F.concat("shape", tail(kinds))).drop("prefix")


def _grown(out: DataFrame, part: Column) -> DataFrame:
    """prefix and shape, longer by one part where there is one."""
    kind = F.when(part.startswith("="), F.lit("=")).otherwise(part)
    longer = {c: F.concat(c, F.coalesce(F.concat(F.lit("/"), x), F.lit(""))) for c, x in (("prefix", part), ("shape", kind))}
    return out.withColumns(longer)


def judged_templates(counted: DataFrame) -> DataFrame:
    """(host, template, n, n_block, n_allow, rejected) of every template with a labelled page.

    It is rejected where the smoothed purity of blocked pages, of it and the siblings it is merged with, reaches PURITY
    on MIN_LABELLED labelled pages or more.
    """
    t = counted.groupBy("host", "shape", "template").agg(F.sum("n").alias("n"), F.sum("n_block").alias("b"), F.sum(F.col("n_block") + F.col("n_allow")).alias("m")).filter("m > 0")
    pool = t.groupBy("host", "shape").agg(F.sum("b").alias("pb"), F.sum("m").alias("pm"))
    t = t.join(pool, ["host", "shape"])
    d = lambda c: F.col(c).cast("double")
    p = d("pb") / d("pm")
    z2 = (d("b") / d("m") - p) * (d("b") / d("m") - p)
    similar = z2 <= F.lit(Z * Z) * p * (1 - p) * (1 / d("m") + 1 / d("pm"))
    t = t.withColumn("similar", similar)
    merged = t.filter("similar").groupBy("host", "shape").agg(F.sum("b").alias("mb"), F.sum("m").alias("mm"))
    t = t.join(merged, ["host", "shape"], "left")
    b, m = F.when(F.col("similar"), d("mb")).otherwise(d("b")), F.when(F.col("similar"), d("mm")).otherwise(d("m"))
    rejected = (m >= MIN_LABELLED) & ((b + SMOOTHING * PRIOR) / (m + SMOOTHING) >= PURITY)
    return t.select("host", "template", "n", F.col("b").alias("n_block"), (F.col("m") - F.col("b")).alias("n_allow"), rejected.alias("rejected"))


def with_rules(pages: DataFrame, rules: list[tuple[str, str]], id_col: str, url_col: str) -> DataFrame:
    """(page_id, host, path, rule, action, segs): the longest rule that fits and what it says."""
    rules = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fits = [(F.when(rule_fits(r, F.col("host"), F.col("path")), F.lit(r)), F.when(rule_fits(r, F.col("host"), F.col("path")), F.lit(a))) for r, a in rules]
    base = base.withColumn("rule", F.coalesce(*[f[0] for f in fits], F.lit(None).cast("string"))).withColumn("action", F.coalesce(*[f[1] for f in fits], F.lit(None).cast("string")))
    return base.withColumn("segs", typed(F.col("path")))


def path_counts(base: DataFrame, label: Column) -> DataFrame:
    """(host, segs, n, n_block, n_allow) by distinct typed path."""
    counts = base.groupBy("host", "segs").agg(F.count("*").alias("n"), F.sum((label == "block").cast("long")).alias("b"), F.sum((label == "allow").cast("long")).alias("a"))
    return counts.select("host", "segs", "n", F.coalesce("b", F.lit(0)).alias("n_block"), F.coalesce("a", F.lit(0)).alias("n_allow"))


def url_templates(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The tree's leaves with a labelled page, labels being what the rules say: see judged_templates()."""
    base = with_rules(pages, RULES if rules is None else rules, id_col, url_col)
    return judged_templates(template_counts(stored(path_counts(base, F.col("action")))).filter("host != ''"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null: none fits), verdict (allow or block).

    ``labels`` (page_id, label 'allow' or 'block'; one row a page) labels more pages than the rules do. Null urls and
    urls without '://' have an empty host and path, which no rule fits and no template rejects: they are allowed.
    Ties between rules of one length go to the alphabetically first. Repeated rows are counted and come out each. An
    empty table gives an empty result; paths of any depth are read whole; extra columns are not read.
    """
    base = with_rules(pages, RULES if rules is None else rules, id_col, url_col)
    label = F.col("action")
    if labels is not None:
        base = base.join(labels.select(F.col("page_id"), F.col("label").alias("given")), "page_id", "left")
        label = F.coalesce("action", "given")
    counted = template_counts(stored(path_counts(base, label))).filter("host != ''")
    rejected = judged_templates(counted).filter("rejected")
    bad = stored(counted.join(rejected, ["host", "template"], "left_semi").select("host", "segs").withColumn("rejected", F.lit(True)))
    # the pages that rules decide need no template; the rest meet the rejected typed paths
    key = F.when(F.col("action").isNull(), F.col("segs")).otherwise(F.array(F.col("page_id").cast("string")))  # meets none
    out = base.withColumn("segs", key).join(broadcast_if_small(bad, 50_000), ["host", "segs"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
