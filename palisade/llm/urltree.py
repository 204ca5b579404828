"""URL filter: rules first, then a path-template tree with smoothed purity. DataFrame functions only.

Paths are cut into segments. In each host a segment that varies is generalised into a wildcard: typed ones (numbers, hashes,
dates, long slugs) at once, others where a branch point has many children and half of them have few pages; a child with a large share
of the point's pages stays. Sibling branches are merged whose subtrees go on alike (in kinds of segments) and whose labelled pages,
over the whole subtree, fall alike, as a two-proportion test tells at any number of pages; a branch with too few labelled pages for the
test stays as it is. Each template's purity is its labelled share of blocked pages, smoothed towards the same template over all
hosts, that towards the same path with its typed marks alone over all hosts, that towards the share of the first segment and that towards the share of all.

Marks of generalised segments begin with a question mark, which no path holds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm._work import cut


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: Longest wins; the order breaks ties.
RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Strength of each level's prior, in pages; share of blocked pages from which a template is rejected.
STRENGTH, REJECT = 8.0, 0.5
#: A branch point with more children than this, half of which have fewer than FEW pages, is a wildcard but for children with a share of its pages above 1 / CHILDREN.
CHILDREN, FEW = 12, 3
#: Labelled pages that a branch has at least to be compared with its siblings; steps of the share of blocked pages by which siblings are ordered.
EVIDENCE, STEPS = 5, 64
#: Squared z below which two shares count as alike.
ALIKE = 3.84


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(at > 0, F.translate(host, upper, lower)).otherwise("")


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _typed(s: Column) -> Column:
    return (
        F.when(s.rlike(r"^[0-9]+$"), F.lit("?number"))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("?date"))
        .when(s.rlike(r"^[0-9A-Fa-f-]{16,}$"), F.lit("?hash"))
        .when(s.rlike(r"^[0-9]+\.[A-Za-z]{2,5}$"), F.concat(F.lit("?number."), F.regexp_extract(s, r"\.([A-Za-z]+)$", 1)))
        .when(s.rlike(r"[0-9]{3,}") | (F.length(s) > 40), F.lit("?slug"))
        .otherwise(s)
    )


def _alike(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Two shares k/n are not told apart by the squared z of their difference (or one has no labelled page)."""
    p = (k1 + k2) / F.greatest(n1 + n2, F.lit(1))
    var = p * (1 - p) * (1 / F.greatest(n1, F.lit(1)) + 1 / F.greatest(n2, F.lit(1)))
    d = k1 / F.greatest(n1, F.lit(1)) - k2 / F.greatest(n2, F.lit(1))
    return (n1 == 0) | (n2 == 0) | (d * d <= ALIKE * var)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every row.

    pages: page_id, url (further columns are ignored). A null url or one without :// has an empty host and path; it then has the
    root template. Pages that a rule judges are the labelled ones. Repeated rows are answered and counted each. All tables
    that are joined back are counts by host and template, made by partial aggregates; a hot host is one row of them,
    and its pages' side of the join is split by adaptive execution.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    shown = F.transform(parts, _typed)
    # one row per host and typed path, with its counts: everything below works on these
    one = p.select("page_id", "host", "path", "rule", "by_rule", shown.alias("segments"))
    key = F.array_join("segments", "/")
    shapes = one.groupBy("host", key.alias("shape")).agg(
        F.count("*").alias("n"), F.count("by_rule").alias("labelled"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked")
    )
    shapes = cut(shapes.withColumn("template", F.lit("")))
    # level by level: literal children of a branch point (host, template so far) are generalised or kept
    done, level = [], 0
    while True:
        # a branch point that can be generalised has three shapes at least; the rest of other paths is literal
        crowd = shapes.groupBy("host", "template").agg(F.count("*").alias("crowd"))
        split = cut(shapes.join(crowd, ["host", "template"]).withColumn("open", (F.col("crowd") > 2) & (F.col("shape") != "") & (F.size(F.split("shape", "/")) > level)).drop("crowd"))
        parts = F.split("shape", "/")
        rest = F.when((F.col("shape") != "") & (F.size(parts) > level), F.concat(F.lit("/"), F.array_join(F.slice(parts, level + 1, F.greatest(F.size(parts) - level, F.lit(1))), "/"))).otherwise("")
        done.append(split.where("not open").withColumn("template", F.concat("template", rest)).drop("open"))
        shapes = split.where("open").drop("open")
        if shapes.isEmpty():
            break
        here = shapes.withColumn("seg", F.coalesce(F.when(F.col("shape") != "", F.get(F.split("shape", "/"), F.lit(level))), F.lit("")))
        after = F.get(F.split("shape", "/"), F.lit(level + 1))
        kind = F.when(after.isNull(), "").when(after.startswith("?"), after).otherwise("word")
        kids = here.where("seg != ''").groupBy("host", "template", "seg").agg(F.sum("n").alias("kn"), F.sum("labelled").alias("kl"), F.sum("blocked").alias("kb"), F.array_join(F.sort_array(F.collect_set(kind)), ",").alias("goes_on"))
        points = kids.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("kn").alias("pn"), F.percentile_approx("kn", 0.5).alias("median"))
        judged = kids.join(points, ["host", "template"])
        literal = ~F.col("seg").startswith("?")
        wild = literal & (F.col("children") > CHILDREN) & (F.col("median") < FEW) & (F.col("kn") * CHILDREN <= F.col("pn"))
        step = F.when(literal & ~wild & (F.col("kl") >= EVIDENCE), F.round(F.col("kb") * STEPS / F.col("kl")).cast("int"))
        judged = judged.select("host", "template", "seg", "kl", "kb", "goes_on", wild.alias("wild"), step.alias("step"))
        # siblings by steps of their share: at most STEPS + 1 rows a branch point and way to go on, each compared with the one before
        place = ["host", "template", "goes_on"]
        order = Window.partitionBy(*place).orderBy("step")
        steps = judged.where("step is not null").groupBy(*place, "step").agg(F.count("*").alias("members"), F.sum("kl").alias("sl"), F.sum("kb").alias("sb"))
        apart = ~_alike(F.col("sb"), F.col("sl"), F.lag("sb").over(order), F.lag("sl").over(order))
        steps = steps.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("band", F.sum("apart").over(order))
        bands = Window.partitionBy(*place, "band")
        share = F.round(100 * F.sum("sb").over(bands) / F.sum("sl").over(bands)).cast("int").cast("string")
        steps = steps.select(*place, "step", F.when(F.sum("members").over(bands) > 1, F.concat(F.lit("?like"), share)).alias("like"))
        judged = judged.join(steps, [*place, "step"], "left")
        names = judged.select("host", "template", "seg", F.when(F.col("wild"), F.lit("?any")).otherwise(F.coalesce("like", "seg")).alias("name"))
        here = here.join(names, ["host", "template", "seg"], "left")
        shapes = cut(here.select("host", "shape", "n", "labelled", "blocked", F.concat("template", F.coalesce(F.concat(F.lit("/"), F.col("name")), F.lit(""))).alias("template")))
        level += 1
    shapes = cut(reduce(DataFrame.unionByName, done))
    shapes = shapes.withColumn("top", F.get(F.split("shape", "/"), F.lit(0)))
    share = lambda k, *by: shapes.groupBy(*by).agg(F.sum("labelled").alias(f"l{k}"), F.sum("blocked").alias(f"b{k}"))
    whole = shapes.agg(F.sum("labelled").alias("l4"), F.sum("blocked").alias("b4"))
    smooth = lambda k, prior: (F.col(f"b{k}") + STRENGTH * prior) / (F.col(f"l{k}") + STRENGTH)
    root = (F.coalesce("b4", F.lit(0)) + 0.5) / (F.coalesce("l4", F.lit(0)) + 1.0)
    scored = shapes.join(share(0, "host", "template"), ["host", "template"]).join(share(1, "template"), "template").join(share(2, "shape"), "shape").join(share(3, "top"), "top").join(F.broadcast(whole))  # whole is a single row
    known = scored.select("host", "shape", "template", F.round(smooth(0, smooth(1, smooth(2, smooth(3, root)))), 6).alias("purity"))
    out = one.select("page_id", "host", "path", "rule", "by_rule", key.alias("shape")).join(known, ["host", "shape"])
    verdict = F.coalesce("by_rule", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
