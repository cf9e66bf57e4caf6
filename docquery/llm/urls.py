"""URL filter: rules, and for urls without one a tree of path templates judged by the rules' verdicts on its branches.

All of it is DataFrame operations. Pages are counted by host and generalised segments first, so that the tree is built
from counts, whatever number of pages a host has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docquery.llm.common import quoted, written
from docquery.llm.html import host_of

#: Segments after which a template is cut to ** where no page below is labelled, and children from which a node's segments are a wildcard.
LEVELS, CHILDREN = 4, 8
#: Pages that the overall share of blocked ones counts as in a template's purity, and branches that what is expected
#: above counts as in what a node makes expect of a new branch; the share that rejects, and the normal deviation up to
#: which branches are alike.
PRIOR_PAGES, PRIOR_BRANCHES, REJECT_FROM, ALIKE = 4.0, 4.0, 0.6, 1.96
#: The most that is expected of a host before its own pages are seen: two branches of its own must be blocked to reject others.
PRIOR_MOST = 0.4


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and the paths that start with a path; written like net/."""

    verdict: str
    host: str
    path: str

    @staticmethod
    def of(verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return Rule(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule.of("block", "net/"), Rule.of("allow", "example.net/en/"), Rule.of("block", "example.com/de/"), Rule.of("allow", "org/fr/"))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without a host."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """pages (with host and path) and the longest rule that fits, as rule and ruled."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))

    def first(value):
        return reduce(lambda rest, r: F.when(r.fits(F.col("host"), F.col("path")), F.lit(value(r))).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))

    return pages.withColumns({"rule": first(lambda r: r.text), "ruled": first(lambda r: r.verdict)})


def segments(path: Column) -> Column:
    """All segments of a path with runs of digits as *."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "*"))


def tree_of(counted: DataFrame) -> DataFrame:
    """host, segs, n, b and template, from distinct host and segs with n, b.

    One level after the other, as deep as the paths go: the children of a node become a wildcard where there are more than
    CHILDREN. A node of at most CHILDREN paths has no wildcard below and is done at once. From LEVELS segments on a node
    without a labelled page below is one template, which ends in **: all of it has the same purity and verdict.
    """
    done, level = [], 0
    active = counted.withColumn("node", F.array().cast("array<string>"))
    while True:
        step = F.coalesce(F.get("segs", F.lit(level)), F.lit(""))
        nodes = active.groupBy("host", "node").agg(F.count("*").alias("paths"), F.count_distinct(step).alias("children"), F.sum(F.when(F.size("segs") > level, F.col("n"))).alias("labelled"))
        rest = F.slice("segs", F.lit(level + 1), F.greatest(F.size("segs") - level, F.lit(0)))
        below = F.concat("node", F.array(F.when((F.col("children") > CHILDREN) & (step != ""), F.lit("*")).otherwise(step)))
        whole = F.when(F.size("segs") <= level, F.col("node"))
        if level >= LEVELS:
            whole = whole.when(F.col("labelled") == 0, F.concat("node", F.array(F.lit("**"))))
        whole = whole.when(F.col("paths") <= CHILDREN, F.concat("node", rest))
        if level < LEVELS:  # deeper paths stay until their node below LEVELS segments shows whether it has a labelled page
            whole = F.when(F.size("segs") <= LEVELS, whole)
        found = written(active.join(nodes, ["host", "node"]).select("host", "segs", "n", "b", whole.alias("whole"), below.alias("node")), f"level{level}")
        done.append(found.where("whole is not null").select("host", "segs", "n", "b", F.concat_ws("/", "whole").alias("template")))
        active = found.where("whole is null").drop("whole")
        level += 1
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)


def expected_of(leaves: DataFrame, prior: Column) -> DataFrame:
    """host, template, expected and near, from host, template, n and b: what the tree above a template makes expect of it.

    From the root down, a node's expectation for a new branch is the mean share of blocked pages over its labelled branches,
    each of them once however many pages it has, smoothed by its own parent's with PRIOR_BRANCHES; the root's parent is the
    prior. A template with labelled pages has its own share, smoothed by its parent's expectation with PRIOR_PAGES. near is
    the share of blocked pages among those labelled at the template or the nearest node above that has any, null without.
    """
    step = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split("template", "/"))
    path = leaves.select("host", "template", "n", "b", step.alias("step"))
    # Node i of a template is what its first i steps lead to: the root has none of them.
    ways = path.select("host", "template", "n", "b", F.size("step").alias("depth"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("step")), lambda i: F.array_join(F.slice("step", F.lit(1), i), "/"))).alias("i", "node"))
    nodes = ways.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("i").alias("i"))
    above = F.when(F.col("i") > 1, F.regexp_replace("node", "/[^/]*$", "")).otherwise(F.lit(""))
    branches = nodes.where("i > 0 and n > 0").groupBy("host", above.alias("node")).agg(F.sum(F.col("b") / F.col("n")).alias("shares"), F.count("*").alias("branches"))
    told = nodes.select("host", "node", "n", "b").join(branches, ["host", "node"], "left")
    chain = ways.select("host", "template", "depth", "i", "node").join(told, ["host", "node"])
    of = F.struct("i", "n", "b", F.coalesce("shares", F.lit(0.0)).alias("shares"), F.coalesce("branches", F.lit(0)).alias("branches"))
    whole = chain.groupBy("host", "template").agg(F.array_sort(F.collect_list(of)).alias("chain"), F.first("depth").alias("depth"))
    inner = F.slice("chain", F.lit(1), F.greatest(F.col("depth"), F.lit(1)))
    parents = F.when(F.col("depth") > 0, inner).otherwise(F.array().cast(whole.schema["chain"].dataType))
    expected = F.aggregate(parents, prior.cast("double"), lambda m, x: (x["shares"] + PRIOR_BRANCHES * m) / (x["branches"] + PRIOR_BRANCHES))
    near = F.aggregate("chain", F.lit(None).cast("double"), lambda m, x: F.when(x["n"] > 0, x["b"] / x["n"]).otherwise(m))
    # Pages labelled at the template itself, not at templates that go on below it.
    return whole.join(leaves.select("host", "template", "n", "b"), ["host", "template"]).select("host", "template", ((F.col("b") + PRIOR_PAGES * expected) / (F.col("n") + PRIOR_PAGES)).alias("expected"), near.alias("near"))


def templates(ruled: DataFrame) -> DataFrame:
    """host, segs (generalised segments), template, purity, shown, expected and near, from pages with host, segs and ruled.

    Branches of a host that have labelled pages and do not differ from the host's share of blocked ones by chance's measure
    are one branch for counting. Purity is the share of blocked pages among a branch's labelled ones, smoothed by the overall
    share; shown is whether its own share, without the overall one, reaches REJECT_FROM. expected and near are expected_of's,
    whose prior is the mean over hosts, so that a hot host counts once, and at most PRIOR_MOST.
    """
    counted = written(ruled.groupBy("host", "segs").agg(F.count("ruled").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("b")), "counted")
    tree = tree_of(counted)
    leaves = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    hosts = leaves.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("b").alias("hb"))
    share = F.try_divide("hb", "hn")
    close = (F.col("n") > 0) & (F.abs(F.col("b") - F.col("n") * share) <= ALIKE * F.sqrt(F.col("n") * share * (1 - share)) + 0.5)
    leaves = leaves.join(hosts, "host").withColumn("alike", F.coalesce(close, F.lit(False)))
    merged = leaves.where("alike").groupBy("host").agg(F.sum("n").alias("mn"), F.sum("b").alias("mb"))
    leaves = leaves.join(merged, "host", "left").withColumns({"n": F.when(F.col("alike"), F.col("mn")).otherwise(F.col("n")), "b": F.when(F.col("alike"), F.col("mb")).otherwise(F.col("b"))})
    total = counted.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    prior = (total["b"] or 0) / total["n"] if total["n"] else 0.0
    shown = F.coalesce(F.col("b") >= REJECT_FROM * F.col("n"), F.lit(False)) & (F.col("n") > 0)
    fair = hosts.where("hn > 0").agg(F.avg(F.col("hb") / F.col("hn")).alias("p")).first()["p"]
    own = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    judged = expected_of(own, F.lit(min(fair or 0.0, PRIOR_MOST)))
    leaves = leaves.select("host", "template", ((F.col("b") + PRIOR_PAGES * prior) / (F.col("n") + PRIOR_PAGES)).alias("purity"), shown.alias("shown"))
    return tree.select("host", "segs", "template").join(leaves.join(judged, ["host", "template"]), ["host", "template"])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict, template, purity and expected of every page.

    The longest rule that fits decides; of other pages the template. One with labelled pages is rejected from a purity of
    REJECT_FROM on if its branch's own labelled pages reach that too. One without is rejected if what the tree above it
    makes expect reaches REJECT_FROM, and so do the pages that are labelled nearest above: other hosts' pages never block
    it, nor does one blocked branch beside it, but several do. A host without labelled pages is allowed.
    A url that is null or has no :// has an empty host and path, and no rule but one for that. Rows come back as often
    as they were given; other columns are not read.
    """
    rows = pages.select(quoted(key).alias(key), host_of(quoted(url)).alias("host"), path_of(quoted(url)).alias("path"))
    rows = with_rule(rows, rules).withColumn("segs", segments(F.col("path")))
    found = rows.join(templates(rows), ["host", "segs"])
    above = (F.col("expected") >= REJECT_FROM) & F.coalesce(F.col("near") >= REJECT_FROM, F.lit(False))
    verdict = F.coalesce("ruled", F.when((F.col("purity") >= REJECT_FROM) & F.col("shown") | above, F.lit("block")).otherwise(F.lit("allow")))
    return found.select(quoted(key), "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"), F.round("expected", 6).alias("expected"))
