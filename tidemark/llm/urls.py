"""Operator 3: URL filters by host rules and a path-template tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import reliable_checkpoint

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Template segments for variable parts, for all that lies deeper, and for merged branches.
#: A path holds neither ``?`` nor ``#``, so no literal segment has these names.
ANY, DEEPER, MERGED = "?", "??", "#"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column) -> Column:
    """The last two labels of a host, its port left out; a host of fewer labels as it is."""
    return F.substring_index(F.regexp_replace(host, r":\d*$", ""), ".", -2)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule ``host/path`` that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def path_templates(paths: DataFrame, max_depth: int, max_children: int, min_share: float) -> DataFrame:
    """Add ``template`` to ``paths(host, segs, n, ...)``: empty, or segments each after a slash.

    Going down level by level, a segment becomes :data:`ANY` when its parent has more than
    ``max_children`` different children and this one holds less than ``min_share`` of the
    parent's rows. What lies deeper than ``max_depth`` becomes :data:`DEEPER`.
    """
    depth = paths.agg(F.max(F.size("segs"))).first()[0] or 0
    paths = paths.withColumn("template", F.lit(""))
    for d in range(min(depth, max_depth)):
        seg = F.when(F.size("segs") > d, F.element_at("segs", F.lit(d + 1)))
        here = paths.withColumn("seg", seg)
        children = here.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(F.sum("n").alias("of_seg"))
        children = reliable_checkpoint(children)
        parents = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("of_seg").alias("of_all"))
        variable = (F.col("kinds") > max_children) & (F.col("of_seg") < min_share * F.col("of_all"))
        # A checkpoint takes a sum's partitioning away, so that a host of many rows can be split.
        parents = reliable_checkpoint(parents)
        fixed = children.join(parents, ["host", "template"]).where(~variable).select("host", "template", "seg", F.lit(True).alias("fixed"))
        here = here.join(reliable_checkpoint(fixed), ["host", "template", "seg"], "left")
        step = F.when(F.col("fixed"), F.col("seg")).otherwise(ANY)
        paths = here.withColumn(
            "template", F.when(F.col("seg").isNotNull(), F.concat("template", F.lit("/"), step)).otherwise(F.col("template"))
        ).drop("seg", "fixed")
    deeper = F.concat("template", F.lit(f"/{DEEPER}"))
    return paths.withColumn("template", F.when(F.size("segs") > max_depth, deeper).otherwise(F.col("template")))


def template_purity(leaves: DataFrame, smoothing: float, similar_z: float) -> DataFrame:
    """Add ``purity`` to ``leaves(host, template, b, l)``: blocked and all labels of each template.

    Each node of a host's tree has the labels below it. Labelled children of a node whose
    block rates lie within ``similar_z`` standard errors of the rate of all of them are
    merged: they share their labels. Going down from the rate of all labels over the
    registered domain and the host to the template, a purity is the block rate smoothed by
    ``smoothing`` pseudo-labels at the purity one step above, and as many at most, as labels allow, at
    the block rate of the equal branch of other hosts. So a branch without labels of its own lies
    between its parent's purity and what equal branches elsewhere are, and a host without any labels begins with its domain's.
    """
    smooth = lambda b, l, above: (b + smoothing * above) / (l + smoothing)
    totals = [F.sum("b").alias("b"), F.sum("l").alias("l")]
    hosts = reliable_checkpoint(leaves.groupBy("host").agg(*totals).withColumn("domain", registered_domain(F.col("host"))))
    domains = reliable_checkpoint(hosts.groupBy("domain").agg(*totals))
    overall = domains.agg(*totals).first()
    rate = (overall["b"] or 0) / (overall["l"] or 1)
    domains = domains.select("domain", smooth(F.col("b"), F.col("l"), F.lit(rate)).alias("of_domain"))
    hosts = hosts.join(domains, "domain").select("host", smooth(F.col("b"), F.col("l"), F.col("of_domain")).alias("of_host"))

    steps = F.split("template", "/")
    places = F.when(F.size(steps) > 1, F.sequence(F.lit(2), F.size(steps))).otherwise(F.array().cast("array<int>"))
    path = lambda n: F.array_join(F.slice(steps, 1, n), "/")
    chain = leaves.select("host", "template", "b", "l", F.explode(F.transform(places, lambda n: F.struct(
        n.alias("depth"), path(n).alias("node"), path(n - 1).alias("parent")))).alias("s"))
    chain = chain.select("host", "template", "b", "l", "s.*")
    nodes = reliable_checkpoint(chain.groupBy("host", "parent", "node").agg(*totals))
    pool = F.try_divide(F.sum("b"), F.sum("l")).alias("pool")
    pools = reliable_checkpoint(nodes.groupBy("host", "parent").agg(pool))
    alike = F.abs(F.try_divide("b", "l") - F.col("pool")) <= similar_z * F.sqrt(F.try_divide(F.col("pool") * (1 - F.col("pool")), "l"))
    nodes = nodes.join(pools, ["host", "parent"]).withColumn("branch", F.when(alike, MERGED).otherwise(F.col("node")))
    nodes = reliable_checkpoint(nodes.drop("pool"))
    branches = reliable_checkpoint(nodes.groupBy("host", "parent", "branch").agg(*totals))
    judged = nodes.select("host", "parent", "node", "branch").join(branches, ["host", "parent", "branch"])
    # Equal branches of all hosts; a branch's own labels are taken off where it is judged.
    equal = reliable_checkpoint(nodes.groupBy("node").agg(F.sum("b").alias("all_b"), F.sum("l").alias("all_l")))
    own = nodes.select("host", "node", F.col("b").alias("own_b"), F.col("l").alias("own_l"))
    judged = reliable_checkpoint(judged).join(own, ["host", "node"]).join(equal, "node")
    of_node = F.struct("b", "l", (F.col("all_b") - F.col("own_b")).alias("other_b"), (F.col("all_l") - F.col("own_l")).alias("other_l"))
    judged = reliable_checkpoint(judged.select("host", "node", of_node.alias("of_node")))
    # At most max_depth + 1 steps to a template.
    walks = chain.select("host", "template", "depth", "node").join(judged, ["host", "node"])
    walks = walks.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("depth", "of_node"))).alias("walk"))
    known = leaves.select("host", "template").join(reliable_checkpoint(hosts), "host").join(reliable_checkpoint(walks), ["host", "template"], "left")

    def down(above: Column, x: Column) -> Column:
        at = x["of_node"]
        # Other hosts count as smoothing times their share of labels in labels and smoothing together.
        part = smoothing / (at["other_l"] + smoothing)
        return (at["b"] + smoothing * above + part * at["other_b"]) / (at["l"] + smoothing + part * at["other_l"])

    steps_down = F.aggregate(F.coalesce("walk", F.array().cast(walks.schema["walk"].dataType)), F.col("of_host"), down)
    return reliable_checkpoint(known.select("host", "template", steps_down.alias("purity")))


def filter_urls(
    pages: DataFrame,
    rules: dict[str, str],
    id_col: str = "page_id",
    url_col: str = "url",
    max_depth: int = 6,
    max_children: int = 12,
    min_share: float = 0.05,
    similar_z: float = 1.96,
    smoothing: float = 4.0,
    threshold: float = 0.75,
) -> DataFrame:
    """Judge every url: (page_id, host, path, rule, template, purity, verdict).

    ``rules`` maps ``host/path`` to allow or block; a rule fits its host, all subdomains
    and paths that start with its path, and the longest one decides. Urls under a rule are
    also the labels of the method for all others: per host a tree of path templates (see
    :func:`path_templates`), whose branches are merged where their block rates are alike and
    get a smoothed purity, the expected share of blocked urls, that backs off to the branch
    above, equal branches of other hosts, the host, the registered domain and all labels (see :func:`template_purity`). A
    url without a rule is blocked when its template's purity is ``threshold`` or more.

    Everything is counted with pre-aggregated group-bys and joined by host and path, so a
    host of a third of the rows is split. A null url or one without ``://`` has empty host
    and path, and no rule; such urls are judged together as a host of no name. Without
    labels all is allowed. Repeated rows and null ids keep their rows. Empty tables give an
    empty result. Other columns are not read.
    """
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    known = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    known = known.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = known.withColumns({"rule": rule, "ruled": verdict})
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    paths = known.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("b"), F.count("ruled").alias("l")
    )
    paths = path_templates(reliable_checkpoint(paths.withColumn("segs", segments)), max_depth, max_children, min_share)
    paths = reliable_checkpoint(paths.drop("segs", "n"))
    leaves = reliable_checkpoint(paths.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("l").alias("l")))
    purity = template_purity(leaves, smoothing, similar_z)
    by_path = paths.select("host", "path", "template").join(purity, ["host", "template"])
    result = known.join(by_path, ["host", "path"])
    own = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return result.select("page_id", "host", "path", "rule", "template", "purity", F.coalesce("ruled", own).alias("verdict"))
