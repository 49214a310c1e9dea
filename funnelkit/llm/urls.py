"""Operator 3: URL filters by a path-template tree. DataFrame functions only.

Rules (host suffix, path prefix, verdict) judge the urls they fit, the longest
rule first. All other urls get the method's verdict:

1. *Tree.* Per host, a node is a path template: the path's segments, those of a
   variable shape (numbers, hexadecimal ids, dates, long mixed words) already
   replaced by a wildcard of their shape; the path's end is a branch of its own.
   Levels follow each other until no two paths below a node differ. Segments that
   all paths of a node share are passed in one step, so a round is a fork, not a
   segment.
2. *Generalise.* Segment values that are many and rare below their parent
   (`VARIED` values or more, each with under `RARE` of the parent's pages) also
   become the wildcard `{*}`, so below a host a node has few branches.
3. *Label.* Pages that fit a rule are the labelled ones.
4. *Merge.* A branch's labelled block rate is compared with that of the rest of
   its parent (two proportions, |z| < `Z`): branches that do not differ are merged
   into the parent and share its counts. Of those that differ, siblings that are
   next to each other by rate and do not differ from one another are merged too:
   they share the counts of them all. Hosts are not merged with each other.
5. *Purity.* purity = (blocked + PRIOR * parent's purity) / (labelled + PRIOR),
   from the root (all pages) over the host down the tree. A template without a
   labelled page takes the blocked share of *all* pages of its nearest labelled
   ancestor, smoothed alike, so few labels do not condemn what nobody judged.
   A url whose template's purity reaches `REJECT` is blocked.

Every count is an aggregate with map-side combining, so a host with a third of
all pages costs a few rows a task. Joins go through `join_by_group`: a node,
segment or template with many rows is joined from a bounded list instead of being
sent to one task. A path that shares its node with no other path leaves the loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import join_by_group, saved

#: (host suffix, path prefix, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
VARIED, RARE = 8, 0.2
Z = 1.96
PRIOR = 4.0
REJECT = 0.6
END = ""                  # no segment is empty: the branch of paths that end here

#: Shapes of variable segments, the first that fits: name and pattern of the whole segment.
SHAPES = [("{num}", r"\d+"), ("{date}", r"\d{4}-\d{2}(-\d{2})?"), ("{hex}", r"(?=[0-9a-fA-F-]*\d)[0-9a-fA-F-]{8,}"),
          ("{num.ext}", r"\d+\.[A-Za-z]{2,5}"), ("{mixed}", r"(?=.*\d)(?=.*[A-Za-z]).{12,}")]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; equally long ones: the first stated."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, what in sorted(reversed(RULES if rules is None else rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(suffix + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    """The segment, or the wildcard of its shape."""
    out = segment
    for name, pattern in reversed(SHAPES):
        out = F.when(segment.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _differs(n: Column, b: Column, pn: Column, pb: Column) -> Column:
    """Whether the block rate of a branch differs from that of the rest of its parent."""
    rn, rb = pn - n, pb - b
    rate = pb / F.greatest(pn, F.lit(1))
    spread = F.sqrt(rate * (1 - rate) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(rn, F.lit(1))))
    z = F.abs(b / F.greatest(n, F.lit(1)) - rb / F.greatest(rn, F.lit(1))) / F.greatest(spread, F.lit(1e-12))
    return (n > 0) & (rn > 0) & (z >= Z)


def _common(lo: Column, hi: Column) -> Column:
    """The segments that all paths between the smallest and the greatest one begin with."""
    differ = F.array_position(F.zip_with(lo, hi, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.slice(lo, 1, F.when(differ == 0, F.size(lo)).otherwise(differ - 1).cast("int"))


def _branches(values: DataFrame, hosts: bool) -> DataFrame:
    """Children of each node from its values (node, seg, g, ...): their state after comparing and merging."""
    state = ["ref_n", "ref_b", "purity", "cover"]
    kids = values.groupBy("node", "g").agg(
        *[F.sum(c).alias(c) for c in ("n", "b", "m")], F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.count(F.lit(1)).alias("values"), *[F.min(c).alias(c) for c in state])
    kids = kids.withColumn("own", _differs(F.col("n"), F.col("b"), F.col("ref_n"), F.col("ref_b")))
    if hosts:
        kids = kids.withColumn("all_n", F.col("n")).withColumn("all_b", F.col("b"))
    else:  # at most VARIED + 1 / RARE + the shapes' branches a node
        by_rate = Window.partitionBy("node", "own").orderBy(F.col("b") / F.greatest("n", F.lit(1)), "g")
        n0, b0 = F.lag("n").over(by_rate), F.lag("b").over(by_rate)
        apart = F.coalesce(_differs(F.col("n"), F.col("b"), F.col("n") + n0, F.col("b") + b0), F.lit(False))
        kids = kids.withColumn("apart", apart.cast("int")).withColumn("kin", F.sum("apart").over(by_rate))
        same = Window.partitionBy("node", "own", "kin")
        kids = kids.withColumn("all_n", F.sum("n").over(same)).withColumn("all_b", F.sum("b").over(same))
    smoothed = (F.col("all_b") + PRIOR * F.col("purity")) / (F.col("all_n") + PRIOR)
    covered = (F.col("b") + PRIOR * F.col("cover")) / (F.col("m") + PRIOR)
    return kids.select(
        "node", "g", "values", F.col("n").alias("leaf_n"), _common(F.col("lo"), F.col("hi")).alias("common"),
        (F.col("lo") == F.col("hi")).alias("single"),
        *[F.when(F.col("own"), new).otherwise(F.col(old)).alias(old)
          for old, new in (("ref_n", F.col("all_n")), ("ref_b", F.col("all_b")), ("purity", smoothed))],
        F.when(F.col("n") > 0, covered).otherwise(F.col("cover")).alias("cover"))


def templates(cells: DataFrame) -> DataFrame:
    """(path_key, pages, template, purity) of each cell (path_key: host and shaped segments; pages, labelled, blocked)."""
    total = cells.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("labelled", "blocked", "pages")]).first()
    purity = (total["blocked"] + 0.5 * PRIOR) / (total["labelled"] + PRIOR)
    cover = (total["blocked"] + 0.5 * PRIOR) / (total["pages"] + PRIOR)
    at = cells.select(
        "path_key", "pages", "labelled", "blocked", F.col("path_key").alias("rest"), F.array().cast("array<string>").alias("node"),
        F.lit(total["labelled"]).cast("long").alias("ref_n"), F.lit(total["blocked"]).cast("long").alias("ref_b"),
        F.lit(float(purity)).alias("purity"), F.lit(float(cover)).alias("cover"))
    level, done = 0, None
    while True:
        at = at.withColumn("seg", F.coalesce(F.get("rest", F.lit(0)), F.lit(END)))
        below = F.slice("rest", 2, F.size("rest"))
        values = saved(at.groupBy("node", "seg").agg(
            F.sum("labelled").alias("n"), F.sum("blocked").alias("b"), F.sum("pages").alias("m"), F.count(F.lit(1)).alias("cells"),
            F.min(below).alias("lo"), F.max(below).alias("hi"),
            *[F.min(c).alias(c) for c in ("ref_n", "ref_b", "purity", "cover")]), "url-values")
        if level == 0:
            values = values.withColumn("g", F.col("seg"))
        else:
            nodes = saved(values.groupBy("node").agg(F.sum("m").alias("node_m"), F.count(F.lit(1)).alias("node_values")), "url-nodes")
            rare = ((F.col("node_size") >= VARIED) & (F.col("m") < RARE * F.col("node_m"))
                    & ~F.col("seg").isin(END, *[name for name, _ in SHAPES]))
            nodes = nodes.withColumn("node_size", F.col("node_values"))
            values = join_by_group(values, nodes, ["node"], "node_values").withColumn(
                "g", F.when(rare, F.lit("{*}")).otherwise(F.col("seg")))
        kids = saved(_branches(values, hosts=level == 0), "url-branches")
        steps = saved(join_by_group(values.select("node", "seg", "g", "cells"), kids, ["node", "g"], "values"), "url-steps")
        moved = join_by_group(at.select("path_key", "pages", "labelled", "blocked", "rest", "node", "seg"), steps, ["node", "seg"], "cells")
        moved = saved(moved.withColumn("node", F.concat("node", F.array("g"), "common"))
                      .withColumn("rest", F.slice("rest", F.size("common") + 2, F.size("rest"))), "url-cells")
        ended = moved.where("single").select(
            "path_key", "pages", F.array_join(F.concat(F.array(F.lit("")), F.filter(F.slice("node", 2, F.size("node")), lambda x: x != END)),
                                              "/").alias("template"),
            F.when(F.col("leaf_n") > 0, F.col("purity")).otherwise(F.col("cover")).alias("purity"))
        done = ended if done is None else done.unionByName(ended)
        at = moved.where("not single").select(*[c for c in at.columns if c != "seg"])
        if at.isEmpty():
            return done
        level += 1


def judge(pages: DataFrame, rules=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row.

    Null urls and urls without `://` have an empty host and path; they form a
    host of their own. Rows that repeat give repeated rows. Without a labelled
    page the purity is 0.5 and nothing is blocked. An empty table gives an
    empty result; extra columns are not read. Very long urls are read whole.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    parts = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), shape)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.concat(F.array("host"), parts).alias("path_key"))
    cells = saved(rows.groupBy("path_key").agg(
        F.count(F.lit(1)).alias("pages"), F.count("ruled").alias("labelled"),
        F.sum((F.coalesce(F.col("ruled"), F.lit("")) == "block").cast("long")).alias("blocked")), "url-cells")
    tree = saved(templates(cells), "url-templates")
    return (join_by_group(rows, tree, ["path_key"], "pages")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "template", F.round("purity", 6).alias("purity")))
