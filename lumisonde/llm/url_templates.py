"""URL filter: a tree of path templates per host, with branches judged by their labels.

*Tree.* A path's segments, with digit runs written as ``<n>``, lead down a tree that starts
at the host. Under a node a literal child stays if it has enough of the node's urls;
all rarer ones become one wildcard child. Levels are built one after another over the
distinct paths and their counts, each by one grouping with partial sums, until no node that
goes on has enough urls for a literal child; what is left of its paths is one wildcard. A
stretch without branches is one step, so the number of steps is that of branchings on the way down, not of segments.
*Merging.* The children of a node, in the order of their labelled rate, join the branch
before them as long as they do not differ from the whole of it by a two-proportion test.
*Purity.* A branch's rate of bad labels is smoothed towards its host's, and that towards
the whole table's; a branch with enough labels and a rate over the threshold rejects
its urls.

Fixed rules, block or allow, go before the tree's verdict; the longest fitting rule wins, of
equally long ones the last in the order of host and path. Labels come from the caller; without any, the
urls that a rule decides are the labelled ones, so that their templates speak for the others.

Defined cases: a null url, or one without ``://``, has an empty host and path and is
judged like the rest; an empty path is the host's own node; a very long path is one row like any other;
repeated rows each get a verdict and count as often as they occur; labels of one key
that differ count as bad; an empty table gives an empty table; other columns are carried
along, and clashing names get fresh ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.llm.common import ascii_lower, fresh, written

#: A literal child has at least so many urls and this share of its parent's, so a node has at most 1 / SHARE of them.
LEAST, SHARE = 4, 0.02
#: A child and a branch are alike if their rates differ by less than so many standard errors.
ALIKE = 1.64
#: Weight of the host's rate in a branch's, and of the table's rate in a host's, in labels.
PRIOR = 4.0
REJECT, LABELS = 0.5, 3

Rule = tuple[str, str, str]  # block or allow, host, path


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(rules: list[Rule], host_: Column, path_: Column) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits. A rule fits its host, all subdomains, and paths that start with its own."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def segments(path_: Column) -> Column:
    """The segments of a path, digit runs as <n>."""
    return F.filter(F.split(F.regexp_replace(path_, "[0-9]+", "<n>"), "/"), lambda s: s != "")


def _shared(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return F.aggregate(same, start, lambda s, e: F.struct((s["n"] + (s["open"] & e).cast("int")).alias("n"), (s["open"] & e).alias("open")), lambda s: s["n"])


def templates(urls: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """urls (host, path, y) to (host, segs, parent, template, n, labelled, bad) per distinct list of segments.

    A round takes each node one level down; where all that go on from a node share their next segments, it goes down all of these at once.
    """
    nodes = urls.select("host", segments(F.col("path")).alias("segs"), "y").groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("labelled"), F.coalesce(F.sum("y"), F.lit(0)).alias("bad"))
    nodes = nodes.select("*", F.lit("").alias("parent"), F.lit("").alias("template"), F.lit(False).alias("done"), F.lit(0).alias("level"))
    while True:
        at = nodes.withColumn("seg", F.when(~F.col("done"), F.get("segs", F.col("level"))))
        rest = F.when(F.col("seg").isNotNull(), F.slice("segs", F.col("level") + 1, F.size("segs")))
        goes = F.coalesce(F.sum(F.when(F.col("seg").isNotNull(), F.col("n"))), F.lit(0))
        totals = at.groupBy("host", "template").agg(F.sum("n").alias("t"), goes.alias("goes"), _shared(F.min(rest), F.max(rest)).alias("shared"))  # the first and last in order share what all do
        at = written(at.join(totals, ["host", "template"]), "level")
        if at.where((F.col("t") >= least) & F.col("seg").isNotNull()).isEmpty():
            more = F.col("seg").isNotNull()
            return at.select("host", "segs", "n", "labelled", "bad", F.when(more, F.col("template")).otherwise(F.col("parent")).alias("parent"), F.when(more, F.concat("template", F.lit("/**"))).otherwise(F.col("template")).alias("template"))
        more, large = F.col("seg").isNotNull(), F.col("t") >= least
        children = at.where(more & large).groupBy("host", "template", "seg").agg(F.sum("n").alias("c"), F.max("t").alias("t"))
        kept = children.where((F.col("c") >= least) & (F.col("c") >= share * F.col("t"))).select("host", "template", "seg", F.lit(True).alias("kept"))
        at = at.join(kept, ["host", "template", "seg"], "left")
        down = F.when(more & F.coalesce("kept", F.lit(False)), F.greatest(F.lit(1), F.coalesce("shared", F.lit(0)))).otherwise(F.lit(1))
        literal = lambda k: F.concat(F.lit("/"), F.array_join(F.slice("segs", F.col("level") + 1, k), "/"))
        step = F.concat("template", F.when(F.col("kept"), literal(down)).when(large, F.lit("/*")).otherwise(F.lit("/**")))
        above = F.when(down > 1, F.concat("template", literal(down - 1))).otherwise(F.col("template"))
        parent, template = F.when(more, above).otherwise(F.col("parent")), F.when(more, step).otherwise(F.col("template"))
        nodes = at.select("host", "segs", "n", "labelled", "bad", parent.alias("parent"), template.alias("template"), (F.col("done") | (more & ~large)).alias("done"), F.when(more, F.col("level") + down).otherwise(F.col("level")).alias("level"))


def _rate(bad: Column, labelled: Column) -> Column:
    return (bad + 0.5) / (labelled + 1)


def branches(nodes: DataFrame, alike: float = ALIKE, prior: float = PRIOR) -> DataFrame:
    """(host, template, branch, labelled, rate): templates with their merged branch and its smoothed rate."""
    each = nodes.groupBy("host", "parent", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    child = F.struct(_rate(F.col("bad"), F.col("labelled")).alias("rate"), "template", "labelled", "bad")
    # a node has at most 1 / SHARE literal children and two wildcards
    sets = each.groupBy("host", "parent").agg(F.sort_array(F.collect_list(child)).alias("children"))
    branch = lambda labelled, bad, names: F.struct(labelled.alias("labelled"), bad.alias("bad"), names.alias("templates"))

    def join(found: Column, c: Column) -> Column:
        last = F.element_at(found, -1)
        own, rest = F.array(branch(c["labelled"], c["bad"], F.array(c["template"]))), F.slice(found, 1, F.size(found) - 1)
        n, m = last["labelled"] + 1, c["labelled"] + 1
        pooled = (last["bad"] + c["bad"] + 1) / (n + m)
        apart = F.abs(c["rate"] - _rate(last["bad"], last["labelled"])) > alike * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
        both = F.array(branch(last["labelled"] + c["labelled"], last["bad"] + c["bad"], F.concat(last["templates"], F.array(c["template"]))))
        return F.when(F.size(found) == 0, own).when(apart, F.concat(found, own)).otherwise(F.concat(rest, both))

    start = F.slice(F.transform("children", lambda c: branch(c["labelled"], c["bad"], F.array(c["template"]))), 1, 0)
    merged = sets.select("host", F.posexplode(F.aggregate("children", start, join)).alias("branch", "b")).select("host", "branch", "b.*")
    hosts = each.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    whole = hosts.agg(F.sum("hl").alias("wl"), F.sum("hb").alias("wb"))  # one row
    hosts = hosts.join(F.broadcast(whole), F.lit(True)).select("host", ((F.col("hb") + prior * _rate(F.col("wb"), F.col("wl"))) / (F.col("hl") + prior)).alias("hr"))
    merged = merged.join(hosts, "host").withColumn("rate", (F.col("bad") + prior * F.col("hr")) / (F.col("labelled") + prior))
    return merged.select("host", F.explode("templates").alias("template"), "branch", "labelled", "rate")


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, key: str = "page_id", url: str = "url", reject: float = REJECT, least: int = LABELS) -> DataFrame:
    """pages with host, path, rule, verdict, template and rate; labels, if given, has (key, y) with y 1 for unwanted urls."""
    slim = pages.select(key, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    if labels is None:
        said = rule_of(rules, F.col("host"), F.col("path"))[1]
        seen = slim.withColumn("y", F.when(said == "block", 1).when(said == "allow", 0))
    else:
        seen = slim.join(labels.groupBy(key).agg(F.max("y").cast("int").alias("y")), key, "left")
    nodes = written(templates(seen), "templates")
    judged = nodes.select("host", "segs", "template").join(branches(nodes), ["host", "template"])
    judged = judged.select("host", "segs", "template", "rate", ((F.col("rate") >= reject) & (F.col("labelled") >= least)).alias("bad"))
    h, p, s, rule, verdict, template, rate, bad = fresh(pages, "host", "path", "segs", "rule", "verdict", "template", "rate", "bad")
    out = pages.withColumn(h, host(F.col(url))).withColumn(p, path(F.col(url))).withColumn(s, segments(F.col(p)))
    out = out.join(judged.toDF(h, s, template, rate, bad), [h, s], "left")
    text, said = rule_of(rules, F.col(h), F.col(p))
    own = F.when(F.col(bad), "block").otherwise("allow")
    return out.select(*pages.columns, h, p, text.alias(rule), F.coalesce(said, own).alias(verdict), template, rate)
