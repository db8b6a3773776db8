"""URL filter: curated rules first, then a path-template tree learned for each host.

The tree: a url's path segments, lexically classed (numbers, hex ids, dates), are the
levels below its host. Level by level, a node whose children are many and rarely
repeat is a variable segment: its children become one wildcard, so that what follows is
a template. Literal branches of one node are then merged if they are statistically
similar: a chi-square test compares each branch's urls by what follows with those of
all branches, and another the labelled rates of the merged branches with enough labels.
Merged branches pool their labels, so a branch without labels of its own borrows those of
its like. Each template has a purity, the share of rejected urls among its labelled
ones, smoothed towards its host's rate, which is itself smoothed towards the corpus rate;
templates with ``MIN_LABELS`` labels, own or pooled, and a purity of ``REJECT_AT`` go.

Labels are the decisions of the curated rules: without evidence a url stays.

Urls are counted by (host, path) before anything is shuffled, so a host with a third of
all pages is a row for each of its paths. The driver learns at which levels some host has
``VARIABLE_CHILDREN`` segments; only those take a round. Nothing is broadcast by hand but one row.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule, and is allowed; null ids pass through; repeated rows are judged row by row; of
merges with as many labels the one with more rejected counts; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.session import materialize

#: (verdict, host, path prefix): a rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A node is variable with so many distinct children, each seen so often at most.
VARIABLE_CHILDREN, VARIABLE_MEAN = 20, 3.0
MIN_LABELS, PRIOR, REJECT_AT = 5, 4.0, 0.8
#: Chi-square quantiles at 0.95 for 1, 2, ... degrees of freedom; beyond, n + 1.645 * sqrt(2n).
CHI2 = (3.841, 5.991, 7.815, 9.488, 11.070, 12.592, 14.067, 15.507, 16.919, 18.307)


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or end. Path: then up to ? # or end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_az(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(what))
    return rule, verdict


def segments(path: Column) -> Column:
    """Lexically classed segments of a path."""
    seg = F.filter(F.split(path, "/", -1), lambda s: s != "")

    def classed(s: Column) -> Column:
        stem, ext = F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        kind = (
            F.when(F.rlike(stem, F.lit(r"^[0-9]+$")), F.lit("{num}"))
            .when(F.rlike(stem, F.lit(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$")), F.lit("{date}"))
            .when(F.rlike(stem, F.lit(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$")), F.lit("{hex}"))
            .otherwise(stem)
        )
        return F.concat(kind, ext)

    return F.transform(seg, classed)


def _generalise(t: DataFrame) -> DataFrame:
    """Wildcards for variable segments, level by level from the root. ``t``: host, segs, tpl, n, bad, seen."""
    width = t.select("host", F.posexplode("tpl").alias("level", "s")).groupBy("host", "level").agg(F.count_distinct("s").alias("k"))
    levels = width.groupBy("level").agg(F.max("k").alias("k")).filter(F.col("k") >= VARIABLE_CHILDREN)
    for level in sorted(r[0] for r in levels.select("level").collect()):
        node = t.filter(F.size("tpl") > level).select("host", F.slice("tpl", 1, level).alias("up"), F.get("tpl", F.lit(level)).alias("s"), "n")
        child = node.groupBy("host", "up", "s").agg(F.sum("n").alias("n"))
        wild = child.groupBy("host", "up").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).filter((F.col("k") >= VARIABLE_CHILDREN) & (F.col("n") <= VARIABLE_MEAN * F.col("k")))
        wild = wild.select(F.col("host").alias("w_host"), F.col("up").alias("w_up"))
        on = (F.col("host") == F.col("w_host")) & (F.slice("tpl", 1, level) == F.col("w_up")) & (F.size("tpl") > level)
        star = F.concat(F.slice("tpl", 1, level), F.array(F.lit("*")), F.slice("tpl", F.lit(level + 2), F.size("tpl")))
        t = t.join(wild, on, "left").withColumn("tpl", F.when(F.col("w_host").isNotNull(), star).otherwise(F.col("tpl"))).drop("w_host", "w_up")
        t = materialize(t, "level")
    return t


def _critical(free: Column) -> Column:
    """Chi-square quantile at 0.95."""
    return F.when(free < 1, F.lit(0.0)).otherwise(F.coalesce(F.get(F.array(*[F.lit(x) for x in CHI2]), (free - 1).cast("int")), free + 1.645 * F.sqrt(2.0 * free)))


def _merge(templates: DataFrame) -> DataFrame:
    """Templates with the labels of the branches they merge with (seen_m, bad_m)."""
    each = templates.select("host", "tpl", "n", "seen", "bad", F.posexplode("tpl").alias("i", "lit")).filter(~F.rlike("lit", F.lit(r"[*{]")))
    each = each.withColumns({"up": F.slice("tpl", F.lit(1), F.col("i")), "tail": F.slice("tpl", F.col("i") + 2, F.size("tpl"))})
    node, branch = ["host", "up", "i"], ["host", "up", "i", "lit"]
    # Is a branch like all branches of its node, by what follows it?
    tails = each.groupBy(*node, "tail").agg(F.sum("n").alias("n_tail"), F.count(F.lit(1)).alias("k_tail"))
    nodes = tails.groupBy(*node).agg(F.sum("n_tail").alias("n_node"), F.count(F.lit(1)).alias("n_tails"), F.max("k_tail").alias("most"))
    nodes = nodes.filter("most > 1").drop("most")
    x = each.join(nodes, node).join(tails, [*node, "tail"])
    fits = x.groupBy(*branch, "n_node", "n_tails").agg(F.sum("n").alias("n_own"), F.sum(F.col("n") * F.col("n") * F.col("n_node") / F.col("n_tail")).alias("q"))
    fits = fits.filter(F.col("q") / F.col("n_own") - F.col("n_own") <= _critical(F.col("n_tails") - 1) + 1e-9).select(*branch)
    like = materialize(each.join(fits, branch), "branches")
    # Do the branches with labels enough agree, in each template?
    sure = F.col("seen") >= MIN_LABELS
    pick = lambda c: F.coalesce(F.sum(F.when(sure, c)), F.lit(0.0))
    g = like.groupBy(*node, "tail").agg(
        F.count(F.lit(1)).alias("k"), F.sum("seen").alias("s"), F.sum("bad").alias("b"), F.count_if(sure).alias("ks"), pick(F.col("seen")).alias("ss"), pick(F.col("bad")).alias("bs"), pick(F.col("bad") * F.col("bad") / F.col("seen")).alias("b2")
    )
    p = F.col("bs") / F.greatest(F.col("ss"), F.lit(1))
    chi2 = F.when((p > 0) & (p < 1), (F.col("b2") - F.col("ss") * p * p) / (p * (1 - p))).otherwise(F.lit(0.0))
    same = g.filter((F.col("k") > 1) & (chi2 <= _critical(F.col("ks") - 1) + 1e-9)).select(*node, "tail", "s", "b")
    best = like.join(same, [*node, "tail"]).groupBy("host", "tpl").agg(F.max(F.struct("s", "b")).alias("m"))
    return templates.join(best, ["host", "tpl"], "left").withColumns({"seen_m": F.coalesce("m.s", "seen"), "bad_m": F.coalesce("m.b", "bad")}).drop("m")


def template_tree(urls: DataFrame) -> DataFrame:
    """``urls`` (host, segs, label: 1 rejected, 0 accepted, null unknown) to (host, segs, template, purity, labelled, reject)."""
    label = F.col("label")
    t = urls.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("bad"), F.count(label).alias("seen"))
    t = _generalise(materialize(t.withColumn("tpl", F.col("segs")), "paths"))
    templates = t.groupBy("host", "tpl").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
    templates = materialize(templates, "templates")
    hosts = templates.groupBy("host").agg(F.sum("bad").alias("h_bad"), F.sum("seen").alias("h_seen"))
    corpus = templates.agg(((F.sum("bad") + 1) / (F.sum("seen") + 2)).alias("rate"))
    m = _merge(templates).join(hosts, "host").join(F.broadcast(corpus))
    host_rate = (F.col("h_bad") + PRIOR * F.col("rate")) / (F.col("h_seen") + PRIOR)
    purity = (F.col("bad_m") + PRIOR * host_rate) / (F.col("seen_m") + PRIOR)
    m = m.select("host", "tpl", F.col("seen_m").alias("labelled"), purity.alias("purity"))
    m = m.withColumn("reject", (F.col("labelled") >= MIN_LABELS) & (F.col("purity") >= REJECT_AT))
    return t.select("host", "segs", "tpl").join(m, ["host", "tpl"]).withColumn("template", F.concat(F.lit("/"), F.array_join("tpl", "/"))).drop("tpl")


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for each row of ``pages``."""
    host, path = host_path(F.col(f"`{url}`"))
    x = pages.select(F.col(f"`{page_id}`").alias(page_id), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = x.withColumns({"rule": rule, "__v": verdict, "segs": segments(F.col("path"))})
    tree = template_tree(x.select("host", "segs", F.when(F.col("__v") == "block", 1).when(F.col("__v") == "allow", 0).alias("label")))
    x = x.join(materialize(tree, "tree"), ["host", "segs"], "left")
    method = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    return x.select(page_id, "host", "path", "rule", F.coalesce("__v", method).alias("verdict"), "template", "purity")


def op1_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
