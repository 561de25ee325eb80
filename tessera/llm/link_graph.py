"""URL filter: host and path rules, then trust and distrust propagated over the host link graph. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import save

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The (rule, verdict) of the longest rule that fits; a rule fits its host and all subdomains."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        hit = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fits = F.when(hit, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def propagate(edges: DataFrame, seeds: DataFrame, seed_col: str, *, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank over edges (src, dst, weight); weights of one src sum to one.

    seeds: one row per host, of any sum. Rows: host, score. What a host without links holds goes nowhere; handing it back to the seeds would
    only multiply all scores, as would seeds of sum one, so neither is done here. Contributions are summed by aggregation, so hubs cost no more than their links.

    Rounds go on until no score can be further than ``tolerance`` from its limit. A round brings all scores together at least by the factor
    ``damping`` nearer, so what is left is at most what the last round moved times damping / (1 - damping).
    """
    now = seeds.select("host", F.col(seed_col).alias("seed"), F.col(seed_col).alias("score"))
    left = 2 * (seeds.agg(F.sum(seed_col)).first()[0] or 0.0)
    while left > tolerance:
        sent = edges.join(now, edges["src"] == now["host"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("weight")).alias("received"))
        score = F.lit(1 - damping) * F.col("seed") + F.lit(damping) * F.coalesce("received", F.lit(0.0))
        now = save(now.join(sent, now["host"] == sent["dst"], "left").select("host", "seed", score.alias("score"), F.abs(score - F.col("score")).alias("moved")))
        moved = now.agg(F.sum("moved")).first()[0]
        left = min(left * damping, moved * damping / (1 - damping))
    return now.select("host", "score")


def judge(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, tolerance: float = 1e-6, margin: float = 0.5) -> DataFrame:
    """Verdict of each url: the longest fitting rule's, else what the link graph says of its host.

    Links are the absolute and protocol-relative ``href`` values of a page; a host's edges are its
    links to other hosts, weighted by how many of its pages' links go there. Trust starts at hosts in
    proportion to the share of their pages that rules allow and follows links; distrust
    starts in proportion to the share that rules block and goes against the links. Both are scaled so that
    a host without links keeps its seed, which makes scores of graphs of all sizes alike: they are personalised PageRank, with the seeds as a
    distribution and what hosts without links hold handed back to the seeds, times one factor. Both are within ``tolerance`` of the
    limit, however long the paths.

    A host is blocked if its distrust exceeds its trust by more than ``margin``, or if what links brought it of distrust exceeds
    its trust by more than ``margin`` times what they can carry. Distrust of a host is divided among all that
    link to it, so a link carries at most the share it is of those, and a host's links the sum of their shares.
    Counts by host are aggregated before any shuffle of pages, and the graph is over hosts, not pages.

    Rows: page_id, host, path, rule, verdict, trust, distrust. A null or unusable url has empty host and
    path and no links lead to it. Null or empty html: no links. Repeated rows are each judged. Empty
    table: no rows. Other columns are ignored.
    """
    base = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    judged = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    share = lambda v: F.avg(F.when(F.col("found.verdict") == v, 1.0).otherwise(0.0))
    seeds = judged.drop("html", "url").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))

    links = judged.select("host", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""), F.lit(1))).alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    pairs = links.select(F.col("host").alias("src"), target.alias("dst")).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    pairs = save(pairs)
    hosts = seeds.unionByName(pairs.select(F.col("dst").alias("host"), F.lit(0.0).alias("trusted"), F.lit(0.0).alias("blocked")))
    hosts = save(hosts.groupBy("host").agg(F.max("trusted").alias("trusted"), F.max("blocked").alias("blocked")))

    def weighted(src: str, dst: str) -> DataFrame:
        out = pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "n")
        total = out.groupBy("src").agg(F.sum("n").alias("total")).withColumnRenamed("src", "from")
        return save(out.join(total, out["src"] == total["from"]).select("src", "dst", (F.col("n") / F.col("total")).alias("weight")))

    back = weighted("dst", "src")
    within = tolerance * (1 - damping)
    trust = propagate(weighted("src", "dst"), hosts, "trusted", damping=damping, tolerance=within)
    distrust = propagate(back, hosts, "blocked", damping=damping, tolerance=within)
    carried = back.groupBy(F.col("dst").alias("host")).agg(F.sum("weight").alias("carried"))
    scale = lambda c: (F.col(c) / F.lit(1 - damping)).alias(c)
    scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host").join(hosts.select("host", "blocked"), "host").join(carried, "host", "left")
    scores = scores.select("host", scale("trust"), scale("distrust"), "blocked", "carried")
    out = judged.drop("html", "url").join(scores, "host", "left")
    over = F.col("distrust") - F.col("trust")
    by_links = F.coalesce(over - F.col("blocked") > F.lit(margin) * F.col("carried"), F.lit(False))
    verdict = F.coalesce("found.verdict", F.when((over > margin) | by_links, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
