"""Operator 10: URL verdicts from rules, and from trust propagated over the host graph.

Rules decide where one fits. All other urls get their host's verdict from two propagations over
host edges, run as DataFrame joins: personalised PageRank from trusted seeds (hosts whose pages an
allow rule takes, by share of pages) along the edges, and distrust from blocked seeds against them.
A host is blocked when its distrust exceeds ``ratio`` times its trust by more than a ``margin`` of it.
Rounds go on until no score of any host, however small, changes by more than ``tolerance`` of itself, so
every host that a seed reaches has its scores; damping makes the changes die out on any graph.

Edges: page host -> host of an absolute link in its html, and host -> parent domain of two labels
at least (a subdomain vouches for the domain it lives under, a bad domain taints its subdomains). Self links count
for nothing. A host without outgoing edges passes nothing on.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and takes
part in no edge, and is allowed; repeated rows give repeated rows; other columns are not read,
whatever their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import written

AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LINK = r"""(?i)href\s*+=\s*+["']?+(?:https?:)?//([^/?#"'<>\s]++)"""
Rules = list[tuple[str, str]]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *AZ)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest fitting rule, else nulls; equal lengths: block first.

    The rules are a reviewed list passed as a parameter; they become one CASE expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_scores(pages: DataFrame, damping: float = 0.85, tolerance: float = 1e-9) -> DataFrame:
    """(host, trust, distrust) from rows (host, verdict, html); verdict null where no rule fits."""
    known = pages.filter("host <> ''")
    share = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"),
                                      F.count(F.when(F.col("verdict") == "allow", 1)).alias("allow"),
                                      F.count(F.when(F.col("verdict") == "block", 1)).alias("block"))
    share = written(share.select("host", (F.col("allow") / F.col("n")).alias("allow"),
                                 (F.col("block") / F.col("n")).alias("block")), "url-hosts")
    links = known.select(F.col("host").alias("src"),
                         F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), 1))).alias("dst")) \
        .select("src", F.translate("dst", *AZ).alias("dst"))
    parents = share.select("host", F.explode(F.sequence(F.lit(0), F.size(F.split("host", r"\.")) - 1)).alias("i")) \
        .select(F.split("host", r"\.").alias("l"), "i") \
        .filter("i + 2 < size(l)").select(F.array_join(F.expr("slice(l, i + 1, size(l))"), ".").alias("src"),
                                          F.array_join(F.expr("slice(l, i + 2, size(l))"), ".").alias("dst")).distinct()
    pairs = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).unionByName(
        parents.withColumn("n", F.lit(1).cast("long"))).filter("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    both = pairs.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("src").alias("host"), "dst", "n"),
        F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("dst"), "n"))).alias("e")) \
        .select("e.*")
    total = both.groupBy("kind", "host").agg(F.sum("n").alias("total"))
    edges = written(both.join(total, ["kind", "host"]).select("kind", "host", "dst", (F.col("n") / F.col("total")).alias("w")),
                    "url-edges")
    seed = share.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("allow").alias("v")),
                                                  F.struct(F.lit("distrust").alias("kind"), F.col("block").alias("v")))).alias("s")) \
        .select("s.kind", "host", "s.v").filter("v > 0")
    mass = seed.groupBy("kind").agg(F.sum("v").alias("mass"))  # two rows
    seed = written(seed.join(F.broadcast(mass), "kind").select("kind", "host", (F.col("v") / F.col("mass")).alias("v")),
                   "url-seeds")
    before, restart = seed, seed.withColumn("v", F.col("v") * (1 - damping))
    while True:
        rank = before
        for _ in range(4):
            passed = rank.join(edges, ["kind", "host"]).select("kind", F.col("dst").alias("host"),
                                                               (F.col("v") * F.col("w") * damping).alias("v"))
            rank = passed.unionByName(restart).groupBy("kind", "host").agg(F.sum("v").alias("v"))
        rank = written(rank, "url-rank")
        change = rank.withColumn("d", F.col("v")).unionByName(before.select("kind", "host", F.lit(0.0).alias("v"), (-F.col("v")).alias("d"))) \
            .groupBy("kind", "host").agg(F.sum("v").alias("v"), F.sum("d").alias("d"))
        if change.filter(F.abs("d") > tolerance * F.col("v")).isEmpty():
            break
        before = rank
    return rank.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("v"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("v"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: Rules, ratio: float = 1.0, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html", margin: float = 1e-8) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"))
    src = src.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    src = src.withColumns({"rule": rule, "verdict": verdict})
    scores = written(host_scores(src), "url-scores")
    none = F.lit(0.0)
    return src.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.coalesce("distrust", none) > ratio * (1 + margin) * F.coalesce("trust", none), "block")
                   .otherwise("allow")).alias("verdict"),
        F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"))
