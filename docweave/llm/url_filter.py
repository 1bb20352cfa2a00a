"""URL rules, and for pages that no rule fits, propagation of trust and distrust over the graph of hosts.

Trust flows from hosts with allowed pages along links: a personalised PageRank with the seeds as restart set.  Distrust
flows from hosts with blocked pages against links, to the hosts that link there, and counts by the part of a linker's own
links: it is what a linker's personalised PageRank gives to blocked hosts, however many others link there.  Both are
worked out as joins and sums over host edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import checkpoint, only

_AUTHORITY = r"^([^/?#]*)"
_PATH = r"^[^/?#]*([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'<>\s]+)"""


@dataclass(frozen=True)
class UrlRule:
    """``action`` is allow or block; ``host`` covers its subdomains, ``path`` is a prefix."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Propagation:
    """``damping`` and ``rounds`` of both ranks; a host is blocked if the distrust that links bring it reaches
    ``threshold`` and exceeds the trust that links bring it.  What a seed restarts with is no evidence from links."""

    damping: float = 0.85
    rounds: int = 8
    threshold: float = 0.02


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without it."""
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), _AUTHORITY, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), _PATH, 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[UrlRule], field: str) -> Column:
    """The longest fitting rule's name or action, else null; equal lengths go by name."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of one host that link to another host; summed before the shuffle."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), 1), lower_ascii))).alias("dst"))
    return links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def _rank(edges: DataFrame, seeds: DataFrame, source: str, target: str, p: Propagation) -> DataFrame:
    """Scores that flow from ``source`` to ``target`` by the edge's part of the links of its ``src``: (host, score)."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = checkpoint(edges.join(out, "src").select(F.col(source).alias("host"), F.col(target).alias("to"), (F.col("weight") / F.col("total")).alias("share")))
    start = seeds.select("host", (F.col("seed") * (1 - p.damping)).alias("score"))
    score = start
    for i in range(p.rounds):
        flow = score.join(share, "host").groupBy(F.col("to").alias("host")).agg((F.sum(F.col("score") * F.col("share")) * p.damping).alias("score"))
        score = start.unionByName(flow).groupBy("host").agg(F.sum("score").alias("score"))
        if i % 3 == 2:
            score = checkpoint(score)
    return score


def host_verdicts(pages: DataFrame, p: Propagation = Propagation()) -> DataFrame:
    """(host, trust, distrust, host_verdict) from pages with host, html and action (null where no rule fits)."""
    judged = pages.where("host <> ''").groupBy("host").agg(F.avg((F.col("action") == "allow").cast("double")).alias("good"), F.avg((F.col("action") == "block").cast("double")).alias("bad"))
    good = judged.where("good > 0").select("host", F.col("good").alias("seed"))
    bad = judged.where("bad > 0").select("host", F.col("bad").alias("seed"))
    edges = checkpoint(host_edges(pages))
    if edges.isEmpty():  # nothing to flow along
        trust, distrust = (s.select("host", (F.col("seed") * (1 - p.damping)).alias("score")) for s in (good, bad))
    else:
        trust, distrust = _rank(edges, good, "src", "dst", p), _rank(edges, bad, "dst", "src", p)
    both = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full_outer").na.fill(0.0, ["trust", "distrust"])
    own = lambda seeds, name: seeds.select("host", (F.col("seed") * (1 - p.damping)).alias(name))
    both = both.join(own(good, "own_trust"), "host", "left").join(own(bad, "own_distrust"), "host", "left").na.fill(0.0, ["own_trust", "own_distrust"])
    both = both.select("host", (F.col("trust") - F.col("own_trust")).alias("trust"), (F.col("distrust") - F.col("own_distrust")).alias("distrust"))
    return both.withColumn("host_verdict", F.when((F.col("distrust") >= p.threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, p: Propagation = Propagation()) -> DataFrame:
    """page_id, host, path, rule, verdict of each page.

    A url that is null or lacks ``://`` has empty host and path and is allowed, there being no evidence.  A null html
    holds no links; links without a host stay on their own host and carry no evidence.  Rows repeat as they do in the input, an empty
    table gives none, and further columns are ignored.  The verdict is the rule's if one fits, else the host's.
    """
    rows = only(pages, "page_id", "url", "html")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "html")
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules, "name")).withColumn("action", rule_for(F.col("host"), F.col("path"), rules, "action"))
    hosts = host_verdicts(rows, p).where("host_verdict = 'block'").select("host", "host_verdict")
    judged = rows.drop("html").join(hosts, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", "host_verdict", F.lit("allow")).alias("verdict"))
