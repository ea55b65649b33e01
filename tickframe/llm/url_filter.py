"""URL filters: given host and path rules first, mined token rules for the rest.

A URL is cut into host and path. A given rule fits its host and every subdomain, if the path starts with
the rule's path; the longest wins. What the given rules decide labels those URLs. FP-growth mines token
combinations (host labels and path parts) that go with a label, over all distinct URLs: those without a
label count against a rule's confidence, so that a token is not blocked for a few blocked URLs. Rules below
the support (a share of the URLs, ten of them at least) or confidence asked for are pruned, and so is one that a shorter one of its verdict makes needless. URLs that
no given rule fits take the verdict of the most confident mined rule, or ``allow``.

Mined rules are matched by an inverted index: each rule stands under its rarest token, distinct URLs are
joined by token, and the candidates' other tokens are checked. Each distinct URL is judged once, so a
very common host or URL is not judged again and again; the join back is split by Spark where it is hot.

Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule and is allowed. With
no labelled URL, or an empty table, nothing is mined. Very long URLs are taken whole. Rules of equal confidence: the wider support,
then more tokens, then the last by text. Repeated rows are judged alike. Extra columns of
the pages are ignored.
"""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import staged


class HostRule(NamedTuple):
    """A fixed verdict for a host with its subdomains, from a path on."""

    verdict: str
    host: str
    path: str


RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
LABEL = "verdict="
LEAST_URLS = 10  # that a mined combination stands in
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.when(F.instr(url, "://") > 0, F.expr(
        "substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(found, r"^[^/?#]*", 0)
    path = F.regexp_extract(found, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fixed_rule(rules: tuple[HostRule, ...]) -> Column:
    """The longest rule that fits columns host and path, as (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens() -> Column:
    """Distinct host labels and path parts of columns host and path."""
    parts = F.concat(
        F.transform(F.split("host", r"\."), lambda t: F.concat(F.lit("h:"), t)),
        F.transform(F.split("path", "/"), lambda t: F.concat(F.lit("p:"), t)))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 2))


def condensed(labelled: DataFrame, least: int) -> DataFrame:
    """``labelled`` (id, tokens, verdict) without tokens of fewer than ``least`` URLs, and with one token of each set that stands in
    the same URLs: the others would only multiply the combinations, of which each is true of the same URLs.

    Two tokens stand in the same URLs if the number of these and two XORs over their hashes agree.
    """
    own = labelled.select("id", "verdict", F.explode("tokens").alias("token"))
    where = own.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                     F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter(F.col("n") >= least)
    kept = staged(where.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token"), "url-tokens")
    # A URL has each token once, so a list here is no longer than its tokens.
    return own.join(kept, "token").groupBy("id").agg(F.collect_list("token").alias("tokens"), F.first("verdict", True).alias("verdict"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """Rules from ``id``, ``tokens`` and ``verdict`` (null: no label): (need, verdict, confidence, support), and the token to index by.

    A combination must stand in a share of ``min_support`` of the URLs, and in LEAST_URLS of them at least.
    """
    least = max(ceil(min_support * labelled.count()), LEAST_URLS)
    short = staged(condensed(labelled, least), "url-baskets")
    label = F.when(F.col("verdict").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit(LABEL), "verdict")))
    baskets = short.select(F.concat("tokens", label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(short.count(), 1)), minConfidence=min_confidence).fit(baskets)
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = model.associationRules.filter(
        F.startswith(F.col("consequent")[0], F.lit(LABEL)) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit(LABEL)))
    ).select(F.array_sort("antecedent").alias("need"), F.expr(f"substring(consequent[0], {len(LABEL) + 1})").alias("verdict"),
             "confidence", "support")
    rules = staged(rules, "url-rules")
    shorter = rules.select(F.col("need").alias("less"), "verdict", F.col("confidence").alias("as_sure"))
    wider = rules.select("need", "verdict", "confidence", F.explode("need").alias("token")).join(
        shorter.select("*", F.explode("less").alias("token")), ["token", "verdict"]).filter(
        (F.size("less") < F.size("need")) & (F.size(F.array_except("less", "need")) == 0) & (F.col("as_sure") >= F.col("confidence")))
    pruned = rules.join(wider.select("need", "verdict").distinct(), ["need", "verdict"], "left_anti")
    rarest = pruned.select("need", "verdict", F.explode("need").alias("token")).join(single, "token").groupBy("need", "verdict").agg(
        F.min(F.struct("freq", "token")).alias("rarest"))
    return pruned.join(rarest, ["need", "verdict"]).select(
        F.col("rarest.token").alias("token"), "need", "verdict", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path and the ``mined`` verdict of the most confident rule whose tokens a URL has all."""
    hits = urls.select("host", "path", "tokens", F.explode("tokens").alias("token")).join(rules, "token").filter(
        F.size(F.array_except("need", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("need").alias("size"), F.array_join("need", " ").alias("text"), "verdict"))
    return hits.groupBy("host", "path").agg(best.alias("best")).select(
        "host", "path", F.col("best.verdict").alias("mined"), F.col("best.text").alias("mined_rule"))


def judge(pages: DataFrame, rules: tuple[HostRule, ...] = RULES, min_support: float = 0.002,
          min_confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, the given rule that fits (or null), the verdict, and the mined rule behind it (or null)."""
    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = parted.groupBy("host", "path").agg(F.count("*").alias("pages"))
    urls = staged(urls.select("host", "path", "pages", fixed_rule(rules).alias("fixed"), tokens().alias("tokens")), "urls")
    labelled = urls.filter(F.size("tokens") > 0).select(F.xxhash64("host", "path").alias("id"), "tokens", "fixed.verdict")
    open_ = urls.filter(F.col("fixed").isNull() & (F.size("tokens") > 0))
    if labelled.filter(F.col("verdict").isNotNull()).isEmpty():
        mined = open_.select("host", "path", F.lit(None).cast("string").alias("mined"), F.lit(None).cast("string").alias("mined_rule"))
    else:
        mined = match(open_, mine(labelled, min_support, min_confidence))
    return parted.join(mined, ["host", "path"], "left").select(
        "page_id", "host", "path", fixed_rule(rules).alias("fixed"), "mined", "mined_rule").select(
        "page_id", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", "mined", F.lit("allow")).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("mined_rule")).alias("mined_rule"))
