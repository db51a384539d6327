"""URL rules with redirect equivalence.

Redirects and canonical links make pages aliases of each other.  A page that a rule names keeps that decision; any
other page is blocked if one of its aliases is blocked, wherever in the chain of links that one stands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.components import components
from candela.llm.frames import hot_keys, hot_size, lookup, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# fixed values: query parameters that only track
TRACKING = "^(utm_[a-z_]+|gclid|fbclid|ref|ref_src)(=.*)?$"
#: Pages of one host that share a copy of its rules.
PART_ROWS = 4096
#: A link element, or a meta element that redirects.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*\d+\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z in lower case; empty without a ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without a ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The page a URL names: host, path and query without scheme, fragment, order of parameters and tracking ones."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.concat(host_of(url), path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def target(url: Column, link: Column) -> Column:
    """``link`` as found on the page ``url``: whole, without scheme, from the root, or beside the page."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme, base = F.lit("http"), F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "(?s)^(.*/)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when((link != "") & ~link.rlike("^[#?]|^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(base, F.when(folder == "", "/").otherwise(folder), link))
    )


def host_suffixes(host: Column) -> Column:
    """The host and all domains above it: a.b.c to a.b.c, b.c and c."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a table; a long list is better kept as one."""
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule_host string, rule_path string")


def with_rules(rows: DataFrame, rules: DataFrame, spread: Sequence[str]) -> DataFrame:
    """``rows`` (host, path and others) with ``own``, the struct (rule, verdict) of the longest rule that fits; null if none does.

    ``rules`` (verdict, rule_host, rule_path) may be of any number.  The rules of a host are one row, and a page looks up
    its host and the few domains above it, each once for all pages of a host.  Of rules of one length the first in order of
    text holds; of rules that are repeated with both verdicts, allow.  A task holds the rules of one host and of the domains
    above it.
    """
    named = F.concat("rule_host", "rule_path")
    step = F.struct((-F.length(named)).alias("order"), named.alias("rule"), "verdict", F.col("rule_path").alias("start"))
    of_host = rules.groupBy("rule_host").agg(F.array_sort(F.collect_set(step)).alias("rules"))
    hosts = rows.select("host").distinct()
    each = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("rule_host"))
    found = each.join(of_host, "rule_host").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("rules"))).alias("rules"))
    found = saved(found, "host-rules")
    hot = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    names = F.broadcast(hot.where(F.col("n") >= hot_size(total)).select("host", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = rows.join(names, "host", "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    repeats = found.join(names, "host", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    own = F.get(fits, F.lit(0))
    joined = dealt.join(repeats, ["host", "_part"], "left").withColumn("_own", own)
    return joined.select(*rows.columns, F.when(F.col("_own").isNotNull(), F.struct(F.col("_own.rule").alias("rule"), F.col("_own.verdict").alias("verdict"))).alias("own"))


def links(pages: DataFrame) -> DataFrame:
    """(url, to) for each canonical link and each redirect that a page states."""
    found = F.array(*[target(F.col("url"), F.regexp_extract(F.coalesce("html", F.lit("")), p, 1)) for p in (CANONICAL, REFRESH)])
    return pages.where(F.col("url").contains("://")).select("url", F.explode(found).alias("to")).where("to IS NOT NULL")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and alias_root (smallest address of its aliases, null without any).

    ``pages`` needs page_id, url and html; other columns are ignored.  ``rules`` are (verdict, host, path), as a list or as a
    table (verdict, rule_host, rule_path) of any length.  ``redirects`` (url, to) adds observed redirects.  Precedence: the page's own rule, allow or block; then block, if a rule blocks one of its aliases;
    then allow.  Null or odd URLs have empty host and path, no alias, and are allowed unless a rule fits.  Repeated rows
    have a result each; an empty table gives none.
    """
    edges = links(pages) if redirects is None else links(pages).unionByName(redirects.select("url", "to"))
    edges = saved(edges.select(address(F.col("url")).alias("a"), address(F.col("to")).alias("b")).where("a != b").distinct(), "links")
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    ruled = with_rules(urls, rules, ["page_id", "url"])
    if edges.limit(1).count() == 0:
        fate = F.lit(None).cast("string")
        ruled = ruled.withColumn("alias_root", fate).withColumn("blocked", F.lit(False))
    else:
        roots = saved(components(edges), "aliases")
        # an address is its own host and path, so rules are looked up on it as on a URL
        whole = F.concat(F.lit("http://"), F.col("node"))
        named = with_rules(roots.select("node", "root", host_of(whole).alias("host"), path_of(whole).alias("path")), rules, ["node"])
        worst = named.groupBy("root").agg(F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("blocked"))
        total = roots.count()
        fates = lookup(roots, worst, "root", hot_keys(roots, "root", total), ["node"])
        fates = saved(fates.select(F.col("node").alias("address"), F.col("root").alias("alias_root"), "blocked"), "fates")
        ruled = saved(ruled.withColumn("address", address(F.col("url"))), "urls")
        ruled = lookup(ruled, fates, "address", hot_keys(ruled, "address", ruled.count()), ["page_id", "url"])
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "alias_root")
