"""Operator 9 [native]: URL filters with redirect equivalence.

Rules name a host (and so its subdomains) and the start of a path; the
longest fitting rule judges a URL.  URLs that lead to each other are aliases:
redirects (a given table, and ``<meta http-equiv=refresh>``), canonical links
(``<link rel=canonical>``), and the redirect that any server makes to a URL's
normal form (scheme, fragment, tracking parameters and last slash aside).
Connected components of that graph (``components``) carry a block decision to
all aliases.  A URL's own rule comes first, so an explicit allow is never
overruled; an alias without a rule is blocked if any URL of its component is
blocked by a rule, else allowed.

DataFrame functions only.  Up to ``MAX_RULES`` given rules are evaluated inside
the row.  More of them, or a table of rules, are joined: a URL meets the rules of
its host's suffixes, by the starts of its path that have such a rule's length.
All other data stay in shuffled tables.  Nodes are MD5 digests of URLs, so hot URLs cost one node.

Defined cases: a null URL, or one without ``://``, has empty host and path,
no rule and no alias, and is allowed; null html has no links; every input
row gives one row, repeats included; an empty table gives none; extra input
columns are not looked at.  Equally long rules: the longer host, then allow.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrisk.llm.common import query, table, written
from carrisk.llm.components import connected_components

MAX_RULES = 1_000
TRACKING = r"(?:utm_[^=&#]*|ref|fbclid|gclid|sessionid|sid)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """The URL a server would redirect to: no scheme, fragment, tracking parameters or last slash."""
    query_part = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query_part, "&"), lambda p: ~p.rlike("^" + TRACKING + "(=.*)?$") & (p != "")), "&")
    path = F.regexp_replace(url_path(url), "/+$", "")
    return F.concat(url_host(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def absolute(href: Column, base: Column) -> Column:
    """``href`` as a whole URL: as it is, under the base's scheme, host, or folder."""
    scheme = F.regexp_extract(base, "^([^:]*):", 1)
    site = F.concat(scheme, F.lit("://"), url_host(base))
    folder = F.regexp_replace(url_path(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (F.when(href.contains("://"), href).when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(site, folder, href)))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = F.regexp_replace(F.regexp_replace(value, r"^\s[^=]*=\s*", ""), r"""^["']|["']$""", "")
    return F.replace(F.trim(value), F.lit("&amp;"), F.lit("&"))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url) of the canonical links and meta refreshes in the pages' html."""
    tags = F.expr(r"regexp_extract_all(__html, '(?i)<(?:link|meta)\\s[^>]*>', 0)")
    tag = (pages.select(F.col(url_col).alias("from_url"), F.col(html_col).alias("__html"))
           .where(F.col("from_url").contains("://") & F.col("__html").rlike(r"(?i)<(?:link|meta)\s[^>]*(?:canonical|refresh)"))
           .select("from_url", F.explode(tags).alias("tag")))
    is_canonical = F.lower(_attribute(F.col("tag"), "rel")) == "canonical"
    is_refresh = F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"
    refresh = F.regexp_replace(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)^[^;,]*[;,]\s*url\s*=\s*(.*)$", 1), r"""^["']|["']$""", "")
    href = F.when(is_canonical, _attribute(F.col("tag"), "href")).when(is_refresh, refresh)
    return tag.select("from_url", href.alias("href")).where("href <> ''").select("from_url", absolute(F.col("href"), F.col("from_url")).alias("to_url"))


def rule_struct(url: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits ``url``; its fields are null where none does."""
    host, path = url_host(url), url_path(url)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow", r[1] + r[2]))
    table_ = F.array(*(F.struct(F.lit(h).alias("h"), F.lit("." + h).alias("dot_h"), F.lit(p).alias("p"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
                       for v, h, p in ordered))
    fits = F.filter(table_, lambda r: ((host == r["h"]) | host.endswith(r["dot_h"])) & path.startswith(r["p"]))
    first = F.try_element_at(fits, F.lit(1))
    return F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict"))


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the distinct ``urls`` (url) that some rule (verdict, host, path) fits: the longest one's.

    A host's rules count by the lengths of their paths, so a URL meets as many rows as its host suffixes have lengths.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))  # allow first
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    host = F.split(F.col("host"), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(host)), lambda i: F.array_join(F.slice(host, i, F.size(host)), "."))
    met = urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("url_path"))
    met = met.select("url", "url_path", F.explode(suffixes).alias("host")).join(lengths, "host")
    starts = F.transform(F.filter("lengths", lambda n: n <= F.length("url_path")), lambda n: F.substring(F.col("url_path"), F.lit(1), n))
    fits = met.select("url", "host", F.explode(starts).alias("path")).join(rules, ["host", "path"])
    rank = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "allow").alias("a"),
                    F.concat("host", "path").alias("rule"), "verdict")
    return fits.groupBy("url").agg(F.max(rank).alias("best")).select("url", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, component (node of its alias group, or null).

    ``rules``: (verdict, host, path).  ``redirects``: further (from_url, to_url).
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame) and len(rules) > MAX_RULES:
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    joined = isinstance(rules, DataFrame)
    if not joined and not rules:
        rules = [("allow", "\0", "\0")]  # fits nothing
    links = link_edges(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url").where("instr(from_url, '://') > 0 and instr(to_url, '://') > 0"))
    links = written(links, "links")
    urls = pages.select(F.col(url_col).alias("url")).where("instr(url, '://') > 0")
    urls = urls.union(links.select("from_url")).union(links.select("to_url")).distinct()
    node = lambda c: F.md5(c.cast("binary"))
    shape = F.concat(F.lit("normal "), normal_form(F.col("url")))  # never equal to a URL with a scheme
    if joined:
        own = written(joined_rules(urls, rules), "url-rules").select(node(F.col("url")).alias("own_node"), F.struct("rule", "verdict").alias("own"))
        urls = urls.join(own, node(F.col("url")) == F.col("own_node"), "left")
        verdict_of_url = F.col("own.verdict")
    else:
        verdict_of_url = rule_struct(F.col("url"), rules)["verdict"]
    nodes = written(urls.select(node(F.col("url")).alias("node"), node(shape).alias("normal"), verdict_of_url.alias("own")), "urls")
    edges = (nodes.select(F.col("node").alias("src"), F.col("normal").alias("dst"))
             .unionByName(links.select(node(F.col("from_url")).alias("src"), node(F.col("to_url")).alias("dst"))))
    parts = written(connected_components(edges), "url-components")
    blocked = (nodes.where("own = 'block'").join(parts, "node").select("component").distinct().withColumn("hit", F.lit(True)))
    member = parts.join(blocked, "component", "left").select("node", "component", "hit")
    page = pages.select(F.col(id_col), F.col(url_col).alias("__url")).select(
        id_col, url_host(F.col("__url")).alias("host"), url_path(F.col("__url")).alias("path"),
        *([] if joined else [rule_struct(F.col("__url"), rules).alias("own")]), F.when(F.col("__url").contains("://"), node(F.col("__url"))).alias("node"))
    if joined:
        page = page.join(own, F.col("node") == F.col("own_node"), "left")
    verdict = F.coalesce("own.verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return page.join(member, "node", "left").select(id_col, "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "component")


# The rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)
