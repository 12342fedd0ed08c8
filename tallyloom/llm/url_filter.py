"""URL filter with redirect equivalence.

Rules of host and path decide a url directly. Redirect and canonical-link edges make
aliases: the urls of one connected component. A url that no rule fits is blocked if any
url of its component, page or mere link target, fits a block rule. An explicit allow takes
precedence: a url under an allow rule stays allowed whatever its aliases are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Written
from tallyloom.llm.components import connected_components


class Rule(NamedTuple):
    verdict: str  # "allow" or "block"
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: HTML that names another address of the same page.
LINK_TAG = r"(?is)<link\s[^>]*?>"
META_TAG = r"(?is)<meta\s[^>]*?>"
HREF = r"""(?is)\shref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)content\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*['"]?([^"'\s>]+)"""
CANONICAL = r"""(?is)\srel\s*=\s*["']?[^"'>]*\bcanonical\b"""
BASE_HREF = r"""(?is)<base\s[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
#: References to characters; the ampersand's stays last.
NAMED = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
NUMBERED = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"
IS_REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?refresh\b"""


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, else null. Rules are a bounded list, compiled into one CASE."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def address(url: Column) -> Column:
    """A url without its fragment, scheme and host in lower case: the node of the alias graph."""
    return F.concat(_ascii_lower(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def _without_dots(path: Column) -> Column:
    """A path that starts with / without its segments . and .. (RFC 3986, 5.2.4)."""
    parts = F.split(path, "/")
    step = lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x)))
    held = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(held, "/"), F.when(path.rlike(r"/\.\.?$") & (F.size(held) > 0), "/").otherwise(""))


def resolve(url: Column, to: Column) -> Column:
    """The full address that a reference on the page url means; null for schemes without ://, such as mailto."""
    origin, scheme = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    path, tail = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(url_path(url), r"(?s)^(.*/)", 1)
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("#"), url)
        .when(path == "", F.concat(origin, url_path(url), tail))
        .otherwise(F.concat(origin, _without_dots(merged), tail))
    )


def plain_text(c: Column) -> Column:
    """An attribute's value with its character references put right; numbers outside Unicode stay."""
    digits = lambda e: F.regexp_extract(e, r"([0-9a-fA-F]+);", 1)
    code = lambda e: F.when(e.rlike(r"^&#[xX]"), F.conv(digits(e), 16, 10)).otherwise(digits(e)).cast("bigint")
    char = lambda e: F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32")
    known = lambda e: (code(e) > 0) & ((code(e) < 0xD800) | (code(e) > 0xDFFF) & (code(e) < 0x110000))
    numbered = F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBERED), 0)), known)
    out = F.aggregate(numbered, c, lambda held, e: F.replace(held, e, char(e)))
    for name, text in NAMED:
        out = F.replace(out, F.lit(name), F.lit(text))
    return out


def alias_edges(pages: DataFrame) -> DataFrame:
    """src, dst addresses: targets of canonical links and refresh redirects, relative ones resolved against <base> or the page's url."""
    html = F.col("html")
    links = F.transform(F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG), 0), lambda t: t.rlike(CANONICAL)), lambda t: F.regexp_extract(t, HREF, 1))
    metas = F.transform(F.filter(F.regexp_extract_all(html, F.lit(META_TAG), 0), lambda t: t.rlike(IS_REFRESH)), lambda t: F.regexp_extract(t, REFRESH, 1))
    may = html.rlike(r"(?i)canonical|http-equiv")
    # each step is below a generator, so that no expression is copied into all the places that use it
    one = lambda c, name: F.explode(F.array(c)).alias(name)
    held = pages.where(may & F.col("url").contains("://")).select("url", one(plain_text(F.regexp_extract(html, BASE_HREF, 1)), "base"), F.array_distinct(F.concat(links, metas)).alias("links"))
    held = held.where(F.size("links") > 0).select("url", "links", one(F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolve(F.col("url"), F.col("base")), F.col("url"))), "base"))
    named = held.select("url", "base", F.explode(F.transform("links", plain_text)).alias("to"))
    full = named.select(address(F.col("url")).alias("src"), one(resolve(F.col("base"), F.col("to")), "to"))
    return full.select("src", one(address(F.col("to")), "dst")).where("dst <> '' AND src <> dst")


def judge_urls(pages: DataFrame, rules: list[Rule], *, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of for every row of pages (page_id, url, html).

    redirects: further pairs of urls (src, dst), such as crawl logs have. Null or odd urls have
    empty host and path, fit no rule and are allowed; null html has no edges; repeated rows are
    judged alike; urls and html of any length are read whole; an empty table gives no rows; columns other than those named are not read.
    alias_of is the smallest address of the component, null where a page has no alias.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")))
    kept = Written(edges.distinct(), "aliases")
    slim = pages.select("page_id", "url")
    judged = slim.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url"))).withColumn("_found", longest_rule(F.col("host"), F.col("path"), rules))
    own = judged.select("page_id", "host", "path", F.col("_found.rule").alias("rule"), F.col("_found.verdict").alias("_own"), address(F.col("url")).alias("_at"))
    if kept.df.isEmpty():
        return own.select("page_id", "host", "path", "rule", F.coalesce("_own", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_of"))
    comp = connected_components(kept.df, "src", "dst")
    ruled = comp.withColumn("_verdict", longest_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"])
    blocked = ruled.groupBy("component").agg(F.bool_or(F.coalesce(F.col("_verdict") == "block", F.lit(False))).alias("_blocked"))
    # written sides, so that a component with very many urls, or a url with very many rows, is split by Spark's skew join
    spread = Written(comp.join(Written(blocked, "blocked").df, "component").select(F.col("node").alias("_at"), F.col("component").alias("alias_of"), "_blocked"), "spread").df
    return own.join(spread, "_at", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("_own", F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"), "alias_of",
    )
