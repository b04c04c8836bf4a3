"""URL filter: host and path rules, and decisions carried over redirect and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelift.llm.catalog import query, table
from panelift.llm.components import connected_components

#: (verdict, host, path) of the production rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Query parameters that only track where a visitor came from.
TRACKING = r"(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?\s*[0-9.]*\s*;\s*url\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    for verdict, domain, prefix in reversed(ordered):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def address(url: Column) -> Column:
    """The name under which a URL is a node: no scheme, fragment, default port or tracking parameters.

    Null when there is no host.
    """
    asked = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    asked = F.regexp_replace(F.regexp_replace(asked, TRACKING, ""), "^&", "")
    site = F.regexp_replace(host(url), ":(80|443)$", "")
    way = F.when(path(url) == "", "/").otherwise(path(url))
    return F.when(site != "", F.concat(site, way, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise("")))


def absolute(base: Column, link: Column) -> Column:
    """``link`` as seen from the page ``base``: absolute, ``//host``, ``/path`` or relative to the folder."""
    link = F.regexp_replace(link, "&amp;", "&")
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    site = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*(?:/(?:[^?#/]*/)*)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(site != "", F.concat(folder, link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): every canonical link and every refresh redirect that a page's html names."""
    text = F.coalesce(F.col(html), F.lit(""))
    found = F.concat(F.regexp_extract_all(text, F.lit(CANONICAL), 1), F.regexp_extract_all(text, F.lit(REFRESH), 1))
    links = pages.select(F.col(url).alias("source"), F.explode(found).alias("link")).where("link <> ''")
    return links.select("source", absolute(F.col("source"), F.col("link")).alias("target"))


def judge(pages: DataFrame, links: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict (columns of these names are replaced).

    A rule's verdict stands. A URL without a rule takes part in the component of its address over
    ``links`` (source, target; both directions): it is allowed if any address there is allowed by a
    rule, else blocked if any is blocked, else allowed. Targets that are no pages are judged as well.
    Null URLs, and those without host, are allowed. Repeated pages and links change nothing.
    """
    ends = links.select(F.col("source").alias("x"), F.col("target").alias("y"))
    edges = ends.select(address(F.col("x")).alias("a"), address(F.col("y")).alias("b"))
    labels = connected_components(edges.where("a <> b"))
    named = ends.select(F.explode(F.array("x", "y")).alias("u")).unionByName(pages.select(F.col(url).alias("u")))
    ruled = named.select(address(F.col("u")).alias("node"), longest_rule(host(F.col("u")), path(F.col("u")), rules)["verdict"].alias("v"))
    by_node = ruled.where("node is not null and v is not null").groupBy("node").agg(
        F.bool_or(F.col("v") == "allow").alias("allowed"), F.bool_or(F.col("v") == "block").alias("blocked")
    )
    by_label = labels.join(by_node, "node").groupBy("label").agg(F.bool_or("allowed").alias("allowed"), F.bool_or("blocked").alias("blocked"))
    carried = labels.join(by_label, "label").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("_carried"))
    h, p = host(F.col(url)), path(F.col(url))
    rule = longest_rule(h, p, rules)
    judged = pages.withColumns({"_node": address(F.col(url)), "_rule": rule, "host": h, "path": p})
    judged = judged.join(carried.withColumnRenamed("node", "_node"), "_node", "left")
    return judged.withColumns(
        {"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", "_carried", F.lit("allow"))}
    ).drop("_node", "_rule", "_carried")


SQL = r"""
with p as (
  select page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rule, verdict, h, q) as (values ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
fits as (
  select page_id, url, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by all),
linked as (
  select p.*, regexp_matches(coalesce(html, ''), '(?is)<link[^>]*rel\s*=\s*["'']?canonical|<meta[^>]*http-equiv\s*=\s*["'']?refresh') as has_link from p)
select l.page_id, l.host, l.path, f.rule, coalesce(f.verdict, case when has_link then 'unknown' else 'allow' end) as verdict
from linked l left join fits f on f.page_id is not distinct from l.page_id and f.url is not distinct from l.url
"""


@query("op10_url_filters", SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, host, path, rule and verdict for every page."""
    pages = table(spark, folder, "pages")
    judged = judge(pages.select("page_id", "url"), page_links(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")
