"""URL filter with redirect equivalence.

Explicit rules decide first.  Pages without a rule take the verdict of their alias class: the connected
component over redirect and canonical-link edges.  A class with an explicitly allowed member is allowed, otherwise
one with an explicitly blocked member is blocked, otherwise (no rule anywhere) allowed.

Edge cases: a url that is null or has no ``://`` has empty host and path, fits no rule, has no edges and is allowed;
null html has no edges; repeated page ids or urls each keep their row; relative targets are resolved against the page's
url; an unparsable target makes no edge; a target that is no page itself takes its rule and its vote like a page; other input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.workspace import Workspace

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """Host, path and query: what a redirect names; null without a host."""
    node = F.concat(url_host(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1))
    return F.when(url_host(url) != "", node)


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``(host, path)`` -> the longest fitting rule of ``rules(verdict, host, path)``; no row if none fits.

    An equi-join on every parent domain, so any number of rules works and Spark picks the join."""
    parts = F.split("host", r"\.")
    parents = urls.select("host", "path").distinct().withColumn(
        "rule_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    )
    named = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    fit = parents.join(named, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.struct(F.length(rule), F.length("rule_host"), (F.col("verdict") == "allow").cast("int"), rule)
    return fit.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), F.col("verdict").alias("verdict")), best).alias("best")).select("host", "path", "best.rule", "best.verdict")


def _without_dots(path: Column) -> Column:
    """A path from the root without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(F.instr(path, "/.") > 0, F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def resolve(url: Column, to: Column) -> Column:
    """The reference ``to`` as it stands in the page ``url``, with scheme and host; its fragment is of no use here."""
    bare = F.regexp_extract(to, r"^([^#]*)", 1)
    path, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"^[^?]*(.*)$", 1)
    root = F.concat(F.regexp_extract(url, r"^(.*?://)", 1), url_host(url))
    folder = F.concat(F.lit("/"), F.regexp_extract(url_path(url), r"^/(.*/)?[^/]*$", 1))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(root, _without_dots(path), query))
        .when(path != "", F.concat(root, _without_dots(F.concat(folder, path)), query))
        .when(query != "", F.concat(root, url_path(url), query))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``pages(url, html)`` -> ``edges(u, v)`` between url nodes, from canonical links and refresh redirects."""
    tag = lambda name, mark: F.filter(F.regexp_extract_all("html", F.lit(rf"(?is)(<{name}\b[^>]*>)"), 1), lambda t: F.regexp_like(t, F.lit(mark)))
    href = F.transform(tag("link", r"""(?is)\brel\s*=\s*["']?canonical\b"""), lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    jump = F.transform(tag("meta", r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""), lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)""", 1))
    return (
        pages.where("html IS NOT NULL AND instr(url, '://') > 0")
        .where(F.col("html").rlike(r"(?i)canonical|refresh"))
        .select("url", F.explode(F.concat(href, jump)).alias("to"))
        .withColumn("to", F.regexp_replace("to", "(?i)&(amp|#38|#x26);", "&"))
        .select(url_node(F.col("url")).alias("u"), url_node(resolve(F.col("url"), F.col("to"))).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, host, path, rule, verdict.

    ``redirects(source, target)`` are further redirect pairs of urls, as a crawler logs them."""
    spark = pages.sparkSession
    work = Workspace(spark, "urls")
    base = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_node(F.col("url")).alias("node"))
    ruled = base.join(apply_rules(base, rules), ["host", "path"], "left")
    named = F.concat(F.lit("http://"), "node")
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(url_node(F.col("source")), url_node(F.col("target"))))
    member = connected_components(edges, work)
    nodes = member.select("component", url_host(named).alias("host"), url_path(named).alias("path"))
    votes = (
        nodes.join(apply_rules(nodes, rules), ["host", "path"]).groupBy("component")
        .agg(F.max(F.col("verdict") == "allow").alias("allowed"))
    )
    verdicts = member.join(votes, "component").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("class_verdict"))
    return ruled.join(verdicts, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "class_verdict", F.lit("allow")).alias("verdict")
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def op9_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), rule_table(spark))


ORACLE = r"""
WITH RECURSIVE r(verdict, rh, rp) AS (VALUES ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')),
b AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
n AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS node FROM p),
tag AS (SELECT node AS u, host, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM n WHERE node IS NOT NULL),
tgt AS (SELECT u, host, path, CASE WHEN regexp_matches(t, '(?is)^<link') AND regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                        WHEN regexp_matches(t, '(?is)^<meta') AND regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END AS x FROM tag),
ref AS (SELECT u, host, path, x, regexp_extract(x, '^([^?#]*)', 1) AS xp, regexp_extract(regexp_extract(x, '^([^#]*)', 1), '^[^?]*(.*)$', 1) AS xq
        FROM (SELECT u, host, path, regexp_replace(x, '(?i)&(amp|#38|#x26);', '&', 'g') AS x FROM tgt) WHERE x IS NOT NULL AND x <> ''),
raw AS (SELECT *, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN CASE WHEN instr(x, '://') > 0 THEN substr(x, instr(x, '://') + 3) END WHEN starts_with(x, '//') THEN substr(x, 3) END AS far,
          regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*:') OR starts_with(x, '//') AS is_far,
          CASE WHEN starts_with(xp, '/') THEN xp WHEN xp <> '' THEN '/' || regexp_extract(path, '^/(.*/)?[^/]*$', 1) || xp WHEN xq <> '' THEN path END AS near, xp = '' AS same_path FROM ref),
dot AS (SELECT *, list_reduce(list_prepend('', string_split(near, '/')[2:]), lambda acc, s: CASE s WHEN '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || s END) AS bare,
          string_split(near, '/')[-1] IN ('.', '..') AS ends_in_dots FROM raw),
ab AS (SELECT u, CASE WHEN is_far THEN far WHEN near IS NOT NULL THEN host || CASE WHEN same_path OR instr(near, '/.') = 0 THEN near WHEN bare = '' THEN '/' ELSE bare || CASE WHEN ends_in_dots THEN '/' ELSE '' END END || xq END AS y FROM dot),
e AS (SELECT u, translate(regexp_extract(y, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(y, '^[^/?#]*([^#]*)', 1) AS v FROM ab WHERE y IS NOT NULL AND regexp_extract(y, '^([^/?#]*)', 1) <> ''),
e2 AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
place AS (SELECT DISTINCT u AS node, regexp_extract(u, '^([^/?#]*)', 1) AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM e2),
k AS (SELECT host, path, arg_max(rh || rp, (length(rh || rp), length(rh))) AS rule, arg_max(verdict, (length(rh || rp), length(rh))) AS verdict
      FROM (SELECT host, path FROM n UNION SELECT host, path FROM place), r
      WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
reach AS (SELECT u AS a, u AS b FROM e2 UNION SELECT reach.a, e2.v FROM reach JOIN e2 ON reach.b = e2.u),
votes AS (SELECT reach.a, bool_or(k.verdict = 'allow') AS allowed FROM reach JOIN place ON place.node = reach.b JOIN k ON k.host = place.host AND k.path = place.path GROUP BY reach.a)
SELECT n.page_id, n.host, n.path, k.rule, coalesce(k.verdict, CASE WHEN v.allowed THEN 'allow' WHEN NOT v.allowed THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN k ON k.host = n.host AND k.path = n.path LEFT JOIN votes v ON v.a = n.node
"""
