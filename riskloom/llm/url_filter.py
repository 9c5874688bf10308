"""URL filter rules with redirect equivalence. DataFrame functions only.

A rule is (verdict, host, path): it fits its host and all subdomains if the url's path starts with the rule's path; the
longest rule wins (allow before block on equal length). Urls that no rule fits get the verdict of their aliases:
connected components over redirect edges (``<meta http-equiv=refresh>``, and a table of redirects if there is one) and
canonical-link edges. A component with an explicitly blocked url blocks its unruled members, unless it also holds an
explicitly allowed url: allow has precedence. Without either, the verdict is allow.

Rules up to LITERAL_RULES are part of the expression. More are joined by host suffix: every url gives its suffixes, and
distinct (host, path) pairs are judged once.

Defined results: null urls and urls without ``://`` have empty host and path, so no rule fits, and are nobody's alias;
null html has no links; repeated rows get a row each; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import scratch
from riskloom.llm.components import components

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LITERAL_RULES = 200
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (with host and path) and ``rule``: struct(name, verdict) of the longest rule that fits, or null."""
    best = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[0]))
    if len(best) <= LITERAL_RULES:
        fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        one = lambda v, h, p: F.when(fits(h, p), F.struct(F.lit(h + p).alias("name"), F.lit(v).alias("verdict")))
        none = F.lit(None).cast("struct<name:string,verdict:string>")
        return pages.withColumn("rule", F.coalesce(*[one(*r) for r in best], none))
    table = pages.sparkSession.createDataFrame([(v, h, p) for v, h, p in best], "verdict string, rule_host string, rule_path string")
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = pages.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    found = (
        urls.join(table, "rule_host").where("startswith(path, rule_path)")
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length(F.concat("rule_host", "rule_path"))).alias("l"), "verdict", F.concat("rule_host", "rule_path").alias("name"))).alias("r"))
        .select("host", "path", F.struct("r.name", "r.verdict").alias("rule"))
    )
    return pages.join(scratch.stage(found, "url-rules"), ["host", "path"], "left")


def node(url: Column) -> Column:
    """A url without scheme and fragment, its host lower-cased; null without ``://``."""
    rest = F.regexp_extract(after_scheme(url), "^[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of a page and of the url that its canonical link or refresh names."""
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = lambda pattern: F.regexp_extract(html, pattern, 0)
    href = lambda t, name: F.regexp_extract(t, f"(?i)\\b{name}\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)", 1)
    canonical = href(tag("(?i)<link\\b[^>]*\\brel\\s*=\\s*[\"']?canonical\\b[^>]*>"), "href")
    refresh = href(tag("(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>"), "url")
    names = F.array(F.when(html.rlike("(?i)canonical"), canonical), F.when(html.rlike("(?i)refresh"), refresh))
    linked = pages.where(F.instr("url", "://") > 0).select("url", F.explode(F.filter(names, lambda x: x.isNotNull() & (x != ""))).alias("to"))
    scheme = F.substring_index("url", "://", 1)
    to = F.col("to")
    absolute = (
        F.when(F.instr(to, "://") > 0, to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(scheme, F.lit("://"), host_of(F.col("url")), to))
        .otherwise(F.concat(scheme, F.lit("://"), host_of(F.col("url")), F.regexp_replace(F.concat(path_of(F.col("url"))), "[^/]*$", ""), to))
    )
    return linked.select(node(F.col("url")).alias("a"), node(absolute).alias("b"))


def verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; ``redirects`` adds (from_url, to_url) edges."""
    url = F.col("url")
    ruled = judged(pages.select("page_id", "url", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path")), rules)
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")))
    edges = scratch.stage(edges.where("a is not null and b is not null"), "url-edges")
    own = F.col("rule.verdict")
    if edges.isEmpty():
        verdict = F.coalesce(own, F.lit("allow"))
        return ruled.select("page_id", "host", "path", F.col("rule.name").alias("rule"), verdict.alias("verdict"))
    members = components(edges)
    known = judged(members.withColumn("host", F.regexp_extract("node", "^[^/?#]*", 0)).withColumn("path", F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1)), rules)
    blocked = (
        known.groupBy("component")
        .agg(F.bool_or(F.coalesce(own == "block", F.lit(False))).alias("b"), F.bool_or(F.coalesce(own == "allow", F.lit(False))).alias("a"))
        .where("b and not a").select("component")
    )
    aliases = scratch.stage(members.join(scratch.stage(blocked, "url-blocked"), "component").select("node", F.lit("block").alias("alias")), "url-aliases")
    out = ruled.withColumn("node", F.coalesce(node(url), F.lit(""))).join(aliases, "node", "left")
    return out.select("page_id", "host", "path", F.col("rule.name").alias("rule"), F.coalesce(own, "alias", F.lit("allow")).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages without links between urls, where a page that no rule fits has no aliases: the method's verdict is allow.
OP8_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM h
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
