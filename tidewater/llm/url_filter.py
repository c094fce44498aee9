"""URL rules with redirect equivalence: a block reaches every alias of a blocked URL.

A rule has a host and a path; it fits the host and its subdomains where the URL's path starts with the
rule's, and the longest that fits decides. URLs that no rule fits are judged by what they are aliases of: redirects
and canonical links are edges between URLs, the connected components of these are found by Spark, and
a component with a blocked URL, be it in the table or only linked to, blocks its members. An explicit
allow of a URL takes precedence over a block that comes from an alias.

All of it is DataFrame functions. Hosts are few beside pages, so rules meet the distinct hosts; a host, a URL or a
link's target with a third of all rows is split by Spark in its joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, plainly, split_join, stash

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What is no markup: comments and elements whose content is text; an open one goes to the end.
SILENT = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template)\b.*?(?:</\1\s*>|\z)"
TAGS = r"(?i)(<(?:link|meta)\s[^<>]*>)"
ATTRIBUTES = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>=`]+))?"""
#: The target in a refresh: seconds, a separator, and the URL with or without a name and quotes.
REFRESH = r"""(?i)^\s*[0-9.]+\s*[;,]\s*(?:url\s*=\s*)?["']?\s*([^"']*)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) of pairs like ``("block", "example.com/de/")``."""
    rows = [(*rule.partition("/")[::2], verdict) for verdict, rule in rules]
    return spark.createDataFrame([(h.lower(), f"/{p}", v) for h, p, v in rows], "host string, path string, verdict string")


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and ``_rules``: those of the host and of the domains it is in, the longest first; hosts without rules are left out.

    Among rules of one length, the longer host comes first, and an allow before a block. The rules that fit one host are held together.
    """
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    within = hosts.select("host", F.explode(domains).alias("domain"))
    found = split_join(within, rules.select(F.col("host").alias("domain"), "path", "verdict").distinct(), ["domain"])
    order = F.struct((-F.length("domain") - F.length("path")).alias("size"), (-F.length("domain")).alias("of"), (F.col("verdict") != ALLOW).alias("late"), F.concat("domain", "path").alias("rule"), "path", "verdict")
    return found.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("_rules"))


def ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with host and path) and ``rule``, ``by_rule``: the longest rule that fits and its verdict, or nulls."""
    known = rules_of_hosts(rows.select("host").distinct(), rules)
    fits = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return split_join(rows, known, ["host"], "left").withColumn("_rule", fits).select(*rows.columns, F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("by_rule"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _walked(path: Column) -> Column:
    """A path without dot segments; it never leaves the root."""
    up = lambda seen: F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(1)))
    segments = lambda parts: F.aggregate(parts, F.array().cast("array<string>"), lambda seen, p: F.when(p == "..", up(seen)).when(p == ".", seen).otherwise(F.concat(seen, F.array(p))))
    open_end = lambda parts: F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise("")
    return _let(F.split(path, "/"), lambda parts: F.concat(F.array_join(segments(parts), "/"), open_end(parts)))


def canonical_form(url: Column) -> Column:
    """The URL as a node: without fragment, scheme and host in lower case, ``/`` for an empty path, dot segments resolved; null without ``://``."""

    def form(bare: Column) -> Column:
        origin = F.translate(F.regexp_extract(bare, r"^((?s:.*?)://[^/?]*)", 1), UPPER, LOWER)
        path = _let(F.regexp_extract(bare, r"^(?s:.*?)://[^/?]*([^?]*)", 1), lambda p: F.when(p == "", "/").when(F.contains(p, F.lit("/.")), _walked(p)).otherwise(p))
        return F.when(F.contains(bare, F.lit("://")), F.concat(origin, path, F.regexp_extract(bare, r"(\?(?s:.*))$", 1)))

    return _let(F.regexp_replace(url, r"(?s)#.*", ""), form)


def resolved(link: Column, base: Column) -> Column:
    """The absolute URL that a link in the page ``base`` means; null for other schemes, empty links and fragments of the page itself."""
    scheme, origin = F.regexp_extract(base, r"^((?s:.*?):)//", 1), F.regexp_extract(base, r"^((?s:.*?)://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(base, r"^(?s:.*?)://[^/?#]*(/(?:[^?#]*/)?)", 1), F.lit("")), F.lit("/"))

    def form(to: Column) -> Column:
        relative = F.when(F.startswith(to, F.lit("//")), F.concat(scheme, to)).when(F.startswith(to, F.lit("/")), F.concat(origin, to)).when(F.startswith(to, F.lit("?")), F.concat(origin, path_of(base), to)).otherwise(F.concat(origin, folder, to))
        absolute = F.rlike(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://"))
        nothing = (to == "") | F.startswith(to, F.lit("#")) | F.rlike(to, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:"))
        return F.when(absolute, to).when(~nothing & F.contains(base, F.lit("://")), relative)

    return _let(F.regexp_replace(F.btrim(link, F.lit(" \t\n\r\f")), "&(?:amp|#38|#[xX]26);", "&"), form)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): each page's URL and the canonical link or refresh target in its markup, as nodes.

    Tags in comments, scripts, styles, titles and templates don't count. All canonical links of a page count; a ``base`` element isn't followed.
    """
    rows = pages.where(F.rlike(html_col, F.lit("(?i)canonical|http-equiv"))).select(F.col(url_col).alias("url"), F.regexp_replace(html_col, SILENT, " ").alias("html"))
    tags = rows.select("url", F.explode(F.regexp_extract_all("html", F.lit(TAGS), 1)).alias("tag"))
    inside = F.substr("tag", F.lit(6))  # after "<link" or "<meta"
    bare = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTES), 2), lambda v: F.regexp_replace(v, r"""^["']|["']$""", ""))
    tags = tags.select("url", F.lower(F.substr("tag", F.lit(2), F.lit(4))).alias("kind"), F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTES), 1), F.lower).alias("names"), bare.alias("values"))
    value = lambda name: F.get("values", F.array_position("names", F.lit(name)).cast("int") - 1)  # noqa: E731  the first of a name counts
    canonical = F.when((F.col("kind") == "link") & F.array_contains(F.split(F.lower(value("rel")), r"\s+"), "canonical"), value("href"))
    refresh = F.when((F.col("kind") == "meta") & (F.lower(F.trim(value("http-equiv"))) == "refresh"), F.nullif(F.regexp_extract(value("content"), REFRESH, 1), F.lit("")))
    linked = tags.select("url", F.coalesce(canonical, refresh).alias("link")).where("link is not null")
    return as_edges(linked.select("url", resolved(F.col("link"), F.col("url")).alias("target")), "url", "target")


def as_edges(table: DataFrame, source: str, target: str) -> DataFrame:
    """(a, b) of a table of redirects; rows without a whole URL on both sides, and from a node to itself, give none."""
    return table.select(canonical_form(F.col(source)).alias("a"), canonical_form(F.col(target)).alias("b")).where("a <> b").distinct()


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, alias_of): the URLs of components with a blocked one, and the smallest of these."""
    roots = components(edges, hot=True)
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).distinct()
    nodes = stash(nodes, "aliases")
    judged = ruled(nodes.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    blocked = judged.where(F.col("by_rule") == BLOCK).groupBy("root").agg(F.min("node").alias("alias_of"))
    return split_join(nodes, blocked, ["root"]).select("node", "alias_of")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, host, path, rule, verdict and ``alias_of`` (the blocked URL that an unruled page is an alias of, or null).

    ``rules``: host, path, verdict (allow or block); ``redirects``: optional further edges (source, target), say of a crawl's log.
    A page that no rule fits is blocked if an alias is, else allowed. Null URLs and URLs without ``://`` have an empty host and path
    and are allowed; an empty host takes part in no rule and a null html in no link. Repeated rows are rows like others; an empty table gives no rows.
    """
    plain, (own, url, html) = plainly(pages, id_col, url_col, html_col)
    edges = link_edges(plain, url, html)
    if redirects is not None:
        edges = edges.unionByName(as_edges(redirects, "source", "target")).distinct()
    rows = plain.select(F.col(own).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical_form(F.col(url)).alias("node"))
    judged = split_join(ruled(rows, rules), blocked_aliases(edges, rules), ["node"], "left")
    open_alias = F.when(F.col("rule").isNull(), F.col("alias_of"))
    verdict = F.coalesce("by_rule", F.when(open_alias.isNotNull(), BLOCK).otherwise(ALLOW))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), open_alias.alias("alias_of"))


#: The rules of the query.
RULES = [(BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/")]


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages by the four rules, and by the links in their markup where none fits; null URLs are allowed."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark, RULES))


#: Links in SQL: those of absolute URLs, canonical or by refresh; reached over any number of them.
ORACLE = r"""
with recursive pages_of as materialized (
    select row_number() over () as r, page_id, url, html, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path, regexp_replace(url, '#.*', '') as node from pages),
rules as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(of, start, says)),
tags as (select node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>', '', 'g'), '(?i)<(?:link|meta)\s[^<>]*>')) as tag from pages_of),
links as materialized (
    select node as a, regexp_replace(regexp_extract(tag, '(?i)(?:href="|url=)(\w+://[^"#]+)', 1), '#.*', '') as b from tags
    where regexp_matches(tag, '(?i)rel="?canonical|http-equiv="?refresh') and regexp_matches(tag, '(?i)(?:href="|url=)\w+://')),
edges as (select a, b from links union select b, a from links),
reached(a, b) as (select a, b from edges union select r.a, e.b from reached r join edges e on r.b = e.a),
nodes as (select b, translate(regexp_extract(b, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(b, '://[^/?#]*([^?#]*)', 1) as path from (select distinct b from edges)),
judged as (select b, arg_max(says, length(of) + length(start)) as says from nodes join rules on (host = of or ends_with(host, '.' || of)) and starts_with(path, start) group by b),
blocked as (select r.a as node, min(j.b) as alias_of from reached r join judged j on r.b = j.b and says = 'block' group by 1),
best as (
    select p.r, p.page_id, p.url, p.host, p.path, p.node, arg_max(of || start, length(of) + length(start)) as rule, arg_max(says, length(of) + length(start)) as says
    from pages_of p left join rules on (host = of or ends_with(host, '.' || of)) and starts_with(path, start) group by all)
select page_id, host, path, rule, coalesce(says, case when alias_of is not null then 'block' else 'allow' end) as verdict, case when rule is null then alias_of end as alias_of
from best left join blocked using (node)
"""
