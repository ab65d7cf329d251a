"""URL filters: longest-match rules, and decisions that aliases share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.shared import ascii_lower, written


@dataclass(frozen=True)
class Rule:
    """`where` is a host and a path, as in example.net/en/; it holds for all subdomains too."""

    where: str
    action: str

    @property
    def host(self) -> str:
        return self.where.partition("/")[0]

    @property
    def path(self) -> str:
        return self.where[len(self.host) :]


# The rules of the query.
RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)

_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_TARGET = r"(?is)\burl\s*=\s*['\"]?([^'\">\s]+)"
_TRACKING = r"(?:utm_[^=&]*|gclid|fbclid|ref)(?:=[^&]*)?(?:&|$)"
_ONWARD = r"[?&](?:url|redirect|redirect_url|target|dest)=(https?(?::|%3[Aa])[^&#]*)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def fitting(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null if none does."""
    where, action = F, F
    for rule in sorted(rules, key=lambda r: -len(r.where)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        where, action = where.when(fits, rule.where), action.when(fits, rule.action)
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return where, action


def normal_form(url: Column) -> Column:
    """One spelling for URLs that name the same page: no scheme, fragment, tracking or last slash."""
    rest = F.regexp_extract(_after_scheme(url), r"^[^/?#]*[^?#]*(?:\?([^#]*))?", 1)
    query = F.regexp_replace(F.regexp_replace(rest, r"(?<![^&])" + _TRACKING, ""), r"&$", "")
    plain = F.concat(host_of(url), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(
        F.instr(url, "://") > 0, F.when(query != "", F.concat(plain, F.lit("?"), query)).otherwise(plain)
    )


def _absolute(link: Column, url: Column) -> Column:
    """A link of a page as a URL with scheme and host; null if there is none."""
    scheme = F.substring_index(url, "://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    link = F.trim(link)
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.instr(url, "://") == 0, None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#"), None)
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(source, target): URLs that pages name as their canonical form or send readers on to.

    A target whose escapes are malformed is no edge.
    """
    url, html = F.col("url"), F.col("html")
    link = F.regexp_extract(html, _LINK, 0)
    href = F.concat(*[F.regexp_extract(link, _HREF, i) for i in (1, 2, 3)])
    canonical = F.when(F.contains(F.lower(html), F.lit("canonical")), _absolute(href, url))
    to = F.regexp_extract(F.regexp_extract(html, _REFRESH, 0), _TARGET, 1)
    refresh = F.when(F.contains(F.lower(html), F.lit("http-equiv")), _absolute(to, url))
    onward = F.when(url.rlike(_ONWARD), F.try_url_decode(F.regexp_extract(url, _ONWARD, 1)))
    return pages.select(
        url.alias("source"), F.explode(F.array_compact(F.array(canonical, refresh, onward))).alias("target")
    )


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict, component, reason) for every row of `pages`.

    The longest rule that fits a page's own URL decides. Else the page shares the
    decision of its aliases: pages that redirects (rows source, target) or their own
    canonical and refresh links connect, directly or not, and spellings with one
    normal form. Among aliases an allow rule outweighs any block rule; without
    either the page is allowed. `component` is the smallest normal form of the aliases.

    A null URL or one without :// has an empty host and path and no aliases. Repeated
    rows are each judged. Pages without html have no links. An empty table gives no rows.
    Columns of `pages` other than page_id, url and html are not looked at.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, action = fitting(F.col("host"), F.col("path"), rules)
    own = (
        pages.select("page_id", "url", host.alias("host"), path.alias("path"))
        .withColumn("node", normal_form(F.col("url")))
        .withColumns({"rule": rule, "action": action})
        .drop("url")
    )
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = written(edges.where("source is not null and target is not null").distinct(), "url-edges")
    linked = components(
        edges.select(normal_form(F.col("source")).alias("a"), normal_form(F.col("target")).alias("b"))
    )
    # every URL that carries a decision: pages' own and those that links lead to
    named = edges.select(F.explode(F.array("source", "target")).alias("url"))
    named = named.select(
        normal_form(F.col("url")).alias("node"),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
    ).withColumn("action", action)
    decided = (
        own.select("node", "action")
        .unionByName(named.select("node", "action"))
        .where("node is not null and action is not null")
        .distinct()
    )
    shared = (
        decided.join(linked, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("root"))
        .agg(F.bool_or(F.col("action") == "allow").alias("any_allow"))
    )
    rooted = own.join(linked, "node", "left").withColumn("root", F.coalesce("component", "node"))
    by_alias = F.when(F.col("any_allow"), "allow").otherwise("block")
    return rooted.drop("component").join(shared, "root", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(F.col("any_allow").isNotNull(), by_alias), F.lit("allow")).alias(
            "verdict"
        ),
        F.col("root").alias("component"),
        F.when(F.col("rule").isNotNull(), "rule")
        .when(F.col("any_allow").isNotNull(), "alias")
        .otherwise("default")
        .alias("reason"),
    )
