"""URL filters: the longest rule decides; without one, a page shares its aliases' decision.

Pages that redirect to each other or name each other as canonical are one resource. Edges
come from the pages' HTML (canonical links, refresh redirects) and from a table of
redirects, if there is one. Connected components over them carry a block to every alias,
unless some alias is explicitly allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from revsync.llm.common import LOWER, UPPER, components, stage


@dataclass(frozen=True)
class UrlRule:
    """`host` and its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Query parameters that say where a visitor came from, not what the page is.
TRACKING = ["utm_[^=&]*", "ref", "fbclid", "gclid", "mc_[^=&]*"]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_DOTS = r"(^|/)\.\.?(/|$)"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'>\s]+)"
_TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def address(url: Column) -> Column:
    """What a URL names: host, path and query without tracking, whatever the scheme and the
    fragment; null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 3)
    kept = F.regexp_replace(query, rf"(^|&)({'|'.join(TRACKING)})(=[^&]*)?(?=&|$)", "")
    kept = F.regexp_replace(kept, r"^&+", "")
    where = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    full = F.concat(host(url), where, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    return F.when(host(url) != "", full)


def matched(h: Column, p: Column, rules: list[UrlRule]) -> Column:
    """(name, verdict) of the longest rule that fits; of equally long ones the first listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((h == r.host) | h.endswith("." + r.host)) & p.startswith(r.path)
        found = F.when(
            fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        ).otherwise(found)
    return found


def _targets(html: str, tag: str, to: str) -> Column:
    """What `to` finds in each of the tags."""
    tags = F.regexp_extract_all(html, F.lit(tag), F.lit(0))
    return F.transform(tags, lambda t: F.regexp_extract(t, to, 1))


def _decoded(target: Column) -> Column:
    """A target without the entities of / and &."""
    slashes = F.regexp_replace(target, r"(?i)&#0*47;|&#x0*2f;|&sol;", "/")
    return F.regexp_replace(slashes, r"(?i)&#0*38;|&#x0*26;|&amp;", "&")


def _without_dots(p: Column) -> Column:
    """A path from the root with its segments . and .. resolved; above the root is the root."""
    segments = F.split(F.substring(p, 2, 1 << 30), "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))
        .when(s == ".", out)
        .otherwise(F.array_append(out, s)),
    )
    folder = F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, F.lit("/")).otherwise(F.lit("")))


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b): the URLs of pages and the canonical and refresh targets that their HTML names.

    Every such tag counts. A target is resolved against its page's URL, dot segments and
    entities for & and / included; a fragment or another scheme's address names no page.
    """
    marked = pages.where(F.col(url).isNotNull()).where(
        F.col(html).rlike(r"(?i)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh")
    )
    targets = [_targets(html, tag, to) for tag, to in ((_LINK, _HREF), (_REFRESH, _TARGET))]
    named = marked.select(F.col(url).alias("a"), F.explode(F.transform(F.concat(*targets), _decoded)).alias("to"))
    other = F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?!//)")  # mailto: and the like
    named = named.where((F.col("to") != "") & ~F.col("to").startswith("#") & ~other)
    site = F.regexp_extract("a", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path(F.col("a")), r"[^/]*$", "")
    full = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(site, "to"))
        .when(F.col("to").startswith("?"), F.concat(site, path(F.col("a")), "to"))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), "to"))
    )
    named = named.select("a", full.alias("b"))
    head, tail = F.regexp_extract("b", r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract("b", r"(?s)^[^?#]*(.*)$", 1)
    plain = F.concat(head, _without_dots(path(F.col("b"))), tail)
    return named.select("a", F.when(path(F.col("b")).rlike(_DOTS), plain).otherwise(F.col("b")).alias("b"))


def judge(
    pages: DataFrame,
    rules: list[UrlRule],
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """Per row of `pages`: its id, host, path, rule, verdict.

    `redirects` has the URLs `a` and `b` of each redirect. A URL that is null or has no ://
    has an empty host and path, fits no rule and has no aliases; its verdict is allow. An
    alias takes part whether or not it was crawled. Repeated rows get the same result each.
    """
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.unionAll(redirects.select("a", "b"))
    edges = stage(
        edges.select(
            F.struct(address(F.col("a")).alias("k"), host(F.col("a")).alias("h"), path(F.col("a")).alias("p")).alias("a"),
            F.struct(address(F.col("b")).alias("k"), host(F.col("b")).alias("h"), path(F.col("b")).alias("p")).alias("b"),
        ).where("a.k is not null and b.k is not null"),
        "url-edges",
    )
    groups = components(edges.select(F.col("a.k").alias("a"), F.col("b.k").alias("b")), "a", "b")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("n")).select("n.*").distinct()
    judged = nodes.select(
        F.col("k").alias("node"), matched(F.col("h"), F.col("p"), rules)["verdict"].alias("v")
    ).join(groups, "node")
    decided = judged.groupBy("component").agg(
        F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked")
    )
    blocked = stage(
        groups.join(
            decided.where(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))),
            "component", "left_semi",
        ).select(F.col("node").alias("k"), F.lit("block").alias("aliased")),
        "url-blocked",
    )
    u = F.col(url)
    rows = pages.select(
        F.col(page_id).alias("page_id"), host(u).alias("host"), path(u).alias("path"), address(u).alias("k")
    )
    rows = rows.withColumn("m", matched(F.col("host"), F.col("path"), rules))
    return rows.join(blocked, "k", "left").select(
        F.col("page_id").alias(page_id), "host", "path", F.col("m.rule").alias("rule"),
        F.coalesce("m.verdict", "aliased", F.lit("allow")).alias("verdict"),
    )
