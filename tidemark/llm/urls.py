"""URL filters: host and path rules, and redirect equivalence.

Redirects and canonical links join URLs into classes of aliases. A class with a member that a rule allows is allowed;
else, with a member that a rule blocks, it is blocked; else allowed. A URL's own rule comes before its class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains, if the path starts with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is no ://."""
    host = F.regexp_extract(url, r"(?s)^(?:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, common.UPPER, common.LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Equally long rules: one that allows, then by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What a URL is called in the class of its aliases: host, path and query. Scheme and fragment do not count."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path_of(url), query))


def resolve(page: Column, target: Column) -> Column:
    """A link's target as a full URL, by the page that holds it. An empty target is the page."""
    site = F.concat(F.lit("http://"), host_of(page))
    folder = F.regexp_replace(F.when(path_of(page) == "", F.lit("/")).otherwise(path_of(page)), r"(?<![^/])[^/]*+$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target == "", page)
        .otherwise(F.concat(site, folder, target))
    )


#: A quoted value, in either kind of quotes.
_QUOTED = "\"[^\"]*+\"|'[^']*+'"


def html_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) URLs: canonical links and refresh redirects in the pages' HTML. Null HTML or URL gives none.

    A tag that is not closed, or has an open quote, takes the rest of the page, as in a browser. Repeats are possessive:
    they neither recurse nor go back, so that a tag of any length takes linear time and no stack.
    """
    tags = F.regexp_extract_all(F.col("html"), F.lit(rf"(?is)<(?:link|meta)\b(?:([^\"'>]*+(?:(?:{_QUOTED})[^\"'>]*+)*+)>|.*+)"), F.lit(1))
    each = pages.select(F.col(url_col).alias("source"), F.col(html_col).alias("html")).select("source", F.explode(tags).alias("inside"))
    inside = F.col("inside")
    # Names, and values with what quotes them; a quoted value is passed over whole, so that no name is looked for in it.
    pattern = F.lit(rf"([^\s\"'>/=]++)(?:\s*+=\s*+(?:{_QUOTED.replace('[^', '([^').replace(']*+', ']*+)')}|([^\s\"'>]++)))?+")
    names, *values = (F.regexp_extract_all(inside, pattern, F.lit(k)) for k in range(1, 5))
    values = F.transform(F.arrays_zip(*[v.alias(f"v{k}") for k, v in enumerate(values)]), lambda v: F.concat(v["v0"], v["v1"], v["v2"]))
    each = each.select("source", F.transform(names, F.lower).alias("names"), values.alias("values"))

    def attribute(name: str) -> Column:
        """The value of the first attribute of this name, or empty."""
        return F.coalesce(F.get("values", (F.array_position("names", name) - 1).cast("int")), F.lit(""))

    canonical = F.when(F.lower(attribute("rel")).rlike(r"(^|\s)canonical(\s|$)"), attribute("href"))
    refresh = F.when(
        F.lower(attribute("http-equiv")) == "refresh",
        F.regexp_extract(attribute("content"), r"(?i)url\s*=\s*['\"]?([^'\"\s]+)", 1),
    )
    links = each.select("source", F.replace(F.trim(F.coalesce(canonical, refresh)), F.lit("&amp;"), F.lit("&")).alias("target"))
    links = links.where(F.col("target").isNotNull() & (F.col("target") != "") & F.col("source").isNotNull())
    return links.select("source", resolve(F.col("source"), F.col("target")).alias("target"))


def judge(
    pages: DataFrame, links: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, component) for each row of pages.

    links: (source, target) URLs. rule: the longest rule that fits the URL itself, or null; verdict: that rule's, else
    that of the URL's class of aliases; component: the least name in that class, or null if no link touches the URL.
    A null URL, or one without ://, has empty host and path, fits no rule that asks for a path, and is allowed.
    Repeated rows and null ids give a row each; an empty table gives none; other columns are left out.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    ends = links.select(F.explode(F.array("source", "target")).alias("url")).distinct()
    judged = ends.select(node_of(url).alias("node"), rule_for(host_of(url), path_of(url), rules)["verdict"].alias("own"))
    classes = connected_components(links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    scratch = common.Scratch(pages.sparkSession)
    classes = scratch.write("classes", classes)
    sizes = classes.groupBy("component").agg(F.count("*").alias("n"))
    of_class = (
        classes.join(judged, "node")
        .groupBy("component")
        .agg(F.max(F.col("own") == "allow").alias("allows"), F.max(F.col("own") == "block").alias("blocks"))
    )
    of_class = scratch.write("of_class", of_class)
    of_node = common.spread_join(classes, of_class, "component", sizes, "node", "left").select("node", "component", "allows", "blocks")
    method = F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").otherwise("allow")
    visits = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("n"))
    return common.spread_join(rows, of_node, "node", visits, "id", "left").select(
        "id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", method).alias("verdict"), "component"
    )
