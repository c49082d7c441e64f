"""URL filters by redirect equivalence. DataFrame functions only.

Rules are (verdict, host, path). A rule fits its host and all subdomains when the path begins with the
rule's; of fitting rules the longest (host and path written together) wins. Pages are linked by
canonical links and meta refresh redirects found in their HTML; the addresses, pages or not, form
components. A page without a rule of its own takes its component's decision: allow if a rule allows
any address in it, else block if a rule blocks one, else allow.

Addresses are compared without scheme and fragment. All links of a page count, relative ones against
its path or their <base>; targets of other schemes (mailto:) and mere fragments are none. Null URLs and URLs without :// have an empty host
and path, no rule and no links, and are allowed; null HTML has no links, and pages of any length are read whole. Every row of pages is judged
for itself, repeated ids and URLs included. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, spread_join, stored

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: What follows a tag's name up to its >: names, and values after = that may be quoted. Possessive, so the matcher neither recurses nor goes back.
_BODY = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+"""
#: Elements whose content is text: links in them are none.
_TEXT = "script|style|title|textarea|xmp|iframe|noembed|noframes"
#: In turn: comments, elements of text with their content, tags, and a tag that never closes, which takes the rest of the page.
_MARKUP = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<({_TEXT})(?=[\s/>]){_BODY}>.*?(?:</\1(?=[\s/>])|\z)|</?[a-z]{_BODY}>|</?[a-z].*+"
_ATTRIBUTE = r"""([^\s=>/"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+"""
#: The address in a refresh: after the seconds, a sign, and url= or nothing.
_REFRESH = r"""(?is)^\s*+[\d.]*+\s*+[;,]?+\s*+(?:url\s*+=\s*+)?+["']?+([^"']+)"""

def _rest(url: Column) -> Column:
    """What follows the first ://, or null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The winning rule as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _address(url: Column) -> Column:
    """Host, path and query of an absolute URL."""
    tail = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(_rest(url).isNotNull(), F.concat(host(url), F.regexp_replace(tail, r"^(?=$|\?)", "/")))


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its segments . and .. taken away."""
    path = F.regexp_replace(path, r"(?<=/)(\.\.?)$", "$1/")
    step = lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def _resolved(target: Column, url: Column) -> Column:
    """An absolute URL for a link target, or null."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"^([^:/?#]+)://", 1)
    site = F.concat(scheme, F.lit("://"), host(url))
    own = F.when(path(url) == "", "/").otherwise(path(url))
    name, tail = F.regexp_extract(target, r"(?s)^[^?#]*", 0), F.regexp_extract(target, r"(?s)^[^?#]*(.*)", 1)
    return (
        F.when(target.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("?")), F.concat(site, own, target))
        .when(~target.rlike(r"^(?i)(#|[a-z][a-z0-9+.-]*:)"), F.concat(site, _without_dots(F.concat(F.regexp_replace(own, r"[^/]*$", ""), name)), tail))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of a name, or null."""
    body = F.regexp_replace(tag, r"(?i)^<[a-z]+", "")
    names = F.transform(F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    value = F.get(F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(2)), (F.array_position(names, name) - 1).cast("int"))
    return F.when(F.array_contains(names, name), F.trim(F.regexp_replace(F.regexp_replace(value, r"""^["']|["']$""", ""), r"[\t\r\n]", " ")))


def _of(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: t.rlike(rf"(?is)^<{name}[\s/].*>\z"))


def links(pages: DataFrame) -> DataFrame:
    """url, target: canonical links and refresh redirects of pages to other addresses.

    Tags are read as a browser reads them: quoted values may hold >, rel is a list of words, a name is a name only after space,
    <base> changes what relative targets are against, and comments and the content of scripts and the like hold none.
    """
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    low = F.lower(html)
    some = pages.where(_rest(url).isNotNull()).select("url", html.alias("html")).where(low.contains("canonical") | low.contains("http-equiv"))
    tags = some.select("url", F.regexp_extract_all("html", F.lit(_MARKUP), F.lit(0)).alias("tags"))
    canonical = F.transform(F.filter(_of(F.col("tags"), "link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")), lambda t: _attribute(t, "href"))
    refresh = F.transform(F.filter(_of(F.col("tags"), "meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"), lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), _REFRESH, 1)))
    base = F.get(F.filter(F.transform(_of(F.col("tags"), "base"), lambda t: _attribute(t, "href")), lambda h: h.isNotNull()), F.lit(0))
    each = tags.select("url", F.coalesce(_resolved(base, url), url).alias("against"), F.explode(F.concat(canonical, refresh)).alias("t"))
    return each.where("t <> ''").select("url", _resolved(F.col("t"), F.col("against")).alias("target")).where("target IS NOT NULL").where(_address(F.col("target")) != _address(url))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    h, p = host(F.col("url")), path(F.col("url"))
    name, own = rule(h, p, rules)
    # pages without an address meet nothing; names of their own spread them over the tasks
    alone = F.concat(F.lit("none-"), F.xxhash64("page_id", "html").cast("string"))
    rows = pages.select("page_id", h.alias("host"), p.alias("path"), name.alias("rule"), own.alias("own"), F.coalesce(_node(F.col("url")), alone).alias("node"))
    edges = stored(links(pages), "url-links")
    if edges.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    ids = edges.select(_node(F.col("url")).alias("a"), _node(F.col("target")).alias("b"))
    parts = stored(connected_components(ids, "url-components"), "url-parts")
    said = edges.select(F.explode(F.array("url", "target")).alias("u")).distinct()
    said = said.select(_node(F.col("u")).alias("node"), rule(host(F.col("u")), path(F.col("u")), rules)[1].alias("v")).where("v IS NOT NULL").distinct()
    decided = said.join(parts, "node").groupBy("component").agg(F.min("v").alias("spread"))  # allow comes before block
    decided = stored(decided.join(parts.groupBy("component").agg(F.count("*").alias("nodes")), "component"), "url-verdicts")
    spread = stored(spread_join(parts, decided, ["component"], "nodes").select("node", "spread"), "url-spread")
    sizes = rows.join(spread.select("node"), "node", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
    spread = stored(spread.join(sizes, "node").select("node", "spread", "n"), "url-decisions")
    return spread_join(rows, spread, ["node"], "n", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))


def _node(url: Column) -> Column:
    """The identity of an address: 128 bits of it."""
    return F.md5(_address(url))
