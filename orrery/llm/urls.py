"""URL rules, spread over redirects and canonical links.

A rule (verdict, host, path) fits a URL whose host is the rule's or a subdomain
of it and whose path starts with the rule's; the longest rule that fits decides
(of equals an allow). URLs that redirect to each other, or name each other as
canonical, are aliases: distributed connected components over these edges make
classes of aliases. A URL without a rule of its own is blocked if some alias is
blocked by a rule, unless some alias is explicitly allowed: explicit allows take
precedence. A URL's own rule always decides for itself. Otherwise it is allowed.

Every canonical link and every refresh of a page counts, but for those inside comments,
scripts, styles and the values of attributes; attributes go by their whole names, ``rel`` by
its tokens; references by number and those of ``NAMED`` are decoded; the first base element
with a target moves relative ones. Only URLs and link targets
leave the scan, never the html.

Nodes are URLs without scheme, fragment, user and default port, their host in lower
case, dot segments resolved; a page whose URL only so becomes one with a rule takes
that rule's verdict if its class has none. Defined cases: null urls, and urls
without "://", have empty host and path, no aliases, and are allowed; null or empty
html has no links; repeated rows each get their row; a target need not be a page;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Scratch, ascii_lower
from orrery.llm.components import components

#: The production rules: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_path(p: Column) -> Column:
    """A path without dot segments."""
    stack = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.least(F.size(a), F.lit(1))))).when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    end = F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(p.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(stack, "/"), end)).otherwise(p)


def key(url: Column) -> Column:
    """A URL's node: host, path ("/" if empty) and query; null if it has no host."""
    port = F.when(url.rlike("(?i)^[^:]*https://"), ":443$").otherwise(":80$")
    h = F.regexp_replace(F.regexp_replace(host(url), F.lit("^.*@"), F.lit("")), port, F.lit(""))
    p = plain_path(path(url))
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(h != "", F.concat(h, F.when(p == "", F.lit("/")).otherwise(p), query))


def rule(h: Column, p: Column, rules=RULES) -> Column:
    """The rule that decides, as struct (rule, verdict); null fields if none fits."""
    out = None
    for verdict, rh, rp in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        this = F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, this) if out is None else out.when(fits, this)
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    return none if out is None else out.otherwise(none)


#: What hides links from a reader of the page.
HIDING = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\b|\z)"
#: A tag; a ">" or a "<" in a quoted value does not end or begin one. One that the page breaks off is matched, so that a scan is linear, and not used.
TAG = r"""(?is)<[a-z/](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\z)"""
#: An attribute's name and value; the name of a tag comes as "<link".
ATTRIBUTE = r"""(?s)([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+"""

# Named references that URLs are written with.
NAMED = {"amp": "&", "colon": ":", "sol": "/", "period": ".", "quest": "?", "equals": "=", "num": "#", "percnt": "%", "lowbar": "_", "commat": "@", "plus": "+", "comma": ",", "semi": ";", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "Tab": "\t", "NewLine": "\n"}


def decoded(value: Column) -> Column:
    """Character references by number, and those of ``NAMED``, replaced; all others stay as they are."""
    named = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])

    def one(t: Column) -> Column:
        hexed = F.conv(F.regexp_extract(t, "^&#[xX]0*([0-9a-fA-F]{1,6});$", 1), 16, 10)
        n = F.when(t.rlike("^&#[xX]"), hexed).otherwise(F.regexp_extract(t, "^&#0*([0-9]{1,7});$", 1)).try_cast("int")
        letter = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        known = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(t.startswith("&#"), F.when(known, letter).otherwise(t)).otherwise(F.coalesce(F.try_element_at(named, F.substring(t, 2, F.char_length(t) - 2)), t))

    parts = F.regexp_extract_all(value, F.lit("(?s)&#?[0-9a-zA-Z]++;|[^&]++|&"), 0)
    whole = F.array_join(F.transform(parts, lambda t: F.when(t.rlike("^&.+;$"), one(t)).otherwise(t)), "")
    return F.when(F.contains(value, F.lit("&")), whole).otherwise(value)


def _attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute, by its whole name, in any case; empty if there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), lambda x: F.lower(x))
    value = F.get(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2), F.array_position(names, name).cast("int") - 1)
    bare = F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")
    return F.regexp_replace(decoded(F.coalesce(bare, F.lit(""))), r"^\s+|\s+$", "")


def targets(html: Column) -> Column:
    """Array of the canonical links and refresh targets of a page, as written, its base (or null) first."""
    seen = F.when(html.rlike("(?i)canonical|refresh"), F.regexp_replace(html, HIDING, " ")).otherwise("")
    tags = F.filter(F.regexp_extract_all(seen, F.lit(TAG), 0), lambda t: t.endswith(">") & t.rlike(r"(?is)^<(?:(?:link|meta)[\s/].*(?:canonical|refresh)|base[\s/])"))

    def of(tag: Column) -> Column:
        refresh = F.regexp_extract(_attribute(tag, "content"), r"""(?is)^\s*[0-9.]*\s*[;,\s]\s*url\s*=\s*['"]?([^'"\s]+)""", 1)
        canonical = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
        return F.when(tag.rlike(r"(?i)^<link[\s/]") & canonical, _attribute(tag, "href")).when(tag.rlike(r"(?i)^<meta[\s/]") & (F.lower(_attribute(tag, "http-equiv")) == "refresh"), refresh).otherwise("")

    bases = F.filter(F.transform(F.filter(tags, lambda t: t.rlike(r"(?i)^<base[\s/]")), lambda t: _attribute(t, "href")), lambda x: x != "")
    found = F.filter(F.transform(tags, of), lambda x: x != "")
    return F.concat(F.array(F.get(bases, 0)), F.array_distinct(found))


def resolve(base: Column, ref: Column) -> Column:
    """The absolute form of a link found on page ``base``."""
    h, p = host(base), path(base)
    return (
        F.when(ref.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), ref)
        .when(ref.startswith("//"), F.concat(F.lit("http:"), ref))
        .when(ref.startswith("/"), F.concat(F.lit("http://"), h, ref))
        .when(ref.startswith("?"), F.concat(F.lit("http://"), h, p, ref))
        .when(ref.startswith("#") | (ref == ""), F.lit(None))
        .when(ref.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(F.lit("http://"), h, F.coalesce(F.regexp_extract(p, r"^.*/", 0), F.lit("")), ref))
    )


def page_edges(pages: DataFrame, scratch: Scratch, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes of a page and of what it redirects to or names as canonical.

    Each step is written: the patterns run once for a link, and no plan repeats their expressions.
    """
    found = pages.select(F.col(url).alias("url"), targets(F.coalesce(F.col(html), F.lit(""))).alias("t")).where(F.size("t") > 1)
    found = scratch.cut(found.select("url", F.get("t", 0).alias("base"), F.explode(F.slice("t", 2, F.size("t") - 1)).alias("ref")), "links")
    at = found.select("url", F.when(F.coalesce("base", F.lit("")) != "", resolve(F.col("url"), F.col("base"))).otherwise(F.col("url")).alias("at"), "ref")
    whole = scratch.cut(at.select("url", resolve(F.coalesce("at", "url"), F.col("ref")).alias("to")), "resolved")
    return scratch.cut(whole.select(key(F.col("url")).alias("a"), key(F.col("to")).alias("b")), "page-edges")


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``redirects`` may add known redirects (from_url, to_url) to those found in the pages.
    """
    scratch = Scratch(pages.sparkSession)
    edges = page_edges(pages, scratch, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(key(F.col("from_url")).alias("a"), key(F.col("to_url")).alias("b")))
    roots = components(edges, scratch)
    as_url = F.concat(F.lit("http://"), F.col("node"))
    ruled = roots.select("node", "root", rule(host(as_url), path(as_url), rules)["verdict"].alias("v"))
    verdict = F.when(F.bool_or(F.col("v").eqNullSafe("allow")), "allow").when(F.bool_or(F.col("v").eqNullSafe("block")), "block")
    verdicts = scratch.cut(ruled.groupBy("root").agg(verdict.alias("spread")).where("spread IS NOT NULL"), "verdicts")
    aliases = scratch.cut(roots.join(verdicts, "root").select(F.col("node").alias("k"), "spread"), "aliases")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"))
    own = own.select("page_id", F.coalesce(host(F.col("url")), F.lit("")).alias("host"), path(F.col("url")).alias("path"), key(F.col("url")).alias("node"))
    as_url = F.concat(F.lit("http://"), F.col("node"))
    own = own.withColumns({"r": rule(F.col("host"), F.col("path"), rules), "n": rule(host(as_url), path(as_url), rules)["verdict"]})
    rows = own.join(aliases, own["node"] == aliases["k"], "left")
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("spread"), F.col("n"), F.lit("allow")).alias("verdict"))
