"""URL filters over classes of equivalent URLs.

Rules (host, path, verdict) judge a URL directly: the longest rule that fits wins. A page
also redirects to other URLs (meta refresh) or names its canonical form (link element);
such edges make URLs aliases of each other. Connected components over the edges carry
blocks to the aliases that no rule judges: in a component with a URL that a rule allows,
they are allowed; else, with one that a rule blocks, they are blocked; else allowed.

Only DataFrame operations are used. Components come from label propagation with pointer
jumping: each round a node takes the smallest label among its neighbours' and then its
label's label, so paths shrink geometrically. Labels and edges are stored tables, minima
are combined before the shuffle and the joins are plain equi-joins, so a URL that very
many pages redirect to is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm.common import LOWER, UPPER, materialise
from satchel.llm.graph import components

#: (host, path, verdict) of the production rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as host + path; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. With a
    short fixed list of rules this is an expression; nothing is joined.
    """
    out = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)).otherwise(out)
    return out


def _verdict(rule: Column, rules) -> Column:
    out = F.lit(None).cast("string")
    for h, p, verdict in rules:
        out = F.when(rule == h + p, F.lit(verdict)).otherwise(out)
    return out


def _plain(url: Column) -> Column:
    """The form in which URLs are compared: without fragment and outer white space, host lower-cased."""
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    rest = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*(.*)$", 1)
    return F.when(scheme == "", url).otherwise(F.concat(F.lower(scheme), F.lit("://"), host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


#: Character references that occur in addresses. The ampersand comes last.
REFERENCES = {"&quot;": '"', "&#34;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&#47;": "/", "&#x2f;": "/", "&#x2F;": "/", "&#58;": ":", "&#x3a;": ":", "&#x3A;": ":", "&lt;": "<", "&gt;": ">", "&#38;": "&", "&#x26;": "&", "&amp;": "&"}


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted in either way or not at all; empty if it is not there."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def _resolved(to: Column, page: Column) -> Column:
    """``to`` as a URL with scheme and host, seen from ``page``; null where it has none (mailto: and the like)."""
    scheme, host = F.regexp_extract(page, r"^([^:/?#]*)://", 1), F.regexp_extract(page, r"^[^:/?#]*://([^/?#]*)", 1)
    path = F.regexp_extract(page, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)
    way, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.when(way == "", F.when(path == "", F.lit("/")).otherwise(path)).when(way.startswith("/"), way).otherwise(F.concat(F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1)), way))
    steps = F.split(whole, "/")
    kept = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x)))
    ends = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    local = F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, F.lit("/"), F.array_join(kept, "/"), ends, rest))
    return F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.when(scheme != "", F.concat(scheme, F.lit(":"), to))).when(~to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), local)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) from all redirects and canonical links in the pages' html.

    A page may have several. Relative targets are resolved against the page, character
    references (``REFERENCES``) are replaced first. Targets without a host, and links of a
    page to itself, are left out.
    """
    tags = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.when(F.array_contains(F.split(F.lower(F.trim(_attribute(F.col("tag"), "rel"))), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?\s*([^"']+)""", 1))
    to = F.when(F.col("tag").rlike(r"(?i)^<link"), canonical).otherwise(refresh)
    for said, meant in REFERENCES.items():
        to = F.replace(to, F.lit(said), F.lit(meant))
    found = tags.select("url", F.regexp_replace(to, r"^\s+|\s+$", "").alias("to")).where("to <> ''")
    return found.select(_plain(F.col("url")).alias("src"), _plain(_resolved(F.col("to"), F.col("url"))).alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``.

    Null URLs and such without ``://`` have an empty host and path, no rule and no
    aliases and are allowed. Rows are judged one by one, so repeated rows get the same
    verdict; of rules of equal length the one later in the alphabet wins. Null or empty
    html has no edges. Of an empty table the result is empty. Columns other than page_id,
    url and html are not read.
    """
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("direct", _verdict(F.col("rule"), rules))
    edges = materialise(alias_edges(pages), "aliases")
    if not edges.head(1):  # no page has an alias
        return judged.select("page_id", "host", "path", "rule", F.coalesce("direct", F.lit("allow")).alias("verdict"))
    found = components(edges)
    host, path = host_of(F.col("node")), path_of(F.col("node"))
    verdicts = found.select("component", _verdict(rule_for(host, path, rules), rules).alias("v")).groupBy("component").agg(F.max(F.col("v") == "allow").alias("allows"), F.max(F.col("v") == "block").alias("blocks"))
    verdicts = materialise(verdicts.where("blocks AND NOT coalesce(allows, false)").select("component"), "blocked")
    blocked = materialise(found.join(verdicts, "component").select(F.col("node").alias("url_key")), "blocked-urls")
    keyed = judged.withColumn("url_key", _plain(F.col("url"))).join(blocked.withColumn("alias", F.lit("block")), "url_key", "left")
    return keyed.select("page_id", "host", "path", "rule", F.coalesce("direct", "alias", F.lit("allow")).alias("verdict"))
