"""URL rules, with block decisions carried over to aliases.

Two addresses are aliases when a page of one names the other as its canonical
address or redirects to it. The main path is DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _part(url: Column, pattern: str) -> Column:
    """The group after the first ://, or empty."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://" + pattern, 1), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty for null or no ://."""
    return F.translate(_part(url, "([^/?#]*)"), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? or #."""
    return _part(url, "[^/?#]*([^?#]*)")


def node_of(url: Column) -> Column:
    """What two spellings of an address share: no scheme, no fragment, host lower-cased. Null if there is no host."""
    return F.nullif(F.concat(host_of(url), F.when(url.rlike("(?s)^.*?://[^/?#]"), _part(url, "[^/?#]*([^#]*)")).otherwise("")), F.lit(""))


def matched(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null. Rules become one CASE."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value up to a blank, and not that of data-<name>; empty if there is none."""
    value = F.regexp_extract(tag, rf"(?i)(?<![\w-]){name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    for code in ("&amp;", "&#38;", "&#x26;"):
        value = F.replace(value, F.lit(code), F.lit("&"))
    return value


def without_dots(path: Column) -> Column:
    """The path with its segments . and .. worked out; a .. at the top goes nowhere."""

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    open_end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"(?s)(^|/)\.\.?(/|$)"), F.array_join(open_end, "/")).otherwise(path)


def resolved(url: Column, to: Column) -> Column:
    """The address that a link ``to`` on the page ``url`` names, with x as its scheme."""
    site, path = F.concat(F.lit("x://"), host_of(url)), path_of(url)
    whole = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(F.lit("x:"), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("#"), url)
        .when(to.startswith("?"), F.concat(site, path, to))
        .otherwise(F.concat(site, F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^.*/", 0)), to))
    )
    query = _part(whole, r"[^/?#]*[^?#]*(\?[^#]*)")
    return F.concat(F.lit("x://"), _part(whole, "([^/?#]*)"), without_dots(path_of(whole)), query)


_CANONICAL = r"""(?i)^<link\b[^>]*(?<![\w-])rel\s*=\s*(?:"(?:[^"]*\s)?canonical[\s"]|'(?:[^']*\s)?canonical[\s']|canonical\b)"""


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): nodes joined by <link rel=canonical> or <meta http-equiv=refresh>; comments and scripts don't count.

    Links are taken from the page's first <base> with an href, if it has one, else from its url.
    """
    html = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    tags = pages.where(F.col("html").rlike(r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)") & node_of(F.col("url")).isNotNull())
    base = _attribute(F.regexp_extract(F.col("plain"), r"(?i)<base\b[^>]*(?<![\w-])href\s*=[^>]*>", 0), "href")
    tags = tags.select("url", html.alias("plain")).select("url", "plain", base.alias("base"))
    tags = tags.select("url", "base", F.explode(F.regexp_extract_all("plain", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), 0)).alias("tag"))
    tag, url = F.col("tag"), F.col("url")
    link = F.when(tag.rlike(_CANONICAL), _attribute(tag, "href"))
    jump = F.when(tag.rlike(r"(?i)^<meta\b[^>]*(?<![\w-])http-equiv\s*=\s*[\"']?\s*refresh\b"), _attribute(tag, "url"))
    to = tags.select("url", "base", F.coalesce(link, jump).alias("to")).where("to <> ''")
    start = F.when(F.col("base") == "", url).otherwise(resolved(url, F.col("base")))
    to = to.select("url", "to", start.alias("start"))
    return to.select(node_of(url).alias("src"), node_of(resolved(F.col("start"), F.col("to"))).alias("dst")).where("src <> dst").distinct()


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) of every page (page_id, url, html).

    A rule that fits decides. Otherwise a page is blocked if some address it is an
    alias of is blocked by a rule, whatever other aliases are allowed, since an allow
    rule speaks for its own addresses only; else ``default``. ``edges`` (src, dst, as
    ``node_of`` gives them) replaces the links found in the pages. Null urls have empty
    host and path and no aliases; null html has no links. Repeated rows keep one result
    each; other columns of ``pages`` are ignored. ``component`` is null without aliases.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host, path = F.col("host"), F.col("path")
    named = pages.select("page_id", node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("rule", matched(rules, host, path, lambda r: r.text)).withColumn("own", matched(rules, host, path, lambda r: r.verdict))
    found = connected_components(alias_edges(pages) if edges is None else edges, "src", "dst")
    # A node starts with its host.
    parts = found.select("component", F.regexp_extract("id", r"^[^/?#]*", 0).alias("host"), F.regexp_extract("id", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    blocked = F.coalesce(matched(rules, host, path, lambda r: r.verdict) == "block", F.lit(False))
    bad = parts.groupBy("component").agg(F.max(blocked).alias("bad"))
    aliases = found.select("component", F.col("id").alias("node")).join(bad, "component")
    verdict = F.coalesce("own", F.when(F.col("bad"), "block"), F.lit(default))
    return named.join(aliases, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component")
