"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that each block element starts a line. Lines of menus, forms,
adverts and the like become blank. The text lengths of the lines are summed over
windows of a few lines: where the sum rises past a threshold the main text surges,
where it falls to nothing the text dives, and the lines between are kept, with short
lines between two such blocks or right beside one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names and patterns below are fixed values.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|select|button|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav header footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
MAIN = frozenset(["article", "main"])
TITLED = frozenset("section h1 h2 h3 h4 h5 h6".split())
CLASS = re.compile(
    r"(?:(?:site|page|main|top|left|right|bottom|global|post|article|user|reader|web|js|the)[-_]*)?"
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlay|"
    r"newsletters?|subscribe|subscription|signup|paywall|nav|navs|navbar|navigation|menus?|breadcrumbs?|sidebars?|rail|widgets?|related|recommended|recommendations|share|sharing|social|"
    r"comments?|commentlist|respond|reply|replies|discussions?|disqus|footers?|headers?|masthead|copyright|toolbar|pagination|pager|login|search|skip|disclaimer)"
    r"(?:[-_]*(?:box|bar|block|list|wrap|wrapper|container|content|section|area|unit|slot|banner|menu|links?|widget|text|form|item|main|top|bottom|left|right|panel|\d+))*",
    re.I,
)
HEADER = re.compile(r"(?:(?:page|main|post|article)[-_]*)?headers?(?:[-_]*(?:box|wrap|wrapper|container|content|area|text|top))*", re.I)
SPOKEN = re.compile(r"comment|repl(?:y|ies)|respond|discuss|disqus", re.I)
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>",
    re.I | re.S,
)
HREF = re.compile(r"(?<![\w-])href\s*=", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def is_boilerplate(name: str, attributes: str, inside_main: bool) -> bool:
    if name in DROPPED:
        return not (inside_main and name == "header")
    if name in ("main", "html", "body") or "=" not in attributes:
        return False
    for kind, *values in ATTRIBUTE.findall(attributes):
        words = "".join(values).lower().split()
        if kind.lower() == "id" and inside_main and name in TITLED:
            continue  # named after its own heading
        if kind.lower() == "role":
            if ROLES.intersection(words):
                return True
        elif any(CLASS.fullmatch(w) and not (inside_main and HEADER.fullmatch(w)) for w in words):
            return True
    return False


def may_wrap(name: str, attributes: str) -> bool:
    """Whether a hidden element may be a wrapper around the page, so that its name says nothing: no menu, footer or comments."""
    return name not in ("head", "nav", "footer", "menu", "dialog") and not any(SPOKEN.search("".join(v)) for _, *v in ATTRIBUTE.findall(attributes))


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters inside links, stands in an article) of each line; boilerplate is a blank line, a tag alone none.

    An element that would be hidden by its name, but holds most of the page's text, is a wrapper and is not.
    """
    shown: set[int] = set()
    while True:
        held: dict[int, int] = {}  # text of each outermost hidden element that may wrap the page, by where it begins
        lines = list(_lines(html, shown, held))
        seen = sum(len(text) for text, _, _ in lines)
        wide = [k for k, n in held.items() if k >= 0 and 2 * n > seen + sum(held.values())]
        if not wide:
            return lines
        shown.update(wide)


def _lines(html: str, shown: set[int], held: dict[int, int]) -> Iterator[tuple[str, int, bool]]:
    opened: list[tuple[str, bool]] = []  # block elements and boilerplate, outermost first
    parts: list[str] = []
    hidden = within = linked = 0
    at, in_link, link_depth, cover = 0, False, 0, -1

    def flush() -> list[tuple[str, int, bool]]:
        nonlocal linked
        line = (" ".join(unescape("".join(parts)).split()), linked, within > 0)
        parts.clear()
        linked = 0
        return [line] if line[0] or hidden else []

    def close(k: int) -> None:
        nonlocal hidden, within, in_link
        in_link = in_link and k >= link_depth  # a link does not outlast the block it began in
        for name, bad in opened[k:]:
            hidden -= bad
            within -= name in MAIN
        del opened[k:]

    for tag in TAG.finditer(html):
        if tag.start() > at and not hidden:
            text = html[at : tag.start()]
            parts.append(text)
            linked += len(text) if in_link else 0
        elif hidden and tag.start() > at:
            held[cover] = held.get(cover, 0) + len(" ".join(html[at : tag.start()].split()))
        at = tag.end()
        name = (tag[3] or "").lower()
        if not name:
            continue
        if name == "a":
            in_link, link_depth = not tag[2] and bool(HREF.search(tag[4])), len(opened)
        if name == "br":
            parts.append(" ")
        if name in VOID and name != "hr":
            continue
        if name not in INLINE:
            yield from flush()
        if tag[2]:
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == name:
                    if name not in INLINE or not any(x in MAIN for x, _ in opened[k:]):
                        close(k)
                    break
            continue
        if name == "hr" or tag[4].endswith("/") and name in INLINE:
            continue
        first = next((k for k, (_, bad) in enumerate(opened) if bad), None) if name in MAIN else None
        if first is not None and opened[first][0] == "nav":  # an unclosed menu ends where the article begins
            close(first)
        if name in ("p", "li") and opened and opened[-1][0] == name:
            close(len(opened) - 1)
        bad = tag.start() not in shown and is_boilerplate(name, tag[4], within > 0)
        if bad and not hidden:
            cover = tag.start() if may_wrap(name, tag[4]) else -1
        if bad or name not in INLINE:
            opened.append((name, bad))
            hidden += bad
            within += name in MAIN
    if not hidden:
        parts.append(html[at:])
    yield from flush()


def main_lines(lines: list[tuple[str, int, bool]], window: int = 3, surge: int = 86) -> list[str]:
    """The lines between surge and dive points, blank ones left out.

    Lengths alone are looked at first. Where the page marks an article, and the lines so
    kept outside it are longer neither than it nor than ``surge``, the marks decide: other
    lines weigh nothing and each line of the article weighs enough to surge by itself. A page whose
    windows all stay below ``surge`` surges at its fullest window.
    """
    plain = [max(0, len(text) - linked) for text, linked, _ in lines]
    kept = _between(lines, plain, window, surge)
    inside = sum(own for own, (_, _, marked) in zip(plain, lines) if marked)
    if any(marked and text for text, _, marked in lines) and sum(plain[k] for k in kept if not lines[k][2]) <= max(inside, surge):
        weight = [surge + len(text) if marked and text else 0 for text, _, marked in lines]
        kept = [k for k in _between(lines, weight, window, surge) if weight[k]]
    return [lines[k][0] for k in kept]


def _between(lines: list[tuple[str, int, bool]], weight: list[int], window: int, surge: int) -> list[int]:
    """Lines from surge to dive, and lines with a weight between such blocks or right beside one."""
    runs = [k for k, (text, _, _) in enumerate(lines) if text or k and lines[k - 1][0]]  # a gap counts once
    total = [0, *accumulate(weight[k] for k in runs)]
    sums = [total[min(i + window, len(runs))] - total[i] for i in range(len(runs))]
    least = min(surge, max(sums, default=0))
    kept, keeping = [], False
    for i, (k, ahead) in enumerate(zip(runs, sums)):
        if keeping and not ahead:
            keeping = False  # dive
        elif not keeping and weight[k] and ahead >= least:
            keeping = True  # surge
        if keeping and lines[k][0]:
            kept.append(i)
    if not kept:
        return []
    first, last = kept[0], kept[-1]
    while first and weight[runs[first - 1]]:
        first -= 1
    while last + 1 < len(runs) and weight[runs[last + 1]]:
        last += 1
    have = set(kept)
    return [runs[i] for i in range(first, last + 1) if i in have or weight[runs[i]]]


def main_text(html: str | None) -> str:
    return "\n".join(main_lines(lines_of(html or "")))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text. A page is one record, read whole; memory
    follows the longest page. Other columns are ignored; repeated rows stay.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
