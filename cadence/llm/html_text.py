"""Main text of web pages by line-block distribution.

``extract`` strips markup into a sequence of lines (one per block element),
gives every line its text length, sums the lengths over sliding line windows and
keeps the lines between the points where that sum surges and where it dives,
measured against the page's own sums (``kept_between``).

Marks only help: lines inside menus, headers, footers, sidebars, notices, adverts,
forms and reader comments (by element or by class, id and role names), and those
that are nearly all link text, have length 0 beforehand, like the empty lines that
stripped markup leaves (so has a line that begins with a copyright sign); a heading in the window
of a surge begins the text.  Where a page
marks its article (``<article>`` or ``<main>``), lines outside it have length 0 as
well and nothing in it is too short: there the sums only have to leave 0.

Each page is handled alone, in Arrow batches, without a shuffle.

Defined results: null or empty html gives an empty text and n_chars 0; a page
without markup is one block per page; unclosed elements end with the element
around them; repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cadence.llm.common import bounded_batches

#: Lines in a sliding window.
WINDOW = 3
#: Share of the page's typical window sum that is a surge, the most characters that
#: may take, and the share of the largest span that another one needs to count.
SURGE, ENOUGH, SPAN = 0.25, 90, 0.2

# Elements whose content is not text of the page.
_OPAQUE = frozenset("script style noscript template svg math iframe object canvas audio video select "
                    "textarea title".split())
# Elements that hold navigation, notices and other page furniture.
_FURNITURE = frozenset("nav header footer aside form dialog menu button".split())
# Elements that hold the text whatever their class says.
_NEVER_FURNITURE = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
# Elements that never have an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that stay within a line.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s "
                    "samp small span strike strong sub sup time tt u var br wbr img".split())
# An open element of the key ends when one of the values begins beside it.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Words in class, id or role that mark page furniture.
_MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notice|gdpr|popup|modal|"
    r"nav\w*|menu|breadcrumbs?|side-?bar|aside|widget|footer|header|masthead|topbar|toolbar|comments?|"
    r"comment-?list|respond|disqus|replies|reader-?comments?|share|sharing|social|related|recommend\w*|"
    r"newsletter|subscribe|signup|login|search-?(?:box|form|bar)?|pagination|pager|copyright|disclaimer|"
    r"navigation|complementary|contentinfo|alert)(?=$|[\s_-])", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_HEADING = re.compile(r"h[1-6]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for name in _OPAQUE}
_SPACE = re.compile(r"\s+")


def _is_furniture(name: str, attributes: str) -> bool:
    if name in _FURNITURE:
        return True
    if not attributes or name in _NEVER_FURNITURE:
        return False
    for key, value in _ATTR.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id", "role") and _MARKS.search(value):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """Blocks of a page in order: (text, its length, length of link text,
    inside page furniture, inside the marked article, a heading)."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # element, furniture around it, article around it
    bad = art = False
    in_link = False

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, len(text), linked, bad, art, any(_HEADING.fullmatch(x[0]) for x in stack[-2:])))
            parts.clear()
        linked = 0

    def close(name: str, upto: frozenset = frozenset()) -> None:
        """Leave the innermost open ``name`` and all within it."""
        nonlocal bad, art
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                _, bad, art = stack[i]
                del stack[i:]
                return
            if stack[i][0] in upto:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        slash, name, attributes, text = m.groups()
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        if name is None:  # a comment or declaration
            continue
        name = name.lower()
        if name == "a":
            in_link = not slash
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        if name in _INLINE:
            if slash or not _is_furniture(name, attributes):
                if any(s[0] == name for s in stack) and slash:
                    end_line()
                    close(name)
                continue
            end_line()
            stack.append((name, bad, art))
            bad = True
            continue
        if name not in _OPAQUE:
            end_line()
            in_link = False
        if slash:
            close(name)
        elif name in _OPAQUE:
            at = _RAW_END[name].search(page, at).end()
        elif name not in _VOID:
            if name in _ENDS_P:
                close("p", frozenset(("div", "article", "section", "main", "td", "body", "aside", "li")))
            elif name in ("li", "tr", "td", "th", "dt", "dd", "option"):
                close(name, frozenset(("ul", "ol", "table", "tr", "dl") if name != "tr" else ("table",)))
            stack.append((name, bad, art))
            bad = bad or _is_furniture(name, attributes)
            art = art or name in ("article", "main")
    end_line()
    return out


def kept_between(lengths: np.ndarray, window: int = WINDOW, heading: np.ndarray | None = None,
                 marked: bool = False) -> np.ndarray:
    """Which lines lie between a surge and a dive of the window sums.

    A window's sum is the text length of ``window`` lines in a row.  It surges where it
    rises to ``SURGE`` of the page's typical sum (that of the window in which the median
    character lies; at most ``ENOUGH`` characters) and dives where it falls below.  A span
    between the two begins and ends with a line that has half of that by itself, so the
    short neighbours that a window brings along are left out, unless a heading among them
    says that the text begins there.  Short spans (less than ``SPAN`` of the largest one and
    than twice ``ENOUGH``) are notices; the text goes from the first of the others to the
    last.  In a ``marked`` article every line counts."""
    n = len(lengths)
    keep = np.zeros(n, dtype=bool)
    if not n or not lengths.any():
        return keep
    run = np.concatenate((np.zeros(window - 1, np.int64), lengths, np.zeros(window - 1, np.int64)))
    sums = np.convolve(run, np.ones(window, np.int64), "valid")  # sums[i]: lines i-window+1 .. i
    order = np.sort(sums)
    typical = order[np.searchsorted(np.cumsum(order), order.sum() / 2)]
    least = 1.0 if marked else min(ENOUGH, SURGE * float(typical))
    low = np.concatenate(([True], sums < least, [True]))
    surge, dive = np.flatnonzero(low[:-1] & ~low[1:]), np.flatnonzero(~low[:-1] & low[1:])
    spans = []
    for a, b in zip(surge.tolist(), dive.tolist()):
        first = max(a - window + 1, 0)
        strong = first + np.flatnonzero(lengths[first:b] >= max(least / 2, 1))
        if len(strong):
            begin = int(strong[0])
            if heading is not None:
                begin = next((i for i in range(max(begin - window + 1, 0), begin) if heading[i] and lengths[i]), begin)
            spans.append((begin, int(strong[-1]) + 1))
    sizes = [int(lengths[a:b].sum()) for a, b in spans]
    spans = [x for x, size in zip(spans, sizes) if marked or size >= min(SPAN * max(sizes), 2 * ENOUGH)]
    if spans:
        keep[spans[0][0]:spans[-1][1]] = True
    return keep & (lengths > 0)


def main_text(page: str | None) -> str:
    """The article text of one page, blocks joined by one LF."""
    found = lines(page or "")
    if not found:
        return ""
    marked = any(x[4] and not x[3] for x in found)
    lengths = np.array([0 if bad or (marked and not art) or (not marked and (2 * linked > length or text[0] == "©")) else length
                        for text, length, linked, bad, art, _ in found], dtype=np.int64)
    keep = kept_between(lengths, heading=np.array([x[5] for x in found]), marked=marked)
    return "\n".join(found[i][0] for i in np.flatnonzero(keep))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row of ``pages``."""
    spark = pages.sparkSession
    bounded_batches(spark)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(x) for x in b["_html"]]
            yield pd.DataFrame({key: b["_key"], url: b["_url"], "text": texts,
                                "n_chars": pd.Series([len(t) for t in texts], dtype="int64")})

    given = pages.selectExpr(f"`{key}` AS _key", f"`{url}` AS _url", f"`{source}` AS _html")
    return given.mapInPandas(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long")
