"""Main text of web pages by line-block distribution.

Markup is cut into blocks: each block element (and <br>) ends a line, as in a page seen as plain text. Lines of elements
that are never main text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments;
known by element, role, class or id; by class or id only if the whole name says so, and inside an article only containers
of menus, adverts and comments) and lines that are mostly links weigh nothing, the others their length. Markup that speaks
for text adds DENSE to it: paragraphs, headings and the like, and each line of an article (or main) element; on a page that
marks its article, lines outside weigh nothing. A window of WINDOW lines is dense if its lines weigh DENSE or more together. A
surge is where windows become dense, a dive is where they stop; what has weight from the first surge to the last dive is
the text, so short lines are left out that stand apart, before or after all text. Where no window is dense, all is text.

Pages are looked at one by one, with Python's own regular expressions, inside mapInPandas.

Defined cases: null and empty html, and pages without text of their own, give an empty text; unclosed and stray tags end
where their parent does; a reference without its semicolon is decoded as browsers do; repeated rows give equal rows; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; characters that make it dense; links' share of a menu line.
WINDOW, DENSE, LINKED = 3, 30, 0.6

# Elements by what they mean for text.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form button select dialog menu svg math canvas object audio video head fieldset datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption caption".split())
#: Elements that the start of one of the same group ends.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Elements that hold other blocks: only these are menus, adverts or comments by their names inside an article.
CONTAINERS = frozenset("center details div dl ol section table ul".split())
#: Whole names of menus, adverts and comments.
PART_NAMES = re.compile(
    r"ads?|adverts?|advertisements?|advertising|adsense|sponsored|promos?|banners?|nav|navs|navbar|navigation|menus?|breadcrumbs?|sidebars?|toolbar|pagination|pager|"
    r"comments?|comment-?list|respond|replies|disqus",
    re.IGNORECASE,
)
#: Parts of names outside an article, of which one is there and all others only tell the layout.
NEVER_PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos banner banners cookie cookies consent notice notices alert alerts popup popups "
    "modal modals overlay overlays nav navs navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers header headers masthead topbar toolbar widget widgets related recommended "
    "share sharing social newsletter subscribe subscription signup login search pagination pager comment comments commentlist respond replies disqus".split()
)
LAYOUT_PARTS = frozenset(
    "area bar bars block body bottom box btn button buttons center column col container content dialog fixed float form global group holder icon icons inner item items left level line link links list "
    "main message mobile module outer page panel post posts primary right row secondary section site slot small sticky sub text top unit wrap wrapper".split()
)

ABOUT = re.compile(r"(?:has|with|without|no|js)[_-]", re.IGNORECASE)  # names that only mention another element

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s>/=\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")  # a whole attribute: its value is never searched for names
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE) for name in RAW}
BLANKS = re.compile(r"\s+")


def _is_part(name: str, value: str, inside_article: bool) -> bool:
    """Whether a class or id says that an element is no main text."""
    if PART_NAMES.fullmatch(value):
        return name in CONTAINERS or not inside_article
    if inside_article or name not in CONTAINERS or ABOUT.match(value):
        return False
    parts = [x for x in re.split(r"[_-]+", value.lower()) if x and not x.isdigit()]
    return any(x in NEVER_PARTS for x in parts) and all(x in NEVER_PARTS or x in LAYOUT_PARTS for x in parts)


def _never(name: str, attributes: str, inside_article: bool) -> bool:
    if name in NEVER or (name == "header" and not inside_article):
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if (
            key == "hidden"
            or (key == "aria-hidden" and value.lower() == "true")
            or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
            or (key == "role" and value.lower() in NEVER_ROLES)
            or (key in ("class", "id") and name not in ("html", "body", "article", "main") and any(_is_part(name, x, inside_article) for x in value.split()))
        ):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """The page's lines in order: text, weight, and whether it stands in an article (or main) element."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0  # characters of the line that are links
    stack: list[tuple[str, bool, bool]] = []  # element, never text, in an article
    links = prose = 0

    def end_line() -> None:
        nonlocal linked
        text = BLANKS.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            never, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            hint = DENSE if prose or article else 0
            lines.append((text, 0 if never or (linked >= LINKED * len(text) and not article) else len(text) + hint, article))
        linked = 0

    def close(at: int) -> None:
        nonlocal links, prose
        for name, _, _ in stack[at:]:
            links -= name == "a"
            prose -= name in PROSE
        del stack[at:]

    position = 0
    while position < len(page):
        m = TOKEN.match(page, position)
        position = m.end()
        if m[2] is None:
            if not (page.startswith(("<!", "<?"), m.start())):
                text = references.unescape(m[0])
                if not (stack and stack[-1][1]):
                    parts.append(text)
                    linked += len(text) if links else 0
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCK:
            end_line()
        if closing:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    close(at)
                    break
                if stack[at][0] in BLOCK and name not in BLOCK:
                    break
            continue
        if name in RAW:
            position = RAW_END[name].search(page, position).end()
            continue
        if name in VOID:
            continue
        if ends := SIBLINGS.get(name):
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in ends:
                    close(at)
                    break
                if stack[at][0] in BLOCK:
                    break
        never, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        article = article or name in ("article", "main")
        if not (m[3] or "").rstrip().endswith("/") or name in BLOCK:
            stack.append((name, never or _never(name, m[3] or "", article), article))
            links += name == "a"
            prose += name in PROSE
    end_line()
    return lines


def stretches(weights: list[int], dense: int = 1) -> list[tuple[int, int]]:
    """(surge, dive) pairs, end exclusive: what runs of dense windows cover, from its first to its last line with weight."""
    found, run, total = [], None, sum(weights[:WINDOW])
    for i in range(len(weights) + 1):
        if i < len(weights) and total >= dense:
            run = i if run is None else run
        elif run is not None:
            held = [j for j in range(run, min(i - 1 + WINDOW, len(weights))) if weights[j]]
            found.append((held[0], held[-1] + 1))
            run = None
        if i < len(weights):
            total += (weights[i + WINDOW] if i + WINDOW < len(weights) else 0) - weights[i]
    return found


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    if any(article and weight for _, weight, article in lines):
        lines = [(text, weight if article else 0, article) for text, weight, article in lines]
    spans = stretches([weight for _, weight, _ in lines], DENSE) or [(0, len(lines))]
    return "\n".join(text for text, weight, _ in lines[spans[0][0] : spans[-1][1]] if weight)


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500]
                yield part.drop(columns="html").assign(text=[main_text(h) for h in part["html"]])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = rows.mapInPandas(extracted, "page_id long, url string, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
