"""HTML extraction by line-block distribution.

1. Markup is stripped into lines, one per block-level element. Elements that HTML or their class, id or role set apart
   (scripts, styles, menus, headers and footers of the page, sidebars, forms, notices, adverts, reader comments) leave
   blank lines in their place: `window` of them at the page's top level, one inside a container (a single one for a run of
   them inside an article, which is never cut there). The id of a paragraph, heading or list item is an anchor and names
   nothing. Outside <article> and <main> every edge of a container leaves one too; where a page has an <article> or <main> with text, all else is blank.
2. Each line weighs its characters outside links, or all of them in an article at least half of which is no link; a block
   is the sum over a window of `window` lines from its first.
3. Stretches are parted by zero blocks. A stretch counts if its largest block reaches `surge` (or the page's largest
   block does not, and it has that one). Its surge point is the first line whose block reaches `surge` and a fifth of
   the stretch's largest block, with the lines that stand right above it; its dive point is the next zero block.
4. All lines between surge and dive are kept, short ones too, in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.words import chunks

WINDOW, SURGE, RISE = 3, 86, 5

# Fixed values of HTML: elements that start a line, that never nest text to keep, and that have no end tag.
CONTAINERS = frozenset("article body center details div fieldset footer form header hgroup html main nav aside section table td th ul ol dl".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
DROPPED = frozenset("head nav aside footer form script style noscript iframe template svg math canvas object embed audio video select textarea button title dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
IMPLIED_END = frozenset("p li dt dd tr td th option".split())
# Words of class, id and role values that mark what is not the article, and those that may follow them in a name.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget "
    "footer header masthead cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "comment comments commentlist respond replies reply disqus pager pagination toolbar search skip copyright legal disclaimer complementary contentinfo".split()
)
HOLDERS = frozenset("area banner bar block box container content form group inner item items link links list outer panel region row section slot top bottom unit wrap wrapper".split())
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption td th".split())
NAME = re.compile(r"[^a-z0-9]+")
ATTRIBUTES = r"(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+>"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<raw>" + "|".join(RAW_TEXT) + rf")\b(?:{ATTRIBUTES}|[^>]*+(?:>|\Z)).*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>{ATTRIBUTES}|[^>]*+(?:>|\Z))",  # the second form: a quote is not closed
    re.S | re.I,
)
MARKS = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")


def _marked(tag: str, rest: str, inside: bool) -> bool:
    """Whether class, id or role mark the element as no article text: a name ends with a marked word, holders aside.

    Inside an article its own header stays. Ids of text-level elements are anchors: they name a topic, not a role.
    """
    if "=" not in rest or tag in ("html", "body", "article", "main"):
        return False
    for attribute, a, b, c in MARKS.findall(rest):
        if tag in TEXT_LEVEL and attribute.lower() == "id":
            continue
        for name in (a or b or c).lower().split():
            words = [w for w in NAME.split(name) if w]
            while len(words) > 1 and words[-1] in HOLDERS:
                words.pop()
            if words and words[-1] in MARKED and not (inside and words[-1] == "header"):
                return True
    return False


def page_lines(page: str, window: int = WINDOW) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside an article) per line; `window` blank lines where an element was dropped."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, is an article
    still_open: Counter[str] = Counter()  # tags on the stack
    dropped = inside = anchors = 0

    def close_line() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                lines.append((text, max(0, len(text) - linked), inside > 0))
            parts.clear()
        linked = 0

    def gap() -> None:
        """Blank lines for a dropped element: enough to part stretches at the page's top level, one inside a container."""
        close_line()
        if inside and lines and lines[-1] == ("", 0, True):
            return
        nested = len(stack) > still_open["html"] + still_open["body"]
        lines.extend([("", 0, inside > 0)] * (1 if nested else window))

    def edge(tag: str) -> None:
        """The blank line at a container's start or end outside an article."""
        if tag in CONTAINERS and not inside and not dropped and lines:
            lines.append(("", 0, False))

    def pop() -> None:
        nonlocal dropped, inside
        tag, was_dropped, was_article = stack.pop()
        still_open[tag] -= 1
        close = tag in BLOCKS
        if close and not dropped:
            close_line()
        if was_dropped:
            dropped -= 1
            gap()
        if was_article:
            inside -= 1
        edge(tag)

    def text_run(run: str) -> None:
        nonlocal linked
        if run and not dropped:
            parts.append(run)
            if anchors:
                linked += len(SPACE.sub(" ", html.unescape(run)).strip())

    at = 0
    for m in TOKEN.finditer(page):
        text_run(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if m["raw"]:
            if m["raw"].lower() not in ("script", "style") and not dropped:
                gap()
            continue
        if not tag:
            if m[0].startswith("<![CDATA["):
                text_run(html.escape(m[0][9:-3], quote=False))
            continue
        if m["end"]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if still_open[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag in BLOCKS and not dropped:
                close_line()
            continue
        if tag in IMPLIED_END and stack and stack[-1][0] == tag:
            pop()
        if tag in BLOCKS and not dropped:
            close_line()
        if tag == "a":
            anchors += 1
        if tag in VOID or m["rest"].endswith("/>"):
            continue
        if tag in BLOCKS or tag in DROPPED or tag == "main" or (m["rest"] and tag != "a" and _marked(tag, m["rest"], inside > 0)):
            page_header = tag == "header" and not inside
            drop = tag in DROPPED or page_header or _marked(tag, m["rest"] or "", inside > 0)
            article = tag in ("article", "main") and not drop
            if drop:
                if not dropped:
                    gap()
                dropped += 1
            if not drop:
                edge(tag)
            inside += article
            stack.append((tag, drop, article))
            still_open[tag] += 1
    text_run(page[at:])
    if not dropped:
        close_line()
    return lines


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The kept lines of a page joined by newlines; empty for null, empty or text-free pages."""
    if not page:
        return ""
    lines = page_lines(page, window)
    if any(inside and text for text, _, inside in lines):
        lines = [x if x[2] else ("", 0, False) for x in lines]
    if not lines:
        return ""
    weights = np.array([n for _, n, _ in lines])
    inside = np.array([x for _, _, x in lines])
    lengths = np.array([len(text) for text, _, _ in lines])
    bounds = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    for a, b in zip(bounds[0::2], bounds[1::2], strict=True):  # an article's lists of links are text, a card of links is none
        if 2 * weights[a:b].sum() >= lengths[a:b].sum():
            weights[a:b] = lengths[a:b]
    sums = np.convolve(weights, np.ones(window, int))[window - 1 :]  # block i: lines i .. i + window - 1
    edges = np.flatnonzero(np.diff(np.concatenate(([False], sums > 0, [False])).view(np.int8)))
    stretches = list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))
    peaks = [int(sums[a:b].max()) for a, b in stretches]
    kept: list[str] = []
    for (a, b), peak in zip(stretches, peaks, strict=True):
        if peak >= min(surge, max(peaks)):
            first = a + int(np.argmax(sums[a:b] >= max(min(surge, peak), peak // RISE)))
            while first > a and lines[first - 1][0]:  # what stands right above it, a heading say
                first -= 1
            kept += [text for text, _, _ in lines[first:b] if text]
    return "\n".join(kept)


def extract_pages(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null html counts as empty; a page without text gives an empty text; repeated rows give repeated results; an empty
    table gives an empty result; other columns are ignored. Pages of any length are read whole, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages_here in chunks(batches, "html"):
            texts = [main_text(x.decode(), window, surge) for x in pages_here]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
