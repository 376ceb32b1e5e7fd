"""Main text of web pages by the line-block distribution.

Markup is stripped to blocks, one a line. Lengths of text, summed over a sliding window of lines,
surge where the article starts and dive where it ends; all text between the first surge and the last
dive is kept. Lengths are weighted by what the markup says: menus, headers, footers, forms, notices,
adverts and comments are no lines of a window, and links weigh against their line. On a page with
article elements windows run inside each of them, and those where one surges are kept whole, so that a short line
of the article holds; where none surges but a window outside does, the article elements mean something else and the
whole page is cut at its first surge and its last dive.
A class judges an element by its words, but not one that holds the article or most
of the text; pages are read in one pass, whatever is left open in them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import text_slices

WINDOW = 3
#: Characters in a window from which on it surges.
SURGE = 25
#: Elements without content, elements that begin a new block, elements that hold no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
ASIDE = frozenset("aside button canvas dialog fieldset footer form head header iframe input label menu nav noscript object select svg textarea title".split())
RAW = "script|style|template|svg|canvas|object|noscript|iframe|textarea"
#: Raw elements that run to the end of the page if nothing closes them; others then end with their parent.
ENDLESS = frozenset(["script", "style", "template"])
#: Words of class, id and role that mark boilerplate, compared as whole words.
MARKED = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification opinions overlay pagination pager popup privacy promo promotion promoted related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split())

#: Of these words, those that mark headings and paragraphs inside an article too.
STRONG = frozenset("ad ads advert adverts advertisement advertising comment comments cookie cookies newsletter promo promoted promotion share sharing signup sponsor sponsored subscribe subscription".split())
_TEXT = frozenset("h1 h2 h3 h4 h5 h6 header hgroup p".split())

#: Of the words of MARKED, those that name a layout or a topic as often, and mark nothing inside an article.
TOPICS = frozenset("alert banner copyright header modal overlay privacy search skip".split())
#: Those that mark an element even if it holds most of a page's text.
NEVER = frozenset("comment comments disqus opinions replies reply respond responses cookie cookies consent ad ads advert adverts advertisement advertising nav navbar navigation menu menubar footer breadcrumb breadcrumbs related".split())
#: Words that make a name tell a state, as in no-sidebar or comments-open.
STATES = frozenset("has no with without is not open closed enabled disabled".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^'\"<>]*")
_CLOSERS = {name: re.compile(f"</{name}", re.I) for name in RAW.split("|")}
_NAMES = re.compile(r"""(?<![-\w])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|\Z)|display\s*:\s*none""", re.I)
_SPACE = re.compile(r"\s+")


def _marked(name: str, attributes: str, inside: bool) -> str:
    """Why class, id or role of an element mark boilerplate: a word of them, hidden, or nothing.

    Names are judged one by one. Inside an article an id marks nothing, and a class only by a whole
    name or by its first or last word.
    """
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return ""
    words = (STRONG if name in _TEXT else MARKED - TOPICS) if inside else MARKED
    for kind, *found in _NAMES.findall(attributes):
        if inside and kind.lower() == "id":
            continue
        for token in "".join(found).split():
            parts = [w.lower() for w in _WORD.findall(token)]
            if STATES.intersection(parts):
                continue
            looked_at = [token.lower(), *parts[:1], *parts[-1:]] if inside else parts
            if hit := next((w for w in looked_at if w in words), ""):
                return hit
    shown = re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: m[0] if "display" in m[0] else "", attributes)
    return "hidden" if _HIDDEN.search(shown) else ""


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Begin, end, whether it closes, name and attributes of each tag; names are empty for comments, and for raw elements with what they hold.

    Each character is looked at a bounded number of times: a quote that nothing closes is no quote, a tag that another one or
    the page's end cuts off ends there, and elements that nothing closes are searched for once.
    """
    last, unclosed, at = {q: page.rfind(q) for q in "'\""}, set(), 0
    while (at := page.find("<", at)) >= 0:
        begin = at
        if page.startswith("<!--", at):
            at = page.find("-->", at + 4)
            at = len(page) if at < 0 else at + 3
            yield begin, at, False, "", ""
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            at = page.find(">", at)
            at = len(page) if at < 0 else at + 1
            yield begin, at, False, "", ""
            continue
        named = _NAME.match(page, at)
        if not named:
            at += 1
            if at == len(page):
                yield begin, at, False, "", ""
            continue
        end = named.end()
        while True:
            end = _PLAIN.match(page, end).end()
            sign = page[end : end + 1]
            if sign not in ("'", '"') or not sign:
                break
            end = page.index(sign, end + 1) + 1 if last[sign] > end else end + 1
        attributes = page[named.end() : end]
        at = end + (sign == ">")
        if sign != ">":  # cut off: it is no tag, but no text either
            yield begin, at, False, "", ""
            continue
        name = named[2].lower()
        if named[1] or name not in _CLOSERS:
            yield begin, at, bool(named[1]), name, attributes
            continue
        empty = attributes.endswith("/") and name not in ENDLESS
        closer = None if name in unclosed or empty else _CLOSERS[name].search(page, at)
        if closer:
            at = page.find(">", closer.end())
            at = len(page) if at < 0 else at + 1
        elif name in ENDLESS:
            at = len(page)
        elif not empty:
            unclosed.add(name)
            yield begin, at, False, name, attributes
            continue
        yield begin, at, False, "", ""


class Block:
    """A block of text; hard: an element that holds no article text holds it; mark: the innermost marked element that holds it, 0 for none; article: the article element, 0 for none, -1 for main alone."""

    __slots__ = ("article", "hard", "linked", "mark", "text")

    def __init__(self, text: str, hard: bool, mark: int, article: int, linked: int):
        self.text, self.hard, self.mark, self.article, self.linked = text, hard, mark, article, linked


def blocks(page: str) -> tuple[list[Block], dict[int, tuple[str, int]], dict[int, int]]:
    """The blocks of a page; for each marked element the word that marks it and the marked one around it; for each article the innermost marked one that holds it or is it."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # open elements: name, hard, mark, article
    places: dict[str, list[int]] = {}  # where in the stack elements of a name are
    open_blocks: list[int] = []
    why: dict[int, tuple[str, int]] = {}
    held_by: dict[int, int] = {}
    marks = [0]
    articles: list[int] = []
    hard = mains = links = linked = number = 0
    parts: list[str] = []

    def close_block() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Block(text, hard > 0, marks[-1], articles[0] if articles else -1 if mains else 0, linked))
        parts, linked = [], 0

    def pop(to: int) -> None:
        nonlocal hard, links, mains
        while len(stack) > to:
            name, bad, mark, article = stack.pop()
            places[name].pop()
            if name in BLOCKS:
                open_blocks.pop()
            hard -= bad
            links -= name == "a"
            mains -= name == "main"
            if mark:
                marks.pop()
            if article:
                articles.pop()

    at = 0
    for begin, end, closing, name, attributes in tags(page):
        if piece := page[at:begin]:
            parts.append(piece)
            linked += len(piece.strip()) if links else 0
        at = end
        if not name:
            if page.startswith("<", begin) and not page.startswith("<!", begin) and not page.startswith("<?", begin):
                parts.append(" ")
            continue
        if name in BLOCKS:
            close_block()
        elif name == "br":
            parts.append(" ")
        if name in VOID:
            continue
        if closing:
            if places.get(name):
                pop(places[name][-1])
            continue
        if name in BLOCKS and open_blocks:  # an open paragraph or item ends where the next block begins
            before = stack[open_blocks[-1]][0]
            if before == "p" or before == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                pop(open_blocks[-1])
        first = name in ("article", "main") and not articles and not mains
        if first:  # nothing unclosed before it counts on, but for what holds articles of its own
            pop(next((i for i, (_, bad, mark, _) in enumerate(stack) if bad or mark and why[mark][0] not in NEVER), len(stack)))
        inside = bool(articles or mains)
        word = "" if name in ("html", "body") else _marked(name, attributes, inside and name != "article")
        bad = name in ASIDE and not (name == "header" and inside)
        number += 1
        mark, article = number if word else 0, number if name == "article" else 0
        if word:
            why[mark] = word, marks[-1]
            marks.append(mark)
        if article:
            articles.append(article)
            held_by[article] = marks[-1]
        elif name == "main":
            held_by.setdefault(-1, marks[-1])
        places.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((name, bad, mark, article))
        hard += bad
        mains += name == "main"
        links += name == "a"
    if at < len(page):
        parts.append(page[at:])
        linked += len(page[at:].strip()) if links else 0
    close_block()
    return out, why, held_by


def _weight(b: Block) -> int:
    """Characters of text, those of links taken off twice."""
    return max(0, len(b.text) - 2 * b.linked)


def _surges(lines: list[Block]) -> list[tuple[int, int]]:
    """The first and last line of each window that surges; lines without weight are in none."""
    weight = [_weight(b) for b in lines]
    on = [i for i, w in enumerate(weight) if w > 0]
    windows = [on[k : k + WINDOW] for k in range(max(1, len(on) - WINDOW + 1))]
    return [(w[0], w[-1]) for w in windows if sum(weight[i] for i in w) >= SURGE]


def _kept(page: str) -> tuple[list[Block], bool]:
    """The blocks that may be article text, and whether article elements tell that all of them are."""
    found, why, held_by = blocks(page)
    found = [b for b in found if not b.hard]
    sizes: Counter = Counter()
    for b in found:
        sizes[b.mark] += len(b.text)
    most = sum(sizes.values()) / 2
    for m in sorted(why, reverse=True):  # inner ones have higher numbers
        sizes[why[m][1]] += sizes[m]
    forgiven = {m for m, (word, _) in why.items() if word not in NEVER and word != "hidden" and sizes[m] > most}

    def dull() -> dict[int, bool]:
        """Whether a marked element, or one around it, is boilerplate."""
        out = {0: False}
        for m in sorted(why):
            out[m] = out[why[m][1]] or m not in forgiven
        return out

    bad, there = dull(), {b.article for b in found}
    if not any(not bad[m] for a, m in held_by.items() if a in there):  # all articles are marked, or in what is: then the marks mean something else
        for m in [m for a, m in held_by.items() if a in there]:
            while m and m not in forgiven and why[m][0] != "hidden":
                forgiven.add(m)
                m = why[m][1]
        bad = dull()
    lines = [b for b in found if not bad[b.mark]] or found
    size: Counter = Counter()
    for b in lines:
        size[b.article] += len(b.text)
    longest = max((n for a, n in size.items() if a), default=0)
    own = {a for a, n in size.items() if a and (4 * n >= longest or a == -1)}  # shorter ones are teasers or comments
    surging = {a for a in own if _surges([b for b in lines if b.article == a])}
    if not surging and (not own or _surges([b for b in lines if not b.article])):
        return lines, False
    told = surging | (own & {-1}) or own
    return [b for b in lines if b.article in told], True


def main_text(page: str) -> str:
    """The blocks of articles with a surge, or those between the page's first surge and last dive, joined by line ends.

    Of several articles those are kept that have a quarter of the longest one's text, and a surge if one of them has. Where no window
    surges, all blocks are kept. On pages cut by windows a line of which half or more is links has no weight and is no line of a window;
    it is kept where it stands alone between two lines of weight.
    """
    lines, whole = _kept(page)
    if whole:
        return "\n".join(b.text for b in lines)
    surges = _surges(lines)
    low, high = (surges[0][0], surges[-1][1]) if surges else (0, len(lines) - 1)
    weight = [_weight(b) for b in lines]
    alone = lambda i: low < i < high and weight[i - 1] > 0 and weight[i + 1] > 0
    return "\n".join(lines[i].text for i in range(low, high + 1) if weight[i] > 0 or alone(i))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    A null or empty page gives an empty text. Pages are taken whole, in time that grows with their length; unclosed elements
    end with the element that holds them, and a tag that the next one or the end of the page cuts off is dropped.
    """
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
