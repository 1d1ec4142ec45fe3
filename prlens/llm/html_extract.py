"""Main-text extraction by line-block distribution.

A page is cut into blocks (the text between block-level tags), one line each. Blocks
that the page marks as menus, headers, footers, sidebars, notices, adverts, forms or
comments are stripped with the markup. Each other line has a weight, the number of
its characters that count as running text: link text does not, nor does text
outside the article where the page marks one. Weights are summed over sliding
windows of lines; a window whose sum rises from below the threshold is a surge
point, one whose sum falls back to nothing is a dive point, and the text between
them is the article, lines of links included.

Defined results: null or empty html gives an empty text; a page without any
running text gives an empty text; unclosed tags, comments and scripts end with
the page; a tag cut off by the end of the page is dropped; very long pages take
time in proportion to their length; repeated rows are extracted alike; a kept
column named ``text`` or ``n_chars`` gives way to the added one; an empty table
gives an empty table.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from prlens.llm._arrow import small_batches

#: Fixed values of HTML: elements that start a block of their own.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td textarea tfoot th thead tr ul video audio object".split()
)
#: Fixed values of HTML: elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed values of HTML: elements whose content is not text of the page, and is raw up to their end tag.
RAW_TAGS = frozenset("script style title textarea noscript template svg math iframe noembed noframes xmp object canvas audio video".split())
#: Elements that never hold article text.
NOISE_TAGS = frozenset("nav footer aside form menu button select dialog head fieldset label input option".split())
#: Words of a class, id or role that mark a region as no article text.
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising advertorial adsense banner bottombar breadcrumb breadcrumbs comment comments commentlist commentary cookie cookies "
    "consent copyright disqus dropdown feedback footer footnav gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification pager pagination paywall popup promo promoted promotion recommended related reply replies respond responses rss share sharing shares sidebar sidenav "
    "skip skyscraper social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets signup login search contentinfo complementary alert "
    "discussion discussions infobar outbrain taboola toc trending popular".split()
)
#: Elements of phrasing that may carry such a class without being a region.
_INLINE_HINT_OK = frozenset("html body main article".split())
#: Class names that speak of a page's layout, not of the region that carries them.
_ABOUT_LAYOUT = re.compile(r"(?:has|no|with|without|is|not)[-_]", re.I)
_CONTENT_WORDS = frozenset("articlebody".split())
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|(\Z))"
    r"|</[^a-zA-Z][^>]*+(?:>|\Z)|<[/!?]?\Z",
    re.S,
)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-hidden|itemprop|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_FORM = re.compile(r"<(/?)form(?=[\s/>])|<(?:article|main|p)(?=[\s/>])", re.I)
#: Tags that end an open element of the same family, as HTML's implied end tags do.
_P_CLOSERS = BLOCK_TAGS - {"body", "html", "head", "td", "th", "tr", "li", "dd", "dt", "caption", "option", "button", "iframe"} | {"li", "dd", "dt"}


@dataclass(slots=True)
class Line:
    """One block: its text, its characters outside links, whether it lies in a noise or an article region."""

    text: str
    plain: int
    noise: bool
    content: bool


def _hints(attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether the attributes mark a noise region, and whether they mark the article's body; ``inside``: an article's header is part of it."""
    noise = content = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            noise = True
        elif name in ("class", "id", "role"):
            for name_ in value.split():
                if _ABOUT_LAYOUT.match(name_):
                    continue
                parts = re.split(r"[_\-:]+", name_)
                words = {t.lower() for word in (parts if len(parts) < 3 else (parts[0], parts[-1])) for t in (word, *_TOKEN.findall(word))}
                noise = noise or bool(words & NOISE_WORDS - ({"header"} if inside else set()))
        elif name == "itemprop" and value.lower() in _CONTENT_WORDS:
            content = True
    return noise, content


def running_forms(page: str) -> set[int]:
    """Where the forms begin that hold paragraphs or an article: wrappers of a page's text, not controls."""
    out: set[int] = set()
    begin = -1
    for m in _FORM.finditer(page):
        if m[1] is None and begin >= 0:
            out.add(begin)
        elif m[1] is not None:
            begin = -1 if m[1] else m.start()
    return out


def page_lines(page: str, hints: bool = True) -> list[Line]:
    """The blocks of a page in page order, empty ones left out; ``hints``: whether class names and ids mark regions."""
    lines: list[Line] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, noise here or above, article here or above, marked inline element
    open_tags: Counter = Counter()
    ends: dict[str, int] = {}  # the last end tag of an inline element
    bodies = running_forms(page)
    links = muted = 0

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(p for p, _ in parts)).split())
            if text:
                noise, content = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                linked = sum(len(" ".join(_html.unescape(p).split())) for p, in_link in parts if in_link)
                lines.append(Line(text, max(0, len(text) - linked), noise, content))
            parts.clear()

    def close(k: int) -> None:
        nonlocal links, muted
        if any(x[0] in BLOCK_TAGS or x[0] in NOISE_TAGS for x in stack[k:]):
            flush()
        for tag, _, _, silent in stack[k:]:
            open_tags[tag] -= 1
            links -= tag == "a"
            muted -= silent
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            if not muted:
                parts.append((page[at:], links > 0))
            break
        if m.start() > at and not muted:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[4] is not None and at == n:  # cut off by the end of the page
            break
        if m[1]:
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag in BLOCK_TAGS:
                flush()
            continue
        attrs = m[3] or ""
        if tag in RAW_TAGS:
            if tag in BLOCK_TAGS or tag == "title":
                flush()
            if not attrs.rstrip().endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            parts.append((" ", links > 0))
            continue
        if tag in BLOCK_TAGS:
            flush()
            if tag in _P_CLOSERS and open_tags["p"]:  # implied end of an open paragraph
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCK_TAGS and stack[k][0] not in ("p",):
                        break
            if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
                same = {"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th") else {tag}
                for k in range(len(stack) - 1, -1, -1) if any(open_tags[x] for x in same) else ():
                    if stack[k][0] in same:
                        close(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "menu", "table", "select", "tr" if tag in ("td", "th") else "table"):
                        break
        if tag in VOID_TAGS:
            continue
        above = stack[-1] if stack else ("", False, False, False)
        marked, body = _hints(attrs, above[2]) if hints and attrs.strip() else (False, False)
        noise = above[1] or (tag in NOISE_TAGS and m.start() not in bodies) or (marked and tag not in _INLINE_HINT_OK) or (tag == "article" and marked and above[2])
        noise = noise or (tag == "article" and bool(re.search(r"comment|reply|teaser|related|promo", attrs, re.I)))
        noise = noise or (tag == "header" and not above[2])
        content = above[2] or body or tag in ("article", "main")
        silent = noise and not above[1] and tag not in BLOCK_TAGS and tag not in NOISE_TAGS
        if silent:  # a marked inline element is dropped without ending the block around it, if it ends at all
            if tag not in ends:
                ends[tag] = max((e.start() for e in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", page, re.I)), default=-1)
            noise, silent = False, ends[tag] >= at
        elif noise and not above[1]:
            flush()
        stack.append((tag, noise or above[1], content, silent))
        open_tags[tag] += 1
        muted += silent
        links += tag == "a"
    flush()
    return lines


def main_lines(lines: list[Line], window: int = 3, surge: int = 80) -> list[int]:
    """Indices of the lines between the surge and the dive points.

    ``window``: lines summed; ``surge``: characters a window needs to start a region, or the page's largest window sum
    if that is smaller. Marked noise is no line here, so it does not part a region. Where the page marks its article,
    only the article's lines have weight, and all their text counts.
    """
    at = [k for k, x in enumerate(lines) if not x.noise]
    marked = any(lines[k].content and lines[k].plain for k in at)
    weights = [(len(lines[k].text) if lines[k].content else 0) if marked else lines[k].plain for k in at]
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    need = max(1, min(surge, max(sums, default=0)))
    kept: list[int] = []
    i = end = 0
    while i < n:
        if sums[i] < need:
            i += 1
            continue
        start = i  # a surge; lines of weight right before it belong to it
        while weights[start] == 0:
            start += 1
        while start > end and weights[start - 1] > 0:
            start -= 1
        while i < n and sums[i] > 0:
            i += 1
        end = i  # the dive
        kept += [k for k in range(start, end) if not marked or weights[k] > 0]
    return [at[k] for k in kept]


def main_text(page: str | None, window: int = 3, surge: int = 80) -> str:
    """The article of one page, its blocks joined by line ends."""
    if not page:
        return ""
    lines = page_lines(page)
    kept = main_lines(lines, window, surge)
    if not kept and lines and not re.search(r"<(?:article|main)[\s>]", page, re.I):  # class names that mark the whole page mark nothing
        lines = page_lines(page, hints=False)
        kept = main_lines(lines, window, surge)
    return "\n".join(lines[i].text for i in kept)


def extract_main_text(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), window: int = 3, surge: int = 80) -> DataFrame:
    """``keep``, ``text`` and ``n_chars`` (code points) for every row; one pass, no shuffle."""
    small_batches(df.sparkSession)
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, window, surge) for x in b.column("_html").to_pylist()]
            cols = [b.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    return df.select(*keep, df[html].alias("_html")).mapInArrow(run, f"{fields}, text string, n_chars bigint")
