"""Main text of web pages by tag-path ratios.

Each text node belongs to the path of its block elements from the root (names, classes and
ids). Over a page's nodes of one path, text length and punctuation are added up and divided
by their number, and the share of text outside links scales them; the ratios are smoothed
along the page and fused: what stands close to a path of a high ratio, below one element,
takes a share of it (a heading of its article's). Paths that reach THRESHOLD of the page's
best are the content.

Names weigh in as a weak prior only: a factor for elements, roles and class words of menus,
headers, footers, sidebars, notices, adverts, forms and comments, and another for an article
or main part; a path whose ratio is high enough overcomes it. An element that holds most of
the page's text isn't held to be clutter, whatever its classes say, unless an article stands
outside it. Scripts, styles and other invisible elements have no text at all.

The blocks of the chosen paths are joined in page order: references are decoded, white
space (that of references, too) inside a block is one blank, ends are trimmed. Nothing else
is dropped or cut.

Null, empty and text-free pages have an empty text; unclosed tags, comments and quotes end
where the page ends. Repeated rows get equal results; empty tables give empty results;
other columns aren't read. One map over the rows; memory follows the longest page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without text; their end tags are looked for literally.
INVISIBLE = frozenset("script style noscript template svg math iframe object embed canvas audio video title head select option textarea button".split())
RAW = frozenset("script style title textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLUTTER = frozenset("nav header footer aside form menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead
    footer foot sidebar aside widget related recommended recommendations share sharing social comment comments commentlist disqus respond reply replies cookie
    cookies consent notice notices notification alert popup modal newsletter subscribe signup login search pagination pager copyright toolbar teaser""".split()
)
MAIN = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article content post entry story main body text".split())
#: An element that another one of these ends when it opens inside it.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
SPACES = re.compile(r"\s+")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。、！？]")
THRESHOLD = 0.2
#: What a path passes to another for each step between the two (two at most inside an article).
SHARE = 0.55
#: The prior: factors of a clutter element and of an article; and the share of a page's text that no clutter has.
CLUTTER_FACTOR, MAIN_FACTOR, MOST_OF_PAGE = 0.02, 4.0, 0.5


class Element:
    __slots__ = ("clutter", "hidden", "link", "main", "name", "path")

    def __init__(self, name: str, path: str, above: Element | None = None):
        self.name, self.path = name, path
        self.main, self.clutter, self.hidden, self.link = (above.main, above.clutter, above.hidden, above.link) if above else (None, (), False, False)


class Block:
    """A text node: its path, the elements above it that look like clutter or an article, its text, and how much of it is links."""

    __slots__ = ("clutter", "linked", "main", "path", "text")

    def __init__(self, path: str, clutter: tuple, main, text: str, linked: int):
        self.path, self.clutter, self.main, self.text, self.linked = path, clutter, main, text, linked


def _open(above: Element, name: str, attributes: str) -> Element:
    marks, role, hidden = set(), "", name in INVISIBLE
    label = name
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key in ("class", "id"):
                label += f".{value.lower()}"
                marks |= set(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower()))
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
    out = Element(name, f"{above.path}/{label}" if name not in INLINE else above.path, above)
    out.hidden |= hidden
    out.link |= name == "a"
    if name in MAIN or role == "main":
        out.main = out
    elif name not in ("html", "body"):
        own = name in CLUTTER and not (name == "header" and above.main) or role in ROLES or marks & WORDS and not marks & MAIN_WORDS and name not in INLINE
        if own:
            out.clutter = (*above.clutter, out)
    return out


def blocks(page: str) -> list[Block]:
    """Each visible block, in page order."""
    stack = [Element("", "")]
    out: list[Block] = []
    buffer: list[str] = []
    holder, linked = stack[0], 0

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = SPACES.sub(" ", "".join(buffer)).strip(" ")
            if text:
                out.append(Block(holder.path, holder.clutter, holder.main, text, min(linked, len(text))))
            buffer, linked = [], 0

    def say(text: str) -> None:
        nonlocal holder, linked
        if text and not stack[-1].hidden:
            top = stack[-1]
            if (top.path, top.clutter) != (holder.path, holder.clutter):
                flush()
                holder = top
            buffer.append(html.unescape(text))
            linked += top.link and len(text)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                spot = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
                if spot and all(e.name in INLINE for e in stack[spot:]):
                    del stack[spot:]
                continue
            spot = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            flush()
            if spot:
                del stack[spot:]
            continue
        if name == "br":
            say(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
            # Inline elements and paragraphs end where a block begins.
            while len(stack) > 1 and (stack[-1].name in INLINE or stack[-1].name == "p" or stack[-1].name in CLOSED_BY and name in CLOSED_BY[stack[-1].name]):
                stack.pop()
        element = _open(stack[-1], name, m[3])
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not m[0].endswith("/>") or name in INLINE or element.hidden:
            stack.append(element)
    flush()
    return out


def _priors(parts: list[Block]) -> list[float]:
    """What the names around each block say of it."""
    whole = sum(len(b.text) for b in parts)
    inside: dict[Element, int] = {}
    mains: dict[Element | None, set] = {}
    for b in parts:
        for e in b.clutter:
            inside[e] = inside.get(e, 0) + len(b.text)
    # An element that holds most of the text is none of the clutter, unless an article with text stands outside it.
    big = {e for e, n in inside.items() if n >= MOST_OF_PAGE * whole}
    for e in list(big):
        mains[e] = {b.main for b in parts if b.main is not None and e not in b.clutter}
        if mains[e]:
            big.discard(e)
    return [CLUTTER_FACTOR if any(e not in big for e in b.clutter) else MAIN_FACTOR if b.main is not None else 1.0 for b in parts]


def _apart(a: list[str], b: list[str]) -> int | None:
    """Steps from path b's end up to what it shares with a, and down to a; None if that is no more than the page's body."""
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if all(step.split(".")[0] in ("", "html", "body") for step in b[:k]):
        return None
    return max(len(a) + len(b) - 2 * k - 1, 1)


def chosen(parts: list[Block], threshold: float | None = None) -> list[bool]:
    """Whether each block is content."""
    priors = _priors(parts)
    keys = list(zip((b.path for b in parts), priors))
    sums: dict[tuple[str, float], list[float]] = {}
    for key, b in zip(keys, parts):
        s = sums.setdefault(key, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(PUNCTUATION.findall(b.text))
        s[3] += b.linked
    ratio = {k: length / n * (1 + points / n) for k, (n, length, points, _) in sums.items()}
    # Smooth along the page: a path takes something from those that it stands next to.
    near: dict[tuple[str, float], list[float]] = {}
    for a, b in zip(keys, keys[1:]):
        if a != b:
            near.setdefault(a, []).append(ratio[b])
            near.setdefault(b, []).append(ratio[a])
    smooth = {k: 0.9 * r + 0.1 * sum(near.get(k, [r])) / len(near.get(k, [r])) for k, r in ratio.items()}
    # Fuse: the strongest paths of a page pass shares to those close to them.
    strong = sorted(smooth, key=lambda k: -smooth[k] * k[1])[:8]
    steps = {k: k[0].split("/") for k in smooth}
    value = {}
    for key, own in smooth.items():
        shares = (smooth[s] * SHARE ** (min(d, 2) if key[1] > 1 else d) for s in strong if s[1] == key[1] and s != key and (d := _apart(steps[s], steps[key])) is not None)
        n, length, _, linked = sums[key]
        # Links count for little, but in an article.
        free = 1.0 if key[1] > 1 else max(1 - linked / max(length, 1), 0.02)
        value[key] = max(own, *shares, 0.0) * key[1] * free
    least = (THRESHOLD if threshold is None else threshold) * max(value.values(), default=0.0)
    return [value[k] >= least for k in keys]


def main_text(page: str | None) -> str:
    parts = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(parts, chosen(parts)) if keep)


def _extracted(batches):
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
