"""HTML main text by tag-path ratios: text length and punctuation aggregated per root-to-leaf tag path."""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Element names of the HTML standard, by how they bear on text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas audio video xmp noembed noframes".split())
LINES = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("nav footer aside form button select option label fieldset dialog menu head datalist input search".split())
CLOSES_P = LINES - frozenset("body head html td th tr tbody thead tfoot caption option optgroup legend summary".split())
# Words of class, id or role whose paths weigh nothing. WEAK ones are common words too (share-price, side-effects) and count only as
# whole classes; the others also beside each other and beside words of layout, as in ad-banner or comments-list.
WEAK = frozenset("header form more side rail notice notices share sharing social reply replies respond search foot alert promotion discussion trending related comment dialog menu navigation".split())
MARKS = WEAK | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner popup modal overlay cookie cookies consent gdpr "
    "nav navbar breadcrumb breadcrumbs sidebar aside widget recommended comments commentlist disqus footer masthead topbar toolbar pagination pager subscribe "
    "newsletter signup login contentinfo complementary".split()
)
LAYOUT = frozenset("list box wrap wrapper container area block section left right top bottom site page inner outer unit slot bar item items global primary secondary row col links link".split())
# Block elements too small to be an article.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li td tr tbody pre".split())
# Elements whose text belongs to the paragraphs around it, though it is short and has few stops.
BETWEEN = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
SPLIT, STOPS = re.compile(r"[^a-z]+"), ".,;:!?…。，、！？؟"


@dataclass
class Block:
    """A run of text between the edges of block elements; its path names tags with their classes, `marked` if a word of MARKS is among them."""

    path: str
    names: tuple[str, ...]
    holders: tuple[int, ...]
    marked: bool
    parts: list[str] = field(default_factory=list)

    def text(self) -> str:
        text = "".join(self.parts)
        return " ".join((html.unescape(text) if "&" in text else text).split())


def blocks(page: str, spared: Container[int] = (), named: bool = True) -> list[tuple[Block, str]]:
    """The page's text blocks outside of raw and aside elements, with their paths and enclosing elements.

    Spared elements are neither left out nor marked, unless named is false and a whole word marks them.
    """
    found: list[Block] = []
    stack: list[tuple[str, int, bool, str, bool]] = []  # name, number, skipped, step of the path, marked
    current: Block | None = None
    number = skipping = at = 0

    def put(text: str) -> None:
        nonlocal current
        if skipping:
            return
        if current is None:
            if not text.strip():
                return
            names, holders, _, steps, marks = zip(*stack) if stack else ((),) * 5
            current = Block("/".join(steps), names, holders, any(marks))
            found.append(current)
        current.parts.append(text)

    def pop() -> None:
        nonlocal skipping, current
        name, _, skipped, *_ = stack.pop()
        skipping -= skipped
        if name in LINES:
            current = None

    start = 0
    while (edge := page.find("<", start)) >= 0:
        m = TOKEN.match(page, edge)
        if m is None:  # a sign in the text
            start = edge + 1
            continue
        if edge > at:
            put(page[at:edge])
        at = start = m.end()
        if m[0].startswith("<![CDATA["):
            put(html.escape(m[0][9:-3]))
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if place is not None and (name in LINES or all(n not in LINES for n, *_ in stack[place:])):
                while len(stack) > place:
                    pop()
            elif place is not None:
                # an inline element closed across blocks: only it goes
                skipping -= stack[place][2]
                del stack[place]
            elif name in ("p", "br"):
                current = None
            continue
        if name == "br":
            put(" ")
            continue
        if name in RAW:
            if not m[0].endswith("/>") or name not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = start = end.end() if end else len(page)
            continue
        if name in LINES:
            current = None
            if name in CLOSES_P:
                _close(stack, pop, {"p"}, LINES - {"p"})
            if name == "li":
                _close(stack, pop, {"li"}, frozenset({"ul", "ol", "menu"}))
            elif name in ("dt", "dd"):
                _close(stack, pop, {"dt", "dd"}, frozenset({"dl"}))
            elif name in ("td", "th", "tr"):
                _close(stack, pop, {"td", "th"} | ({"tr"} if name == "tr" else set()), frozenset({"table"}))
        if name in VOID:
            continue
        number += 1
        bound = number not in spared or not named and _named(name, m[3])
        skipped = bound and (name in ASIDE or name == "header" and all(n not in ("article", "main") for n, *_ in stack))
        kinds = CLASS.search(m[3]) if m[3] and name in LINES else None
        step = f"{name}.{'.'.join((kinds[1] or kinds[2] or kinds[3] or '').lower().split())}" if kinds else name
        stack.append((name, number, skipped, step, bound and _marked(name, m[3])))
        skipping += skipped
    put(page[at:])
    return [(b, t) for b in found if (t := b.text())]


def _close(stack: list, pop: object, names: set[str], limits: frozenset[str]) -> None:
    """Closes the nearest open element of the names, unless one of the limits is open inside of it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in names:
            if stack[i][0] == "p":
                # inline elements that stay open go on in the next block
                inline = [x for x in stack[i + 1 :]]
                del stack[i + 1 :]
                pop()
                stack.extend(inline)
            else:
                while len(stack) > i:
                    pop()
            return
        if stack[i][0] in limits:
            return


def _marked(name: str, attributes: str) -> bool:
    """Whether class, id or role call the element something else than article text."""
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    return any(_mark(w) for m in ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split())


def _mark(token: str) -> bool:
    if token in MARKS:
        return True
    words = [w for w in SPLIT.split(token) if len(w) > 1]
    return any(w in MARKS - WEAK for w in words) and all(w in MARKS or w in LAYOUT for w in words)


def _named(name: str, attributes: str) -> bool:
    """Whether the element's name, other than form, or a whole word of its class, id or role marks it."""
    return name in ASIDE - {"form"} or any(w in MARKS for m in ATTRIBUTE.finditer(attributes or "") for w in (m[2] or m[3] or m[4] or "").lower().split())


def wrappers(page: str) -> tuple[set[int], bool]:
    """Elements that hold the greater part of the text and punctuation of all article and main elements from outside; without these, of the page. And whether there are such."""
    found = [(b, t, b.names) for b, t in blocks(page, range(1, len(page) + 1))]
    inner = [(b, t, min(names.index(n) for n in ("article", "main") if n in names)) for b, t, names in found if "article" in names or "main" in names]
    base = [(b.holders[:k], t) for b, t, k in inner] or [(b.holders, t) for b, t, _ in found]
    held: dict[int, list[int]] = {}
    for holders, text in base:
        stops = sum(map(text.count, STOPS))
        for i in holders:
            row = held.setdefault(i, [0, 0])
            row[0] += len(text)
            row[1] += stops
    size, stops = sum(len(t) for _, t in base), sum(sum(map(t.count, STOPS)) for _, t in base)
    return {i for i, (n, m) in held.items() if 2 * n > size and 2 * m >= stops}, bool(inner)


def path_scores(found: list[tuple[Block, str]]) -> dict[str, float]:
    """Each path's fused ratio: mean text length by mean punctuation of its blocks, each smoothed over neighbouring paths.

    Paths through marked elements weigh nothing: their text counts for their neighbours only.
    """
    order: dict[str, list[float]] = {}
    marked = {b.path: b.marked for b, _ in found}
    for block, text in found:
        row = order.setdefault(block.path, [0, 0, 0])
        row[0] += len(text)
        row[1] += sum(map(text.count, STOPS))
        row[2] += 1
    total = np.array(list(order.values()))
    ratios = total[:, :2] / total[:, 2:]
    if len(ratios) > 2:
        near = np.concatenate([ratios[:1], ratios, ratios[-1:]])
        ratios = 0.15 * near[:-2] + 0.7 * near[1:-1] + 0.15 * near[2:]
    fused = np.sqrt(ratios[:, 0] * (ratios[:, 1] + 0.1)) * [not marked[p] for p in order]
    return dict(zip(order, fused.tolist()))


def main_text(page: str, strength: float = 0.5) -> str:
    """The article of a page; empty if there is none.

    Paths whose score passes `strength` standard deviations (at most half the best) select content nodes. The article is
    the innermost article or main element that holds most of their text, given whole in page order but for paths that weigh nothing; without
    such an element the smallest block element, of which the selected paths count, and headings, lists and tables between their blocks.
    """
    found = blocks(page, *wrappers(page))
    if not found:
        return ""
    score = path_scores(found)
    values = np.array(list(score.values()))
    threshold = min(strength * float(values.std()) if len(values) > 1 else 0.0, float(values.max()) / 2)
    chosen = [(b, len(t)) for b, t in found if score[b.path] >= threshold]
    held: dict[int, int] = {}
    for block, size in chosen:
        for i in block.holders:
            held[i] = held.get(i, 0) + size
    total = sum(size for _, size in chosen)
    names = {i: n for b, _ in chosen for i, n in zip(b.holders, b.names)}
    most = [i for i, n in held.items() if n > 0.6 * total and names[i] in LINES - PARTS]
    inside = max((i for i in most if names[i] in ("article", "main")), default=None)
    sure = inside is not None
    inside = inside if sure else max(most, default=None)
    here = [(b, t, score[b.path] >= threshold) for b, t in found if inside is None or inside in b.holders]
    if sure:
        return "\n\n".join(t for b, t, good in here if good or not b.marked)
    first, last = (next((i for i in order if here[i][2]), 0) for order in (range(len(here)), range(len(here) - 1, -1, -1)))
    return "\n\n".join(t for i, (b, t, good) in enumerate(here) if good or not b.marked and not BETWEEN.isdisjoint(b.names) and (first < i < last or b.names[-1][:1] == "h" and i < last))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html give an empty text. Pages are read whole, whatever their length; repeated rows give
    a row each; an empty table gives none; other columns are not read.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(each, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
