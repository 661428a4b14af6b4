"""Main text of pages by two passes of block rules.

The page is cut into blocks at block tags. Pass one decides blocks by where they
stand (menus, headers, footers, forms, adverts, comments are out by tag, role,
class or id), by link density, length and stop-word density; short blocks stay
undecided. A class or id puts nothing out that holds the page's only marked article and most of its text, nor,
if just a part of it names such a place, nearly all of the text. Where the longer blocks of a page hardly have a known stop word among them, its language is
unknown, and length and link density decide. Pass two gives each undecided block the label of its nearest decided
neighbours (of those in the article, if it is marked); if they differ, the nearer one counts, and headings look ahead. If the page
marks its article (``article``, ``main``, role or itemprop), blocks outside it are out,
and inside it length alone decides, since an article may be a list or a table.

Null and empty html, and pages without such text, give an empty text. Tags that are
not closed, closed twice or cut off end where the next one begins. Each row is taken for
itself: repeated rows give equal results, an empty table none. Other columns are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import map_batches

MAX_LINKS, SHORT, LONG, FEW_STOPS, MANY_STOPS = 0.5, 70, 200, 0.12, 0.25
SHORT_INSIDE = 25
#: Letters of scripts without spaces between words, each of which counts as three of others: Thai to Tibetan, Khmer, kana, Han, Hangul.
_DENSE = re.compile(r"[\u0e01-\u0e4e\u0e81-\u109f\u1780-\u17d3\u3041-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")

#: Frequent words of the languages expected.
STOP_WORDS = frozenset(
    (
        "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its"
        " more not of on one or other our out she so than that the their there they this to up was we were what when which who"
        " will with would you"
        " aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat"
        " ich im ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war werden wie wird wir zu zum zur"
        " au aux avec ce ces cette dans de des du elle en est et été être il ils je la le les leur lui mais ne nous on ou par"
        " pas pour plus que qui sa se ses son sont sur un une vous"
        " al como con cual de del desde donde el ella en entre era es esta este ha han hay la las lo los más me mi muy no nos o"
        " para pero por que se ser si sin sobre son su sus también un una y ya"
    ).split()
)

#: Tags.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary"
    " table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = frozenset(
    "head nav footer aside form menu dialog button select textarea object canvas audio video map datalist template".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
OUT_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar side aside ad ads adv advert adverts advertisement"
    " advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login register share sharing social related recommended recommendations teaser comment comments"
    " commentlist respond reply replies disqus pagination pager toolbar widget search skip tags copyright".split()
)

OUT_NAMES_OUTSIDE = OUT_NAMES | {"header"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math)\b[^<>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*>?"
    r"""|<(?P<close>/?)(?P<tag>[a-z][^\s/<>]*)(?P<attributes>(?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+'|["'])*+)>?"""
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-z][a-z0-9:_-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Parts of names that speak of a layout, not of the element.
_LAYOUT = frozenset("has have no not non with without by is hide show enabled disabled layout".split())


class Named:
    """An element that its class or id puts out, unless ``lifted``; ``weak`` if only a part of the name says so."""

    __slots__ = ("parent", "weak", "lifted", "out", "top")

    def __init__(self, parent: Named | None, weak: bool) -> None:
        self.parent, self.lifted, self.out = parent, False, True
        self.weak = weak and (parent is None or parent.weak)
        self.top = parent.top if parent else self


class Block:
    __slots__ = ("text", "links", "out", "inside", "heading", "label", "named", "around")

    def __init__(self, text: str, links: int, out: bool, inside: bool, heading: bool, named: Named | None, around: Named | None) -> None:
        self.text, self.links, self.out, self.inside, self.heading = text, links, out, inside, heading
        self.named, self.around = named, around  # the innermost element put out by name, and that around the article
        self.label: bool | None = None


def by_name(value: str, out_names: frozenset[str]) -> int:
    """2 if a name of a class or id, or the last part of one, is of ``out_names``, 1 if another part is, else 0."""
    found = 0
    for name in value.split():
        parts = _NAME.findall(name)
        if parts and not _LAYOUT.intersection(parts):
            found = max(found, 2 if parts[-1] in out_names else int(not out_names.isdisjoint(parts)))
    return found


def place(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, int]:
    """Whether an element is out of the text, whether it is the article, and ``by_name`` of its class and id."""
    named = 0
    main = tag in ("article", "main")
    out = tag in OUT_TAGS or (tag == "header" and not inside)
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "role":
                out |= value in OUT_ROLES
                main |= value in ("main", "article")
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                named = max(named, by_name(value, OUT_NAMES if inside else OUT_NAMES_OUTSIDE))
            elif name == "itemprop":
                main |= value == "articlebody"
            elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "")):
                out = True
            elif name == "aria-hidden":
                out |= value == "true"
    return out, main, named


def cut(page: str) -> list[Block]:
    """Blocks of a page in order, those without text left out."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, bool, Named | None, Named | None]] = []  # tag, out, inside, named, around
    nothing = ("", False, False, None, None)
    names: list[Named] = []
    parts: list[str] = []
    opened: Counter[str] = Counter()
    links = anchor = 0
    heading = False

    def leave(tag: str) -> None:
        while True:
            own = stack.pop()[0]
            opened[own] -= 1
            if own == tag:
                return

    def end() -> None:
        nonlocal links, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, out, inside, named, around = stack[-1] if stack else nothing
            blocks.append(Block(text, min(links, len(text)), out, inside, heading, named, around))
        parts.clear()
        links, heading = 0, False

    for token in _TOKEN.finditer(page):
        kind = token.lastgroup
        if kind == "text":
            parts.append(token["text"])
            if anchor:
                links += len(token["text"])
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            anchor = 0 if token["close"] else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCKS and tag not in OUT_TAGS and not (token["attributes"] and ("=" in token["attributes"])):
            if token["close"] and opened[tag]:
                end()
                leave(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                end()
            continue
        block = tag in BLOCKS or tag in OUT_TAGS
        if token["close"]:
            if opened[tag]:
                end()
                leave(tag)
            elif block:
                end()
            continue
        _, out, inside, named, around = stack[-1] if stack else nothing
        if block and tag != "title" and opened["head"]:
            end()
            leave("head")
            _, out, inside, named, around = stack[-1] if stack else nothing
        own_out, own_main, own_named = place(tag, token["attributes"], inside)
        if not block and not ((own_out or own_named) and not out):
            continue  # an inline element of no account
        end()
        anchor = 0
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option", "h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] == tag:
            leave(tag)
            _, out, inside, named, around = stack[-1] if stack else nothing
        elif stack and stack[-1][0] == "p":
            leave("p")
            _, out, inside, named, around = stack[-1] if stack else nothing
        if own_main and not inside:
            around = named
        if own_named:
            named = Named(named, own_named == 1)
            names.append(named)
        stack.append((tag, out or own_out, inside or own_main, named, around))
        opened[tag] += 1
        heading = tag[0] == "h" and tag[1:].isdigit()
    end()
    lift(blocks)
    for n in names:  # parents come first
        n.out = not n.lifted or (n.parent is not None and n.parent.out)
    for b in blocks:
        b.out |= b.named is not None and b.named.out
    return blocks


def lift(blocks: list[Block]) -> None:
    """Mark the elements whose names must not put them out, by the text that they hold."""
    rest = held = total = 0
    parts: Counter[Named] = Counter()
    for b in blocks:
        size = len(b.text)
        if b.out or size < SHORT or b.links > MAX_LINKS * size:
            continue
        total += size
        if b.named is None:
            rest += size
        elif b.inside and b.around:
            held += size
        if b.named is not None and b.named.weak:
            parts[b.named.top] += size
    marked = any(b.inside and not b.out and b.named is None for b in blocks)
    most = {n for n, size in parts.items() if 2 * size > total and size > 8 * rest}
    for b in blocks:
        article = not marked and held > rest and b.inside
        if b.named is None or not (article or b.named.top in most):
            continue
        n = b.around if article else b.named
        while n is not None and not n.lifted and (article or n.weak):
            n.lifted = True
            n = n.parent


def length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def stops_and_words(text: str) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def first_pass(blocks: list[Block]) -> None:
    marked = any(b.inside and not b.out for b in blocks)
    open_blocks: list[tuple[Block, int, int, int]] = []
    for b in blocks:
        size = len(b.text)
        if b.out or (marked and not b.inside) or b.links > MAX_LINKS * size:
            b.label = False
        elif b.inside:
            b.label = True if size >= SHORT_INSIDE else None
        elif "©" in b.text and size < LONG:
            b.label = False
        elif (size := length(b.text)) >= SHORT:
            open_blocks.append((b, size, *stops_and_words(b.text)))
    known = sum(x[2] for x in open_blocks) >= FEW_STOPS * sum(x[3] for x in open_blocks)
    for b, size, stops, words in open_blocks:
        if not known or stops >= MANY_STOPS * words:
            b.label = True
        elif stops < FEW_STOPS * words:
            b.label = False
        elif size >= LONG:
            b.label = True


def second_pass(blocks: list[Block]) -> None:
    marked = any(b.inside and not b.out for b in blocks)

    def counts(b: Block) -> bool:
        return b.inside and not b.out if marked else True

    before: list[tuple[int, bool] | None] = []
    last = None
    for i, b in enumerate(blocks):
        before.append(last)
        if b.label is not None and counts(b):
            last = (i, b.label)
    after, inherited = None, []
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.label is not None:
            if counts(b):
                after = (i, b.label)
            continue
        left, right = before[i], after
        if left is None and right is None:
            found = b.inside
        elif left is None or right is None:
            found = (left or right)[1]
        elif b.heading or left[1] == right[1] or right[0] - i < i - left[0]:
            found = right[1]
        else:
            found = left[1]
        inherited.append((b, found))
    for b, found in inherited:
        b.label = found


def main_text(page: str | None) -> str:
    blocks = cut(page or "")
    first_pass(blocks)
    second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points, of each page."""

    def make():
        def f(batch):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

        return f

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return map_batches(kept, make, "page_id long, url string, text string, n_chars long")
