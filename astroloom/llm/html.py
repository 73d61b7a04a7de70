"""Operator 9, HTML extraction by two-pass block rules.

The whole page is tokenised into blocks, the text between block-level tags;
character references are decoded. Scripts, styles, comments, controls and hidden
elements show no text and fall away with the markup. Every other block is judged
by the two passes and by nothing else.

Pass one, without context. A block that is mostly links is bad (a paragraph or a
heading inside an article is left open instead); so is one with a copyright sign
outside an article. A long block (``LONG_WORDS``) rich in stop words is good, a
long one without them bad outside an article and open inside. Short blocks are
open. Stop words cover English, German, French and Spanish: where no long block
of a page is rich in them, its language is taken for another one, and long
blocks of low link density count as rich.

Pass two: an open block takes the label of its nearest decided neighbour. Blocks
between them count one each; another container between them counts ``BOUNDARY``.

Containers are evidence beside the text's own features; none drops a block by
itself. An article or main element acts as a good neighbour ``BOUNDARY`` blocks
away, a container that is boilerplate by its element, role, class or id as a bad
one as far away (one more where the name is a doubtful one, or the block only
lies outside a page's article). Of two as near, the evidence decides. Long rich
blocks in boilerplate containers are held back: they are bad where the page has
other good text or an article. Where it has neither, those in named containers
and forms are good.
Inside an article only names that articles don't use for their own text are
plain evidence (``STRONG_NAMES``), others (notice, discussion) are doubtful: a
long rich block stays good. Ids of headings and of an article's sections are
anchors and say nothing. On a page without good text, open blocks stay unless
their container is boilerplate.

Results in unusual cases: null and empty pages give an empty text; unclosed or
stray tags and cut-off tags or references never fail, a cut-off reference stays
as it is written; a page without any markup is one block; text after an unclosed
script or style is not shown, as in a browser; very long pages are read whole, in
time proportional to their length; repeated rows stay; an empty table gives an
empty result; only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, raw_texts, table

#: Function words of four languages; a block rich in them is running text.
STOP_WORDS = frozenset(
    (
        "the of and to in is it that for was on are as with at be this have from by not or an a he she they we you i "
        "der die das und ist in zu den mit von auf für im ein eine nicht des dem sich auch es an als wie bei oder "
        "le la les de des et est un une que qui dans pour sur pas en du au il elle ce se plus par avec "
        "el los las y que en un una por con para del se no es lo como su al más o"
    ).split()
)

BLOCK_TAGS = frozenset(
    (
        "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset "
        "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
        "menu nav ol optgroup option p pre section select summary table tbody td template textarea tfoot th thead "
        "title tr ul iframe object noscript svg"
    ).split()
)
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content holds no markup; without an end tag they run to the page's end.
RAW_TAGS = ("script", "style", "textarea", "title", "xmp", "iframe", "noframes")
#: Controls and embedded documents: no text of the page.
UNSHOWN_TAGS = frozenset("select button datalist dialog noscript template iframe svg object".split())
#: Boilerplate by their element; a header only outside an article.
STRONG_TAGS = frozenset("nav footer aside menu form fieldset".split())
#: Elements that may wrap a whole page.
WRAPPERS = frozenset("form fieldset".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split()
)
#: Words of a class or id that boilerplate containers have.
BOILERPLATE_NAMES = frozenset(
    (
        "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot adunit banner "
        "sponsor sponsored sponsors promo promotion "
        "sidebar sidenav rail aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar "
        "cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe signup "
        "comment comments commentlist disqus replies responses reactions discussion respond related recommended share sharing social "
        "widget toolbar pagination pager login search"
    ).split()
)
#: Of these, those that no part of an article's own text is named.
STRONG_NAMES = frozenset(
    (
        "ad ads adverts advertisement advertisements advertising adsense adsbygoogle adbox adslot adunit sponsored sponsors sidebar "
        "sidenav navbar breadcrumb breadcrumbs gdpr newsletter comment comments commentlist disqus pagination pager menubar"
    ).split()
)
#: Names that only say something outside an article (it may have a header of its own).
PAGE_NAMES = frozenset("header heading head top".split())
#: Classes of an <article> that is not the page's own.
ASIDE_ARTICLES = frozenset(
    "ad ads advert advertisement comment comments promo recommended related reply response sponsored teaser".split()
)
#: WordPress puts these before a post's terms.
TERMS = frozenset("category tag type format status".split())
#: ``has-sidebar`` is no sidebar.
MODIFIERS = frozenset("has have with no not without".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = HEADINGS | frozenset("p pre blockquote".split())
#: A new one of these ends an open one of its own kind.
SIBLINGS = frozenset("p li td th tr dd dt option".split())
BARRIERS = frozenset("article main body html".split())

LONG_WORDS = 12
STOP_DENSITY = 0.12
LINK_DENSITY = 0.4
#: What another container between two blocks adds to their distance.
BOUNDARY = 4

PLAIN, DOUBTFUL, STRONG = 0, 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:[\"'][^>]*)?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HREF = re.compile(r"\bhref\b", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_WORD = re.compile(r"\w+")


@dataclass(slots=True)
class Place:
    """What an open element says of the text inside it."""

    tag: str
    hidden: bool = False
    level: int = PLAIN
    named: bool = False  # the level comes from a name or a wrapper, not from a boilerplate element
    container: int = 0
    article: bool = False
    text_tag: bool = False


@dataclass(slots=True)
class Block:
    text: str
    n: int
    density: float
    links: float
    place: Place
    label: str = ""
    why: str = ""

    def long(self) -> bool:
        doubted = self.place.level == DOUBTFUL and not self.place.article
        return self.n >= LONG_WORDS * (2 if doubted else 1)

    def judge(self, known: bool) -> None:
        """Pass one. ``known``: whether the page's language is one of the stop words'."""
        article = self.place.article and self.place.level < STRONG
        if self.links > LINK_DENSITY:
            open_ = article and self.place.text_tag
            self.label, self.why = ("open", "short") if open_ else ("bad", "links")
        elif not article and "©" in self.text:
            self.label, self.why = "bad", "copyright"
        elif not self.long():
            self.label, self.why = "open", "short"
        elif known and self.density < STOP_DENSITY:
            self.label, self.why = ("open", "no stop words") if article else ("bad", "no stop words")
        else:
            self.label, self.why = ("held", "long") if self.place.level == STRONG else ("good", "long")


def _names(value: str) -> list[str]:
    return _NAME.findall(_CAMEL.sub(r"\1 \2", value).lower())


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)] if text else []


def _name_level(value: str, in_article: bool) -> int:
    """What one class or id says."""
    found = _names(value)
    if not found or not MODIFIERS.isdisjoint(found):
        return PLAIN
    if in_article:
        return STRONG if found[-1] in STRONG_NAMES else DOUBTFUL if found[-1] in BOILERPLATE_NAMES else PLAIN
    if found[-1] in BOILERPLATE_NAMES:
        return STRONG
    return PLAIN if (BOILERPLATE_NAMES | PAGE_NAMES).isdisjoint(found) else DOUBTFUL


def _beside(value: str) -> bool:
    """Whether a class of an <article> says that it is a comment, a teaser or an advert."""
    found = _names(value)
    if not found or found[0] in TERMS or not MODIFIERS.isdisjoint(found):
        return False
    return len(found) == 1 and found[0] in ASIDE_ARTICLES or found[-1] in ("comment", "teaser")


class _Reader:
    """Turns a page into blocks."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[Place] = [Place("")]
        self.open: dict[str, list[int]] = defaultdict(list)  # where in the stack each element is open
        self.barriers = [0]
        self.pieces: list[str] = []
        self.linked = 0
        self.link_depth = 0  # of the open link, 0 for none
        self.containers = 0

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text:
                ws = _WORD.findall(text.lower())
                density = sum(w in STOP_WORDS for w in ws) / len(ws) if ws else 0.0
                self.out.append(Block(text, len(ws), density, self.linked / len(text), self.stack[-1]))
        self.linked = 0

    def show(self, raw: str) -> None:
        if raw and not self.stack[-1].hidden:
            text = entities.unescape(raw)
            self.pieces.append(text)
            if self.link_depth:
                self.linked += len("".join(text.split()))

    def pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag].pop()
        while self.barriers[-1] >= depth:
            self.barriers.pop()
        if self.link_depth > depth:
            self.link_depth = 0

    def close(self, tag: str) -> None:
        where = self.open.get(tag)
        # A stray end tag does not close the article around it.
        if where and (tag in BARRIERS or where[-1] > self.barriers[-1]):
            self.pop(where[-1])

    def end_optional(self, tag: str) -> None:
        """Ends a paragraph before a block, an item before the next one."""
        for kind in {"p", tag} if tag in SIBLINGS else ("p",):
            top = len(self.stack) - 1
            while top and self.stack[top].tag not in BLOCK_TAGS:
                top -= 1
            if top and self.stack[top].tag == kind:
                self.pop(top)

    def push(self, tag: str, text: str) -> None:
        up = self.stack[-1]
        attributes = _attributes(text)
        here = Place(tag, up.hidden or tag in UNSHOWN_TAGS, up.level, up.named, up.container, up.article, up.text_tag)
        if tag in BLOCK_TAGS:
            here.text_tag = tag in TEXT_TAGS
        level, named, main = PLAIN, False, tag in ("article", "main")
        if tag in STRONG_TAGS or tag == "header" and not up.article:
            level, named = STRONG, tag in WRAPPERS
        for name, value in attributes:
            if name == "hidden" or name == "style" and _HIDDEN.search(value.lower()):
                here.hidden = True
            elif name == "role":
                role = value.strip().lower()
                main = main or role == "main"
                if role in ROLES and level < STRONG:
                    level, named = STRONG, role == "form"
            elif name == "class" and tag == "article":
                if any(map(_beside, value.split())):
                    level, named = STRONG, True
            elif name in ("class", "id") and tag not in BARRIERS:
                if name == "id" and (tag in HEADINGS or up.article and tag == "section"):
                    continue
                own = max((_name_level(x, up.article) for x in value.split()), default=PLAIN)
                if own > level:
                    level, named = own, True
        if main:
            here.article = True
            if up.level < STRONG or up.named and tag == "main":
                here.level, here.named = PLAIN, False
        if level > here.level or level == STRONG and not named:
            here.level, here.named = level, named
        if main or level:
            self.containers += 1
            here.container = self.containers
        self.open[tag].append(len(self.stack))
        if tag in BARRIERS:
            self.barriers.append(len(self.stack))
        self.stack.append(here)

    def read(self, page: str) -> list[Block]:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                self.show(page[at:])
                break
            self.show(page[at : m.start()])
            at = m.end()
            if m[1] is None:
                continue
            tag, closing = m[1].lower(), page[m.start() + 1] == "/"
            if tag == "a":
                self.link_depth = len(self.stack) if not closing and _HREF.search(m[2]) else 0
                continue
            empty = tag in VOID_TAGS or m[2].rstrip().endswith("/")
            if not closing and tag in _RAW_END and not empty:
                self.end_block()
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else n
                continue
            if tag in BLOCK_TAGS:
                self.end_block()
            if closing:
                self.close(tag)
            elif not empty:
                if tag in BLOCK_TAGS:
                    self.end_optional(tag)
                if tag in BLOCK_TAGS or m[2].strip():
                    self.push(tag, m[2])
        self.end_block()
        return self.out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in their order."""
    return _Reader().read(page)


def _sides(found: list[Block], order: range) -> list[tuple[int | None, int | None]]:
    """For each block, in ``order``, the last decided block before it: any, and
    of its own container."""
    last, own = None, {}
    out: list[tuple[int | None, int | None]] = [(None, None)] * len(found)
    for i in order:
        b = found[i]
        out[i] = last, own.get(b.place.container)
        if b.label != "open":
            last = own[b.place.container] = i
    return out


def _evidence(b: Block, names_article: bool) -> tuple[str, int] | None:
    """A block's container as a neighbour: its label and distance."""
    if b.place.level == STRONG:
        return "bad", BOUNDARY
    if b.place.level == DOUBTFUL:
        return "bad", BOUNDARY + 1
    if b.place.article:
        return "good", BOUNDARY
    return ("bad", BOUNDARY + 1) if names_article else None


def label(found: list[Block]) -> None:
    """Both passes: every block's ``label`` becomes good or bad, and ``why``."""
    for known in (True, False):
        for b in found:
            b.judge(known)
        if any(b.label in ("good", "held") for b in found) or not any(b.why == "no stop words" for b in found):
            break
    article = any(b.place.article and b.place.level < STRONG for b in found)
    good = any(b.label == "good" for b in found)
    for b in found:
        if b.label == "held":
            rescued = b.place.named and not good and not article
            b.label, b.why = ("good" if rescued else "bad"), "container of a long block"
    good = any(b.label == "good" for b in found)
    names_article = article or any(b.place.article and b.label == "good" for b in found)
    before = _sides(found, range(len(found)))
    after = _sides(found, range(len(found) - 1, -1, -1))
    final: list[tuple[Block, str, str]] = []
    for i, b in enumerate(found):
        if b.label != "open":
            continue
        own = _evidence(b, names_article)
        near: list[tuple[int, bool, str, str]] = []
        for j in {*before[i], *after[i]} - {None}:
            distance = abs(i - j) + (BOUNDARY if found[j].place.container != b.place.container else 0)
            near.append((distance, own is not None and own[0] != found[j].label, found[j].label, "neighbour"))
        if own:
            near.append((own[1], False, own[0], "container"))
        distance, _, chosen, why = min(near, key=lambda x: (x[0], x[1], x[2] != "good", x[3])) if near else (0, False, "good", "alone")
        if not good and b.place.level == PLAIN and b.links <= LINK_DENSITY:
            chosen, why = "good", "alone"
        final.append((b, chosen, why))
    for b, chosen, why in final:
        b.label, b.why = chosen, why


def main_text(page: str) -> str:
    """The good blocks, joined by one space."""
    found = blocks(page)
    label(found)
    return " ".join(b.text for b in found if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t.decode()) for t in raw_texts(batch.column("html"))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_batches(pages, run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html": op9_html}
SQL: dict[str, str] = {}
