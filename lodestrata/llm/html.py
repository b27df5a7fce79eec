"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one decides each block by
its length, link density and stop-word density.  Tags, roles and class names
are votes: they take an element's blocks away only while the densities leave
the page's prose outside of it, so a hint on an element that holds the page
itself is outvoted.  Blocks that show too little stay undecided; pass two
gives them the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrata.llm import textscan
from lodestrata.runtime import ship, small_batches

#: Frequent words of the languages that pages are written in.
STOP_WORDS = frozenset(
    """
    the of and to a in is that for it was on with as be by at this are from an or not have has had his her they you we he she but were which
    their its will would can there been if so what all when up out about who more no into than them then some could our only also
    le la les de des du un une et en est que qui dans pour pas sur par avec au aux ce il elle ne se plus son sa ses sont ou mais nous vous
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
    el la los las de y en que un una es por con no se su para al lo como más pero sus le ha me si sin sobre este ya entre cuando todo
    """.split()
)
#: Elements that never hold main text, with all that is in them.
_SKIPPED = frozenset("script style noscript template svg math iframe object select option textarea button canvas audio video head title".split())
#: Elements around page furniture; a form may also be the page's own wrapper.
_FURNITURE = frozenset("nav footer aside menu dialog".split())
_BLOCKS = frozenset(
    """address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TRACKED = _BLOCKS - _HEADINGS - frozenset("br hr p li dt dd td th tr tbody thead tfoot html body legend summary".split())
#: Parts of class names and ids of page furniture; those of the second list also count as beginnings.
_HINTS = frozenset(
    """ad ads adsense banner breadcrumb breadcrumbs copyright footer gdpr legal menu modal nav navbar navigation newsletter notice notification
    alert pagination pager popup recommended related share sharing sidebar side signup login search skip social subscribe subscription tags
    teaser toolbar topbar masthead header consent cookie cookies""".split()
)
_HINT_STARTS = ("advert", "promo", "sponsor", "widget")
#: Parts of the names of reader comments.
_COMMENTS = frozenset("comment comments commentlist respond disqus replies discussion".split())
#: Parts of names that stand for content, and parts that say of a hint that it is not there or elsewhere.
_CONTENT = frozenset("article content main post entry story body text page layout wrapper container results".split())
_DENIED = frozenset("no not non without with has is hide".split())
#: Words of calls to action and of labels around an article, in four languages.
_LABELS = frozenset(
    """advertisement advertisements advertising sponsored subscribe newsletter share tweet follow login signup register comments reply related
    anzeige werbung abonnieren teilen anmelden kommentare publicité annonce abonnez partager connexion commentaires publicidad anuncio suscríbete
    suscribirse compartir comentarios""".split()
)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORD = re.compile(r"\w+")


_SENTENCE_END = re.compile(r"[.!?…](?=\s|$)|[。！？।؟۔։]")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_FOREIGN = re.compile(r"[^\W\d_\u0000-\u024f]")

#: How much a tag or a name speaks against an element: it may be a wrapper, it is page furniture, it is not shown.
WEAK, STRONG, HIDDEN = 1, 2, 3


@dataclass(frozen=True)
class HtmlParams:
    """Lengths in characters (those of wide scripts count three times); densities are shares of characters (links) and of words (stop words).

    ``sentence``: a text with a sentence end to so many characters is prose in any language.
    """

    short: int = 70
    long: int = 200
    sentence: int = 300
    max_links: float = 0.35
    low_stop: float = 0.12
    high_stop: float = 0.25


@dataclass(eq=False)
class Element:
    """An open element that blocks lie in; ``group`` is its outermost article."""

    parent: Element | None
    name: str
    vote: int
    group: Element | None = None
    prose: int = 0
    off: bool = False
    vetoed: bool = False


@dataclass
class Block:
    where: Element | None
    vote: int = 0
    heading: bool = False
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    def close(self) -> bool:
        self.text = " ".join("".join(self.pieces).split())
        return bool(self.text)


#: The end of a tag, or the quote that opens an attribute's value.
_TAG_STEP = re.compile(r">|=\s*([\"'])")


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag, beyond quoted values; -1 if there is none."""
    first = page.find(">", at)
    while first >= 0 and (step := _TAG_STEP.search(page, at)):
        if not step[1]:
            return step.start()
        close = page.find(step[1], step.end())
        if close < 0:
            break
        at = close + 1
    return first


def _name_vote(names: str) -> int:
    """How much the class names or the id of an element speak against it."""
    vote, content = 0, False
    for name in names.split():
        parts = [part.lower() for part in _NAME_PARTS.findall(name)]
        own = [part in _HINTS or part in _COMMENTS or part.startswith(_HINT_STARTS) for part in parts]
        inner = any(part in _CONTENT for part in parts)
        if not any(own):
            content = content or inner
        elif not any(part in _DENIED for part in parts):
            sure = own[-1] and (not inner or parts[-1] in _COMMENTS)
            vote = max(vote, STRONG if sure else WEAK)
    return WEAK if vote and content else vote


def _vote(name: str, attributes: str, in_article: bool) -> int:
    """How much tag, role, style and names of an element speak against it."""
    vote = STRONG if name in _FURNITURE or (name == "header" and not in_article) else WEAK if name == "form" else 0
    if not attributes or name in ("body", "html", "main"):
        return vote
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return HIDDEN
    if found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in _ROLES:
        vote = STRONG
    return max(vote, *(_name_vote(found.get(key, "")) for key in ("class", "id")))


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The page's non-empty blocks and its elements, both in order."""
    out: list[Block] = []
    elements: list[Element] = []
    here: Element | None = None
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    links = 0
    block = Block(None)

    def cut(vote: int = 0, heading: bool = False) -> None:
        nonlocal block
        if block.close():
            out.append(block)
        block = Block(here, vote, heading)

    def text(raw: str) -> None:
        if raw:
            piece = entities.unescape(raw)
            block.pieces.append(piece)
            if links:
                block.linked += sum(map(len, piece.split()))

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        follow = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if follow in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        closing = follow == "/"
        name_at = lt + 1 + closing
        if not page[name_at : name_at + 1].isalpha():
            text("<")
            at = lt + 1
            continue
        end = _tag_end(page, lt)
        if end < 0:
            text(page[lt:])
            break
        inner = page[name_at:end]
        name = re.match(r"[^\s/>]+", inner)[0].lower()
        at = end + 1
        if name in _SKIPPED and not closing:
            if not inner.endswith("/"):
                done = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if done is None:
                    unclosed.add(name)
                at = done.end() if done else (size if name in ("script", "style", "template") else at)
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name not in _BLOCKS:
            continue
        attributes = inner[len(name) :]
        if closing:
            if opened[name]:
                while here is not None:
                    top, here = here, here.parent
                    opened[top.name] -= 1
                    if top.name == name:
                        break
                links = 0
            cut()
        elif name in _TRACKED and not inner.endswith("/"):
            vote = _vote(name, attributes, here is not None and here.group is not None)
            here = Element(here, name, vote, here.group if here else None)
            if here.group is None and name in ("article", "main") and vote < STRONG:
                here.group = here
            opened[name] += 1
            elements.append(here)
            cut()
        else:
            cut(_vote(name, attributes, True) if attributes.strip() else 0, name in _HEADINGS)
    cut()
    return out, elements


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    return parse(page)[0]


def density(b: Block, p: HtmlParams = HtmlParams()) -> bool | None:
    """What length, links and stop words say of a block: main text, no main text, or too little."""
    words = [w.lower() for w in _WORD.findall(b.text)]
    size = len(b.text) + 2 * len(_WIDE.findall(b.text))
    links = b.linked / max(1, sum(map(len, b.text.split())))
    article = b.where is not None and b.where.group is not None
    if links > p.max_links:
        return False
    if size < p.short:
        labels = sum(w in _LABELS for w in words)
        return False if 2 * labels >= max(1, len(words)) or (links > 0 and not article) else None
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= p.high_stop or (stop >= p.low_stop and size >= p.long):
        return True
    ends = len(_SENTENCE_END.findall(b.text))
    foreign = 2 * len(_FOREIGN.findall(b.text)) > sum(map(len, words))
    if ends and (foreign or (size >= p.long and ends * p.sentence >= size)):
        return True
    return None if article or stop >= p.low_stop else False


def _set_vetoes(found: list[Block], labels: list[bool | None], elements: list[Element]) -> None:
    """Decide which votes stand.

    Furniture goes while any prose lies outside of it, or where it holds less
    than half of all; what may be a wrapper goes where it holds no more than
    half of the prose that furniture leaves.
    """

    counted = [
        label or (label is None and b.where is not None and b.where.group is not None) for b, label in zip(found, labels, strict=True)
    ]  # an article's undecided blocks count as its prose

    def weigh(skip) -> int:
        """Prose of every element and of the page, but for that in skipped elements."""
        total = 0
        for e in elements:
            e.prose, e.off = 0, skip(e) or (e.parent is not None and e.parent.off)
        for b, full in zip(found, counted, strict=True):
            if full and b.vote < STRONG and not (b.where and b.where.off):
                total += len(b.text)
                if b.where:
                    b.where.prose += len(b.text)
        for e in reversed(elements):
            if e.parent:
                e.parent.prose += e.prose
        return total

    free = weigh(lambda e: e.vote >= STRONG)
    total = weigh(lambda e: e.vote == HIDDEN)
    for e in elements:
        e.vetoed = e.vote == HIDDEN or (e.vote == STRONG and (free > 0 or 2 * e.prose < total))
    total = weigh(lambda e: e.vetoed)
    for e in elements:
        e.vetoed = e.vetoed or (e.vote == WEAK and 2 * e.prose <= total > 0)
    weigh(lambda e: e.vetoed)
    for at, b in enumerate(found):
        if b.vote >= STRONG or (b.where and b.where.off):
            labels[at] = False


def classify(found: list[Block], elements: list[Element], p: HtmlParams = HtmlParams()) -> list[bool]:
    """Which blocks are main text.

    Undecided blocks look at decided ones of the same article (or outside of
    all): a heading at the next one, others at the nearest; of two as near, one
    of main text is enough.  Without any, they are main text.
    """
    labels = [density(b, p) for b in found]
    _set_vetoes(found, labels, elements)
    group = [id(b.where.group) if b.where is not None and b.where.group is not None else 0 for b in found]
    behind, ahead = [-1] * len(found), [-1] * len(found)
    for places, order in ((behind, range(len(found))), (ahead, range(len(found) - 1, -1, -1))):
        last: dict[int, int] = {}
        for at in order:
            places[at] = last.get(group[at], -1)
            if labels[at] is not None:
                last[group[at]] = at
    out = []
    for at, label in enumerate(labels):
        if label is None:
            before, after = behind[at], ahead[at]
            if found[at].heading and after >= 0:
                before = -1
            near = [(abs(at - k), labels[k]) for k in (before, after) if k >= 0]
            least = min((d for d, _ in near), default=0)
            label = any(bool(kept) for d, kept in near if d == least) if near else True
        out.append(bool(label))
    return out


def main_text(page: str | None, p: HtmlParams = HtmlParams()) -> str:
    """The main text of a page: its blocks in order, joined by one space."""
    if not page:
        return ""
    found, elements = parse(page)
    return " ".join(b.text for b, keep in zip(found, classify(found, elements, p), strict=True) if keep)


def extract_pages(pages: DataFrame, p: HtmlParams = HtmlParams()) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``.

    A null or empty page, or one without main text, has an empty text.  Long
    pages are read whole, in time linear in their length.  Repeated rows give
    repeated rows; other columns are ignored whatever their names.
    """
    spark = pages.sparkSession
    ship(spark)
    small_batches(spark)

    def run(batches):
        for batch in batches:
            texts = [main_text(page, p) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(textscan.released(run), textscan.schema_with(pages, ["page_id", "url"], "text string, n_chars long"))
