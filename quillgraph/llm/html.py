"""Main text of a web page by two-pass block rules.

Pass 1 cuts the page into blocks at block-level tags and labels each by its words, its share of stop words and its share of linked
characters: good, bad, near (some stop words) or short. Blocks inside menus, headers, footers, side bars, notices, adverts, forms,
comments and the like are bad by their place. Pass 2 gives every undecided block the label of its nearest decided neighbours: two
that agree decide; where they differ, the one with the same parent element, then the nearer one; at the same distance a near block is
good and a short one bad. A heading is kept where the next decided block is good.

Place: an element's tag, or a word of its class, id or role. A word of a class is passed over after `has`, `with`, `no` and the like, and where
another class of the element names the article itself (`post-content share-enabled`). A place is sure where its tag says so, where a
class is the word or ends with it (`site-header`), or the word only ever names such a place (`comment-list`). Forms, and
classes that begin with other words (`header-fixed`), are unsure: they stand where they hold more than half of the good text that is
in no sure place. An element that holds `main` is no place. Where marked articles (`article`, `main`) hold at least half of the good text, their
bounds count as good neighbours and blocks outside them as bad; where they hold less (teasers), the marks are not looked at.

Defined results: null or empty html gives an empty text and 0; html without a good block, its undecided ones; an empty table gives
no row. Broken markup is read as far as it goes: an unclosed tag ends with the page, a stray end tag is ignored. Character references
are decoded once. Repeated rows and ids are read row by row; other columns are ignored. Pages are read whole, in time linear in their length, but
that a tag left open costs its own closing.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from quillgraph.llm.common import small_batches

# Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """the of and to in is that it was for on are as with they be at this have from or by not but what all were when we there can
    an your which their if will each about how up out them then she many some so these would other into has her two him see could
    no make than been its who now my made over did down only way find use may i you he his a
    de la le les et des en un une du dans que est pour qui par sur au pas plus ne se ce il sont avec aux son cette ou mais ont sa ses
    elle leur été être nous vous je tout comme fait ces aussi
    der die und den von das zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer
    um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde
    el los las y del se por con una su para lo al más o sus pero este ya entre cuando todo esta ser son también muy hasta desde nos
    durante uno ni contra ese eso ante esto antes algunos qué unos yo otro otras otra tanto esa estos mucho como
    di che non una per con si da dei della nel alla sono il gli lo e ma ha anche più
    o que não uma os no na por mais as dos como mas foi ao ele das tem à seu sua
    het een van en dat op te zijn niet aan met voor er maar om ook bij uit dan""".split()
)

BLOCK_TAGS = frozenset(
    """address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu meta nav noframes
    object ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul video audio""".split()
)
#: What these hold is not text of the page.
SKIPPED = frozenset("script style noscript template svg math head title iframe object canvas select textarea button video audio map noframes frameset".split())
#: Blocks in these are bad wherever they stand.
ASIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Of these, those that may hold a whole page.
FORMS = frozenset("form fieldset".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
PAGE = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open p, li, ... ends where one of these begins.
ENDS_P = BLOCK_TAGS - {"button", "canvas", "col", "colgroup", "link", "meta", "option", "optgroup", "object", "iframe", "select", "textarea", "title", "video", "audio"}
AUTO_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Words of a class, id or role that name something beside the article.
ROLE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion nav navbar navigation menu
    breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent
    notice gdpr popup modal overlay newsletter subscribe subscription signup login comment comments reply replies disqus respond
    pagination pager tags toolbar skip copyright""".split()
)
#: Of these, those that name no wrapper of a page, whatever stands beside them.
SURE_WORDS = frozenset(
    """adverts advertisement advertising sponsored breadcrumb breadcrumbs related recommended cookie cookies consent gdpr newsletter
    comment comments reply replies disqus respond pagination pager""".split()
)
#: After one of these a class says what its page has or lacks.
SAYING = frozenset("has with no without non not hide show".split())
#: With one of these, `header` is the article's own.
OWN_WORDS = frozenset("article post entry content story main".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {t: re.compile(rf"</{t}\s*(?:>|\Z)|\Z", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes")}
WORD = re.compile(r"[^\W\d_]+")
SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")

#: Thresholds: link density; words of a short block, of a long one; share of stop words that makes a block near, good.
LINKED, SHORT, LONG, SOME_STOPS, MANY_STOPS = 0.3, 10, 25, 0.12, 0.2

GOOD, NEAR, SHORT_BLOCK, BAD = "good", "near", "short", "bad"


NOWHERE, UNSURE, SURE = 0, 1, 2


def _named(words: list[str]) -> int:
    """What a class, id or role of these words names."""
    own = bool(OWN_WORDS & set(words))
    found = NOWHERE
    for k, w in enumerate(words):
        if w in ROLE_WORDS and not (w == "header" and own) and not (k and words[k - 1] in SAYING):
            found = max(found, SURE if w in SURE_WORDS or k == len(words) - 1 else UNSURE)
    return found


@lru_cache(4096)
def beside(attributes: str) -> int:
    """Whether an element's attributes name something beside the article, or hide it: NOWHERE, UNSURE or SURE."""
    found = NOWHERE
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name in ("class", "id", "role"):
            parts = [[w.lower() for w in SPLIT.split(x) if w] for x in value.split()]
            named = [_named(words) for words in parts]
            if not any(OWN_WORDS & set(words) and not place for words, place in zip(parts, named, strict=True)):
                found = max([found, *named])
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURE
    return found


class Block:
    __slots__ = ("heading", "home", "linked", "marked", "parts", "place_bad", "places")

    def __init__(self, places: tuple[int, ...] = (), heading: bool = False, marked: bool = False, home: int = 0):
        self.parts: list[str] = []
        self.linked, self.places, self.place_bad, self.heading, self.marked, self.home = 0, places, False, heading, marked, home

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


class Element(NamedTuple):
    """An open element: its name, the numbers of the places it is in, whether it is skipped, in an article, in a heading, and the numbers of its innermost block element and of that one's parent."""

    name: str
    places: tuple[int, ...] = ()
    skipped: bool = False
    marked: bool = False
    heading: bool = False
    block: int = 0
    home: int = 0


def blocks(page: str) -> list[tuple[str, Block]]:
    """Blocks of the page in order, each with its text and whether its place is bad; none is empty."""
    out, sure = _read(page)
    _placed(out, sure)
    return out


def _placed(found: list[tuple[str, Block]], sure: dict[int, bool]) -> None:
    """Sets place_bad. An unsure place stands if it holds more than half of the good text outside sure places."""
    stands: set[int] = set()
    if not all(sure.values()):
        good = [(len(t), [p for p in b.places if not sure[p]]) for t, b in found if not any(sure[p] for p in b.places) and label(t, b) == GOOD]
        total, held = sum(n for n, _ in good), Counter()
        for n, places in good:
            for p in places:
                held[p] += n
        for p in held:
            if 2 * held[p] > total:
                stands.add(p)
    for _, b in found:
        b.place_bad = any(p not in stands for p in b.places)


def _read(page: str) -> tuple[list[tuple[str, Block]], dict[int, bool]]:
    """The blocks with the places they are in, and of each place whether it is sure."""
    out: list[tuple[str, Block]] = []
    root = Element("")
    stack: list[Element] = []
    open_: Counter[str] = Counter()  # names on the stack
    now, number = Block(), 0
    sure: dict[int, bool] = {}
    holding: set[int] = set()  # places that hold a main element

    def close() -> None:
        nonlocal now
        if now.parts and (text := now.text()):
            out.append((text, now))
        top = stack[-1] if stack else root
        now = Block(top.places, top.heading, top.marked, top.home)

    def pop(name: str) -> None:
        while stack:
            top = stack.pop().name
            open_[top] -= 1
            if top == name:
                return

    at, end = 0, len(page)
    while at <= end:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not (stack and stack[-1].skipped):
            now.parts.append(piece)
            if open_["a"]:
                now.linked += len("".join(piece.split()))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:  # a comment or declaration
            continue
        block = name in BLOCK_TAGS
        if m[1]:  # an end tag
            if open_[name]:
                pop(name)
            if block:
                close()
            continue
        if name == "br":
            now.parts.append(" ")
            continue
        if name in VOID:
            if block:
                close()
            continue
        if name in ENDS_P and open_["p"]:
            pop("p")
        if name in AUTO_END and stack and stack[-1].name in AUTO_END[name]:
            pop(stack[-1].name)
        if name == "body" and open_["head"]:
            pop("head")
        up = stack[-1] if stack else root
        away = SURE if name in ASIDE and name not in FORMS and not (name == "header" and up.marked) else max(UNSURE if name in FORMS else NOWHERE, beside(m[3]) if name not in PAGE and m[3] else NOWHERE)
        number += 1
        if away and block:
            sure[number] = away == SURE
        if name == "main":
            holding.update(up.places)
        heading = name in HEADINGS or up.heading and not block
        place = (number, up.block) if block else (up.block, up.home)
        stack.append(Element(name, (*up.places, number) if away and block else up.places, up.skipped or name in SKIPPED or bool(away and not block), up.marked or name in ("article", "main"), heading, *place))
        open_[name] += 1
        if block:
            close()
        if name in RAW_END:
            at = RAW_END[name].search(page, at).end()
            pop(name)
        elif m[3].endswith("/") and not block:
            pop(name)
    close()
    for _, b in out if holding else ():
        b.places = tuple(p for p in b.places if p not in holding)
    return out, sure


def label(text: str, block: Block) -> str:
    """Pass 1."""
    if block.place_bad:
        return BAD
    size = len(text) - text.count(" ")
    if block.linked > LINKED * size:
        return BAD
    words = WORD.findall(text)
    n = len(words)
    if n < SHORT:
        return SHORT_BLOCK
    share = sum(w in STOP_WORDS for w in map(str.lower, words)) / n
    if share >= MANY_STOPS:
        return GOOD if n >= LONG else NEAR
    return NEAR if share >= SOME_STOPS else SHORT_BLOCK


def inherited(labels: list[str], headings: list[bool], ends: str, homes: list[int] | None = None) -> list[bool]:
    """Pass 2: which blocks are kept. `ends` is the label that stands before the first and after the last block; homes are parents."""
    homes = homes or [0] * len(labels)
    if ends == BAD and GOOD not in labels:
        return [x != BAD for x in labels]  # no neighbour to inherit from: the page is its few words

    def nearest(rows: list[tuple[str, int]]) -> list[tuple[int, str, int]]:
        """Distance, label and home of the last decided block up to each."""
        out, last = [], (1, ends, -1)
        for x, home in rows:
            last = (0, x, home) if x in (GOOD, BAD) else (last[0] + 1, *last[1:])
            out.append(last)
        return out

    rows = list(zip(labels, homes, strict=True))
    kept = []
    for x, heading, home, (a, before, one), (b, after, two) in zip(labels, headings, homes, nearest(rows), nearest(rows[::-1])[::-1], strict=True):
        if x in (GOOD, BAD):
            kept.append(x == GOOD)
        elif before == after:
            kept.append(after == GOOD)
        elif heading and after == GOOD:
            kept.append(True)
        elif (home == one) != (home == two):
            kept.append((before if home == one else after) == GOOD)
        elif a != b:
            kept.append((before if a < b else after) == GOOD)
        else:
            kept.append(x == NEAR)
    return kept


def extract(page: str | None) -> str:
    """The main text of a page."""
    found = blocks(page) if page else []
    labels = [label(t, b) for t, b in found]
    good = lambda marked: sum(len(t) for (t, b), x in zip(found, labels, strict=True) if x == GOOD and b.marked >= marked)
    inside = [b.marked and not b.place_bad for _, b in found]
    marked = any(inside) and 2 * good(True) >= good(False)
    if marked:
        found, labels = [x for x, i in zip(found, inside, strict=True) if i], [x for x, i in zip(labels, inside, strict=True) if i]
    kept = inherited(labels, [b.heading for _, b in found], GOOD if marked else BAD, [b.home for _, b in found])
    return "\n".join(t for (t, _), keep in zip(found, kept, strict=True) if keep)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = small_batches(pages).select("page_id", "url", "html")
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
