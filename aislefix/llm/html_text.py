"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags. The first pass decides blocks by
where they stand (menus, forms, comments and the like are never text), by link
density, length and stop-word density. Short or unclear blocks stay ambiguous; the
second pass gives them the label of the nearest decided neighbour. On a page without
any stop word, in another language then, length and link density decide alone.

Markup is read leniently: open elements are kept on a stack, a missing end tag is
implied by the next one that fits, a page may break off anywhere.

Defined results: a null or empty page, or one without main text, has an empty
text of 0 characters; repeated pages are extracted each; a page depends on no
other; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by their role in a page, words in class names, and stop words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template iframe textarea title svg math canvas object audio video noframes xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_TEXT = frozenset("head nav aside footer form menu button select option optgroup dialog fieldset label".split())
#: Elements that are skipped with all their content, and may hold others of their kind.
NESTING_RAW = frozenset("template svg math object audio video canvas noscript".split())
#: Containers, which parts of a class name describe; a paragraph of class market-share is no button to share it.
NAMED_BY_PARTS = frozenset("center div dl ol section table ul".split())
#: An element that an opening tag of the key ends, unless one of the second set stands between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}), "a": ({"a"}, set()),
}
NEVER_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies discussion disqus footer gdpr menu modal nav navbar navigation newsletter popup promo promoted promotion "
    "related replies share sharing sidebar social sponsor sponsored".split()
)
UNLESS_CONTENT_CLASSES = frozenset(
    "alert author byline copyright disclaimer header legal login masthead meta notice pager pagination recommended reply search "
    "side subscribe tags teaser toolbar widget".split()
)
CONTENT_CLASSES = frozenset("article body content entry main post story text".split())
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
STOP_WORDS = frozenset(
    # English
    "a all an and are as at be been but by can did do for from had has have he her his i if in is it its me my no not of on or "
    "our she so that the their them there they this to was we were what when which who will with would you your "
    # French
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que "
    "qui sa se ses son sont sur un une vous "
    # German
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich ihr im in ist "
    "mit nach nicht noch nur oder sein sich sie sind um und uns vom von war wie wir zu zum zur "
    # Spanish
    "al como con cuando del el ella ellos era es esta este fue ha hay la las lo los más me muy no nos o para pero por que se sin "
    "sobre su sus un una y ya".split()
)


@dataclass(frozen=True)
class BlockRules:
    most_link_density: float = 0.33
    short: int = 70
    long: int = 200
    low_stop_density: float = 0.05
    high_stop_density: float = 0.10


GOOD, BAD, UNCLEAR = 1, -1, 0


@dataclass
class Block:
    text: str
    link_chars: int
    never: bool
    heading: bool
    in_article: bool
    label: int = UNCLEAR


_OPENING = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/><]*+)|<[!?/]")
# Up to the end of a tag, over quoted values; it never goes back, so a page is read once.
_INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_NOT_P = BLOCK_TAGS - {"p"}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAME_PART = re.compile(r"[a-z0-9]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _never_by_attributes(raw: str, tag: str) -> bool:
    """Whole class names condemn any element but an article with a content name; parts of names condemn containers without one.

    Ids of headings, sections and text are names of their topic and condemn nothing. Of elements inside
    a line only whole class names count.
    """
    if not raw.strip(" /"):
        return False
    whole: set[str] = set()
    names: set[str] = set()
    by_parts, inline = tag in NAMED_BY_PARTS, tag not in BLOCK_TAGS
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"'")
        if name == "class" or (name == "id" and by_parts and tag != "section"):
            whole.update(value.lower().split())
            names.update(_NAME_PART.findall(value.lower()) if by_parts else value.lower().split())
        elif name == "role" and value.lower().strip() in NEVER_ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and _HIDDEN_STYLE.search(value):
            return True
    if inline:
        return bool(whole & NEVER_CLASSES)
    content = bool(whole & CONTENT_CLASSES)
    if tag == "article":
        return not content and bool(whole & (NEVER_CLASSES | UNLESS_CONTENT_CLASSES))
    if whole & NEVER_CLASSES or (names & NEVER_CLASSES and not content):
        return True
    return bool(names & UNLESS_CONTENT_CLASSES and not names & CONTENT_CLASSES)


class _Page:
    """Blocks of a page, gathered while its markup goes by."""

    def __init__(self):
        self.blocks: list[Block] = []
        # Open elements: tag, whether nothing inside is text.
        self.open: list[tuple[str, bool]] = []
        self.pieces: list[str] = []
        self.link_chars = 0
        self.links = self.never = self.articles = self.dropping = 0
        self.seen_article = False

    def text(self, raw: str) -> None:
        if self.dropping:
            return
        if self.links:
            self.link_chars += len("".join(raw.split()))
        self.pieces.append(raw)

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                heading = any(tag in HEADINGS for tag, _ in self.open[-8:])
                self.blocks.append(Block(text, self.link_chars, self.never > self.dropping, heading, self.articles > 0))
            self.pieces, self.link_chars = [], 0

    def _push(self, tag: str, never: bool) -> None:
        self.open.append((tag, never))
        self.links += tag == "a"
        self.articles += tag in ("article", "main")
        self.never += never
        # Inside a condemned element that is no block, text is dropped where it stands: its block goes on after it.
        self.dropping += never and tag not in BLOCK_TAGS

    def _pop_to(self, at: int) -> None:
        for tag, never in self.open[at:]:
            self.links -= tag == "a"
            self.articles -= tag in ("article", "main")
            self.never -= never
            self.dropping -= never and tag not in BLOCK_TAGS
        del self.open[at:]

    def _last(self, tags: set[str], barriers: set[str]) -> int | None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in tags:
                return at
            if self.open[at][0] in barriers:
                return None
        return None

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
            # A paragraph ends where another block begins.
            at = self._last({"p"}, _NOT_P)
            if at is not None:
                self._pop_to(at)
        if tag in VOID_TAGS:
            if tag == "br":
                self.pieces.append(" ")
            return
        if tag in IMPLIED_END:
            ended, barriers = IMPLIED_END[tag]
            at = self._last(ended, barriers)
            if at is not None:
                self._pop_to(at)
        if tag in ("article", "main") and not self.seen_article:
            # The first article is not part of an advert or notice whose end tag is missing.
            self.seen_article = True
            self.open = [(t, False) for t, _ in self.open]
            self.never = self.dropping = 0
        if tag not in VOID_TAGS:
            header = tag == "header" and not self.articles
            never = tag in NEVER_TEXT or header or (tag not in ("body", "html", "main") and _never_by_attributes(attributes, tag))
            self._push(tag, never)

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        # Elements of a page's own may hold blocks, as blocks do.
        at = self._last({tag}, set() if tag in BLOCK_TAGS or "-" in tag else BLOCK_TAGS)
        if at is not None:
            self._pop_to(at)


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order, undecided."""
    found, at, page = _Page(), 0, page or ""
    while (mark := _OPENING.search(page, at)) is not None:
        if mark.start() > at:
            found.text(page[at : mark.start()])
        if mark[0] == "<!--":
            at = page.find("-->", mark.end())
            at = len(page) if at < 0 else at + 3
            continue
        inside = _INSIDE.match(page, mark.end()).end()
        at = page.find(">", inside) + 1
        if not at:  # the page breaks off inside a tag
            break
        tag = (mark[2] or "").lower()
        if not tag:
            continue
        if mark[1]:
            found.end(tag)
        elif tag in RAW_TAGS:
            if page[at - 2] != "/":
                at = _after_raw(page, tag, at)
        else:
            found.start(tag, page[mark.end() : inside])
    else:
        found.text(page[at:])
    found.end_block()
    return found.blocks


def _after_raw(page: str, tag: str, at: int) -> int:
    """Where an element whose content is no text ends; one that may hold others of its kind ends with as many end tags."""
    opening, depth = _reopening(tag), 1
    while depth:
        close = _closing(tag).search(page, at)
        if close is None:
            return len(page)
        if tag in NESTING_RAW:
            depth += len(opening.findall(page, at, close.start()))
        depth -= 1
        at = close.end()
    return at


@cache
def _reopening(tag: str) -> re.Pattern[str]:
    return re.compile(rf"<{re.escape(tag)}\b(?![^>]*/>)", re.IGNORECASE)


@cache
def _closing(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE)


def _stop_density(block: Block) -> float:
    words = block.text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def _decide(block: Block, rules: BlockRules, stopped: bool) -> int:
    """First pass; ``stopped`` is whether the page has stop words of the known languages at all."""
    if block.never:
        return BAD
    size = len(block.text)
    links = block.link_chars / max(1, len(block.text.replace(" ", "")))
    if links > rules.most_link_density or (size < rules.short and links > 0 and not block.in_article):
        return BAD
    if size < rules.short or block.heading:
        return UNCLEAR
    if not stopped and any(map(str.isalpha, block.text)):
        return GOOD if size >= rules.long else UNCLEAR
    stops = _stop_density(block)
    if stops >= rules.high_stop_density or (stops >= rules.low_stop_density and size >= rules.long):
        return GOOD
    return UNCLEAR if stops > 0 or size < rules.long or block.in_article else BAD


def label(blocks: list[Block], rules: BlockRules) -> None:
    """Both passes. A block in an article looks for neighbours there first; headings look forward first."""
    stopped = any(not b.never and _stop_density(b) > 0 for b in blocks)
    for block in blocks:
        block.label = _decide(block, rules, stopped)
    first = [b.label for b in blocks]
    # Blocks of links alone say nothing of the rest of an article.
    told = any(b.in_article and b.label == GOOD for b in blocks)
    nearest = {}
    for step in (1, -1):
        for inside in (False, True):
            last = None
            for i in range(len(blocks))[::step]:
                nearest[i, -step, inside] = last
                if first[i] != UNCLEAR and not (inside and (not blocks[i].in_article or blocks[i].never)):
                    last = i
    for i, block in enumerate(blocks):
        if first[i] == UNCLEAR and block.in_article and not told:
            block.label = GOOD
        elif first[i] == UNCLEAR:
            after, before = nearest[i, 1, block.in_article], nearest[i, -1, block.in_article]
            block.label = _inherited(i, block, first, before, after)


def _inherited(i: int, block: Block, first: list[int], before: int | None, after: int | None) -> int:
    if before is None and after is None:
        return GOOD if block.in_article else BAD
    if before is None or after is None:
        return first[after if before is None else before]
    if first[before] == first[after]:
        return first[before]
    if block.heading:
        return first[after]
    if i - before != after - i:
        return first[before] if i - before < after - i else first[after]
    return GOOD if block.in_article else BAD


def main_text(page: str | None, rules: BlockRules | None = None) -> str:
    """The text blocks of a page, one a line."""
    blocks = blocks_of(page)
    label(blocks, rules or BlockRules())
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(
    df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", rules: BlockRules | None = None
) -> DataFrame:
    """``key, url, text, n_chars`` of every row."""
    rules = rules or BlockRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py(), rules) for value in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, url, "text", "n_chars"])

    kinds = [df.schema[c].dataType.simpleString() for c in (key, url)]
    rows = df.select(df[key], df[url], df[page])
    return rows.mapInArrow(run, f"`{key}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_chars bigint")
