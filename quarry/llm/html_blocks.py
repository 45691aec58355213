"""A small HTML reader: the text blocks of a page, and its element subtrees.

It follows the parts of the HTML standard that decide where text belongs: raw
text elements, void elements, implied end tags, comments and end of file. Text is
kept by block; inline elements and ``<br>`` don't end one, and an inline element
that is no content leaves its block without its text.

Time is linear in the page: open elements are found by their names' last places,
inline elements share their block's list of digests, and a tag without an end is
sought once.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import xxhash

# Element names by their role in the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre"
    " search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(
    "annotation iframe noembed noframes noscript object script style svg template textarea title xmp".split()
)
NOISE = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe menu nav noscript object script"
    " search select style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An element that opens ends an open element of these names.
ENDS = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
    "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th",
}
ENDS = {k: frozenset(v.split()) for k, v in ENDS.items()}
#: Implied ends don't reach beyond these.
SCOPE = frozenset("html body table ul ol dl menu article section main div td th".split())
NOISE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
# Words of classes and ids that name what is no content.
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement"
    " advertisements banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices popup"
    " modal newsletter subscribe signup share sharing social comment comments disqus replies respond related"
    " recommended recommendations widget pagination pager toolbar login skip copyright disclaimer".split()
)
HEAD_WORDS = frozenset("header masthead topbar".split())
BYLINE_WORDS = frozenset("byline dateline author meta date time published timestamp".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_OPEN_END = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[-_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


class _Noise:
    """An element that is no content by its names, unless it holds an article or main."""

    __slots__ = ("around", "holds")

    def __init__(self, around):
        self.around, self.holds = around, False


#: What is hidden is no content, whatever it holds.
_HIDDEN_NOISE = _Noise(None)


@dataclass(slots=True)
class Block:
    """``whole``: all text of a block; ``text``: that of its content, empty without any."""

    whole: str
    text: str
    in_article: bool
    in_main: bool


@dataclass(slots=True)
class Page:
    """``subtrees``: (hash, first block, end, tag) of the block elements with text."""

    blocks: list[Block]
    subtrees: list[tuple[int, int, int, str]]

    def kept(self, gone: frozenset | set = frozenset()) -> list[str]:
        """Texts of the main content of what stays without the subtrees whose hashes are in ``gone``."""
        out = set()
        if gone:
            reach = 0  # a subtree that lies in one already taken out adds nothing
            for a, b in sorted((a, b) for h, a, b, _ in self.subtrees if h in gone):
                out.update(range(max(a, reach), b))
                reach = max(reach, b)
        return [self.blocks[i].text for i in self.main(out)]

    def content(self) -> list[int]:
        """Places of the blocks with content, in articles or not."""
        return [i for i, b in enumerate(self.blocks) if b.text]

    def main(self, out: frozenset | set = frozenset()) -> list[int]:
        """Places of the main content but for the blocks in ``out``: the articles; main, where there is no
        article or most of main's text lies outside of them; else all content."""
        left = [i for i in self.content() if i not in out]
        articles = [i for i in left if self.blocks[i].in_article]
        whole = [i for i in left if self.blocks[i].in_main]
        size = lambda places: sum(len(self.blocks[i].text) for i in places)
        if articles:
            return whole if size(i for i in whole if not self.blocks[i].in_article) > size(articles) else articles
        return whole or left


def _names_noise(value: str, in_article: bool) -> bool:
    """Whether a class or id names what is no content: by a whole name, outside of articles by a part of one."""
    for name in value.lower().split():
        words = {name} if in_article else {name, *_PART.split(name)}
        if not NOISE_WORDS.isdisjoint(words) or not in_article and not HEAD_WORDS.isdisjoint(words):
            return True
    return False


def _noise(tag: str, attributes: str, in_article: bool, holder: bool) -> str | None:
    """Why an element is no content: its ``name``, or that it is ``hidden``. A ``holder`` (article or main) has no such name."""
    if tag in ("html", "body", "main"):
        return None
    named = not holder and tag in NOISE and not (tag == "header" and in_article)
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            named = named or not holder and _names_noise(value, in_article)
        elif name == "role":
            named = named or not holder and value.lower() in NOISE_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return "hidden"
    return "name" if named else None


def _is_byline(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            words = {w for name in (m[2] or m[3] or m[4] or "").lower().split() for w in (name, *_PART.split(name))}
            if not BYLINE_WORDS.isdisjoint(words):
                return True
    return False


class _Element:
    __slots__ = ("byline", "digests", "first", "in_article", "in_main", "noise", "tag")

    def __init__(self, tag, noise, in_article, in_main, byline, first, digests):
        self.tag, self.noise, self.in_article, self.in_main = tag, noise, in_article, in_main
        self.byline, self.first, self.digests = byline, first, digests


class _Reader:
    def __init__(self):
        self.blocks: list[tuple[list, str, bool, bool]] = []
        self.subtrees: list[tuple[int, int, int, str]] = []
        self.stack = [_Element("", None, False, False, False, 0, [])]
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = [0]
        self.parts: list[tuple[str, _Noise | None]] = []

    def say(self, text: str) -> None:
        top = self.stack[-1]
        self.parts.append((text, _HIDDEN_NOISE if top.byline else top.noise))

    def flush(self) -> None:
        """Ends the block that is being read."""
        if self.parts:
            whole = _plain(p for p, _ in self.parts)
            if whole:
                top = self.stack[-1]
                self.blocks.append((self.parts, whole, top.in_article, top.in_main))
                top.digests.append(whole)
            self.parts = []

    def last(self, names) -> int:
        """The place of the innermost open element of ``names``, or 0."""
        return max((held[-1] for n in names if (held := self.places.get(n))), default=0)

    def open(self, e: _Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        if e.tag in BLOCK:
            self.block_places.append(len(self.stack))
        self.stack.append(e)

    def close_to(self, place: int) -> None:
        """Closes the element at ``place`` and all in it."""
        while len(self.stack) > max(place, 1):
            e = self.stack.pop()
            self.places[e.tag].pop()
            if e.tag not in BLOCK:
                continue  # its digests are those of the block around it
            self.block_places.pop()
            if e.digests:
                h = xxhash.xxh64_intdigest("\x1f".join([e.tag, *e.digests]))
                self.subtrees.append((h, e.first, len(self.blocks), e.tag))
                self.stack[-1].digests.append(f"\x1e{h:x}")

    def end_tag(self, tag: str) -> None:
        place = self.last((tag,))
        if tag in BLOCK:
            self.flush()
        elif place < self.block_places[-1]:
            return
        if place:
            self.close_to(place)

    def start_tag(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            for ended in (("p",), ENDS.get(tag, ())):
                place = self.last(ended)
                if place and place >= self.last(SCOPE.difference(ended)):
                    self.close_to(place)
        top = self.stack[-1]
        main = tag == "main" or 'role="main"' in attributes
        holder, noise = main or tag == "article", top.noise
        if holder:
            around = noise
            while around is not None and around is not _HIDDEN_NOISE and not around.holds:
                around.holds, around = True, around.around
        if noise is not _HIDDEN_NOISE and (why := _noise(tag, attributes, top.in_article, holder)):
            noise = _HIDDEN_NOISE if why == "hidden" else _Noise(noise)
        in_article = top.in_article or tag == "article"
        # In an article's header only headings and paragraphs are content.
        byline = not holder and (tag == "header" and top.in_article or top.byline and tag not in HEADINGS and (tag != "p" or _is_byline(attributes)))
        digests = [] if tag in BLOCK else top.digests
        self.open(_Element(tag, noise, in_article, top.in_main or main, byline, len(self.blocks), digests))

    def read(self, html: str) -> Page:
        at, end = 0, len(html)
        last = html.rfind(">")
        while at <= last:
            begin = html.find("<", at)
            if begin < 0 or begin > last:
                break
            m = _TAG.match(html, begin)
            if not m:
                self.say(html[at : begin + 1])
                at = begin + 1
                continue
            if begin > at:
                self.say(html[at:begin])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end_tag(tag)
            elif tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    stop = _RAW_END[tag].search(html, at)
                    at = stop.end() if stop else end
            elif tag == "br":
                self.say(" ")
            elif tag in VOID:
                if tag == "hr":
                    self.flush()
            else:
                self.start_tag(tag, m[3])
        rest = html[at:]
        cut = _OPEN_END.search(rest)  # a tag or comment without an end has no text
        if rest:
            self.say(rest[: cut.start()] if cut else rest)
        self.flush()
        self.close_to(1)
        return Page([_block(*b) for b in self.blocks], self.subtrees)


def _plain(parts) -> str:
    return " ".join(_html.unescape("".join(parts)).split())


def _block(parts: list, whole: str, in_article: bool, in_main: bool) -> Block:
    own = [p for p, noise in parts if noise is None or _content(noise)]
    text = whole if len(own) == len(parts) else _plain(own)
    return Block(whole, text, in_article, in_main)


def _content(noise: _Noise) -> bool:
    return noise is not _HIDDEN_NOISE and noise.holds


def read(html: str | None) -> Page:
    """The blocks and subtrees of a page. What its names mark as no content has no text of content, unless
    an article or main is in it."""
    return _Reader().read(html or "")
