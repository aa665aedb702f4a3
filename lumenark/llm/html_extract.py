"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Elements that by HTML's own meaning hold
no main text (menus, headers, footers, sidebars, forms, scripts, styles, hidden ones: by
element, role or attribute) are left out with all they hold; class and id words only give
the blocks within a hint.
Pass one classifies each block by length, link density and stop-word density as good, bad
or undecided. The hints feed it: a strong one (advert, cookie, breadcrumb ...) is bad,
a weak one (related, share, notice ..., words that main text uses too) is good only as
long, dense and unlinked prose in a marked article, else bad; hinted blocks are no one's
neighbours. Pass two lets each undecided block take the label of its nearest decided
neighbours: good if both agree or the nearer one is good; at equal distance and different
labels it is bad.
Both passes run on all blocks of every page, within a marked article (``article`` or
``main``) or not. The mark is a prior only: within it, few stop words or some link text
leave a block undecided, and bad is only what is almost all link text. Undecided blocks
look at neighbours on their own side of the mark; without a decided one, those within
are good, and of the others those that are unlinked, dense and end as a sentence does. A
heading takes the label of the block that follows it.

Rows are independent: nothing is shuffled. A page is read whole, in time proportional to
its length, however it is broken (tags are found without backtracking, and each open
element is looked at a bounded number of times). Defined results: null or empty html
gives an empty text; unclosed and stray tags are tolerated; a "<" that no ">" follows is
text; repeated rows stay; other columns pass through, but for those named text and
n_chars, which are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lumenark.llm.common import others, returning

# HTML's elements and common stop words.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set("head nav footer aside menu dialog script style title textarea noscript iframe template button select svg canvas object audio video map".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class and id that name no main text, and those that main text may bear too.
STRONG_HINTS = set(
    "ad ads adbox adsense adslot adunit adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr popup modal overlay newsletter sidebar navbar navigation breadcrumb breadcrumbs footer masthead comments commentlist disqus pagination pager paywall topbar".split()
)
WEAK_HINTS = set(
    "announcement promotion disclaimer notice notices alert subscribe subscription menu nav navi comment reply replies respond related recommended recommendations share sharing social toolbar widget login signin signup search copyright toc skip".split()
)
#: Of these, the words for what readers write; they hold good whatever they hold.
COMMENT_HINTS = set("comment comments commentlist disqus reply replies respond".split())
#: Parts of a class that say what the page has or how it looks: "has-sidebar", "ad-hoc".
SETTINGS = set("has with without no hide is hoc theme layout free".split())
#: A heading of readers' comments, as in "3 Comments".
_COMMENTS = re.compile(r"(?:\d+ )?(?:comments?|reader comments|replies|responses|kommentare?|commentaires?|comentarios?)(?: ?\(?\d+\)?)?:?", re.I)
#: What a header may be of, and then is none of the page's.
OWN_HEADER = set("article entry post story content".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
STOP_WORDS = set(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the they this to was were which will with you
    als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous à été être
    al como con de del el ella en era es esta este fue ha hay la las lo los más me mi muy no o para pero por que se ser si sin sobre son su sus también un una y ya""".split()
)

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: Within a tag: a quoted value opens after "=", or the tag ends.
_EDGE = re.compile(r"""=\s*(["'])|>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[^\W_]+")
#: Elements that a new one closes while they are open within the same block.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(frozen=True)
class Rules:
    long_chars: int = 140
    short_chars: int = 70
    max_link_density: float = 0.35
    article_link_density: float = 0.8
    #: Of weakly hinted blocks, which must be longer and denser than others.
    hinted_link_density: float = 0.1
    good_stop_density: float = 0.2
    bad_stop_density: float = 0.05


@dataclass
class Block:
    heading: bool
    article: bool
    hint: int = 0  # 0 none, 1 weak, 2 strong
    mark: int = -1  # the innermost mark around it
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    text: str = ""
    link_density: float = 0.0

    def close(self) -> None:
        self.text = " ".join(entities.unescape("".join(self.parts)).split())
        linked = " ".join(entities.unescape(" ".join(self.links)).split())
        self.link_density = min(1.0, len(linked) / len(self.text)) if self.text else 0.0


def attributes_of(written: str) -> dict[str, str]:
    """A tag's attributes by name; of several of one name the first holds."""
    out: dict[str, str] = {}
    for k, v in _ATTRIBUTE.findall(written):
        out.setdefault(k.lower(), v.strip("\"'").lower())
    return out


#: What a mark says of all that an element holds: hints, and what is left out unless the
#: element holds the page's article or most of its text.
WEAK, STRONG, LEFT_OUT, COMMENTS = 1, 2, 3, 4


def _judge(name: str, written: str, article: bool) -> tuple[bool, int]:
    """Whether an element and all it holds is left out for good, and its mark (0: none)."""
    if name in DROPPED:
        return True, 0
    bare = LEFT_OUT if name == "form" or name == "header" and not article else 0
    if not written:
        return False, bare
    by = attributes_of(written)
    if "hidden" in by or by.get("aria-hidden") == "true" or re.search(r"(^|[;\s])display\s*:\s*none", by.get("style", "")):
        return True, 0
    if by.get("role") in DROPPED_ROLES:
        return True, 0
    if name in ("html", "body", "main") or name == "article" and not article:
        return False, 0
    words: set[str] = set()
    for token in f"{by.get('class', '')} {by.get('id', '')}".split():
        own = set(re.split(r"[^a-z0-9]+", token))
        words |= own if not own & SETTINGS else set()
    if words & COMMENT_HINTS:
        return False, COMMENTS
    if bare or not article and "header" in words and not words & OWN_HEADER:
        return False, LEFT_OUT
    return False, STRONG if words & STRONG_HINTS else WEAK if words & WEAK_HINTS else 0


class _Marks:
    """The marked elements of a page, and what each holds."""

    def __init__(self) -> None:
        self.kind: list[int] = []
        self.above: list[int] = []
        self.size: list[int] = []
        self.fields: list[int] = []
        self.articles: list[list[int]] = []  # (mark, size) of each article or main

    def add(self, kind: int, above: int) -> int:
        for column, value in ((self.kind, kind), (self.above, above), (self.size, 0), (self.fields, 0)):
            column.append(value)
        return len(self.kind) - 1

    def judged(self, total: int) -> list[int]:
        """What holds good of all within each mark: 0, WEAK, STRONG or LEFT_OUT. Marks are
        added outermost first, so one pass adds sizes up and one hands verdicts down."""
        n = len(self.kind)
        comments = [False] * n
        for i in range(n):
            comments[i] = self.kind[i] == COMMENTS or self.above[i] >= 0 and comments[self.above[i]]
        main = max((a for a in self.articles if a[0] < 0 or not comments[a[0]]), key=lambda a: a[1], default=None)
        holds = [False] * n
        if main is not None and main[0] >= 0 and main[1]:
            holds[main[0]] = True
        for i in range(n - 1, -1, -1):
            if self.above[i] >= 0:
                self.size[self.above[i]] += self.size[i]
                self.fields[self.above[i]] += self.fields[i]
                holds[self.above[i]] |= holds[i]
        out: list[int] = []
        for i in range(n):
            kind = STRONG if self.kind[i] == COMMENTS else self.kind[i]
            most = 2 * self.size[i] > total and self.size[i] >= 200 * max(self.fields[i], 1)
            void = self.kind[i] != COMMENTS and (holds[i] or most)
            out.append(max(out[self.above[i]] if self.above[i] >= 0 else 0, 0 if void else kind))
        return out


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, closing, lower-case name (empty: a comment or declaration) and
    attributes of each tag. The end of a scan is never left behind, but once: when a
    tag's quoted values hide every later ">", quotes count as nothing from there on."""
    at, n, plain = 0, len(page), False
    unclosed: set[str] = set()  # quotes that do not occur any more
    while True:
        lt = page.find("<", at)
        if lt < 0:
            return
        at = lt + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = n if end < 0 else end + 3
            yield lt, at, False, "", ""
            continue
        if page[at : at + 1] in ("!", "?"):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            yield lt, at, False, "", ""
            continue
        m = _NAME.match(page, at)
        if m is None:
            continue
        end, look = -1, m.end()
        while not plain:
            e = _EDGE.search(page, look)
            if e is None:
                plain = True
            elif e[1] is None:
                end = e.end() - 1
                break
            else:
                close = -1 if e[1] in unclosed else page.find(e[1], e.end())
                if close < 0:
                    unclosed.add(e[1])
                look = e.end() if close < 0 else close + 1
        if end < 0:
            end = page.find(">", m.end())
            if end < 0:
                return
        at = end + 1
        name = m[2].lower()
        yield lt, at, bool(m[1]), name, page[m.end() : end]
        if name in RAW and not m[1]:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            yield end + 1, at, False, "", ""


class _Open:
    """The open elements. ``blocks`` are the places of block-level ones; inline ones are
    counted since the last block, block-level ones over all, so that an end tag without
    its element costs nothing."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # name, dropped, in an article, in a link, mark
        self.blocks: list[int] = []
        self.counts: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]

    @property
    def top(self) -> tuple[str, bool, bool, bool, int]:
        return self.stack[-1] if self.stack else ("", False, False, False, -1)

    def last_block(self) -> str:
        return self.stack[self.blocks[-1]][0] if self.blocks else ""

    def push(self, name: str, dropped: bool, article: bool, link: bool, mark: int) -> None:
        if name in BLOCK:
            self.blocks.append(len(self.stack))
            self.counts[name] = self.counts.get(name, 0) + 1
            self.inline.append({})
        else:
            self.inline[-1][name] = self.inline[-1].get(name, 0) + 1
        self.stack.append((name, dropped, article, link, mark))

    def pop(self) -> str:
        name = self.stack.pop()[0]
        if name in BLOCK:
            self.blocks.pop(), self.inline.pop()
            self.counts[name] -= 1
        else:
            self.inline[-1][name] -= 1
        return name

    def pop_block(self) -> None:
        to = self.blocks[-1]
        while len(self.stack) > to:
            self.pop()

    def close(self, name: str) -> bool:
        """Close the last open ``name``; an inline one only within its block."""
        if not (self.counts if name in BLOCK else self.inline[-1]).get(name):
            return False
        while self.pop() != name:
            pass
        return True


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without those of dropped elements."""
    found: list[Block] = []
    open_, block, marks, total = _Open(), Block(False, False), _Marks(), 0
    inside: list[tuple[int, int]] = []  # (depth, its number) of the open articles

    def end(heading: bool = False) -> None:
        nonlocal block, total
        if block.parts:
            block.close()
            if block.text:
                found.append(block)
                size = len(block.text)
                total += size
                if block.mark >= 0:
                    marks.size[block.mark] += size
                while inside and inside[-1][0] >= len(open_.stack):
                    inside.pop()
                if block.article and inside:
                    marks.articles[inside[-1][1]][1] += size
                if block.heading and _COMMENTS.fullmatch(block.text):
                    comments_follow()
        block = Block(heading, open_.top[2], mark=open_.top[4])

    def comments_follow() -> None:
        """The rest of a section that a heading calls comments is marked as such."""
        for at in range(len(open_.stack) - 1, -1, -1):
            name, dropped, article, link, mark = open_.stack[at]
            if name in HEADINGS or name not in BLOCK:
                continue
            if name in ("section", "div"):
                open_.stack[at] = (name, dropped, article, link, marks.add(COMMENTS, mark))
            return

    def say(text: str) -> None:
        _, dropped, _, link, _ = open_.top
        if text and not dropped:
            block.parts.append(text)
            if link:
                block.links.append(text)

    at = 0
    for start, stop, closing, name, attributes in tags(page):
        say(page[at:start])
        at = stop
        if not name:
            continue
        blocky = name in BLOCK
        if closing:
            if blocky:
                end()
            if open_.close(name) and blocky:
                end()
        elif name in VOID:
            if blocky:
                end()
            elif name == "br":
                say(" ")
            elif name == "input" and open_.top[4] >= 0:
                marks.fields[open_.top[4]] += 1
        elif name not in RAW:
            if blocky:
                end()
                last = open_.last_block()
                if last == "p" or last in _ENDS.get(name, ()) or (name in HEADINGS and last in HEADINGS):
                    open_.pop_block()
                if name == "tr" and open_.top[0] == "tr":
                    open_.pop()
            _, dropped, article, link, mark = open_.top
            if not dropped:
                dropped, own = _judge(name, attributes, article)
                if own:
                    mark = marks.add(own, mark)
                if name == "button" and mark >= 0:
                    marks.fields[mark] += 1
            open_.push(name, dropped, article or name in ("article", "main"), link or name == "a", mark)
            if name in ("article", "main") and not dropped:
                inside.append((len(open_.stack) - 1, len(marks.articles)))
                marks.articles.append([mark, 0])
            if attributes.endswith("/") and not blocky:
                open_.pop()  # written as empty
            elif blocky:
                end(name in HEADINGS)
    say(page[at:])
    end()
    verdict = marks.judged(total)
    kept = []
    for b in found:
        b.hint = verdict[b.mark] if b.mark >= 0 else 0
        if b.hint != LEFT_OUT:
            kept.append(b)
    return kept


def classify(found: list[Block], rules: Rules = Rules()) -> list[bool]:
    """Whether each block is main text."""
    first: list[bool | None] = []
    sentence: list[bool] = []
    for b in found:
        words = [w.lower() for w in _WORD.findall(b.text)]
        stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        ends = b.text[-1:] in ".!?…»”\""
        sentence.append(ends and stops >= rules.good_stop_density and not b.link_density)
        if b.hint:
            prose = b.article and len(b.text) >= rules.long_chars and stops >= rules.good_stop_density and b.link_density <= rules.hinted_link_density
            first.append(b.hint == 1 and prose)
        elif b.link_density > (rules.article_link_density if b.article else rules.max_link_density):
            first.append(False)
        elif b.link_density > rules.max_link_density:
            first.append(None)
        elif b.heading or len(b.text) < rules.short_chars:
            first.append(None)
        elif stops >= rules.good_stop_density:
            first.append(True if len(b.text) >= rules.long_chars or ends else None)
        elif stops < rules.bad_stop_density and len(b.text) < rules.long_chars:
            first.append(None if b.article else False)
        else:
            first.append(True if len(b.text) >= rules.long_chars else None)
    before, after = [(None, 0)] * len(first), [(None, 0)] * len(first)
    for order, near in ((range(len(first)), before), (range(len(first) - 1, -1, -1), after)):
        last: dict[bool, tuple[bool | None, int]] = {True: (None, 0), False: (None, 0)}  # by side of the mark
        for i in order:
            label, at = last[found[i].article]
            near[i] = (label, abs(i - at) if label is not None else len(first) + 1)
            if first[i] is not None and not found[i].hint:
                last[found[i].article] = (first[i], i)
    out = list(first)
    following: dict[bool, bool] = {}  # by side of the mark, the label of the next block
    for i in range(len(first) - 1, -1, -1):
        side = found[i].article
        if out[i] is None and found[i].heading:  # belongs to what follows it
            out[i] = following.get(side, side)
        elif out[i] is None:
            (b, db), (a, da) = before[i], after[i]
            if a is None and b is None:
                out[i] = side or sentence[i]
            elif a == b:
                out[i] = bool(a)
            else:
                out[i] = bool(b) if db < da else bool(a) if da < db else False
        if not found[i].hint:
            following[side] = out[i]
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, classify(found, rules)) if keep)


def extract(pages: DataFrame, html_col: str = "html", rules: Rules = Rules()) -> DataFrame:
    """``pages`` without ``html_col``, with text and n_chars."""
    names = others(pages.columns, html_col, "text", "n_chars")
    fields = pages.select(*names).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, rules) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, html_col).mapInArrow(returning(run), fields)
