"""The main text of web pages by two passes of rules over blocks.

A page is read once, tag by tag, into blocks of text. The first pass decides blocks by themselves: by the containers they
stand in, their share of link text, their length and their density of stop words. What stays open, short blocks and
those of middling density, takes the label of the nearest decided blocks in the same section in the second pass.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his how i if in into is it its more no not of on one only or other our out she so some than that the
    their them then there these they this to up was we were what when where which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um
    und uns von vor war was wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur tout un une vous y
    al como con cuando de del desde donde el ella en entre era es esta este esto fue ha hay la las le lo los más me muy no nos o para pero por porque que se ser si sin sobre son su sus también un una
    uno y ya""".split()
)
# Elements by what they mean here.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("article main section aside nav div td body".split())
UNWANTED = frozenset("nav footer aside form menu dialog select button fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus replies reply respond cookie cookies consent gdpr notice notices
    notification alert popup modal overlay toast footer foot header masthead menu nav navbar navigation newsletter pager pagination paywall promo promotion recommended recommendations related
    search share sharing sidebar signup subscribe social sponsor sponsored toolbar widget login form copyright disclaimer legal topbar""".split()
)

LOW, HIGH = 0.10, 0.20  # densities of stop words: below it a long block is none of the text, from there on it is
SHORT, LONG = 70, 200  # characters
LINKED = 0.5  # share of link text beyond which a block is none of the text
HEADING = 200  # characters between a heading and the text that it stands over, at most

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<!--(.*?)(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_NAME = re.compile(r"""(?:^|\s|/)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    words: int = 0
    density: float = 0.0
    linked: float = 0.0
    unwanted: bool = False  # stands in a container that is none of the text
    inside: bool = False  # stands in an article or main element
    heading: bool = False
    section: int = 0
    label: str = ""


def names_unwanted(value: str) -> bool:
    """Whether a class list or an id names something that is none of the text, by the first or last word of a name.
    Names such as has-sidebar say what stands beside."""
    for name in value.split():
        parts = [p.lower() for p in _SPLIT.split(name) if p]
        if parts and parts[0] not in ("has", "with", "no", "without") and (parts[0] in NAMES or parts[-1] in NAMES):
            return True
    return False


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    if tag in UNWANTED or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "main"):
        return False
    for key, *values in _NAME.findall(attributes):
        value, key = html.unescape("".join(values)), key.lower()
        if key == "hidden" or (key == "role" and value.lower() in ROLES):
            return True
        # what names an article's own header or form keeps its headings out of no text
        if key in ("class", "id") and names_unwanted(value) and not (inside and tag == "header"):
            return True
    return False


@dataclass
class _Reader:
    """The open containers while a page is read, and the block that is being filled."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, bool, bool, int]] = field(default_factory=list)  # tag, unwanted, inside, section
    counts: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    link: bool = False
    heading: bool = False
    breaks: int = 0
    sections: int = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, unwanted, inside, section = self.stack[-1] if self.stack else ("", False, False, 0)
            words = _WORD.findall(text.lower())
            dense = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
            self.blocks.append(Block(text, len(words), dense, self.linked / len(text), unwanted, inside, self.heading, section))
        self.parts, self.linked, self.link, self.breaks = [], 0, False, 0

    def add(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            self.parts.append(text)
            if not text.isspace():
                self.breaks = 0
            if self.link:
                self.linked += len("".join(text.split()))

    def close(self, tag: str) -> None:
        if self.counts.get(tag):
            while True:
                top = self.stack.pop()[0]
                self.counts[top] -= 1
                if top == tag:
                    break
        self.heading = any(self.counts.get(h) for h in ("h1", "h2", "h3", "h4", "h5", "h6"))

    def open(self, tag: str, attributes: str) -> None:
        self.flush()
        if tag in ("p", "li", "option") and self.stack and self.stack[-1][0] == tag:
            self.close(tag)
        elif self.counts.get("p") and self.stack[-1][0] == "p":
            self.close("p")
        _, unwanted, inside, section = self.stack[-1] if self.stack else ("", False, False, 0)
        if tag in SECTIONS:
            self.sections += 1
            section = self.sections
        self.stack.append((tag, unwanted or _unwanted(tag, attributes, inside), inside or tag in ("article", "main") or bool(re.search(r"role\s*=\s*.?main\b", attributes)), section))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heading = True


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order. Tags are read as they come: what is not closed ends with what it stands in."""
    reader, at = _Reader(), 0
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            break
        m = _TAG.match(page, begin)
        if not m:  # a sign, not a tag
            reader.add(page[at : begin + 1])
            at = begin + 1
            continue
        reader.add(page[at:begin])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag in RAW and not closing:
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag == "title":
                reader.flush()
        elif tag == "br":
            reader.breaks += 1
            reader.parts.append(" ")
            if reader.breaks > 1:
                reader.flush()
        elif tag == "a":
            reader.link = not closing
        elif tag in BLOCKS:
            if closing:
                reader.flush()
                reader.close(tag)
            elif tag in VOID:
                reader.flush()
            else:
                reader.open(tag, m[3])
    reader.add(page[at:])
    reader.flush()
    return reader.blocks


def decide(block: Block) -> str:
    """The first pass: good, bad, or open: near (of middling density) or short. An article's own prose is never bad for its
    length or density, only for its links or the container that it stands in."""
    if block.unwanted or block.linked > LINKED or ("©" in block.text and not block.inside):
        return "bad"
    n = len(block.text)
    if n < SHORT:
        return "short" if not block.linked or block.inside else "bad"
    if block.density >= HIGH:
        return "good" if n > LONG or block.inside else "near"
    if block.density >= LOW:
        return "near"
    return "short" if block.inside else "bad"


def inherit(blocks: list[Block]) -> None:
    """The second pass, in linear time: an open block takes the label of its nearest decided neighbour in its section, ties to
    good, nearness in characters. Without any, an article's block is good, others are if their density is middling."""
    decided = {}
    places, at = [], 0
    for b in blocks:
        b.label = decide(b)
        places.append((at, at + len(b.text)))
        at += len(b.text)
    n = len(blocks)
    before, after = [None] * n, [None] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        decided.clear()
        for i in order:
            b = blocks[i]
            if b.label in ("good", "bad"):
                if not b.unwanted:
                    decided[b.section] = i
            else:
                out[i] = decided.get(b.section)
    final = []
    for i, b in enumerate(blocks):
        if b.label in ("good", "bad"):
            final.append(b.label)
            continue
        near = [(places[i][0] - places[j][1] if j < i else places[j][0] - places[i][1], blocks[j].label != "good", blocks[j].label) for j in (before[i], after[i]) if j is not None]
        if near and not (b.inside and b.label == "near"):
            final.append(min(near)[2])
        else:
            final.append("good" if b.inside or b.label == "near" else "bad")
    # a heading outside of any article stands over the text that follows it closely
    over, at = None, 0
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        if final[i] == "good":
            over = places[i][0]
        elif b.heading and not b.unwanted and b.label == "short" and over is not None and over - places[i][1] <= HEADING:
            final[i] = "good"
    for b, label in zip(blocks, final, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    """The blocks of the text, one a line."""
    blocks = blocks_of(page or "")
    inherit(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


@F.pandas_udf(StringType())
def _main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(main_text, na_action=None)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each row of ``pages`` (page_id, url, html). A null or empty page, or one without any text, has an
    empty text. Repeated rows come back once each, an empty table gives an empty one, and other columns are ignored."""
    return pages.select("page_id", "url", _main_text(F.coalesce("html", F.lit(""))).alias("text"))
