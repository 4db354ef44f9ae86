"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one looks at each block alone: the share of its words that
are frequent function words (stop-word density), its length, and the share of its characters inside links (link
density) make it good, bad or ambiguous. In pass two every ambiguous block (short, or of middling density)
takes the label of its nearest decided neighbour, where near means few blocks and few steps through the tree of
elements between both, so that the last short line of an article goes with the article and not with the footer.

Markup is a feature beside these. Scripts, styles and controls are never text. Elements that say that they are a
menu, header, footer, sidebar, notice, advert, form or reader comments (by tag, role or a whole class or id
token) make their blocks bad, unless such an element holds most of the page's running text (nearly all of it for
comments): then it is a wrapper and says nothing. Where the markup names an article that holds most of the running text, blocks
outside it are bad. What is inside is decided by the rules.

Defined cases: null or empty html gives an empty text; markup that never closes is closed at the end of the page,
and a tag cut off there is dropped; in a page without any good block the ambiguous one that looks most like
running text stands for it; ties between neighbours go to the text; unknown entities stay as written; control
characters other than white space stay. Very long pages are parsed whole, in time that grows with their
length. Repeated rows give repeated results, an empty table an empty one; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from eventide.llm.common import pieces

SCHEMA = "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint"

#: Function words of the languages that pages are written in; they are common in running text and rare in menus.
STOP_WORDS = frozenset(
    "the of and to in is that it for was as with be by on are this not but have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must through back years where much your way down should because long each just state those people too little"
    " der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn"
    " de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou mais comme aux cette ses être elle nous leur fait été tout entre"
    " que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya cuando todo esta ser son dos también fue había era muy hasta desde está mi porque"
    " il di che è e per non una sono con del della da si dei le gli alla nel come anche".split()
)  # fixed values

#: Elements whose content is never text, void elements, and elements whose content is not markup.
DROPPED = frozenset("script style noscript template iframe object embed svg canvas button select textarea math audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY_NEXT = frozenset("li dd dt tr td th option".split())
#: Elements that say by their tag that they are not the article.
HINTED = frozenset("nav footer aside form header menu dialog label legend".split())
#: What a whole class or id token or a role may be: one of these, with words of position before and of shape behind.
_NAMED = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|user|reader|post|article|cookie|email|social|google|side|js|c|m|l)-)*"
    r"(?:ads?|advert|adverts|advertisement|advertising|adslot|adbox|adsense|banner|sponsor|sponsored|promo|promotion|promoted|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|paywall|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|widget|widgets|related|recommended|recommendations|trending|share|sharing|social|follow|toolbar|"
    r"(?P<talk>comments?|commentlist|respond|replies|reply|disqus|discussion)|footer|masthead|header|topbar|copyright|legal|disclaimer|login|signin|signup|search|searchform|skiplink|skip|tags|hidden|complementary|contentinfo)"
    r"(?:-(?:list|box|bar|section|area|container|wrapper|wrap|block|links?|menu|banner|notice|text|form|body|content|slot|unit|label|buttons?|icons?|posts?|articles?|stories|items?|thread|message|signup|nav|inner|outer|top|bottom|left|right|header|footer|overlay|popup|widget|[0-9]+))*[0-9]*"
)
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_IN_TAG = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in RAW}

#: Thresholds of the first pass: length in characters, share of stop-words, share of characters in links.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.05, 0.15
LINKS_SOME, LINKS_HIGH = 0.1, 0.3
#: An element that holds more of the running text than this is a wrapper, whatever its name; for comments the second.
WRAPPER, TALK = 0.5, 0.9
#: Blocks that a step through the tree counts for, and steps that the border of a named article counts for.
TREE, BORDER = 64, 4
#: Elements nested deeper count as standing at this depth.
DEPTH = 512


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    path: tuple[int, ...] = ()
    hint: int = -1  #: innermost element around it that hints at boilerplate
    article: int = -1
    text: str = ""
    stops: float = 0.0
    links: float = 0.0
    label: str = ""


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    talks: list[bool] = field(default_factory=list)  #: for each element that hints at boilerplate: is it of comments
    outer: list[int] = field(default_factory=list)  #: and the hinting element around it, or -1


def _hint(name: str, attrs: str, in_article: bool) -> str:
    """What an element says about itself: nothing, boilerplate or talk."""
    if name in HINTED and not (name == "header" and in_article):
        return "boilerplate"
    if attrs and name not in ("html", "body", "article", "main"):
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), entities.unescape(a or b or c).lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                return "boilerplate"
            if key in ("class", "id", "role"):
                for token in value.replace("_", "-").split():
                    if m := _NAMED.fullmatch(token):
                        return "talk" if m["talk"] else "boilerplate"
    return ""


def tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closes, name, attributes) of every tag, comment (no name) and raw element, in one pass."""
    at, size = 0, len(html)
    gone: dict[str, bool] = {}  # what does not stand in the rest of the page

    def find(what: str, begin: int) -> int:
        if gone.get(what):
            return -1
        k = html.find(what, begin)
        gone[what] = k < 0
        return k

    while (begin := html.find("<", at)) >= 0:
        after = html[begin + 1 : begin + 9]
        if after[:1] in ("!", "?"):
            mark = "-->" if after.startswith("!--") else "]]>" if after.startswith("![CDATA[") else ">"
            k = find(mark, begin + (4 if mark == "-->" else 2))
            at = size if k < 0 else k + len(mark)
            yield begin, at, False, "", ""
            continue
        m = _OPEN.match(html, begin)
        if not m:
            at = begin + 1
            continue
        k = m.end()
        while True:
            n = _IN_TAG.search(html, k)
            if n is None:
                k = size
                break
            k = n.end()
            if n[0] == ">":
                break
            close = find(n[0][-1], k)
            k = k if close < 0 else close + 1
        name = m[2].lower()
        attrs = html[m.end() : k - 1]
        if not m[1] and name in RAW:
            end = None if gone.get(name) else _ENDS[name].search(html, k)
            gone[name] = end is None
            k = end.end() if end else size
            yield begin, k, False, "", ""
        else:
            yield begin, k, bool(m[1]), name, attrs
        at = k


def parse(html: str) -> Page:
    """Blocks of a page in order, each with where it stands and what its elements say."""
    page, now = Page(), Block()
    stack: list[tuple[str, int, int, bool, bool]] = []  # open elements: name, own number, hint, dropped, article
    counts: dict[str, int] = {}  # open elements by name
    path, hints, articles = [], [], []
    where: tuple[int, ...] | None = ()  # path as a tuple, shared by the blocks that stand there
    dropped = links = made = 0

    def close() -> None:
        nonlocal now
        text = _SPACE.sub(" ", entities.unescape("".join(now.parts))).strip()
        if text:
            now.text = text
            page.blocks.append(now)
        now = Block()

    def pop() -> None:
        nonlocal dropped, where
        name, number, hint, drop, article = stack.pop()
        counts[name] -= 1
        dropped -= drop
        if number >= 0:
            path.pop()
            where = None
        if hint >= 0:
            hints.pop()
        if article:
            articles.pop()

    def add(piece: str) -> None:
        nonlocal where
        if not now.parts:
            where = tuple(path) if where is None else where
            now.path, now.hint, now.article = where, hints[-1] if hints else -1, articles[-1] if articles else -1
        now.parts.append(piece)
        if links:
            now.linked += len(piece.strip())

    done = 0
    for begin, end, closes, name, attrs in tags(html):
        if begin > done and not dropped:
            add(html[done:begin])
        done = end
        if not name:
            continue
        if name in ("br", "wbr"):
            if name == "br" and not dropped:
                add("\n")
        elif name in VOID:
            if name == "hr" and not dropped:
                close()
        elif name == "a":
            links = max(0, links + (-1 if closes else 1)) if not dropped else links
        elif not closes:
            if attrs.endswith("/") and name not in BLOCKS:
                continue
            hint, drop = _hint(name, attrs, bool(articles)), name in DROPPED
            if not (name in BLOCKS or hint or drop):
                continue
            if name == "p" or name in CLOSED_BY_NEXT:
                while stack and (stack[-1][0] == "p" or stack[-1][0] == name):
                    pop()
            if not dropped:
                close()
            made += 1
            article = name in ("article", "main")
            if hint:
                page.talks.append(hint == "talk")
                page.outer.append(hints[-1] if hints else -1)
                hints.append(len(page.talks) - 1)
            deep = len(path) >= DEPTH
            if not deep:
                path.append(made)
                where = None
            if article:
                articles.append(made)
            dropped += drop
            counts[name] = counts.get(name, 0) + 1
            stack.append((name, -1 if deep else made, len(page.talks) - 1 if hint else -1, drop, article))
            links = 0 if name in BLOCKS else links
        elif counts.get(name):
            if not dropped and name in BLOCKS or not drop_only(stack, name):
                close()
            while stack[-1][0] != name:
                pop()
            pop()
            links = 0 if name in BLOCKS else links
    if done < len(html) and not dropped:
        add(html[done:])
    close()
    return page


def drop_only(stack: list[tuple[str, int, int, bool, bool]], name: str) -> bool:
    """Whether an element is open only because its content is dropped; its end then is no border of a block."""
    return stack[-1][0] == name and stack[-1][3]


def first_pass(page: Page) -> None:
    """Labels each block by itself, then by what its elements say."""
    for b in page.blocks:
        words = _WORD.findall(b.text.lower())
        b.stops = sum(map(STOP_WORDS.__contains__, words)) / max(1, len(words))
        b.links = b.linked / max(1, len(b.text))
        if b.links > LINKS_HIGH or b.text[0] == "©" or len(b.text) < SHORT and b.links > LINKS_SOME:
            b.label = "bad"
        elif len(b.text) < SHORT:
            b.label = "short"
        elif b.stops >= STOPS_HIGH and len(b.text) > LONG:
            b.label = "good"
        else:
            b.label = "near"
    running = [len(b.text) if b.label != "bad" else 0 for b in page.blocks]
    held, total = [0] * len(page.talks), sum(running)
    for b, n in zip(page.blocks, running, strict=True):
        if b.hint >= 0:
            held[b.hint] += n
    out = [False] * len(held)
    for h in range(len(held) - 1, -1, -1):  # inner elements come after outer ones
        if page.outer[h] >= 0:
            held[page.outer[h]] += held[h]
    for h, n in enumerate(held):
        wrapper = n > LONG and n > (TALK if page.talks[h] else WRAPPER) * total
        out[h] = not wrapper or page.outer[h] >= 0 and out[page.outer[h]]
    for b in page.blocks:
        if b.hint >= 0 and out[b.hint]:
            b.label = "bad"
    left = [(len(b.text), b.article >= 0) for b in page.blocks if b.label != "bad"]
    if 2 * sum(n for n, inside in left if inside) > sum(n for n, _ in left):  # the markup names an article
        for b in page.blocks:
            if b.article < 0:
                b.label = "bad"


def steps(a: Block, b: Block) -> int:
    """Elements to leave and enter between two blocks; the borders of a named article and of a hint count for more."""
    k = 0
    for x, y in zip(a.path, b.path, strict=False):
        if x != y:
            break
        k += 1
    return len(a.path) + len(b.path) - 2 * k + BORDER * (a.article != b.article) + (a.hint != b.hint)


def second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks take the label of their nearest decided neighbour; afterwards every label is good or bad."""
    first = [b.label for b in blocks]
    if "good" not in first:  # the ambiguous block that looks most like running text stands for it
        open_ones = [i for i, x in enumerate(first) if x != "bad"]
        if open_ones:
            first[max(open_ones, key=lambda i: (min(blocks[i].stops, STOPS_HIGH) * len(blocks[i].text), len(blocks[i].text), -i))] = "good"
    near: list[list[int]] = [[] for _ in blocks]
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[str, int] = {}
        for i in order:
            near[i] += last.values()
            if first[i] in ("good", "bad"):
                last[first[i]] = i
    for i, b in enumerate(blocks):
        b.label = first[i]
        if first[i] in ("near", "short"):
            around = [(TREE * steps(b, blocks[j]) + abs(i - j), first[j] != "good") for j in near[i]]
            b.label = "bad" if min(around)[1] else "good"


def extract(html: str | None) -> tuple[str, int, int]:
    """Main text, number of blocks and number of blocks kept."""
    page = parse(html or "")
    first_pass(page)
    second_pass(page.blocks)
    kept = [b.text for b in page.blocks if b.label == "good"]
    return "\n\n".join(kept), len(page.blocks), len(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html", 4 << 20):
            got = [extract(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()),
                pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()),
            ], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")).mapInArrow(run, SCHEMA)
