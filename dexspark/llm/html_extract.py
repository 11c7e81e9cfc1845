"""Main text of web pages by consensus paths of their hosts.

Method: every page's containers are scored by all text below them, less links and a cost for
every known frame of a page (menus, notices, forms) below them; frames' text is left out. An
element that looks like a frame but holds most of the page's text is none. So text dealt to
sibling containers is won by the container around them. Those around the text lose a share:
all above the lowest that holds the first h1 and half of the page's text, and body where no h1
tells. A container votes with its score for its generalised path, the tag-class names from the
root with digits taken out. Spark sums the votes per host in two steps, so that a host with a
third of all pages is summed by many tasks first, and keeps the path with most votes. Every
page is then read again: the containers of its host's winning path give the text, and a page
without one falls back on its own best path.

The host decides inside the container too. Of every path below it Spark counts the pages and
those whose text there stands on different pages of the host; a path whose text mostly repeats,
or is mostly links, is a frame of the host, whatever its names. Pages differ if their longest
blocks do, so copies of a page are no evidence. Lists of dated items or of other articles after
the title are told by their structure. Names of elements decide where a host does not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dexspark.llm.common import materialise, slices, small_batches
from dexspark.llm.url_filters import host_and_path

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
#: Attributes of elements that are not shown.
UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*["']?until-found)|\bstyle\s*=\s*(?:"[^"]*|'[^']*|)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg annotation annotation-xml xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body center details div main section table td".split())
#: Frames by their name; those of the first list never hold the text.
HARD = frozenset("button footer head menu nav select script style textarea title noscript iframe template svg annotation annotation-xml xmp noembed noframes".split())
FRAME = HARD | frozenset("aside dialog form header".split())
CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "body", "html", "legend", "summary"}
#: Elements that only a whole class, id or role marks as a frame; headings are none.
SMALL = frozenset("a abbr b cite code em font i label mark p small span strong sub sup time u".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names that tell of a frame elsewhere, or of the head of a text.
ELSEWHERE = re.compile(r"(?:^|[-_])(?:has|no|not|with|without)[-_]|[-_](?:open|closed|enabled|disabled)$")
TEXT_HEAD = re.compile(r"(?:article|blog|content|entry|news|page|post|single|story)[-_]+header")
#: Words of a class, id or role that mark a frame of a page, alone or with words of layout (``site-header``, not ``share-price``).
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promos promotion promoted related replies reply share sharing sidebar social sponsor sponsored sponsors subscribe "
    "toolbar widget widgets complementary contentinfo search".split()
)
LAYOUT_WORDS = frozenset(
    "action actions alert and area article articles aside bar block blocks body bottom box btn button buttons cell col column columns container content desktop dialog extra first fixed float "
    "form global group holder icon icons inline inner item items label last layer left lightbox link links list lower main media mobile module note outer overlay page pane panel post posts "
    "primary rail region right root row secondary section sections side signup site slot small sticky stories story strip sub tab tabs text the title top unit upper user view wrap wrapper "
    "wrapping zone".split()
)
#: Those of FRAME_WORDS that mark a frame of an article or main element itself, which a site may well name after its parts.
MAIN_WORDS = frozenset("ad ads advert adverts advertisement comment comments promo promos related replies reply sponsor sponsored sponsors".split())
#: Those that are parts of a text where they stand inside an article or main element.
TEXT_WORDS = frozenset("menu modal search toolbar widget widgets".split())
#: Those that are so too where they hold no link.
DOUBT_WORDS = frozenset("notice notices related social".split())
#: Remarks of readers, which may be longer than the text.
REMARK_WORDS = frozenset("comment comments disqus replies reply".split())
PARTS_OF_NAME = re.compile(r"[a-z]+")
#: What kind of frame an element is; a frame of a soft kind is none with these shares of the page's text, in article or main and at all.
NONE, SOFT, REMARKS, NEVER, DOUBT = range(5)
MAIN_SHARE, TEXT_SHARE = 0.5, 0.8
#: Elements that stand for the main text, with the weight of their votes.
MAIN = {"article": 5, "main": 4}
#: Characters that a frame below a container costs it; share of its score left to one that is around the text.
FRAME_COST, AROUND = 25, 0.6
#: Bytes of all winning paths up to which they are sent to every task; beyond, pages are dealt to PARTS parts of their host.
BROADCAST, PARTS = 32 << 20, 64
#: Pages of a host that make a frame by repetition, share of its pages that a path must be on, share of these whose text repeats, share
#: of the text in links, share of the container's text that a frame may hold.
PAGES, PRESENT, REPEATED, LINKED, FRAME_SHARE = 3, 0.01, 0.5, 0.8, 0.3
#: Block elements that are judged with what is around them, if they have no class.
PLAIN = frozenset("body dd dt h1 h2 h3 h4 h5 h6 hgroup html legend li option optgroup p summary tbody td tfoot th thead tr".split())
#: Dated items, or other articles, that make their list one of remarks or teasers; share of the page's text from which it is the text.
ITEM, ITEMS, LIST_SHARE = frozenset("article div li section".split()), 2, 0.5
#: Characters of a path from which on the elements above are named by a hash.
PATH = 256
#: A tag whose quotes do not match.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
#: Elements that bound the search for a paragraph to close, and for an item.
KEEPS_P, LISTS = CONTAINER | {"li", "blockquote"}, ("ul", "ol", "dl", "menu", "table", "select")
SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass(slots=True)
class Node:
    """An element: its generalised path, the innermost frame and main element that it is or lies in, and what it spans.

    blocks, links and frames of an element are intervals of what the page has counted, so that
    nothing is stored once per ancestor.
    """

    name: str
    path: str
    above: Node | None
    frame: Node | None = None
    holder: Node | None = None
    main: Node | None = None
    kind: int = NONE
    never: bool = False
    #: Places in the stack of open elements: its own, of the next block, of the next element that keeps paragraphs.
    place: int = 0
    block: int = 0
    keeps: int = 0
    #: Blocks, elements, text and h1 met before it opened and when it closed.
    first: int = 0
    end: int = 0
    order: int = 0
    last: int = 0
    text: int = 0
    titles: int = 0
    main_text: int = 0
    times: int = 0
    items: int = 0
    linked: int = 0
    hides: bool = False
    size: int = 0
    links: int = 0
    frames: int = 0
    around: bool = False

    def hidden(self) -> bool:
        return self.frame is not None and self.frame.hides


def frame_word(name: str) -> str | None:
    """The word that makes a name one of a frame: all its other parts are words of layout."""
    parts = PARTS_OF_NAME.findall(name)
    told = next((p for p in parts if p in FRAME_WORDS), None)
    return told if told and all(p in FRAME_WORDS or p in LAYOUT_WORDS for p in parts) else None


def framed(tag: str, words: list[str], inside: bool = False) -> int:
    """The kind of frame that an element is by its name and by the names in its class, id and role."""
    if tag in HARD:
        return NEVER
    if not words:
        return SOFT if tag in FRAME else NONE
    names = [w for w in words if not ELSEWHERE.search(w)]
    told = [w for w in map(frame_word, names) if w]
    if tag in MAIN:
        return REMARKS if any(w in MAIN_WORDS for w in told) else NONE
    if tag in HEADING or tag in ("html", "body") or any(TEXT_HEAD.fullmatch(w) for w in names):
        return NONE
    if tag in SMALL:
        told = [w for w in names if w in FRAME_WORDS]
    if any(w in REMARK_WORDS for w in told):
        return REMARKS
    told = [w for w in told if not (inside and w in TEXT_WORDS)]
    if inside and told and tag not in FRAME and all(w in DOUBT_WORDS for w in told):
        return DOUBT
    return SOFT if told or tag in FRAME else NONE


def named(tag: str, attributes: str, inside: bool = False) -> tuple[str, int]:
    """The generalised tag-class name of an element, and what kind of frame of the page it is."""
    found = CLASS.findall(attributes) if attributes else []
    unseen = attributes and tag not in ("html", "body") and UNSEEN.search(attributes)
    if not found:
        return tag, NEVER if unseen else framed(tag, [])
    words = " ".join(a or b or c for _, a, b, c in found).lower().split()
    classes = next((a or b or c for kind, a, b, c in found if kind.lower() == "class"), "")
    general = ".".join(sorted(set(re.sub(r"\d+", "#", classes.lower()).split())))[:PATH]
    return (f"{tag}.{general}" if general else tag), NEVER if unseen else framed(tag, words, inside)


class Page:
    """The elements of a page that can hold its text, and its text blocks, in page order."""

    def __init__(self, html: str):
        self.root = Node("#page", "", None)
        self.held, self.frames, self.titles = [self.root], [], []
        #: Elements that a host or their structure can make frames, and headings.
        self.parts, self.heads = [], []
        #: A block is its runs, pieces in one frame each: the frame, texts, characters in links.
        self.raw: list[list[list]] = []
        self.runs: list[list] = []
        self.stack, self.open = [self.root], {}
        self.count = self.total = self.headings = self.times = self.linked = 0
        self.parse(html)
        self.close(1)
        self.root.end, self.root.last = len(self.raw), self.count
        self.judge()

    def add(self, piece: str) -> None:
        top = self.stack[-1]
        if top.never:
            return
        if not self.runs or self.runs[-1][0] is not top.frame:
            self.runs.append([top.frame, [], 0])
        self.runs[-1][1].append(piece)
        if self.open.get("a"):
            self.runs[-1][2] += 0 if self.open.get("h1") else len(piece)  # a title may link to its own page
            self.linked += len(piece.strip())
        else:
            self.total += len(piece.strip())

    def flush(self) -> None:
        if self.runs:
            self.raw.append(self.runs)
            self.runs = []

    def close(self, place: int) -> None:
        """Take the elements from a place on off the stack."""
        for node in reversed(self.stack[place:]):
            self.open[node.name].pop()
            node.end, node.last, node.text, node.titles = len(self.raw), self.count, self.total - node.text, self.headings - node.titles
            node.times, node.linked = self.times - node.times, self.linked - node.linked
            # an item has a date, or as an article links elsewhere, apart from its text
            if node.name in ITEM and not node.titles and node.end - node.first > 1 and (node.times or node.linked and node.name == "article"):
                node.above.items += 1
            outer = node.above.main
            if node.main is node:
                # an outermost main element below a frame
                frame = node.frame
                if frame is not None and (outer is None or frame.place > outer.place):
                    frame.main_text += node.text
            if node.frame is node and (up := node.above.frame) is not None and node.main is up.main:
                up.main_text += node.main_text
        del self.stack[place:]

    def parse(self, html: str) -> None:
        end = 0
        while found := TOKEN.match(html, end):
            if found.group(0) == "<":
                found = LOOSE.match(html, end) or found
            end = found.end()
            tag = found.group(2) if found.re is LOOSE or found.group(0) != "<" else None
            if tag is None:
                piece = found.group(0)
                if piece[0] != "<" or piece == "<":
                    if not self.stack[-1].never:
                        self.add(unescape(piece))
                elif piece.startswith("<![CDATA["):
                    self.add(piece[9:].removesuffix("]]>"))
                continue
            tag = tag.lower()
            if found.group(1):
                self.ended(tag)
            elif tag in VOID:
                if tag == "br" and self.runs:
                    self.runs[-1][1].append(" ")
                elif tag == "hr":
                    self.flush()
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, end)
                end = close.end() if close else len(html)
            else:
                self.begun(tag, found.group(3))
        self.flush()

    def ended(self, tag: str) -> None:
        places = self.open.get(tag)
        if not places:
            if tag == "p":
                self.flush()
            return
        if tag not in BLOCK and places[-1] < self.stack[-1].block:
            return  # a stray end of an inline element does not close blocks
        if self.stack[-1].block >= places[-1]:
            self.flush()
        self.close(places[-1])

    def begun(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
            # what the standard closes by itself
            at = -1
            if tag in CLOSES_P:
                at = self.open["p"][-1] if self.open.get("p") else -1
                at = at if at > self.stack[-1].keeps else -1
            elif tag in SAME:
                at = max((self.open[n][-1] for n in SAME[tag] if self.open.get(n)), default=-1)
                at = at if at > max((self.open[n][-1] for n in LISTS if self.open.get(n)), default=0) else -1
            if at > 0:
                self.close(at)
        above = self.stack[-1]
        name, kind = named(tag, attributes, above.main is not None)
        if tag == "header" and (self.open.get("article") or self.open.get("main")):
            kind = NONE  # the head of an article belongs to it
        path = above.path
        if tag in BLOCK:
            path = f"{path}/{name}" if len(path) < PATH else f"#{xxhash.xxh3_64_hexdigest(path.encode())}/{name}"
        place = len(self.stack)
        node = Node(tag, path, above, above.frame, above if above.name in CONTAINER or above is self.root else above.holder, above.main, kind, above.never or kind == NEVER, place)
        node.block = place if tag in BLOCK else above.block
        node.keeps = place if tag in KEEPS_P else above.keeps
        self.count += 1
        node.first, node.order, node.text, node.titles = len(self.raw), self.count, self.total, self.headings
        node.times, node.linked = self.times, self.linked
        self.times += tag == "time"
        if tag in MAIN and kind == NONE:
            node.main = node
        if kind != NONE:
            node.frame = node
            self.frames.append(node)
        if tag == "h1":
            self.headings += 1
            self.titles.append(node)
        if tag in CONTAINER:
            self.held.append(node)
        if tag in BLOCK and not node.never and (tag not in PLAIN or name != tag):
            self.parts.append(node)
        if tag in HEADING:
            self.heads.append(node)
        self.stack.append(node)
        self.open.setdefault(tag, []).append(place)

    def judge(self) -> None:
        """Tell frames, then what every container holds outside them."""
        counted = np.zeros(self.count + 2, dtype=np.int64)
        for f in self.frames:
            up = f.above.frame
            much = f.text > 0 and f.text >= TEXT_SHARE * self.total
            none = f.kind == DOUBT and not f.linked or f.kind in (SOFT, DOUBT) and (much or 0 < MAIN_SHARE * self.total <= f.main_text) or f.kind == REMARKS and much and f.titles > 0
            f.hides = not none or up is not None and up.hides
            counted[f.order] = f.hides and f.name in BLOCK and not (up is not None and up.hides)
        self.blocks = []
        links = []
        for runs in self.raw:
            runs = [run for run in runs if run[0] is None or not run[0].hides]
            self.blocks.append(SPACE.sub(" ", "".join("".join(run[1]) for run in runs)).strip())
            links.append(sum(run[2] for run in runs) if self.blocks[-1] else 0)
        listed = self.lists()
        for at in np.flatnonzero(self.inside(listed)).tolist():
            self.blocks[at], links[at] = "", 0
        self.hashes = np.cumsum(np.array([0, *(xxhash.xxh3_64_intdigest(b.encode("utf-8", "replace")) if b else 0 for b in self.blocks)], dtype=np.uint64))
        sizes, linked, counted = (np.cumsum(np.concatenate(([0], x))) for x in (np.fromiter(map(len, self.blocks), np.int64, len(self.blocks)), np.array(links, dtype=np.int64), counted))
        self.sizes, self.linked_to = sizes, linked
        for n in self.held:
            n.size, n.links = int(sizes[n.end] - sizes[n.first]), int(linked[n.end] - linked[n.first])
            n.frames = int(counted[n.last + 1] - counted[n.order + 1])
        at = next((n.holder for n in self.titles if not n.hidden()), None)
        while at is not None and 2 * at.size < self.root.size:
            at = at.holder
        for n in self.held:
            n.around = at is None and n.name in ("#page", "html", "body")
        while at is not None and (at := at.holder) is not None:
            at.around = True
        self.held = [n for n in self.held if not n.hidden()]

    def inside(self, nodes: list[Node]) -> np.ndarray:
        """Which blocks lie in one of the elements."""
        change = np.zeros(len(self.raw) + 1, dtype=np.int64)
        for n in nodes:
            change[n.first] += 1
            change[n.end] -= 1
        return np.cumsum(change)[:-1] > 0

    def lists(self) -> list[Node]:
        """Lists of dated items or of other articles after the title, and the headings right before them."""
        title = next((n for n in self.titles if not n.hidden()), None)
        if title is None:
            return []
        out = [n for n in self.parts if n.items >= ITEMS and not n.titles and n.name not in ("table", "dl") and n.first >= title.end and n.text < LIST_SHARE * self.total]
        starts = {n.first for n in out}
        return out + [n for n in self.heads if n.end in starts and n.first < n.end and not n.titles]

    def seen(self) -> dict[str, tuple[int, int, int]]:
        """Hash of the text, characters and those in links of every path of the page that can be a frame or hold the text."""
        out: dict[str, tuple[int, int, int]] = {}
        for n in {id(n): n for n in [*self.held, *(p for p in self.parts if not p.hidden())]}.values():
            size = int(self.sizes[n.end] - self.sizes[n.first])
            if size:
                was = out.get(n.path, (0, 0, 0))
                own = int(self.hashes[n.end]) - int(self.hashes[n.first])
                out[n.path] = ((was[0] + own) % 2**64, was[1] + size, was[2] + int(self.linked_to[n.end] - self.linked_to[n.first]))
        return out

    def identity(self) -> int:
        """Hash of the longest block, by which a host's pages differ."""
        return xxhash.xxh3_64_intdigest(max(self.blocks, key=len, default="").encode("utf-8", "replace"))

    def votes(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for node in self.held:
            if (worth := whole(node)) > 0:
                out[node.path] = out.get(node.path, 0.0) + worth
        return out

    def extract(self, path: str | None, frames: frozenset[str] = frozenset()) -> str:
        chosen = [n for n in self.held if n.path == path and n.size] if path is not None else []
        if not chosen:
            own = self.votes()
            best = min(own, key=lambda p: (-own[p], -len(p), p), default="")
            chosen = [n for n in self.held if n.path == best and n.size]
        cut = self.inside([n for n in self.parts if n.path in frames]) if frames else np.zeros(len(self.raw), dtype=bool)
        out, last = [], -1
        for n in chosen:
            if n.order > last:  # else it lies in one before it
                out.extend(b for b, gone in zip(self.blocks[n.first : n.end], cut[n.first : n.end].tolist(), strict=True) if b and not gone)
                last = n.last
        return "\n".join(out)


def score(node: Node) -> float:
    """Characters of all blocks below the container, less twice those in links and the cost of its frames; a share of it around the text."""
    worth = max(0, node.size - 2 * node.links - FRAME_COST * node.frames)
    return worth * AROUND if node.around else float(worth)


def whole(node: Node) -> float:
    """Like score; elements that stand for the main text count links and frames too, with their weight."""
    return float(MAIN[node.name] * node.size) if node.name in MAIN else score(node)


def votes(html: str | None) -> dict[str, float]:
    """Score of every generalised path of a page."""
    return Page(html or "").votes()


def extract(html: str | None, path: str | None, frames: frozenset[str] = frozenset()) -> str:
    """Text of the outermost containers on the path but for the host's frames; where there is none, on the page's own best path.

    Where no container has any worth, all text outside frames is taken.
    """
    return Page(html or "").extract(path, frames)


COUNTS = "host string, path string, worth double, hash long, page long, chars long, linked long"


def _count_rows(batches):
    """Votes of a slice of pages, summed, and a row of every path of every page."""
    for batch in slices(batches, 128):
        rows: list[tuple] = []
        total: dict[tuple[str, str], float] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(html or "")
            for path, worth in page.votes().items():
                total[host, path] = total.get((host, path), 0.0) + worth
            own = page.identity() - 2**63
            rows.extend((host, path, None, text - 2**63, own, chars, linked) for path, (text, chars, linked) in page.seen().items())
        rows.extend((host, path, worth, None, None, None, None) for (host, path), worth in total.items())
        kinds = [pa.string(), pa.string(), pa.float64(), *[pa.int64()] * 4]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "path", "worth", "hash", "page", "chars", "linked"])


def _text_rows(batches):
    for batch in slices(batches, 128):
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "path", "frames")), strict=True)
        texts = [extract(html, path, frozenset(frames or ())) for html, path, frames in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), batch.column("path")], ["page_id", "url", "text", "path"])


def counted(pages: DataFrame) -> DataFrame:
    """Votes and paths of pages (url, html), written once."""
    own = pages.select(host_and_path(F.col("url").cast("string"))[0].alias("host"), F.col("html").cast("string").alias("html"))
    return materialise(own.mapInArrow(_count_rows, COUNTS))


def winners(counts: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host; ties go to the longer, then the last."""
    sums = counts.filter("worth is not null").groupBy("host", "path").agg(F.sum("worth").alias("worth"))
    return sums.groupBy("host").agg(F.max(F.struct("worth", F.length("path").alias("size"), "path")).alias("best")).select("host", "best.path")


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path) of pages (url, html)."""
    return winners(counted(pages))


def host_frames(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """(host, path): paths below the host's winning one whose text mostly repeats over different pages, or is mostly links.

    At most 1 / PRESENT times as many as a page has paths, whatever the host.
    """
    texts = counts.filter("worth is null").groupBy("host", "path", "hash").agg(
        F.min("page").alias("least"), F.max("page").alias("most"), F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    repeated = F.sum(F.when(F.col("least") < F.col("most"), F.col("pages")).otherwise(0)).alias("repeated")
    sums = texts.groupBy("host", "path").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("pages").alias("pages"), repeated, F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    around = sums.join(paths, ["host", "path"]).select("host", F.col("path").alias("top"), F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    below = sums.join(around, "host").filter(F.col("path").startswith(F.concat("top", F.lit("/"))))
    often = (F.col("pages") >= PAGES) & (F.col("pages") >= PRESENT * F.col("all_pages")) & (F.col("least") < F.col("most"))
    told = (F.col("repeated") >= REPEATED * F.col("pages")) | (F.col("linked") >= LINKED * F.col("chars"))
    return below.filter(often & told & (F.col("chars") <= FRAME_SHARE * F.col("all_chars"))).select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, path) for every row of pages (page_id, url, html).

    text joins the blocks of the main container by a line feed; null or empty html gives an
    empty text, and a null url belongs to the host of the empty name, as does one without
    ``://``. path is the winning path of the host, null where no page of it has any text.
    Repeated rows vote and are read each on their own; they are no evidence that a host repeats itself. A host with
    fewer than PAGES pages on a path leaves that path to names and structure. Pages are read whole, and work and memory
    grow in proportion to a page's length, be its elements never closed. Other columns are
    ignored.

    Html is not shuffled while the winning paths of all hosts take at most BROADCAST bytes;
    beyond, pages go to PARTS parts of their host.
    """
    small_batches(pages)
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    dealt = own.withColumn("_host", host_and_path(F.col("url"))[0])
    counts = counted(own)
    won = materialise(winners(counts))
    frames = host_frames(counts, won).groupBy("host").agg(F.collect_list("path").alias("frames"))
    paths = materialise(won.join(frames, "host", "left"))
    listed = F.coalesce(F.octet_length(F.concat_ws(" ", "frames")), F.lit(0))
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + listed + 64)).first()[0] or 0
    if size <= BROADCAST:
        joined = dealt.join(F.broadcast(paths), F.col("_host") == F.col("host"), "left")
    else:
        parts = paths.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>")))
        dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.lit(PARTS).cast("long")))
        joined = dealt.join(parts, (F.col("_host") == F.col("host")) & (F.col("_part") == F.col("part")), "left")
    return joined.select("page_id", "url", "html", "path", "frames").mapInArrow(_text_rows, own.select("page_id", "url").schema.add("text", "string").add("path", "string"))
