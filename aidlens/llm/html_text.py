"""HTML extraction (8): the subtree of greatest composite text density.

A page becomes a tree of its block elements; inline elements count as tags of their block.
Density is characters per tag, lowered where links hold much of the text. The block with the
greatest sum of child densities holds the article; the least density on its way up to the body
is the threshold that other blocks beside that way must reach to belong to it.
"""

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aidlens.llm import common

#: Elements that HTML reads as raw text up to their end tag, or to the end of the page.
RAW = frozenset("script style noscript iframe textarea title xmp".split())
#: Other elements whose content is no article text; they end with their parent at the latest.
EMBEDDED = frozenset("template svg canvas audio video annotation annotation-xml".split())
#: Elements within a drawing that may hold blocks; any other block there ends the drawing.
INNER = frozenset("foreignobject desc".split())
#: Elements that hold no article text.
ASIDE = frozenset("head nav header footer aside form menu dialog button select option fieldset label input".split())
BLOCKS = frozenset(
    "html body address article blockquote center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption".split()
) | ASIDE
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends when it is still open.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: What a class, id or role says: a part of the page beside the article, an advert, or comments and notices.
PART, ADVERT, NEVER = 1, 2, 3
_NOT = r"(?<!has[_-])(?<!no[_-])(?<!with[_-])(?<!without[_-])"
_PARTS = "nav|navigation|navbar|menu|sidebar|footer|header|masthead|modal|social|share|sharing|breadcrumbs?|related|complementary|contentinfo"
_ADVERTS = r"ads?|advert\w*|banner|sponsor\w*|promo\w*|popup|subscribe|newsletter"
_NEVER = "comments?|replies|notice|cookies?|consent"
_BESIDE = re.compile(rf"(?:^|[\s_-]){_NOT}(?:{_PARTS}|{_ADVERTS}|{_NEVER})(?:$|[\s_-])", re.I)
#: Adverts, comments and notices are named by the first or last word of a name; inside one they tell of a part.
_EDGE = r"(?:(?:^|(?<=\s)){0}(?=$|[\s_-])|(?:^|(?<=[\s_-])){1}{0}(?=$|\s))"
_ADVERT = re.compile(_EDGE.format(f"(?:{_ADVERTS})", _NOT), re.I)
_COMMENT = re.compile(_EDGE.format(f"(?:{_NEVER})", _NOT), re.I)
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_QUOTED = re.compile("[^>\"']*+")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def named(attributes: str) -> int:
    """What the names of an element tell of it; 0 if nothing."""
    names = [a or b or c for a, b, c in _NAMES.findall(attributes)] if attributes else []
    if not any(map(_BESIDE.search, names)):
        return 0
    return NEVER if any(map(_COMMENT.search, names)) else ADVERT if any(map(_ADVERT.search, names)) else PART


class Tags:
    """Finds where tags end, moving over the page once.

    A ``>`` in quotes does not end a tag. Where quotes or the tag are never closed, quotes count
    for nothing up to there, so that no stretch of the page is read again and again.
    """

    def __init__(self, page: str):
        self.page, self.plain_to = page, 0

    def end(self, at: int) -> int:
        """The place of the ``>`` of a tag read up to ``at``; -1 if there is none."""
        if at >= self.plain_to:
            place = at
            while True:
                place = _QUOTED.match(self.page, place).end()
                sign = self.page[place : place + 1]
                if sign == ">":
                    return place
                close = self.page.find(sign, place + 1) if sign else -1
                if close < 0:
                    self.plain_to = place if sign else len(self.page) + 1
                    break
                place = close + 1
        return self.page.find(">", at)


class Block:
    """A block element: child blocks and text runs in page order, and what they add up to."""

    __slots__ = ("name", "parent", "parts", "beside", "named", "links", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, name: str, parent: "Block | None", beside: bool = False, named: int = 0, links: int = 0):
        self.name, self.parent, self.beside, self.named, self.links = name, parent, beside, named, links
        self.parts: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0

    def blocks(self) -> list["Block"]:
        return [p for p in self.parts if isinstance(p, Block) and not p.beside]


def parse(page: str) -> Block:
    """The page's blocks. What is left open ends with its parent, stray end tags are nothing."""
    root = Block("html", None)
    stack, opened = [root], Counter()
    tags, at, links = Tags(page), 0, 0
    last: dict[str, int] = {}  # where the last end tag of an embedded element is

    def text(chunk: str) -> None:
        if chunk and not chunk.isspace():
            chunk = entities.unescape(chunk) if "&" in chunk else chunk
            n = len("".join(chunk.split()))
            stack[-1].chars += n
            if links:
                stack[-1].link_chars += n
        if chunk:
            stack[-1].parts.append(chunk)

    def enter(block: Block) -> None:
        stack.append(block)
        opened[block.name] += 1

    def leave() -> Block:
        opened[stack[-1].name] -= 1
        return stack.pop()

    def ended(name: str) -> bool:
        """Whether the element is ended at all after this place."""
        if name not in last:
            last[name] = max((e.start() for e in re.finditer(rf"</{name}\s*>", page, re.I)), default=-1)
        return last[name] >= at

    while m := _OPEN.search(page, at):
        if m[0] == "<!--":
            close = page.find("-->", m.end())
            stop = close + 3 if close >= 0 else len(page)
        else:
            stop = (tags.end(m.end()) if m[2] else page.find(">", m.end())) + 1
            if not stop:
                break  # nothing after this is a tag
        text(page[at : m.start()])
        at = stop
        name, attributes = (m[2] or "").lower(), page[m.end() : stop - 1]
        if not name:
            continue
        if m[1]:
            if opened[name]:
                while (block := leave()).name != name:
                    pass
                links = block.links
            elif name == "a":
                links = max(0, links - 1)
            continue
        drawn = opened["svg"] > 0
        if attributes.endswith("/") and (name == "svg" or name in RAW and drawn):
            continue
        if name in EMBEDDED or name in INNER and drawn:
            if ended(name):  # one that is never ended holds nothing
                enter(Block(name, stack[-1], links=links))  # no part of its parent
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in BLOCKS:
            if name not in VOID and (opened[name] or attributes and named(attributes) >= ADVERT and not opened["pre"]) and ended(name):
                enter(Block(name, stack[-1], links=links))  # an advert in a line, or an element inside one
                continue
            stack[-1].tags += 1
            if name == "a":
                links += 1
                stack[-1].link_tags += 1
            elif name == "br":
                stack[-1].parts.append("\n")
            continue
        while stack[-1].name == "svg":
            leave()
        ends = ENDS.get(name, ())
        while stack[-1].name == "p" and stack[-1] is not root or stack[-1].name in ends:
            leave()
        links = 0
        page_part = name not in ("html", "body")
        child = Block(name, stack[-1], page_part and name in ASIDE, named(attributes) if page_part and attributes else 0)
        stack[-1].parts.append(child)
        if name not in VOID:
            enter(child)
    text(page[at:])
    settle(root)
    return root


def settle(root: Block) -> None:
    """Leave out the blocks that are named as beside the article, whatever their size.

    Comments and notices always go. Another name is overruled only by what the block encloses:
    the only article or main element, or, where there is none, the only first heading, with
    paragraphs. Where nothing but parts of the page has text, the part that has most is read.
    """
    mains, titles, parts = [], [], []
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.named == NEVER:
            node.beside = True
            continue
        if node.name in ("article", "main") and not inside:
            mains.append(node)
            inside = True
        if node.name == "h1":
            titles.append(node)
        if node.named:
            parts.append(node)
        todo += [(b, inside) for b in reversed(node.blocks())]
    if not parts:
        return
    free = {root}
    if len(mains) == 1:
        free.update(_up(mains[0]))
    elif not mains and len(titles) == 1:
        above = _up(titles[0])[1:]
        place = {node: k for k, node in enumerate(above)}
        inner, todo = len(above), [(root, len(above) - 1)]
        while todo:  # the innermost block above the heading that encloses a paragraph too
            node, k = todo.pop()
            k = place.get(node, k)
            if node.name == "p" and node.chars:
                inner = min(inner, k)
            todo += [(b, k) for b in node.blocks()]
        free.update(above[inner:])
    weight = {root: 0}
    spread = [(root, root)]
    while spread:
        node, region = spread.pop()
        if node.named and node not in free:
            region = node
            weight[region] = 0
        weight[region] += node.chars - node.link_chars
        spread += [(b, region) for b in node.blocks()]
    if not weight[root]:
        free.update(_up(max((r for r in weight if r.named != ADVERT), key=weight.__getitem__)))
    for node in parts:
        node.beside = node.beside or node not in free


def _up(block: Block) -> list[Block]:
    """The block and all that enclose it."""
    out = [block]
    while (block := block.parent) is not None:
        out.append(block)
    return out


def weigh(root: Block) -> list[Block]:
    """Sum characters and tags up the tree and set densities; blocks in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed(node.blocks())
    for node in reversed(order):
        for child in node.blocks():
            node.chars += child.chars
            node.tags += child.tags + 1
            node.link_chars += child.link_chars
            node.link_tags += child.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = c / t * max(math.log(c * t / (lc * lt)) / math.log(base) if base > 1 else math.log(c * t / (lc * lt)), 0.0) if c * t > lc * lt else c / t * 1e-3
    return order


def _flow(node: Block, out: list[str]) -> None:
    """The block's text, one entry a block, in page order."""
    todo: list = [iter(node.parts)]
    run: list[str] = []

    def close() -> None:
        line = " ".join("".join(run).split())
        run.clear()
        if line:
            out.append(line)

    while todo:
        for part in todo[-1]:
            if isinstance(part, str):
                run.append(part)
            elif not part.beside:
                close()
                todo.append(iter(part.parts))
                break
        else:
            close()
            todo.pop()


def section(block: Block) -> bool:
    """Whether a block is a section of an article: a heading, then paragraphs, mostly without links."""
    names = [b.name for b in block.blocks() if b.chars]
    return names[:1] in (["h2"], ["h3"]) and "p" in names and 2 * block.link_chars < block.chars


def main_text(page: str) -> str:
    """The article's blocks, one a line; empty if there is none."""
    root = parse(page)
    order = weigh(root)
    if not root.chars:
        return ""
    body = next((b for b in order if b.name == "body"), root)
    sums = [(sum(c.density for c in b.blocks()) or (b.density if b is body else 0.0), -k) for k, b in enumerate(order)]
    best = order[-max(sums)[1]]
    for node in _up(best):  # all of an article or main element is the article
        best = node if node.name in ("article", "main") else best
    path = _up(best)
    threshold = min(b.density for b in path if b.density) if best.density else 0.0
    before: list[str] = []
    after: list[list[str]] = []
    for above, inner in zip(path[:0:-1], path[-2::-1]):
        sides: list[list[str]] = [[], []]
        run: list[str] = []
        passed = 0
        for part in [*above.parts, None]:
            if isinstance(part, str):
                run.append(part)
                continue
            line = " ".join("".join(run).split())
            run = []
            if line and len("".join(line.split())) >= threshold:
                sides[passed].append(line)
            if part is inner:
                passed = 1
            elif part is not None and not part.beside and part.chars and (part.density >= threshold or section(part)):
                _flow(part, sides[passed])
        before += sides[0]
        after.append(sides[1])
    _flow(best, before)
    return "\n".join([*before, *(line for side in reversed(after) for line in side)])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    A null or empty page has an empty text. Ids and addresses may be null or repeated, each row
    gives one row. Work is in the row: nothing is shuffled.
    """
    common.prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in common.texts(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    one = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return one.mapInArrow(run, "page_id long, url string, text string, n_chars long")
