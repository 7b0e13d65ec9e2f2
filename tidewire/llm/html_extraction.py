"""Main text of web pages by consensus of each host's pages.

Every page is parsed and its containers are scored by the prose that stands in them. A container is known by its path of
tags and classes, with numbers generalised, so that one template gives one path. The pages of a host vote with all their
containers; the votes are summed in Spark. Each page is then extracted again with its host's winning path, or, where it
has no such container, with its own best one. All containers of that path count, each as the whole `article` that it
stands in if there is one; what belongs to them beside them, as headings and prose, is taken along (see `extract`).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import apart, cut, small

# Element names of HTML by their part in a page.
RAW = frozenset("script style textarea title iframe noscript template svg math object select canvas video audio".split())
TO_THE_END = frozenset("script style textarea title iframe".split())  # without an end tag they take the rest of the page
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption address summary".split())
CONTAINERS = frozenset("html body main article section div ul ol dl table tbody thead tfoot tr figure details center".split())
ASIDE = frozenset("nav footer aside form header dialog menu button fieldset head".split())
CLOSES_ITSELF = frozenset("p li dt dd td th tr".split())
BREAKS = frozenset("br hr wbr".split())
EMPTY = frozenset("br hr wbr img input link meta source embed area col base param track".split())
PAGE = frozenset(["", "html", "body"])  # what stands side by side in them are regions of the page, not parts of one text
NEVER = frozenset("html body main article".split())  # hold the text, whatever their classes say
WRAPS = frozenset("form header fieldset".split())  # some sites put the whole page into one
# Words that mark page furniture in a class, id or role.
SURE = re.compile(
    r"ads?|adv|advert\w*|comments?|commentlist|consent|cookies?|disqus|gdpr|newsletter|paywall|promo\w*|recommend\w*|related|"
    r"replies|reply|respond|sponsor\w*|teasers?"
)
LIKELY = re.compile(
    r"banner|breadcrumbs?|byline|copyright|disclaimer|footer|header|masthead|menu\w*|meta|modal|nav|navbar|navigation|notices?|alert|"
    r"pagination|pager|popup|share|sharing|sidebar\w*|signup|social|subscribe|subscription|tags|toolbar|widget\w*|complementary|"
    r"contentinfo|search"
)
# Words of the above that mean the same in any compound name, and words that say nothing of a box's content.
CERTAIN = re.compile(
    r"advert\w*|comments?|commentlist|consent|cookies?|disqus|gdpr|newsletter|paywall|sponsor\w*|replies|breadcrumbs?|footer|header|"
    r"masthead|menu|nav|navbar|navigation|pagination|popup|sidebar\w*|signup|toolbar|widget\w*|contentinfo"
)
FRAME = frozenset(
    "a area article articles bar block body bottom box btn button buttons card cards column container content entry global google "
    "grid group heading hot icons in inner item items label left legal line link links list main more news outer page panel part "
    "post posts primary privacy region right row secondary section site slot stories story text this title top unit user wrap "
    "wrapper you".split()
)
HEAD = frozenset(["header", "masthead"])
INLINE = re.compile(r"ads?|adv|advert\w*|sponsor\w*|promo\w*|share|sharing|social|newsletter|cookies?")
ABOUT = re.compile(r"(?:has|no|not|with|without|is|hide|show)[-_]")  # such a class tells of furniture elsewhere
OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>")
CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW}
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PROSE = 140  # letters outside links from which a box with a doubtful name is part of the text
LEAD = 80  # letters of a paragraph in an article's header that is no byline or date
LONG_PATH, LONG_NAME = 160, 80  # beyond these a path goes on from the hash of what came before


@dataclass(slots=True)
class Box:
    """A container: its parent, its path, whether it is page furniture, and what stands in it in page order."""

    parent: Box | None
    tag: str
    path: str
    mark: int = 0  # 1: likely furniture, 2: surely
    doubt: bool = False  # the mark comes only from a part of a name that tells of content too
    head: bool = False  # of furniture, whether its headings belong to what it stands in
    article: Box | None = None  # the outermost article that it is or stands in
    items: list = field(default_factory=list)  # (kind, text, letters of links) or Box
    score: float = 0.0
    prose: int = 0  # letters outside links, of all that stands in it

    @property
    def furniture(self) -> bool:
        return self.mark > 0


def _layout(part: str) -> bool:
    """Whether a part of a name is furniture, a word of layout, a number or a letter."""
    return len(part) < 2 or part in FRAME or part[0].isdigit() or bool(SURE.fullmatch(part) or LIKELY.fullmatch(part))


def _name(tag: str, attrs: str) -> tuple[str, int, bool, bool]:
    """Name with generalised classes, furniture mark, whether it is a header, and whether the mark is in doubt.

    A block of text is marked by whole names only; a container also by the first or last part of a name. Such a mark is in
    doubt if the word has other uses and a further part of the name is neither furniture nor a word of layout, as in
    share-price or related-work. Names that begin with has-, no- and the like are no marks.
    """
    mark, head = (0, False) if tag not in ASIDE else (1 if tag in WRAPS else 2, tag == "header")
    sure = mark > 0
    if not attrs:
        return tag, mark, head, False
    found: dict[str, str] = {}
    for m in NAMED.finditer(attrs):
        found.setdefault(m[1].lower(), next(x for x in (m[2], m[3], m[4], "") if x is not None).lower())
    classes = ".".join(sorted({re.sub(r"\d+", "N", c) for c in found.get("class", "").split()}))
    if len(classes) > LONG_NAME:
        classes = f"#{xxhash.xxh64_hexdigest(classes.encode('utf-8', 'surrogatepass'))}"
    name = f"{tag}.{classes}" if classes else tag
    if tag in NEVER:
        return name, 0, False, False
    for token in " ".join(found.values()).split():
        if ABOUT.match(token):
            continue
        parts = re.split(r"[-_]+", token)
        for part in {token} if tag in BLOCKS else {token, parts[0], parts[-1]}:
            if part in HEAD:
                if tag not in BLOCKS:
                    mark, head, sure = max(mark, 1), True, True
            elif (strong := SURE.fullmatch(part)) or LIKELY.fullmatch(part):
                mark = 2 if strong else max(mark, 1)
                sure = sure or part == token or bool(CERTAIN.fullmatch(part)) or all(map(_layout, parts))
    return name, mark, head, mark > 0 and not sure


def parse(page: str) -> Box:
    """The tree of a page's containers, in one pass whose cost is in proportion to the page.

    Inline markup leaves no trace, inline adverts and the like are left out; open elements end where their parent does.
    A tag whose quotes never close ends at the next >, as do all tags after it; a tag without any > takes the rest.
    """
    root = box = Box(None, "", "")
    open_: dict[str, int] = {}  # how many open boxes have a tag, so that a stray end tag costs no search
    unclosed: set[str] = set()
    block, parts, links, in_link, skip, deep, loose = "", [], 0, False, "", 0, False
    at = start = 0

    def flush():
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                box.items.append((block, text, links))
            parts, links = [], 0

    def leave(to: Box | None):
        nonlocal box
        while box is not to:
            open_[box.tag] -= 1
            box = box.parent

    while m := OPEN.search(page, at):
        at = m.start()
        if at > start and not skip:
            parts.append(page[start:at])
            if in_link:
                links += at - start
        start = len(page)
        if m[0] == "<!--":
            end = page.find("-->", at + 2)
            at = start = end + 3 if end >= 0 else start
            continue
        if m[0] in ("<!", "<?"):
            end = page.find(">", at)
            at = start = end + 1 if end >= 0 else start
            continue
        t = None if loose else TAG.match(page, at)
        if t is None:
            loose = True
            t = LOOSE.match(page, at)
        if t is None:
            break
        at = start = t.end()
        ends, tag, attrs = bool(t[1]), t[2].lower(), t[3]
        if tag in RAW:
            if not ends and tag not in unclosed and not (tag in ("svg", "math") and attrs.endswith("/")):
                if close := CLOSE[tag].search(page, at):
                    at = start = close.end()
                elif tag in TO_THE_END:
                    at = start = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag not in BLOCKS and tag not in CONTAINERS and tag not in ASIDE:
            if tag == skip:
                deep += -1 if ends else 1
                if not deep:
                    skip = ""
            elif not skip and not ends and attrs and tag not in EMPTY and any(
                INLINE.fullmatch(w) for m in NAMED.finditer(attrs) for w in (m[2] or m[3] or m[4] or "").lower().split()
            ):
                skip, deep = tag, 1
            elif tag == "a":
                in_link = not ends
            elif tag in BREAKS:
                parts.append(" ")
            continue
        flush()
        skip = ""
        if ends:
            if tag in BLOCKS and block == tag:
                block = ""
            if open_.get(tag):  # an end without a start is ignored
                seen = box
                while seen.tag != tag:
                    seen = seen.parent
                leave(seen.parent)
                block = ""
            continue
        in_link, block = False, ""
        name, mark, head, doubt = _name(tag, attrs)
        if (tag in CLOSES_ITSELF and box.tag == tag) or box.tag == "p":
            leave(box.parent)
        if tag in BLOCKS and not mark and tag not in ("td", "th", "li", "dd", "blockquote"):
            block = tag
        else:
            above = box.path
            if len(above) > LONG_PATH:
                above = f"/#{xxhash.xxh64_hexdigest(above.encode('utf-8', 'surrogatepass'))}"
            child = Box(box, tag, f"{above}/{name}", mark, doubt, head)
            child.article = box.article or (child if tag == "article" else None)
            box.items.append(child)
            open_[tag] = open_.get(tag, 0) + 1
            box, block = child, tag if tag in BLOCKS else ""
    if start < len(page) and not skip:
        parts.append(page[start:])
        if in_link:
            links += len(page) - start
    flush()
    _settle(root)
    return root


def _settle(root: Box) -> None:
    """Count the prose of every box, and take back marks that can't be right: of a box that holds the `main`, and, if no
    `main` or `article` with prose stands outside marked boxes, of one that holds an article or most of the page's prose
    (of a comment section and the like, nearly all). A mark in doubt is taken back from a box of prose."""
    order, stack = [], [(root, False)]
    clear = False
    under: list[bool] = []
    while stack:
        b, marked = stack.pop()
        marked = marked or b.furniture
        order.append(b)
        under.append(marked)
        stack += [(x, marked) for x in b.items if isinstance(x, Box)]
    mains: set[int] = set()
    articles: set[int] = set()
    for b, marked in zip(reversed(order), reversed(under)):
        b.prose += sum(max(0, len(x[1]) - 2 * x[2]) for x in b.items if not isinstance(x, Box))
        if b.tag in ("main", "article") and b.prose:
            (mains if b.tag == "main" else articles).add(id(b))
            clear = clear or not marked
        if b.parent:
            b.parent.prose += b.prose
            for found in (mains, articles):
                if id(b) in found:
                    found.add(id(b.parent))
    for b in order:
        if b.mark:
            share = b.prose / root.prose if root.prose else 0
            alone = not clear and (share > 0.95 or (b.mark == 1 and (share > 0.7 or id(b) in articles)))
            if id(b) in mains or alone or (b.doubt and b.prose >= PROSE):
                b.mark = 0


def _walk(box: Box) -> Iterator[Box]:
    stack = [box]
    while stack:
        b = stack.pop()
        if not b.furniture:
            yield b
            stack += [x for x in b.items if isinstance(x, Box)]


def candidates(root: Box) -> list[Box]:
    """Containers by falling score. Prose counts fully for its container, half for the one above; links count against."""
    for b in _walk(root):
        own = sum(max(0, len(t) - 2 * links) + 25 * t.count(",") for k, t, links in (x for x in b.items if not isinstance(x, Box)))
        up = b
        if b.tag in BLOCKS and b.parent:
            up = b.parent
        up.score += own
        if up.parent:
            up.parent.score += own / 2
    found = [b for b in _walk(root) if b.score > 0]
    return sorted(found, key=lambda b: (-b.score, b.path))


def blocks(box: Box) -> list[str]:
    """The blocks of a container in page order without furniture; of a header within it, the headings and leads stay."""
    return [t for _, t in _items(box)]


def _items(box: Box) -> list[tuple[str, str]]:
    """(kind, text) of blocks()."""
    out: list[tuple[str, str]] = []
    stack = [iter([box])]
    headings = [False]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            headings.pop()
        elif isinstance(x, Box):
            only = headings[-1] or (x.furniture and x.head)
            if x is box or not x.furniture or x.head:
                stack.append(iter(x.items))
                headings.append(only and x is not box)
        elif not headings[-1] or x[0] in ("h1", "h2") or _is_lead(x):
            out.append(x[:2])
    return out


def _is_lead(item: tuple[str, str, int]) -> bool:
    """Whether a paragraph of a header is a sentence of some length, not a byline, a date or links."""
    kind, text, links = item
    return kind == "p" and len(text) - 2 * links >= LEAD and text.rstrip("\"'\u201d\u2019\u00bb)")[-1:] in (".", "!", "?", "\u2026", "\u3002")


def _is_prose(box: Box) -> bool:
    """Whether a container holds more prose than links, furniture left out."""
    return sum(len(x[1]) - 2 * x[2] for b in _walk(box) for x in b.items if not isinstance(x, Box)) > 0


def _together(root: Box, parts: list[Box]) -> list[str]:
    """The blocks of the parts in page order, with what stands beside them in the least container above them all."""
    if parts[0] is root:
        return blocks(root)
    whole = {id(b): _items(b) for b in parts}
    holds: set[int] = set()
    for b in parts:
        x = b.parent
        while x and id(x) not in holds:
            holds.add(id(x))
            x = x.parent
    above = root
    while True:
        down = [x for x in above.items if isinstance(x, Box) and (id(x) in holds or id(x) in whole)]
        if len(down) > 1 or id(down[0]) in whole:
            break
        above = down[0]
    beside = above.tag not in PAGE and not any(b.tag == "article" for b in parts)
    untitled = not any(k in ("h1", "h2") for got in whole.values() for k, _ in got)
    out: list[str] = []
    stack = [iter(above.items)]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
        elif not isinstance(x, Box):
            if (beside and len(x[1]) > 2 * x[2]) or (untitled and x[0] in ("h1", "h2")):
                out.append(x[1])
        elif id(x) in whole:
            out += [t for _, t in whole[id(x)]]
        elif id(x) in holds:
            stack.append(iter(x.items))
        elif x.furniture and x.head:
            if above.tag not in PAGE and (beside or untitled):
                out += [t for k, t in _items(x) if k in ("h1", "h2")]
        elif beside and not x.furniture and _is_prose(x):
            out += blocks(x)
    return out


def extract(root: Box, ranked: list[Box], path: str | None) -> tuple[str, str]:
    """The text, its blocks joined by blank lines, and the path used.

    All containers of the path are taken, in page order. One that stands in an `article` stands for the whole outermost
    article. Others bring along the headings, prose and prose containers beside them, unless these are regions of the
    page, directly in its body. A text without a heading takes one that stands beside it.
    """
    best = next((b for b in ranked if b.path == path), ranked[0] if ranked else None)
    if not best:
        return "", ""
    parts: dict[int, Box] = {}
    for b in ranked:
        if b.path == best.path:
            whole = b.article or b
            parts[id(whole)] = whole
    return "\n\n".join(_together(root, list(parts.values()))), best.path


def host_of(url) -> F.Column:
    """The lower-case host of a URL column, or the empty string."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_paths(pages: DataFrame, url: str, page: str) -> DataFrame:
    """host, path: the winner of each host. A page gives all its containers shares of one vote; sums are rounded, and ties
    go to the path first in alphabetical order."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tally: dict[tuple[str, str], float] = {}
            for host, text in zip(b["host"], b["__page"]):
                top = candidates(parse(text or ""))
                total = sum(c.score for c in top)
                for c in top:
                    tally[host, c.path] = tally.get((host, c.path), 0.0) + c.score / total
            yield pd.DataFrame([(h, p, v) for (h, p), v in tally.items()], columns=["host", "path", "votes"])

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("__page"))
    sums = rows.mapInPandas(vote, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("v"))
    return sums.groupBy("host").agg(F.min_by("path", F.struct(-F.col("v"), "path")).alias("path"))


def main_text(pages: DataFrame, url: str, page: str, keep: list[str], broadcast_hosts: int = 200_000) -> DataFrame:
    """keep, text, path, consensus (whether the host's path was used). A null or empty page has empty text and path.
    A kept column named like an output is an error."""
    apart(keep, ["text", "path", "consensus"])
    winners = host_paths(pages, url, page).select(F.col("host").alias("__host"), F.col("path").alias("__path"))
    winners = small(cut(winners), broadcast_hosts)
    rows = pages.select(*keep, F.col(page).alias("__page"), host_of(F.col(url)).alias("__of"))
    rows = rows.join(winners, F.col("__of") == F.col("__host"), "left").drop("__of", "__host")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for text, path in zip(b["__page"], b["__path"]):
                root = parse(text or "")
                found, used = extract(root, candidates(root), path)
                got.append((found, used, bool(used) and used == path))
            out = b.drop(columns=["__page", "__path"]).reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(got, columns=["text", "path", "consensus"])], axis=1)

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema]
    return rows.mapInPandas(run, ", ".join([*own, "text string, path string, consensus boolean"]))
