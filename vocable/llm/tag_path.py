"""Main-text extraction by tag-path ratios.

A page is cut into blocks; a block's tag path is the chain of block elements
from the root to it.  Per path, text length and punctuation are summed and
divided by the number of blocks on that path; the two ratios are smoothed along
the page, fused by multiplication and compared with a threshold taken from the
page itself.  Every block on a path above it is text; so are the other blocks
(titles, short lines, lists) of the article and main elements that hold at least
half of that text or, without them, of the common ancestor of all of it: all its
blocks, but where that is the whole page those between the first and the last
and the headings and paragraphs directly before.  Elements that are never content
(menus, forms, adverts, ...) are told by element name or role.  A class or id that
names such a thing as a whole (``comments``, ``cookie-notice``, ``sidebar-right``;
not ``search-algorithms``) lowers the fused ratio of the paths below it; those of
headings, paragraphs and inline elements, and ids of sections, which are made
from titles, say nothing.

Reader comments and lists of links to other pages go before that, told by structure:
repeated siblings that each carry an author or date and a reply link, or a name
or heading that speaks of comments together with such a sibling, a form, or short
blocks after the article's last heading; a name that speaks of related pages or
sharing on an element that is mostly links, or short.  A page that would have
nothing left (a forum thread) keeps its posts.

A page is one row and is handled alone: one pass, no shuffle, memory of one
small batch of pages.  The parser is linear in the page: an element knows its
depth, its block, its path and whether it lies in a link when it is made, open
elements are found by name, and what was looked for in vain is not looked for
again.

Edge cases: null or empty html, and pages without text, give an empty text;
broken markup is read on as text; repeated rows are handled each on its own; a
page of any length and any depth is read whole; an empty table gives an empty
result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocable.llm.textbytes import chunks

# Element names of HTML by role, and class words of boilerplate.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noframes", "xmp", "svg", "math"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr img br picture object audio video canvas".split())
NEVER = RAW | set("nav footer aside form button select option dialog menu head datalist fieldset input".split())
NEVER_ROLE = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NEVER_WORD = set("""ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies
consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login nav navbar navigation menu
menubar breadcrumb breadcrumbs sidebar aside widget footer masthead topbar toolbar comment comments respond disqus
share sharing social related recommended pagination pager skip copyright legal form search""".split())
#: Words that may stand beside one of those in a class.
LAYOUT_WORD = set("""area bar block body bottom box button buttons column container content global group header heading inner
item items left link links list module outer page panel right row site slot title top unit wrap wrapper""".split())
TITLED = set("h1 h2 h3 h4 h5 h6 p".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile("[\"'>]")
ATTR = re.compile(r"""([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCT = re.compile(r"[.,;:!?…。，、！？]")

# Words that speak of reader comments, of other pages, of replying, of who wrote and when.
THREAD_WORD = set("""comment comments commentlist commentarea commentsection disqus discussion discussions respond responses replies
reactions kommentar kommentare commentaire commentaires comentario comentarios""".split())
RELATED_WORD = set("""related recommended recommendations share sharing social promo sponsored trending popular similar newsletter
subscribe outbrain taboola""".split())
REPLY = set("reply answer respond report quote like permalink flag répondre antworten responder citer zitieren citar".split())
BYLINE_WORD = set("author byline user username avatar fn vcard date time timestamp posted meta poster".split())
THREAD_TITLE = re.compile(r"(?i)^\W*(?:\d+\s+)?(?:user |reader )?(?:comments?|responses?|replies|discussion|kommentare?|commentaires?|comentarios?|"
                          r"leave a (?:reply|comment)|join the discussion)\b.{0,40}$")
DATE = re.compile(r"(?i)\b(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}:\d\d|(?:\d+|an?) (?:second|minute|hour|day|week|month|year)s? ago|"
                  r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2},? \d{4})\b")
#: A block up to this length can be a byline; shorter ones on average are chatter.
BYLINE, CHATTER = 80, 300

#: Width of the smoothing (weights of the neighbours at distance 0, 1, 2), the
#: share of the page's mean fused ratio that a content path must reach.
SMOOTH, THRESHOLD = (0.4, 0.24, 0.06), 0.5
#: Factor of the fused ratio of paths below an element whose name says boilerplate.
LOWERED = 0.1


def boilerplate(key: str, token: str) -> bool:
    """Whether a class token or an id is the name of something that is not content."""
    words = set(WORDS.findall(CAMEL.sub(" ", token).lower()))
    rest = words - NEVER_WORD
    return len(rest) < len(words) and (not rest or (key == "class" and rest <= LAYOUT_WORD))


def _name_words(names: dict) -> set[str]:
    """The words of an element's class tokens and id, whole tokens without hyphens too."""
    text = f"{names.get('class', '')} {names.get('id', '')}"
    return set(WORDS.findall(CAMEL.sub(" ", text).lower()))


class Node:
    """An element; what it takes from its ancestors is settled when it is made."""

    __slots__ = ("tag", "parent", "pre", "last", "depth", "label", "never", "low", "inline", "link", "block", "outer", "path", "words")

    def __init__(self, tag: str, parent: "Node | None", attrs: str, tree: "Tree"):
        self.tag, self.parent, self.label = tag, parent, tag
        self.pre = self.last = len(tree.nodes)
        tree.nodes.append(self)
        self.inline = tag in INLINE
        self.never = (parent is not None and parent.never) or tag in NEVER
        self.low = parent is not None and parent.low
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or (parent is not None and parent.link)
        self.outer = parent.outer if parent else None        # the outermost article or main
        if tag == "header" and self.outer is None:
            self.never = True
        if self.outer is None and tag in ("article", "main"):
            self.outer = self
        self.words = frozenset()
        if "=" in attrs:
            names = {key.lower(): value.strip("\"'") for key, value in reversed(ATTR.findall(attrs))}
            self.words = _name_words(names)
            if tag not in ("html", "body", "article", "main"):
                tokens = names.get("class", "").split()
                self.never |= names.get("role", "").lower() in NEVER_ROLE
                if not self.inline and tag not in TITLED:
                    self.low |= any(boilerplate("class", t) for t in tokens)
                    if tag != "section" and "section" not in tokens:      # ids of sections are made from titles
                        self.low |= boilerplate("id", names.get("id", ""))
                if "class" in names:
                    self.label = f"{tag}.{names['class']}"
        # the block it lies in, itself if it is one, and a number for the chain of labels down to it
        self.block = parent.block if self.inline and parent else self
        above = parent.block.path if parent else -1
        self.path = above if self.inline else tree.paths.setdefault((above, self.label), len(tree.paths))


class Tree:
    """Elements in the order in which they open, and the numbers of tag paths."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.paths: dict[tuple[int, str], int] = {}

    def close(self) -> None:
        """Give each element the last one below it."""
        for n in reversed(self.nodes):
            if n.parent is not None and n.last > n.parent.last:
                n.parent.last = n.last


class Block:
    __slots__ = ("node", "text", "n", "linked", "punct")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.n = node, text, len(text)
        self.linked, self.punct = linked, len(PUNCT.findall(text))

    def links(self) -> bool:
        """Mostly links, and not a paragraph or heading."""
        return self.linked >= 0.9 * max(1, len(self.text.replace(" ", ""))) and self.node.tag not in TITLED


class Scanner:
    """Ends of tags; remembers what the rest of the page does not hold."""

    def __init__(self, page: str):
        self.page = page
        self.open_end = False                    # no ">" from here on
        self.failed: set[int] = set()            # places outside quotes from which no tag ends
        self.unclosed: set[str] = set()          # raw elements without an end tag from here on

    def tag_end(self, at: int) -> int:
        """Place of the ">" that ends a tag whose attributes start at ``at``: outside quotes, else the first; -1 if none."""
        page, first, trace, i = self.page, self.page.find(">", at), [], at
        if first < 0:
            return -1
        while i not in self.failed:
            trace.append(i)
            m = QUOTE_OR_END.search(page, i)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            i = page.find(m[0], m.end()) + 1
            if not i:
                break
        self.failed.update(trace)
        return first

    def raw_end(self, tag: str, at: int) -> int:
        """Place after the end tag of a raw element, -1 if there is none."""
        if tag in self.unclosed:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.page, at)
        if m is None:
            self.unclosed.add(tag)
        return m.end() if m else -1


def parse(page: str) -> tuple[Tree, list[Block]]:
    """The elements of a page and its text blocks in order, without those of never-content elements."""
    tree, scan = Tree(), Scanner(page)
    top = Node("", None, "", tree)
    opened: dict[str, list[Node]] = defaultdict(list)       # open elements by name
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def close_block():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not top.block.never:
                out.append(Block(top.block, text, linked))
            parts.clear()
        linked = 0

    def text_until(stop: int):
        nonlocal linked
        if stop > at and not top.never:
            parts.append(page[at:stop])
            if top.link:
                linked += len("".join(page[at:stop].split()))

    def leave(node: Node):
        """Close everything down to ``node`` and itself."""
        nonlocal top
        while True:
            gone = top
            opened[gone.tag].pop()
            top = gone.parent
            if gone is node:
                return

    def enter(tag: str, attrs: str):
        nonlocal top
        top = Node(tag, top, attrs, tree)
        opened[tag].append(top)

    at, look = 0, 0                              # text starts, the next "<" is looked for
    while True:
        start = page.find("<", look)
        if start < 0 or scan.open_end:
            break
        if page.startswith("<!--", start):
            text_until(start)
            end = page.find("-->", start + 4)
            at = look = end + 3 if end >= 0 else len(page)
            continue
        m = NAME.match(page, start)
        if m is None:
            if page[start + 1:start + 2] in ("!", "?"):
                end = page.find(">", start)
                if end < 0:
                    break
                text_until(start)
                at = look = end + 1
            else:
                look = start + 1
            continue
        end = scan.tag_end(m.end())
        if end < 0:                              # no tag can end from here on
            scan.open_end = True
            break
        text_until(start)
        closing, tag, attrs = m[1], m[2].lower(), page[m.end():end]
        at = look = end + 1
        if closing:
            if not opened[tag]:
                continue
            node = opened[tag][-1]
            if tag not in INLINE:
                close_block()
            elif top.block.depth > node.depth:
                continue                         # an inline end tag does not close blocks
            leave(node)
        elif tag == "br":
            if not top.never:
                parts.append(" ")
        elif tag in VOID:
            if tag not in INLINE:
                close_block()
        elif tag in RAW:
            end = scan.raw_end(tag, at)
            if end >= 0 or tag not in ("svg", "math"):
                at = look = end if end >= 0 else len(page)
        elif tag in INLINE:
            if not attrs.rstrip().endswith("/"):
                enter(tag, attrs)
        else:
            close_block()
            closes = SAME_CLOSES.get(tag, {"p"})
            while top.parent is not None and (top.inline or top.tag in closes or top.tag == "p"):
                leave(top)                       # an open paragraph, item or inline element ends here
            enter(tag, attrs)
    text_until(len(page))
    close_block()
    tree.close()
    return tree, out


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order, without those of never-content elements."""
    return parse(page)[1]


def _inside(node: Node, of: Node) -> bool:
    return of.pre <= node.pre <= of.last


def chatter(tree: Tree, bl: list[Block]) -> list[Node]:
    """Elements that hold reader comments, links to other pages or share buttons."""
    n = len(tree.nodes)
    size, linked, count = [0] * n, [0] * n, [0] * n
    said, byline, named = [False] * n, [False] * n, [False] * n
    for b in bl:
        k = b.node.pre
        size[k] += b.n
        linked[k] += b.linked
        count[k] += 1
        words = set(b.text.lower().split()) if b.n <= BYLINE else ()
        if words and (b.n <= 24 or b.linked) and any(w.strip(".,:;·|()↩") in REPLY for w in words):
            said[k] = True
        if b.n <= BYLINE and DATE.search(b.text):
            byline[k] = True
    headings = [b for b in bl if b.node.tag in TITLED and b.node.tag != "p"]
    for node in tree.nodes:
        named[node.pre] = bool(node.words & THREAD_WORD)
        if node.words & BYLINE_WORD or node.tag == "time":
            byline[node.block.pre] = True
        if node.link and node.words & REPLY:
            said[node.block.pre] = True
    forms = [x.pre for x in tree.nodes if x.tag in ("form", "textarea")]
    for node in reversed(tree.nodes):            # from the leaves up
        p = node.parent
        if p is not None:
            size[p.pre] += size[node.pre]
            linked[p.pre] += linked[node.pre]
            count[p.pre] += count[node.pre]
            said[p.pre] |= said[node.pre]
            byline[p.pre] |= byline[node.pre]
    # siblings of one label that each have an author or date and a reply link
    posts: dict[tuple[int, str], list[Node]] = defaultdict(list)
    for node in tree.nodes:
        if not node.inline and node.parent is not None and node.tag not in ("html", "body", "main", "head") and said[node.pre] and byline[node.pre]:
            posts[node.parent.pre, node.label].append(node)
    out = []
    for (_, _), same in posts.items():
        if len(same) > 1:
            out += same
        elif named[same[0].pre] or named[same[0].parent.pre]:
            out += same
    titles = [b.node.pre for b in headings if THREAD_TITLE.match(b.text)]
    last = max((b.node.pre for b in headings if not THREAD_TITLE.match(b.text)), default=-1)
    post_at = sorted(x.pre for same in posts.values() for x in same)
    for node in tree.nodes:
        if node.inline or node.never or node.tag in ("html", "body", "main") or not size[node.pre]:
            continue
        short = size[node.pre] < CHATTER * count[node.pre]
        if named[node.pre] and node.tag not in TITLED:
            few = [_first_in(x, node) for x in (titles, post_at, forms)]
            repeated = any(few)
            if repeated or (short and node.pre > last >= 0 and count[node.pre] > 1):
                out.append(node)
        elif node.words & RELATED_WORD and size[node.pre] <= CHATTER * max(2, count[node.pre]):
            mostly = linked[node.pre] >= 0.5 * max(1, size[node.pre])
            if mostly or (size[node.pre] <= BYLINE and (linked[node.pre] or node.words & {"share", "sharing", "social"})):
                out.append(node)
    return out


def _first_in(at: list[int], node: Node) -> bool:
    """Whether one of the sorted places lies inside the element."""
    k = bisect.bisect_left(at, node.pre)
    return k < len(at) and at[k] <= node.last


def without_chatter(tree: Tree, bl: list[Block]) -> list[Block]:
    """The blocks outside of what :func:`chatter` names, and outside of headings that announce it;
    all of them where no sentence would be left."""
    edge = [0] * (len(tree.nodes) + 1)
    for node in chatter(tree, bl):
        edge[node.pre] += 1
        edge[node.last + 1] -= 1
    covered = list(itertools.accumulate(edge))
    gone = [covered[b.node.pre] > 0 for b in bl]
    if not any(gone):
        return bl
    for i in range(len(bl) - 1):                 # "3 comments" directly before them
        if gone[i + 1] and bl[i].node.tag in TITLED and THREAD_TITLE.match(bl[i].text):
            gone[i] = True
    left = [b for b, g in zip(bl, gone) if not g]
    return left if any(b.n > BYLINE and not b.links() for b in left) else bl


def _smooth(x: list[float]) -> list[float]:
    n = len(x)
    out = []
    for i in range(n):
        total = weight = 0.0
        for d in range(-2, 3):
            if 0 <= i + d < n:
                total += SMOOTH[abs(d)] * x[i + d]
                weight += SMOOTH[abs(d)]
        out.append(total / weight)
    return out


def content(bl: list[Block]) -> list[Block]:
    """The blocks on paths chosen by fused tag-path ratios, and what lies between them."""
    if not bl:
        return []
    paths = [(b.node.path, b.node.low) for b in bl]         # an id is no part of the path
    length, punct, linked, count = (defaultdict(float) for _ in range(4))
    for p, b in zip(paths, bl):
        length[p] += b.n
        punct[p] += b.punct
        linked[p] += b.linked
        count[p] += 1
    ratio = _smooth([length[p] / count[p] * (1 - min(1.0, linked[p] / max(1.0, length[p]))) for p in paths])
    dots = _smooth([punct[p] / count[p] for p in paths])
    fused = [r * (1 + d) * (LOWERED if b.node.low else 1) for r, d, b in zip(ratio, dots, bl)]
    per_path = defaultdict(list)
    for p, f in zip(paths, fused):
        per_path[p].append(f)
    limit = THRESHOLD * sum(fused) / len(fused)
    chosen = {p for p, f in per_path.items() if sum(f) / len(f) >= limit}
    picked = [i for i, p in enumerate(paths) if p in chosen]
    # the outermost article and main elements, where they hold half of what is chosen, else the common ancestor
    named = sum(bl[i].n for i in picked if bl[i].node.outer) >= 0.5 * sum(bl[i].n for i in picked)
    low, high = (f((bl[i].node for i in picked), key=lambda n: n.pre) for f in (min, max))
    common = low                                 # of all that is chosen: that of the first and the last to open
    while not _inside(high, common):
        common = common.parent
    while common.tag in TITLED or common.tag in ("li", "blockquote", "pre"):
        common = common.parent
    wide = common.tag in ("", "html", "body")
    first, last = picked[0], picked[-1]
    while first and bl[first - 1].node.tag in TITLED and not bl[first - 1].node.low:
        first -= 1                    # title and lead directly before the text
    hold = {bl[i].node.outer.pre for i in picked if bl[i].node.outer}
    out = []
    for i, (p, b) in enumerate(zip(paths, bl)):
        if named:
            inside = b.node.outer is not None and b.node.outer.pre in hold
        else:
            inside = _inside(b.node, common) and (first <= i <= last or not wide) and not b.links()
        if p in chosen or (inside and not b.node.low):
            out.append(b)
    return out


def extract(page: str | None) -> str:
    return "\n".join(b.text for b in content(without_chatter(*parse(page or ""))))


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html", 4 << 20):
            texts = [extract(x) for x in part.column(part.schema.get_field_index("html")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("page_id")), part.column(part.schema.get_field_index("url")),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html"))
    schema = (f"page_id {p.schema['page_id'].dataType.simpleString()}, url {p.schema['url'].dataType.simpleString()}, "
              "text string, n_chars long")
    return p.mapInArrow(_extractor, schema)
