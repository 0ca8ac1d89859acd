"""Main text of web pages by consensus host paths.

1. Every page scores its containers: characters of prose blocks below it, less those of link lists and page furniture.
   The best, deepest one votes for its generalised path of tags and classes (digits become ``#``).
2. Votes are summed by host and path in Spark; each host's path with the largest sum wins.
3. Every page is extracted again from the elements on its host's winning path, or from its own best container where it
   has no such element. Where more prose lies off that path than on it, and at least ``LONG_PROSE`` characters, the page
   is of another layout than its host's others: its own best container is taken, too.

Blocks are cut at block-level tags; character references are decoded, white space in a block becomes one space, and
blocks are joined by two line feeds. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out by tag, role, or the names in class and id. A name marks an element if it says nothing else
(``STRONG_WORDS``, or ``FURNITURE_WORDS`` with ``LAYOUT_WORDS`` only). A form, or a block that is marked by name, stays if it
holds ``MOST`` of the page's prose (reader comments apart), or the article or main element that holds over half of it. A name
that also says something else (search-results-study) only hints: such a block within a story or the winning path goes
only if it has no prose or half of it is links. Where nothing else is left, all such blocks are taken. Words after
has-, with-, no- and the like mark nothing. Names of ``CALLOUT_WORDS`` (alert, notice, banner) are those of boxes that
stories have, too: within a story they only hint. Reader comments are also known by their build: siblings of one step,
each with an author and a date and without a heading, beside at least ``LONG_PROSE`` characters of other prose.

Pages are read in one pass: tags by hand, so that unclosed quotes and comments cost no second look, elements as a list in
which parents come before children, so that sums and marks take one pass up and one down. Paths are written out for winners only.

Defined results: null or empty html gives an empty text; a null url is a host of its own (``''``); rows are independent
but for the vote, so repeated rows get equal texts; ties in the vote go to the greater path; other columns don't enter; an empty table gives
an empty result. Long pages are worked on whole. Only winners (one row a host) are joined to the pages; Spark broadcasts
them where they are small and else splits a hot host's pages over tasks.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_texts, read_table

#: Elements whose content is no text.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "annotation"}
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)\s*(/?)>")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s=>/]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_TO_END = re.compile(r"[^>]*")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "img", "wbr",
    "object", "param", "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mpadded", "mphantom", "merror", "semantics",
}
DROPPED_TAGS = {"nav", "header", "footer", "aside", "form", "head", "button", "dialog", "menu", "fieldset"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
#: Words that mark what is no main text wherever they begin a class or id name.
STRONG_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adbox", "adslot", "sponsor", "sponsored", "promo", "cookie", "cookies", "gdpr", "popup", "modal", "newsletter",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "masthead", "disqus", "pagination",
}
#: Words that do so where the rest of the name is of such words or of words of layout.
FURNITURE_WORDS = STRONG_WORDS | {
    "promotion", "banner", "consent", "notice", "alert", "overlay", "subscribe", "subscription", "signup", "nav", "menu", "aside", "footer", "header", "comment", "comments", "reply", "replies", "responses", "share",
    "sharing", "social", "related", "recommended", "widget", "widgets", "pager", "toolbar", "search", "login", "form", "copyright", "skip",
}
LAYOUT_WORDS = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "col", "column", "container", "content", "desktop", "feed", "fixed", "floating", "frame", "global",
    "group", "holder", "home", "icon", "icons", "inner", "item", "items", "large", "layout", "left", "link", "links", "list", "main", "mini", "mobile", "more", "outer", "page", "panel", "placement", "post",
    "posts", "primary", "right", "row", "secondary", "section", "side", "site", "slot", "small", "sticky", "stories", "tab", "tabs", "text", "thread", "title", "toggle", "top", "unit", "user", "wide", "wrap", "wrapper", "zone",
}
#: Furniture words that also name boxes within a story.
CALLOUT_WORDS = {"alert", "notice", "banner", "overlay", "aside", "header", "footer", "widget", "widgets", "form", "search", "toolbar", "menu", "nav"}
SOFT_TAGS = {"form", "fieldset"}
TALK_WORDS = {"comment", "comments", "disqus", "reply", "replies", "responses"}
#: Names of who wrote an entry, and when.
AUTHOR_WORDS = {"author", "avatar", "byline", "commenter", "nick", "nickname", "user", "username"}
DATE_WORDS = {"date", "datetime", "posted", "published", "time", "timestamp"}
AUTHOR, DATE, HEADING = 1, 2, 4
#: The rest of a name after these says what a page has or lacks, not what the element is.
MODIFIERS = {"has", "have", "with", "without", "no", "not", "hide", "hides"}
#: Before "header" these make it a story's own.
STORY_WORDS = {"article", "entry", "post", "story"}
MOST = 0.75
#: So many characters of prose are no small box of a page.
LONG_PROSE = 140
CONTAINERS = {"body", "article", "main", "section", "div", "td", "center"}
#: Tags that an opening tag of the key closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROOT = "body"


def _name_words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


def _mark(value: str, in_story: bool) -> tuple[int, bool]:
    """What the names of a class or id attribute say: 2 no main text, 1 perhaps none, 0 nothing; and whether readers talk there."""
    most, talk = 0, False
    for name in value.split():
        words = _name_words(name)
        found, other = [], False
        for k, word in enumerate(words):
            if word in MODIFIERS:
                break
            if word in FURNITURE_WORDS and not (word == "header" and (in_story or k and words[k - 1] in STORY_WORDS)):
                found.append(word)
            elif word not in LAYOUT_WORDS and len(word) > 1:
                other = True
        callout = bool(found) and CALLOUT_WORDS.issuperset(found)
        level = 0 if not found else 2 if words[0] in STRONG_WORDS or not (other or callout) else 1
        most, talk = max(most, level), talk or level == 2 and not TALK_WORDS.isdisjoint(found)
    return most, talk


class Node:
    """An element: where it stands, what its tag and names say, and what its blocks add up to."""

    __slots__ = ("bad", "chars", "depth", "dropped", "good", "in_story", "inside", "linked", "mark", "out", "parent", "path", "prose", "signs", "step", "story", "tag", "talk")

    def __init__(self, tag: str, step: str, parent: Node | None, path: int, dropped: bool = False, mark: int = 0, talk: bool = False):
        self.tag, self.step, self.parent, self.path, self.dropped, self.mark = tag, step, parent, path, dropped, mark
        self.talk = talk or parent is not None and parent.talk
        self.in_story = tag in ("article", "main") or parent is not None and parent.in_story
        self.depth = parent.depth + 1 if parent is not None else 0
        self.good, self.bad, self.prose, self.story, self.chars, self.linked = 0.0, 0.0, 0, 0, 0, 0
        self.signs = HEADING if tag in HEADINGS else DATE if tag == "time" else 0
        self.inside = self.out = False


def tags(page: str):
    """(start, end, closing, tag, attributes, self-closing) of each tag; the tag is '' for comments, declarations and skipped content."""
    at, n = 0, len(page)
    none_after = {'"': n, "'": n}  # from where on there is no such quote
    while (start := page.find("<", at)) >= 0:
        if (m := _PLAIN_TAG.match(page, start)) is not None:
            end, tag, attributes, closed = m.end(), m[2].lower(), {}, bool(m[3])
        elif (m := _TAG.match(page, start)) is not None:
            tag, attributes, end = m[2].lower(), {}, m.end()
            while True:
                end = _GAP.match(page, end).end()
                if end >= n or page[end] == ">":
                    break
                name = _NAME.match(page, end)
                end = name.end()
                value = ""
                if (equals := _EQUALS.match(page, end)) is not None:
                    end = equals.end()
                    quote = page[end : end + 1]
                    stop = page.find(quote, end + 1) if quote in none_after and end < none_after[quote] else -1
                    if stop >= 0:
                        value, end = page[end + 1 : stop], stop + 1
                    else:
                        if quote in none_after:
                            none_after[quote] = min(none_after[quote], end)
                        bare = (_TO_END if quote in none_after else _BARE).match(page, end)
                        value, end = bare[0], bare.end()
                attributes.setdefault(name[0].lower(), value)
            closed = page[end - 1] == "/"
            end += 1
            if end > n:  # the page ends in a tag
                yield start, n, False, "", {}, False
                return
        elif page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else n
            yield start, at, False, "", {}, False
            continue
        elif page[start + 1 : start + 2] in ("!", "?", "/"):
            stop = page.find(">", start)
            at = stop + 1 if stop >= 0 else n
            yield start, at, False, "", {}, False
            continue
        else:
            at = start + 1
            continue
        if tag in RAW and not m[1]:
            if not closed:
                stop = _ENDS[tag].search(page, end)
                end = stop.end() if stop else n
            tag = ""
        at = end
        yield start, end, bool(m[1]), tag, attributes, closed


class Page:
    """The elements of a page, parents first, and its blocks (element, text, share of links)."""

    def __init__(self, page: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes = [Node("#", ROOT, None, 0)]
        self.blocks: list[tuple[Node, str, float]] = []
        self._read(page)
        self._sum()
        self._find_talk()

    def _open(self, parent: Node, tag: str, attributes: dict[str, str]) -> Node:
        role = attributes.get("role", "").lower()
        mark, talk = 0, False
        for name in ("class", "id"):
            if attributes.get(name):
                level, said = _mark(attributes[name], parent.in_story)
                mark, talk = max(mark, level), talk or said
        classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
        inside = parent.tag not in ("#", "html", "body")
        dropped = (tag in DROPPED_TAGS - SOFT_TAGS and not (tag == "header" and inside)) or (role in DROPPED_ROLES and role != "form")
        if tag in ("body", "html", "article", "main"):
            mark, talk = 0, False
        if tag in INLINE:  # inline elements hold no blocks that could be judged later
            dropped, mark, talk = dropped or mark == 2 or role == "form", 0, False
        elif tag in SOFT_TAGS or role == "form":
            mark = 2
        step = ".".join([tag, *classes])
        key = (0, step) if tag in ("html", "body") or parent.tag in ("html", "#") else (parent.path, step)
        node = Node(tag, step, parent, self.paths.setdefault(key, len(self.paths) + 1), parent.dropped or dropped, mark, talk)
        for name in ("class", "itemprop", "rel"):
            words = _name_words(attributes[name]) if attributes.get(name) else ()
            node.signs |= (0 if AUTHOR_WORDS.isdisjoint(words) else AUTHOR) | (0 if DATE_WORDS.isdisjoint(words) else DATE)
        self.nodes.append(node)
        return node

    def path_of(self, node: Node) -> str:
        """The generalised path of an element."""
        steps = []
        while True:
            steps.append(node.step)
            if node.tag in ("#", "html", "body") or node.parent.tag in ("html", "#"):
                return ">".join(reversed(steps))
            node = node.parent

    def path_id(self, path: str) -> int | None:
        """The number of a generalised path on this page."""
        found: int | None = 0
        for step in path.split(">"):
            found = self.paths.get((found, step))
            if found is None:
                return None
        return found

    def _read(self, page: str) -> None:
        stack, text, linked, at = [self.nodes[0]], [], 0, 0
        open_tags: dict[str, int] = {}

        def pop() -> None:
            open_tags[stack.pop().tag] -= 1

        def flush() -> None:
            nonlocal text, linked
            joined = " ".join(entities.unescape("".join(text)).split()) if text else ""
            if joined:
                holder = next(node for node in reversed(stack) if node.tag not in INLINE)
                self.blocks.append((holder, joined, min(1.0, linked / len(joined))))
            text, linked = [], 0

        def add(raw: str) -> None:
            nonlocal linked
            if not stack[-1].dropped:
                text.append(raw)
                if any(n.tag == "a" for n in stack[-3:]):
                    linked += len(raw)

        for start, end, closing, tag, attributes, closed in tags(page):
            if start > at:
                add(page[at:start])
            at = end
            if not tag:
                continue
            if tag == "br" or tag == "hr" and not closing:
                text.append(" ")
                if tag == "br":
                    continue
            if tag not in INLINE:
                flush()
                if tag != "p" or not closing:
                    while len(stack) > 1 and stack[-1].tag in INLINE:
                        pop()
            if closing:
                if open_tags.get(tag):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == tag:
                            while len(stack) > k:
                                pop()
                            break
                        if tag in INLINE and stack[k].tag not in INLINE:
                            break
                continue
            if tag not in INLINE and stack[-1].tag == "p":
                pop()
            for k in range(len(stack) - 1, max(0, len(stack) - 6), -1):
                if stack[k].tag in CLOSES.get(tag, ()):
                    while len(stack) > k:
                        pop()
                    break
                if stack[k].tag in ("ul", "ol", "table", "dl"):
                    break
            if tag not in VOID and not closed:
                stack.append(self._open(stack[-1], tag, attributes))
                open_tags[tag] = open_tags.get(tag, 0) + 1
        if at < len(page):
            add(page[at:])
        flush()

    def _sum(self) -> None:
        """What is below each element: prose outside reader comments, the most prose of one story, characters and those in links."""
        for node in self.nodes:
            node.prose = node.story = node.chars = node.linked = 0
        for node, text, share in self.blocks:
            node.chars += len(text)
            node.linked += int(share * len(text))
            if not node.dropped and not node.talk and _is_prose(text, node.tag, share):
                node.prose += len(text)
        for node in reversed(self.nodes[1:]):
            up = node.parent
            up.prose, up.chars, up.linked = up.prose + node.prose, up.chars + node.chars, up.linked + node.linked
            up.story = max(up.story, node.story, node.prose if node.tag in ("article", "main") else 0)

    def _find_talk(self) -> None:
        """Mark reader comments by their build."""
        for node in reversed(self.nodes[1:]):
            node.parent.signs |= node.signs
        entries: dict[tuple[int, str], list[Node]] = {}
        for node in self.nodes[1:]:
            if node.signs == AUTHOR | DATE and node.prose and node.tag not in INLINE:
                entries.setdefault((node.parent.path, node.step), []).append(node)
        groups = [group for group in entries.values() if len(group) > 1 and self.nodes[0].prose - sum(n.prose for n in group) >= LONG_PROSE]
        if not groups:
            return
        for node in (n for group in groups for n in group):
            node.mark, node.talk = 2, True
        for node in self.nodes[1:]:
            node.talk = node.talk or node.parent.talk
        self._sum()

    def judge(self, path: str | None = None, keep_all: bool = False) -> None:
        """Mark what is out, given the winning path."""
        total, wanted = self.nodes[0].prose, self.path_id(path) if path else None
        for node in self.nodes[1:]:
            up = node.parent
            node.inside = up.inside or node.path == wanted
            furniture = False
            if node.mark and not keep_all and not node.dropped:
                if node.mark == 1 and (node.in_story or up.inside):
                    furniture = node.prose == 0 or 2 * node.linked >= node.chars
                else:
                    furniture = node.talk or not total or (node.prose < MOST * total and node.story * 2 <= total)
            node.out = up.out or node.dropped or furniture

    def best_container(self) -> tuple[Node, float]:
        """(element, score) of the container that holds the page's prose most closely; the innermost, then the first, of equals."""
        for node in self.nodes:
            node.good = node.bad = 0.0
        for node, text, share in self.blocks:
            if node.out and not node.dropped:
                continue  # furniture
            if not node.dropped and _is_prose(text, node.tag, share):
                node.good += len(text)
            else:
                node.bad += len(text)
        best, most = self.nodes[0], (0.0, 0)
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.good += node.good
                node.parent.bad += node.bad
            if node.tag in CONTAINERS and not node.dropped:
                score = node.good * (1.1 if node.tag in ("article", "main") else 1.0) - 2 * node.bad
                if score > 0 and (score, node.depth) >= most:
                    best, most = node, (score, node.depth)
        return best, most[0]

    def _with_own(self, found: list[int]) -> list[int]:
        """Blocks on the winning path, and those of the page's own best container where more prose lies off the path."""
        on, off = 0, 0
        for node, text, share in self.blocks:
            if not node.out and _is_prose(text, node.tag, share):
                on, off = (on + len(text), off) if node.inside else (on, off + len(text))
        if off < max(on, LONG_PROSE):
            return found
        self.judge(self.path_of(self.best_container()[0]))
        return sorted({*found, *(k for k, (node, _, _) in enumerate(self.blocks) if node.inside and not node.out)})

    def texts(self, path: str | None, keep_all: bool = False) -> list[str]:
        """Blocks of the elements on ``path``, or of the page's own best container, or all."""
        self.judge(path, keep_all)
        if path and path != ROOT:
            found = [k for k, (node, _, _) in enumerate(self.blocks) if node.inside and not node.out]
            if found:
                return [self.blocks[k][1] for k in self._with_own(found)]
        everything = [text for node, text, _ in self.blocks if not node.out]
        own = self.path_of(self.best_container()[0])
        if own != ROOT and path != ROOT:
            self.judge(own, keep_all)
            return [text for node, text, _ in self.blocks if node.inside and not node.out] or everything
        return everything


def _is_prose(text: str, tag: str, share: float) -> bool:
    return share < 0.5 and (tag in HEADINGS or len(text) >= 25 or text[-1:] in ".!?:;…")


def extract(page: str | None, path: str | None) -> str:
    """Main text of a page, given its host's winning path, if any."""
    if not page:
        return ""
    read = Page(page)
    return "\n\n".join(read.texts(path) or read.texts(None, keep_all=True))


def vote(page: str | None) -> tuple[str, float]:
    """The generalised path of a page's best container, and its score."""
    if not page:
        return ROOT, 0.0
    read = Page(page)
    read.judge()
    best, score = read.best_container()
    return read.path_of(best), score


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading ``www.``; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """Winning path of each host: rows (host, path)."""

    def run(table: pa.Table):
        found = [vote(h) for h in table.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([table.column("host").combine_chunks(), pa.array([p for p, _ in found]), pa.array([s for _, s in found], pa.float64())], ["host", "path", "score"])

    votes = map_texts(pages.select(host_of(F.col("url")).alias("host"), "html"), run, "host string, path string, score double", 100)
    sums = votes.where("score > 0").groupBy("host", "path").agg(F.sum(F.log1p("score")).alias("weight"))
    return sums.groupBy("host").agg(F.max_by("path", F.struct(F.round("weight", 6), "path")).alias("path"))


def extract_pages(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Rows (page_id, url, text), one for each page row."""
    with Scratch(pages.sparkSession, scratch) as own:
        winners = own.keep(host_paths(pages), "host-paths")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left").select("page_id", "url", "html", "path")

    def run(table: pa.Table):
        texts = [extract(h, p) for h, p in zip(table.column("html").to_pylist(), table.column("path").to_pylist(), strict=True)]
        yield table.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string())).combine_chunks().to_batches()[0]

    return map_texts(rows, run, pages.select("page_id", "url").schema.add("text", "string"), 100)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
