"""Main text of web pages by consensus host paths.

A page's elements are named by generalised paths (tag, and class or id with digits as #). Every page scores its containers:
a block of text gives its length, without link text, to its parent and half of it to the one above; inside an article, or else a main
element, the outermost one counts as its parent. From the best one a page climbs to an ancestor, as long as what that adds is text
and not mostly links (never out of a main element, or of an article without one). Each page votes for the path that it reaches; votes are added up by host in Spark (one row a page, summed before the shuffle), and
each host's path with most votes wins. All pages are then extracted again at their host's path; a page that
lacks it, or has no text there, uses its own path.

Left out at any depth: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments and hidden
elements, known by tag, role, or a word of a class or id name, unless the name says that something is there or not (has-sidebar, no-header). An element that only its name speaks against stays if it holds an article or main element, or most of the
page's text outside links, unless the name is that of comments or adverts. White space inside a block becomes one space, and blocks are
joined by a line feed in page order.

Defined results: null or empty html, or none with text, gives an empty text; pages without url share one (empty) host;
repeated rows are kept; an empty table gives an empty result; long, deep or broken pages are read whole in time that grows with their length
(after BROKEN_QUOTES tags without a closing quote, quotes in tags no longer hide a >). Only the three named columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidgraph.llm.common import map_batches, materialize

_tag = re.compile(r"/?[A-Za-z][^\s/>]*")
#: A tag without < or > in its quotes: looked at no further than the next of these.
_plain_tag = re.compile(r"""<(/?)([A-Za-z][^\s/<>"']*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*)>""")
_quote = re.compile("[\"']")
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_digits = re.compile(r"\d+")
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_invisible = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Tags with an unclosed quote in one page before quotes no longer count; characters from which a named element can be most of a page.
BROKEN_QUOTES, MOST = 8, 250
#: Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article blockquote body center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody tfoot thead tr ul caption".split())
OUT_TAGS = frozenset("head nav header footer aside form button select option label menu dialog object canvas audio video svg math".split()) | RAW
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
OUT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar aside footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs comment comments disqus replies widget login search toolbar pagination pager".split())
#: Of these, only adverts and comments are left out by class.
MAIN_TAGS, MAIN_OUT = frozenset(("html", "body", "main", "article")), frozenset(("ad", "ads", "advert", "comment", "comments"))
#: Names that stand even for most of a page's text; words that say that another one is there, or not.
ALWAYS_OUT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments disqus replies cookie cookies consent gdpr".split())
ABOUT = frozenset("no not non has have with without hide hides show shows is toggle".split())
#: These may be left out in a page, and so don't count in paths.
ROOTS = frozenset(("html", "body"))
#: Starting an element ends open ones of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


#: How an element stands: part of the page, left out if nothing speaks for it, or left out.
PART, DOUBTFUL, OUT = 0, 1, 2


class Element:
    __slots__ = ("children", "out", "parent", "step", "tag")

    def __init__(self, tag: str, parent: Element | None, step: str, out: int):
        self.tag, self.parent, self.step, self.out, self.children = tag, parent, step, out, []

    @property
    def path(self) -> str:
        steps, node = [], self
        while node:
            if node.step:
                steps.append(node.step)
            node = node.parent
        return "".join(f"/{x}" for x in reversed(steps))


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in reversed(_attribute.findall(text))} if text.strip(" /") else {}


def _name(tag: str, attributes: dict[str, str]) -> str:
    """A path's step: tag.class, or tag#id, digits as #."""
    for key, mark in (("class", "."), ("id", "#")):
        if words := sorted(set(_digits.sub("#", attributes.get(key, "").lower()).replace("/", "|").split())):
            return f"{tag}{mark}{'.'.join(words)}"
    return tag


def _speaks_against(name: str, words: frozenset[str]) -> set[str]:
    """Words of a class or id name that leave its element out."""
    parts = {x.lower() for x in _word.findall(name)} | {name.lower()}
    return parts & words if not parts & ABOUT else set()


def _left_out(tag: str, attributes: dict[str, str]) -> int:
    if tag in OUT_TAGS:
        return OUT
    if not attributes:
        return PART
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in OUT_ROLES:
        return OUT
    if _invisible.search(attributes.get("style", "")):
        return OUT
    against: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        against |= _speaks_against(name, MAIN_OUT if tag in MAIN_TAGS else OUT_WORDS)
    return (OUT if against & ALWAYS_OUT else DOUBTFUL) if against else PART


class Tags:
    """Where the tags of a page start and end, in one pass: (start, end, slash, name, attributes); without a name: to be skipped."""

    def __init__(self, source: str):
        self.source, self.broken, self.known = source, 0, {}

    def _after(self, what: str, at: int) -> int:
        """The next place of a short string, or -1; what the last search went over isn't searched again."""
        since, found = self.known.get(what, (at + 1, 0))
        if since <= at and (found < 0 or at <= found):
            return found
        found = self.source.find(what, at)
        self.known[what] = at, found
        return found

    def _end(self, at: int) -> int:
        """The > that ends a tag: the first outside quotes, or simply the first if a quote is never closed."""
        first = close = self._after(">", at)
        if self.broken >= BROKEN_QUOTES:
            return first
        while close >= 0:
            opening = _quote.search(self.source, at, close)
            if not opening:
                return close
            closing = self._after(opening[0], opening.end())
            if closing < 0:
                break
            at = closing + 1
            close = close if close >= at else self._after(">", at)
        self.broken += 1
        return first

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        source = self.source
        while (start := self._after("<", at)) >= 0:
            if m := _plain_tag.match(source, start):
                return start, m.end(), m[1] == "/", m[2].lower(), m[3]
            if source.startswith("<!--", start):
                end = self._after("-->", start + 4)
                return start, end + 3 if end >= 0 else len(source), False, "", ""
            end = self._after(">", start)
            if end < 0:
                return None
            if source[start + 1] in "!?":
                return start, end + 1, False, "", ""
            if m := _tag.match(source, start + 1):
                end = self._end(m.end())
                slash = m[0][0] == "/"
                return start, end + 1, slash, m[0][slash:].lower(), source[m.end() : end]
            at = start + 1
        return None


_raw_end = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def parse(source: str) -> Element:
    """A tree of elements; children are elements and texts (already decoded)."""
    root = Element("", None, "", PART)
    stack, open_at = [root], {}
    at, tags, ended = 0, Tags(source), set()

    def text(part: str) -> None:
        if part and stack[-1].out != OUT:
            stack[-1].children.append(html.unescape(part))

    def last(names) -> int:
        return max((open_at[t][-1] for t in names if open_at.get(t)), default=0)

    def close(names, scope=()) -> bool:
        """Close the innermost open element of these tags, unless one of the scope is open inside it."""
        found = last(names)
        if found <= last(scope):
            return False
        for gone in stack[found:]:
            open_at[gone.tag].pop()
        del stack[found:]
        return True

    while token := tags.next(at):
        start, end, slash, tag, inner = token
        text(source[at:start])
        at = end
        if not tag:
            continue
        if slash:
            if tag == "br":
                text(" ")
            else:
                close((tag,))
            continue
        if tag in RAW:
            stop = None if tag in ended else _raw_end[tag].search(source, at)
            if stop is None:
                ended.add(tag)
            at = stop.end() if stop else len(source)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag in BLOCKS and stack[-1].out != OUT:
                stack[-1].children.append(Element(tag, stack[-1], "", PART))
            continue
        if not (tag in ENDS and close(ENDS[tag], SCOPES[tag])) and (tag in BLOCKS or tag in OUT_TAGS):
            close(("p",), ("td", "th", "button", "object"))
        attributes, node = _attributes(inner), stack[-1]
        child = Element(tag, node, "" if tag in ROOTS else _name(tag, attributes), OUT if node.out == OUT else _left_out(tag, attributes))
        if child.out != OUT:
            node.children.append(child)
        if not inner.endswith("/") or tag not in ("path", "use", "circle", "rect"):
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(child)
    text(source[at:])
    _settle(root)
    return root


def _settle(root: Element) -> None:
    """Takes doubtful elements out, or makes them part of the page."""
    order, doubtful = _down(root), False
    for node, _ in order:
        doubtful = doubtful or node.out == DOUBTFUL
    if not doubtful:
        return
    plain: dict[int, int] = {}
    holds: set[int] = set()
    for node, link in reversed(order):
        below = [x for x in node.children if not isinstance(x, str)]
        plain[id(node)] = sum(plain[id(x)] for x in below) + (0 if link else sum(len(x.strip()) for x in node.children if isinstance(x, str)))
        if node.tag in ("article", "main") or any(id(x) in holds for x in below):
            holds.add(id(node))
    for node, _ in order:
        if any(not isinstance(x, str) and x.out == DOUBTFUL for x in node.children):
            kept = []
            for x in node.children:
                if not isinstance(x, str) and x.out == DOUBTFUL:
                    if not (id(x) in holds or plain[id(x)] >= MOST and 2 * plain[id(x)] > plain[id(root)]):
                        continue
                    x.out = PART
                kept.append(x)
            node.children = kept


def _down(root: Element) -> list[tuple[Element, bool]]:
    """All elements, parents first, and whether they are inside a link."""
    order, work = [], [(root, False)]
    while work:
        node, link = work.pop()
        link = link or node.tag == "a"
        order.append((node, link))
        work += [(x, link) for x in node.children if not isinstance(x, str)]
    return order


def blocks(node: Element) -> list[str]:
    """The texts of a subtree's blocks, in page order."""
    done, parts = [], []

    def end():
        if joined := " ".join("".join(parts).split()):
            done.append(joined)
        parts.clear()

    work: list = [node]  # no recursion: pages may nest deeply
    while work:
        x = work.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag in BLOCKS:
            end()
            work += [None, *reversed(x.children)]
        else:
            if x.tag in ("td", "th"):
                parts.append(" ")
            work += reversed(x.children)
    end()
    return done


def best_container(root: Element) -> tuple[Element, float]:
    """The container with the most text of its own blocks, and its score."""
    score: Counter[int] = Counter()
    seen: dict[int, Element] = {}
    work = [(root, root, False, None)]
    while work:
        node, block, link, whole = work.pop()
        link = link or node.tag == "a"
        if node.tag == "article" and (whole is None or whole.tag == "main") or node.tag == "main" and whole is None:
            whole = node
        if node.tag in BLOCKS:
            block = node
        for child in node.children:
            if isinstance(child, str):
                if not link and (size := len(child.strip())):
                    #: Text right inside a container counts for it; text of a paragraph counts for what holds the paragraph.
                    holder = whole or (block if block.tag in ("div", "section", "article", "main", "body", "td", "") else block.parent or root)
                    for share in (1.0, 0.5):
                        score[id(holder)] += size * share
                        seen[id(holder)] = holder
                        if not holder.parent:
                            break
                        holder = holder.parent
            else:
                work.append((child, block, link, whole))
    if not score:
        return root, 0.0
    top = max(score.values())
    return next(seen[k] for k, v in score.items() if v == top), top


def amounts(root: Element) -> dict[int, tuple[int, int]]:
    """Characters of text, and those outside links, in each element's subtree."""
    total: dict[int, tuple[int, int]] = {}
    for node, link in reversed(_down(root)):
        own = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        below = [total[id(x)] for x in node.children if not isinstance(x, str)]
        total[id(node)] = own + sum(x[0] for x in below), (0 if link else own) + sum(x[1] for x in below)
    return total


def main_container(root: Element) -> tuple[Element, float]:
    """The best container or the highest ancestor that adds text to it and not mostly links, and the best one's score."""
    best, score = best_container(root)
    above, node = [], best
    while node.parent:
        node = node.parent
        above.append(node)
    kinds = [x.tag for x in [best, *above]]
    if "main" in kinds:
        above = above[: kinds.index("main")]
    elif "article" in kinds:
        above = above[: len(kinds) - 1 - kinds[::-1].index("article")]
    if not above:
        return best, score
    total = amounts(root)
    text, plain = total[id(best)]
    chosen, most = best, 0
    for node in above:
        more, bare = total[id(node)][0] - text, total[id(node)][1] - plain
        if more > most and 3 * bare >= 2 * more:
            chosen, most = node, more
    return chosen, score


def raised(nodes: list[Element]) -> list[Element]:
    """The outermost article around each element, or else main element, or itself; each once."""
    known: dict[int, Element | None] = {}
    out: dict[int, Element] = {}
    for node in nodes:
        way, x = [], node
        while x and id(x) not in known:
            way.append(x)
            x = x.parent
        found = known[id(x)] if x else None
        for x in reversed(way):  # from the outside in: the first article stays, a main element only without one around or inside
            if x.tag == "article" and (found is None or found.tag == "main") or x.tag == "main" and found is None:
                found = x
            known[id(x)] = found
        whole = known[id(node)] or node
        out[id(whole)] = whole
    return list(out.values())


def at_path(root: Element, path: str) -> list[Element]:
    """Outermost elements of a path, in page order."""
    steps = path.split("/")[1:]
    found, work = [], [(root, 0)]
    while work:
        node, at = work.pop()
        if node.step:
            if at == len(steps) or node.step != steps[at]:
                continue
            at += 1
        if at == len(steps) and node.step:
            found.append(node)
        else:
            work += [(x, at) for x in reversed(node.children) if not isinstance(x, str)]
    return found


def extract(source: str | None, path: str | None) -> str:
    """Main text at the host's path, else at the page's own."""
    if not source:
        return ""
    root = parse(source)
    found = texts_at(root, path) if path else []
    if not found:
        node, _ = main_container(root)
        found = texts_at(root, path) if (path := node.path) else blocks(node)
    return "\n".join(found)


def texts_at(root: Element, path: str) -> list[str]:
    """Blocks of the elements of a path, or of the articles around them, each once."""
    return [b for x in raised(at_path(root, path)) for b in blocks(x)]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


def host_paths(spark: SparkSession, pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path): the path that most pages of a host voted for (ties: the higher score, then the path's order)."""

    def vote(batch):
        votes: Counter[tuple[str, str]] = Counter()
        scores: Counter[tuple[str, str]] = Counter()
        for u, h in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if page := h.as_py():
                node, score = main_container(parse(page))
                votes[host_of(u), node.path] += 1
                scores[host_of(u), node.path] += round(score)
        return {"host": [k[0] for k in votes], "path": [k[1] for k in votes], "votes": list(votes.values()), "score": [scores[k] for k in votes]}

    votes = map_batches(pages.select(url, source), vote, "host string, path string, votes long, score long")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    best = summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))
    return materialize(spark, best, "host-paths")


def extract_pages(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    named = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    paths = host_paths(spark, named)

    def with_host(batch):
        return {"page_id": batch.column(0), "url": batch.column(1), "html": batch.column(2), "host": [host_of(u) for u in batch.column(1).to_pylist()]}

    def again(batch):
        for low in range(0, batch.num_rows, 256):
            few = batch.slice(low, 256)
            texts = [extract(h.as_py(), p) for h, p in zip(few.column(2), few.column(3).to_pylist(), strict=True)]
            yield {"page_id": few.column(0), "url": few.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    hosted = map_batches(named.select(F.col("page_id").cast("long"), "url", "html"), with_host, "page_id long, url string, html string, host string")
    joined = hosted.join(paths, "host", "left").select("page_id", "url", "html", "path")
    return map_batches(joined, again, "page_id long, url string, text string, n_chars long")
