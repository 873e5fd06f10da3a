"""Main text of web pages by scoring the element tree.

Paragraphs pass points for length and commas to the elements above them, less the higher they stand; an element's points
are discounted by the share of its text that is links. The best container, or the article or main part that encloses it, is kept with its
related siblings and with the headings, paragraphs, lists and sections beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd div section article main".split())
NO_TEXT = frozenset("head title script style noscript template svg math iframe object canvas audio video select textarea button input datalist".split())
PAGE_PARTS = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
# Parts of a page that such a word names wherever it stands in a class name, and those that it names as the last word.
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "menu nav navbar navigation newsletter recommended related replies respond share sharing sidebar sponsor sponsored subscribe".split()
)
LAST_WORDS = frozenset("banner login masthead modal notice notices pager pagination popup promo promotion reply rss signup social toolbar widget".split())
MODIFIERS = frozenset("has is js no with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BESIDE = frozenset("blockquote dl figure hgroup ol p pre table ul".split()) | HEADINGS
CONTENT_WORDS = frozenset("article body content entry main page post story text".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot menu select body html".split())
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Share of the best score from which a sibling is kept, and link share from which a block counts as links.
SIBLING, LINKS = 0.2, 0.5


def names_of(attrs: dict) -> list[list[str]]:
    """The words of each class name and of the id."""
    given = [*attrs.get("class", "").split(), attrs.get("id", "")]
    return [words for name in given if (words := NAME.findall(CAMEL.sub(" ", name).lower()))]


def stands_aside(names: list[list[str]]) -> bool:
    """Whether a name says so: ``post-comments`` and ``comments-content`` are comments, ``has-sidebar`` is no sidebar."""
    return any(words[0] not in MODIFIERS and (not STRONG_WORDS.isdisjoint(words) or words[-1] in LAST_WORDS) for words in names)


class Node:
    __slots__ = ("name", "words", "parent", "inside", "aside", "score", "chars", "linked")

    def __init__(self, name: str, words: frozenset, parent: Node | None, aside: bool) -> None:
        self.name, self.words, self.parent, self.aside = name, words, parent, aside
        self.inside: list = []  # nodes, and (text, in a link) pairs
        self.score = 0.0
        self.chars = self.linked = 0


class TreeBuilder(HTMLParser):
    """A forgiving tree: open paragraphs end at blocks, list items at their like, stray end tags are passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", frozenset(), None, False)
        self.links = 0

    def handle_starttag(self, name: str, attrs: list) -> None:
        if name in BLOCK:
            self._end_open({"p"}, BLOCK - {"p"})
        if name in CLOSED_BY:
            self._end_open(CLOSED_BY[name], SCOPES)
        if name in ("html", "body") and self.at is not self.root:
            return
        found = {k: v or "" for k, v in attrs}
        names = names_of(found) if "class" in found or "id" in found else []
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool("style" in found and HIDDEN.search(found["style"].lower()))
        role = found.get("role", "").lower() in ROLES
        if name in ("html", "body", "main"):
            aside = "hidden" in found or name == "main" and role
        else:
            aside = hidden or role or name in NO_TEXT or name in PAGE_PARTS or stands_aside(names)
            # A page's header stands aside, that of its article has the headline.
            heads = name == "header" or any(words[-1] == "header" and words[0] not in MODIFIERS for words in names)
            aside = aside or heads and name not in HEADINGS and not self._within("article", "main")
        words = frozenset(w for part in names for w in part)
        if name == "br":
            self.at.inside.append((" ", False))
        if name in VOID:
            return
        node = Node(name, words, self.at, aside)
        self.at.inside.append(node)
        self.at = node
        self.links += name == "a"

    def handle_startendtag(self, name: str, attrs: list) -> None:
        self.handle_starttag(name, attrs)
        if name in ("svg", "math"):
            self.handle_endtag(name)

    def handle_endtag(self, name: str) -> None:
        if name in VOID:
            return
        if name in BLOCK and name != "p":
            self._end_open({name}, frozenset())
        else:
            self._end_open({name}, BLOCK)

    def handle_data(self, data: str) -> None:
        self.at.inside.append((data, self.links > 0))

    def _within(self, *names: str) -> bool:
        node = self.at
        while node is not None:
            if node.name in names:
                return True
            node = node.parent
        return False

    def _end_open(self, names: set, barrier: frozenset) -> None:
        node = self.at
        while node is not self.root:
            if node.name in names:
                while self.at is not node.parent:
                    self.links -= self.at.name == "a"
                    self.at = self.at.parent
                return
            if node.name in barrier:
                return
            node = node.parent


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, characters in links) in page order, without what stands aside; walks without recursion."""
    found, parts, linked = [], [], 0
    owner = top

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            found.append((owner, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    stack: list = [(top, iter(top.inside))]
    while stack:
        node, rest = stack[-1]
        for x in rest:
            if isinstance(x, tuple):
                parts.append(x[0])
                linked += len(x[0].strip()) if x[1] else 0
            elif not x.aside:
                if x.name in BLOCK:
                    flush()
                    owner = x
                stack.append((x, iter(x.inside)))
                break
        else:
            stack.pop()
            if node.name in BLOCK or not stack:
                flush()
                owner = next((n for n, _ in reversed(stack) if n.name in BLOCK), top)
    return found


def _best(page: list[tuple[Node, str, int]], root: Node) -> list[Node]:
    """The container with most points or the article (else main) around it, and the siblings that belong to it."""
    scored: dict[int, Node] = {}
    for node, text, linked in page:
        up = node
        while up is not None:
            up.chars += len(text)
            up.linked += linked
            up = up.parent
        if node.name in PARAGRAPH and linked < LINKS * len(text):
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            # Text that stands in a container itself gives its points to that container.
            up, share = (node.parent or node) if node.name not in ("div", "section", "article", "main") else node, 1.0
            step = 0
            while up is not None and step < 4:
                up.score += points * share
                scored[id(up)] = up
                step += 1
                share = 0.5 if step == 1 else 0.5 / (3 * (step - 1))
                up = up.parent
    for node in scored.values():
        bonus = 25 * (node.name in ("article", "main")) + 5 * bool(node.words & CONTENT_WORDS)
        node.score = (node.score + bonus) * (1 - node.linked / max(1, node.chars))
    if not scored:
        return [root]
    best = max(scored.values(), key=lambda n: n.score)  # the first in page order of equals
    # Points thin out with the steps upwards, so a long part of an article may have more of them than the article.
    around, up = {}, best
    while up is not None:
        around[up.name] = up  # the outermost of each name
        up = up.parent
    best = around.get("article") or around.get("main") or best
    if best.parent is None or best.name == "main":
        return [best]
    kept = []
    for x in best.parent.inside:
        if isinstance(x, Node) and not x.aside:
            dense = x.linked / max(1, x.chars)
            if x is best:
                kept.append(x)
            elif x.name == "article":
                # The next part of the same story has no headline of its own; another story's teaser has one.
                if x.words == best.words and dense < LINKS and not _has_heading(x):
                    kept.append(x)
            elif x.name in BESIDE:
                if dense < LINKS:
                    kept.append(x)
            elif best.name != "article":
                alike = x.name == best.name and x.words and x.words == best.words
                if x.name == "section" and dense < LINKS or dense < 0.25 and x.name in BLOCK and x.score + alike * SIBLING * best.score >= max(10, SIBLING * best.score):
                    kept.append(x)
    return kept


def _has_heading(top: Node) -> bool:
    stack = [top]
    while stack:
        node = stack.pop()
        if node.name in HEADINGS:
            return True
        stack += [x for x in node.inside if isinstance(x, Node) and not x.aside]
    return False


def main_text(html: str) -> str:
    """Blocks of the main text, joined by an empty line; empty if the page has none."""
    root = parse(html)
    page = blocks(root)
    if not page:
        return ""
    chosen = _best(page, root)
    if chosen == [root]:
        return "\n\n".join(text for _, text, _ in page)
    keep = set(map(id, chosen))
    held: dict[int, bool] = {}

    def within(node: Node) -> bool:
        path = []
        while node is not None and id(node) not in held and id(node) not in keep:
            path.append(node)
            node = node.parent
        found = node is not None and (id(node) in keep or held[id(node)])
        for x in path:
            held[id(x)] = found
        return found

    return "\n\n".join(text for node, text, _ in page if within(node))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), from the whole html.

    A null or empty page, or one without main text, has an empty text. Pages without a scored paragraph keep all text
    that does not stand aside; of equal containers the first in the page wins. The
    outermost article around the best container is kept whole, or the outermost main part, and nothing beside it, if there is
    none; headings, paragraphs and lists beside an article stay unless half of their text is links, and so does an article of
    the same class without a headline of its own; beside another container related sections and blocks stay too. Repeated rows are kept; an empty table
    gives no rows; other columns are not looked at.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((x.as_py() or b"").decode("utf-8", "replace")) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("binary").alias("html"))
    return slim.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
