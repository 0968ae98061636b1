"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. A small linear classifier over elements, class names, text length and
links gives each block log-odds for being main text, bounded by MOST; these are the capacities to the two
terminals. Blocks next to each other on the page, and successive blocks below the same parent, are tied by
smoothness edges of like size, weaker the further apart they are in the tree and where only one of them bears marks
of the page's frame or is mostly links. Maximum flow finds the cheapest labelling: a block of doubtful
looks goes with its neighbours, one that clearly differs from them does not.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"""[^"'>]*+(?:"[^"]*"[^"'>]*+|'[^']*'[^"'>]*+)*+>""")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is not text of the page.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|$)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "template", "svg", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: An opening tag of the key ends an open element of the value, unless a boundary lies between.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
_BOUNDARY = frozenset("ul ol dl table article section div main body aside nav header footer form".split())
#: Elements that hold the main text, the surest highest: blocks below the surest that a page has count as inside.
_CONTENT_TAGS = {"article": 2, "main": 1}
_FRAME_TAGS = frozenset("nav footer aside form button select menu dialog fieldset datalist".split())
#: Words in class names, ids and roles that speak against a block, by their share of a name's words.
_FRAME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion share sharing social related recommended widget toolbar pagination pager search complementary contentinfo disclaimer skip".split()
)
_HEADER_WORDS = frozenset("header masthead topbar".split())
#: Words that say nothing either way.
_NEUTRAL_WORDS = frozenset("box block wrapper wrap container inner outer unit item items list area section slot top bottom left right bar panel site page global primary secondary links buttons icons".split())
#: Words that speak for a block, a little.
_CONTENT_WORDS = frozenset("article post story entry content text body".split())
_COMMENT_WORDS = frozenset("comment comments respond reply replies discussion disqus commentlist".split())
#: Share that a name with a word for reader comments counts with at least.
_COMMENT_SHARE = 0.8
#: Weights of the classifier: positive for main text. W_CLASS is for names that are nothing but frame words; the square of the share of such words takes from it.
W_ARTICLE, W_OUTSIDE, W_FRAME, W_CLASS, W_HINT, W_LINKS, W_SENTENCE, W_BIAS = 1.5, -2.5, -6.0, -5.0, 1.0, -2.5, 0.5, -0.4
#: For each word up to so many.
W_WORD, WORDS = 0.08, 20
#: Bound of the log-odds.
MOST = 3.0
#: Smoothness: of neighbours, of successive blocks of one parent; the former falls with the distance in the tree, both where marks differ.
S_NEXT, S_SIBLING, S_FALL, S_UNLIKE = 0.8, 0.6, 0.6, 0.3


class Block:
    """A run of text. ``share`` is the frame words' share in the worst name around it, ``parent`` the number of the
    element around its own, ``depth`` how many block elements it stands in, ``common`` how many of them the block before it shares."""

    __slots__ = ("text", "words", "linked", "frame", "share", "article", "hint", "parent", "depth", "common")

    def __init__(self, text: str, linked: int, top: "_Open", parent: int, depth: int, common: int):
        self.text, self.linked, self.parent, self.depth, self.common = text, linked, parent, depth, common
        self.frame, self.share, self.article, self.hint = top.frame, top.share, top.article, top.hint
        self.words = text.count(" ") + 1


class _Open:
    """An open element: what it passes on to those within, and where the nearest of some kinds lie on the stack."""

    __slots__ = ("tag", "frame", "share", "article", "hint", "number", "parent", "p", "boundary", "inline")

    def __init__(self, tag: str = "", frame: bool = False, share: float = 0.0, article: int = 0, hint: bool = False):
        self.tag, self.frame, self.share, self.article, self.hint = tag, frame, share, article, hint
        #: Numbers of the nearest block element and of the one around it; places of the nearest open p that no boundary
        #: hides, of the nearest boundary, and of the first of the inline elements on top.
        self.number = self.parent = 0
        self.p = self.boundary = -1
        self.inline = 0


_ROOT = _Open()


def _frame_share(value: str, in_article: bool) -> tuple[float, bool, set[str]]:
    """(largest share of frame words in one of the names, whether some are for comments, all words)."""
    share, comments, every = 0.0, False, set()
    for name in value.split():
        words = {t.lower() for t in _TOKEN.findall(name)}
        every |= words
        telling = words - _NEUTRAL_WORDS
        bad = telling & _FRAME_WORDS | (set() if in_article else telling & _HEADER_WORDS) | telling & _COMMENT_WORDS
        if bad:
            said = telling & _COMMENT_WORDS
            comments = comments or bool(said)
            share = max(share, len(bad) / len(telling), _COMMENT_SHARE if said else 0.0)
    return share, comments, every


def blocks(page: str) -> tuple[list[Block], int]:
    """The page's text blocks in order, and the surest content element it has (2 article, 1 main, 0 none).

    Character references are decoded, white space within a block becomes one space. Comments, scripts, styles
    and the like are left out. Broken markup is read as far as it goes: unclosed elements end with their parents.
    Time and memory are in proportion to the page, however deep it nests.
    """
    out: list[Block] = []
    has_article = 0
    stack: list[_Open] = []
    #: Places on the stack of each tag's open elements.
    open_at: dict[str, list[int]] = {}
    serial = depth = low = 0
    run: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal run, linked, low
        if run:
            text = " ".join(_html.unescape("".join(run)).split())
            if text:
                top = stack[-1] if stack else _ROOT
                out.append(Block(text, min(linked, len(text)), top, top.parent, depth, min(low, depth)))
                low = depth
        run, linked = [], 0

    def pop(k: int) -> None:
        nonlocal anchors, depth, low
        for e in stack[k:]:
            open_at[e.tag].pop()
            anchors -= e.tag == "a"
            depth -= e.tag not in _INLINE
        del stack[k:]
        low = min(low, depth)

    def nearest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    i, n = 0, len(page)
    while i < n:
        at = page.find("<", i)
        if at < 0:
            at = n
        if at > i:
            run.append(page[i:at])
            if anchors:
                linked += at - i
        if at == n:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            i = n if end < 0 else end + 3
            continue
        after = page[at + 1 : at + 2]
        closing = after == "/"
        name = _NAME.match(page, at + 1 + closing)
        if name is None:
            if after in ("!", "?") or closing:
                end = page.find(">", at)
                i = n if end < 0 else end + 1
            else:  # a bare < is text
                run.append("&lt;")
                i = at + 1
            continue
        whole = _TAG_END.match(page, name.end())
        end = whole.end() if whole else page.find(">", name.end()) + 1
        if not end:
            break  # a tag that the page's end cuts off
        tag = name.group().lower()
        i = end
        if closing:
            k = nearest((tag,))
            if tag == "br" or tag == "p" and k < 0:
                flush()
            elif tag in _INLINE:
                if k >= 0 and k >= stack[-1].inline:
                    pop(k)
            elif k >= 0:
                flush()
                pop(k)
            continue
        if tag in _RAW:
            if page[end - 2 : end] == "/>" and tag == "svg":
                continue
            shut = _RAW[tag].search(page, end)
            if shut is None:
                i = n
            else:
                gt = page.find(">", shut.end())
                i = n if gt < 0 else gt + 1
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                k = nearest(("a",))
                if k >= 0 and k >= stack[-1].inline:
                    pop(k)
        else:
            flush()
            if stack and stack[-1].p >= 0:
                pop(stack[-1].p)
            k = nearest(_CLOSES.get(tag, ()))
            if k >= 0 and k > stack[-1].boundary:
                pop(k)
        if tag in _VOID or page[end - 2 : end] == "/>" and tag not in _INLINE and tag not in _BOUNDARY and tag != "p":
            continue
        up = stack[-1] if stack else _ROOT
        e = _Open(tag, up.frame, up.share, up.article, up.hint)
        if tag in _FRAME_TAGS or tag == "header" and not e.article:
            e.frame = True
        if tag not in ("html", "body"):
            attrs = page[name.end() : end]
            if "=" in attrs:
                for m in _HINT.finditer(attrs):
                    share, comments, words = _frame_share(m[1] or m[2] or m[3] or "", bool(e.article))
                    if comments or tag not in _CONTENT_TAGS:
                        e.share = max(e.share, share)
                    if "main" in words and not e.frame and e.share < 1:
                        e.article = max(e.article, 1)
                    e.hint = e.hint or bool(words & _CONTENT_WORDS)
        framed = e.frame or e.share >= _COMMENT_SHARE
        if tag in _CONTENT_TAGS and not framed:
            e.article = max(e.article, _CONTENT_TAGS[tag])
        if not framed:
            has_article = max(has_article, e.article)
        here = len(stack)
        e.p, e.boundary, e.inline, e.number, e.parent = up.p, up.boundary, up.inline, up.number, up.parent
        if tag not in _INLINE:
            serial += 1
            e.inline, e.number, e.parent = here + 1, serial, up.number
            depth += 1
        if tag == "p":
            e.p = here
        elif tag in _BOUNDARY:
            e.p, e.boundary = -1, here
        stack.append(e)
        open_at.setdefault(tag, []).append(here)
        anchors += tag == "a"
    flush()
    return out, has_article


def unary(b: Block, has_article: int) -> float:
    """The classifier: log-odds of main text, from -MOST to MOST."""
    score = W_BIAS + W_WORD * min(b.words, WORDS) + W_LINKS * b.linked / len(b.text) + W_CLASS * b.share**2
    if b.frame:
        score += W_FRAME
    if b.hint:
        score += W_HINT
    if b.text[-1:] in ".!?:;\"'":
        score += W_SENTENCE
    if has_article:
        # What tells text from boilerplate elsewhere says little within the element that is there for the text.
        score = max(score, b.frame * W_FRAME + W_CLASS * b.share**2) + W_ARTICLE if b.article == has_article else score + W_OUTSIDE
    return max(-MOST, min(MOST, score))


def edges(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours on the page, and successive blocks of one parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i:
            a = bs[i - 1]
            apart = max(0, a.depth + b.depth - 2 * min(b.common, a.depth) - 2)
            out.append((i - 1, i, S_NEXT * S_FALL**apart * _alike(a, b)))
        j = last.get(b.parent)
        if j is not None:
            out.append((j, i, S_SIBLING * _alike(bs[j], b)))
        last[b.parent] = i
    return out


def _alike(a: Block, b: Block) -> float:
    links = (2 * a.linked > len(a.text)) == (2 * b.linked > len(b.text))
    return 1.0 if links and a.frame == b.frame and a.share == b.share else S_UNLIKE


def minimum_cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """The labels (True: main) of least sum of max(0, cost) of blocks labelled False, max(0, -cost) of those
    labelled True, and the ties between unlike labels.

    A node whose own cost outweighs all its undecided ties has the same label in every minimum, so such nodes are
    settled first and their ties passed on as costs; what is left over goes through maximum flow. Exact.
    """
    n = len(costs)
    cost = list(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in ties:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(cost[i]) < sum(near[i].values()) or not cost[i] and near[i]:
            continue
        label[i] = cost[i] > 0
        for j, w in near[i].items():
            cost[j] += w if label[i] else -w
            del near[j][i]
            queue.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        main = _source_side(rest, cost, near)
        for i in rest:
            label[i] = i in main
    return [bool(x) for x in label]


def _source_side(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> set[int]:
    """Maximum flow from the nodes of positive to those of negative cost; the nodes that the source still reaches.

    Each node sends off its cost along shortest paths to nodes that still take some. Where a search ends without one,
    all it has met is cut off from the sink for good: no later path can lead through, so nothing is searched in vain twice.
    """
    left = {i: dict(near[i]) for i in nodes}
    room = {i: max(0.0, -cost[i]) for i in nodes}
    main: set[int] = set()
    for start in nodes:
        give = cost[start]
        while give > 1e-12 and start not in main:
            came, queue, end = {start: start}, deque([start]), None
            while queue and end is None:
                x = queue.popleft()
                for y, w in left[x].items():
                    if w > 1e-12 and y not in came and y not in main:
                        came[y] = x
                        if room[y] > 1e-12:
                            end = y
                            break
                        queue.append(y)
            if end is None:
                main.update(came)
                break
            path, y = [], end
            while y != start:
                path.append((came[y], y))
                y = came[y]
            flow = min(give, room[end], min(left[x][y] for x, y in path))
            for x, y in path:
                left[x][y] -= flow
                left[y][x] += flow
            room[end] -= flow
            give -= flow
    return main


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by one space; empty for null, empty and textless pages."""
    if not page:
        return ""
    bs, has_article = blocks(page)
    labels = minimum_cut([unary(b, has_article) for b in bs], edges(bs))
    return " ".join(b.text for b, keep in zip(bs, labels, strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages. Null ids and urls pass through; equal rows give equal rows.

    Null, empty and textless pages have an empty text of 0 characters; an empty table gives an empty result. Other
    columns of pages are left out, so their names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
