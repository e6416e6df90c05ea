"""Main-text extraction as a minimum cut over a page's blocks.

A page is cut into blocks at block-level tags. A classifier gives each block the
log-odds of being content: its positive part is the capacity from the source, its
negative part that to the sink. Blocks that follow one another, and the nearest
earlier block under the same parent, are joined by smoothness edges whose capacity
falls with their distance in the tree. The source side of the minimum cut is the
content; nothing else decides.

The classifier is a logistic regression over the block's shape (length, links,
punctuation, digits, tag) and its containers (element names, class, id and role
words). Names are evidence among others, not verdicts, and an element that wraps the
page's story (it holds the h1, or most of the page's words) has none: a class
on body or around the whole article empties no page.

It is fitted here on a bounded sample: about `SAMPLE_PAGES` pages, chosen by hash, and
at most `SAMPLE_BLOCKS` evenly spread blocks of each. Labels come from what a
prediction never sees, the title element: the heading that repeats it lies in the
story, and the smallest element around that heading with half of the page's plain words
is the story; pages without such a heading, or whose only such element is the body, teach
nothing. Each block is learned twice, as it is and with its containers hidden, so that
pages without telling names are read by shape; on pages that hardly use paragraphs any
block counts as half a paragraph. Weights are drawn to `PRIOR`, which
stands where the sample says nothing.

Defined results: a null or empty html has no text; a page without content gives
''; broken markup is read as far as it goes (an unfinished tag at the end is
dropped, an end tag without a start is ignored); repeated rows each get a row; no
pages give no rows; very long pages are read whole; extra columns are not read,
whatever their names. Nothing is cut short.
"""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the classifier is fitted on, as expected (each page is in with the same chance), and blocks of each at most.
SAMPLE_PAGES, SAMPLE_BLOCKS = 2_000, 48

# Element names of HTML.
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|iframe|textarea|title|svg|math|object|video|audio|canvas|noframes|xmp"
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# What containers are called; how much that says is learned.
_MAIN_TAGS = frozenset(("article", "main"))
_ASIDE_TAGS = frozenset("nav footer aside form menu dialog select fieldset search option button legend".split())
_MAIN_ROLES = frozenset(("main", "article"))
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu button".split())
_STORY_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|main|story|text|body|blog)(?:$|[\s_-])")
_ASIDE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|adsby\w*|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|search|menu|nav\w*|breadcrumbs?|toolbar|header|masthead|footer|foot|sidebar|side|aside|widget|related|recommend\w*|share|sharing|social|pagination|pager|tags?|copyright|legal|skip\w*|byline)(?:$|[\s_-])")
_TALK_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|respond|discussion|disqus)(?:$|[\s_-]|list|area)")
#: First lines of readers' comments.
_TALK_LINE = re.compile(r"(?:\d+\s+)?(?:comments?|replies|responses|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d*\)?)?\s*:?", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>" + _RAW + r")\b(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BREAKS = frozenset(".!?:;")


@dataclass
class Element:
    """What an element is called: as a story (`main` by tag or role, `story` by name) or not (`aside` by tag or role, `named` by name, `talk`: readers' comments)."""

    tag: str
    parent: int
    main: bool = False
    aside: bool = False
    story: bool = False
    named: bool = False
    talk: bool = False
    # filled in when the page is read
    words: int = 0
    headed: bool = False
    menu: bool = False
    blocks: int = 0


@dataclass
class Block:
    text: str
    path: tuple[int, ...]  # the elements it lies in, from the root
    tag: str
    linked: int  # characters inside links


def _element(tag: str, attrs: str, parent: int) -> Element:
    out = Element(tag, parent, tag in _MAIN_TAGS, tag in _ASIDE_TAGS)
    if "=" in attrs or "hidden" in attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), _CAMEL.sub("-", a or b or c).lower()
            if name == "role":
                out.main |= value in _MAIN_ROLES
                out.aside |= value in _ASIDE_ROLES
            elif name == "style":
                out.aside |= bool(_UNSEEN.search(value))
            elif name in ("hidden", "aria-hidden"):
                out.aside |= name == "hidden" or value == "true"
            elif _TALK_NAME.search(value):
                out.talk = True
            elif _ASIDE_NAME.search(value):
                out.named = True
            elif _STORY_NAME.search(value):
                out.story = True
    return out


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=lambda: [Element("", 0)])  # 0: the page
    stack: list[int] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: bool = False

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                path, tag = tuple(self.stack), self.elements[self.stack[-1]].tag if self.stack else ""
                plain = (text.count(" ") + 1) if self.linked * 2 < len(text) else 0
                for x in (0, *path):
                    e = self.elements[x]
                    e.words += plain
                    e.headed |= tag == "h1"
                    e.menu |= tag == "nav"
                    e.blocks += 1
                    if e.blocks == 1 and x and _TALK_LINE.fullmatch(text) and e.tag not in ("html", "body"):
                        e.talk = True
                self.blocks.append(Block(text, path, tag, self.linked))
            self.parts, self.linked = [], 0

    def close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.elements[self.stack[i]].tag
            if name == tag:
                del self.stack[i:]
                return
            if name in within:
                return

    def open(self, tag: str, attrs: str) -> None:
        parent = self.stack[-1] if self.stack else 0
        self.elements.append(_element(tag, attrs, parent))
        self.stack.append(len(self.elements) - 1)
        if tag == "nav":
            for x in self.stack:
                self.elements[x].menu = True

    def read(self, page: str) -> _Reader:
        for m in _TOKEN.finditer(page):
            tag = m["tag"]
            if tag is None:
                s = m[0]
                if s[0] != "<" or len(s) == 1:
                    s = html_.unescape(s) if "&" in s else s
                    self.parts.append(s)
                    self.linked += len(s) if self.in_link else 0
                continue
            tag = tag.lower()
            if tag == "a":
                self.in_link = not m["end"]
            elif tag == "br" or tag == "hr":
                self.flush()
            elif tag in _BLOCK:
                self.flush()
                self.in_link = False
                if m["end"]:
                    self.close(tag)
                elif not (tag in _VOID or m["attrs"].endswith("/")):
                    if tag == "li":
                        self.close("li", frozenset(("ul", "ol", "menu")))
                    elif tag in ("td", "th", "tr"):
                        for x in ("td", "th") if tag != "tr" else ("tr",):
                            self.close(x, frozenset(("table",)))
                    elif tag in ("dt", "dd"):
                        self.close("dt", frozenset(("dl",)))
                        self.close("dd", frozenset(("dl",)))
                    self.close("p", _BLOCK - {"p"})
                    self.open(tag, m["attrs"])
        self.flush()
        return self


def read(page: str | None) -> _Reader:
    return _Reader().read(page) if page else _Reader()


def blocks(page: str | None) -> list[Block]:
    return read(page).blocks


def _wraps(e: Element, whole: Element) -> bool:
    """Whether an element holds the page's story, so that its own names say nothing about it."""
    if e.tag in ("html", "body", ""):
        return True
    if e.tag == "header":
        return e.headed and not e.menu
    if e.headed and e.words >= 20:
        return True
    # most of the words count where no heading tells, and never for an element that says by its tag what it is
    return (e.main or not whole.headed) and (not e.aside or e.tag == "form") and not e.talk and 2 * e.words > whole.words


SHAPE = 7
#: Of each block: SHAPE numbers of its own, then its containers: main or article; story names; aside tags; aside names; readers' comments; a page header.
FEATURES = SHAPE + 6


def shape(b: Block, loose: bool = False) -> list[float]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    return [1.0, min(np.log1p(words), 6.0), b.linked / n, 1.0 if b.text[-1] in _BREAKS else 0.0, sum(map(b.text.count, ".,;:!?")) / words, sum(map(b.text.count, "0123456789")) / n, 1.0 if b.tag == "p" else 0.5 if loose or b.tag in _HEADINGS else 0.0]


def containers(of: _Reader) -> list[tuple[float, ...]]:
    """The container features of each element, summed along its path."""
    whole, out = of.elements[0], []
    for i, e in enumerate(of.elements):
        main, story, aside, named, talk, header = out[e.parent] if i else (0.0,) * 6
        inside = main > 0
        main, story = max(main, float(e.main)), max(story, float(e.story and e.tag not in ("html", "body")))
        if i and not _wraps(e, whole):
            aside, named, talk = min(2.0, aside + e.aside), min(2.0, named + e.named), max(talk, float(e.talk))
            header = max(header, float(e.tag == "header" and not inside))
        out.append((main, story, aside, named, talk, header))
    return out


def features(of: _Reader) -> np.ndarray:
    """A row of FEATURES a block."""
    near = containers(of)
    loose = 5 * sum(b.text.count(" ") + 1 for b in of.blocks if b.tag == "p") < of.elements[0].words
    return np.array([[*shape(b, loose), *near[b.path[-1] if b.path else 0]] for b in of.blocks]).reshape(-1, FEATURES)


#: What the fit starts from and is drawn to: long, unlinked paragraphs that end in a stop are content; so is what lies in a story's container and in none of the others.
PRIOR = np.array([-1.5, 0.5, -3.0, 0.5, 0.5, -1.0, 1.0, 1.5, 1.0, -5.0, -5.0, -6.0, -3.0])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, pull: float = 20.0) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to PRIOR; classes weigh the same."""
    beta = PRIOR.copy()
    n = [max(1.0, float((y == c).sum())) for c in (0, 1)]
    weight = np.where(y == 1, len(y) / n[1], len(y) / n[0]) / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - pull * (beta - PRIOR)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(FEATURES), gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def told(page: str, of: _Reader) -> np.ndarray | None:
    """Which blocks the page's title tells to be content; None where it tells nothing."""
    found = _TITLE.search(page)
    title = " ".join(html_.unescape(found[1]).split()).casefold() if found else ""
    if not title:
        return None
    for b in of.blocks:
        name = b.text.casefold()
        if b.tag not in _HEADINGS or not (name == title or len(name) >= 10 and (title.startswith(name) or name.startswith(title))):
            continue
        for x in reversed(b.path):
            e = of.elements[x]
            if e.tag in ("html", "body"):
                break
            if 2 * e.words >= of.elements[0].words:
                return np.array([x in other.path for other in of.blocks], float)
        return None
    return None


#: Log-odds that it costs to part two siblings.
SMOOTHNESS = 1.0


def _distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def edges(of: list[Block], scale: float = SMOOTHNESS) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity) between neighbours in the page and in the tree: `scale` between siblings, half of it for each step farther."""
    out, last = [], {}
    for j, b in enumerate(of):
        near = {j - 1} if j else set()
        parent = b.path[:-1]
        if parent in last:
            near.add(last[parent])
        last[parent] = j
        out += [(i, j, round(1000 * scale * 2.0 ** (2 - max(1, _distance(of[i].path, b.path))))) for i in sorted(near)]
    return out


def source_side(gain: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source side of a minimum cut: node i has capacity gain[i] from the source if that is positive, else -gain[i] to the sink; links hold both ways.

    Nodes whose terminal exceeds all their links keep its side in any minimum
    cut; the rest is cut by augmenting along shortest paths (Dinic)."""
    n = len(gain)
    gain, side = list(gain), [None] * n
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in links:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    todo = list(range(n))
    while todo:  # persistency
        i = todo.pop()
        if side[i] is None and abs(gain[i]) > sum(near[i].values()):
            side[i] = gain[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                gain[j] += c if side[i] else -c
                todo.append(j)
            near[i] = {}
    free = [i for i in range(n) if side[i] is None]
    if free:
        place = {i: k for k, i in enumerate(free)}
        s, t = len(free), len(free) + 1
        head: list[list[int]] = [[] for _ in range(t + 1)]
        to: list[int] = []
        cap: list[int] = []

        def link(a: int, b: int, c: int, back: int) -> None:
            head[a].append(len(to))
            to.append(b)
            cap.append(c)
            head[b].append(len(to))
            to.append(a)
            cap.append(back)

        for i in free:
            if gain[i] > 0:
                link(s, place[i], gain[i], 0)
            elif gain[i] < 0:
                link(place[i], t, -gain[i], 0)
            for j, c in near[i].items():
                if i < j:
                    link(place[i], place[j], c, c)
        while True:
            level = [-1] * (t + 1)
            level[s], queue = 0, [s]
            for a in queue:
                for e in head[a]:
                    if cap[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if level[t] < 0:
                break
            at, path = [0] * (t + 1), []
            while True:
                a = to[path[-1]] if path else s
                if a == t:
                    flow = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    path = path[: next(k for k, e in enumerate(path) if not cap[e])]
                    continue
                while at[a] < len(head[a]):
                    e = head[a][at[a]]
                    if cap[e] and level[to[e]] == level[a] + 1:
                        path.append(e)
                        break
                    at[a] += 1
                else:
                    if not path:
                        break
                    at[to[path.pop() ^ 1]] += 1
        for i in free:
            side[i] = level[place[i]] >= 0
    return [bool(x) for x in side]


def extract(page: str | None, beta: np.ndarray = PRIOR, smoothness: float = SMOOTHNESS) -> str:
    """The content blocks of a page, joined by line feeds."""
    of = read(page)
    if not of.blocks:
        return ""
    gain = [round(1000 * o) for o in (features(of) @ beta).tolist()]
    return "\n".join(b.text for b, kept in zip(of.blocks, source_side(gain, edges(of.blocks, smoothness)), strict=True) if kept)


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, each: int = SAMPLE_BLOCKS) -> np.ndarray:
    """The classifier, from about so many pages, chosen by a hash of page_id and url where they are, not sorted or moved."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(0):
                of = read(text := page.as_py())
                if (y := told(text, of)) is not None:
                    pick = np.unique(np.linspace(0, len(y) - 1, min(each, len(y))).round().astype(int))
                    out += [r.tobytes() for r in np.hstack([features(of), y[:, None]])[pick]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["row"])

    share = min(1.0, sample / max(1, pages.count()))
    picked = pages.where(F.col("html").isNotNull() & (F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < F.lit(share * (1 << 30)))).select("html")
    found = sorted(bytes(r[0]) for r in picked.mapInArrow(rows, "row binary").collect())
    return learn(np.array([np.frombuffer(r) for r in found]).reshape(-1, FEATURES + 1))


def learn(rows: np.ndarray) -> np.ndarray:
    """The classifier from labelled blocks (features, label); each row also stands with its containers hidden."""
    if not len(rows) or len({*rows[:, -1]}) < 2:
        return PRIOR
    hidden = rows.copy()
    hidden[:, SHAPE:FEATURES] = 0
    both = np.concatenate([rows, hidden])
    return fit(both[:, :-1], both[:, -1])


def extract_pages(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    beta = train(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), beta) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select("page_id", "url", "html")
    kinds = dict(picked.dtypes)
    return picked.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
