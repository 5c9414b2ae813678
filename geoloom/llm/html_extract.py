"""Operator 10: main text of web pages by minimum-cut labelling of blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from geoloom.llm.common import hashed_share, map_rows

# Elements without content, whose content is no markup, without text for a reader, that make no blocks, and that close an open paragraph.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe".split())
_MUTE = _RAW | frozenset("noscript template svg object select option button annotation annotation-xml".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mrow mi mn mo ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded mspace mtable mtr mtd semantics".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
# What ends a mute element that has no end tag of its own, if its parent doesn't end before.
_BREAKS = _ENDS_P | frozenset("body li dt dd tr td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = _HEADINGS | frozenset("p li dt dd td th pre".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAME = re.compile(r"(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE = re.compile(r"\"[^\"]*\"|'[^']*'|([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# Words in names of elements that hold no article text, words that say nothing by themselves, and words that name the article.
_POOR_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets "
    "footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist reply "
    "replies respond disqus discussion share sharing social related recommended recommendations trending popular pagination pager copyright legal disclaimer toolbar skip".split()
)
_PLAIN_WORDS = frozenset(
    "list item items box bar wrap wrapper container block section area region main site page top bottom left right inner outer primary secondary post posts story stories article "
    "link links button buttons icon icons group row col column columns content body text global local more reader user readers users the of and".split()
)
_RICH_WORDS = frozenset("article content main post entry story body text".split())
_POOR_TAGS = frozenset("nav header footer aside form dialog menu address".split())
_RICH_TAGS = frozenset("article main".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Headings (or short labels) that open a part of the page which is no article, labels in a reader's comment, and phrases of notices.
_OPENS = re.compile(
    r"\W*(?:[0-9]+\s+)?(?:(?:reader |user |all )?comments?|comments? \([0-9]+\)|(?:[0-9]+ )?(?:responses?|replies)|leave a (?:comment|reply)|(?:join|add to) the (?:conversation|discussion)|kommentare?|"
    r"commentaires?|comentarios?|related (?:articles?|posts?|stories|links|content)|you may also like|more (?:from|stories|articles).{0,20}|read (?:more|next)|most (?:read|popular)|trending(?: now)?|"
    r"share(?: this)?(?: article| post)?|newsletter|subscribe.{0,20}|advertisements?|sponsored(?: content)?|anzeige|werbung|publicité|publicidad)\W*",
    re.I,
)
# Of those, labels that are headings of articles too.
_EITHER = re.compile(r"\W*(?:(?:[0-9]+ )?(?:responses?|replies)|more from.{0,20}|trending(?: now)?|newsletter|subscribe.{0,20})\W*", re.I)
_ANSWER = re.compile(r"\W*(?:reply|report|antworten|répondre|responder)\W*|.{1,60}\b(?:says|wrote|commented|schrieb|a écrit|dice|escribió)\s*:\W*", re.I)
_NOTICE = re.compile(r"©|\ball rights reserved\b|\bcookies?\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\bsign up\b|\bsubscribe\b|\bsponsored\b|\badvertisement\b|\balle rechte\b|\btous droits\b|\btodos los derechos\b", re.I)

#: Evidence in log-odds: of elements and names that speak against content (surely, perhaps), of those that speak for it,
#: of hidden elements, and the most that the text itself can say.
POOR, DOUBT, RICH_TAG, RICH_NAME, HIDDEN, TEXT = 3.0, 0.8, 1.5, 0.8, 40.0, 1.8
#: Weights of smoothness edges: to the next block, to what else the same element holds, and across a change of region.
SMOOTH_NEXT, SMOOTH_HOME, SMOOTH_ACROSS = 1.2, 0.8, 0.15


def name_evidence(tag: str, names: list[str]) -> tuple[float, float]:
    """What the names (class, id, role, label) of an element say against and for content.

    A name all of whose words are known, one of them poor, speaks surely; a poor
    word beside an unknown one ("social-history") only perhaps."""
    poor = rich = 0.0
    for name in names:
        words = [w.lower() for w in _WORD.findall(name)]
        bad = [w for w in words if w in _POOR_WORDS]
        if bad:
            poor = max(poor, POOR if len(words) <= 4 and all(w in _POOR_WORDS or w in _PLAIN_WORDS for w in words) else DOUBT)
        elif tag in ("div", "section", "td") and any(w in _RICH_WORDS for w in words):
            rich = RICH_NAME
    return poor, rich


def hidden(attributes: str) -> bool:
    """Whether an attribute hides the element: ``hidden``, aria-hidden="true" or such a style."""
    if not re.search("hidden|display", attributes, re.I):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = (m[1] or "").lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _UNSHOWN.search(value)):
            return True
    return False


class _Ends:
    """Where the tags of a name lie in a page, and which start tags have an end tag of their own."""

    def __init__(self, page: str, tag: str):
        self.stops: list[tuple[int, int]] = []
        self.paired: set[int] = set()
        opened: list[int] = []
        for m in re.finditer(rf"<(/?){tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", page, re.I):
            if not m[1]:
                opened.append(m.start())
            else:
                self.stops.append((m.start(), m.end()))
                if opened:
                    self.paired.add(opened.pop())

    def after(self, at: int) -> int | None:
        """Where the first end tag from ``at`` on stops."""
        k = bisect_left(self.stops, (at, 0))
        return self.stops[k][1] if k < len(self.stops) else None


class Block:
    """A stretch of text between block boundaries, with what surrounds it."""

    __slots__ = ("parts", "path", "linked", "poor", "rich", "heading", "tag")

    @property
    def home(self) -> tuple[int, ...]:
        """The element that holds the block: around its own paragraph, item or heading, if it has one."""
        return self.path[:-1] if self.tag in _LEAVES else self.path

    def __init__(self, path: tuple[int, ...], poor: float, rich: float, heading: bool, tag: str):
        self.parts: list[str] = []
        self.path, self.poor, self.rich, self.heading, self.tag, self.linked = path, poor, rich, heading, tag, 0


def blocks(page: str) -> list[tuple[str, Block]]:
    """The blocks of a page with their text (white space folded, trimmed), none empty.

    Tags may be unclosed, misnested or cut off: an end tag closes up to its
    start if that is open, a block element closes an open paragraph. The text of
    mute elements is left out; one without an end tag of its own ends with its
    parent, or before that at the next block element or element of its kind."""
    out: list[tuple[str, Block]] = []
    stack: list[tuple[str, float, float, int, int]] = [("", 0.0, 0.0, 0, 0)]  # tag, poor, rich, number, place of the mute element around (0: none)
    known: dict[str, _Ends] = {}
    count, at, links, now = 0, 0, 0, None

    def finish() -> None:
        nonlocal now
        if now is not None:
            text = " ".join(html.unescape("".join(now.parts)).split())
            if text:
                out.append((text, now))
        now = None

    def say(piece: str) -> None:
        nonlocal now
        if piece and not stack[-1][4]:
            if now is None:
                if piece.isspace():
                    return
                _, poor, rich, _, _ = stack[-1]
                around = [x for x in stack if x[0] not in _INLINE]
                now = Block(tuple(x[3] for x in around), poor, rich, any(x[0] in _HEADINGS for x in around), around[-1][0])
            now.parts.append(piece)
            if links:
                now.linked += len(piece)

    def leave(k: int) -> None:
        nonlocal links
        for x in stack[k:]:
            links -= x[0] == "a"
            if x[0] not in _INLINE and not x[4]:
                finish()
        del stack[k:]

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                leave(k)
                return

    def ends(tag: str) -> _Ends:
        if tag not in known:
            known[tag] = _Ends(page, tag)
        return known[tag]

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if (tag in _ENDS_P or tag not in _INLINE) and not stack[-1][4]:
                finish()
            close(tag)
            continue
        whole = m[3].rstrip().endswith("/")
        mute = stack[-1][4]
        if mute and not whole and (tag in _BREAKS or tag == stack[mute][0]) and stack[mute][3] < 0:
            leave(mute)
            mute = 0
        if tag in _MUTE:
            if whole:
                continue
            if tag in _RAW:
                if not mute:
                    finish()
                stop = ends(tag).after(at)
                if stop is not None:
                    at = stop
                    continue
            # The number of a mute element is negative if it has no end tag of its own.
            count += 1
            paired = m.start() in ends(tag).paired
            stack.append((tag, *stack[-1][1:3], count if paired else -count, mute or len(stack)))
            continue
        if mute:
            if tag not in _VOID and not whole:
                count += 1
                links += tag == "a"
                stack.append((tag, *stack[-1][1:3], count, mute))
            continue
        if tag not in _INLINE:
            finish()
        if tag in _ENDS_P and any(x[0] == "p" for x in stack):
            close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ("ul", "ol", "dl", "table", "tr") and tag != "tr":
                    break
                if stack[k][0] == tag:
                    close(tag)
                    break
        if tag in _VOID or whole:
            continue
        _, poor, rich, _, _ = stack[-1]
        header = tag == "header" and any(x[0] in _RICH_TAGS for x in stack)  # an article's own header holds its title
        against = POOR if tag in _POOR_TAGS and not header else 0.0
        favour = 0.0
        if m[3]:
            if tag not in ("body", "html", "article", "main"):
                named, favour = name_evidence(tag, [n for x in _NAME.findall(m[3]) for n in (x[0] or x[1] or x[2]).split()])
                against = max(against, named)
            if hidden(m[3]):
                against = HIDDEN
        # The element nearest to the text has the say, except that a sure word against isn't undone by an element inside.
        if against >= POOR:
            poor, rich = max(poor, against), 0.0
        elif tag in _RICH_TAGS:
            poor, rich = (poor if poor >= POOR else 0.0), RICH_TAG
        else:
            poor, rich = max(poor, against), max(rich, favour)
        count += 1
        links += tag == "a"
        stack.append((tag, poor, rich, count, 0))
    finish()
    return out


#: What is asked of a block's text, and the weights of the answers before any page is seen.
_ASKED = (1, 3, 6, 10, 20, 40)
PRIOR = (-1.0, 0.3, 0.4, 0.8, 0.6, 0.4, -0.6, -0.8, -1.2, 0.8, 0.3, 1.0, -0.4, -1.5, -0.5)


def features(text: str, block: Block) -> tuple[int, ...]:
    """Yes-or-no answers about the text of a block; neither its element's name nor its place."""
    n = text.count(" ") + 1
    share = block.linked / max(1, len(text))
    marks = sum(text.count(c) for c in ".!?")
    return (
        *(int(n >= k) for k in _ASKED),
        int(share > 0.1),
        int(share > 0.4),
        int(share > 0.8),
        int(text[-1:] in ".!?…:;\"”»"),
        int(marks >= 2),
        int(block.heading),
        int(block.tag in ("li", "dt", "dd", "td", "th")),
        int(bool(_NOTICE.search(text))),
        int(not re.search(r"[^\W\d_]{2}", text)),
    )


def fit_text_weights(rows: list[tuple[tuple[int, ...], int, int]], pull: float = 20.0, rounds: int = 30) -> list[float]:
    """Logistic regression (Newton's steps) of rows (answers, content or not,
    count), both labels weighted alike in sum, drawn towards :data:`PRIOR` by
    ``pull`` squared-error units: few labels hardly move it."""
    prior = np.array(PRIOR)
    if not rows:
        return prior.tolist()
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    n = np.array([r[2] for r in rows], float)
    sums = [n[y == k].sum() for k in (0, 1)]
    if min(sums) == 0:
        return prior.tolist()
    n = n * np.where(y == 1, n.sum() / (2 * sums[1]), n.sum() / (2 * sums[0]))
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - pull * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), slope)
        w += np.clip(step, -1, 1)
        if abs(step).max() < 1e-9:
            break
    return [round(v, 6) for v in w.tolist()]


def train_text(pages: DataFrame, sample: int = 5_000, id_col: str = "page_id", html_col: str = "html") -> list[float]:
    """The text weights, learnt from about ``sample`` pages (chosen by their hashed
    ids; all, if there are no more) that have an article or main element: blocks
    inside it, and inside nothing that speaks against content, are labelled
    content, blocks outside boilerplate. Only the counts of distinct answers
    reach the driver."""

    def fn(found: list) -> dict:
        x, y = [], []
        for page in found:
            own = blocks(page or "")
            if any(b.rich >= RICH_TAG for _, b in own):
                for text, b in own:
                    if b.poor < HIDDEN and (b.rich >= RICH_TAG or b.poor == 0 or b.poor >= POOR):
                        x.append(features(text, b))
                        y.append(int(b.rich >= RICH_TAG and b.poor == 0))
        return {"x": x, "y": y}

    chosen = hashed_share(pages.select(id_col, html_col), id_col, sample)
    counts = map_rows(chosen, [html_col], fn, "x array<int>, y int").groupBy("x", "y").count().orderBy("x", "y").collect()
    return fit_text_weights([(tuple(r["x"]), r["y"], r["count"]) for r in counts])


def prose(text: str, block: Block) -> bool:
    """Whether a block is a paragraph of sentences: twenty words or more, few of them links, closed by a full stop or the like."""
    return text.count(" ") >= 19 and block.linked < 0.4 * len(text) and text[-1:] in ".!?…\"”»"


def opened(found: list[tuple[str, Block]]) -> list[bool]:
    """Which blocks lie in a part opened by a label such as "Comments": what
    follows under the label's parent (or, if it stands there alone, that one's
    parent) up to the next heading of another kind; and what shares its parent with
    a comment's own labels.

    One such label among three or more paragraphs ("As Mary wrote:") makes no
    comment of them, and a heading that articles have too ("Responses") opens
    such a part only if no paragraph follows or a comment's labels do."""
    out = [False] * len(found)
    marked = [b.home if len(t) <= 80 and b.rich < RICH_TAG and _ANSWER.fullmatch(t) else None for t, b in found]
    marks, paragraphs = Counter(marked), Counter(b.home for t, b in found if prose(t, b))
    answers = {home for home, n in marks.items() if home is not None and (n > 1 or paragraphs[home] < 3)}
    for i, (text, b) in enumerate(found):
        if len(b.path) > 2 and b.home in answers:
            out[i] = True
        if len(text) > 60 or not (b.heading or len(text) <= 30) or not _OPENS.fullmatch(text):
            continue
        root = b.home
        while len(root) > 1 and (i + 1 == len(found) or found[i + 1][1].path[: len(root)] != root) and (not i or found[i - 1][1].path[: len(root)] != root):
            root = root[:-1]
        part = [i]
        for j in range(i + 1, len(found) if b.heading else i + 1):
            t, other = found[j]
            if other.path[: len(root)] != root or (other.heading and len(other.path) <= len(b.path) and not _OPENS.fullmatch(t)):
                break
            part.append(j)
        if b.heading and _EITHER.fullmatch(text) and any(prose(*found[j]) for j in part) and not any(marked[j] is not None and found[j][1].home in answers for j in part):
            continue
        for j in part:
            out[j] = True
    return out


def evidence(found: list[tuple[str, Block]], weights: Sequence[float] = PRIOR) -> list[float]:
    """The log-odds of content for each block by itself: what its text says, within
    bounds, and what elements, names and labels around it say."""
    out = []
    for (text, b), part in zip(found, opened(found), strict=True):
        said = sum(w for w, x in zip(weights, features(text, b), strict=True) if x)
        poor = max(b.poor, POOR) if part else b.poor
        out.append(max(-TEXT, min(TEXT, said)) + (0.0 if poor >= POOR else b.rich) - poor)
    return out


_NIL = 1e-12


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut; a node costs
    ``sink`` there and ``source`` on the other side, an edge whose ends are
    parted its weight. Augmenting paths along the levels of a breadth-first search.

    Nodes whose terminal costs differ by more than all their edges can weigh
    have their label in every minimum cut; they are settled first and leave
    their edges' weights to their neighbours' terminals."""
    n = len(source)
    excess = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        k = todo.popleft()
        if label[k] is not None or abs(excess[k]) <= sum(near[k].values()):
            continue
        label[k] = excess[k] > 0
        for j, w in near[k].items():
            if label[j] is None:
                excess[j] += w if label[k] else -w
                del near[j][k]
                todo.append(j)
        near[k] = {}
    left = [k for k in range(n) if label[k] is None]
    room = {k: dict(near[k]) for k in left}
    give = {k: max(0.0, excess[k]) for k in left}
    take = {k: max(0.0, -excess[k]) for k in left}
    while left:
        # Levels from the source; then paths along rising levels until none is left.
        level = {k: 0 for k in left if give[k] > _NIL}
        line, met = deque(level), False
        while line:
            k = line.popleft()
            met = met or take[k] > _NIL
            for j, w in room[k].items():
                if w > _NIL and j not in level:
                    level[j] = level[k] + 1
                    line.append(j)
        if not met:
            for k in left:
                label[k] = k in level
            break
        arcs = {k: iter(list(room[k])) for k in level}
        for root in [k for k, d in level.items() if d == 0]:
            path = [root]
            while give[root] > _NIL and path:
                k = path[-1]
                if take[k] > _NIL:
                    flow = min([give[root], take[k], *(room[a][b] for a, b in zip(path, path[1:], strict=False))])
                    give[root] -= flow
                    take[k] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        room[a][b] -= flow
                        room[b][a] = room[b].get(a, 0.0) + flow
                    full = next((i for i in range(1, len(path)) if room[path[i - 1]][path[i]] <= _NIL), len(path))
                    del path[full:]
                    continue
                for j in arcs[k]:
                    if level.get(j) == level[k] + 1 and room[k][j] > _NIL:
                        path.append(j)
                        break
                else:
                    path.pop()
    return [bool(x) for x in label]


def cut_edges(found: list[tuple[str, Block]]) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks. Neighbours in the page weigh half as much
    for each step in the tree that parts them beyond that of siblings, and little
    where one is in a region for or against content and the other isn't. The
    blocks that one element holds are tied to a node of that element's own, numbered
    after the blocks, which has no cost."""
    edges, hubs = [], {}
    for i, (_, b) in enumerate(found):
        if i:
            before = found[i - 1][1]
            common = sum(1 for x, y in zip(b.path, before.path, strict=False) if x == y)
            steps = max(0, len(b.path) + len(before.path) - 2 * common - 2)
            edges.append((i - 1, i, SMOOTH_NEXT * 0.5**steps if before.poor == b.poor and before.rich == b.rich else SMOOTH_ACROSS))
        hub = hubs.setdefault((b.home, b.poor, b.rich), len(found) + len(hubs))
        edges.append((i, hub, SMOOTH_HOME))
    return edges


def keep_blocks(found: list[tuple[str, Block]], weights: Sequence[float] = PRIOR) -> list[bool]:
    """The minimum cut's label of each block: True for content."""
    own, edges = evidence(found, weights), cut_edges(found)
    nodes = 1 + max((b for _, b, _ in edges), default=-1)
    own += [0.0] * (nodes - len(own))
    return min_cut([max(0.0, x) for x in own], [max(0.0, -x) for x in own], edges)[: len(found)]


def main_text(page: str, weights: Sequence[float] = PRIOR) -> str:
    """The content blocks of a page in order, joined by one space."""
    found = blocks(page)
    return " ".join(t for (t, _), k in zip(found, keep_blocks(found, weights), strict=True) if k)


def extract_text(pages: DataFrame, sample: int = 5_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text (empty if none), n_chars.

    Blocks of the page are labelled content or boilerplate by a minimum cut.
    Terminal capacities are the log-odds of a classifier of the block's text,
    fitted on about ``sample`` pages (:func:`train_text`), with moderate amounts
    for what elements, names and labels around it say; nearness in the page and
    in its tree gives the smoothness edges. A null or empty page gives an empty
    text; broken markup is read as far as it goes; very long pages are read
    whole; repeated rows repeat; null ids and urls stay; an empty table gives an
    empty one; other columns, whatever their names, are not read. No shuffle of
    pages: one pass over the sample, one over all.
    """
    weights = train_text(pages, sample, id_col, html_col)

    def fn(ids: list, urls: list, found: list) -> dict:
        texts = [main_text(h or "", weights) for h in found]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(pages, [id_col, url_col, html_col], fn, "page_id long, url string, text string, n_chars long")
