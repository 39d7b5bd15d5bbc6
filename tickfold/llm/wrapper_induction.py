"""Main text of web pages by wrapper induction: the trees of same-host pages are aligned by simple tree matching.

1. Dealing. Pages are grouped by host; a host with many pages is cut into groups of about ``GROUP`` by a hash of the row,
   so a host with a third of all pages is many tasks. A group is walked in order of page_id and that hash, in chunks of
   ``CHUNK`` to 2 * CHUNK - 1 pages. All of this depends on the rows alone, so a page's text does not depend on how many
   partitions or tasks there are.
2. Wrappers. The pages of a chunk are aligned one after the other with the chunk's wrappers, trees of slots. Two nodes
   can match if they have the same element and class (numbers apart). Of two child lists the blocks whose whole text was
   seen in a slot before are matched first (the longest run in order), and between those the largest order-preserving
   match is taken, as simple tree matching has it. A page joins the wrapper that explains most of its nodes, if that is
   at least ``ALIKE`` of them, and starts a new one otherwise; nodes without a match become new slots in their places, so
   a wrapper grows by whatever its first pages lack.
3. Votes. A slot counts every text by its contexts: what else stands beside it, in the nearest element around it that has
   more. Copies of a page bring the same context again and count once. A text that fills most of a slot's contexts is
   template (constant), the others vary and are content: ``OUTSIDE`` and ``INSIDE`` say how many contexts and what share.
4. Priors, as menus and adverts may vary as much as content does. Elements and roles that hold no article text (nav,
   footer, form and the like) are template. If a page has an article or main element, only what is inside counts, and
   texts there are template only on the strength of many pages. Class words break ties: the plain ones (ads, comments)
   always, the others (notice, related, sidebar) outside of articles, or inside where the slot's texts repeat or are all
   links; never on an element with an article, main or more than half of the page's text inside. Outside of articles a
   list of nothing but links is a menu.

Defined results: a null or empty html and a page without article text give an empty text; a null url has a host of its
own; a null page_id is kept; equal rows are pages of their own with equal texts; of two wrappers that explain a page
alike the older is taken; unclosed and stray tags are closed as HTML does; below ``DEEPEST`` levels blocks are cut into
siblings, template elements stay out there too; columns of other names are not used; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.shared import slices

CHUNK, GROUP, MOST_GROUPED, ALIKE, DEEPEST = 64, 256, 20_000, 0.5, 200
#: Groups dealt to a task, so that a task's work does not grow with the table, and the most tasks.
TASK_GROUPS, TASKS = 4, 50_000
#: Contexts and share of all contexts from which on a slot's text is template.
OUTSIDE, INSIDE = (3, 0.66), (8, 0.9)
#: Bytes of html beyond which a chunk ends before it has its number of pages, as all of it is in memory.
CHUNK_BYTES = 32 << 20
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Element names and attribute words of HTML and of common page layouts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg select object".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CHROME = set("nav footer aside form button dialog menu input label fieldset head".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
PART = r"(?:[-_]?(?:box|list|area|section|container|wrap|wrapper|bar|block|slot|unit|form|links|thread))?"
PLAIN = re.compile(rf"^(?:ads?|adv|adverts?|advertisement|advertising|adsense|sponsor|sponsored|user-comments|reader-comments|comments?|disqus|respond|cookie-?(?:notice|banner|consent)|newsletter){PART}$")
WEAK = re.compile(rf"^(?:nav|navi|navbar|navigation|menu|submenu|breadcrumbs?|sidebar|sidenav|rail|footer|foot|header|masthead|topbar|banner|promo|promotion|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|subscribe|subscription|signup|signin|login|register|share|sharing|social|related|recommended|recommendations|reply|replies|discussion|widgets?|toolbar|pagination|pager|search){PART}$")


class Node:
    __slots__ = ("tag", "key", "names", "role", "kids", "blocks", "slot", "own", "full", "size", "shape", "holds", "text", "context")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.kids, self.role, self.names, self.slot, self.key = tag, [], "", (), None, tag
        if attributes:
            found = {a.lower(): (b or c or d).lower() for a, b, c, d in ATTRIBUTE.findall(attributes)}
            self.role = found.get("role", "")
            classes = found.get("class", "").split()
            self.names = (*classes, *found.get("id", "").split())
            if classes:
                self.key = f"{tag}.{re.sub('[0-9]+', '', '.'.join(sorted(classes)))}"

    @property
    def aside(self) -> bool:
        """Whether the element or its role says that it holds no article text."""
        return self.tag in CHROME or self.role in ROLES

    @property
    def chrome(self) -> bool:
        """The same, but for a form around the article."""
        return self.aside and not (self.tag in ("form", "fieldset", "label") and self.holds)


def parse(html: str) -> Node:
    """The tree of a page, with what each node needs for matching; references are decoded where a text ends at a tag."""
    root = Node("html")
    #: element names on the way down, and the node that takes the text there
    stack: list[tuple[str, Node]] = [("html", root)]
    at = 0

    def text(piece: str) -> None:
        if piece:
            stack[-1][1].kids.append(entities.unescape(piece) if "&" in piece else piece)

    def close(to: int) -> None:
        """Closes elements down to that depth; below DEEPEST a block's end is a break between siblings."""
        for name, node in stack[to:]:
            if node is stack[to - 1][1] and name in BLOCK:
                node.kids.append(Node("div"))
                break
        del stack[to:]

    def place(names: set[str], bounds: set[str] = frozenset()) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in bounds:
                return 0
        return 0

    for m in PIECE.finditer(html):
        if m.start() < at:
            continue
        text(html[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                stack[-1][1].kids.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        if m[1]:
            depth = place({name})
            if depth and not (name not in BLOCK and any(x in BLOCK for x, _ in stack[depth + 1 :])):
                close(depth)
            elif name == "br":
                text(" ")
            continue
        if name in RAW:
            if name != "svg" or not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in ("html", "body"):
            continue
        if name in ("br", "wbr"):
            text(" " if name == "br" else "")
            continue
        if name in BLOCK:
            depth = place({"p"})
            if depth and not any(x in ("table", "li", "td", "div", "blockquote", "section", "article") for x, _ in stack[depth + 1 :]):
                close(depth)
        if name in CLOSES:
            while depth := place(*CLOSES[name]):
                close(depth)
                if name != "tr":
                    break
        elif name == "head":
            continue
        here, node = stack[-1][1], Node(name, m[3])
        if len(stack) < DEEPEST or node.aside and not here.aside:
            here.kids.append(node)
        else:  # too deep for a node of its own
            if name in BLOCK:
                here.kids.append(Node("div"))
            node = here
        if name not in VOID:
            stack.append((name, node))
    text(html[at:])
    finish(root)
    return root


def clean(text: str) -> str:
    return " ".join(text.split())


def finish(x: Node) -> None:
    """Sets blocks (children that are blocks, also those within inline elements), own (text outside of them), full (a sum of
    hashes of all texts), size and shape of the tree, text (its length) and holds, from the leaves up."""
    parts: list[str] = []
    x.blocks = []

    def add(n: Node) -> None:
        for k in n.kids:
            if isinstance(k, str):
                parts.append(k)
            elif k.tag in BLOCK:
                finish(k)
                x.blocks.append(k)
            else:
                k.holds, k.text = False, 0
                add(k)

    add(x)
    x.own = clean("".join(parts))
    x.full = (hash((1, x.own)) if x.own else 0) + sum(k.full for k in x.blocks) & (1 << 64) - 1
    x.size = 1 + sum(k.size for k in x.blocks)
    x.shape = hash((x.key, *[k.shape for k in x.blocks]))
    x.text = len(x.own) + sum(k.text for k in x.blocks)
    x.holds = any(k.holds or k.tag in ("article", "main") for k in x.blocks)


class Slot:
    """A node of a wrapper. votes: text -> its contexts; known: (key, full) of a child -> the child's slot."""

    __slots__ = ("key", "kids", "shape", "size", "votes", "known")

    def __init__(self, node: Node) -> None:
        self.key, self.kids = node.key, [Slot(k) for k in node.blocks]
        self.votes: dict[str, set[int]] = {}
        self.known: dict[tuple[str, int], Slot] = {}
        self.shape, self.size = node.shape, node.size

    def grown(self) -> None:
        for k in self.kids:
            k.grown()
        self.shape, self.size = hash((self.key, *[k.shape for k in self.kids])), 1 + sum(k.size for k in self.kids)


Pairs = list[tuple[Slot, Node]]


def match(a: Slot, b: Node, pairs: Pairs) -> int:
    """The size of the match of two trees, 0 if their roots differ; pairs gets it."""
    if a.key != b.key:
        return 0
    pairs.append((a, b))
    x, y, total, low, start = a.kids, b.blocks, 1, 0, 0
    for i, j in anchors(a, b) if a.known and y else ():
        total += largest(x[low:i], y[start:j], pairs) + match(x[i], y[j], pairs)
        low, start = i + 1, j + 1
    return total + largest(x[low:], y[start:], pairs)


def anchors(a: Slot, b: Node) -> list[tuple[int, int]]:
    """Places of children whose whole text was seen in a slot of a, as many as are in the same order there."""
    place = {id(s): i for i, s in enumerate(a.kids)}
    found = [(place[id(s)], j) for j, n in enumerate(b.blocks) if n.full and (s := a.known.get((n.key, n.full))) is not None]
    ends: list[int] = []  # of the increasing run of each length so far the one with the least end
    tails, back = [], [-1] * len(found)
    for k, (i, _) in enumerate(found):
        at = bisect_left(ends, i)
        back[k] = tails[at - 1] if at else -1
        ends[at : at + 1], tails[at : at + 1] = [i], [k]
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(found[k])
        k = back[k]
    return out[::-1]


def largest(x: list[Slot], y: list[Node], pairs: Pairs) -> int:
    """Simple tree matching of two child lists. Children of one shape at either end are matched at once, as no match is
    larger than one that does so; long lists of like elements cost their length then, not its square."""
    total = low = high = 0
    while low < min(len(x), len(y)) and x[low].shape == y[low].shape:
        total += match(x[low], y[low], pairs)
        low += 1
    while high < min(len(x), len(y)) - low and x[-1 - high].shape == y[-1 - high].shape:
        total += match(x[-1 - high], y[-1 - high], pairs)
        high += 1
    x, y = x[low : len(x) - high], y[low : len(y) - high]
    if not x or not y:
        return total
    found: dict[tuple[int, int], tuple[int, Pairs]] = {}
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, s in enumerate(x):
        for j, n in enumerate(y):
            size = 0
            if s.key == n.key:
                own: Pairs = []
                size = match(s, n, own)
                found[i, j] = (size, own)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size)
    i, j = len(x), len(y)
    while i and j:
        size, own = found.get((i - 1, j - 1), (0, []))
        if size and best[i][j] == best[i - 1][j - 1] + size:
            pairs += own
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return total + best[-1][-1]


def grow(pairs: Pairs) -> bool:
    """Gives slots to the nodes without a match, each after that of the node before it; whether there were any."""
    slots, new = {id(n): s for s, n in pairs}, False
    for s, n in pairs:
        at = 0
        place = {id(k): i for i, k in enumerate(s.kids)}
        kids: list[Slot] = []
        for b in n.blocks:
            if (own := slots.get(id(b))) is not None:
                kids += s.kids[at : place[id(own)] + 1]
                at = place[id(own)] + 1
            else:
                kids.append(settle(b))
                new = True
        s.kids = kids + s.kids[at:]
    return new


def settle(n: Node) -> Slot:
    """A new slot for a node, with those below it."""
    s = Slot(n)
    stack = [(s, n)]
    while stack:
        a, b = stack.pop()
        b.slot = a
        stack += zip(a.kids, b.blocks)
    return s


def contexts(page: Node) -> Iterator[tuple[Node, int]]:
    """Each node with a hash of what stands beside it in the nearest element around that has more text."""
    stack = [(page, 0)]
    while stack:
        x, around = stack.pop()
        yield x, around
        for k in x.blocks:
            rest = (x.full - k.full) & (1 << 64) - 1
            stack.append((k, rest or around))


def induce(pages: list[Node]) -> None:
    """Aligns the pages of a chunk and leaves in each node its slot, with the votes of all of them."""
    wrappers: list[Slot] = []
    for page in pages:
        best: tuple[float, Slot | None, Pairs] = (0.0, None, [])
        for wrapper in wrappers:
            pairs: Pairs = []
            alike = match(wrapper, page, pairs) / page.size
            if alike > best[0]:
                best = (alike, wrapper, pairs)
        if best[0] < ALIKE:
            wrappers.append(settle(page))
        else:
            for slot, node in best[2]:
                node.slot = slot
            if grow(best[2]):
                best[1].grown()
        for x, around in contexts(page):
            if x.own:
                x.slot.votes.setdefault(x.own, set()).add(hash((around, x.full)))
            for k in x.blocks:
                if k.full:
                    x.slot.known.setdefault((k.key, k.full), k.slot)


def constant(x: Node, least: int, share: float) -> bool:
    """Whether a node's own text is what most pages have in its slot."""
    if x.slot is None or not x.own:
        return False
    votes = x.slot.votes
    n = len(votes.get(x.own, ()))
    return n >= least and n >= share * sum(map(len, votes.values()))


def repeats(x: Node) -> bool:
    """Whether all texts of a block came again in their slots, or it has none."""
    return (not x.own or x.slot is None or len(x.slot.votes.get(x.own, ())) > 1) and all(map(repeats, x.blocks))


def links_only(x: Node) -> bool:
    """Whether a list has nothing but links."""
    def outside(n: Node) -> bool:
        return any(k.strip() if isinstance(k, str) else k.tag != "a" and outside(k) for k in n.kids)

    return x.tag in ("ul", "ol", "div", "section") and len(x.blocks) >= 2 and not outside(x)


def blocks(page: Node) -> list[str]:
    """The content slots' blocks in page order."""
    def named(k: Node, words: re.Pattern) -> bool:
        return any(words.match(w) for w in k.names) and not k.holds and 2 * k.text <= page.text

    inside: list[Node] = []

    def find(x: Node, tag: str, plain: bool) -> None:
        for k in x.blocks:
            if not k.chrome:
                if k.tag == tag or k.role == tag:
                    if not plain or not any(PLAIN.match(w) for w in k.names):
                        inside.append(k)
                elif not named(k, PLAIN):
                    find(k, tag, plain)

    for tag, plain in (("article", True), ("main", True), ("article", False), ("main", False)):
        if not inside:
            find(page, tag, plain)
    bounded, out, parts = bool(inside), [], []
    evidence = INSIDE if bounded else OUTSIDE

    def template(k: Node) -> bool:
        if k.tag == "header":  # an article's own header is part of it
            return not bounded
        if k.chrome or named(k, PLAIN):
            return True
        if named(k, WEAK):
            return not bounded or links_only(k) or k.slot is not None and repeats(k)
        return not bounded and links_only(k)

    def flush() -> None:
        if t := clean("".join(parts)):
            out.append(t)
        parts.clear()

    def walk(x: Node, quiet: bool) -> None:
        for k in x.kids:
            if isinstance(k, str):
                if not quiet:
                    parts.append(k)
            elif k.tag in BLOCK:
                flush()
                if not template(k):
                    walk(k, constant(k, *evidence))
                flush()
            elif not k.aside and not any(PLAIN.match(w) for w in k.names):
                walk(k, quiet)

    for x in inside or [page]:
        flush()
        walk(x, not bounded and constant(x, *evidence))
        flush()
    return out


def host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(pages: DataFrame, *, html: str = "html", url: str = "url", page_id: str = "page_id", induction: bool = True) -> DataFrame:
    """page_id, url and text of each page. induction: off, only the priors decide.

    A host counts as large from GROUP pages on, or, in tables of more than GROUP * MOST_GROUPED pages, from that share of
    all of them, so at most MOST_GROUPED hosts are sent to all tasks and no other host is more than such a share."""
    total = pages.count()
    least = max(GROUP, -(-total // MOST_GROUPED))
    large = pages.groupBy(host(url).alias("host")).count().where(F.col("count") > least).select("host", F.ceil(F.col("count") / least).alias("groups"))
    mark = F.xxhash64(page_id, url, html)
    rows = pages.select(host(url).alias("host"), F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), mark.alias("mark"))
    rows = rows.join(F.broadcast(large), "host", "left").withColumn("part", F.pmod("mark", F.coalesce("groups", F.lit(1))))
    tasks = min(TASKS, 1 + total // (TASK_GROUPS * GROUP))
    dealt = rows.repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "page_id", "mark").select("host", "part", "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            trees = [parse(r[2] or "") for r in rows]
            if induction:
                induce(trees)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array(["\n".join(blocks(t)) for t in trees], pa.string())], names=["page_id", "url", "text"])

        now, held, size = None, [], 0
        for batch in slices(batches, CHUNK):
            for h, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (h, part) != now:
                    yield done(held)
                    held, size = [], 0
                elif len(held) == 2 * CHUNK - 1:  # what follows has enough pages for a chunk, or joins these
                    yield done(held[:CHUNK])
                    held = held[CHUNK:]
                    size = sum(len(r[2] or "") for r in held)
                elif size > CHUNK_BYTES:
                    yield done(held)
                    held, size = [], 0
                now = (h, part)
                held.append(tuple(row))
                size += len(row[2] or "")
        if held:
            yield done(held)

    return dealt.mapInArrow(run, "page_id long, url string, text string")
