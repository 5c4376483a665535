"""HTML extraction by wrapper induction.

Pages of one host share a template. One page of each host, the pivot, is aligned with every page of the host by simple tree
matching (largest number of matched nodes of equal tags, in order, by dynamic programming over child lists). A pivot node is
a slot; over the pages of the host that differ in text, each slot's values are counted, so copies of a page have one vote
together; within an article, over articles that differ. A slot whose values are mostly one value, or few values that rotate,
is template; the others vary and hold content. What holds the only article, or is a container and the only block of its
level, is never template. The content root is the slot of a container that holds most of the varying text. A page's text is
what stands under its content root, less template slots and less nodes that by tag, class or role are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments.

Defined results: null or empty html gives an empty text. A page that has no node at the content root is read from its body by
tag, class and role alone. Pages with a null url form one host. Repeated rows give repeated results. An empty table gives no
rows. Elements may be nested to any depth.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import Scratch

#: pivots of all hosts together are broadcast up to this size, and joined by shuffle beyond it
BROADCAST_MB = 32
#: the pages of one host are dealt to so many join keys where pivots are not broadcast
SALTS = 64
#: different pages that must fill a slot before its values can make it template
EVIDENCE = 20

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math xmp".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("article body center div main section table tbody td tr html".split())
SKIPPED = frozenset("nav footer aside form button select option label dialog menu head object audio video canvas".split()) | RAW
SKIPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent
cookie cookies disqus footer login menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related
respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
HEADERS = frozenset("header masthead topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: a start tag of the key ends an open element of the values
ENDS = {t: {"p"} for t in BLOCKS} | {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
                                    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl article section div main body html td th blockquote form aside nav header footer".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("tag", "words", "roles", "children", "slot")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.slot = tag, [], None
        self.words, self.roles = frozenset(), frozenset()
        if attributes and "=" in attributes:
            found = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in NAMED.finditer(attributes)]
            self.words = frozenset(w for k, v in found if k != "role" for w in re.split(r"[^a-z0-9]+", v))
            self.roles = frozenset(v for k, v in found if k == "role")

    def elements(self) -> list["Node"]:
        return [c for c in self.children if not isinstance(c, str)]


def parse(page: str) -> Node:
    """A tree that is always made, whatever is left open, closed twice or cut off."""
    root = Node("html")
    stack, at, n = [root], 0, len(page)
    open_: Counter[str] = Counter()

    def close(k: int) -> None:
        open_.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            stack[-1].children.append(entities.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        ended = ENDS.get(tag, ())
        for k in range(len(stack) - 1, 0, -1) if any(open_[t] > 0 for t in ended) else ():
            if stack[k].tag in ended:
                close(k)
                break
            if stack[k].tag in SCOPES:
                break
        attributes = m[3] or m[6] or ""
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            closed = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = closed.end() if closed else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def skipped(node: Node, inside: bool) -> bool:
    """Template by its own tag, class, id or role; a header inside an article may hold its title."""
    return (node.tag in SKIPPED or bool(node.words & SKIPPED_WORDS) or bool(node.roles & ROLES)
            or not inside and (node.tag in HEADERS or bool(node.words & HEADERS)))


def align(pivot: Node, page: Node) -> None:
    """Simple tree matching; each matched node of ``page`` gets the slot number of its pivot node."""
    table: dict[tuple[int, int], tuple[int, list[list[int]]]] = {}
    inner: dict[int, list[Node]] = {}

    def below(node: Node) -> list[Node]:
        if id(node) not in inner:
            inner[id(node)] = node.elements()
        return inner[id(node)]

    # pairs of equal tags from the roots down; each is solved after the pairs of its children, at any depth
    pairs = [(pivot, page)] if pivot.tag == page.tag and below(pivot) and below(page) else []
    for a, b in pairs:
        pairs.extend((p, q) for p in below(a) if below(p) for q in below(b) if p.tag == q.tag and below(q))
    for a, b in reversed(pairs):
        y = below(b)
        m = [[0] * (len(y) + 1)]
        for p in below(a):
            above, row = m[-1], [0]
            for j, q in enumerate(y):
                best = above[j + 1] if above[j + 1] > row[j] else row[j]
                if p.tag == q.tag:
                    solved = table.get((id(p), id(q)))
                    w = above[j] + (solved[0] if solved else 1)
                    best = w if w > best else best
                row.append(best)
            m.append(row)
        table[id(a), id(b)] = (m[-1][-1] + 1, m)
    todo = [(pivot, page)]
    while todo:
        a, b = todo.pop()
        b.slot = a.slot
        if (id(a), id(b)) not in table:
            continue
        m, x, y = table[id(a), id(b)][1], below(a), below(b)
        i, j = len(x), len(y)
        while i and j:
            # equal ways: the earliest pair, so extra nodes of a page stand behind those of the pivot
            if m[i][j] == m[i][j - 1]:
                j -= 1
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x[i], y[j]))


def numbered(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.slot = len(out)
        out.append(node)
        stack.extend(reversed(node.elements()))
    return out


def text_of(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x.children))
            if x.tag in BLOCKS or x.tag == "br":
                stack.append(" ")
    return " ".join("".join(out).split())


def texts(root: Node) -> Iterator[tuple[Node, str]]:
    """Every element with its ``text_of``, innermost first. A text is made of its parts' texts, so deep nests are not read again at each level."""
    order, made = [root], {}
    for node in order:
        order.extend(node.elements())
    for node in reversed(order):
        parts = [p for c in node.children if (p := c if isinstance(c, str) else made.pop(id(c)))]
        if (node.tag in BLOCKS or node.tag == "br") and not (parts and parts[0][0] == " "):
            parts.insert(0, " ")
        whole = parts[0] if len(parts) == 1 else "".join(parts)
        words = " ".join(whole.split())
        made[id(node)] = (" " if whole[:1].isspace() else "") + words + (" " if words and whole[-1].isspace() else "")
        yield node, words


def blocks(root: Node, template: frozenset[int], inside: bool) -> list[str]:
    """Texts of the blocks under ``root`` in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [(root, inside)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        else:
            node, within = x
            if node is not root and (skipped(node, within) or node.slot in template):
                continue
            block = node.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            elif node.tag == "br":
                line.append(" ")
            within = within or node.tag in ("article", "main")
            stack.extend(c if isinstance(c, str) else (c, within) for c in reversed(node.children))
    flush()
    return out


def _walk(root: Node) -> Iterator[tuple[Node, Node | None, bool]]:
    """(node, its container, inside an article) of what is not skipped."""
    stack: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while stack:
        node, parent, inside = stack.pop()
        if skipped(node, inside):
            continue
        yield node, parent, inside
        inside = inside or node.tag in ("article", "main")
        stack.extend((c, node, inside) for c in node.elements())


def _slots(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each page and matched slot: the text of its article or page as a hash, the value's hash and length; only containers and blocks have values."""
    pivots: dict[str, Node] = {}
    for frame in frames:
        out = []
        for host, page, pivot in zip(frame["host"], frame["html"], frame["pivot"]):
            if host not in pivots:
                pivots[host] = parse(pivot or "")
                numbered(pivots[host])
            tree = parse(page or "")
            align(pivots[host], tree)
            values = {id(node): (_stable(text), len(text)) for node, text in texts(tree) if node.tag in BLOCKS}
            within: dict[int, int] = {}
            for node, parent, _ in _walk(tree):
                around = within[id(parent)] if parent else values[id(tree)][0]
                within[id(node)] = values[id(node)][0] if node.tag in ("article", "main") else around
                if node.slot is not None and (node.tag in BLOCKS):
                    out.append((host, around, node.slot, *values[id(node)]))
        yield pd.DataFrame(out, columns=["host", "page", "slot", "value", "length"])


def _stable(text: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def never_template(pivot: Node) -> frozenset[int]:
    """Slots from the root down to the only article or main part, or else down containers that are the only block of their level."""
    out, node = {pivot.slot}, pivot
    while True:
        outer = _outermost(node)
        if len(outer) == 1:
            path = outer[0]
        elif not outer:
            path = [c for c in node.elements() if c.tag in BLOCKS and not skipped(c, False)]
            if len(path) != 1 or path[0].tag not in CONTAINERS:
                return frozenset(out)
        else:
            # several articles: what holds all of them
            path = [a for a in outer[0] if all(any(a is b for b in p) for p in outer)]
            return frozenset(out | {n.slot for n in path})
        out.update(n.slot for n in path)
        node = path[-1]


def _outermost(node: Node) -> list[list[Node]]:
    """Of each article or main part below ``node`` that is in no other: the elements from below ``node`` to it."""
    out, above = [], {}
    stack = [(c, node) for c in reversed(node.elements())]
    while stack:
        x, parent = stack.pop()
        if skipped(x, False):
            continue
        above[id(x)] = parent
        if x.tag in ("article", "main"):
            path = [x]
            while above[id(path[-1])] is not node:
                path.append(above[id(path[-1])])
            out.append(path[::-1])
        else:
            stack.extend((c, x) for c in reversed(x.elements()))
    return out


def content_root(pivot: Node, varying: dict[int, float]) -> int:
    """The innermost container slot that holds most of what varies, on the average of pages."""
    best = pivot
    while True:
        inner = [c for c in best.elements() if c.tag in CONTAINERS and not skipped(c, False)]
        inner = [c for c in inner if varying.get(c.slot, 0.0) > 0.6 * varying.get(best.slot, 0.0) > 0]
        if not inner:
            return best.slot
        best = max(inner, key=lambda c: varying[c.slot])


def _extract(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    wrappers: dict[str, tuple[Node, int, frozenset[int]]] = {}
    for frame in frames:
        out = []
        for page_id, url, page, host, pivot, facts in zip(frame["page_id"], frame["url"], frame["html"], frame["host"], frame["pivot"], frame["facts"]):
            if host not in wrappers:
                tree = parse(pivot or "")
                numbered(tree)
                facts = list(facts) if facts is not None else []
                template = frozenset(f["slot"] for f in facts if f["template"]) - never_template(tree)
                wrappers[host] = (tree, content_root(tree, {f["slot"]: 0.0 if f["slot"] in template else f["length"] for f in facts}), template)
            tree, root, template = wrappers[host]
            own = parse(page or "")
            align(tree, own)
            start, inside = own, False
            for node, _, within in _walk(own):
                if node.slot == root:
                    start, inside = node, within or node.tag in ("article", "main")
                    break
            else:
                template = frozenset()
            text = "\n".join(blocks(start, template - {root}, inside))
            out.append((page_id, url, text, len(text)))
        yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    scratch = Scratch(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    # any complete page serves; the smallest hash is a fixed choice
    order = F.struct((~F.coalesce(F.contains(F.lower("html"), F.lit("</body")), F.lit(False))).alias("cut"), F.xxhash64("html").alias("h"))
    pivots = scratch.keep(rows.groupBy("host").agg(F.min_by("html", order).alias("pivot")))
    size = (pivots.agg(F.sum(F.octet_length("pivot"))).first()[0] or 0) / 1e6

    def with_host(table: DataFrame, facts: DataFrame) -> DataFrame:
        if size <= BROADCAST_MB:
            return table.join(F.broadcast(facts), "host", "left")
        salted = table.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)))
        return salted.join(facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "salt"], "left").drop("salt")

    values = with_host(rows, pivots).select("host", "html", "pivot").mapInPandas(_slots, "host string, page long, slot int, value long, length int")
    # one vote for each different page, however often it comes back
    votes = values.groupBy("host", "page", "slot", "value").agg(F.max("length").alias("length"))
    counted = votes.groupBy("host", "slot", "value").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    slots = counted.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.count("*").alias("distinct"), F.max("n").alias("most"), F.sum("length").alias("length"))
    # one value on nearly all pages, or values that come back ten times on the average; few pages prove nothing
    template = (F.col("pages") >= EVIDENCE) & ((5 * F.col("most") > 4 * F.col("pages")) | (F.col("pages") >= 10 * F.col("distinct")))
    slots = slots.select("host", F.struct("slot", template.alias("template"), F.col("length").cast("double").alias("length")).alias("fact"))
    wrappers = scratch.keep(slots.groupBy("host").agg(F.collect_list("fact").alias("facts")).join(pivots, "host", "right"))
    return with_host(rows, wrappers).select("page_id", "url", "html", "host", "pivot", "facts").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
