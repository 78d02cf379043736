"""HTML extraction by wrapper induction.

Pages of a host share a template. Every page becomes a small tree of elements; up to EXEMPLARS pages of each host are its exemplars,
and all others are aligned with each by simple tree matching (the largest order-preserving match of two trees; among those, one
with the most equal texts). Nodes that hold the same text in nearly all pages that could hold it are template, inside an article element as
outside, but for headings inside one, as articles of one kind name their sections alike; nodes that nearly always hold little but links are menus, and go outside an article element; nodes whose text varies, or that all
exemplars lack, are slots. Slots hold content, but also what varies without being content: block elements that say so by tag, role or
a whole class name are left out. A node is template or menu only on the word of LOOSE pages of different articles.

Only small trees of hashes are shuffled, with few exemplars a host; votes are summed inside each task first, so a host with a
third of all pages is spread like any other. Texts stay where they are read: the induced templates, whose size Spark
checks, meet the pages in a join that Spark broadcasts while they are small and shuffles beyond."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .url_filter import host_of

#: Fixed values of HTML: void elements, elements of raw text, and elements that stand on lines of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An open element of the second kind ends where one of the first kind begins.
CLOSES = {t: ("p",) for t in BLOCK - {"html", "body", "head"}} | {
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",),
}
SCOPE = frozenset("article section div ul ol dl table main body aside nav footer header form blockquote td th".split())

#: Elements, roles and class or id words that mark what is not the article.
OUT_TAGS = frozenset("nav footer aside form script style noscript template head title iframe button select textarea svg object canvas menu dialog input label xmp noembed noframes".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup social share sharing related recommended comment comments "
    "commentlist reply replies disqus respond widget toolbar masthead topbar copyright skip pagination pager".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words that may stand beside OUT_WORDS in a class name, as in ``ad-box``; beside others, as in ``ad-hoc``, they say nothing.
PLAIN_WORDS = frozenset("box wrap wrapper container block section area bar list item items link links inner outer top bottom left right main unit slot holder panel content text header title body group col column row js site page post article inline fixed sticky".split())
#: A quoted value ends at a quote that white space, ``/`` or ``>`` follows; quotes anywhere else are characters like others.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!doctype[^>\[]*(?:\[.*?\]\s*)?>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))|=)*+)>|<[!?/][^>]*>""", re.S | re.I
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
DIGITS = re.compile(r"\d+")


class Node:
    __slots__ = ("label", "tag", "out", "parts")

    def __init__(self, tag: str, label: str, out: bool):
        self.tag, self.label, self.out = tag, label, out
        self.parts: list = []  # texts and nodes, in page order


def _says_out(name: str) -> bool:
    """Whether a class or id is made of OUT_WORDS, beside PLAIN_WORDS at most."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in OUT_WORDS for w in words) and all(w in OUT_WORDS or w in PLAIN_WORDS for w in words)


def _node(tag: str, attributes: str) -> Node:
    names: list[str] = []
    role = ""
    if attributes:
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id"):
                names += (a or b or c).lower().split()
            elif name == "role":
                role = (a or b or c).strip().lower()
            elif name == "hidden":
                role = "alert"
    out = tag in OUT_TAGS or tag in BLOCK and tag not in ("html", "body", "main", "article") and (role in OUT_ROLES or any(map(_says_out, names)))
    label = tag + ("." + DIGITS.sub("#", ".".join(names)) if names else "")
    return Node(tag, label, out)


def parse(page: str | None) -> Node:
    """A forgiving parse: end tags close down to their element or are ignored, paragraphs and items end where the next begins,
    raw-text elements are left out with their text. Character references stay as they are."""
    root = Node("", "", False)
    page = page or ""
    stack, at = [root], 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in SCOPE:
                    break
            continue
        if ends := CLOSES.get(tag):
            k = len(stack) - 1
            while k and stack[k].tag not in SCOPE:
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                k -= 1
            if k and stack[-1].tag in ends and tag in ("td", "th", "tr"):
                del stack[k:]
        node = _node(tag, m[3])
        stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


class Slot:
    """A node of the small tree. h hashes the texts directly below, in order; words and linked count theirs."""

    __slots__ = ("label", "kids", "h", "nodes", "words", "linked")

    def __init__(self, label: int):
        self.label, self.nodes = label, []
        self.words = self.linked = 0
        self.kids: list[Slot] = []
        self.h = xxhash.xxh64()


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) >> 1


def shrink(root: Node) -> Slot:
    """The small tree: a slot for each block, however many a page has."""
    top = Slot(0)
    stack = [(root, top, False)]
    while stack:
        node, slot, link = stack.pop()
        slot.nodes.append(node)
        below = []
        for part in node.parts:
            if isinstance(part, str):
                if words := part.split():
                    slot.words += len(words)
                    slot.linked += len(words) * link
                    slot.h.update(" ".join(words).encode("utf-8", "surrogatepass") + b"\n")
            elif part.tag not in RAW:
                if part.tag in BLOCK:
                    slot.kids.append(Slot(_hash(part.label)))
                    below.append((part, slot.kids[-1], link))
                else:
                    below.append((part, slot, link or part.tag == "a"))  # inline text belongs to its block
        stack.extend(reversed(below))
    return top


def flat(top: Slot) -> tuple[list[int], list[int], list[int], list[bool], list[Slot]]:
    """Preorder: labels, depths, text hashes, whether nine tenths of the words below are links, slots."""
    labels, depths, texts, words, linked, slots = [], [], [], [], [], []
    stack = [(top, 0)]
    while stack:
        slot, depth = stack.pop()
        labels.append(slot.label)
        depths.append(depth)
        texts.append(slot.h.intdigest() >> 1)
        words.append(slot.words)
        linked.append(slot.linked)
        slots.append(slot)
        stack.extend((k, depth + 1) for k in reversed(slot.kids))
    path: list[int] = []
    for i in range(len(depths) - 1, 0, -1):  # children come after their parent, so sums go up in one sweep
        while path and depths[path[-1]] > depths[i]:
            j = path.pop()
            if depths[j] == depths[i] + 1:
                words[i] += words[j]
                linked[i] += linked[j]
        path.append(i)
    return labels, depths, texts, [0 < 9 * w <= 10 * n for w, n in zip(words, linked)], slots


def _children(depths: list[int]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in depths]
    path: list[int] = []
    for i, d in enumerate(depths):
        del path[d:]
        if path:
            kids[path[-1]].append(i)
        path.append(i)
    return kids


#: Tables of more cells are made by numpy, a row at a time; of smaller ones up to MOST_CELLS cells in all are kept for the way back.
WIDE, MOST_CELLS = 4096, 1 << 20
#: Two trees with more pairs of nodes have equal subtrees told first.
MANY = 1 << 14


def _classes(labels: list[int], kids: list[list[int]], texts: list[int] | None, common: set[int]) -> list[int]:
    """The same number for subtrees of the same shape, labels and texts; texts that the other tree lacks count as one."""
    found: dict[tuple, int] = {}
    out = [0] * len(labels)
    for i in range(len(labels) - 1, -1, -1):
        text = texts[i] if texts is not None and texts[i] in common else -1
        out[i] = found.setdefault((labels[i], text, *[out[k] for k in kids[i]]), len(found))
    return out


def match(la: list[int], da: list[int], lb: list[int], db: list[int], ta: list[int] | None = None, tb: list[int] | None = None, ka: list | None = None, kb: list | None = None) -> dict[int, int]:
    """Simple tree matching: b's node -> a's node for a largest match that keeps labels, order and ancestry; among the largest, one with
    the most equal texts, if these are given. Trees are preorder labels and depths (and their _children(), if known), of any size: in large ones pairs of equal subtrees are scored
    once, and of a wide table only every so many rows are held, the others made again on the way back. The match is the same either way."""
    if not la or not lb or la[0] != lb[0]:
        return {}
    ka, kb = ka or _children(da), kb or _children(db)
    ca, cb, many = range(len(la)), range(len(lb)), len(lb)
    if len(la) * len(lb) > MANY:
        common = set(ta) & set(tb) if ta is not None else set()
        ca, cb = _classes(la, ka, ta, common), _classes(lb, kb, tb, common)
    score: dict[int, int] = {}
    tables: dict[int, list[list[int]]] = {}
    one, two = 1 << 32, (1 << 32) + 1

    def table(i: int, j: int) -> list[list[int]]:
        b = kb[j]
        row = [0] * (len(b) + 1)
        m = [row]
        for u in ka[i]:
            label, left, before, row, at = la[u], 0, row, [0], ca[u] * many
            for y, v in enumerate(b):
                best = before[y + 1]
                if left > best:
                    best = left
                if label == lb[v]:
                    both = before[y] + (score.get(at + cb[v]) or (two if ta is not None and ta[u] == tb[v] else one))
                    if both > best:
                        best = both
                row.append(best)
                left = best
            m.append(row)
        return m

    def rows(j: int):
        """The first row of a table of j's children, and what makes the next one, given a child of i."""
        b = kb[j]
        labels, inner = np.array([lb[v] for v in b], np.int64), np.array([y for y, v in enumerate(b) if kb[v]], np.int64)
        gains = {x: np.where(labels == x, one, 0) for x in {lb[v] for v in b}}
        texts, held = (None, ()) if tb is None else (np.array([tb[v] for v in b], np.int64), {tb[v] for v in b})
        kinds, which = np.unique(np.array([cb[b[y]] for y in inner.tolist()], np.int64), return_inverse=True)
        kinds = kinds.tolist()

        def after(before: np.ndarray, u: int) -> np.ndarray:
            if la[u] not in gains:
                return before
            gain = gains[la[u]]
            if ta is not None and ta[u] in held:
                gain = gain + ((gain > 0) & (texts == ta[u]))
            if ka[u] and kinds:
                at, gain = ca[u] * many, gain.copy()
                gain[inner] = np.array([score.get(at + k, 0) for k in kinds], np.int64)[which]  # a pair with a leaf has its own nodes alone
            row = np.zeros(len(b) + 1, np.int64)
            np.add(before[:-1], gain, out=row[1:])
            np.maximum(row[1:], before[1:], out=row[1:])
            return np.maximum.accumulate(row, out=row)

        return np.zeros(len(b) + 1, np.int64), after

    def inner_pairs(i: int, j: int):
        us, vs = [u for u in ka[i] if ka[u]], [v for v in kb[j] if kb[v]]
        if len(us) * len(vs) < 50:
            return iter([(u, v) for u in us for v in vs if la[u] == lb[v]])
        us, vs = {ca[u]: u for u in us}.values(), {cb[v]: v for v in vs}.values()
        return ((u, v) for u in us for v in vs if la[u] == lb[v])

    cells = 0
    todo = [(0, 0, inner_pairs(0, 0))] if ka[0] and kb[0] else []
    while todo:
        i, j, rest = todo[-1]
        for u, v in rest:
            if ca[u] * many + cb[v] not in score:
                todo.append((u, v, inner_pairs(u, v)))
                break
        else:
            todo.pop()
            size = len(ka[i]) * len(kb[j])
            if size <= WIDE:
                m = table(i, j)
                last = m[-1][-1]
                if (cells := cells + size) <= MOST_CELLS:
                    tables[ca[i] * many + cb[j]] = m
            else:
                row, after = rows(j)
                for u in ka[i]:
                    row = after(row, u)
                last = int(row[-1])
            score[ca[i] * many + cb[j]] = last + (two if ta is not None and ta[i] == tb[j] else one)
    pairs, back = {}, [(0, 0)]
    while back:
        i, j = back.pop()
        pairs[j] = i
        x, y = len(ka[i]), len(kb[j])
        if not x or not y:
            continue
        step, after = x, None
        if x * y <= WIDE:
            held = [tables.get(ca[i] * many + cb[j]) or table(i, j)]
        else:
            row, after = rows(j)
            held, step = [], math.isqrt(x) + 1
            for k, u in enumerate(ka[i]):
                if k % step == 0:
                    held.append([row])
                row = after(row, u)
        while held:
            m, first = held.pop(), len(held) * step
            if after:
                for u in ka[i][first : first + step]:
                    m.append(after(m[-1], u))
            while x > first and y:
                now, before = m[x - first], m[x - first - 1]
                if now[y] == before[y]:
                    x -= 1
                elif now[y] == now[y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    back.append((ka[i][x], kb[j][y]))
    return pairs


def _space(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def blocks(root: Node, template: set[int] | None = None, menus: set[int] | None = None) -> list[str]:
    """Texts of the blocks of the article in page order, without what OUT_* mark, without the own texts of template nodes and without
    menus with all that is in them (both by id()). The
    article is all article elements, else all main elements, else the whole page."""
    template, menus = template or set(), menus or set()
    homes = _homes(root)
    found: list[str] = []
    for home in homes:
        open_: list[str] = []

        def flush() -> None:
            if text := _space(open_):
                found.append(text)
            open_.clear()

        stack: list = [(home, False)]
        while stack:
            part, header = stack.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                if not header:
                    open_.append(part)
            elif part.tag == "br" or part.tag == "img":
                open_.append(" ")
            elif (part.out or id(part) in menus) and part is not home:
                if part.tag in BLOCK:
                    flush()
            else:
                inside = (header or part.tag == "header") and part.tag not in HEADINGS
                own = [x for x in part.parts if not isinstance(x, str)] if id(part) in template else part.parts
                if part.tag in BLOCK:
                    flush()
                    stack.append((None, False))
                stack.extend((x, inside) for x in reversed(own))
        flush()
    return found


def _homes(root: Node) -> list[Node]:
    """The outermost article elements that are not themselves left out; else main elements; else the root."""
    for want in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == want and not node.out:
                found.append(node)
            elif not node.out:
                stack.extend(p for p in reversed(node.parts) if not isinstance(p, str))
        if found:
            return found
    return [root]


TREE = "struct<labels:array<bigint>,depths:array<int>,texts:array<bigint>,menus:array<boolean>>"


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, contents, rows = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            root = parse(page.as_py())
            labels, depths, texts, menus, _ = flat(shrink(root))
            hosts.append(host)
            contents.append(_hash("\n\n".join(blocks(root))))
            rows.append({"labels": labels, "depths": depths, "texts": texts, "menus": menus})
        kind = pa.struct([("labels", pa.list_(pa.int64())), ("depths", pa.list_(pa.int32())), ("texts", pa.list_(pa.int64())), ("menus", pa.list_(pa.bool_()))])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(rows, kind)], ["host", "content", "tree"])


def _lists(array: pa.Array) -> list[list]:
    """The values of an array of lists without nulls; to_pylist() would make a scalar of each first."""
    ends, values = array.offsets.to_pylist(), array.values.to_numpy(zero_copy_only=False).tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


#: Hosts whose templates or exemplars a task keeps as Python lists.
MOST_HOSTS = 200


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, exemplar, its node, pages that have a node of this label where the parent is matched, those whose match has equal text, those whose
    match is a menu; summed within the task."""
    got: dict = defaultdict(lambda: [0, 0, 0])
    known: dict = {}
    for batch in batches:
        fields = ("labels", "depths", "texts", "menus")
        trees, exemplars = batch.column("tree"), batch.column("exemplar")
        rows = zip(batch.column("host").to_pylist(), batch.column("k").to_pylist(), *(_lists(trees.field(f)) for f in fields))
        for at, (host, k, labels, depths, texts, menus) in enumerate(rows):
            if (host, k) not in known:
                if len(known) >= MOST_HOSTS:
                    known.clear()
                known[host, k] = a = exemplars[at].as_py()
                a["below"] = _children(a["depths"])
            a = known[host, k]
            below_a, below_b, texts_a, menus_a, labels_a = a["below"], _children(depths), a["texts"], a["menus"], a["labels"]
            pairs = match(labels_a, a["depths"], labels, depths, texts_a, texts, below_a, below_b)
            got[host, k, 0][0] += 1
            for j, i in pairs.items():
                votes = got[host, k, i]
                votes[1] += texts_a[i] == texts[j]
                votes[2] += menus_a[i] and menus[j]
                if below_a[i]:
                    held = {labels[v] for v in below_b[j]}
                    for u in below_a[i]:
                        got[host, k, u][0] += labels_a[u] in held
    keys = list(got)
    columns = [*([k[x] for k in keys] for x in range(3)), *([got[k][x] for k in keys] for x in range(3))]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "k", "node", "met", "same", "menu"])


LOOSE = 4
EXEMPLARS = 3


def induce(pages: DataFrame, host: str, page: str, share: float = 0.9) -> DataFrame:
    """(host, templates): the tree of each of a host's exemplars, its template nodes and its menus, on the word of LOOSE pages or more.
    Pages of one article, whatever stands around it, vote once; rows of null or empty host have no template."""
    trees = pages.where(F.col(host) != "").select(F.col(host).alias("host"), F.col(page).alias("page")).mapInArrow(_skeletons, f"host string, content bigint, tree {TREE}")
    trees = trees.withColumn("h", F.xxhash64("tree")).groupBy("host", "content").agg(F.min_by("tree", "h").alias("tree"), F.min("h").alias("h"))
    trees = written(trees.select("host", "tree", "h"), "page-trees")
    # written, so that Spark knows their size: small ones are broadcast and no host's pages meet in one task; large ones meet in a
    # join whose hot keys it splits
    k = F.pmod("h", F.lit(EXEMPLARS)).cast("int").alias("k")
    exemplars = written(trees.groupBy("host", k).agg(F.min_by(F.struct("h", "tree"), "h").alias("e")).select("host", "k", F.col("e.h").alias("first"), F.col("e.tree").alias("exemplar")), "page-exemplars")
    votes = trees.join(exemplars, "host").where("h <> first").select("host", "k", "tree", "exemplar")
    votes = votes.mapInArrow(_votes, "host string, k int, node int, met bigint, same bigint, menu bigint")
    same, menu = F.col("same") >= share * F.col("met"), F.col("menu") >= share * F.col("met")
    summed = votes.groupBy("host", "k", "node").agg(*(F.sum(c).alias(c) for c in ("met", "same", "menu"))).where((F.col("met") >= LOOSE) & (same | menu))
    listed = summed.groupBy("host", "k").agg(*(F.sort_array(F.collect_list(F.when(c, F.col("node")))).alias(n) for c, n in ((same, "constant"), (menu, "linked"))))
    whole = exemplars.join(listed, ["host", "k"]).select("host", F.struct("k", "exemplar.labels", "exemplar.depths", "exemplar.texts", "constant", "linked").alias("t"))
    return whole.groupBy("host").agg(F.sort_array(F.collect_list("t")).alias("templates"))


def extract_page(page: str | None, templates: list[dict] | None = None) -> str:
    """The main text of one page, given its host's templates if it has any. A node is left out as constant only if its text is the template's
    own and it is no heading of the article, as a menu only outside the article and if it is one here too."""
    root = parse(page)
    template: set[int] = set()
    gone: set[int] = set()
    if templates:
        labels, depths, texts, menus, slots = flat(shrink(root))
        inside = {id(n) for home in _homes(root) if home is not root for n in _within(home)}
        below = _children(depths)
        for t in templates:
            constant, linked = set(t["constant"]), set(t["linked"])
            for j, i in match(t["labels"], t["depths"], labels, depths, t["texts"], texts, t.get("below"), below).items():
                if i in constant and t["texts"][i] == texts[j]:
                    template |= {id(n) for n in slots[j].nodes if n.tag not in HEADINGS or id(n) not in inside}
                if j and i in linked and menus[j]:
                    gone |= {id(n) for n in slots[j].nodes if id(n) not in inside and n.tag in BLOCK}
    return "\n\n".join(blocks(root, template, gone))


def _within(home: Node) -> list[Node]:
    found, stack = [], [home]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(p for p in node.parts if not isinstance(p, str))
    return found


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        pages, templates, texts = batch.column("__html"), batch.column("templates"), []
        for at, host in enumerate(batch.column("__host").to_pylist()):
            if host not in known:
                if len(known) >= MOST_HOSTS:
                    known.clear()
                known[host] = templates[at].as_py() or []
                for t in known[host]:
                    t["below"] = _children(t["depths"])
            texts.append(extract_page(pages[at].as_py(), known[host]))
        out = [batch.column("__id"), batch.column("__url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(out, ["__id", "__url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html", share: float = 0.9) -> DataFrame:
    """Per row of pages: id_col, url, text (empty if none) and n_chars (code points).

    Null html counts as empty and has no text; pages of any length count whole and are aligned block by block, whatever their number (matching
    takes time for the product of two pages' blocks at most, numpy's for long lists of siblings). Rows of null URL, or of a host with fewer than LOOSE + 1
    different articles, have no template and keep all of the article. Of a host's pages those of the least hashes are its exemplars; equal
    hashes are equal trees. Repeated rows and null ids each keep a row; an empty table gives none. Other columns are not read."""
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url).alias("__url"), F.col(page).alias("__html"), host_of(F.col(url)).alias("__host"))
    templates = written(induce(rows, "__host", "__html", share), "page-templates")
    met = rows.join(templates, rows["__host"] == templates["host"], "left").select("__id", "__url", "__html", "__host", "templates")
    kinds = dict(rows.dtypes)
    out = met.mapInArrow(_extract, f"__id {kinds['__id']}, __url string, text string, n_chars bigint")
    return out.select(F.col("__id").alias(id_col), F.col("__url").alias(url), "text", "n_chars")
