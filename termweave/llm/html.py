"""HTML extraction: wrappers inferred from a host's pages, then applied to each page.

A page's token stream becomes a tree of block elements; equal neighbours are one repeated group. Pages of a
host are aligned one after the other: parts that only some have become optional, neighbours that repeat become
repeated groups, texts become slots. The result is a union-free regular expression (concatenation, optional,
repeated, slot) that also has each slot's amount of text and of link text. Alignment merges wrappers with
wrappers, so tasks infer partial ones, which are merged by host in two levels: no task sees all pages of a host.

A host's wrapper says which element holds the article: the one named so, or else the one whose own slots hold
most text that isn't links. It also says what in the article is the template's: elements with a class whose text
is the same on all of five pages or more (a constant, not a slot), where other text of the article differs. A
page's text is what lies in the article and is neither the template's nor in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or comments.

Defined cases: null and empty html give an empty text; a page without its host's article element is read by its
own; truncated pages are read to their end; null or odd URLs share a host of their own; very long pages are read
whole; repeats and null page_ids come back row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import html as _html
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Generator, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import small_batches, stage, table
from termweave.llm.urls import host_of

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_RAW = {"script", "style", "noscript", "textarea", "template", "iframe", "svg", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul br hr".split())
_CLOSES = {  # an opening tag closes these, if they are open above the nearest of the stops
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_SKIPPED = {"nav", "footer", "aside", "form", "button", "select", "head", "menu", "dialog", "search", "input", "object", "canvas", "audio", "video"}
_WORDS = "nav navbar navigation menu header footer sidebar aside ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments reply replies respond discussion disqus share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget newsletter subscribe signup login search toolbar skip masthead copyright".split()
_NOISE = re.compile(r"(?:^|[^a-z0-9])(?:" + "|".join(_WORDS) + r")(?:$|[^a-z0-9])")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_MAIN = re.compile(r"(?:^|[^a-z0-9])(?:article|post|entry|story|content|main|maincontent|body-?text)(?:$|[^a-z0-9])")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text else {}


def walk(page: str) -> Iterator[tuple[str, object]]:
    """Events: open (tag, attributes), close tag and text of a page; unclosed elements are closed as HTML does."""
    stack: list[str] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:]
            break
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if m[1]:
            if stack and stack[-1] == tag:
                yield "close", stack.pop()
            elif tag in stack:
                while True:
                    t = stack.pop()
                    yield "close", t
                    if t == tag:
                        break
            continue
        if tag in _BLOCK and "p" in stack and tag != "br":  # a block ends an open paragraph and what it holds
            k = len(stack) - 1 - stack[::-1].index("p")
            if not any(t in _BLOCK and t != "p" for t in stack[k + 1 :]):
                while len(stack) > k:
                    yield "close", stack.pop()
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in stops:
                    break
                if stack[k] in ends:
                    while len(stack) > k:
                        yield "close", stack.pop()
        yield "open", facts(tag, m[3] if _ATTR.search(m[3]) else "") if m[3] else facts(tag, "")
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s>/]", re.I).search(page, at)
            at = end.start() if end else n
            if end and (gt := page.find(">", at)) >= 0:
                at = gt + 1
            elif end:
                at = n
            yield "close", tag
        elif tag in _VOID or m[3].rstrip().endswith("/") and tag not in _BLOCK:
            yield "close", tag
        else:
            stack.append(tag)
    while stack:
        yield "close", stack.pop()


def key_of(tag: str, attributes: dict[str, str]) -> str:
    mark = (attributes.get("class") or attributes.get("id") or "").lower().split()
    return tag + ("." + re.sub(r"\d+", "0", mark[0]) if mark else "")


_TEXTUAL = {"p", "table", "tbody", "tr", "td", "th", "pre", "blockquote", "h2", "h3", "h4", "h5", "h6", "dl", "dt", "dd", "li", "figure", "figcaption", "a", "b", "i", "em", "strong", "span", "code"}
_LOUD = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "sponsored", "cookie", "cookies", "consent", "notice", "comment", "comments", "newsletter"}
_MODIFIER = re.compile(r"^(?:no|non|not|has|have|with|without|is|in|hide|show)-")


def noisy(tag: str, attributes: dict[str, str], within: bool) -> bool:
    """Is the element boilerplate? A header counts as such outside the article only.

    Class names that say what a box has or lacks (has-sidebar, no-comment) don't make it one. Elements of running
    text are boilerplate only by a name of their own.
    """
    if tag in _SKIPPED or tag in _RAW or tag == "header" and not within or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in _ROLES:
        return True
    names = [x for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().replace("_", "-").split() if not _MODIFIER.match(x)]
    if tag in _TEXTUAL and within:
        return not _LOUD.isdisjoint(names)
    name = " ".join(names)
    if tag in ("html", "body", "article", "main", "h1") or not name.strip():
        return False
    return bool(_NOISE.search(name)) and not (within and tag == "header")


@lru_cache(10_000)
def facts(tag: str, attributes: str) -> tuple[str, str, bool, bool]:
    """An element's tag and key, and if it is boilerplate outside and within the article."""
    a = _attributes(attributes)
    return tag, key_of(tag, a), noisy(tag, a, False), noisy(tag, a, True)


# ---- wrappers: [key, repeated, optional, slot, characters, characters in links, pages, children] ----
# slot: 0 without text, the fingerprint of a constant text, or VARIES

KEY, PLUS, MAYBE, SLOT, CHARS, LINKS, SEEN, KIDS = range(8)
VARIES = -1
#: Beyond so many comparisons, children are aligned by their next equal key instead of their longest common run.
ALIGNED = 40_000
#: Pages on which a text is the same before it counts as the template's.
TEMPLATE_PAGES = 5


def run_steps(step: Generator) -> object:
    """The result of a step that yields the steps it needs: trees of any depth without recursion."""
    open_, value = [step], None
    while open_:
        try:
            step = open_[-1].send(value)
        except StopIteration as done:
            open_.pop()
            value = done.value
        else:
            open_.append(step)
            value = None
    return value


def _matched(a: list, b: list) -> list[tuple[int, int]]:
    """Places of children with equal keys, ascending in both: the ends they share, and what lies between them."""
    n, m, head = len(a), len(b), 0
    while head < min(n, m) and a[head][KEY] == b[head][KEY]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail][KEY] == b[m - 1 - tail][KEY]:
        tail += 1
    x, y = [c[KEY] for c in a[head : n - tail]], [c[KEY] for c in b[head : m - tail]]
    found: list[tuple[int, int]] = []
    if len(x) * len(y) <= ALIGNED:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                found.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        places: dict[str, list[int]] = {}
        for j, k in enumerate(y):
            places.setdefault(k, []).append(j)
        j = 0
        for i, k in enumerate(x):
            held = places.get(k, [])
            at = bisect_left(held, j)
            if at < len(held) and held[at] - j <= max(16, len(x) - i):
                found.append((i, held[at]))
                j = held[at] + 1
    return [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in found] + [(n - tail + k, m - tail + k) for k in range(tail)]


def _align(a: list, b: list) -> Generator:
    """The children of two wrappers as one list: those that match are merged, the rest is optional."""
    out, i, j = [], 0, 0
    for x, y in [*_matched(a, b), (len(a), len(b))]:
        for c in a[i:x] + b[j:y]:
            c[MAYBE] = True
            out.append(c)
        if x < len(a):
            out.append((yield _merge(a[x], b[y])))
        i, j = x + 1, y + 1
    return (yield _folded(out))


def _merge(a: list, b: list, neighbours: bool = False) -> Generator:
    """neighbours: of the same page or pages, which count once."""
    kids = (yield _align(a[KIDS], b[KIDS])) if a[KIDS] or b[KIDS] else []
    if neighbours and VARIES not in (a[SLOT], b[SLOT]) and (a[SLOT] or b[SLOT]):
        slot = zlib.crc32(b"%d %d" % (a[SLOT], b[SLOT])) or 1  # texts side by side are one constant until pages differ
    else:
        slot = a[SLOT] if a[SLOT] == b[SLOT] else VARIES
    return [a[KEY], a[PLUS] or b[PLUS], a[MAYBE] or b[MAYBE], slot, a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], max(a[SEEN], b[SEEN]) if neighbours else a[SEEN] + b[SEEN], kids]


def merge(a: list, b: list) -> list:
    return run_steps(_merge(a, b))


def _folded(children: list) -> Generator:
    """Neighbours of the same key become one repeated group."""
    out: list = []
    for c in children:
        if out and out[-1][KEY] == c[KEY]:
            maybe = out[-1][MAYBE] and c[MAYBE]
            out[-1] = yield _merge(out[-1], c, True)
            out[-1][PLUS], out[-1][MAYBE] = True, maybe
        else:
            out.append(c)
    return out


def skeleton(page: str) -> list:
    """A page's own wrapper; inline elements belong to their block's slot."""
    root: list = ["", False, False, 0, 0, 0, 1, []]
    path, depth, links = [root], [], 0
    for kind, value in walk(page):
        if kind == "open":
            tag, key, outside, within = value
            links += tag == "a"
            depth.append(tag)
            if tag in _BLOCK and tag not in _VOID and tag not in _RAW:
                if (within if "article" in depth[:-1] or "main" in depth[:-1] else outside):
                    key = "~" + key
                path.append([key, False, False, 0, 0, 0, 1, []])
        elif kind == "close":
            links -= value == "a"
            depth.pop()
            if value in _BLOCK and value not in _VOID and value not in _RAW:
                done = path.pop()
                kids = path[-1][KIDS]
                kids.append(done)
                if len(kids) > 1 and kids[-2][KEY] == done[KEY]:
                    path[-1][KIDS] = run_steps(_folded(kids))
        elif value.strip():
            path[-1][SLOT] = zlib.crc32(" ".join(value.split()).encode("utf-8", "surrogatepass"), path[-1][SLOT]) or 1
            path[-1][CHARS] += len(value)
            path[-1][LINKS] += len(value) if links else 0
    return root


def packed(w: list) -> str:
    """A wrapper as JSON: its nodes in order, each with its depth in place of its children."""
    out, todo = [], [(w, 0)]
    while todo:
        node, depth = todo.pop()
        out.append([*node[:KIDS], depth])
        todo += [(c, depth + 1) for c in reversed(node[KIDS])]
    return json.dumps(out)


def unpacked(text: str) -> list:
    path: list[list] = []
    for *facts_, depth in json.loads(text):
        node = [*facts_, []]
        del path[depth:]
        if path:
            path[-1][KIDS].append(node)
        path.append(node)
    return path[0]


def expression(w: list) -> str:
    """A wrapper as a union-free regular expression."""
    return run_steps(_expression(w))


def _expression(w: list) -> Generator:
    inner = "#" if w[SLOT] == VARIES else "=" if w[SLOT] else ""
    for c in w[KIDS]:
        inner += yield _expression(c)
    if not w[KEY]:
        return inner
    one = f"<{w[KEY]}>{inner}</>"
    return f"({one}){'+' * w[PLUS]}{'?' * w[MAYBE]}" if w[PLUS] or w[MAYBE] else one


def article_key(w: list) -> str:
    """The key of the element that holds the article, '' for the whole page."""
    found: list[tuple[int, int, str]] = []
    within: list[list] = []

    def own(node: list) -> int:
        return node[CHARS] - 2 * node[LINKS]

    def visit(node: list) -> Generator:
        if node[KEY].startswith("~"):  # its text counts nowhere, but an article may lie in it (a form or a layout around all)
            within.append(node)
            for c in node[KIDS]:
                yield visit(c)
            within.pop()
            return 0
        text, below = own(node), 0
        for c in node[KIDS]:
            t = yield visit(c)
            below += t
            if not c[KIDS] or c[KEY].split(".")[0] in ("p", "ul", "ol", "blockquote", "pre", "table", "h1", "h2", "h3", "h4"):
                text += t  # a container's own paragraphs
        tag = node[KEY].split(".")[0]
        grade = 3 if tag == "article" else 2 if tag == "main" else 1 if _MAIN.search(node[KEY]) else 0
        if node[KEY] and tag not in ("html", "body", "p", "li", "td", "h1") and (grade > 1 if within else grade or text > 0):
            found.append((grade, below + own(node) if grade else text, node[KEY]))
        return own(node) + below

    run_steps(visit(w))
    found = [f for f in found if f[1] > 0]
    return max(found)[2] if found else ""


def template_keys(w: list, article: str) -> list[str]:
    """Keys of the article's elements that are the template's: a class, and a text that is the same on all pages."""
    if not article:
        return []
    todo, constant, other, varies = [(w, False)], {}, set(), False
    while todo:
        node, inside = todo.pop()
        inside_now = inside or node[KEY].lstrip("~") == article
        if inside:
            varies |= node[SLOT] == VARIES
            tag, _, mark = node[KEY].lstrip("~").partition(".")
            text = node[SLOT] > 0 and not node[PLUS] and not any(c[SLOT] or c[KIDS] for c in node[KIDS])
            if text and mark and tag not in ("h1", "h2", "h3", "h4", "h5", "h6") and node[SEEN] >= TEMPLATE_PAGES:
                constant[node[KEY].lstrip("~")] = constant.get(node[KEY].lstrip("~"), 0) + 1
            elif node[SLOT] or node[KIDS]:
                other.add(node[KEY].lstrip("~"))
        todo += [(c, inside_now) for c in node[KIDS]]
    return sorted(k for k, n in constant.items() if n == 1 and k not in other) if varies else []


def main_text(page: str, article: str = "", template: frozenset[str] = frozenset()) -> str:
    """The text of the article's blocks, one a line, without elements with a key of the template."""
    events = list(walk(page))
    keys = {v[1] for k, v in events if k == "open"}
    if article not in keys:
        article = next((k for k in ("article", "main") if any(x.split(".")[0] == k for x in keys)), "")
        article = min((x for x in keys if x.split(".")[0] == article), default="") if article else ""
    blocks: list[str] = []
    now: list[str] = []
    skip, outer = 0, []  # open elements since the boilerplate element began; the same around each open article
    inside, open_ = (0 if article else 1), []

    def flush() -> None:
        if now:
            if text := " ".join(_html.unescape("".join(now)).split()):
                blocks.append(text)
            now.clear()

    for kind, value in events:
        if kind == "open":
            tag, key, outside, within = value
            starts = key == article
            if tag in _BLOCK:
                flush()
            if starts and inside == 0:  # an article stays whatever holds it
                outer.append(skip)
                skip = 0
            elif skip or (within or key in template if inside > 0 and article else outside) and not starts:
                skip += 1
            open_.append(starts)
            inside += starts
        elif kind == "close":
            if value in _BLOCK:
                flush()
            starts = open_.pop()
            inside -= starts
            if starts and inside == 0 and outer:
                skip = outer.pop()
            else:
                skip -= skip > 0
        elif not skip and inside:
            now.append(value)
    flush()
    return "\n".join(blocks)


def infer_wrappers(pages: DataFrame, spread: int = 32) -> DataFrame:
    """host, wrapper (JSON): partial wrappers by task, then merged by host and part, then by host."""
    small_batches(pages.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if page:
                    w = skeleton(page)
                    found[host] = merge(found[host], w) if host in found else w
            if len(found) > 5000:
                yield rows(found)
                found = {}
        yield rows(found)

    def rows(found: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "wrapper": pa.array([packed(w) for w in found.values()], pa.string())})

    def merged(key: tuple, group: pa.Table) -> pa.Table:  # all hints are needed: Spark reads them
        w = None
        for text in sorted(group.column("wrapper").to_pylist()):
            w = unpacked(text) if w is None else merge(w, unpacked(text))
        return pa.table({"host": [key[0].as_py()], "wrapper": [packed(w)]})

    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(partial, "host string, wrapper string")
    parts = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(spread))).applyInArrow(merged, "host string, wrapper string")
    return parts.groupBy("host").applyInArrow(merged, "host string, wrapper string")


#: Broadcast the article elements of at most so many hosts; join them otherwise.
BROADCAST_HOSTS = 50_000


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and the article element that the host's wrapper names."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [unpacked(x) for x in b.column("wrapper").to_pylist()]
            keys = [article_key(w) for w in ws]
            template = pa.array([template_keys(w, k) for w, k in zip(ws, keys, strict=True)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict({"host": b.column("host"), "article": pa.array(keys, pa.string()), "template": template})

    hosts = stage(infer_wrappers(pages).mapInArrow(decide, "host string, article string, template array<string>"), "wrappers")
    side = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h or "", a or "", frozenset(t or ())) for h, a, t in zip(*(b.column(c).to_pylist() for c in ("html", "article", "template")), strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": b.column("page_id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "article": b.column("article")})

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(side, "host", "left")
    return rows.select("page_id", "url", "html", "article", "template").mapInArrow(run, f"page_id {kind}, url string, text string, article string")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "article")
