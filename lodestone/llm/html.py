"""Main text of web pages: site template removal.

Every element subtree of a page is hashed (tag, class and id without digits, texts, children), and Spark counts per host what recurs. Two
kinds of subtrees are a host's template and are deleted:

* a subtree that recurs as it is on many of the host's articles: on `share` of them at a small host, on fewer of a
  larger one (2 / sqrt(articles), 2 % at least), and on `min_pages`;
* a slot, which is an element with class, id or role, or one that HTML names as a part of the frame (nav, footer ...),
  normalised to its tag, its names without digits and those of what it stands in: if it stands on `share` of the host's
  articles and its texts recur, each on two articles or more on average (menus, adverts, notices and footers that vary
  from page to page over a limited stock).

What is counted are articles, not pages, so that copies of an article do not make its own paragraphs template: a
page's article is known by the least hash among the 3-word windows of its longest block, which copies with a few other
words mostly share. A subtree is taken for copied, and stays, if it stands on clearly fewer articles a page than its host
has (under three quarters of that, or under 0.3). So a host that is little but copies of one article has no template.
Identical pages count once. Inside an <article> or <main>, plain text blocks without class or id are never template.

What is left is read as an article: the largest <article> (else <main>, else the body), without what HTML itself names
as menu, sidebar, form or code. Where a page stands alone at its host nothing recurs; therefore elements that are named
as menus, notices, adverts and so on go too, if all parts of a class or id say so (ad-box, not ad-lib). Inside an article
only adverts, comments and the like go by such a name.

Defined results: null or empty html has empty text. Pages without a host share the host ''. Repeated rows get equal
text. Cut off tags, comments and scripts at the end of a page are dropped, their elements end there. Equally large
articles go to the first. An empty table stays empty; input columns may have any names, main_text is replaced. Pages of
any length are read whole; nothing is capped.
"""

from __future__ import annotations

import functools
import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.neardup import shingle_set
from lodestone.llm.shared import Workspace, size_checked

MIN_PAGES, SHARE, LEAST_SHARE = 5, 0.2, 0.02
#: Hosts' lists of template hashes are broadcast up to so many hashes in all, counted before.
BROADCAST_HASHES = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th b i em strong a span code figure figcaption br q u s sub sup small mark".split())
#: Start tags that end an open element of these names, up to one of the limits.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: An end tag does not reach beyond these.
WALLS = {"li": frozenset(["ul", "ol"]), "p": frozenset(["article", "main", "section", "div", "td", "li", "blockquote"])}

DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video head title nav aside footer form button select textarea input menu dialog search noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs "
    "sidebar sidebars footer cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations teasers comment comments respond reply replies disqus discussion banner masthead topbar toolbar "
    "pagination pager skip alert alerts disclaimer paywall feedback rating search".split()
)
#: Of these, what goes inside an article as well.
DROPPED_INSIDE = frozenset("ad ads advert adverts advertisement advertising adsense sponsored comments respond disqus newsletter cookie cookies consent".split())
#: Parts of a class or id that say nothing about what the element is.
VAGUE = frozenset("area bar block body bottom box buttons container content group inner item items left links list main outer page post right section site slot top unit widget widgets wrap wrapper".split())
#: Elements that are parts of a page's frame by their tag.
FRAME = frozenset("nav header footer aside menu form".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s"'/>]|$)""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)|</{t}\Z", re.I) for t in RAW}
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"

OPEN, TEXT, CLOSE = 0, 1, 2


def _named(token: str, words: frozenset[str]) -> bool:
    """Whether all parts of a class or id are among words, but for vague ones and numbers."""
    told = [p for p in re.split(r"[^a-z]+", token) if p and p not in VAGUE]
    return bool(told) and words.issuperset(told)


@functools.lru_cache(maxsize=20000)
def _names(raw: str) -> tuple[str, str, bool, bool, bool]:
    """Of an element's attributes: its class and id words, and these without digits; whether they mark it as no article,
    and as none even inside one; whether it is hidden."""
    words, dropped, inside, hidden = [], False, False, False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for w in value.split():
                words.append(w)
                dropped |= _named(w, DROPPED_WORDS)
                inside |= _named(w, DROPPED_INSIDE)
        elif name == "role":
            words.append(value)
            dropped |= not DROPPED_ROLES.isdisjoint(value.split())
            inside |= not DROPPED_ROLES.isdisjoint(value.split())
        elif name == "style":
            hidden |= bool(_HIDDEN.search(value))
        elif name == "hidden" or value == "true":
            hidden = True
    return " ".join(words), re.sub(r"\d+", "0", " ".join(words)), dropped, inside, hidden


def events(page: str):
    """(OPEN, tag, attributes), (TEXT, decoded text, '') and (CLOSE, tag, '') of a page, every element closed."""
    stack: list[str] = []
    open_p = 0  # open elements of this name, so that deep pages are not searched for them
    pos, size = 0, len(page)

    def close(down_to):
        nonlocal open_p
        while len(stack) > down_to:
            open_p -= stack[-1] == "p"
            yield CLOSE, stack.pop(), ""

    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            at = size
        if at > pos:
            yield TEXT, html.unescape(page[pos:at]), ""
        if at == size:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = size if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            pos = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, at) or _LOOSE.match(page, at)
        if m is None:
            rest = page[at + 1 : at + 3]
            if rest[:1].isalpha() or rest[:1] == "/" and (rest[1:].isalpha() or len(rest) < 2) or not rest:
                break  # a tag cut off at the end
            yield TEXT, "<", ""
            pos = at + 1
            continue
        pos, tag = m.end(), m[2].lower()
        if m[1]:
            wall = WALLS.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] == tag:
                    yield from close(i)
                    break
                if stack[i] in wall:
                    break
            continue
        if tag in BLOCK and open_p:
            i = len(stack) - 1
            while i >= 0 and stack[i] != "p" and stack[i] not in ("td", "th", "button", "table", "object"):
                i -= 1
            if i >= 0 and stack[i] == "p":
                yield from close(i)
        if tag in ENDS:
            mine, limits = ENDS[tag]
            i, top = len(stack) - 1, None
            while i >= 0 and stack[i] not in limits:
                if stack[i] in mine:
                    top = i
                i -= 1
            if top is not None:
                yield from close(top)
        yield OPEN, tag, m[3]
        if tag in VOID:
            yield CLOSE, tag, ""
        elif tag in RAW:
            end = _RAW_END[tag].search(page, pos)
            if tag in ("title", "textarea"):
                yield TEXT, html.unescape(page[pos : end.start() if end else size]), ""
            pos = end.end() if end else size
            yield CLOSE, tag, ""
        elif not (m[3].endswith("/") and tag in ("path", "svg", "g", "circle", "rect")):
            stack.append(tag)
            open_p += tag == "p"
        else:
            yield CLOSE, tag, ""
    yield from close(0)


class Node:
    __slots__ = ("tag", "words", "boring", "hidden", "parent", "inside", "hash", "slot", "letters", "end", "plain")

    def __init__(self, tag, words, boring, hidden, parent, inside):
        self.tag, self.words, self.boring, self.hidden, self.parent, self.inside = tag, words, boring, hidden, parent, inside
        self.hash, self.slot, self.letters, self.end = 0, 0, 0, 0
        self.plain = tag in PLAIN and not words


def _signed(*parts) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x01".join(parts).encode("utf-8", "surrogatepass")) - 2**63


def read(page: str) -> tuple[list, list[Node]]:
    """A page as a sequence of node numbers (opened), -1 - number (closed) and texts, and its nodes with subtree hashes."""
    walk: list = []
    nodes: list[Node] = []
    stack: list[tuple[int, list[str]]] = []
    for kind, value, raw in events(page):
        if kind == TEXT:
            walk.append(value)
            if stack:
                tight = " ".join(value.split())
                if tight:
                    stack[-1][1].append(tight)
                    nodes[stack[-1][0]].letters += len(tight)
        elif kind == OPEN:
            words, names, dropped, dropped_inside, hidden = _names(raw) if raw else ("", "", False, False, False)
            parent = stack[-1][0] if stack else -1
            up = nodes[parent] if parent >= 0 else None
            inside = up is not None and (up.inside or up.tag in ("article", "main"))
            node = Node(value, words, dropped_inside if inside else dropped, hidden, parent, inside)
            # the nearest marked element's slot, and this one's own if it is marked
            node.slot = up.slot if up is not None else 0
            if words or value in FRAME:
                node.slot = _signed(str(node.slot), value, names)
            nodes.append(node)
            stack.append((len(nodes) - 1, [value, names]))
            walk.append(len(nodes) - 1)
        else:
            number, parts = stack.pop()
            node = nodes[number]
            node.hash = _signed(*parts)
            node.end = len(walk)
            walk.append(-1 - number)
            if stack:
                stack[-1][1].append(f"\x02{node.hash}")
                nodes[stack[-1][0]].letters += node.letters
    return walk, nodes


def _may_go(nodes: list[Node]) -> list[bool]:
    """Whether each node can be template: no part of the page's own frame around an article, and no plain block in one."""
    frames = set()  # whatever an article stands in
    for n in nodes:
        if n.tag in ("article", "main"):
            at = n.parent
            while at >= 0 and at not in frames:
                frames.add(at)
                at = nodes[at].parent
    return [i not in frames and n.tag not in ("html", "body", "article", "main", "head") and not (n.inside and n.plain) for i, n in enumerate(nodes)]


def _story(walk: list, nodes: list[Node]) -> int:
    """Which article a page has: the least hash of the words of its longest block."""
    longest, current, size, at = [], [], 0, 0
    while at < len(walk):
        x = walk[at]
        at += 1
        if isinstance(x, str):
            current.extend(x.split())
            continue
        n = nodes[x if x >= 0 else -1 - x]
        if n.tag in BLOCK:
            if (total := sum(map(len, current))) > size:
                longest, size = current, total
            current = []
        if x >= 0 and (n.hidden or n.tag in DROPPED):
            at = n.end + 1
    windows = shingle_set(" ".join(current if sum(map(len, current)) > size else longest), 3)
    return int(windows[0].astype("int64")) if len(windows) else 0


EXACT, SLOT, PAGE = 0, 1, 2


def subtrees(page: str) -> tuple[int, list[tuple[int, int, int]]]:
    """The page's article, and (kind, key, text) of the subtrees with text that can be template."""
    walk, nodes = read(page)
    found = set()
    for n, may in zip(nodes, _may_go(nodes)):
        if n.letters and may:
            found.add((EXACT, n.hash, 0))
            if n.words or n.tag in FRAME:
                found.add((SLOT, n.slot, n.hash))
    return _story(walk, nodes), sorted(found)


def main_text(page: str | None, template: frozenset[int] = frozenset(), slots: frozenset[int] = frozenset()) -> str:
    """The article's blocks, joined by two line feeds."""
    if not page:
        return ""
    walk, nodes = read(page)

    def off(n: Node, may: bool) -> bool:
        if n.hidden or n.tag in DROPPED or (may and (n.hash in template or ((n.words or n.tag in FRAME) and n.slot in slots))):
            return True
        if n.tag in ("html", "body", "article", "main") and not (n.tag == "article" and n.inside):
            return False
        return n.boring or (not n.inside and (n.tag == "header" or _named(n.words, frozenset(["header"]))))

    out = [False] * len(nodes)  # in an element that is dropped
    for i, (n, may) in enumerate(zip(nodes, _may_go(nodes))):
        out[i] = (n.parent >= 0 and out[n.parent]) or off(n, may)
    root = None
    for tag in ("article", "main"):
        tops = [i for i, n in enumerate(nodes) if n.tag == tag and n.letters and not (tag == "article" and n.inside and _within(nodes, i, "article"))]
        tops = [i for i in tops if not out[i]] or ([] if tag == "article" else tops)
        if tops:
            root = max(tops, key=lambda i: (nodes[i].letters, -i))
            break
    blocks: list[str] = []
    current: list[str] = []
    start, stop = (0, len(walk)) if root is None else (walk.index(root), nodes[root].end)

    def flush():
        text = _SPACE.sub(" ", "".join(current)).strip()
        if text:
            blocks.append(text)
        current.clear()

    at = start
    while at < stop:
        x = walk[at]
        at += 1
        if isinstance(x, str):
            current.append(x)
            continue
        n = nodes[x if x >= 0 else -1 - x]
        if n.tag in BLOCK:
            flush()
        elif n.tag in ("br", "td", "th", "wbr"):
            current.append(" " * (n.tag != "wbr"))
        if x >= 0 and x != root and out[x]:
            at = n.end + 1
    flush()
    return "\n\n".join(blocks)


def _within(nodes: list[Node], i: int, tag: str) -> bool:
    at = nodes[i].parent
    while at >= 0:
        if nodes[at].tag == tag:
            return True
        at = nodes[at].parent
    return False


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, least_share: float = LEAST_SHARE) -> DataFrame:
    """_host, _template, _slots: the hashes of each host's template.

    pages: _host, _html. Pages are told apart by the digest of their html. Only what is template comes together in a
    host's lists, and those are bounded: an article has so many subtrees, and each in a list stands on `least_share` of the
    host's articles at least. Counts are combined before each shuffle and dealt by host, subtree and page, so that a
    large host is spread like the rest.
    """

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            rows = {"_host": [], "_kind": [], "_key": [], "_text": [], "_first": [], "_story": [], "_sum": []}
            for host, total, page in zip(*(batch.column(i) for i in range(3))):
                host, total = host.as_py(), total.as_py()
                story, found = subtrees(page.as_py() or "")
                last = None
                for kind, key, text in [*found, (PAGE, 0, 0)]:
                    for name, x in zip(rows, (host, kind, key, text, int((kind, key) != last), story, total)):
                        rows[name].append(x)
                    last = (kind, key)
            yield pa.record_batch([pa.array(x, pa.string() if n == "_host" else pa.int64()) for n, x in rows.items()], names=list(rows))

    seen = pages.select("_host", F.xxhash64("_html").alias("_sum"), "_html").mapInArrow(emit, "_host string, _kind long, _key long, _text long, _first long, _story long, _sum long")
    # first the texts and articles of each subtree, then how many there are of either
    by_page = seen.distinct().groupBy("_host", "_kind", "_key", "_text", "_story").agg(F.sum("_first").alias("_n"))
    counts = by_page.groupBy("_host", "_kind", "_key").agg(F.sum("_n").alias("_n"), F.count("*").alias("_o"), F.countDistinct("_story").alias("_a"), F.countDistinct("_text").alias("_d"))
    counts = counts.filter((F.col("_kind") == PAGE) | (F.col("_a") >= int(min_pages)))
    hosts = counts.filter(F.col("_kind") == PAGE).select("_host", F.col("_a").alias("_articles"), F.col("_n").alias("_pages")).filter(F.col("_articles") >= int(min_pages))
    least = F.when(F.col("_kind") == SLOT, F.lit(share)).otherwise(F.greatest(F.lit(least_share), F.least(F.lit(share), 2 / F.sqrt("_articles"))))
    apart = F.col("_a") >= F.greatest(F.lit(0.3), 0.75 * F.col("_articles") / F.col("_pages")) * F.col("_n")
    found = counts.filter(F.col("_kind") != PAGE).join(hosts, "_host").filter((F.col("_a") >= least * F.col("_articles")) & apart)
    found = found.filter((F.col("_kind") == EXACT) | (2 * F.col("_d") <= F.col("_o")))
    listed = lambda kind: F.sort_array(F.collect_list(F.when(F.col("_kind") == kind, F.col("_key"))))
    return found.groupBy("_host").agg(listed(EXACT).alias("_template"), listed(SLOT).alias("_slots"))


def extract(pages: DataFrame, *, url: str = "url", page: str = "html", keep: list[str] | None = None, min_pages: int = MIN_PAGES, share: float = SHARE, least_share: float = LEAST_SHARE) -> DataFrame:
    """The columns of pages (or those in keep) with main_text, which replaces an input column of that name.

    The pages are read twice: for the counts, of which only hashes are shuffled, and for the texts. Hosts' templates
    meet the pages without a shuffle if they are few; otherwise by a join whose hot hosts Spark splits.
    """
    work = Workspace(pages.sparkSession, "html")
    names = [c for c in (pages.columns if keep is None else keep) if c != "main_text"]
    place = {c: f"_{i}" for i, c in enumerate(pages.columns)}
    inner = pages.toDF(*place.values())
    host = F.lower(F.coalesce(F.regexp_extract(F.col(place[url]).cast("string"), _HOST, 1), F.lit("")))
    inner = inner.withColumn("_host", host).withColumn("_html", F.col(place[page]).cast("string"))
    found = work.keep(templates(inner.select("_host", "_html"), min_pages, share, least_share), "templates")
    kept = [place[c] for c in names]
    hashes = found.agg(F.sum(F.size("_template") + F.size("_slots"))).first()[0] or 0
    found = size_checked(found) if hashes <= BROADCAST_HASHES else found
    joined = inner.join(found, "_host", "left").select(*kept, "_html", "_template", "_slots")
    schema = T.StructType([*[T.StructField(p, joined.schema[p].dataType) for p in kept], T.StructField("_text", T.StringType())])

    def texts(batches):
        import pyarrow as pa

        last: tuple = (None, None, frozenset(), frozenset())
        for batch in batches:
            out = []
            for x, a, b in zip(*(batch.column(len(kept) + i) for i in range(3))):
                a, b = a.values, b.values
                if last[0] is None or not (_same(a, last[0]) and _same(b, last[1])):
                    last = (a, b, frozenset(a.to_pylist()) if a is not None else frozenset(), frozenset(b.to_pylist()) if b is not None else frozenset())
                out.append(main_text(x.as_py(), last[2], last[3]))
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(out, pa.string())], names=[*batch.schema.names[: len(kept)], "_text"])

    return joined.mapInArrow(texts, schema).toDF(*names, "main_text")


def _same(a, b) -> bool:
    return a is b or (a is not None and b is not None and a.equals(b))
