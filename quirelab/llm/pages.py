"""Main text of web pages by consensus host paths.

Each page's containers are scored by how much clean text they hold and how little else; the scores are votes for the
containers' generalised tag-class paths, summed per host in Spark. Then every page is extracted anew from the container
at its host's winning path, or from its own best container where the page has none at that path or no host. With it come its
siblings on the same path and, if it has no title of its own, the title before it and what stands between the two.

Cases: null or empty html, and html without text, give an empty text and n_chars 0. A null or relative url has no host.
Open tags, quotes and comments at the end of a page end with it. Repeated rows give repeated results. Columns besides the
three named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelab.llm.rows import map_rows
from quirelab.session import materialise

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and class words whose text is not the article's.
_DROP = frozenset("nav footer aside form button select option dialog menu svg canvas object audio video script style textarea title noscript iframe xmp noembed noframes template head".split())
_CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promos promotion banner sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs foot footer masthead "
    "comment comments commentlist disqus replies reply respond cookie cookies consent notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login social share sharing shares "
    "related recommended recommendations widget widgets toolbar pagination pager disclaimer copyright paywall topbar".split()
)
#: With one of the above first, these leave a class word about other parts of a page: ad-box, related-posts, but not related-work.
_PLAIN = frozenset(
    "0 a ad ads area articles banner bar block body bottom box button buttons center col column container content form group header holder icons inner inline item items left link links list main module outer panel part posts primary "
    "region right row secondary section slot small stories side thread text title top unit widget wide wrap wrapper".split()
)
#: Class words with one of these say what else a page has or lacks.
_ABOUT = frozenset("has with no without is show hide hidden".split())
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_HEADER_CLASS = re.compile(r"(?:^|\s)(?:(?:site|page|main|global)[-_]?)?(?:header|head)(?:$|\s)|(?:^|\s)top-?bar(?:$|\s)", re.I)
_GOOD_CLASS = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)
#: What calls itself this is not the article's if it holds links only, or talk with several authors or dates.
_LINKS, _TALK = frozenset("links linklist tags tagcloud".split()), frozenset("discussion responses reactions feedback thread conversation".split())
_BYLINE = frozenset("author user username byline date time timestamp posted avatar".split())
#: A start tag on the left ends an open element on the right.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div section article main body td th blockquote".split())
#: A page's containers below this share of its best one's score are not voted for.
VOTE_FLOOR = 0.3
_TITLES, _LEAD = frozenset(("h1", "h2", "hgroup")), frozenset("h1 h2 h3 h4 hgroup p blockquote figure ul ol dl pre table div section header".split())
#: What stands between title and container must be text at least by this share, the rest being links.
LEAD = 0.5
#: Up to this many hosts the winning paths are broadcast (well below 100 MB); beyond it Spark joins by shuffle.
BROADCAST_HOSTS = 200_000


class Node:
    __slots__ = ("tag", "parent", "drop", "clean", "total", "bonus", "path", "start", "end", "inside", "kind", "place", "anchors", "bylines")

    def __init__(self, tag: str, parent: Node | None, drop: bool, bonus: float, path: str, start: int, inside: bool, kind: str = "", place: int = 0):
        self.tag, self.parent, self.drop, self.bonus, self.path, self.start, self.end, self.inside = tag, parent, drop, bonus, path, start, -1, inside
        self.kind, self.place = kind, place
        self.clean = self.total = self.anchors = self.bylines = 0


def chrome(names: str) -> bool:
    """Whether a class word or id, taken as a whole, says that an element is not the article's: a word of _CHROME, one that
    ends with such a word (site-footer), or one that begins with one and goes on with _PLAIN words (share-buttons)."""
    for name in names.split():
        parts = [re.sub(r"\d+", "0", x.lower()) for x in _PARTS.split(name) if x]
        if not parts or _ABOUT.intersection(parts):
            continue
        if parts[-1] in _CHROME or parts[0] in _CHROME and all(x in _PLAIN or x in _CHROME for x in parts[1:]):
            return True
    return False


def _words(names: str) -> set[str]:
    return {x.lower() for x in _PARTS.split(names.replace(" ", "-"))}


def _segment(tag: str, classes: str, name: str) -> str:
    """The tag with its classes and id, numbers in them made equal."""
    general = sorted({re.sub(r"\d+", "0", c.lower()) for c in classes.split()})
    return ".".join([tag, *general]) + (f"#{re.sub(r'[0-9]+', '0', name.lower())}" if name else "")


def _join(path: str, segment: str) -> str:
    joined = f"{path}>{segment}"
    return joined if len(joined) <= 400 else "~" + hashlib.blake2b(joined.encode("utf-8", "replace"), digest_size=12).hexdigest()


def parse(page: str) -> tuple[list[tuple[str, bool]], list[Node]]:
    """Text pieces (text, whether it is the article's or not; "" ends a block), and the elements, with their ranges of pieces."""
    root = Node("#root", None, False, 0.2, "", 0, False)
    stack, nodes, pieces = [root], [root], []
    pos, n, closed = 0, len(page), True
    links = 0
    opened: Counter[str] = Counter()

    def text(raw: str) -> None:
        if not raw:
            return
        top = stack[-1]
        value = entities.unescape(raw) if "&" in raw else raw
        pieces.append((value, not top.drop))
        size = len(value) - value.count(" ") if not value.isspace() else 0
        if size and top.tag not in _RAW:
            top.total += size
            if not top.drop:
                top.clean += size if not links else 0

    def pop(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            node = stack.pop()
            node.end = len(pieces)
            links -= node.tag == "a"
            opened[node.tag] -= 1
            above = node.parent
            if not node.drop and (node.kind == "links" and node.anchors > 1 and not node.clean or node.kind == "talk" and node.bylines > 1 and (node.inside or above.clean)):
                pieces[node.start :] = [(x, False) for x, _ in pieces[node.start :]]
                for x in nodes[node.place :]:
                    x.drop, x.clean = True, 0
            above.anchors += node.anchors + (node.tag == "a")
            above.bylines += node.bylines
            node.parent.total += node.total
            node.parent.clean += node.clean

    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            text(page[pos:])
            break
        if at > pos:
            text(page[pos:at])
        m = _TAG.match(page, at)
        if m is None:
            after = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                pos = n if end < 0 else end + 3
            elif after in ("!", "?") or after == "/" or after.isalpha():
                end = page.find(">", at) if closed else -1
                closed = end >= 0
                pos = n if end < 0 else end + 1
            else:
                text("<")
                pos = at + 1
            continue
        pos = m.end()
        tag = m[2].lower()
        block = tag not in _INLINE
        if m[1]:
            if tag == "br":
                pieces.append(("", True))
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    if block:
                        pieces.append(("", True))
                    pop(k)
                    break
                if not block and stack[k].tag not in _INLINE:
                    break
            else:
                if block:
                    pieces.append(("", True))
            continue
        if block:
            pieces.append(("", True))
            if tag != "br":
                ends = _ENDS.get(tag)
                for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends or ("p",)) else ():
                    open_tag = stack[k].tag
                    if ends and open_tag in ends or not ends and open_tag == "p" and tag not in _VOID:
                        pop(k)
                        break
                    if open_tag in _SCOPE:
                        break
        if tag in _VOID:
            continue
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m[3])} if m[3] else {}
        classes, role = attrs.get("class", ""), attrs.get("role", "").lower()
        named = f"{classes} {attrs.get('id', '')}"
        parent = stack[-1]
        inside = parent.inside or tag in ("article", "main") or role == "main"
        whole = tag in ("html", "body", "article", "main")
        drop = parent.drop or tag in _DROP or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        if not drop and not whole:
            drop = role in _DROP_ROLE or chrome(named) or (not parent.inside and (tag == "header" or bool(named.strip() and _HEADER_CLASS.search(named))))
        bonus = 1.3 if tag in ("article", "main") or role == "main" else 1.15 if named.strip() and _GOOD_CLASS.search(named) else 1.0
        words = _words(named) if named.strip() and not drop else ()
        kind = "" if not words or whole or not block else "links" if not _LINKS.isdisjoint(words) else "talk" if not _TALK.isdisjoint(words) else ""
        node = Node(tag, parent, drop, bonus, "" if drop or not block else _join(parent.path, _segment(tag, classes, attrs.get("id", ""))), len(pieces), inside, kind, len(nodes))
        parent.bylines += bool(words and not _BYLINE.isdisjoint(words))
        opened[tag] += 1
        if not block:
            node.path = parent.path
        nodes.append(node)
        stack.append(node)
        links += tag == "a"
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
            pos = end.start() if end else n
    pop(1)
    root.end = len(pieces)
    return pieces, nodes


_PARTS_OF = frozenset("p h1 h2 h3 h4 h5 h6 li pre html tr".split())


def containers(nodes: list[Node]) -> list[Node]:
    return [x for x in nodes if x.parent is None or not x.drop and x.tag not in _INLINE and x.tag not in _PARTS_OF]


def score(node: Node) -> float:
    return node.bonus * node.clean * node.clean / node.total if node.total else 0.0


def best(nodes: list[Node]) -> Node:
    """The highest score; of equal ones the innermost, first."""
    top = nodes[0]
    for x in nodes:
        if score(x) > score(top) or score(x) == score(top) and x.end - x.start < top.end - top.start:
            top = x
    return top


def whole(nodes: list[Node], found: Node) -> list[Node]:
    """A container, its siblings on its path, and the title before it with what stands between."""
    if found.parent is None or found.tag in ("html", "body"):
        return [found]
    kept = [x for x in nodes if x is found or x.parent is found.parent and x.path == found.path and x.tag == found.tag and x.clean]
    first, level = kept[0], found
    if any(x.tag == "h1" and not x.drop and x.clean for k in kept for x in nodes if k.start <= x.start < k.end):
        return kept
    while level.parent is not None:
        before = [x for x in nodes if x.parent is level.parent and not x.drop and x.tag in _LEAD and x.end <= first.start and x.clean >= LEAD * x.total > 0]
        titles = [k for k, x in enumerate(before) if x.tag in _TITLES or x.tag in ("header", "div", "section") and any(y.tag in _TITLES and not y.drop and x.start <= y.start < x.end for y in nodes)]
        if titles:
            # The last title of the highest rank that this level has before the container.
            top = min((before[k].tag not in ("h1",), -k) for k in titles)
            return before[-top[1] :] + kept
        level = level.parent
        if level.tag == "body":
            break
    return kept


def render(pieces: list[tuple[str, bool]], nodes: list[Node]) -> str:
    return " ".join("".join("".join(value or " " for value, kept in pieces[x.start : x.end] if kept) + " " for x in nodes).split())


def extract(page: str | None, path: str | None = None) -> str:
    if not page:
        return ""
    pieces, nodes = parse(page)
    some = containers(nodes)
    at_path = [x for x in some if path is not None and x.path == path and x.clean]
    return render(pieces, whole(nodes, best(at_path or some)))


def _host(url_col: str):
    found = F.lower(F.regexp_extract(F.col(url_col), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path with the most votes for each host; of equal ones the least string."""

    def make():
        votes: dict[tuple[str, str], int] = {}

        def flush():
            out = [h for h, _ in votes], [p for _, p in votes], list(votes.values())
            votes.clear()
            return out

        def call(hosts, pages):
            for host, page in zip(hosts, pages):
                if host is None or not page:
                    continue
                nodes = [x for x in containers(parse(page)[1]) if x.path]
                most = max(map(score, nodes), default=0)
                if most:
                    for path, value in {x.path: score(x) / most for x in sorted(nodes, key=score)}.items():
                        if value >= VOTE_FLOOR:
                            votes[host, path] = votes.get((host, path), 0) + round(1000 * value)
            return flush() if len(votes) > 50_000 else None

        call.finish = lambda: [flush()]
        return call

    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("votes", T.LongType())])
    voted = map_rows(pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")), ["host", "html"], schema, make)
    summed = voted.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col).alias("host"))
    winners = materialise(host_paths(pages, url_col, html_col), "hostpaths")
    few = winners.count() <= BROADCAST_HOSTS
    joined = rows.join(F.broadcast(winners) if few else winners, "host", "left")
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def make():
        def call(ids, urls, pages, paths):
            texts = [extract(page, path) for page, path in zip(pages, paths)]
            return ids, urls, texts, [len(t) for t in texts]

        return call

    return map_rows(joined, ["id", "url", "html", "path"], schema, make)
