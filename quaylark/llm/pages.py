"""Main text of web pages: site templates and page furniture are removed.

Every element's subtree is hashed. Per host, Spark counts the different pages that hold
each hash; subtrees on many pages of a host are its template and go first. Outside a
page's article a small share of the pages tells a template, as sites change their
menus, adverts and footers; inside it, where passages may be quoted, it takes half of them.
What is left is cleared of navigation, forms, notices, comments and the like, which their
tags, roles and class names tell, and the text of the articles is taken block by block.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import python_map, stash, with_set

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are deleted inside an article when they recur: not single cells or items, whose
#: words may be common, nor headings. Inline elements always stay with their block.
UNITS = BLOCK - HEADING - frozenset("li td th tr tbody thead tfoot dt dd body html main article summary legend caption figcaption hgroup hr".split())
#: Elements that hold a page's content and never go as template.
WHOLE = frozenset("html body main article".split())
FURNITURE = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object embed svg canvas audio video dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note".split())
#: Parts of class names and ids that mark furniture, and those that may stand beside them: a
#: name counts only if it has no other parts.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu modal"
    " nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo related replies respond share sharing sidebar signup skip social sponsor sponsored"
    " subscribe taboola toc toolbar widget".split()
)
BESIDE = frozenset("area bar block bottom box buttons col column container content group holder icons inner items left links list main number page post posts primary right secondary section site slot top wrap wrapper".split())
#: Containers that class names can mark; text elements keep their words but for clear names.
CONTAINERS = frozenset("div section ul ol dl table header".split())
#: Parts that stand beside `comment` in names which tell a page's setting.
SETTINGS = frozenset("open opened closed enabled disabled allowed on off no not without has have with count".split())
#: Share and number of a host's pages that make a subtree its template outside of articles; and inside.
RATIO, MIN_PAGES, INNER_RATIO, INNER_MIN = 0.05, 3, 0.5, 8
#: Start tags that end an open paragraph.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div main body html td th blockquote form nav aside header footer".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "hash")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.hash = tag, attrs, [], 0


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.stack = [self.root]

    def pop_open(self, tags: frozenset[str] | set[str]) -> None:
        """End the innermost open element of these tags inside the present scope."""
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                del self.stack[i:]
                return
            if tag in _SCOPE:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.pop_open({"p"})
        if tag in _CLOSES:
            self.pop_open(_CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag and tag in ("svg", "path", "script"):
            self.stack.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def nodes(root: Node) -> list[Node]:
    """All elements, parents before children, without recursion: pages may nest deeply."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    return out


def hash_subtrees(root: Node) -> list[Node]:
    """Give every element the hash of its tag, classes, texts and children."""
    all_ = nodes(root)
    for n in reversed(all_):
        h = xxhash.xxh64(f"{n.tag} {n.attrs.get('class', '')} {n.attrs.get('id', '')}")
        for c in n.children:
            h.update(b"<" + c.hash.to_bytes(8, "big", signed=True) if isinstance(c, Node) else " ".join(c.split()).encode("utf-8", "surrogatepass"))
        n.hash = int.from_bytes(h.digest(), "big", signed=True)
    return all_


def has_text(n: Node) -> bool:
    return any(isinstance(c, str) and not c.isspace() for x in nodes(n) for c in x.children)


def _parts(n: Node) -> list[list[str]]:
    return [[x for x in re.split(r"[^a-z]+", name) if x] for name in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower().split()]


def marked(n: Node) -> bool:
    """Whether a class name or id says furniture."""
    return any(any(x in HINTS for x in p) and all(x in HINTS or x in BESIDE for x in p) for p in _parts(n))


def is_main(n: Node) -> bool:
    return n.tag in ("article", "main") or n.attrs.get("role") == "main"


def is_comment(n: Node) -> bool:
    """Whether a class name or id says readers' comments, and not only that a page has some."""
    if "comment" not in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower():
        return False
    return any(("comment" in p or "comments" in p) and SETTINGS.isdisjoint(p) for p in _parts(n))


def _holds_content(n: Node) -> bool:
    return any(x.tag == "h1" or is_main(x) and not is_comment(x) for x in nodes(n))


def is_furniture(n: Node) -> bool:
    role = n.attrs.get("role", "").lower()
    if "form" in (n.tag, role):  # some sites wrap the whole page in one
        return not _holds_content(n)
    if n.tag in FURNITURE or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or role in ROLES:
        return True
    if re.search(r"display\s*:\s*none", n.attrs.get("style", "")):
        return True
    if n.tag == "article":  # readers' comments may be articles themselves
        return is_comment(n) and (["comment"] in _parts(n) or not any(x.tag == "h1" for x in nodes(n)))
    if n.tag == "p":  # paragraphs are the text itself: only a name of two such words or more
        return bool(n.attrs) and any(len(p) > 1 and HINTS.issuperset(p) for p in _parts(n))
    if n.tag == "li":
        return is_comment(n) and not _holds_content(n)
    return n.tag in CONTAINERS and (marked(n) or is_comment(n)) and not _holds_content(n)


def teasers(all_: list[Node]) -> set[int]:
    """Ids of the articles that only point to other pages: those named so, or with more than
    half of their letters in links, where the page has an article that isn't so. `all_`
    has parents before children."""
    articles = [n for n in all_ if n.tag == "article" and not is_comment(n)]
    if len(articles) < 2:
        return set()
    letters, linked, proper = {}, {}, set()
    for n in reversed(all_):
        own = [c for c in n.children if isinstance(c, Node)]
        letters[id(n)] = sum(letters[id(c)] for c in own) + sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        linked[id(n)] = letters[id(n)] if n.tag == "a" else sum(linked[id(c)] for c in own)
        if n.tag == "article" and not is_comment(n) and "teaser" not in sum(_parts(n), []) and 2 * linked[id(n)] <= letters[id(n)] > 0:
            proper.add(id(n))
        if any(id(c) in proper for c in own):
            proper.add(id(n))
    return {id(n) for n in articles} - proper if any(id(n) in proper for n in articles) else set()


def prune(root: Node, template: frozenset[int], common: frozenset[int], rules: bool = True) -> None:
    """Delete template subtrees, then furniture. Outside of a page's articles `template`
    tells, inside, and on pages without any, `common`. Of an article's header its
    headings stay."""
    all_ = nodes(root)
    inside = not any(is_main(n) for n in all_)
    pointers = teasers(all_) if rules else ()
    todo = [(root, inside, False)]
    while todo:
        n, inside, article = todo.pop()
        kept = []
        for c in n.children:
            if isinstance(c, Node):
                within = inside or is_main(c)
                if c.tag not in WHOLE and (c.hash in common and (not article or c.tag in UNITS) if within else c.hash in template):
                    continue
                if rules and c.tag == "header":
                    if not article and not any(is_main(x) for x in nodes(c)):
                        continue
                    if article:
                        c.children = [x for x in nodes(c) if x.tag in HEADING]
                elif rules and (is_furniture(c) or id(c) in pointers):
                    continue
            kept.append(c)
        n.children = kept
        todo += [(c, inside or is_main(c), article or is_main(c)) for c in kept if isinstance(c, Node)]


def blocks(root: Node) -> list[str]:
    out, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [root]
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            line.append(n)
        elif n.tag == "br":
            line.append(" ")
        else:
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(n.children)
    flush()
    return out


def main_text(html: str, template: frozenset[int] = frozenset(), common: frozenset[int] = frozenset(), rules: bool = True) -> str:
    """The articles' blocks in page order, joined by line feeds; where there is no article,
    the main element's, or the body's; empty if there are none. Without `rules` only the
    templates go."""
    root = parse(html)
    if template or common:
        hash_subtrees(root)
    prune(root, template, common, rules)
    for tag in ("article", "main", "body"):
        texts, todo = [], [root]
        while todo:  # outermost ones: an article inside another is part of its text
            n = todo.pop()
            if n.tag == tag or tag == "main" and n.attrs.get("role") == "main":
                texts.append("\n".join(blocks(n)))
            else:
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        if any(texts):
            return "\n".join(t for t in texts if t)
    return "\n".join(blocks(root))


def host_of(url):
    """Lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def site_templates(pages: DataFrame, *, ratio: float = RATIO, min_pages: int = MIN_PAGES, inner_ratio: float = INNER_RATIO, inner_min: int = INNER_MIN) -> DataFrame:
    """(host, template, common): hashes of subtrees on at least `ratio` of a host's pages and
    on at least `min_pages`; and those on at least `inner_ratio` and `inner_min` of them.
    `pages` has host and html.

    Whole copies of a page count as one page. A page sends one row for each of its
    different subtrees; pages are made different, and subtrees counted, with partial
    aggregates ahead of each shuffle, so a host with very many pages sends each hash once
    from each task. A host's template has at most 1 / ratio times the subtrees of its
    average page.
    """

    def make():
        return lambda b: {"hashes": [list({n.hash for n in hash_subtrees(parse(h))[1:] if n.tag != "br"}) for h in b["html"]]}

    held = python_map(pages.select("host", F.xxhash64("html", F.lit(1)).alias("page"), "html"), make, "hashes array<long>", ["host", "page"])
    once = held.groupBy("host", "page").agg(F.first("hashes").alias("hashes"))
    # A page's own total travels as the hash null: one pass counts both.
    counts = once.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "hashes")).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.where(F.col("hash").isNull()).select(F.col("host").alias("h"), F.col("n").alias("total"))
    often = counts.where(F.col("hash").isNotNull() & (F.col("n") >= min(min_pages, inner_min)))
    share = lambda r, m: (F.col("n") >= r * F.col("total")) & (F.col("n") >= m)
    outer, inner = share(ratio, min_pages), share(inner_ratio, inner_min)
    found = often.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(outer | inner)
    return found.groupBy("host").agg(F.collect_list(F.when(outer, F.col("hash"))).alias("template"), F.collect_list(F.when(inner, F.col("hash"))).alias("common"))


def extract_main_text(pages: DataFrame, *, bound_bytes: int = 16 << 20, **options) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages(page_id, url, html).

    A null or empty html gives an empty text. Pages without a host share one group. Rows
    may repeat; each is read by itself. Other columns are ignored, whatever their names; an
    empty table gives none. Templates of at most `bound_bytes` altogether are sent to the
    tasks once; beyond that each page gets its host's by a join.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    sets = stash(site_templates(rows, **options))
    size = sets.agg(F.sum((F.size("template") + F.size("common")) * 8 + 64)).first()[0] or 0
    if size <= bound_bytes:
        sent = spark.sparkContext.broadcast({r["host"]: (frozenset(r["template"]), frozenset(r["common"])) for r in sets.collect()})

        def make():
            none = (frozenset(), frozenset())
            return lambda b: {"text": [main_text(html, *sent.value.get(host, none)) for host, html in zip(b["host"], b["html"])]}

    else:
        rows = with_set(rows, sets.select("host", F.array(F.struct("template", "common"))), F.col("host"), "sets")

        def make():
            last: list = [None, ()]

            def texts(b):
                out = []
                for html, t in zip(b["html"], b["sets"]):
                    if t != last[0]:
                        last[:] = t, tuple(frozenset(t[0][k]) for k in ("template", "common")) if t else ()
                    out.append(main_text(html, *last[1]))
                return {"text": out}

            return texts

    return python_map(rows, make, "text string", ["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))
