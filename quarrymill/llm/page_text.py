"""Main text of web pages by site template removal.

Every page is read into its elements, and each block element with text gets a digest of its subtree (tags and text, without scripts,
comments and attributes). Spark counts, per host, on how many different pages a digest occurs; pages with the same article count once, so
copies make no template. Subtrees that recur across many pages of their host are deleted, and the text of the rest is the result:

- A subtree outside the article is a template from ``MANY`` pages and ``SHARE`` of the host's pages on, if it holds links or is marked;
  anything else, and whatever lies within the article, only where ``MOST`` of the host's pages have it.
- Paragraphs, headings, lists, tables and quotes within an article are never deleted for recurring: passages that documents share are text.
- What a page itself marks as no part of the article goes on any host, be it one of a single page: by tag (menus, headers, footers,
  sidebars, forms, scripts, styles), by role, or by the words of its class and id (adverts, notices, reader comments).
- Where a page has an ``article`` (or else ``main``) outside such parts, the text is what they hold.

Templates are kept per host. They are broadcast only if there are at most ``BROADCAST`` of them, else hosts and pages are shuffled and
salted; a host's own list is bounded, as each of its templates takes a hundredth of its pages.

Defined cases: null html is the empty page, with empty text; pages without a readable host are judged by their own marks alone; null
page_ids and repeated rows give a row each; markup cut off in the middle of a tag or comment ends there, as browsers do; an empty table
gives an empty result; further columns are ignored. Pages are read whole, in time proportional to their length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import tidy
from .shared import bounded, parts_for, written

#: Different pages of a host that make a subtree a template, and their least share of the host's pages.
MANY, SHARE = 5, 0.01
#: The share asked of plain text and of what lies within an article.
MOST = 0.5
#: Templates that may be broadcast.
BROADCAST = 200_000
SALTS = 32

# Elements of HTML by their part in the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary "
    "table tbody td template tfoot th thead tr ul".split()
)
#: Start tags that end an open element of these names, up to a boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), **{t: ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
}
BOUNDARY = frozenset("table td th caption button object template".split())
#: Text blocks that recur as shared passages do.
PLAIN = HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre table caption thead tbody tfoot tr td th figure figcaption address summary details".split())

# What is no part of an article, by tag, role and words of class or id.
TAGS = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "search": "form", "button": "form", "select": "form", "datalist": "form", "dialog": "notice",
    "head": "script", "noscript": "script", "template": "script", "object": "script", "svg": "script", "canvas": "script", "audio": "script", "video": "script",
}
ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer", "complementary": "sidebar", "search": "form", "form": "form", "alert": "notice", "dialog": "notice", "alertdialog": "notice"}
WORDS = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topnav subnav sitenav",
    "header": "header masthead topbar siteheader",
    "footer": "footer colophon copyright sitefooter",
    "sidebar": "sidebar aside widget widgets related recommended recommendations share sharing social sidenav rail",
    "notice": "notice notices cookie cookies consent gdpr alert alerts popup modal overlay newsletter subscribe subscription paywall toast",
    "advert": "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion banner",
    "form": "form searchform searchbox login signin signup",
    "comment": "comment comments commentlist commentary disqus respond replies",
}
KIND = {w: kind for kind, words in WORDS.items() for w in words.split()}
#: What follows such a word tells of the page, not of the element.
ABOUT = frozenset("has with no without is hide show".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_TAG_END = re.compile(r"[\s/]*>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


@lru_cache(maxsize=4096)
def mark(tag: str, classes: str, role: str) -> str:
    """Which part of a page an element says it is; empty for none."""
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return ""
    kind = TAGS.get(tag, "") or ROLES.get(role.strip().lower(), "")
    if kind:
        return kind
    for name in classes.split():
        for w in map(str.lower, _WORD.findall(name)):
            if w in ABOUT:
                break
            found = KIND.get(w, "")
            if found and (tag != "article" or found in ("comment", "sidebar", "advert")):
                return found
    return ""


class Page:
    """The elements and texts of a page, in order. Parents come before their children."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.marks, self.digest, self.links = [""], [0], [""], [0], [0]
        self.attributed, self.paragraphs = [False], [0]
        self.runs: list[tuple[str, int]] = []  # text, element; an empty text parts blocks
        self._parts: list[list[bytes]] = [[]]
        self._open: list[int] = [0]
        self._count: dict[str, int] = {}
        self._read(source)
        while len(self._open) > 1:
            self._pop()
        self._roots()

    def _push(self, tag: str, classes: str, role: str) -> None:
        at, up = len(self.tag), self._open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.marks.append(mark(tag, classes, role))
        self.digest.append(0)
        self.links.append(tag == "a")
        self.paragraphs.append(tag == "p")
        self.attributed.append(bool(classes or role))
        self._parts.append([] if tag in BLOCKS else self._parts[up])
        self._open.append(at)
        self._count[tag] = self._count.get(tag, 0) + 1
        if tag in BLOCKS:
            self.runs.append(("", at))

    def _pop(self) -> None:
        at = self._open.pop()
        tag, up = self.tag[at], self._open[-1]
        self._count[tag] -= 1
        self.links[up] += self.links[at]
        self.paragraphs[up] += self.paragraphs[at]
        if tag in BLOCKS:
            self.runs.append(("", up))
            if self._parts[at]:
                digest = blake2b(tag.encode() + b"<" + b"\0".join(self._parts[at]), digest_size=8).digest()
                self.digest[at] = int.from_bytes(digest, "big", signed=True)
                self._parts[up].append(b"\1" + digest)
        self._parts[at] = []

    def _close(self, names: set[str] | frozenset[str], boundary: set[str] | frozenset[str]) -> None:
        """Ends the outermost open element of these names that no boundary hides."""
        if not any(self._count.get(n) for n in names):
            return
        last = 0
        for i in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[i]]
            if tag in names:
                last = i
            elif tag in boundary:
                break
        while last and len(self._open) > last:
            self._pop()

    def _end(self, tag: str) -> None:
        """An end tag ends the nearest open element of its name; inline ones don't reach out of their block."""
        if not self._count.get(tag):
            return
        for i in range(len(self._open) - 1, 0, -1):
            name = self.tag[self._open[i]]
            if name == tag:
                while len(self._open) > i:
                    self._pop()
                return
            if name in BLOCKS and tag not in BLOCKS or name in BOUNDARY and tag not in BOUNDARY and tag not in ("tr", "tbody", "thead", "tfoot"):
                return

    def _start(self, tag: str, classes: str, role: str, closed: bool) -> None:
        if self._count.get("head") and tag not in IN_HEAD and tag != "head":
            self._end("head")
        if tag == "br":
            self.runs.append((" ", self._open[-1]))
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag in BLOCKS:
            self._close({"p"}, BOUNDARY)
            if tag in HEADINGS and self.tag[self._open[-1]] in HEADINGS:
                self._pop()
        if tag == "a":
            self._close({"a"}, BLOCKS)
        if tag in VOID:
            if tag == "hr":
                self.runs.append(("", self._open[-1]))
        elif not closed or tag in BLOCKS:  # <span/> holds nothing, as its writer means
            self._push(tag, classes, role)

    def _text(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        plain = " ".join(text.split())
        if plain:
            if self._count.get("head") and self.tag[self._open[-1]] == "head":
                self._end("head")
            self._parts[self._open[-1]].append(plain.encode("utf-8", "surrogatepass"))
        self.runs.append((text, self._open[-1]))

    def _read(self, source: str) -> None:
        at, n, find = 0, len(source), source.find
        while at < n:
            i = find("<", at)
            if i < 0:
                self._text(source[at:])
                return
            after = source[i + 1 : i + 2]
            if after == "!" or after == "?" or (after == "/" and not _NAME.match(source, i + 2)):
                if i > at:
                    self._text(source[at:i])
                if source.startswith("<!--", i):
                    stop = i + 4 if source.startswith((">", "->"), i + 4) else find("-->", i + 4)
                    at = n if stop < 0 else find(">", stop) + 1
                else:
                    stop = find(">", i + 1)
                    at = n if stop < 0 else stop + 1
                continue
            name = _NAME.match(source, i + 1 + (after == "/"))
            if not name:  # a plain <
                stop = find("<", i + 1)
                self._text(source[at : n if stop < 0 else stop])
                at = n if stop < 0 else stop
                continue
            if i > at:
                self._text(source[at:i])
            tag, at = name.group().lower(), name.end()
            classes = role = ""
            while True:
                end = _TAG_END.match(source, at)
                if end:
                    break
                found = _ATTRIBUTE.match(source, at)
                if not found:
                    return  # cut off within a tag
                key = found[1].lower()
                if key in ("class", "id", "role"):
                    value = entities.unescape(found[2] or found[3] or found[4] or "")
                    classes, role = (classes, value) if key == "role" else (f"{classes} {value}" if classes else value, role)
                at = found.end()
            at = end.end()
            if after == "/":
                if tag == "p" and not self._count.get("p"):
                    self.runs.append(("", self._open[-1]))
                self._end(tag)
                continue
            if tag in RAW:
                stop = _RAW_END[tag].search(source, at)
                at = n if not stop else (find(">", stop.end()) + 1 or n)
                continue
            self._start(tag, classes, role, source[end.end() - 2] == "/")

    def _roots(self) -> None:
        """inside[e]: does e lie within the page's article; apart[e]: is e, or what holds it, marked."""
        n = len(self.tag)
        self.apart, self.inside = [""] * n, [False] * n
        holds = [False] * n  # an article or main
        for e in range(n - 1, 0, -1):
            if self.tag[e] in ("article", "main"):
                holds[e] = True
            if holds[e]:
                holds[self.parent[e]] = True
        for e in range(1, n):
            if self.tag[e] == "form" and (holds[e] or self.paragraphs[e] > 2):
                self.marks[e] = ""  # a form around the whole page
            self.apart[e] = self.apart[self.parent[e]] or self.marks[e]
        texts = [False] * n
        for text, e in self.runs:
            if text.strip():
                texts[e] = True
        for e in range(n - 1, 0, -1):
            if texts[e] and not self.apart[e]:
                texts[self.parent[e]] = True
        roots = [e for e in range(1, n) if self.tag[e] == "article" and not self.apart[e] and texts[e]] or [e for e in range(1, n) if self.tag[e] == "main" and not self.apart[e] and texts[e]]
        self.root, chosen = bool(roots), set(roots)
        for e in range(1, n):
            self.inside[e] = self.inside[self.parent[e]] or e in chosen
        self.around = set()  # what holds a root
        for e in roots:
            while e and e not in self.around:
                self.around.add(e)
                e = self.parent[e]

    def candidates(self) -> Iterator[tuple[int, bool]]:
        """(element, strict): subtrees that may be templates; a strict one must be on MOST pages."""
        for e in range(1, len(self.tag)):
            tag = self.tag[e]
            if not self.digest[e] or e in self.around or tag in ("html", "body", "head"):
                continue
            plain = tag in PLAIN and not self.attributed[e]
            if self.inside[e]:
                if not plain or self.apart[e]:
                    yield e, not self.apart[e]
            elif tag not in ("li", "dt", "dd", "td", "th", "tr", "option"):
                yield e, not (self.links[e] or self.marks[e])

    def text(self, many: set[int] | frozenset[int] = frozenset(), most: set[int] | frozenset[int] = frozenset()) -> tuple[str, int, int]:
        """(text, subtrees deleted as templates, subtrees deleted by their marks). many and most: the host's templates."""
        n = len(self.tag)
        gone, templates, marked = [0] * n, 0, 0
        template = {e for e, strict in self.candidates() if self.digest[e] in most or not strict and self.digest[e] in many} if many or most else set()
        for e in range(1, n):
            up = gone[self.parent[e]]
            if up == 1 or up == 2 and self.tag[e] not in HEADINGS:
                gone[e] = up
            elif e in template:
                gone[e], templates = 1, templates + 1
            elif self.marks[e] and e not in self.around:
                # an article's own header keeps its headings
                gone[e], marked = (2 if self.marks[e] == "header" and self.inside[e] else 1), marked + 1
        out = [(text or " ") for text, e in self.runs if not text or not gone[e] and (self.inside[e] or not self.root)]
        return " ".join("".join(out).split()), templates, marked

    def key(self) -> int:
        """Digest of the article, or of the whole page without one: equal pages count once."""
        return int.from_bytes(blake2b(self.text()[0].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)", 1)), F.lit(""))


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, node): digests of the candidates of every page, and one row without node a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, keys, nodes = [], [], []
            for name, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                found = [None, *{page.digest[e] for e, _ in page.candidates()}]
                hosts += [name] * len(found)
                keys += [page.key()] * len(found)
                nodes += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], names=["host", "page", "node"])
            tidy()

    return pages.select(host(F.col("url")).alias("host"), "html").filter("host IS NOT NULL").mapInArrow(run, "host string, page long, node long")


def templates(pages: DataFrame) -> DataFrame:
    """(host, node, most): subtrees on MANY pages and SHARE of their host's pages; most: on MOST of them."""
    counts = subtrees(pages).distinct().groupBy("host", "node").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= MANY) | F.col("node").isNull())
    counts = written(counts, "subtrees")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sizes = counts.filter("node IS NULL").select("host", F.col("n").alias("pages"), salt)
    found = counts.filter("node IS NOT NULL").withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(sizes, ["host", "salt"])
    return found.filter(F.col("n") >= F.col("pages") * SHARE).select("host", "node", (F.col("n") >= F.col("pages") * MOST).alias("most"))


def extract(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, text, n_chars; n_template and n_marked count the subtrees deleted as templates and by their marks."""
    spark = pages.sparkSession
    bounded(spark, 500)
    found = written(templates(pages), "templates")
    n = found.count()
    lists = found.groupBy("host").agg(F.collect_list("node").alias("many"), F.collect_list(F.when(F.col("most"), F.col("node"))).alias("most"))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    if n <= broadcast:
        rows = rows.join(F.broadcast(lists), "host", "left")
    else:  # each page moves once; a hot host's over SALTS tasks
        lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).repartition(parts_for(spark, n, 100_000), "host", "salt").join(lists, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str | None, tuple] = {}
        for b in batches:
            many, most, out = b.column(4), b.column(5), []
            for i, (name, source) in enumerate(zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if name not in sets:
                    if len(sets) > 64:
                        sets.clear()
                    sets[name] = frozenset(many[i].as_py() or ()), frozenset(most[i].as_py() or ())
                out.append(Page(source or "").text(*sets[name]))
            texts, a, z = zip(*out, strict=True) if out else ((), (), ())
            clean = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(clean, pa.string()), pa.array(map(len, clean), pa.int64()), pa.array(a, pa.int64()), pa.array(z, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_template", "n_marked"],
            )
            tidy()

    return rows.select("page_id", "url", "html", "host", "many", "most").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long, n_marked long")
