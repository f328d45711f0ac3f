"""Ordered work on markup: a tolerant walk, painted text, rewriting. State stays inside one document, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import FILE_ATTRIBUTES, QUOTES
from ..functions.text import SPELLINGS
from .batches import bounded
from .digest import first_fit

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text a page asks a reader to read as a unit.
ASKING = frozenset("h1 h2 h3 h4 h5 h6 a button label summary option".split())

class _Outline(HTMLParser):
    """Elements of a page with their places; open ones are kept on a stack."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.stack: list[dict] = []
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()

    def place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def begin(self, name: str, given: list[tuple[str, str | None]], empty: bool) -> None:
        after = self.place() + len(self.get_starttag_text())
        first: dict[str, str] = {}
        for k, v in reversed(given):
            first[k] = v or ""
        item = {"name": name, "depth": len(self.stack), "start": after, "end": after if empty else -1, "attributes": first}
        self.found.append(item)
        if not empty:
            self.stack.append(item)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.begin(tag, attrs, tag in VOID)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.begin(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        if any(x["name"] == tag for x in self.stack):
            while (last := self.stack.pop())["name"] != tag:
                pass
            last["end"] = self.place()


def walk(html: str) -> list[tuple[int, str, int, int, int, dict[str, str]]]:
    """(number, name, depth, content start, content end or -1, attributes) of elements in order of opening.

    A closing tag closes the last open element of its name and all within; others without a match are ignored; void and self-closed
    elements hold nothing; elements never closed have no end.
    """
    return [(n, x["name"], x["depth"], x["start"], x["end"], x["attributes"]) for n, x in enumerate(_Outline(html).found)]


def blanked(html: str) -> str:
    """Bodies of scripts and styles replaced by blanks of the same length, so that offsets hold."""
    out = list(html)
    for _, name, _, start, end, _ in walk(html):
        if name in ("script", "style") and end > start:
            out[start:end] = " " * (end - start)
    return "".join(out)


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, name, depth, start, end, attributes: a row an element."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, name, depth, s, None if e < 0 else e, list(a.items())) for k, t in zip(b[key], b[html], strict=True) for n, name, depth, s, e, a in walk(t or "")]
            yield pd.DataFrame(rows, columns=["key", "pos", "name", "depth", "start", "end", "attributes"])

    bounded(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    t = pages.select(key, html).mapInPandas(run, f"key {kind}, pos int, name string, depth int, start int, end int, attributes array<struct<k:string,v:string>>")
    return t.withColumn("attributes", F.map_from_entries("attributes"))


def composed(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def folded(s: str) -> str:
    """Lower case without the marks of Latin letters; marks of other scripts stay."""
    out, base = [], ""
    for c in unicodedata.normalize("NFD", s):
        if unicodedata.combining(c) and base and "LATIN" in unicodedata.name(base, ""):
            continue
        if not unicodedata.combining(c):
            base = c
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out)).lower()


def surface(html: str, dropped: tuple[str, ...] = ()) -> tuple[list[tuple[str, str]], str]:
    """((key, element) asked, all that is said): elements hidden from all readers are left out, each key once, by its first element."""
    page = walk(html)
    hidden = [(s, e) for _, name, _, s, e, a in page if e >= s and (a.get("aria-hidden") == "true" or "hidden" in a or a.get("role") == "dialog" or any(c in a.get("class", "") for c in dropped))]
    plain = blanked(html)

    def text(a: int, b: int) -> str:
        keep, at = [], a
        for s, e in sorted(hidden):
            if s >= at and e <= b:
                keep.append(plain[at:s])
                at = e
        keep.append(plain[at:b])
        return key_of("".join(keep))

    asked: dict[str, str] = {}
    for _, name, _, s, e, _ in page:
        if name in ASKING and e >= 0 and not any(x <= s < y for x, y in hidden):
            k = text(s, e)
            if k:
                asked.setdefault(k, name)
    return list(asked.items()), text(0, len(plain))


def key_of(s: str) -> str:
    """The comparison key of a text (as functions.text.comparison_text), composed."""
    s = re.sub("<[^>]*>", " ", s)
    for plain, spellings in SPELLINGS.items():
        for spelled in spellings:
            s = s.replace(spelled, plain)
    return composed(re.sub(" ?/ ?", "/", " ".join(s.split())).strip().lower())


def surfaces(pages: DataFrame, key: str, html: str, dropped: tuple[str, ...] = ()) -> DataFrame:
    """key, asked (array of struct(key, kind)), said."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [surface(t or "", dropped) for t in b[html]]
            yield pd.DataFrame({"key": b[key], "asked": [a for a, _ in got], "said": [s for _, s in got]})

    bounded(pages.sparkSession)
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"key {kind}, asked array<struct<key:string,kind:string>>, said string")


def quoted_values(html: str) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of every attribute value in quotes that holds no quote, in order: a scan from one equals sign to the next."""
    at = html.find("=")
    while at >= 0:
        quote, stop = html[at + 1 : at + 2], -1
        if quote in ("'", '"') and quote:
            stop = html.find(quote, at + 2)
        if stop >= 0 and ("'" if quote == '"' else '"') not in html[at + 2 : stop]:
            first = at
            while first and (html[first - 1].isalnum() or html[first - 1] in "-_"):
                first -= 1
            yield html[first:at].lower(), at + 2, stop
        at = html.find("=", at + 1)


def replaced(html: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans, which come in order and do not overlap, replaced."""
    out, at = [], 0
    for start, end, new in spans:
        out += html[at:start], new
        at = end
    return "".join(out) + html[at:]


def internalised(html: str, hosts: tuple[str, ...], away: tuple[str, ...]) -> str:
    """Links to the site's own hosts become root-relative, unless they name a file or a system path; root-relative links to paths that
    are not migrated become absolute on the first host."""
    own = {h.lower().removeprefix("www.") for h in hosts}

    def kept_out(path: str) -> bool:
        return any(path.rstrip("/") == a or path.startswith(a + "/") for a in away)

    def moved(url: str) -> str:
        path = re.split("[?#]", url, maxsplit=1)[0]
        scheme, _, rest = path.partition("://")
        if scheme.lower() in ("http", "https") and rest:
            host, slash, inner = rest.partition("/")
            inner = slash + inner or "/"
            file = "." in inner.rsplit("/", 1)[-1] and re.fullmatch("[A-Za-z0-9]{1,5}", inner.rsplit(".", 1)[-1])
            if host.lower().removeprefix("www.") in own and not file and not inner.startswith("/wp-") and not kept_out(inner):
                return inner + url[len(path) :]
        elif url.startswith("/") and not url.startswith("//") and kept_out(path):
            return f"https://{hosts[0]}{url}"
        return url

    spans = []
    for name, start, end in quoted_values(html):
        opened = html.rfind("<", 0, start)
        if name == "href" and html[opened + 1 : opened + 2] in ("a", "A") and opened >= 0 and not (html[opened + 2 : opened + 3].isalnum()) and ">" not in html[opened:start]:
            spans.append((start, end, moved(html[start:end])))
    return replaced(html, spans)


def rewritten(html: str, to_local: Callable[[str], str | None]) -> str:
    """References of attributes, srcset, CSS and Markdown replaced where to_local knows a local path; all else stays byte for byte."""

    def swap(u: str) -> str:
        return to_local(u) or u

    def of_set(value: str) -> str:
        """URLs of a srcset replaced, each with what follows it."""
        return ", ".join(" ".join([swap(c.split()[0]), *c.split()[1:]]) for c in value.split(",") if c.strip())

    def named(name: str) -> str:
        return max((a for a in FILE_ATTRIBUTES if name == a or name.endswith(f"-{a}")), key=len, default="")

    spans = []
    for name, start, end in quoted_values(html):
        known = named(name)
        if known:
            spans.append((start, end, (of_set if known.endswith("srcset") else swap)(html[start:end])))
    html = replaced(html, spans)

    spans, at = [], html.lower().find("url(")
    while at >= 0:
        start, end = at + 4, html.find(")", at)
        if end < 0:
            break
        start += len(html[start:end]) - len(html[start:end].lstrip())
        stop = start + len(html[start:end].rstrip())
        for q in QUOTES:
            start += len(q) if html.startswith(q, start, stop) else 0
        for q in QUOTES:
            stop -= len(q) if html.endswith(q, start, stop) else 0
        if stop > start and not set("\"'") & set(html[start:stop]):
            spans.append((start, stop, swap(html[start:stop])))
        at = html.lower().find("url(", end)
    html = replaced(html, spans)

    spans, at = [], html.find("](")
    while at >= 0:
        start, stop = at + 2, at + 2
        while stop < len(html) and html[stop] != ")" and not html[stop].isspace():
            stop += 1
        if stop > start and html.rfind("[", 0, at) > html.rfind("]", 0, at):
            spans.append((start, stop, swap(html[start:stop])))
        at = html.find("](", stop)
    return replaced(html, spans)


def map_text(df: DataFrame, column: str, change: Callable[[str], str]) -> DataFrame:
    """A column changed by a Python function in Arrow batches; for rewriting that patterns cannot express."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else change(x))

    bounded(df.sparkSession)
    return df.withColumn(column, run(column))


def greedy_differences(a: list[tuple[int, ...]], b: list[tuple[int, ...]], within: int = 1) -> tuple[int, int]:
    """(only in a, only in b) of two bags of geometries matched first fit, every number within a tolerance."""
    lost, left = first_fit(a, b, within)
    return len(lost), len(left)


def compare_digests(old: DataFrame, new: DataFrame, within: int = 1) -> DataFrame:
    """file, state (same, changed, unrecorded, vanished), removed, added. old, new: file, label, numbers (array of int), pos.

    Lines of one file and label are matched first fit; a file's label is the unit of work, so a group is one page's lines.
    """
    t = old.select("file", "label", "numbers", "pos", F.lit(0).alias("side")).unionByName(new.select("file", "label", "numbers", "pos", F.lit(1).alias("side")))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        x, y = greedy_differences([tuple(v) for v in p[p.side == 0].numbers], [tuple(v) for v in p[p.side == 1].numbers], within)
        return pd.DataFrame([(p.file.iloc[0], x, y, bool((p.side == 0).any()), bool((p.side == 1).any()))], columns=["file", "removed", "added", "o", "n"])

    g = t.groupBy("file", "label").applyInPandas(run, "file string, removed int, added int, o boolean, n boolean")
    g = g.groupBy("file").agg(F.sum("removed").alias("removed"), F.sum("added").alias("added"), F.bool_or("o").alias("o"), F.bool_or("n").alias("n"))
    return g.select("file", F.when(~F.col("o"), "unrecorded").when(~F.col("n"), "vanished").when(F.col("removed") + F.col("added") > 0, "changed").otherwise("same").alias("state"), "removed", "added")
