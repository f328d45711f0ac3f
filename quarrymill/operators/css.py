"""Style sheets taken apart: rules with their selectors and declarations, nested and conditional ones too, and what they do to focus and lists.

A sheet is tokenized once however many pages apply it: pages name it by digest, and facts are rows of an inverted index
(sheet, kind, name).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At-rules whose blocks hold style rules.
GROUPS = frozenset("media supports layer container scope starting-style document".split())
# Properties that draw a focus indicator, by name and by what they begin with, and the endings that don't.
DRAWS = frozenset("outline outline-width outline-style outline-color box-shadow background background-color background-image".split())
DRAWS_FROM = ("border", "text-decoration")
PUTS_BACK = ("box-shadow", "border", "background", "text-decoration")

_TOKEN = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[{};]", re.S)
_CLASS = re.compile(r"\.(-?[A-Za-z_][\w-]*|[A-Za-z0-9_-]+)")
_FOCUS = re.compile(r":focus-visible(?![\w-])")


def split_top(s: str, mark: str = ",") -> list[str]:
    """Parts of a text between marks that no bracket encloses."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(s):
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == mark and depth <= 0:
            parts.append(s[start:i])
            start = i + 1
    return [p.strip() for p in (*parts, s[start:])]


def _nested(outer: list[str] | None, inner: list[str]) -> list[str]:
    if not outer:
        return inner
    return [s.replace("&", o) if "&" in s else f"{o} {s}" for o in outer for s in inner]


def rules(css: str) -> Iterator[tuple[list[str], list[tuple[str, str]]]]:
    """(selectors, declarations) of every style rule, inner ones before the one that holds them. Blocks of media and other conditions are
    entered, those of fonts and key frames are not; a block that never closes ends with the sheet."""
    text: list[str] = []
    # what is open: selectors (None: none so far), is it read at all, declarations
    open_: list[tuple[list[str] | None, bool, list]] = [(None, True, [])]
    at = 0

    def declare() -> None:
        name, colon, value = "".join(text).partition(":")
        if colon and open_[-1][0] is not None and open_[-1][1]:
            open_[-1][2].append((name.strip().lower(), value.strip().lower()))
        text.clear()

    for m in _TOKEN.finditer(css):
        text.append(css[at : m.start()])
        at, token = m.end(), m[0]
        if token[0] in "\"'":
            text.append(token)
        elif token == ";":
            declare()
        elif token == "{":
            head = "".join(text).strip()
            text.clear()
            outer, read, _ = open_[-1]
            if head.startswith("@"):
                open_.append((outer, read and re.split(r"[\s(]", head[1:], maxsplit=1)[0].lower() in GROUPS, []))
            else:
                open_.append((_nested(outer, split_top(head)), read, []))
        elif token == "}":
            declare()
            if len(open_) > 1:
                selectors, read, held = open_.pop()
                if read and selectors is not None:
                    yield selectors, held
    text.append(css[at:])
    declare()
    while len(open_) > 1:
        selectors, read, held = open_.pop()
        if read and selectors is not None:
            yield selectors, held


def draws_focus(declarations: list[tuple[str, str]]) -> bool:
    """Does a block draw an indicator? One that only takes the outline away does not."""
    names = [n for n, _ in declarations]
    drawn = any(n in DRAWS or n.startswith(DRAWS_FROM) and not n.startswith("border-radius") for n in names)
    removed = any(n == "outline" and v in ("none", "0") for n, v in declarations)
    return drawn and not (removed and not any(p in f"{n}:{v}" for n, v in declarations for p in PUTS_BACK))


def strips_lists(declarations: list[tuple[str, str]]) -> bool:
    """Does a block take away what makes a reader announce a list: its markers or its box?"""
    markers = any(n in ("list-style", "list-style-type") and re.search(r"\bnone\b", v) for n, v in declarations)
    return markers or any(n == "display" and v.removeprefix("inline-").startswith(("flex", "grid")) for n, v in declarations)


def facts(css: str) -> set[tuple[str, str]]:
    """(kind, name): focus (classes of :focus-visible rules), indicator (those that draw), universal (a rule for everything), list-class and
    list-tag (what loses list semantics; a tag with its scope, * for all)."""
    out: set[tuple[str, str]] = set()
    for selectors, declarations in rules(css):
        draws, strips = draws_focus(declarations), strips_lists(declarations)
        for s in selectors:
            if _FOCUS.search(s):
                named = _CLASS.findall(s)
                out |= {("focus", c) for c in named} | ({("indicator", c) for c in named} if draws else set())
                if draws and s.strip() in (":focus-visible", "*:focus-visible"):
                    out.add(("universal", "*"))
            if strips:
                last = re.split(r"[\s>+~]+", s.strip())[-1]
                named = _CLASS.findall(re.sub(r"\[[^\]]*\]", "", last))
                out |= {("list-class", c) for c in named}
                tag = re.match(r"(ul|ol)(?![\w-])", last)
                if tag and not named:
                    scopes = re.findall(r"\[(data-astro-cid-[\w-]+)\]", last) or ["*"]
                    out |= {("list-tag", f"{tag[1]}@{x}") for x in scopes}
    return out


def index(sheets: DataFrame) -> DataFrame:
    """sheet, kind, name of style sheets (sheet, css), a row a fact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(s, k, n) for s, c in zip(b["sheet"], b["css"], strict=True) for k, n in sorted(facts(c or ""))], columns=["sheet", "kind", "name"])

    return sheets.select("sheet", "css").mapInPandas(run, "sheet string, kind string, name string")


def sheets_of(pages: DataFrame) -> DataFrame:
    """sheet, css: the different style texts of pages (css), named by digest."""
    css = F.coalesce("css", F.lit(""))
    return pages.select(F.md5(css).alias("sheet"), css.alias("css")).groupBy("sheet").agg(F.first("css").alias("css"))
