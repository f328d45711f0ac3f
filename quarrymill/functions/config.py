"""Configuration linted on the driver: permalinks, post types, taxonomies, markup profiles. Problems are codes, not exceptions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .url import Permalinks

# Tokens that a pattern may use.
ALLOWED = {
    "post": ("postname", "year", "monthnum", "day", "category", "author"), "page": ("pagename",), "category": ("slug",), "tag": ("slug",), "author": ("nicename",),
}


def permalink_problems(p: Permalinks) -> list[str]:
    """code:setting for every rule that a permalink configuration breaks."""
    out = []
    for name, allowed in ALLOWED.items():
        pattern = getattr(p, name)
        tokens = re.findall("%([a-z_]+)%", pattern)
        out += [f"token-not-allowed:{name}.{t}" for t in tokens if t not in allowed]
        if not pattern.startswith("/"):
            out.append(f"no-leading-slash:{name}")
        if not tokens and name != "page":
            out.append(f"no-token:{name}")
        if not pattern.endswith("/") and not re.search(r"\.[A-Za-z0-9]{2,5}$", pattern):
            out.append(f"no-trailing-slash:{name}")
    if not p.posts_index.startswith("/"):
        out.append("no-leading-slash:posts_index")
    if not re.fullmatch("[a-z0-9-]+", p.pagination):
        out.append("bad-segment:pagination")
    if p.per_page < 1:
        out.append("not-positive:per_page")
    return out


@dataclass(frozen=True)
class PostType:
    name: str
    collection: str
    permalink: str
    published: bool = True


@dataclass(frozen=True)
class Taxonomy:
    name: str
    collection: str
    permalink: str
    applies_to: tuple[str, ...] = ()
    published: bool = True
    hierarchical: bool = False
    url_hierarchy: bool = False
    held_in: str = "terms"


def post_type_problems(types: list[PostType]) -> list[str]:
    """Repeated names and collections, reserved names, patterns without the entry's own name."""
    out = []
    for what in ("name", "collection"):
        seen: set[str] = set()
        for t in types:
            v = getattr(t, what)
            if v in seen:
                out.append(f"repeated-{what}:{v}")
            seen.add(v)
    out += [f"reserved:{t.name}" for t in types if t.name in ("post", "page", "attachment")]
    out += [f"no-token:{t.name}" for t in types if "%postname%" not in t.permalink]
    return out


def taxonomies(p: Permalinks, own: list[Taxonomy]) -> list[Taxonomy]:
    """The two that every site has, by its permalinks, and the configured ones."""
    return [Taxonomy("category", "categories", p.category, ("post",), True, True, True, "field"), Taxonomy("tag", "tags", p.tag, ("post",), True, False, False, "field"), *own]


def taxonomy_problems(own: list[Taxonomy], types: list[PostType]) -> list[str]:
    """Core names taken again, unknown or withheld types, hierarchy in URLs without hierarchy in data."""
    known = {t.name: t for t in types}
    out = [f"core-redefined:{t.name}" for t in own if t.name in ("category", "tag", "post_tag")]
    for t in own:
        for a in t.applies_to:
            if a not in known and a != "post":
                out.append(f"unknown-type:{t.name}.{a}")
            elif a in known and t.published and not known[a].published:
                out.append(f"withheld-type:{t.name}.{a}")
        if t.url_hierarchy and not t.hierarchical:
            out.append(f"hierarchy-in-url-only:{t.name}")
    return out


def resolve_markup(builders: list[str], profiles: dict[str, dict[str, tuple[str, ...]]], own: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """Class sets of the named builders and of the site, merged; an unknown builder is an error."""
    out: dict[str, list[str]] = {k: list(v) for k, v in own.items()}
    for b in builders:
        if b not in profiles:
            raise ValueError(f"unknown builder {b}: known are {', '.join(sorted(profiles))}")
        for k, v in profiles[b].items():
            out.setdefault(k, []).extend(x for x in v if x not in out.get(k, []))
    return {k: tuple(v) for k, v in out.items()}


def form_problems(routes: list[tuple[str, str]], forms: list[str]) -> list[str]:
    """Forms routed twice, routes without a form, forms without a route. routes: (form, transport)."""
    seen: set[str] = set()
    out = []
    for form, _ in routes:
        if form in seen:
            out.append(f"routed-twice:{form}")
        seen.add(form)
        if form not in forms:
            out.append(f"unknown-form:{form}")
    return out + [f"no-route:{f}" for f in forms if f not in seen]


def signoff(commit: str | None, digest: str, ancestors: dict[str, str], signoffs: list[dict]) -> tuple[bool, str]:
    """(signed, why): the sign-off of this very commit, else one of the same digest on an ancestor. ancestors: sha to yes, no or unknown."""
    if not commit:
        return False, "no-commit"
    for s in signoffs:
        if s["commit"] == commit:
            return True, "exact"
    same = [s for s in signoffs if s["digest"] == digest]
    if any(ancestors.get(s["commit"]) == "yes" for s in same):
        return True, "carried"
    if any(ancestors.get(s["commit"], "unknown") == "unknown" for s in same):
        return False, "ancestry-unknown"
    return False, "changed-since" if signoffs else "never-signed"


def crumbs(parents: list[tuple[str, str]], label: str) -> list[dict]:
    """Home, the parents, and the current page, which has no link."""
    return [{"label": "Home", "href": "/", "current": False}, *({"label": a, "href": b, "current": False} for a, b in parents), {"label": label, "href": None, "current": True}]


def breadcrumb_json(trail: list[dict], origin: str) -> dict | None:
    """Structured breadcrumbs; none for fewer than two, or where one before the last has no link."""
    if len(trail) < 2 or any(c["href"] is None for c in trail[:-1]):
        return None
    return {"@type": "BreadcrumbList", "itemListElement": [{"@type": "ListItem", "position": i, "name": c["label"]} | ({"item": origin.rstrip("/") + c["href"]} if c["href"] else {}) for i, c in enumerate(trail, 1)]}
