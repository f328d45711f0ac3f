"""Columns about what a site shows to search engines, by path and environment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import trim_slashes

# Paths that no environment indexes, and what an indexed page says to robots.
NEVER_INDEXED = ("/search", "/404", "/404.html")
INDEXED = "index, follow, max-image-preview:large"
PRODUCTION = "production"


def is_indexable(path: Column) -> Column:
    return ~trim_slashes(path).isin(*NEVER_INDEXED)


def is_pagination(path: Column, word: str = "page") -> Column:
    """Is it a further page of a listing: the word and a number at the end?"""
    parts = F.split(trim_slashes(path), "/", -1)
    return (F.size(parts) > 2) & (F.try_element_at(parts, F.lit(-2)) == word) & F.element_at(parts, -1).rlike("^[0-9]+$")


def robots_directive(path: Column, environment: Column) -> Column:
    return F.when((environment == PRODUCTION) & is_indexable(path), INDEXED).otherwise("noindex")


def sitemap_disposition(path: Column, environment: Column) -> Column:
    """included, or why a page is not in the sitemap: preview, never, pagination."""
    return F.when(environment != PRODUCTION, "preview").when(~is_indexable(path), "never").when(is_pagination(path), "pagination").otherwise("included")
