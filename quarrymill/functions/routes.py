"""Columns about routes: whose they are, where custom types live, where a form's entries go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url as U

# The identity of a posts index without a page, and what precedes a custom type's archive.
POSTS_INDEX = "@posts-index"
CUSTOM_ARCHIVE = "@archive/"
# The collection that an archive's rows belong to.
ARCHIVES = {"category": "categories", "tag": "tags", "author": "authors"}
# What a form's environment variable begins with.
ENDPOINT = "WPK_FORM_ENDPOINT_"


def identity_of(kind: Column, archive: Column, collection: Column, slug: Column, locale: Column) -> Column:
    """The content that a route shows. Pages, posts and custom entries are told apart by locale, rows of registries are not; every page
    of a listing has its archive's identity. An index of posts that a page stands for (slug) is that page."""
    row = lambda c: F.concat(c, F.lit("/"), F.coalesce(slug, F.lit("")))
    entry = lambda c: U.entry_id(c, slug, locale)
    listed = F.when((archive == "posts") & slug.isNull(), POSTS_INDEX).when(archive == "posts", entry(F.lit("pages")))
    for name, registry in ARCHIVES.items():
        listed = listed.when(archive == name, row(F.lit(registry)))
    return (
        F.when(kind == "page", entry(F.lit("pages"))).when(kind == "post", entry(F.lit("posts"))).when(kind == "custom", entry(collection))
        .when(kind == "custom-archive", F.concat(F.lit(CUSTOM_ARCHIVE), collection)).when(kind == "taxonomy-archive", row(collection)).when(kind == "archive", listed)
    )


def custom_type_path(permalink: str, slug: Column, published: Column) -> Column:
    """The path of an entry of a custom type: its slug and the parts of its date are all that a permalink may name."""
    part = lambda i: F.try_element_at(F.split(published, "-", -1), F.lit(i))
    return U.expand(permalink, postname=slug, year=part(1), monthnum=part(2), day=part(3))


def custom_type_archive_path(archive: Column) -> Column:
    """The path of a custom type's archive; null for a type without one."""
    return F.when(archive.isNotNull(), U.site_path(archive))


def endpoint_variable(form_key: Column) -> Column:
    return F.concat(F.lit(ENDPOINT), F.replace(F.upper(form_key), F.lit("-"), F.lit("_")))


def transport_of(setting: Column) -> Column:
    """http-post for an https address, undecided for none, refused for anything else."""
    raw = F.trim(F.coalesce(setting, F.lit("")))
    return F.when(raw == "", "undecided").when(raw.rlike("""^https://[^\\s"'<>]+$"""), "http-post").otherwise("refused")
