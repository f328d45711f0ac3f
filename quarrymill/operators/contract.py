"""The content contract: strict schemas over entries and registries, and the rules that cross a whole content tree.

A row is a map of fields, nested keys with dots, each with the list of its values. A schema is compiled to one projection that gives a row's
errors as an array: required and unknown keys by differences of key sets, the form of each value, and rules between fields. The tree's
rules are aggregates and joins over what the rows say: sole identities, source entities, clusters, parents, references.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U
from . import hierarchy as Y
from . import identity as I
from .lineage import cut

# Systems that content comes from, ways it was written, formats of bodies, dispositions.
SYSTEMS = ("wordpress", "authored", "sample")
MODELS = ("gutenberg", "classic", "elementor", "html", "markdown")
FORMATS = ("html", "markdown")
DISPOSITIONS = ("preserve", "fix")
MIGRATED = ("SUPPORTED", "CONFIGURED")


@dataclass(frozen=True)
class Site:
    """What values are judged by: languages, the default one, and whose media are the site's own."""

    locales: tuple[str, ...] = ("en",)
    default: str = "en"
    media: U.MediaProfile = field(default_factory=U.MediaProfile)


@dataclass(frozen=True)
class Field:
    """A key and the form of its values; options are the values of a choice; least is the least number of them, for a list."""

    name: str
    form: str = "text"
    required: bool = False
    options: tuple[str, ...] = ()
    least: int = 0


SOURCE = (Field("source.system", "choice", True, SYSTEMS), Field("source.sourceId"), Field("source.capturedAt", "date"), Field("source.authoringModel", "choice", options=MODELS))
ENTRY = (Field("slug", "slug", True), Field("title", required=True), Field("locale", "locale", True), Field("cluster", "cluster", True), Field("updatedAt", "date", True), *SOURCE)
IMAGE = lambda name: (Field(f"{name}.url", "media"), Field(f"{name}.alt", "any"), Field(f"{name}.width", "count"), Field(f"{name}.height", "count"), Field(f"{name}.variants.url", "media"), Field(f"{name}.variants.width", "count"), Field(f"{name}.variants.height", "count"))

#: The schemas by name: fields; a name that ends with .* stands for a value a language.
SCHEMAS: dict[str, tuple[Field, ...]] = {
    "posts": (*ENTRY, Field("publishedAt", "date", True), Field("author", "slug", True), Field("categories", "slug", True, least=1), Field("tags"), Field("excerpt"), *IMAGE("featuredImage"), Field("bodyFormat", "choice", options=FORMATS)),
    "pages": (*ENTRY, Field("parent", "slug"), Field("form", "slug"), Field("excerpt"), Field("bodyFormat", "choice", options=FORMATS)),
    "authors": (Field("slug", "slug", True), Field("name", required=True), Field("nicename", "nicename"), Field("bio"), *IMAGE("avatar"), Field("social.label"), Field("social.url", "address"), *SOURCE),
    "terms": (Field("slug", "slug", True), Field("parent", "slug"), Field("name.*", required=True), Field("description.*"), *SOURCE),
    "overrides": (Field("path", "path", True), Field("locale", "locale", True), Field("metaTitle"), Field("metaDescription"), Field("canonical"), Field("robots.noindex", "flag"), Field("robots.nofollow", "flag"), *IMAGE("ogImage"), Field("disposition.state", "choice", options=DISPOSITIONS), Field("disposition.note"), *SOURCE),
}


def usable_media(url: Column, profile: U.MediaProfile) -> Column:
    """Is it the site's own file, or another host's over https that is not in the uploads of a WordPress?"""
    cls = U.identify_asset(url, profile)["classification"]
    return cls.isin(*MIGRATED) | ((cls == "EXTERNAL") & F.lower(url).startswith("https://") & ~url.contains(f"/{profile.uploads.strip('/')}/"))


def well_formed(f: Field, v: Column, site: Site) -> Column:
    """Is a value of the field's form?"""
    word = r"[\p{Ll}\p{Lo}\p{Lm}\p{N}\p{M}_]+"
    return {
        "any": F.lit(True), "text": v != "", "slug": U.is_slug(v), "locale": v.isin(*site.locales), "cluster": v.rlike(rf"^[a-z0-9-]+/{word}(-{word})*$"), "choice": v.isin(*f.options) if f.options else F.lit(True),
        "date": v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(v, "yyyy-MM-dd").isNotNull(), "count": v.rlike("^[1-9][0-9]*$"), "flag": v.isin("true", "false"), "nicename": v.rlike("^[a-z0-9._-]+$"),
        "address": v.rlike(r"^[a-z][a-z0-9+.-]*:\S+$"), "path": v.rlike(r"^/[^?#\s]*$"), "media": usable_media(v, site.media),
    }[f.form]


def errors(fields: Column, schema: str, site: Site) -> Column:
    """array of struct(at, code) of a row: missing, unknown-key, bad-<form> and the rules between fields."""
    spec = SCHEMAS[schema]
    say = lambda at, code: F.struct(at.alias("at"), F.lit(code).alias("code"))
    keys = F.map_keys(fields)
    got = lambda name: F.try_element_at(fields, F.lit(name))
    first = lambda name: F.get(got(name), F.lit(0))
    each: list[Column] = []
    known: list[str] = []
    for f in spec:
        names = [f"{f.name[:-1]}{x}" for x in site.locales] if f.name.endswith(".*") else [f.name]
        known += names
        if f.required:
            wanted = f"{f.name[:-1]}{site.default}" if f.name.endswith(".*") else f.name
            each.append(F.when(got(wanted).isNull() | (F.size(got(wanted)) < max(1, f.least)), say(F.lit(wanted), "missing")))
        if f.form != "any":
            each += [F.when(F.exists(got(n), lambda v: ~F.coalesce(well_formed(f, v, site), F.lit(False))), say(F.lit(n), f"bad-{f.form}")) for n in names]
    if any(f.name == "source.system" for f in spec):
        wp = first("source.system") == "wordpress"
        id_ = first("source.sourceId")
        each.append(F.when(wp & (F.coalesce(id_, F.lit("")).eqNullSafe("") | first("source.capturedAt").isNull()), say(F.lit("source.sourceId"), "wordpress-without-identity")))
        if schema != "overrides":
            each.append(F.when(wp & ~F.coalesce(id_, F.lit("")).rlike("^[1-9][0-9]*$"), say(F.lit("source.sourceId"), "source-id-is-no-key")))
    unknown = F.filter(keys, lambda k: ~k.isin(*known))
    return F.concat(F.array_compact(F.array(*each)), F.transform(unknown, lambda k: say(k, "unknown-key")))


def flattened(rows: DataFrame, nested: tuple[str, ...] = ("source", "name", "description", "avatar", "ogImage", "robots", "disposition")) -> DataFrame:
    """file, pos, fields of the rows of JSON registries (file, text): objects under these keys give keys with dots. A file that is no array of rows has
    one row, pos -1, without fields."""
    many = "array<map<string,string>>"
    t = rows.select("file", F.from_json("text", many).alias("a"), F.ltrim("text").startswith("[").alias("ok"))
    bad = t.filter(~F.coalesce("ok", F.lit(False)) | F.col("a").isNull()).select("file", F.lit(-1).alias("pos"), F.lit(None).cast("map<string,array<string>>").alias("fields"))
    t = t.filter(F.coalesce("ok", F.lit(False))).select("file", F.posexplode("a").alias("pos", "m"))
    pairs = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), F.array(e["value"]).alias("v")))
    inner = lambda n: F.transform(F.map_entries(F.coalesce(F.from_json(F.try_element_at("m", F.lit(n)), "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lit(f"{n}."), e["key"]).alias("k"), F.array(e["value"]).alias("v")))
    is_object = lambda e: e["k"].isin(*nested) & F.coalesce(F.ltrim(e["v"][0]).startswith("{"), F.lit(False))
    every = F.concat(F.filter(pairs(F.col("m")), lambda e: ~is_object(e) & e["v"][0].isNotNull()), *[inner(n) for n in nested])
    return t.select("file", "pos", F.map_from_entries(every).alias("fields")).unionByName(bad)


def schema_findings(rows: DataFrame, schema: str, site: Site) -> DataFrame:
    """at, code, detail of rows (at, fields) against a schema; null fields are a row that could not be read."""
    return _told(_judged(rows, schema, site))


def _judged(rows: DataFrame, schema: str, site: Site) -> DataFrame:
    """rows with their errors, cut off: the schema is applied once."""
    unread = F.array(F.struct(F.lit("").alias("at"), F.lit("unreadable").alias("code")))
    return cut(rows.withColumn("errors_", F.when(F.col("fields").isNull(), unread).otherwise(errors(F.col("fields"), schema, site))))


def _told(judged: DataFrame) -> DataFrame:
    return judged.select("at", F.explode("errors_").alias("e")).select("at", F.col("e.code").alias("code"), F.col("e.at").alias("detail"))


def tree_findings(entries: DataFrame, registries: dict[str, DataFrame], site: Site) -> DataFrame:
    """at, code, detail of what crosses the tree. entries: at, collection, fields (read ones); registries: name to at, fields, of authors, categories, tags."""
    one = lambda n: F.get(F.try_element_at("fields", F.lit(n)), F.lit(0))
    say = lambda d, at, code, detail: d.select(at.cast("string").alias("at"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    e = cut(entries.select("at", "collection", one("slug").alias("slug"), one("locale").alias("locale"), one("cluster").alias("cluster"), one("parent").alias("parent"), one("author").alias("author"), F.coalesce(F.try_element_at("fields", F.lit("categories")), F.array().cast("array<string>")).alias("categories"),
        F.coalesce(F.try_element_at("fields", F.lit("tags")), F.array().cast("array<string>")).alias("tags"), one("source.system").alias("system"), one("source.sourceId").alias("source_id")))
    identity = U.entry_id(F.col("collection"), F.col("slug"), F.col("locale"))
    twice = I.sole_claimant(e.filter("slug is not null and locale is not null"), identity, "at")
    out = say(twice, F.col("key"), "identity-claimed-twice", F.col("claimants"))
    wp = e.filter("system = 'wordpress' and source_id is not null").select(F.concat_ws("#", "collection", "source_id").alias("source"), F.concat_ws("@", "source_id", "locale").alias("s"), "collection", "at")
    again = I.sole_claimant(wp, F.concat_ws("#", "collection", "s"), "at")
    out = out.unionByName(say(again, F.col("key"), "source-claimed-twice", F.col("claimants")))
    clusters = I.cluster_issues(e.filter("cluster is not null").select("cluster", "locale", "slug", F.col("at").alias("id")), site.default)
    out = out.unionByName(say(clusters, F.col("cluster"), "cluster-issue", F.concat_ws(":", "code", "detail")))
    parents = Y.parent_issues(e.filter("collection = 'pages' and slug is not null").select(F.concat_ws("@", "slug", "locale").alias("slug"), F.when(F.col("parent").isNotNull(), F.concat_ws("@", "parent", "locale")).alias("parent")).dropDuplicates(["slug"]))
    out = out.unionByName(say(parents, F.col("slug"), "page-parent", F.col("code")))
    for name, column in (("authors", F.array_compact(F.array("author"))), ("categories", F.col("categories")), ("tags", F.col("tags"))):
        if name in registries:
            known = registries[name].select(one("slug").alias("v")).filter("v is not null").distinct()
            asked = e.select("at", F.explode(F.array_distinct(column)).alias("v"))
            out = out.unionByName(say(asked.join(known, "v", "left_anti"), F.col("at"), f"unknown-{name}", F.col("v")))
    for name, rows in registries.items():
        shared = I.sole_claimant(rows.select("at", one("slug").alias("slug")).filter("slug is not null"), "slug", "at")
        out = out.unionByName(say(shared, F.concat(F.lit(f"{name}/"), "key"), "slug-claimed-twice", F.col("claimants")))
        if name == "authors":
            nice = I.sole_claimant(rows.select("at", F.coalesce(one("nicename"), one("slug")).alias("n")).filter("n is not null"), "n", "at")
            out = out.unionByName(say(nice, F.concat(F.lit("authors/"), "key"), "nicename-claimed-twice", F.col("claimants")))
        else:
            t = rows.select("at", one("slug").alias("slug"), one("parent").alias("parent")).filter("parent is not null")
            out = out.unionByName(say(t.filter("slug = parent"), F.col("at"), "term-is-its-parent", F.col("parent")))
            out = out.unionByName(say(t.filter("not slug <=> parent").join(rows.select(one("slug").alias("parent")).distinct(), "parent", "left_anti"), F.col("at"), "unknown-parent", F.col("parent")))
    return out


def validate(entries: DataFrame, registries: dict[str, DataFrame], site: Site, production: bool = False) -> DataFrame:
    """at, code, detail of a whole content tree. entries: at, collection (posts, pages), fields; registries: name (authors, categories, tags, overrides) to at, fields.

    Only rows that keep their schema take part in the tree's rules, as only they are read. In production sample content is refused.
    """
    out, good = None, []
    for name in ("posts", "pages"):
        rows = _judged(entries.filter(F.col("collection") == name), name, site)
        out = _told(rows) if out is None else out.unionByName(_told(rows))
        good.append(rows.filter("size(errors_) = 0").drop("errors_"))
    read = good[0].unionByName(good[1])
    for name, rows in registries.items():
        out = out.unionByName(schema_findings(rows, name if name in SCHEMAS else "terms", site))
    terms = {n: r.filter("fields is not null") for n, r in registries.items() if n != "overrides"}
    out = out.unionByName(tree_findings(read, terms, site))
    if "overrides" in registries:
        one = lambda n: F.get(F.try_element_at("fields", F.lit(n)), F.lit(0))
        shared = I.sole_claimant(registries["overrides"].filter("fields is not null").select("at", F.concat_ws("@", one("path"), one("locale")).alias("k")), "k", "at")
        out = out.unionByName(shared.select(F.col("key").alias("at"), F.lit("override-claimed-twice").alias("code"), F.col("claimants").alias("detail")))
    if production:
        system = F.get(F.try_element_at("fields", F.lit("source.system")), F.lit(0))
        for rows in (read, *registries.values()):
            out = out.unionByName(rows.filter(system == "sample").select("at", F.lit("sample-content").alias("code"), F.lit("").alias("detail")))
    return out
