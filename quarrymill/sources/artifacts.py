"""Artifacts written by many tasks and published at once: sitemaps, manifests, search indexes, reports, overrides.

Rows (key, line) are range-partitioned and sorted by key, so the files follow each other in one global order; a file holds a bounded number
of lines between a head and a tail. Tasks write into a staging folder beside the artifact. The commit numbers the files, moves them in
and writes the index that names them last, by a rename: until then readers see the artifact as it was. A key that occurs twice is
found where it is written (equal keys share a range) and aborts the commit; so does any failed task, and staging is removed then.
Paths may be local to all tasks or URIs that Arrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import escape_xml
from ..functions.url import absolute_url
from ..operators.ordering import numbered

# Locations that one sitemap may hold, and the version of a search index.
SITEMAP_MOST, INDEX_VERSION = 50_000, 1


@dataclass(frozen=True)
class Form:
    """The text around an artifact's lines, of a file and of the index over several files; {name}, {count} and {files} are filled in."""

    name: str
    head: str
    tail: str
    between: str = "\n"
    limit: int = SITEMAP_MOST
    unique: bool = True
    index_head: str = ""
    index_line: str = '"{name}"'
    index_between: str = ","
    index_tail: str = ""

    def file(self, n: int) -> str:
        stem, dot, end = self.name.rpartition(".")
        return f"{stem}-{n}{dot}{end}"


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]
    twice: list[str]
    n_twice: int


class ArtifactWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.form = options["path"].rstrip("/"), Form(**json.loads(options["form"]))
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, staging = _filesystem(self.staging)
        fs.create_dir(staging, recursive=True)
        out, n, last, twice, n_twice, files = None, 0, None, [], 0, []
        for row in iterator:
            if self.form.unique and row["key"] == last:
                n_twice += 1
                twice = [*twice, last][:3]
            last = row["key"]
            if out is None:
                name, n = f"{staging}/{uuid.uuid4().hex}", 0
                out = fs.open_output_stream(name)
                out.write(self.form.head.encode())
            elif n:
                out.write(self.form.between.encode())
            out.write(row["line"].encode())
            n += 1
            if n == self.form.limit:
                out.write(self.form.tail.encode())
                out.close()
                files.append((name, n))
                out = None
        if out is not None:
            out.write(self.form.tail.encode())
            out.close()
            files.append((name, n))
        return Written(files, twice, n_twice)

    def _clear(self) -> None:
        fs, staging = _filesystem(self.staging)
        if fs.get_file_info(staging).type.name == "Directory":
            fs.delete_dir(staging)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileSelector

        done = [m for m in messages if m is not None]
        if any(m.n_twice for m in done):
            self._clear()
            raise ValueError(f"{self.form.name}: {sum(m.n_twice for m in done)} keys are claimed twice, as {', '.join([k for m in done for k in m.twice][:3])}")
        fs, base = _filesystem(self.path)
        files = [f for m in done for f in m.files]
        fs.create_dir(base, recursive=True)
        old = {i.path for i in fs.get_file_info(FileSelector(base)) if i.type.name == "File" and i.base_name.startswith(f"{self.form.name.rpartition('.')[0]}-")}
        count, named = sum(n for _, n in files), []
        if len(files) == 1:
            top = files[0][0]
        else:
            for i, (f, _) in enumerate(files, 1):
                named.append(self.form.file(i))
                fs.move(f, f"{base}/{named[-1]}")
            _, staging = _filesystem(self.staging)
            fs.create_dir(staging, recursive=True)
            top = f"{staging}/index"
            fill = lambda s, **v: s.replace("{count}", str(count)).replace("{files}", str(len(named))).replace("{name}", v.get("name", ""))
            text = f"{fill(self.form.index_head)}{self.form.index_between.join(fill(self.form.index_line, name=x) for x in named)}{fill(self.form.index_tail)}" if named else self.form.head + self.form.tail
            with fs.open_output_stream(top) as out:
                out.write(text.encode())
        fs.move(top, f"{base}/{self.form.name}")  # from here on the new artifact is read
        for stale in old - {f"{base}/{x}" for x in named}:
            fs.delete_file(stale)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()


class Artifact(DataSource):
    """Format ``artifact``: rows (key, line) to one artifact; options path and form (JSON of a :class:`Form`)."""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(dict(self.options))


def publish(rows: DataFrame, path: str, form: Form, parts: int | None = None) -> None:
    """Writes rows (key, line) as path/form.name, in the order of keys (and of lines, where keys may repeat). Null keys and lines are an error."""
    spark = rows.sparkSession
    spark.dataSource.register(Artifact)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bad = F.raise_error(F.lit("an artifact's key or line is null"))
    t = rows.select(F.coalesce(F.col("key").cast("string"), bad.cast("string")).alias("key"), F.coalesce("line", bad.cast("string")).alias("line"))
    order = ["key"] if form.unique else ["key", "line"]
    t = t.repartitionByRange(n, *order).sortWithinPartitions("key", "line")
    t.write.format("artifact").option("path", path).option("form", json.dumps(form.__dict__)).mode("overwrite").save()


def sharded(rows: DataFrame, form: Form) -> DataFrame:
    """file (from 1), pos (from 0), key, line: which file a row of an artifact falls into when files are filled one after the other."""
    t = numbered(rows.select("key", "line"), ["key", "line"], "n_")
    return t.select((F.floor(F.col("n_") / form.limit) + 1).cast("long").alias("file"), (F.col("n_") % form.limit).alias("pos"), "key", "line")


# the artifacts themselves


def sitemap_form(origin: str, limit: int = SITEMAP_MOST) -> Form:
    open_ = '<?xml version="1.0" encoding="UTF-8"?>\n'
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    return Form("sitemap.xml", f"{open_}<urlset {space}>\n", "\n</urlset>\n", limit=limit, index_head=f"{open_}<sitemapindex {space}>\n", index_line=f"  <sitemap><loc>{origin}/{{name}}</loc></sitemap>", index_between="\n", index_tail="\n</sitemapindex>\n")


def sitemap_rows(pages: DataFrame, origin: str) -> DataFrame:
    """key, line of a sitemap. pages: path, lastmod (or null)."""
    date = F.when(F.col("lastmod").isNotNull(), F.concat(F.lit("<lastmod>"), F.col("lastmod").cast("string"), F.lit("</lastmod>"))).otherwise("")
    loc = escape_xml(absolute_url(F.col("path"), origin))
    return pages.select(F.col("path").alias("key"), F.concat(F.lit("  <url><loc>"), loc, F.lit("</loc>"), date, F.lit("</url>")).alias("line"))


def _json(key: str, columns: list[str | Column]) -> list[Column]:
    return [F.col(key).alias("key"), F.concat(F.lit("    "), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("line")]


def _json_form(name: str, header: dict, rows: str, limit: int) -> Form:
    head = "{\n" + "".join(f"  {json.dumps(k)}: {json.dumps(v)},\n" for k, v in header.items())
    return Form(name, f'{head}  "{rows}": [\n', "\n  ]\n}\n", ",\n", limit, index_head=f'{head}  "count": {{count}},\n  "files": [', index_tail="]\n}\n")


def manifest_form(environment: str, limit: int = 1_000_000) -> Form:
    return _json_form("deployment.json", {"build": {"environment": environment}}, "routes", limit)


def manifest_rows(routes: DataFrame) -> DataFrame:
    """key, line of a deployment manifest, a path a row; a path that two routes claim aborts the writing. routes: path, file, kind, origin."""
    return routes.select(*_json("path", ["path", "file", "kind", "origin"]))


def search_form(locale: str, limit: int = 1_000_000) -> Form:
    return _json_form(f"search-index.{locale}.json", {"version": INDEX_VERSION, "locale": locale}, "documents", limit)


def search_rows(docs: DataFrame) -> DataFrame:
    """key, line of a locale's search index, by id. docs: id, kind, title, summary, url, categories, tags."""
    return docs.select(*_json("id", ["id", "kind", "title", "summary", "url", "categories", "tags"]))


def evidence(df: DataFrame, root: str, kind: str, day: str, key: str, header: dict, limit: int = 1_000_000) -> None:
    """Dated evidence of a measurement (an inventory, a capture): root/kind-day/kind.json with a header and the rows in the order of their key. A day written
    again replaces that day; other days stay. A key that occurs twice aborts, as an inventory with two rows for one key is none."""
    publish(df.select(*_json(key, [f"`{c}`" for c in df.columns])), f"{root.rstrip('/')}/{kind}-{day}", _json_form(f"{kind}.json", header, "records", limit))


def overrides_form(limit: int = 1_000_000) -> Form:
    return Form("overrides.json", "[\n", "\n]\n", ",\n", limit, index_head='{\n  "count": {count},\n  "files": [', index_tail="]\n}\n")


def overrides(captured: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: key, line; silent: path; refused: path, reason) of captured heads (path, locale, title, description, canonical, noindex, problem).

    A page whose head says nothing of its own is silent and left out; one with a problem is refused, which is for the caller to stop at.
    """
    says = F.coalesce("title", "description", "canonical").isNotNull() | F.coalesce("noindex", F.lit(False))
    good = captured.filter("problem is null")
    robots = F.when(F.col("noindex"), F.struct(F.lit(True).alias("noindex")))
    line = F.to_json(F.struct("path", "locale", "title", "description", "canonical", robots.alias("robots")))
    rows = good.filter(says).select(F.col("path").alias("key"), F.concat(F.lit("  "), line).alias("line"))
    return rows, good.filter(~says).select("path"), captured.filter("problem is not null").select("path", F.col("problem").alias("reason"))


def diff_report_form(day: str, limit: int = 100_000) -> Form:
    return Form("diff-report.md", f"# Inventory difference, {day}\n\n", "\n", limit=limit, unique=False, index_head=f"# Inventory difference, {day}\n\n{{count}} lines in {{files}} files\n\n", index_line="- [{name}]({name})", index_between="\n", index_tail="\n")


def diff_report_rows(rows: DataFrame) -> DataFrame:
    """key, line of a Markdown report by classification: a heading with the number of rows, then a line a URL. rows: key, classification, redirect_target."""
    heads = rows.groupBy("classification").agg(F.count(F.lit(1)).alias("n")).select(F.concat("classification", F.lit(" 0")).alias("key"), F.concat(F.lit("## "), "classification", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("line"))
    to = F.when(F.col("redirect_target").isNotNull(), F.concat(F.lit(" → `"), "redirect_target", F.lit("`"))).otherwise("")
    return heads.unionByName(rows.select(F.concat("classification", F.lit(" 1 "), "key").alias("key"), F.concat(F.lit("- `"), F.col("key"), F.lit("`"), to).alias("line")))
