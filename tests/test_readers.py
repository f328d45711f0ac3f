"""Small readers: documents, digests, type listings, collected media."""

from pyspark.sql import functions as F

from quarrymill.functions.url import MediaProfile
from quarrymill.operators import media as M
from quarrymill.sources import files, structured


def test_documents_and_digests(spark, tmp_path):
    for name in ("a.md", "docs/b.md", "node_modules/x/c.md", "docs/dist/d.md", "docs/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert sorted(tuple(r) for r in files.documents(spark, str(tmp_path)).collect()) == [("a.md", "a.md"), ("docs/b.md", "docs/b.md")]
    assert [tuple(r) for r in files.digests(spark, str(tmp_path)).collect()] == [("docs/e.txt", "docs/e.txt")]


def test_types_of_a_cms(spark):
    text = '{"post": {"slug": "post", "rest_base": "posts", "taxonomies": ["category"], "x": {"y": 1}}, "a": {}, "page": {"hierarchical": true, "types": ["p"]}}'
    rows = spark.createDataFrame([(text,), ("[]",), ("",)], "t string").select(structured.cms_types(F.col("t")).alias("x")).collect()
    assert [tuple(x) for x in rows[0]["x"]] == [("a", "a", "a", False, []), ("page", "page", "page", True, ["p"]), ("post", "post", "posts", False, ["category"])]
    assert rows[1]["x"] is None and rows[2]["x"] is None


def test_collected_media(spark):
    html = '<img src="/wp-content/uploads/b.png" srcset="/wp-content/uploads/a.png 1x, https://else.example/x.png 2x"><p style="background:url(/wp-content/uploads/b.png)">![x](/wp-content/uploads/md.png)<a href="/about/">'
    got = spark.createDataFrame([(html,)], "h string").select(M.collected(F.col("h"), MediaProfile()).alias("u")).first()["u"]
    assert got == ["/wp-content/uploads/a.png", "/wp-content/uploads/b.png"]


def test_an_outline_has_the_rows_of_its_sql_for_odd_titles(spark, tmp_path):
    import duckdb

    from quarrymill.plans import catalog

    titles = ["", " ", "\t", " lead", "\tlead", "  lead and trail ## ", "###", "# x", "x # #", "Top", "TOP ##", "Top 1", "x \r", "\xa0x \xa0", "x #\xa0", "x \t\xa0", "\x0b x", "x \x85", "\u2028 x", "\u0130x", "\u0391\u03a3", "e\u0301", "plain", None]
    rows = [(i * 4 + k, None if t is None else t + "\nbody") for i, t in enumerate(titles) for k in range(3)] + [(0, "again"), (0, "again"), (3, " Top"), (None, "no id"), (None, None), (-3, " minus"), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    for t in ("region", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()["w03_markdown_outline"]).fetchall()
    got = catalog.queries()["w03_markdown_outline"](spark, str(tmp_path)).select("file", "anchor", "level").collect()
    as_text = lambda t: sorted(map(repr, map(tuple, t)))
    assert as_text(got) == as_text(want)
    assert len(want) > 200
