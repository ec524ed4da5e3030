"""Scans and updates do their heavy steps once."""

import hashlib
import random

from loomgraph.operators import documents
from loomgraph.plans import scan_queries
from loomgraph.sources import fact_store


def test_rows_of_some_files_go(spark):
    rng = random.Random(2)
    rows = [([f"f{rng.randrange(30)}" for _ in range(rng.randrange(1, 5))], f"t{rng.randrange(4)}") for _ in range(300)]
    rows += rows[:20] + [(["f29", None], None), ([None, "f3"], "n")]
    scope = {"f1", "f2", "f3", "gone"}
    df = spark.createDataFrame(rows, "files array<string>, target string")
    kept = fact_store._without_files(df, spark.createDataFrame([(f,) for f in scope], "file string"))
    order = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.files, r.target) for r in kept.collect()), key=order) == sorted((r for r in rows if not scope & set(r[0])), key=order)


def test_outlines_of_a_scan_are_read_once(spark):
    nodes = scan_queries.document_scan_nodes(spark, "/root/testdata/sf0.001")
    assert "parquet" not in nodes._jdf.queryExecution().optimizedPlan().toString()


def test_a_scan_by_files_is_that_of_documents_and_shuffles_nothing(spark):
    rng = random.Random(7)
    node = "struct<id:string,title:string,content:string,hash:string,page_start:int,page_end:int,mode:string,description:string,created_by:string,x:double,y:double>"
    rows = []
    for k in range(30):
        file = f"docs/{k}.pdf"
        base = "pdf." + hashlib.sha256(file.encode()).hexdigest()[:16]
        outline = [(j, rng.choice([None, 1, 2]), rng.choice([None, "", " A "]), rng.choice([None, 1, 3, 99]), rng.choice([None, 2])) for j in range(rng.randrange(5))]
        pages = lambda: rng.choice([None, 1, 2, 3])
        known = [(f"{base}.section.{j}", "t", f"c{j}", rng.choice(["h", "g", None]), pages(), pages(), rng.choice(["AUTO", "MANUAL", None]), "d", "me", 1.0, None) for j in [1, 2, 2, 9] if rng.random() < 0.7]
        known += [(base, "t", rng.choice(["", "top"]), "h", None, None, rng.choice(["AUTO", "MANUAL"]), None, "me", None, 2.0)]
        rows.append((file, f"T{k}", rng.choice([None, 2, 5]), "h", k % 3 != 2, outline, known))
    files = spark.createDataFrame(rows, f"file string, title string, pages bigint, hash string, scanned boolean, outline array<struct<idx:int,level:int,title:string,page_start:int,page_end:int>>, known array<{node}>")
    got = documents.scan_files(files, "now")
    nodes = files.selectExpr("file", "inline(known)").selectExpr("*", "title AS label", "CAST(NULL AS STRING) AS source")
    docs = files.where("scanned").select("file", "title", "pages", "hash")
    want = documents.scan_documents(nodes, spark.createDataFrame([], "source string, target string, type string, file string"), docs, files.where("scanned").selectExpr("file", "inline(outline)"), "now")[0]
    columns = [c for c in sorted(want.columns) if c not in ("label", "source")]
    said = lambda df: sorted(str(tuple(r)) for r in df.select(columns).collect())
    assert said(got) == said(want) and got.count() > 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_documents_of_a_scan_are_shuffled_before_they_are_stored(spark):
    nodes = scan_queries.document_scan_nodes(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()
