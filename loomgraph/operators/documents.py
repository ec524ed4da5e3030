"""Document outlines: ranges, hierarchy, ranking, bounded extraction, layout (survey rows D1-D12, S17-S19).

Outlines are rows ``doc_id, idx, level, title, page_start``. A document's outline is one array of its entries' numbers, so ranges
and parents are folds inside a row, without a self-join: time grows with the outline, however many entries share a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_like, filled, task_terms


def clean_outline(sections: DataFrame, pages: Column) -> DataFrame:
    """Levels from 1, pages within the document, ends not before starts."""
    start = F.least(F.greatest(F.coalesce("page_start", F.lit(1)), F.lit(1)), pages)
    return sections.withColumns({"level": F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), "page_start": start, "page_end": F.least(F.greatest(F.coalesce("page_end", start), start), pages)})


def section_ranges(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, idx, level, page_start, page_end, parent_idx``: a section ends on the page before the next one of its level
    or above (on its own start page at least), else with the document; its parent is the last section before it of a lower level.

    pages: ``doc_id, pages``. One pass each way over the outline with the last place of every level.
    """
    entry = F.struct("idx", "level", "page_start")
    rows = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("s")).join(pages, "doc_id")
    none = F.lit(None).cast("int")
    stack = "array<struct<idx:int,level:int,page:int>>"
    empty = F.array().cast(stack)
    # the stack holds entries whose levels grow: those that may still be a parent (or, from behind, an end)
    push = lambda st, x: F.concat(F.filter(st, lambda e: e["level"] < x["level"]), F.array(F.struct(x["idx"].cast("int").alias("idx"), x["level"].cast("int").alias("level"), x["page_start"].cast("int").alias("page"))))
    top = lambda st: F.try_element_at(st, F.lit(-1))

    def forward(acc, x):
        above = F.filter(acc["st"], lambda e: e["level"] < x["level"])
        return F.struct(push(acc["st"], x).alias("st"), F.concat(acc["out"], F.array(F.coalesce(top(above)["idx"], F.lit(-1)))).alias("out"))

    def backward(acc, x):
        next_ = F.filter(acc["st"], lambda e: e["level"] <= x["level"])
        kept = F.concat(F.filter(acc["st"], lambda e: e["level"] < x["level"]), F.array(F.struct(x["idx"].cast("int").alias("idx"), x["level"].cast("int").alias("level"), x["page_start"].cast("int").alias("page"))))
        return F.struct(kept.alias("st"), F.concat(acc["out"], F.array(F.coalesce(top(next_)["page"], F.lit(-1)))).alias("out"))

    start = F.struct(empty.alias("st"), F.array().cast("array<int>").alias("out"))
    parents = F.aggregate("s", start, forward, lambda a: a["out"])
    ends = F.reverse(F.aggregate(F.reverse("s"), start, backward, lambda a: a["out"]))
    flat = rows.select("doc_id", "pages", F.explode(F.arrays_zip(F.col("s").alias("s"), parents.alias("p"), ends.alias("e"))).alias("z"))
    end = F.when(F.col("z.e") < 0, F.col("pages")).otherwise(F.col("z.e") - 1)
    return flat.select("doc_id", F.col("z.s.idx").alias("idx"), F.col("z.s.level").alias("level"), F.col("z.s.page_start").alias("page_start"), F.greatest(F.col("z.s.page_start"), end).alias("page_end"), F.when(F.col("z.p") >= 0, F.col("z.p")).otherwise(none).alias("parent_idx"))


def rank_sections(sections: DataFrame, task: str, most: int = 5) -> DataFrame:
    """Per document the sections whose title the task names (20) or shares terms with (4 for four characters or more, else 2)."""
    title = F.lower(F.coalesce("title", F.lit("")))
    named = F.when((title != "") & F.contains(F.lit(task.lower()), title), 20).otherwise(0)
    hits = F.aggregate(task_terms(F.lit(task), "document"), F.lit(0), lambda s, t: s + F.when(F.contains(title, t), F.when(F.length(t) >= 4, 4).otherwise(2)).otherwise(0))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "page_start", "idx")
    scored = sections.withColumn("score", named + hits).where("score > 0").withColumn("rank", F.row_number().over(w))
    return scored.where(F.col("rank") <= max(1, min(20, most)))


def bounded_extract(sections: DataFrame, max_tokens: int = 12_000) -> DataFrame:
    """Per request sections in order, cut where four characters a token are used up: ``request, ord, id, taken, truncated``.

    What is left for a section is the budget less all before it, a running sum.
    """
    limit = max(100, min(50_000, max_tokens)) * 4
    size = F.length(F.coalesce("text", F.lit("")))
    before = F.coalesce(F.sum(size).over(Window.partitionBy("request").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = sections.withColumns({"size": size, "before": before}).where(F.col("before") < limit)
    taken = F.least(F.col("size"), limit - F.col("before"))
    return rows.select("request", "ord", "id", taken.cast("bigint").alias("taken"), (taken < F.col("size")).alias("truncated"), F.substring(F.coalesce("text", F.lit("")), F.lit(1), taken.cast("int")).alias("text"))


def code_islands(lines: DataFrame) -> DataFrame:
    """``doc_id, first_line, n_lines`` of runs of two or more code-like lines. Rows ``doc_id, line_no, line``."""
    marked = lines.withColumn("code", code_like(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    runs = marked.where("code").withColumn("island", F.col("line_no") - F.row_number().over(w))
    return runs.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines")).where("n_lines >= 2").drop("island")


def document_id(path: Column) -> Column:
    """A document's id from its path."""
    return F.concat(F.lit("pdf."), F.substring(F.sha2(path, 256), 1, 16))


def upsert_sections(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """Sections after a new scan: by hand ones stay; others take the scan's range and keep their text only if hash and range are
    the same. Rows ``id, hash, page_start, page_end, text, mode``."""
    new = scanned.select("id", F.col("hash").alias("h"), F.col("page_start").alias("a"), F.col("page_end").alias("b"), F.lit(True).alias("found"))
    both = known.withColumn("known", F.lit(True)).join(new, "id", "full_outer")
    manual = F.coalesce(F.col("mode") == "MANUAL", F.lit(False))
    same = F.col("hash").eqNullSafe(F.col("h")) & F.col("page_start").eqNullSafe(F.col("a")) & F.col("page_end").eqNullSafe(F.col("b"))
    rows = both.where(F.col("found") | manual)
    keep = lambda own, fresh: F.when(manual, F.col(own)).otherwise(F.col(fresh)).alias(own)
    return rows.select("id", keep("hash", "h"), keep("page_start", "a"), keep("page_end", "b"), F.when(manual | same, F.col("text")).alias("text"), F.coalesce("mode", F.lit("AUTO")).alias("mode"))


def layout_artifacts(artifacts: DataFrame, max_tokens: int = 12_000, overhead: int = 64) -> DataFrame:
    """Per section code blocks, then tables, as child nodes with hashed ids, as long as text and overhead fit the budget.

    Rows ``section_id, kind (code|table), ord, text``. As every artifact that fits is taken whole, this is an ordered fold.
    """
    limit = max(100, min(50_000, max_tokens)) * 4
    size = (F.length(F.coalesce("text", F.lit(""))) + overhead).alias("size")
    key = F.struct(F.when(F.col("kind") == "code", 0).otherwise(1).alias("k"), "ord", size)
    packed = artifacts.groupBy("section_id").agg(F.sort_array(F.collect_list(key)).alias("a"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<k:int,ord:bigint>>").alias("out"))
    fits = lambda s, x: s["used"] + x["size"] <= limit
    step = lambda s, x: F.struct(F.when(fits(s, x), s["used"] + x["size"]).otherwise(s["used"]).alias("used"), F.when(fits(s, x), F.concat(s["out"], F.array(F.struct(x["k"].alias("k"), x["ord"].cast("bigint").alias("ord"))))).otherwise(s["out"]).alias("out"))
    took = packed.select("section_id", F.explode(F.aggregate("a", start, step, lambda s: s["out"])).alias("t")).select("section_id", F.when(F.col("t.k") == 0, "code").otherwise("table").alias("kind"), F.col("t.ord").alias("ord"))
    out = artifacts.join(took, ["section_id", "kind", "ord"])
    return out.withColumn("id", F.concat("section_id", F.lit("."), F.substring(F.sha2(F.concat_ws(":", "kind", F.col("ord").cast("string"), "text"), 256), 1, 12)))


# What a node keeps of the one that it takes the place of.
_WAS = ("content", "description", "created_by", "mode", "hash", "page_start", "page_end", "x", "y")


def _sections(parts: DataFrame) -> DataFrame:
    """Entries of outlines, cleaned, with their ids and names. Rows also have ``doc_id, pages``."""
    parts = clean_outline(parts.withColumn("page_end", F.coalesce("page_end", "pages")), F.col("pages")).withColumn("id", F.concat("doc_id", F.lit(".section."), (F.col("idx") + 1).cast("string")))
    return parts.withColumn("name", filled(F.trim(F.coalesce("title", F.lit(""))), F.concat(F.lit("Section "), (F.col("idx") + 1).cast("string"))))


def _by_hand(now: str) -> tuple[Column, list[Column]]:
    manual = F.coalesce(F.col("was_mode") == "MANUAL", F.lit(False))
    return manual, [F.when(manual, F.col("was_created_by")).otherwise("analyzer").alias("created_by"), F.lit("active").alias("status"), F.when(manual, "MANUAL").otherwise("AUTO").alias("mode"), F.lit(now).alias("updated_at")]


def _top_nodes(tops: DataFrame, now: str) -> DataFrame:
    """Nodes of documents, from rows with what the scan found and what the node was."""
    manual, by_hand = _by_hand(now)
    said = F.concat(F.lit("PDF document: "), "file", F.lit("\nPages: "), F.col("pages").cast("string"), F.lit("\nOutline sections: "), F.col("n").cast("string"))
    told = F.concat(F.lit("PDF document with "), F.col("pages").cast("string"), F.lit(" pages and "), F.col("n").cast("string"), F.lit(" outline sections."))
    kept = lambda own, new: filled(F.when(manual, F.col(own)), new)
    none = F.lit(None).cast("int")
    return tops.select(
        "id", F.lit("documentation").alias("type"), "title", F.col("title").alias("label"), kept("was_content", said).alias("content"), kept("was_description", told).alias("description"), F.col("file").alias("source"), *by_hand,
        F.coalesce("was_x", F.lit(80.0)).alias("x"), F.coalesce("was_y", F.lit(80.0)).alias("y"), "file", F.col("now_hash").alias("hash"), none.alias("page_start"), none.alias("page_end"),
    )


def _section_nodes(rows: DataFrame, now: str) -> DataFrame:
    """Nodes of sections, likewise."""
    manual, by_hand = _by_hand(now)
    same = manual | (F.col("was_hash").eqNullSafe(F.col("now_hash")) & F.col("was_page_start").eqNullSafe(F.col("page_start")) & F.col("was_page_end").eqNullSafe(F.col("page_end")))
    return rows.select(
        "id", F.lit("documentation").alias("type"), F.col("name").alias("title"), F.col("name").alias("label"), F.when(same, F.coalesce("was_content", F.lit(""))).otherwise("").alias("content"),
        F.concat("file", F.lit(", pages "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")).alias("description"), F.concat("file", F.lit("#page="), F.col("page_start").cast("string")).alias("source"), *by_hand,
        F.coalesce("was_x", 80.0 + F.col("level") * 240).alias("x"), F.coalesce("was_y", 80.0 + (F.col("idx") + 1) * 130).alias("y"), "file", F.col("now_hash").alias("hash"), F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"),
    )


def scan_files(files: DataFrame, now: str) -> DataFrame:
    """D4 where a row has all of a file: the nodes that ``scan_documents`` gives, without a shuffle.

    files: ``file, title, pages, hash, scanned, outline, known``: outline, an array of ``idx, level, title, page_start, page_end``, and
    known, the nodes that the file has; their ids are the document's or begin with it.
    """
    files = files.withColumns({"pages": F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)), "doc_id": document_id(F.col("file"))}).withColumnRenamed("hash", "now_hash")
    scanned = files.where("scanned")

    def with_was(df: DataFrame) -> DataFrame:
        df = df.withColumn("was", F.explode_outer(F.filter("known", lambda x: x["id"] == F.col("id"))))
        return df.withColumns({f"was_{c}": F.col("was")[c] for c in _WAS})

    tops = with_was(scanned.withColumns({"n": F.size("outline"), "id": F.col("doc_id")}))
    parts = scanned.select("file", "doc_id", "pages", "now_hash", "known", F.inline("outline"))
    made = _top_nodes(tops, now).unionByName(_section_nodes(with_was(_sections(parts)), now))
    ids = F.concat(F.array("doc_id"), F.transform("outline", lambda x: F.concat("doc_id", F.lit(".section."), (x["idx"] + 1).cast("string"))))
    stay = files.withColumn("known", F.filter("known", lambda x: ~F.col("scanned") | ((x["mode"] == "MANUAL") & ~F.array_contains(ids, x["id"]))))
    return stay.select("file", F.inline("known")).unionByName(made, allowMissingColumns=True)


def scan_documents(nodes: DataFrame, edges: DataFrame, documents: DataFrame, outlines: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph after a scan of documents: each document and its sections as nodes, joined by ``contains``.

    documents: ``file, title, pages, hash``; outlines: ``file, idx, level, title, page_start, page_end``; nodes: at least ``id, title, label,
    content, description, source, created_by, mode, file, hash, page_start, page_end, x, y``; edges: ``source, target, type, file``.
    What a scanned file had before goes, but for nodes by hand; a section keeps its text while hash and pages are the same.
    """
    docs = documents.select("file", "title", F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1)).alias("pages"), F.col("hash").alias("now_hash"), document_id(F.col("file")).alias("doc_id"))
    parts = _sections(outlines.join(docs.select("file", "doc_id", "pages", "now_hash"), "file"))
    scanned = docs.select("file").distinct()
    old = nodes.join(scanned, "file", "left_semi")
    was = old.select("id", *[F.col(c).alias(f"was_{c}") for c in _WAS])
    count = parts.groupBy("file").agg(F.count("*").alias("n"))
    tops = docs.join(count, "file", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "id": F.col("doc_id")}).join(was, "id", "left")
    made = _top_nodes(tops, now).unionByName(_section_nodes(parts.join(was, "id", "left"), now))
    # what is made is known by its ids, before anything is joined to it
    stay = nodes.join(docs.select(F.col("doc_id").alias("id")).unionByName(parts.select("id")), "id", "left_anti")
    stay = stay.join(scanned.withColumn("scanned_", F.lit(True)), "file", "left").where("scanned_ IS NULL OR mode = 'MANUAL'").drop("scanned_")
    parent = section_ranges(parts.select("doc_id", "idx", "level", "page_start"), docs.select("doc_id", "pages")).select("doc_id", "idx", "parent_idx")
    inside = parent.join(docs.select("doc_id", "file"), "doc_id").select(
        F.when(F.col("parent_idx").isNull(), F.col("doc_id")).otherwise(F.concat("doc_id", F.lit(".section."), (F.col("parent_idx") + 1).cast("string"))).alias("source"),
        F.concat("doc_id", F.lit(".section."), (F.col("idx") + 1).cast("string")).alias("target"), F.lit("contains").alias("type"), "file",
    )
    return stay.unionByName(made, allowMissingColumns=True), edges.join(scanned, "file", "left_anti").unionByName(inside, allowMissingColumns=True)
