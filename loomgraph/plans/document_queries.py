"""Outline, extraction and layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents
from .projections import project, read, with_
from .registry import query

_OUT = with_("g_outline") + ", pg AS (SELECT doc_id, CAST(max(page_start) + 2 AS INT) AS pages FROM g_outline GROUP BY 1)"
TASK = "Find Part STEEL and ECONOMY in the part list"


def _pages(outline):
    return outline.groupBy("doc_id").agg((F.max("page_start") + 2).cast("int").alias("pages"))


@query(_OUT + """SELECT a.doc_id AS doc_id, a.idx AS idx, CAST(greatest(a.page_start, coalesce((SELECT arg_min(b.page_start, b.idx) FROM g_outline b WHERE b.doc_id = a.doc_id AND b.idx > a.idx AND b.level <= a.level) - 1, pages)) AS INT) AS page_end FROM g_outline a JOIN pg USING (doc_id)""")
def section_ranges(spark, sf):
    o = project(spark, sf, "g_outline")
    return documents.section_ranges(o, _pages(o)).select("doc_id", "idx", "page_end")


@query(_OUT + """SELECT a.doc_id AS doc_id, a.idx AS idx, (SELECT max(b.idx) FROM g_outline b WHERE b.doc_id = a.doc_id AND b.idx < a.idx AND b.level < a.level) AS parent_idx FROM g_outline a""")
def section_parent(spark, sf):
    o = project(spark, sf, "g_outline")
    return documents.section_ranges(o, _pages(o)).select("doc_id", "idx", "parent_idx")


_TERMS = ["find", "part", "steel", "and", "economy", "in", "the", "list"]
_HITS = " + ".join(f"CASE WHEN contains(lower(title), '{t}') THEN {4 if len(t) >= 4 else 2} ELSE 0 END" for t in _TERMS)


@query(with_("g_outline") + f""", s AS (SELECT *, CASE WHEN contains('{TASK.lower()}', lower(title)) THEN 20 ELSE 0 END + {_HITS} AS score FROM g_outline), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_start, idx) AS rk FROM s WHERE score > 0)
SELECT doc_id, idx, CAST(score AS INT) AS score, CAST(rk AS INT) AS rank FROM r WHERE rk <= 3""")
def rank_sections(spark, sf):
    return documents.rank_sections(project(spark, sf, "g_outline"), TASK, 3).select("doc_id", "idx", "score", "rank")


@query("""WITH t AS (SELECT doc_id % 50 AS request, doc_id AS ord, length(coalesce(text, '')) AS size, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY doc_id % 50 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT request, ord, CAST(least(size, 8000 - before) AS BIGINT) AS taken, least(size, 8000 - before) < size AS truncated FROM t WHERE before < 8000""")
def bounded_extract(spark, sf):
    d = read(spark, sf, "documents")
    s = d.select((F.col("doc_id") % 50).alias("request"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"), "text")
    return documents.bounded_extract(s, 2000).select("request", "ord", "taken", "truncated")


# What marks a line as code, written out for the oracle.
_MARKERS = ["def ", "class ", "function ", "const ", "let ", "var ", "import ", "from ", "curl ", "http ", "#include", "=>", "{", "}", ";", "//", "<?", "select ", "post ", "get "]
_MARKED = "(" + " OR ".join(f"contains(low, '{m}')" for m in _MARKERS) + ")"


@query(rf"""WITH l AS (SELECT page_id AS doc_id, unnest(string_split(html, '>')) AS line, unnest(range(len(string_split(html, '>')))) AS line_no FROM pages), b AS (SELECT *, lower(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS low FROM l),
c AS (SELECT doc_id, line_no, low <> '' AND (regexp_matches(line, '^\s') OR {_MARKED} OR starts_with(low, '$ ') OR starts_with(low, '> ') OR starts_with(low, '... ')) AS code FROM b),
i AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM c WHERE code)
SELECT doc_id, CAST(min(line_no) AS INT) AS first_line, count(*) AS n_lines FROM i GROUP BY doc_id, g HAVING count(*) >= 2""")
def code_islands(spark, sf):
    lines = read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.split("html", ">", -1)).alias("line_no", "line"))
    return documents.code_islands(lines)


@query(r"""WITH c AS (SELECT n_regionkey AS k, [['key', 'name|x', '']] || list([CAST(n_nationkey AS VARCHAR), ' ' || n_name || ' '] ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1)
SELECT k, '| key | name\|x |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(rows[2:], lambda r: '| ' || r[1] || ' | ' || trim(r[2]) || ' |  |'), chr(10)) AS markdown FROM c""")
def table_markdown(spark, sf):
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("r"))
    rows = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list(row)).alias("a"))
    head = F.array(F.array(F.lit("key"), F.lit("name|x"), F.lit("")))
    return rows.select("k", T.table_markdown(F.concat(head, F.transform("a", lambda x: x["r"]), F.array(F.array(F.lit(""), F.lit(" ")))))).toDF("k", "markdown")


@query(r"""SELECT conv_id, turn, CASE WHEN contains(lower(text), '#include') OR contains(lower(text), 'std::') THEN 'cpp' WHEN contains(lower(text), 'def ') OR (contains(lower(text), 'import ') AND contains(text, ':')) THEN 'python'
 WHEN contains(lower(text), 'const ') OR contains(lower(text), 'let ') OR contains(text, '=>') THEN 'javascript' WHEN contains(lower(text), 'curl ') OR regexp_matches(ltrim(lower(text)), '^(get|post|put|delete) ') THEN 'http'
 WHEN contains(lower(text), 'select ') AND contains(lower(text), ' from ') THEN 'sql' WHEN regexp_matches(ltrim(text), '^[\{\[]') THEN 'json' ELSE 'text' END AS language FROM conversations""")
def code_language(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", T.code_language(F.col("text")).alias("language"))


@query("SELECT page_id, 'pdf.' || substring(sha256(url), 1, 16) AS id FROM pages")
def document_ids(spark, sf):
    return read(spark, sf, "pages").select("page_id", documents.document_id(F.col("url")).alias("id"))
