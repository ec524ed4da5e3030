"""Code-fact queries over small sources made of the driver's tables (rows only: SQL cannot parse code)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import code_facts
from .projections import read
from .registry import query


def _sources(spark, sf):
    """A Python file a nation and a C file and header a region."""
    n = read(spark, sf, "nation")
    low = F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    other = F.concat(F.lit("n"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("string"))
    body = F.format_string("from pkg import %s\nimport os\n\nclass C_%s:\n    def run(self, x: int) -> int:\n        return self.step(x) + %s.main()\n\n    def step(self, x):\n        return x\n\ndef main():\n    c = C_%s()\n    return c.run(1)\n", other, low, other, low)
    py = n.select(F.concat(F.lit("pkg/n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))
    r = read(spark, sf, "region")
    key = F.col("r_regionkey").cast("string")
    c = r.select(F.concat(F.lit("c/r"), key, F.lit(".c")).alias("path"), F.concat(F.lit('#include "r'), key, F.lit('.h"\nint help_'), key, F.lit("(int a) { return a; }\nint main_"), key, F.lit("(void) { return help_"), key, F.lit("(2); }\n")).alias("content"))
    h = r.select(F.concat(F.lit("c/r"), key, F.lit(".h")).alias("path"), F.concat(F.lit("int help_"), key, F.lit("(int a);\n")).alias("content"))
    return py.unionByName(c).unionByName(h)


@query()
def py_symbols(spark, sf):
    return code_facts.code_facts(_sources(spark, sf))["symbols"].where("path like '%.py'").select("id", "kind", "container", "signature", "start_line", "end_line")


@query()
def py_relationships(spark, sf):
    return code_facts.code_facts(_sources(spark, sf))["relationships"].where("path like '%.py'").select("from", "from_symbol", "to", "type", "symbol", "confidence", "line")


@query()
def c_symbols(spark, sf):
    return code_facts.code_facts(_sources(spark, sf))["symbols"].where("path not like '%.py'").select("id", "kind", "container", "signature", "start_line")


@query()
def c_relationships(spark, sf):
    return code_facts.code_facts(_sources(spark, sf))["relationships"].where("path not like '%.py'").select("from", "from_symbol", "to", "type", "symbol", "confidence")


@query()
def code_interfaces(spark, sf):
    return code_facts.code_facts(_sources(spark, sf))["interfaces"].select("qualified_id", "signature", "input", "output", "confidence")


_FOUND = "array_to_string(list_sort(list_distinct({0})), ',')"
_EVERY = lambda pattern: f"regexp_extract_all(html, '{pattern}', 1)"
_OTHER = "['if', 'for', 'while', 'switch', 'return', 'sizeof', 'catch', 'else', 'do', 'new', 'delete', 'throw']"


@query(rf"""SELECT page_id, concat_ws(',', nullif({_FOUND.format(_EVERY(r'(?m)^\s*(?:import|from)\s+([\w.]+)'))}, ''), nullif({_FOUND.format(_EVERY(r'(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]'))}, '')) AS imports,
  {_FOUND.format(f"list_filter({_EVERY(r'\b([A-Za-z_]\w*)\s*\(')}, lambda x: NOT list_contains({_OTHER}, x))")} AS calls, {_FOUND.format(_EVERY(r'(?m)^\s*(?:async\s+)?def\s+(\w+)'))} AS functions, {_FOUND.format(_EVERY(r'(?m)^\s*(?:class|struct)\s+(\w+)'))} AS classes FROM pages""")
def light_scan(spark, sf):
    """The scan by patterns alone over the text of pages, their scripts among it."""
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    return code_facts.light_scan(pages).select(F.col("path").alias("page_id"), *[F.array_join(c, ",").alias(c) for c in ("imports", "calls", "functions", "classes")])
