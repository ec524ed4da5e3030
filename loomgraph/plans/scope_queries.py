"""Scoped name resolution over symbols, uses and includes made of parts, order lines and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scopes
from .projections import read
from .registry import query

_NAME = "CASE {k} % 3 WHEN 0 THEN 'f' || CAST({p} % 300 AS STRING) WHEN 1 THEN 'T' || CAST({p} % 20 AS STRING) || '.f' || CAST({p} % 300 AS STRING) ELSE 'ns' || CAST({p} % 5 AS STRING) || '.T' || CAST({p} % 20 AS STRING) || '.f' || CAST({p} % 300 AS STRING) END"
_SYMBOLS = f"SELECT 'm' || CAST(p_partkey % 50 AS STRING) AS module, p_partkey % 4 = 0 AS is_class, {_NAME.format(k='p_partkey', p='p_partkey')} AS name FROM part"
_CALLS = f"SELECT DISTINCT 'm' || CAST(l_orderkey % 50 AS STRING) AS module, CASE WHEN l_linenumber = 5 THEN 'w.f' || CAST(l_partkey % 300 AS STRING) ELSE {_NAME.format(k='l_linenumber', p='l_partkey')} END AS name FROM lineitem"
_BASES = f"SELECT DISTINCT 'm' || CAST(o_orderkey % 50 AS STRING) AS module, {_NAME.format(k='o_orderkey', p='o_custkey')} AS name, CASE WHEN o_orderkey % 5 > 1 THEN 'ns' || CAST(o_custkey % 5 AS STRING) || '.T' || CAST(o_custkey % 20 AS STRING) WHEN o_orderkey % 5 = 1 THEN 'T' || CAST(o_custkey % 20 AS STRING) END AS inside FROM orders"
_INCLUDES = "SELECT DISTINCT 'm' || CAST(s_suppkey % 50 AS STRING) AS module, 'm' || CAST((s_suppkey * 7 + s_nationkey) % 50 AS STRING) AS included FROM supplier"

# Every use against every symbol, rung by rung.
_LAST = "regexp_extract({0}, '[^.]*$')"
_BRUTE = f"""WITH k AS (SELECT module AS there, module || ':' || name AS id, name AS full_name, {_LAST.format('name')} AS short, is_class FROM ({_SYMBOLS})), i AS ({_INCLUDES}), u AS (USES), c AS (RUNGS),
b AS (SELECT module, name, inside, min(rung) AS rung FROM c GROUP BY ALL),
g AS (SELECT c.module, c.name, c.inside, count(DISTINCT id) AS n, min(id) AS one, count(DISTINCT id) FILTER (WHERE there = c.module) AS ln, min(id) FILTER (WHERE there = c.module) AS lone, count(DISTINCT id) FILTER (WHERE i.included IS NOT NULL) AS fn, min(id) FILTER (WHERE i.included IS NOT NULL) AS fone
  FROM c JOIN b ON b.module = c.module AND b.name = c.name AND b.inside IS NOT DISTINCT FROM c.inside AND b.rung = c.rung LEFT JOIN i ON i.module = c.module AND i.included = c.there GROUP BY ALL)
SELECT module, name, inside, CASE WHEN n = 1 THEN one WHEN ln = 1 THEN lone ELSE fone END AS target, CASE WHEN n = 1 THEN 'only' WHEN ln = 1 THEN 'local' ELSE 'included' END AS scope FROM g WHERE n = 1 OR ln = 1 OR fn = 1"""


def _sql(uses: str, rungs: list[str], only: str = "TRUE") -> str:
    each = [f"SELECT module, name, inside, {r} AS rung, there, id FROM u JOIN k ON {on} WHERE {only}" for r, on in enumerate(rungs)]
    return _BRUTE.replace("USES", uses).replace("RUNGS", " UNION ALL ".join(each))


def _run(spark, sf, sql, tables):
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: read(spark, sf, t) for t in tables})


def _symbols(spark, sf):
    return _run(spark, sf, _SYMBOLS, ["part"]).withColumn("id", F.concat_ws(":", "module", "name"))


@query(_sql(f"SELECT *, CAST(NULL AS VARCHAR) AS inside FROM ({_CALLS})", ["full_name = name", "short = name", "ends_with(full_name, '.' || name)", f"contains(name, '.') AND full_name = {_LAST.format('name')}", f"contains(name, '.') AND short = {_LAST.format('name')}"]).replace("1 AS rung", "0 AS rung").replace("4 AS rung", "3 AS rung"))
def scoped_calls(spark, sf):
    uses = _run(spark, sf, _CALLS, ["lineitem"]).withColumns({"inside": F.lit(None).cast("string"), "rungs": scopes.call_rungs(F.col("name"))})
    return scopes.resolve_scoped(uses, scopes.name_keys(_symbols(spark, sf)), _run(spark, sf, _INCLUDES, ["supplier"]))


@query(_sql(_BASES, ["NOT contains(name, '.') AND full_name = inside || '.' || name", "NOT contains(name, '.') AND short = inside || '.' || name", "full_name = name", "short = name", f"full_name = {_LAST.format('name')}", f"short = {_LAST.format('name')}"], "is_class").replace("1 AS rung", "0 AS rung").replace("3 AS rung", "2 AS rung").replace("5 AS rung", "4 AS rung"))
def scoped_bases(spark, sf):
    uses = _run(spark, sf, _BASES, ["orders"]).withColumn("rungs", scopes.base_rungs(F.col("name"), F.col("inside")))
    return scopes.resolve_scoped(uses, scopes.name_keys(_symbols(spark, sf).where("is_class")), _run(spark, sf, _INCLUDES, ["supplier"]))
