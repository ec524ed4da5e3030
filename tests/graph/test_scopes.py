"""Scoped resolution of names: local, included, suffixes, namespaces; C sources from text to relations."""

from pyspark.sql import functions as F

from loomgraph.operators import scopes
from loomgraph.sources import code_facts

SYMBOLS = [("a", "run"), ("b", "run"), ("c", "ns.Api.call"), ("d", "Api.call"), ("e", "ns.Api.only"), ("f", "twice"), ("f", "T.twice"), ("g", "twice"), ("h", "deep.ns.Box"), ("i", "Box")]
INCLUDES = [("x", "b"), ("x", "d"), ("y", "a"), ("y", "b"), ("z", "g"), ("x", "x")]


def resolved(spark, uses, symbols=SYMBOLS, bases=False):
    s = spark.createDataFrame([(m, f"{m}:{n}", n) for m, n in symbols], "module string, id string, name string")
    u = spark.createDataFrame(uses, "module string, name string, inside string")
    u = u.withColumn("rungs", scopes.base_rungs(F.col("name"), F.col("inside")) if bases else scopes.call_rungs(F.col("name")))
    got = scopes.resolve_scoped(u, scopes.name_keys(s), spark.createDataFrame(INCLUDES, "module string, included string"))
    return {(r.module, r.name, r.inside): (r.target, r.scope) for r in got.collect()}


def test_calls(spark):
    uses = [("a", "run"), ("x", "run"), ("y", "run"), ("q", "run"), ("q", "Api.only"), ("q", "box.only"), ("x", "Api.call"), ("q", "Api.call"), ("f", "twice"), ("z", "twice"), ("q", "nothing"), ("q", "obj.run"), ("x", "obj.run"), ("q", "call"), ("c", "call")]
    got = resolved(spark, [(*u, None) for u in uses])
    assert got == {
        ("a", "run", None): ("a:run", "local"),
        ("x", "run", None): ("b:run", "included"),
        ("q", "Api.only", None): ("e:ns.Api.only", "only"),
        ("q", "box.only", None): ("e:ns.Api.only", "only"),
        # a whole name comes before a suffix
        ("x", "Api.call", None): ("d:Api.call", "only"),
        ("q", "Api.call", None): ("d:Api.call", "only"),
        ("z", "twice", None): ("g:twice", "included"),
        ("x", "obj.run", None): ("b:run", "included"),
        ("c", "call", None): ("c:ns.Api.call", "local"),
    }


def test_bases(spark):
    got = resolved(spark, [("q", "Box", "deep.ns"), ("q", "Box", None), ("i", "Box", None), ("q", "Box", "other"), ("q", "no.Box", None), ("i", "no.Box", None)], bases=True)
    assert got == {("q", "Box", "deep.ns"): ("h:deep.ns.Box", "only"), ("i", "Box", None): ("i:Box", "local"), ("i", "no.Box", None): ("i:Box", "local")}


def test_nothing(spark):
    assert resolved(spark, []) == {} and resolved(spark, [("q", "run", None)], []) == {}


def test_a_name_that_many_files_define(spark):
    """No pair of a use and a candidate is made."""
    many = [(f"m{i}", "get") for i in range(3000)]
    uses = [(f"m{i}", "get", None) for i in range(3000)] + [("x", "get", None)]
    got = resolved(spark, uses, many)
    assert len(got) == 3000 and all(v == (f"{m}:get", "local") for (m, _, _), v in got.items())


def test_c_sources(spark):
    files = {
        "include/api.hpp": "class Api {\npublic:\n  int value() const;\n};\nint api_call(int v);\n",
        "include/other.hpp": "int api_call(int v);\nclass Api { };\n",
        "src/api.cpp": '#include "../include/api.hpp"\nint api_call(int v) { return helper(v); }\nstatic int helper(int v) { return v; }\n',
        "src/other.cpp": "static int helper(int v) { return v; }\nint go() { return helper(1); }\n",
        "src/lost.cpp": "int lost() { return helper(1); }\n",
        "main.cpp": '#include "include/api.hpp"\nclass Mine : public Api { };\nint main() { return api_call(1); }\n',
        "far.cpp": "int far_away() { return api_call(1); }\n",
    }
    facts = code_facts.code_facts(spark.createDataFrame(list(files.items()), "path string, content string"))
    rel = {(r["from"], r.from_symbol, r["to"], r.type, r.symbol) for r in facts["relationships"].collect()}
    ids = {r.path: r.id for r in facts["modules"].collect()}
    # the header that main includes, not the other header or the source that define the name too
    assert (ids["main.cpp"], "main", ids["include/api.hpp"], "CALL", "api_call") in rel
    assert (ids["main.cpp"], "Mine", ids["include/api.hpp"], "INHERIT", "Api") in rel
    assert (ids["src/api.cpp"], "api_call", ids["src/api.cpp"], "CALL", "helper") in rel and (ids["src/other.cpp"], "go", ids["src/other.cpp"], "CALL", "helper") in rel
    assert not any(r[3] == "CALL" and r[0] in (ids["far.cpp"], ids["src/lost.cpp"]) for r in rel)
