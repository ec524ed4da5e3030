"""Implementation index: symbols to nodes and edges, file state, snapshots, imports (survey rows I1-I12, P10, S8, R10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled


def normalize_symbols(symbols: DataFrame) -> DataFrame:
    """Ids, short names, lines and containers of symbols (``module, ord, name`` and what else there is)."""
    c = {n: F.col(n) if n in symbols.columns else F.lit(None).cast(t) for n, t in (("qualified_id", "string"), ("id", "string"), ("short_name", "string"), ("kind", "string"), ("container", "string"), ("start_line", "int"), ("end_line", "int"), ("line", "int"), ("signature", "string"))}
    name = filled(F.col("name"), c["short_name"], c["id"], F.lit("symbol"))
    own = F.when(F.contains(c["id"], F.lit(":")), c["id"])
    start = F.coalesce(c["start_line"], c["line"], F.lit(1))
    given, module = c["container"], F.col("module")
    below = F.startswith(given, F.concat(module, F.lit(".")))
    parent = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    box = (
        F.when((given == module) | F.contains(given, F.lit(":")), given)
        .when(below, F.concat(module, F.lit(":"), F.expr("substring(container, length(module) + 2)") if "container" in symbols.columns else F.lit("")))
        .when(given != "", F.concat(module, F.lit(":"), given))
        .when(parent != "", F.concat(module, F.lit(":"), parent))
        .otherwise(module)
    )
    return symbols.withColumns(
        {
            "id": filled(c["qualified_id"], own, F.concat(module, F.lit(":"), name)),
            "name": name,
            "short_name": filled(c["short_name"], F.element_at(F.split(name, r"\."), -1)),
            "kind": filled(c["kind"], F.lit("symbol")),
            "container": box,
            "signature": F.coalesce(c["signature"], F.lit("")),
            "line": F.coalesce(c["line"], start),
            "start_line": start,
            "end_line": F.greatest(start, F.coalesce(c["end_line"], start)),
        }
    )


def symbol_node_type(kind: Column) -> Column:
    """A symbol's node type."""
    return F.when(kind == "class", "implementation_class").when(kind.isin("function", "method"), "implementation_function").otherwise("implementation_symbol")


def alias_table(symbols: DataFrame) -> DataFrame:
    """I4: ``alias, id``: a symbol's id, name, short name and ``module.name``."""
    names = F.array("id", "name", "short_name", F.concat_ws(".", "module", "name"))
    return symbols.select("id", F.explode(F.array_distinct(names)).alias("alias")).where("alias <> ''").distinct()


def unique_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases of exactly one symbol; others resolve to nothing."""
    return aliases.groupBy("alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("alias", "id")


def resolve_ladder(rows: DataFrame, unique: DataFrame, rungs: list[Column], key: list[str]) -> DataFrame:
    """The first of several names that is unique. All rungs are one exploded join, the first hit an aggregate."""
    tries = rows.select(*key, F.posexplode(F.array(*rungs)).alias("rung", "alias")).where("alias <> ''")
    hit = tries.join(unique, "alias").groupBy(*key).agg(F.min_by("id", "rung").alias("resolved"))
    return rows.join(hit, key, "left")


def resolve_calls(calls: DataFrame, unique: DataFrame) -> DataFrame:
    """``resolved`` for calls ``call, module, container, raw, target_module``: as written, with ``self`` as the class, in the
    target module, in the own module."""
    inner = F.when(F.contains("container", F.lit(":")), F.element_at(F.split("container", ":"), 2))
    cls = F.element_at(F.split(inner, r"\."), -1)
    bare = F.when(F.startswith("raw", F.lit("self.")) & (cls != ""), F.concat(cls, F.lit("."), F.expr("substring(raw, 6)"))).otherwise(F.col("raw"))
    there = lambda sep: F.when(F.col("target_module") != "", F.concat("target_module", F.lit(sep), "raw"))
    here = lambda sep: F.concat("module", F.lit(sep), bare)
    return resolve_ladder(calls, unique, [F.col("raw"), bare, there(":"), there("."), here(":"), here(".")], ["call"])


def index_edges(branches: list[DataFrame]) -> DataFrame:
    """Edges ``ord, source, target, type, confidence`` of several branches in order: no self-edges, the first of each triple."""
    out = None
    for k, b in enumerate(branches):
        b = b.where("source <> target").select("source", "target", "type", "confidence", F.struct(F.lit(k).alias("k"), F.col("ord").cast("bigint").alias("ord")).alias("at"))
        out = b if out is None else out.unionByName(b)
    return out.groupBy("source", "target", "type").agg(F.min_by("confidence", "at").alias("confidence"))


def materialize_index(modules: DataFrame, symbols: DataFrame, symbol_calls: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of files and symbols, and ``contains`` and ``calls`` edges.

    modules: ``ord, id, path``; symbols: ``ord, module, name, ...``; symbol_calls: ``ord, symbol, raw, confidence``;
    relationships: call facts with ``ord, from, from_symbol, from_symbol_id, to, to_symbol_id, symbol, type, confidence``.
    """
    full = normalize_symbols(symbols)
    unique = unique_aliases(alias_table(full))
    files = modules.select("ord", "id", F.lit("implementation_file").alias("type"), F.col("id").alias("title"), "path")
    parts = full.join(modules.select(F.col("id").alias("module"), "path"), "module", "left").select("ord", "id", symbol_node_type(F.col("kind")).alias("type"), F.col("name").alias("title"), "path")
    nodes = files.unionByName(parts).groupBy("id").agg(F.min_by(F.struct("type", "title", "path"), F.struct(F.col("type") != "implementation_file", "ord")).alias("n")).select("id", "n.*")
    known = nodes.select("id")
    contains = full.select("ord", F.col("container").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("confidence")).join(known.withColumnRenamed("id", "source"), "source", "left_semi")
    place = full.select(F.col("id").alias("symbol"), "module", "container")
    calls = symbol_calls.join(place, "symbol").withColumns({"call": F.concat_ws("\x00", "symbol", "ord", "raw"), "target_module": F.lit("")})
    calls = resolve_calls(calls, unique).where("resolved is not null").select("ord", F.col("symbol").alias("source"), F.col("resolved").alias("target"), F.lit("calls").alias("type"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"))
    facts = relationships.where("upper(type) = 'CALL'").withColumn("call", F.concat_ws("\x00", "ord", "from", "symbol"))
    ends = resolve_ladder(facts, unique, [F.concat("from", F.lit(":"), F.coalesce("from_symbol", F.lit(""))), F.concat("from", F.lit("."), F.coalesce("from_symbol", F.lit(""))), F.coalesce("from_symbol", F.lit(""))], ["call"])
    ends = ends.withColumn("source", F.coalesce(F.nullif("from_symbol_id", F.lit("")), "resolved", "from")).drop("resolved")
    ends = ends.join(place.withColumnRenamed("symbol", "source"), "source", "left").withColumns({"raw": F.col("symbol"), "target_module": F.col("to"), "module": F.coalesce("module", "from"), "container": F.coalesce("container", "from")})
    ends = resolve_calls(ends, unique).withColumn("target", F.coalesce(F.nullif("to_symbol_id", F.lit("")), "resolved", "to"))
    ends = ends.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    related = ends.select("ord", "source", "target", F.lit("calls").alias("type"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"))
    return nodes, index_edges([contains, calls, related])


def file_state(facts: DataFrame) -> DataFrame:
    """Per file its content hash, number of parts, and its distinct ids, sorted and joined. facts: ``file, part, content, id``."""
    grouped = facts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("p"), F.sort_array(F.collect_set("id")).alias("ids"), F.count("*").alias("n_parts"))
    return grouped.select("file", F.sha2(F.array_join(F.transform("p", lambda x: x["content"]), "\n"), 256).alias("hash"), "n_parts", F.array_join("ids", ",").alias("ids"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``file, change``: changed (new or another hash), deleted or unchanged."""
    a, b = before.select("file", F.col("hash").alias("old")), after.select("file", F.col("hash").alias("new"))
    change = F.when(F.col("new").isNull(), "deleted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, "file", "full_outer").select("file", change.alias("change"))


def merge_incremental(previous: DataFrame, current: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of the files analysed anew (``file``) replaced, all others kept."""
    return previous.join(files.select("file").distinct(), "file", "left_anti").unionByName(current)


def merge_facts(code: DataFrame, deep: DataFrame) -> DataFrame:
    """Modules of both analyses; where both have one, the deeper one's symbols win. Rows ``id, path, symbols``."""
    b = deep.select(F.col("id").alias("id_"), F.col("path").alias("path_"), F.col("symbols").alias("symbols_"))
    both = code.join(b, F.col("id") == F.col("id_"), "full_outer")
    return both.select(F.coalesce("id", "id_").alias("id"), F.coalesce("path", "path_").alias("path"), F.coalesce("symbols_", "symbols").alias("symbols"))


def resolve_imports(imports: DataFrame, module_ids: DataFrame) -> DataFrame:
    """P10: ``module, raw, target``: the longest module id that is the import or a leading part of it; else, from the longest
    leading part on, the one module that ends in it. Several such modules end the search with nothing."""
    raw = F.replace(F.regexp_replace("raw", r"^\.+", ""), F.lit("/"), F.lit("."))
    bare = F.regexp_replace(raw, r"(?i)\.(?:h|hh|hpp|hxx|c|cc|cpp|cxx)$", "")
    parts = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda n: F.array_join(F.slice(F.split(c, r"\."), F.lit(1), n), "."))
    ids = module_ids.select("id").distinct()
    rows = imports.select("module", F.col("raw").alias("raw_"), raw.alias("a"), bare.alias("b"))
    lead = rows.select("module", "raw_", F.explode(F.concat(F.transform(parts(F.col("a")), lambda x: F.struct(F.lit(1).alias("s"), x.alias("p"))), F.transform(parts(F.col("b")), lambda x: F.struct(F.lit(0).alias("s"), x.alias("p"))))).alias("q"))
    direct = lead.join(ids, F.col("q.p") == F.col("id")).groupBy("module", "raw_").agg(F.max_by("id", F.struct("q.s", F.length("id"))).alias("direct"))
    tails = ids.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split("id", r"\.")), F.lit(2))), lambda n: F.array_join(F.slice(F.split("id", r"\."), n, F.lit(1000)), "."))).alias("tail")).where("tail <> ''")
    tails = tails.groupBy("tail").agg(F.count_distinct("id").alias("n"), F.min("id").alias("tail_id"))
    alias = rows.select("module", "raw_", F.explode(parts(F.col("b"))).alias("tail")).join(tails, "tail").groupBy("module", "raw_").agg(F.max_by(F.struct("n", "tail_id"), F.length("tail")).alias("t"))
    out = rows.join(direct, ["module", "raw_"], "left").join(alias, ["module", "raw_"], "left")
    return out.select("module", F.col("raw_").alias("raw"), F.coalesce("direct", F.when(F.col("t.n") == 1, F.col("t.tail_id"))).alias("target"))


def scan_mode(diff: DataFrame, before: DataFrame, same_analyzer: bool) -> str:
    """Cache, incremental or full, from three counts: any file added or deleted asks for a full scan."""
    row = diff.join(before.select("file").withColumn("old", F.lit(True)), "file", "left").agg(
        F.coalesce(F.sum((F.col("change") == "deleted").cast("int")), F.lit(0)).alias("deleted"),
        F.coalesce(F.sum(((F.col("change") == "changed") & F.col("old").isNull()).cast("int")), F.lit(0)).alias("added"),
        F.coalesce(F.sum((F.col("change") == "changed").cast("int")), F.lit(0)).alias("changed"),
    ).first()
    if not same_analyzer or row.deleted or row.added:
        return "full"
    return "incremental" if row.changed else "cache"
