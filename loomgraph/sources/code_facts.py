"""Code facts from source files (survey rows S4-S8, S10, P1-P21, C1-C15).

Files are read with the ``binaryFile`` source. Each file is parsed on its own in a Python worker (the one thing built-in operators
cannot do) and gives plain rows; what needs other files (module ids, imports, base classes, call targets) is resolved by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import settle
from ..operators.index import normalize_symbols, resolve_imports
from ..operators.scopes import base_rungs, call_rungs, name_keys, resolve_scoped

# Extensions of source files, and folders that are not looked into.
PYTHON, C_SOURCES, C_HEADERS = [".py"], [".c", ".cc", ".cpp", ".cxx"], [".h", ".hh", ".hpp", ".hxx"]
IGNORED = [".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".context"]
RAW = "path string, module string, kind string, ord int, name string, subkind string, container string, signature string, start_line int, end_line int, raw string, target_symbol string, from_symbol string, confidence double, evidence string"


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below the root), ``content``, ``hash``, ``size``, ``modified`` of all source files.

    Spark's file sources pass over names that begin with an underscore; those (``__init__.py`` and the like) are listed and read
    through the same file system on the driver.
    """
    endings = [*PYTHON, *C_SOURCES, *C_HEADERS]
    globs = ",".join(e[1:] for e in endings)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + globs + "}").load(root)
    rows = files.select("path", "content", F.col("modificationTime").alias("modified"))
    jvm, top = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    hidden, listed = [], fs.listFiles(top, True)
    while listed.hasNext():
        status = listed.next()
        name = status.getPath().getName()
        if name.startswith("_") and name.endswith(tuple(endings)):
            stream = status.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).open(status.getPath())
            try:
                hidden.append((status.getPath().toString(), bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)), status.getModificationTime()))
            finally:
                stream.close()
    if hidden:
        more = spark.createDataFrame(hidden, "path string, content binary, at bigint")
        rows = rows.unionByName(more.select("path", "content", F.timestamp_millis("at").alias("modified")))
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.element_at(F.split("path", F.lit(base + "/"), 2), 2), r"^/+", "")
    rows = rows.select(path.alias("path"), "content", F.sha2("content", 256).alias("hash"), F.length("content").alias("size"), "modified")
    return rows.where(~F.exists(F.split("path", "/"), lambda p: p.isin(IGNORED)))


def python_module(path: Column) -> Column:
    """Dotted module id of a path; a package's is its folder's."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", "")
    return F.coalesce(F.nullif(F.replace(bare, F.lit("/"), F.lit(".")), F.lit("")), F.lit("root"))


def package_of(path: Column) -> Column:
    """Dotted id of a path's folder."""
    return F.replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("/"), F.lit("."))


def c_modules(files: DataFrame) -> DataFrame:
    """``path, module``: headers keep their extension; so do sources that share a name; later equals get a number."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    stem = F.replace(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit("/"), F.lit("."))
    rows = files.select("path", stem.alias("stem"), ext.alias("ext")).where(F.col("ext").isin(*C_SOURCES, *C_HEADERS, *PYTHON))
    owners = rows.where(~F.col("ext").isin(C_HEADERS)).groupBy("stem").agg(F.count("*").alias("n"))
    rows = rows.join(owners, "stem", "left").where(~F.col("ext").isin(PYTHON))
    wanted = rows.select("path", F.when(F.col("ext").isin(C_HEADERS) | (F.col("n") > 1), F.concat("stem", "ext")).otherwise(F.col("stem")).alias("module"))
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("module").orderBy("path"))
    return wanted.withColumn("k", k).select("path", F.when(F.col("k") > 1, F.concat_ws(".", "module", "k")).otherwise(F.col("module")).alias("module"))


def parse_python(path: str, module: str, source: str) -> Iterator[dict]:
    """Raw rows of one file; a file that does not parse gives one error row."""
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        yield {"kind": "error", "evidence": str(e)}
        return
    package = module if path.endswith("__init__.py") else module.rpartition(".")[0]
    lines = source.splitlines()
    aliases: dict[str, tuple[str, str]] = {}  # local name -> (import, symbol in it)
    classes = {n.name for n in ast.walk(tree) if isinstance(n, ast.ClassDef)}
    own = {n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
    rows: list[dict] = []

    def dotted(node) -> str:
        if isinstance(node, ast.Name):
            return node.id
        head = dotted(node.value) if isinstance(node, ast.Attribute) else ""
        return f"{head}.{node.attr}" if head else ""

    def put(kind, node, **more):
        rows.append({"kind": kind, "start_line": node.lineno, "end_line": node.end_lineno, "evidence": "\n".join(lines[node.lineno - 1 : node.end_lineno])[:400], **more})

    def climb(level: int) -> str:
        parts = package.split(".") if package else []
        return ".".join(parts[: len(parts) - level + 1])

    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                put("import", node, raw=a.name, confidence=1.0)
                aliases[a.asname or a.name.split(".")[0]] = (a.name if a.asname else a.name.split(".")[0], "")
        elif isinstance(node, ast.ImportFrom):
            base = ".".join(x for x in (climb(node.level) if node.level else "", node.module or "") if x)
            for a in node.names:
                full = base if a.name == "*" else f"{base}.{a.name}".strip(".")
                put("import", node, raw=full, target_symbol="*" if a.name == "*" else a.name, confidence=1.0)
                aliases[a.asname or a.name] = (base, a.name)

    def said(fn) -> str:
        lead = "async def" if isinstance(fn, ast.AsyncFunctionDef) else "def"
        return f"{lead} {fn.name}({ast.unparse(fn.args)})" + (f" -> {ast.unparse(fn.returns)}" if fn.returns else "")

    def visit(node, scope: list, kinds: list, inside: dict):
        """scope: names around; kinds: class or function for each; inside: local name -> class it was made of."""
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(child, ast.ClassDef)
                name = ".".join([*scope, child.name])
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                if cls:
                    bases = [ast.unparse(b) for b in child.bases] + [f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in child.keywords]
                    signature = f"class {child.name}" + (f"({', '.join(bases)})" if bases else "")
                else:
                    signature = said(child)
                sub = "class" if cls else "method" if kinds and kinds[-1] == "class" else "function"
                rows.append({"kind": "symbol", "name": name, "subkind": sub, "container": f"{module}:{'.'.join(scope)}" if scope else module, "signature": signature, "start_line": first, "end_line": child.end_lineno})
                if not cls:
                    args = [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs]
                    said_args = ", ".join(f"{a.arg}: {ast.unparse(a.annotation) if a.annotation else 'unknown'}" for a in args)
                    put("interface", child, name=name, signature=signature, raw=said_args, target_symbol=ast.unparse(child.returns) if child.returns else "unknown", confidence=1.0)
                for base in child.bases if cls else []:
                    refer("inherit", base, name, scope, kinds, inside)
                visit(child, [*scope, child.name], [*kinds, "class" if cls else "function"], dict(inside))
                continue
            if isinstance(child, ast.Assign) and isinstance(child.value, ast.Call):
                made = dotted(child.value.func)
                for t in child.targets:
                    if isinstance(t, ast.Name) and made and (made in classes or made.split(".")[0] in aliases):
                        inside[t.id] = made
            if isinstance(child, ast.Call):
                refer("call", child.func, ".".join(scope), scope, kinds, inside, child)
            elif isinstance(child, ast.Name) and isinstance(child.ctx, ast.Load) and child.id in aliases:
                refer("reference", child, ".".join(scope), scope, kinds, inside)
            visit(child, scope, kinds, inside)

    def refer(kind, node, who, scope, kinds, inside, whole=None):
        name = dotted(node)
        if not name:
            return
        at = whole or node
        if kind == "call" and (name in ("getattr", "__import__") or "load_" in name):
            put("optional", at, raw="?", target_symbol=name, from_symbol=who, confidence=0.42)
            return
        head, _, tail = name.partition(".")
        if head == "self" and tail and "class" in kinds:
            owner = ".".join(scope[: len(kinds) - kinds[::-1].index("class")])
            put(kind, at, raw=module, target_symbol=f"{owner}.{tail}", from_symbol=who, confidence=0.9)
        elif head in inside:
            made_head, _, made_tail = inside[head].partition(".")
            base, sym = aliases.get(made_head, (module, made_head))
            full = ".".join(x for x in (sym, made_tail, tail) if x)
            put(kind, at, raw=base, target_symbol=full, from_symbol=who, confidence=0.9)
        elif head in aliases:
            base, sym = aliases[head]
            put(kind, at, raw=base, target_symbol=".".join(x for x in (sym, tail) if x), from_symbol=who, confidence=1.0)
        elif head in own or head in classes:
            put(kind, at, raw=module, target_symbol=name, from_symbol=who, confidence=0.9)

    visit(tree, [], [], {})
    yield from rows


# What the lexical C parser looks for.
C_WORDS = {"if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do", "new", "delete", "throw"}


def mask_c(source: str) -> str:
    """Comments, literals and directives other than includes blanked, line breaks and places kept."""
    import re

    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    pattern = r"//[^\n]*|/\*.*?\*/|^[ \t]*#(?!\s*include)(?:[^\n\\]|\\.|\\\n)*|(?<!include )(?<!include)\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
    keep = lambda m: m[0] if m[0].startswith('"') and re.search(r"#\s*include\s*$", source[: m.start()].rsplit("\n", 1)[-1]) else blank(m)
    return re.sub(pattern, keep, source, flags=re.S | re.M)


def split_params(text: str) -> list[tuple[str, str]]:
    """``(name, type)`` of a parameter list, split at commas outside brackets, defaults left out."""
    import re

    parts, depth, start = [], 0, 0
    for k, c in enumerate(text + ","):
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            parts.append(text[start:k])
            start = k + 1
    out = []
    for p in parts:
        p = p.split("=")[0].strip()
        m = re.match(r"(.*?)([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?$", p, re.S)
        if p and p not in ("void", "..."):
            out.append((m[2], m[1].strip() or "unknown") if m else (p, "unknown"))
    return out


def parse_c(path: str, module: str, source: str) -> Iterator[dict]:
    """Raw rows of a C or C++ file by its words and braces, without a compiler."""
    import bisect
    import re

    text = mask_c(source)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    pairs, stack = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", text, re.M):
        yield {"kind": "include", "raw": m[1], "start_line": line(m.start()), "end_line": line(m.start()), "evidence": m[0].strip(), "confidence": 1.0}
    scopes = []
    for m in re.finditer(r"\b(namespace|class|struct)\s+([A-Za-z_][\w:]*)\s*(?:final\s*)?(?::([^{;]*))?\{", text):
        at = m.end() - 1
        scopes.append((at, pairs.get(at, len(text)), m[1], m[2].replace("::", "."), m[3] or "", m.start()))

    def around(at: int) -> list:
        return [s for s in scopes if s[0] < at < s[1]]

    bodies: dict[str, tuple] = {}
    for s in scopes:
        if s[2] == "namespace":
            continue
        outer = ".".join(x[3] for x in around(s[5]))
        name = ".".join(x for x in (outer, s[3]) if x)
        yield {"kind": "symbol", "name": name, "subkind": "class", "container": f"{module}:{outer}" if outer else module, "signature": re.sub(r"\s+", " ", text[s[5] : s[0]]).strip(), "start_line": line(s[5]), "end_line": line(s[1]), "confidence": 0.9}
        for base in s[4].split(","):
            base = re.sub(r"\b(public|private|protected|virtual)\b", " ", base).strip().replace("::", ".")
            if base:
                yield {"kind": "inherit", "raw": "", "target_symbol": re.sub(r"<.*", "", base).strip(), "from_symbol": name, "confidence": 0.8, "start_line": line(s[5]), "end_line": line(s[5])}
    pattern = r"(?:^|(?<=[;{}\n]))[ \t]*((?:[A-Za-z_][\w:<>,*&~ \t]*[\s*&])?)([A-Za-z_~][\w:~]*)\s*\(([^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*(?:const\b|noexcept\b|override\b|\s)*([;{])"
    for m in re.finditer(pattern, text, re.M):
        raw, kind = m[2].replace("::", "."), m[1].strip()
        if raw in C_WORDS or not kind or kind.split()[0] in C_WORDS:
            continue
        held = around(m.start(2))
        if m[4] == ";" and any(s for s in bodies.values() if s[1] < m.start() < s[2]):
            continue
        outer = ".".join(x[3] for x in held)
        name = ".".join(x for x in (outer, raw) if x)
        end = pairs.get(m.end() - 1, m.end()) if m[4] == "{" else m.end()
        if m[4] == "{" or name not in bodies:
            bodies[name] = (m, m.end() if m[4] == "{" else end, end, held, outer)
    for name, (m, lo, hi, held, outer) in bodies.items():
        cls = bool(held and held[-1][2] != "namespace") or "." in m[2].replace("::", ".")
        signature = re.sub(r"\s+", " ", f"{m[1].strip()} {m[2]}({m[3]})").strip()
        yield {"kind": "symbol", "name": name, "subkind": "method" if cls else "function", "container": f"{module}:{outer}" if outer else module, "signature": signature, "start_line": line(m.start(2)), "end_line": line(hi), "confidence": 0.85}
        yield {"kind": "interface", "name": name, "signature": signature, "raw": ", ".join(f"{n}: {t}" for n, t in split_params(m[3])), "target_symbol": m[1].strip(), "confidence": 0.85, "start_line": line(m.start(2)), "end_line": line(hi)}
        body = text[lo:hi]
        kinds = {v: t.replace("::", ".") for t, v in re.findall(r"\b([A-Z][\w:]*)\s*[*&]?\s+([a-z_]\w*)\s*[;({=]", body)}
        for c in re.finditer(r"([A-Za-z_]\w*(?:(?:::|\.|->)[A-Za-z_]\w*)*)\s*\(", body):
            called = c[1].replace("::", ".").replace("->", ".")
            head, _, tail = called.partition(".")
            if called not in C_WORDS and called != m[2].replace("::", "."):
                full = f"{kinds[head]}.{tail}" if tail and head in kinds else called
                yield {"kind": "call", "raw": "", "target_symbol": full, "from_symbol": name, "confidence": 0.8 if "." in full else 0.7, "start_line": line(lo + c.start()), "end_line": line(lo + c.start()), "evidence": c[0]}


def parse_files(files: DataFrame) -> DataFrame:
    """Raw rows of all files (``path, module, content``); one file at a time, whatever its neighbours do."""

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        shape = [f.split() for f in RAW.split(", ")]
        for b in batches:
            rows = []
            for path, module, content in zip(*(c.to_pylist() for c in b.columns)):
                source = content if isinstance(content, str) else (content or b"").decode("utf-8", "replace")
                parse = parse_python if path.endswith(".py") else parse_c
                try:
                    found = list(parse(path, module, source or ""))
                except RecursionError as e:
                    found = [{"kind": "error", "evidence": str(e)}]
                rows += [{"path": path, "module": module, "ord": k, **x} for k, x in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in shape], names=[n for n, _ in shape])

    return files.select("path", "module", "content").mapInArrow(run, RAW)


def with_modules(files: DataFrame) -> DataFrame:
    """Files with their module ids."""
    py = files.where(F.endswith("path", F.lit(".py"))).withColumn("module", python_module(F.col("path")))
    c = files.where(~F.endswith("path", F.lit(".py"))).join(c_modules(files), "path")
    return py.unionByName(c)


def resolve_includes(includes: DataFrame, modules: DataFrame) -> DataFrame:
    """``path, raw, target``: an include relative to its file, to the root, or the only path that ends in it."""
    here = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    # a part that goes up takes the last part kept with it; one that nothing is left for stays
    up = lambda kept: (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
    fold = lambda kept, p: F.when((p == "..") & up(kept), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(p)))
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))
    tidy = lambda c: F.array_join(F.aggregate(parts(c), F.array().cast("array<string>"), lambda kept, p: F.coalesce(fold(kept, p), kept)), "/")
    m = modules.select(F.col("path").alias("p"), F.col("module").alias("target"))
    tails = m.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("p", "/"))), lambda n: F.array_join(F.slice(F.split("p", "/"), n, F.lit(1000)), "/"))).alias("tail"))
    tails = tails.groupBy("tail").agg(F.count_distinct("target").alias("n"), F.min("target").alias("t3")).where("n = 1")
    rows = includes.withColumns({"a": tidy(F.concat(here, F.col("raw"))), "b": tidy(F.col("raw"))})
    rows = rows.join(m.withColumnsRenamed({"p": "a", "target": "t1"}), "a", "left").join(m.withColumnsRenamed({"p": "b", "target": "t2"}), "b", "left").join(tails.select(F.col("tail").alias("b"), "t3"), "b", "left")
    return rows.withColumn("target", F.coalesce("t1", "t2", "t3")).drop("a", "b", "t1", "t2", "t3")


def code_facts(files: DataFrame, wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """``symbols``, ``relationships``, ``interfaces``, ``modules`` and ``errors`` of files (``path, content``).

    wanted: paths to report on (P21); all files take part in resolution. A C name that several
    symbols share is that of its own file, else that of an included one, else it resolves to nothing.
    """
    modules = with_modules(files)
    raw = parse_files(modules)
    raw = settle(raw.unionByName(_degraded(modules, raw), allowMissingColumns=True))
    ids = modules.select(F.col("module").alias("id")).distinct()
    symbols = normalize_symbols(raw.where("kind = 'symbol'").withColumn("kind", F.col("subkind")).withColumn("line", F.col("start_line")).select("path", "module", "ord", "name", "kind", "subkind", "container", "signature", "start_line", "end_line", "line"))
    py, c = F.endswith("path", F.lit(".py")), ~F.endswith("path", F.lit(".py"))
    imports = raw.where(py & (F.col("kind") == "import"))
    known = resolve_imports(raw.where(py & F.col("raw").isNotNull() & (F.col("raw") != "?") & F.col("kind").isin("import", "call", "inherit", "reference")).select("module", "raw").distinct(), ids)
    upper = F.when(F.col("kind") == "include", "IMPORT").when(F.col("kind") == "optional", "OPTIONAL_DEPENDENCY").otherwise(F.upper("kind"))
    shape = lambda df, to: df.select("path", "ord", F.col("module").alias("from"), "from_symbol", to.alias("to"), upper.alias("type"), F.col("target_symbol").alias("symbol"), "confidence", F.col("path").alias("file"), F.col("start_line").alias("line"))
    linked = raw.where(py & F.col("kind").isin("call", "inherit", "reference")).join(known, ["module", "raw"])
    rel = shape(imports.join(known, ["module", "raw"]).where("target is not null and target <> module"), F.col("target"))
    rel = rel.unionByName(shape(linked.where("target is not null"), F.col("target")))
    rel = rel.unionByName(shape(raw.where("kind = 'optional'"), F.lit("?")))
    includes = resolve_includes(raw.where("kind = 'include'"), modules.select("path", "module"))
    rel = rel.unionByName(shape(includes.where("target is not null and target <> module"), F.col("target")))
    uses = raw.where(c & F.col("kind").isin("call", "inherit")).withColumn("use", F.concat_ws(":", "path", "ord"))
    near = includes.where("target is not null").select("module", F.col("target").alias("included"))
    named = symbols.where(c).select("module", "id", "name", "kind").distinct()
    inside = F.when(F.contains("from_symbol", F.lit(".")), F.regexp_extract("from_symbol", r"^(.*)\.[^.]*$", 1))
    asked = uses.where("kind = 'call'").select("module", F.col("target_symbol").alias("name"), F.lit(None).cast("string").alias("inside"), call_rungs(F.col("target_symbol")).alias("rungs"))
    bases = uses.where("kind = 'inherit'").withColumn("inside", inside).select("module", F.col("target_symbol").alias("name"), "inside", base_rungs(F.col("target_symbol"), F.col("inside")).alias("rungs"))
    meant = resolve_scoped(asked, name_keys(named), near).withColumn("kind", F.lit("call")).unionByName(resolve_scoped(bases, name_keys(named.where("kind = 'class'")), near).withColumn("kind", F.lit("inherit")))
    meant = meant.select("kind", "module", F.col("name").alias("target_symbol"), F.coalesce("inside", F.lit("")).alias("inside"), F.element_at(F.split("target", ":"), 1).alias("target"))
    scope = F.when(F.col("kind") == "inherit", F.coalesce(inside, F.lit(""))).otherwise("")
    rel = rel.unionByName(shape(uses.withColumn("inside", scope).join(meant, ["kind", "module", "target_symbol", "inside"]), F.col("target")))
    first = F.min(F.struct("ord", "confidence", "file"))
    rel = rel.groupBy("from", "from_symbol", "to", "type", "symbol", "line", "path").agg(first.alias("f")).select("path", "from", "from_symbol", "to", "type", "symbol", "line", F.col("f.ord").alias("ord"), F.col("f.confidence").alias("confidence"), F.col("f.file").alias("file"))
    out = {
        "symbols": symbols,
        "relationships": rel,
        "interfaces": raw.where("kind = 'interface'").select("path", "module", F.col("name").alias("symbol"), F.concat_ws(":", "module", "name").alias("qualified_id"), "signature", F.col("raw").alias("input"), F.col("target_symbol").alias("output"), "confidence", "start_line", "end_line"),
        "errors": raw.where("kind = 'error'").select("path", F.col("path").alias("file"), F.col("evidence").alias("error")),
        "modules": modules.select("path", F.col("module").alias("id"), F.when(F.endswith("path", F.lit(".py")), "python").when(F.lower("path").rlike(r"\.c$"), "c").otherwise("cpp").alias("language")),
    }
    return {k: df.join(wanted.select("path").distinct(), "path", "left_semi") for k, df in out.items()} if wanted is not None else out


def _degraded(modules: DataFrame, raw: DataFrame) -> DataFrame:
    """Symbols and imports by patterns alone for files that could not be parsed; they stand beside the files' errors."""
    failed = modules.join(raw.where("kind = 'error'").select("path").distinct(), "path", "left_semi")
    light = light_scan(failed).join(failed.select("path", "module"), "path")
    row = lambda kind, sub, name: F.transform(F.col(name), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(sub).alias("subkind"), x.alias("said")))
    found = light.select("path", "module", F.posexplode(F.concat(row("symbol", "function", "functions"), row("symbol", "class", "classes"), row("import", "", "imports"))).alias("ord", "x"))
    py, symbol = F.endswith("path", F.lit(".py")), F.col("x.kind") == "symbol"
    return found.select(
        "path", "module", "ord", F.when(symbol, "symbol").when(py, "import").otherwise("include").alias("kind"), F.when(symbol, F.col("x.said")).alias("name"), F.when(symbol, F.col("x.subkind")).alias("subkind"), F.when(symbol, F.col("module")).alias("container"),
        F.when(symbol, F.lit("")).alias("signature"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.when(~symbol, F.col("x.said")).alias("raw"), F.when(~symbol, F.col("x.said")).alias("target_symbol"), F.lit(0.5).alias("confidence"),
    )


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``path, size`` of the files below a folder; contents are not read."""
    below = len(root.rstrip("/")) + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.select(F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*(?=/)', ''), {below + 1})").alias("path"), F.col("length").alias("size"))


def language_of(modules: DataFrame) -> DataFrame:
    """P20: the one language of all modules, mixed, or python if there are none."""
    n = modules.agg(F.count_distinct("language").alias("n"), F.min("language").alias("one"))
    return n.select(F.when(F.col("n") == 0, "python").when(F.col("n") == 1, F.col("one")).otherwise("mixed").alias("language"))


def light_scan(files: DataFrame) -> DataFrame:
    """Imports, called names and functions by patterns alone, as a degraded mode that needs no Python worker."""
    text = F.decode("content", "UTF-8") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    every = lambda pattern, k: F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(k))))
    calls = F.filter(every(r"\b([A-Za-z_]\w*)\s*\(", 1), lambda x: ~x.isin(sorted(C_WORDS)))
    return files.select(
        "path",
        F.concat(every(r"(?m)^\s*(?:import|from)\s+([\w.]+)", 1), every(r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", 1)).alias("imports"),
        calls.alias("calls"),
        every(r"(?m)^\s*(?:async\s+)?def\s+(\w+)", 1).alias("functions"),
        every(r"(?m)^\s*(?:class|struct)\s+(\w+)", 1).alias("classes"),
    )
