"""Graph and cache files (survey rows S1, S2, S11-S16, S21-S22)."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.store import empty_graph, validate_graph

MAX_GRAPH_BYTES, MAX_TEXT_BYTES, HISTORY = 16 << 20, 32 << 10, 8
#: Files of a module's memory.
MEMORY_FILES = ["context", "interface", "state", "decisions"]


class GraphTooLarge(ValueError):
    code = "GRAPH_TOO_LARGE"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a graph document, with places; an empty graph if there is none; too large a one is refused."""
    if not _exists(spark, path):
        return empty_graph(spark)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    if size > MAX_GRAPH_BYTES:
        raise GraphTooLarge(f"{path} has {size} bytes")
    bare = lambda s: ", ".join(f for f in _fields(s) if not f.startswith("ord "))
    parts = f"nodes array<struct<{_typed(bare(schema.NODES))}>>, edges array<struct<{_typed(bare(schema.EDGES))}>>, mappings array<struct<{_typed(bare(schema.MAPPINGS))}>>, overrides struct<include:array<string>,exclude:array<string>,deleted:array<string>>"
    doc = spark.read.schema(parts).option("multiLine", True).json(path)
    each = lambda name: doc.select(F.posexplode(name).alias("ord", "x")).select(F.col("ord").cast("bigint").alias("ord"), "x.*")
    over = doc.select(F.explode(F.map_from_arrays(F.array(F.lit("include"), F.lit("exclude"), F.lit("deleted")), F.array("overrides.include", "overrides.exclude", "overrides.deleted"))).alias("kind", "ids"))
    return {"nodes": each("nodes"), "edges": each("edges"), "mappings": each("mappings"), "overrides": over.select("kind", F.posexplode("ids").alias("ord", "id")).select("kind", "id", F.col("ord").cast("bigint").alias("ord"))}


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:k].strip())
            start = k + 1
    return out


def _typed(ddl: str) -> str:
    return ",".join(f.replace(" ", ":", 1) for f in _fields(ddl))


def save_graph(graph: dict[str, DataFrame], path: str) -> None:
    """Write the tables of a valid graph as Parquet; an invalid one is refused with all its errors."""
    items = graph["mappings"].select("functional", F.explode_outer("implementation").alias("i")).select("functional", F.col("i.id").alias("impl_id"))
    wrong = validate_graph(graph["nodes"], graph["edges"], items).limit(100).collect()  # as many as a message shows
    if wrong:
        raise ValueError("; ".join(f"{r.code} {r.subject or ''} {r.detail or ''}".strip() for r in wrong))
    for name, df in graph.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A graph that ``save_graph`` wrote."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "mappings", "overrides")}


def save_state(state: DataFrame, path: str, version: int) -> None:
    """A snapshot of the file state under its version; a reader sees it only when it is whole (its success mark is there)."""
    state.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{path}/v{version}")


def load_state(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The snapshot of a version, or None: other versions are not used."""
    return spark.read.parquet(f"{path}/v{version}").drop("version") if _exists(spark, f"{path}/v{version}/_SUCCESS") else None


def bounded_text(files: DataFrame) -> DataFrame:
    """``path, text``: at most 32 KiB of each file (``path, content``), with a mark if it was cut."""
    cut = F.decode(F.substring("content", 1, MAX_TEXT_BYTES), "UTF-8")
    return files.select("path", F.when(F.length("content") > MAX_TEXT_BYTES, F.concat(cut, F.lit("\n[truncated]"))).otherwise(cut).alias("text"))


def contained(path: str) -> bool:
    """Whether a relative path stays below its root."""
    depth = 0
    for part in path.replace("\\", "/").split("/"):
        depth += -1 if part == ".." else part not in ("", ".")
        if depth < 0:
            return False
    return not path.startswith(("/", "\\")) and ":" not in path.split("/")[0]


def missing_memory(nodes: DataFrame, present: DataFrame) -> DataFrame:
    """Memory files (``path``) to be made: the project's and four a code module, those present left alone."""
    kinds = F.explode(F.array(*[F.lit(k) for k in MEMORY_FILES])).alias("kind")
    wanted = nodes.where("type = 'code_module'").select("id", kinds).select(F.concat(F.lit(".context/modules/"), F.url_encode("id"), F.lit("/"), "kind", F.lit(".md")).alias("path"))
    project = nodes.sparkSession.createDataFrame([(".context/project.md",)], "path string")
    return wanted.unionByName(project).distinct().join(present.select("path"), "path", "left_anti")


def git_summary(project: str, target: str = "") -> tuple[list[str], list[str]]:
    """Changed files and the last eight commits (of a path); empty without a repository."""

    def git(*args: str) -> list[str]:
        try:
            said = subprocess.run(["git", "-C", project, *args], capture_output=True, text=True, timeout=30)
        except (OSError, subprocess.TimeoutExpired):
            return []
        return [x for x in said.stdout.rstrip().split("\n") if x] if said.returncode == 0 else []

    return git("status", "--short"), git("log", "-n", str(HISTORY), "--date=short", "--pretty=format:%h %ad %s", *(["--", target] if target else []))


def child_projects(spark: SparkSession, root: str) -> list[str]:
    """Folders below a root, by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return sorted(s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p) if s.isDirectory())
