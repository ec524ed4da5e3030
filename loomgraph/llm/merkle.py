"""Merkle manifest of a dataset: leaves by language, subroots by language, proofs of every row, tampered rows found.

A fragment of a tree is a sparse forest: nodes keyed by level and index whose parents are not known yet. Two fragments merge by taking
the nodes of both and, as the leaves of the tree are counted, making the parent of each run of siblings that is complete; the order of
merging does not matter. A task folds each of its batches of leaves to a fragment; the fragments are reduced as a tree of rounds, each
merging what lies under one node ``SPAN`` levels up. ``RDD.treeReduce`` would merge distant fragments, whose runs stay open, and return
only the last one; the rounds merge neighbours and keep their nodes, which the way down needs: a node's proof is its siblings under the
round's node, then that node's proof. Nothing larger than ``2 ** SPAN`` nodes meets in a task and nothing comes to the driver but sizes.

Leaves get their places from a range sort: rows of a tree before a partition, and the row's place in it.

Defined cases: null fields are ``-``; a null language is a tree of its own, the first; rows of equal id are ordered by their leaf's
digest, and equal rows are leaves of their own; null ids come first and are never tampered with; an empty table gives an empty result.
Only the five columns named are read, so others may bear any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, stored, table

#: Siblings of a run, and levels that one round goes up: 4096 leaves.
ARITY, SPAN = 2, 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, size bigint, level int, at bigint, digest string"
PATH = "tree string, block bigint, path string, subroot string, root string, place bigint, places bigint"


def framed(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, leaf, other``: a row's digest, and that of the tampered row where it is tampered with. Trees sort as languages do."""
    kinds = dict.fromkeys(("doc_id", "n_chars"), "bigint")
    d = docs.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in FIELDS])

    def leaf(n_chars: Column) -> Column:
        return F.sha2(F.concat(*[framed(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS]), 256)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return d.select(tree.alias("tree"), "doc_id", leaf(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf(F.expr("try_add(n_chars, 1L)"))).alias("other"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, their place in their ``tree`` in the given order, and ``size``, its number of rows."""
    # a number for each row, so that copies of one row can be parted too
    rows = stored(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    by = ["tree", *order, "salt"]
    rows = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("n", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("n", 33))
    runs = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first"))
    w = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(w).alias("size")), "runs")
    return rows.join(small_side(runs), ["tree", "part"]).withColumn("at", F.col("n") + F.col("shift")).drop("n", "part", "shift", "salt")


def parent(run: list[str]) -> str:
    import hashlib

    return hashlib.sha256("".join(run).encode()).hexdigest()


def settle(nodes: dict, size: int, top: int = 64, made=None) -> dict:
    """The monoid's normal form: parents of all complete runs in place of the runs, up to level ``top``. ``nodes``: (level, index) -> digest.

    ``made(level, index, run)`` is told of each run before it goes.
    """
    levels: dict[int, dict[int, str]] = {}
    for (level, at), digest in nodes.items():
        levels.setdefault(level, {})[at] = digest
    level = min(levels, default=0)
    while level <= min(max(levels, default=-1), top - 1):
        here, width = levels.get(level, {}), -(-size // ARITY**level)
        if width > 1:
            for first in sorted({at - at % ARITY for at in here}):
                run = range(first, min(first + ARITY, width))
                if all(at in here for at in run):
                    digests = [here.pop(at) for at in run]
                    if made:
                        made(level, first, digests)
                    levels.setdefault(level + 1, {})[first // ARITY] = parent(digests)
        level += 1
    return {(level, at): digest for level, here in levels.items() for at, digest in here.items()}


def merge(a: dict, b: dict, size: int) -> dict:
    """The monoid's sum: two fragments of one tree."""
    return settle(a | b, size)


def fragments(span: int):
    """Batches of leaves ``tree, size, at, leaf`` to their unresolved nodes, up to the first round's level."""

    def run(batches):
        import pyarrow as pa

        kinds = [("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string())]
        for batch in batches:
            trees: dict = {}
            for tree, size, at, leaf in zip(*(c.to_pylist() for c in batch.columns)):
                trees.setdefault((tree, size), {})[0, at] = leaf
            out = [(tree, size, level, at, digest) for (tree, size), nodes in trees.items() for (level, at), digest in settle(nodes, size, span).items()]
            yield pa.RecordBatch.from_pylist([dict(zip([name for name, _ in kinds], row)) for row in out], pa.schema(kinds))

    return run


def under(rounds: int) -> Column:
    """The node that so many rounds up is above a node."""
    return F.expr(f"shiftright(shiftleft(at, level), {SPAN * rounds})")


def merged(top: int):
    """The fragments under one node of level ``top`` as one."""

    def run(pdf):
        import pandas as pd

        size = int(pdf["size"].iloc[0])
        nodes = settle({(int(level), int(at)): digest for level, at, digest in zip(pdf["level"], pdf["at"], pdf["digest"])}, size, top)
        return pd.DataFrame([(pdf["tree"].iloc[0], size, level, at, digest) for (level, at), digest in nodes.items()], columns=["tree", "size", "level", "at", "digest"])

    return run


def rounds_of(leaves: DataFrame) -> list[DataFrame]:
    """Nodes after each round; the last has one node a tree, its root."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    nodes, out = leaves.select("tree", "size", "at", "leaf").mapInArrow(fragments(SPAN), NODE), []
    while not out or most > ARITY ** (SPAN * len(out)):
        nodes = stored(nodes.groupBy("tree", under(len(out) + 1).alias("block")).applyInPandas(merged(SPAN * (len(out) + 1)), NODE), "round")
        out.append(nodes)
    return out


def siblings(nodes: dict, size: int) -> dict:
    """(level, index) -> digests of the siblings that it meets on its way to the forest's last node, in order."""
    above: dict = {}
    settle(nodes, size, made=lambda level, first, run: above.update({(level, first + k): (run[:k] + run[k + 1 :], (level + 1, first // ARITY)) for k in range(len(run))}))

    def path(key):
        out = []
        while key in above:
            met, key = above[key]
            out += met
        return "".join(out)

    return {key: path(key) for key in nodes}


def paths_down(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the nodes of the first round, from those of the trees' roots (``PATH``)."""
    import pandas as pd

    def down(nodes, paths):
        if nodes.empty:
            return pd.DataFrame([], columns=[x.split()[0] for x in PATH.split(", ")])
        found = siblings({(int(level), int(at)): d for level, at, d in zip(nodes["level"], nodes["at"], nodes["digest"])}, int(nodes["size"].iloc[0]))
        above = paths.iloc[0]
        rows = [(above["tree"], at << level, mine + above["path"], *above[["subroot", "root", "place", "places"]]) for (level, at), mine in found.items()]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PATH.split(", ")])

    paths = tops
    for r in range(len(rounds) - 1, 0, -1):
        keyed = rounds[r - 1].withColumn("block", under(r + 1))
        paths = keyed.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInPandas(down, PATH)
        paths = stored(paths.withColumn("block", F.shiftright("block", SPAN * r)), "paths")
    return paths


def folded(digest: str, at: int, size: int, path: str) -> tuple[str, str]:
    """The root that a digest and its siblings give, and the siblings left over."""
    while size > 1:
        run = min(ARITY, size - (at - at % ARITY))
        met = [path[64 * k : 64 * k + 64] for k in range(run - 1)]
        digest, path = parent(met[: at % ARITY] + [digest] + met[at % ARITY :]), path[64 * (run - 1) :]
        at, size = at // ARITY, -(-size // ARITY)
    return digest, path


def with_paths(leaves: DataFrame, rounds: list[DataFrame], tops: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(leaf row, its path, the path's row)`` of every leaf."""
    import pandas as pd

    names = [x.split()[0] for x in schema.split(", ")]

    def last(mine, paths):
        if mine.empty:
            return pd.DataFrame([], columns=names)
        found, above = siblings({(0, int(at)): d for at, d in zip(mine["at"], mine["leaf"])}, int(mine["size"].iloc[0])), paths.iloc[0]
        return pd.DataFrame([finish(row, found[0, int(row.at)] + above["path"], above) for row in mine.astype(object).itertuples(index=False)], columns=names)

    keyed = leaves.withColumn("block", F.shiftright("at", SPAN))
    return keyed.groupBy("tree", "block").cogroup(paths_down(rounds, tops).groupBy("tree", "block")).applyInPandas(last, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, tree`` of every row."""
    leaves = placed(leaves_of(docs), "doc_id", "leaf")
    rounds = rounds_of(leaves)
    # the subroots are the leaves of one more tree
    roots = placed(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf")), "name")
    upper = rounds_of(roots)
    start = upper[-1].select("tree", F.lit(0).cast("bigint").alias("block"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"), F.lit(0).cast("bigint").alias("place"), F.lit(1).cast("bigint").alias("places"))
    tops = stored(with_paths(roots, upper, start, lambda row, path, above: (row.name, 0, path, row.leaf, above["root"], row.at, row.size), PATH), "tops")

    def proved(row, path, above):
        import hashlib

        sub, rest = folded(row.other if isinstance(row.other, str) else row.leaf, int(row.at), int(row.size), path)
        got, _ = folded(sub, int(above["place"]), int(above["places"]), rest)
        doc_id = int(row.doc_id) if isinstance(row.doc_id, str) else None
        return doc_id, row.leaf, above["subroot"], above["root"], hashlib.sha256(path.encode()).hexdigest(), got, got == above["root"], row.tree

    # ids as text: pandas would turn those of a group with a null id into doubles
    leaves = leaves.select("tree", "at", "size", "leaf", "other", F.col("doc_id").cast("string").alias("doc_id"))
    return with_paths(leaves, rounds, tops, proved, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, tree string")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its leaf, roots, proof, and whether the row, tampered with or not, gives the root."""
    return manifest(table(spark, sf_dir, "documents")).drop("tree")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, list_reduce([xor(c & 255, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, o: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))), 4294967295) % 7 = 0 AS hit FROM documents),
l AS (SELECT r, doc_id, tree, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS other FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY tree) AS w FROM l),
n AS (SELECT tree, 0 AS level, i, w, leaf AS digest FROM p
  UNION ALL SELECT tree, level + 1, i // 2, (w + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM n WHERE w > 1 GROUP BY tree, level, i // 2, w),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS w FROM n WHERE w = 1),
m AS (SELECT 0 AS level, i, w, subroot AS digest FROM s
  UNION ALL SELECT level + 1, i // 2, (w + 1) // 2, sha256(string_agg(digest, '' ORDER BY i)) FROM m WHERE w > 1 GROUP BY level, i // 2, w),
a AS (SELECT r, tree, 0 AS level, i, w, '' AS path, coalesce(other, leaf) AS f FROM p
  UNION ALL SELECT r, a.tree, a.level + 1, a.i // 2, (a.w + 1) // 2, path || coalesce(n.digest, ''), sha256(CASE WHEN n.digest IS NULL THEN f WHEN a.i % 2 = 0 THEN f || n.digest ELSE n.digest || f END)
    FROM a LEFT JOIN n ON n.tree = a.tree AND n.level = a.level AND n.i = xor(a.i, 1) WHERE a.w > 1),
b AS (SELECT r, 0 AS level, s.i, s.w, path, f FROM a JOIN s USING (tree) WHERE a.w = 1
  UNION ALL SELECT r, b.level + 1, b.i // 2, (b.w + 1) // 2, path || coalesce(m.digest, ''), sha256(CASE WHEN m.digest IS NULL THEN f WHEN b.i % 2 = 0 THEN f || m.digest ELSE m.digest || f END)
    FROM b LEFT JOIN m ON m.level = b.level AND m.i = xor(b.i, 1) WHERE b.w > 1)
SELECT p.doc_id, p.leaf, s.subroot, m.digest AS root, sha256(b.path) AS proof_sha256, b.f AS folded_root, b.f = m.digest AS verified
FROM p JOIN s USING (tree) JOIN b ON b.r = p.r AND b.w = 1 JOIN m ON m.w = 1"""
