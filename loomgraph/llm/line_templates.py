"""Line deduplication by a log-template tree.

A line is parsed at fixed depth: its leaf is its token count and its leading ``LEAD`` tokens; tokens with a digit are variable
fields and become one wildcard. In a leaf of ``MIN_DOCS`` texts or more, the fields are told by how many texts have a token at
its place: fewer than ``MIN_DOCS``, or (in a second, coarser generalisation) than a ``COARSE`` part of the leaf's texts, make the
place a variable field. What is left is the line's template, whatever the number and the places of its fields; a template
needs a third of constant tokens and at most a third of fields without digits. A template's count is the number of different
texts that have it.

A line is dropped if a template of it occurs in ``MIN_DOCS`` texts or more and ``OUTSTANDING`` times as many as the text at
large. What the text at large has is told by the support of its lines, the median over a line's places of the number of texts
with its token there: the lesser of the support that half of its lines, and half of its words, do not exceed. Copies edited here
and there support each other's lines, changed ones too, so what recurs because whole documents were copied is left for
near-duplicate removal; what is dropped recurs across documents that are otherwise different.

All counts are sums of partial sums; no task holds a leaf. Only lines of recurring leaves are looked at token by token.

Defined cases: null texts stay null; empty and blank lines are never dropped and count for nothing; an empty table gives an
empty one; equal texts count once and are treated alike, whatever their ids; a line that a text repeats counts once; ties keep
the line; the lines that stay keep their order, and of every text the line of least support stays; texts are never cut, however
long; columns of any name are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_process, sliced, small_side, stored, table

LEAD, MIN_DOCS, OUTSTANDING, COARSE = 2, 20, 3, 0.1
WILD = 0
#: Leaves (8 bytes each) up to which their list is sent to the workers.
LISTED = 1_000_000


class TokenHashes:
    """64-bit hash of each token; a token with a digit has the wildcard's."""

    def __init__(self):
        import re

        import xxhash

        self.hash, self.digit, self.seen = xxhash.xxh64_intdigest, re.compile(rb"[0-9]").search, {}

    def leaf(self, tokens: list[bytes]) -> int:
        """Hash of the token count and the leading tokens, never 0."""
        lead = [b"<*>" if self.digit(t) else t for t in tokens[:LEAD]]
        return (self.hash(b"\0".join([b"%d" % len(tokens), *lead])) or 1) - (1 << 63)

    def of(self, tokens: list[bytes]) -> list[int]:
        seen = self.seen
        if len(seen) > 100_000:
            seen.clear()
        for t in tokens:
            if t not in seen:
                seen[t] = WILD if self.digit(t) else (self.hash(t) or 1) - (1 << 63)
        return [seen[t] for t in tokens]


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text).alias("h"), text.cast("binary").alias("t"))


def leaf_table(docs: DataFrame, text_col: str) -> DataFrame:
    """``h, leaves, sizes`` of every different text: each line's leaf (0: blank) and number of tokens."""

    def run(batches):
        import pyarrow as pa

        hashes = per_process("token_hashes", TokenHashes)
        for b in sliced(batches):
            split = [[line.split() for line in x.as_py().split(b"\n")] for x in b.column(1)]
            leaves = [np.array([hashes.leaf(s) if s else 0 for s in lines], np.int64) for lines in split]
            sizes = [[len(s) for s in lines] for lines in split]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaves, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=["h", "leaves", "sizes"])

    return _texts(docs, text_col).mapInArrow(run, "h bigint, leaves array<bigint>, sizes array<int>").dropDuplicates(["h"])


def parsed_lines(docs: DataFrame, text_col: str, lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """``h, line, leaf, first, tokens`` of the lines of recurring leaves; first: no equal line goes before in the text.

    Up to ``LISTED`` leaves are sent to the workers, which find the lines by them; more leaves are joined with the texts' lines.
    """
    texts, listed = _texts(docs, text_col), leaves.count() <= LISTED
    shipped = docs.sparkSession.sparkContext.broadcast({r.leaf for r in leaves.select("leaf").collect()} if listed else set())
    if listed:
        rows = texts.select("h", F.lit(None).cast("array<int>"), "t")
    else:
        marked = lines.select("h", F.posexplode("leaves").alias("line", "leaf")).join(leaves, "leaf", "left_semi")
        rows = texts.join(marked.groupBy("h").agg(F.sort_array(F.collect_list("line")).alias("lines")), "h").select("h", "lines", "t")

    def run(batches):
        import pyarrow as pa

        hashes, names = per_process("token_hashes", TokenHashes), ["h", "line", "leaf", "first", "tokens"]
        for b in sliced(batches):
            rows = []
            for h, at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                split, seen = x.as_py().split(b"\n"), set()
                for k in range(len(split)) if at is None else at:
                    words = split[k].split()
                    leaf = hashes.leaf(words) if words else 0
                    if at is not None or leaf in shipped.value:
                        rows.append((h, k, leaf, tuple(words) not in seen, hashes.of(words)))
                        seen.add(tuple(words))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * 5, kinds)], names=names)

    return rows.mapInArrow(run, "h bigint, line int, leaf bigint, first boolean, tokens array<bigint>").dropDuplicates(["h", "line"])


def dropped_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, outstanding: float = OUTSTANDING) -> DataFrame:
    """``h, drop``: by hash of the text, the numbers (from 0) of lines to drop, for the texts that have any."""
    lines = stored(leaf_table(docs, text_col), "lines")
    leaves = lines.select(F.explode(F.array_distinct(F.filter("leaves", lambda x: x != 0))).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n_leaf"))
    leaves = stored(leaves.where(F.col("n_leaf") >= min_docs), "leaves")
    parsed = stored(parsed_lines(docs, text_col, lines, leaves), "parsed")
    tokens = parsed.select("h", "line", "leaf", "first", F.size("tokens").alias("w"), F.posexplode("tokens").alias("place", "token"))
    constants = tokens.where("first").groupBy("leaf", "place", "token").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    constants = stored(constants.join(small_side(leaves), "leaf").select("leaf", "place", "token", "n", (F.col("n") >= F.col("n_leaf") * COARSE).alias("often")), "constants")
    placed = tokens.join(small_side(constants), ["leaf", "place", "token"], "left")
    digit, keys = F.col("token") == WILD, []
    for k, known in enumerate((F.col("n").isNotNull(), F.coalesce("often", F.lit(False)))):
        said = F.when(known, F.col("token")).otherwise(F.lit(WILD))
        keys += [F.bit_xor(F.xxhash64("place", said)).alias(f"key{k}"), F.count_if(~known & ~digit).alias(f"wild{k}"), F.count_if(known & ~digit).alias(f"same{k}")]
    middle = F.sort_array(F.collect_list(F.coalesce("n", F.lit(0).cast("bigint"))))[F.floor((F.col("w") - 1) / 2).cast("int")]
    whole = stored(placed.groupBy("h", "line", "leaf", "first", "w").agg(middle.alias("support"), *keys), "generalised")
    fits = lambda k: F.when((F.col(f"wild{k}") * 3 <= F.col("w")) & (F.col(f"same{k}") * 3 >= F.col("w")), F.xxhash64("leaf", f"key{k}"))
    keyed = whole.select("h", "line", "first", F.explode(F.array_distinct(F.array_compact(F.array(fits(0), fits(1))))).alias("key"))
    templates = stored(keyed.where("first").select("h", "key").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "templates")
    found = keyed.join(small_side(templates), "key").groupBy("h", "line").agg(F.max("n").alias("n"))
    each = whole.select("h", "line", "w", "support").join(found, ["h", "line"], "left")
    # a text's lines by support, those of leaves that do not recur (support 0) ahead of them as a number of lines and words
    a = each.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("support", "w", "line", "n"))).alias("a"), F.sum("w").alias("w"), F.count("*").alias("k"))
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("words")
    a = a.join(lines.select("h", total, F.size(F.filter("sizes", lambda x: x > 0)).alias("full")), "h")
    at = F.floor((F.col("full") - 1) / 2).cast("int") - (F.col("full") - F.col("k")).cast("int")
    by_lines = F.when(at < 0, F.lit(0)).otherwise(F.get("a", at)["support"])
    other = F.col("words") - F.col("w")
    start = F.struct(other.alias("below"), F.when(other * 2 >= F.col("words"), F.lit(0).cast("bigint")).alias("base"))
    walk = lambda s, x: F.struct((s["below"] + x["w"]).alias("below"), F.coalesce(s["base"], F.when((s["below"] + x["w"]) * 2 >= F.col("words"), x["support"])).alias("base"))
    a = a.withColumn("base", F.greatest(F.least(by_lines, F.aggregate("a", start, walk)["base"]), F.lit(1)))
    drop = F.transform(F.filter("a", lambda x: x["n"].isNotNull() & (x["n"] >= F.col("base") * outstanding)), lambda x: x["line"])
    return a.select("h", F.array_sort(drop).alias("drop")).where(F.size("drop") > 0)


def drop_templates(docs: DataFrame, text_col: str = "text", mark: str = "__dropped", **kw) -> DataFrame:
    """The rows and columns of docs, texts without the dropped lines, and a column ``mark`` with their numbers (null: none)."""
    h, gone = fresh(docs, "text_key", "lines_gone")
    drops = stored(dropped_lines(docs, text_col, **kw), "drops").select(F.col("h").alias(h), F.col("drop").alias(gone))
    joined = docs.join(small_side(drops), F.xxhash64(F.col(text_col).cast("string")) == F.col(h), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col(gone).alias(mark))


def op7_line_templates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    (mark,) = fresh(docs, "dropped_lines")
    return drop_templates(docs, mark=mark).select(
        "doc_id",
        F.when(F.col(mark).isNull(), 0).otherwise(F.size(mark)).cast("bigint").alias("n_dropped"),
        F.coalesce(F.array_join(F.transform(mark, lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("kept_chars"),
    )
