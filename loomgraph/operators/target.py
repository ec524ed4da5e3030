"""Targets and exclusions named in free text (survey rows T1-T9)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim_all
from .store import is_implementation

# What asks for an exclusion, in the order that they are looked for.
MARKERS = [
    r"(?:不要|别|禁止)(?:再)?(?:自动)?(?:加载|包含|注入|读取|选择|使用|参考|带上|携带)\s*",
    r"(?:无需|不需要)(?:再)?(?:加载|包含|注入|读取|选择|使用|参考|带上|携带)\s*",
    r"排除\s*",
    r"(?<![A-Za-z0-9_])(?:do not|don't|never|must not|should not)\s+(?:load|include|inject|read|select|use|reference|send)\s+",
    r"(?<![A-Za-z0-9_])(?:exclude|omit)\s+",
]
NEGATION = r"(?:不要|别|禁止|不应|do not|don't|never|must not|should not)\s*$"
CONTRAST = r"(?<![A-Za-z0-9_])(?:but|instead)(?![A-Za-z0-9_])|但是|但|而是|而要|改为"
CONNECTOR = r"(?:(?:the|and|or|module|modules|node|nodes|feature|features)(?![A-Za-z0-9_])|以及|并且|和|与|及|或|、|模块|节点|功能)\s*"
CLAUSES = r"[\n,，;；。!?！？]+"


def latest_user_text(messages: DataFrame) -> DataFrame:
    """Per session the text of the last ordinary user message. Rows ``session, pos, role, kind, text``."""
    plain = messages.where((F.col("role") == "user") & ~F.coalesce(F.col("kind").isin("plugin", "tool"), F.lit(False)))
    return plain.groupBy("session").agg(F.max_by("text", "pos").alias("t")).select("session", trim_all(F.coalesce("t", F.lit(""))).alias("text"))


def alias_table(nodes: DataFrame) -> DataFrame:
    """``alias, id`` of the nodes of the highest rank that bear a name: functional, others, implementation."""
    rank = F.when(F.col("type") == "functional", 3).when(is_implementation(F.col("type")), 1).otherwise(2)
    names = nodes.select("id", rank.alias("rank"), F.explode(F.array("id", "title", "label")).alias("a")).select("id", "rank", F.lower(trim_all(F.coalesce("a", F.lit("")))).alias("alias")).where("alias <> ''").distinct()
    top = names.groupBy("alias").agg(F.max("rank").alias("rank"))
    return names.join(top, ["alias", "rank"]).select("alias", "id")


#: Bits of the filter over names (its size has this bound, whatever the number of names), and characters of a name that are looked at first.
FILTER_BITS, HEAD = 27, 8
_PRIME, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mentions(texts: DataFrame, names: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of ``texts`` and ``alias`` for every name (``alias``) that the lower-cased text contains, once a row."""
    return _likely(texts, names, text_col).join(names.select("alias").distinct(), "alias", "left_semi")


def _likely(texts: DataFrame, names: DataFrame, text_col: str = "text") -> DataFrame:
    """``mentions`` and a few more strings that are no names: a join with the names leaves those out.

    Texts are read once, however many names there are. A place in a text may begin a name if a filter of fixed size has its first
    characters, and is cut at the lengths of names at which the filter has the whole; sums of powers give each piece's hash at once.
    """
    keys = [f for f in texts.schema.fields if f.name != text_col]
    schema = T.StructType([*keys, T.StructField("alias", T.StringType())])
    names = names.where("alias <> ''").select("alias")
    lengths = sorted(r.n for r in names.select(F.char_length("alias").alias("n")).distinct().collect())
    words = names.mapInArrow(_filter_words, "word int, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    shipped = texts.sparkSession.sparkContext.broadcast((bits, lengths))

    def run(batches):
        import pyarrow as pa

        bits, lengths = shipped.value
        for b in batches:
            said = b.column(len(keys)).to_pylist()
            lo = 0
            while lo < len(said):
                hi, size = lo, 0
                while hi < len(said) and size < 1 << 18:
                    size, hi = size + len(said[hi] or ""), hi + 1
                found = sorted(_pieces([(t or "").lower() for t in said[lo:hi]], bits, lengths))
                at = pa.array([lo + row for row, _ in found], pa.int32())
                yield pa.RecordBatch.from_arrays([c.take(at) for c in b.columns[: len(keys)]] + [pa.array([name for _, name in found], pa.string())], names=schema.names)
                lo = hi

    # a table in few files is read by few tasks: texts are dealt anew before they are scanned
    dealt = texts.select(*[F.col(f.name) for f in keys], F.col(text_col)).repartition(2 * texts.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, schema)


def _sums(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid one after another: sums of characters times powers of a number up to each place, that number's inverse powers, and ends."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(codes) + 1, _PRIME, np.uint64))
        back = np.cumprod(np.full(len(codes) + 1, pow(_PRIME, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * np.uint64(_MIX) * power[:-1])])
    return sums, back, np.cumsum([len(t) for t in texts])


def _bit(sums: np.ndarray, back: np.ndarray, at: np.ndarray, size, whole: bool) -> np.ndarray:
    """The filter's bit of pieces; the first characters of longer names are told from whole names."""
    with np.errstate(over="ignore"):
        h = (sums[at + size] - sums[at]) * back[at] + np.asarray(size).astype(np.uint64) * np.uint64(2) + np.uint64(whole)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_PRIME)
    return h >> np.uint64(64 - FILTER_BITS)


def _filter_words(batches):
    """64-bit words of the filter that a batch of names sets bits of."""
    import pyarrow as pa

    for b in batches:
        names = b.column(0).to_pylist()
        if not names:
            continue
        sums, back, ends = _sums(names)
        size = np.array([len(n) for n in names])
        at = ends - size
        long = size > HEAD
        bit = np.unique(np.concatenate([_bit(sums, back, at, size, True), _bit(sums, back, at[long], np.full(long.sum(), HEAD), False)]))
        word, first = np.unique(bit >> np.uint64(6), return_index=True)
        mask = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), first)
        yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))], names=["word", "mask"])


def _pieces(texts: list[str], bits: np.ndarray, lengths: list[int]) -> set[tuple[int, str]]:
    """``(text, piece)`` of all pieces of texts that the filter has."""
    sums, back, ends = _sums(texts)
    if len(sums) == 1:
        return set()
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    rest = ends[owner] - np.arange(len(owner))
    starts = ends - np.array([len(t) for t in texts])

    def has(at, size, whole):
        at = at[rest[at] >= size]
        bit = _bit(sums, back, at, np.full(len(at), size), whole)
        return at[(bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]

    every = np.arange(len(owner))
    head = has(every, HEAD, False) if lengths and lengths[-1] > HEAD else every[:0]
    out = set()
    for size in lengths:
        for i in has(every if size <= HEAD else head, size, True).tolist():
            row = int(owner[i])
            begin = i - int(starts[row])
            out.add((row, texts[row][begin : begin + size]))
    return out


def named_exclusions(tasks: DataFrame, aliases: DataFrame) -> DataFrame:
    """``task_id, alias, id`` (id null: ambiguous) of what a task asks to leave out.

    The phrases after a marker are cut, the names that each contains are found by ``mentions``, and the walk over a phrase, name
    after name, takes the longest of them at each place: no other name can be in it.
    """
    names = aliases.groupBy("alias").agg(F.count_distinct("id").alias("n"), F.min("id").alias("one"))
    phrases = _phrases(tasks)
    texts = phrases.select("phrase", F.col("phrase").alias("text")).distinct()
    known = mentions(texts, names).groupBy("phrase").agg(F.collect_set("alias").alias("known"))

    def walked(batches):
        import pyarrow as pa

        for b in batches:
            at, said = [], []
            for row, (phrase, known_) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                hit = _walk(phrase, frozenset(known_))
                at += [row] * len(hit)
                said += hit
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(said, pa.string())], names=["task_id", "alias"])

    kind = tasks.schema["task_id"].dataType.simpleString()
    found = phrases.join(known, "phrase").select("task_id", "phrase", "known").mapInArrow(walked, f"task_id {kind}, alias string").distinct()
    return found.join(names, "alias").select("task_id", "alias", F.when(F.col("n") == 1, F.col("one")).alias("id"))


def _phrases(tasks: DataFrame) -> DataFrame:
    def cut(text):
        import re

        out = []
        for clause in re.split(CLAUSES, text or ""):
            for marker in MARKERS:
                for m in re.finditer(marker, clause, re.I):
                    if re.match(r"(?:排除|exclude|omit)", m[0], re.I) and re.search(NEGATION, clause[: m.start()].rstrip(), re.I):
                        continue
                    out.append(re.split(CONTRAST, clause[m.end() :].lower(), maxsplit=1)[0])
        return out

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cuts = [cut(t) for t in b.column(1).to_pylist()]
            at = pa.array([row for row, c in enumerate(cuts) for _ in c], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([p for c in cuts for p in c], pa.string())], names=["task_id", "phrase"])

    return tasks.select("task_id", F.col("text").cast("string")).mapInArrow(run, f"task_id {tasks.schema['task_id'].dataType.simpleString()}, phrase string").distinct()


def _walk(phrase: str, known: frozenset) -> list[str]:
    """Aliases that a phrase lists, the longest first at each place, between connectors."""
    import re

    longest, out, rest = max(map(len, known), default=0), [], phrase
    while rest:
        rest = re.sub(r"^[\s\"'`()\[\]{}]+", "", rest)
        word = re.match(CONNECTOR, rest, re.I)
        if word:
            rest = rest[word.end() :]
            continue
        for n in range(min(longest, len(rest)), 0, -1):
            after = rest[n:]
            free = not after or re.match("模块|节点|功能", after) or not (after[0].isalnum() or after[0] in "_-")
            if rest[:n] in known and free:
                out.append(rest[:n])
                rest = after
                break
        else:
            break
    return out


def infer_target(tasks: DataFrame, nodes: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """``task_id, target, score``: the node that a task names: by id, title, label or path (3), or by the last part of one (1)
    if that names one node only; longer names, then longer ids first. blocked: ``task_id, id``.

    Names in texts are found by ``mentions``; what is joined are names, not texts.
    """
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lower(F.col(c)).alias("v")) for k, c in enumerate(("id", "title", "label", "path"))])).alias("x")
    full = nodes.select(F.col("id").alias("node"), value).where("x.v <> ''").select("node", F.col("x.k").alias("k"), F.col("x.v").alias("alias"))
    leaf = full.select("node", (F.col("k") + 10).alias("k"), F.element_at(F.split("alias", r"[/.]"), -1).alias("alias")).where(F.length("alias") >= 4)
    names = full.where(F.length("alias") >= 2).withColumn("score", F.lit(3)).unionByName(leaf.withColumn("score", F.lit(1)))
    hits = _likely(tasks.select("task_id", F.lower("text").alias("text")), names).join(names, "alias")
    first = hits.groupBy("task_id", "node").agg(F.max(F.struct("score", (-F.col("k")).alias("k"), "alias")).alias("h")).select("task_id", "node", "h.score", "h.alias")
    if blocked is not None:
        first = first.join(blocked.select("task_id", F.col("id").alias("node")).distinct(), ["task_id", "node"], "left_anti")
    best = first.groupBy("task_id").agg(F.max(F.struct("score", F.length("alias").alias("n"), F.length("node").alias("m"))).alias("top"))
    top = first.join(best, "task_id").where((F.col("score") == F.col("top.score")) & (F.length("alias") == F.col("top.n")))
    pick = top.groupBy("task_id").agg(F.max("score").alias("score"), F.count_distinct("node").alias("n"), F.min_by("node", F.struct((-F.length("node")).alias("l"), "node")).alias("node"), F.min_by("alias", F.struct((-F.length("node")).alias("l"), "node")).alias("alias"))
    alone = first.groupBy("task_id", "alias", "score").agg(F.count_distinct("node").alias("same"))
    pick = pick.join(alone, ["task_id", "alias", "score"], "left")
    ok = (F.col("score") == 3) | (F.col("same") == 1)
    return tasks.select("task_id").join(pick.where(ok).select("task_id", F.col("node").alias("target"), "score"), "task_id", "left")


def target_cascade(tasks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first target of functional, implementation, then other nodes (no conversations or tasks)."""
    code = is_implementation(F.col("type"))
    tiers = [nodes.where("type = 'functional'"), nodes.where(code), nodes.where(~code & ~F.col("type").isin("functional", "conversation", "task"))]
    out = tasks.select("task_id")
    for k, tier in enumerate(tiers):
        out = out.join(infer_target(tasks, tier).select("task_id", F.col("target").alias(f"t{k}")), "task_id", "left")
    return out.select("task_id", F.coalesce("t0", "t1", "t2").alias("target"))


def escape_attribute(col: Column) -> Column:
    """Markup characters of an attribute escaped."""
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col
