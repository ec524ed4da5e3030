"""Secret scan with multipart credential linking, in DataFrame operations only.

Base kinds (fixed patterns, leftmost and non-overlapping per kind):

* ``assign``: keyword, separator, value; kept if the value has 12 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 18 or more characters;
* ``hex``: 16 or more of ``0-9a-f``.

Weak kinds are too common to be reported alone: ``id`` (a short access identifier), ``key`` (a bare mixed-case token
as long as a secret), ``endpoint`` (an address of a service). Every part, weak or base, lies in a *scope*: ``scope``
characters in either direction. An interval join brings parts of one row together, by cells of the scope's width and
their neighbours, and a weak part is reported only when a complementary part (an identifier for a secret, a secret for
an identifier, either for an endpoint) begins within the scope and does not overlap it.

Offsets come from the pieces between the matches: a match begins where the lengths of all earlier pieces and matches
end, which a running sum gives in linear time for any number of matches. The texts are read once: the lengths of pieces and
matches are stored under a row number, and all that follows reads those.

Defined cases: null text is empty; empty text has no span and keeps its row; every input row gives one output row, also
if it repeats or its id is null; an empty table gives an empty result; a text may be of any length and have any number of
matches; extra columns are ignored; order of spans is by start, then kind as listed above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The patterns that the results are defined by.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Weak patterns, ours.
ID = r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|AKIA)[A-Z0-9]{6,13}(?![A-Z0-9])"
KEY = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])[A-Za-z0-9+/]{24,}+"
ENDPOINT = r"""https?://[^\s"'<>]{4,}"""

#: kind, pattern, a cheap necessary condition, part it plays, whether it stands alone.
KINDS = [
    ("assign", ASSIGN, None, "secret", True),
    ("access", ACCESS, "AKIA", "id", True),
    ("hex", HEX, None, "secret", True),
    ("id", ID, None, "id", False),
    ("key", KEY, None, "secret", False),
    ("endpoint", ENDPOINT, "://", "endpoint", False),
]


def secret_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = 200) -> DataFrame:
    """One row per input row: ``row_id, id, spans``; spans is an array of ``(start, rank, kind, end)`` in order.

    Spans of the weak kinds are in it only where a complementary part lies in their scope.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_id"), text.alias("t"))
    none = F.array().cast("array<struct<rank:int,sizes:array<struct<gap:int,n:int,counts:boolean>>>>")
    value = lambda hit: F.regexp_extract(hit, f"^(?:{ASSIGN})$", 1)
    found = []
    for rank, (_, pattern, needs, _, _) in enumerate(KINDS):
        has = F.col("t").rlike(pattern)
        has = F.col("t").contains(needs) & has if needs else has
        # the last piece of a kind follows its last match and has no match of its own
        both = F.arrays_zip(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("hit"), F.split("t", pattern, -1).alias("piece"))
        counts = (lambda z: F.length(value(z["hit"])) >= 12) if rank == 0 else (lambda z: F.lit(True))
        sizes = F.transform(F.filter(both, lambda z: z["hit"].isNotNull()), lambda z: F.struct(F.length(z["piece"]).alias("gap"), F.length(z["hit"]).alias("n"), counts(z).alias("counts")))
        found.append(F.when(has, F.array(F.struct(F.lit(rank).alias("rank"), sizes.alias("sizes")))).otherwise(none))
    scanned = stored(rows.select("row_id", "id", F.concat(*found).alias("kinds")), "scanned")
    per_kind = scanned.select("row_id", F.explode("kinds").alias("k"))
    hits = per_kind.select("row_id", "k.rank", F.posexplode("k.sizes")).select("row_id", "rank", "pos", "col.*")
    upto = Window.partitionBy("row_id", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).withColumn("start", F.col("end") - F.col("n"))
    parts = stored(placed.where("counts").select("row_id", "rank", "start", "end"), "parts")
    linked = _linked(parts, scope)
    by_row = linked.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))
    ids = scanned.select("row_id", "id")
    kinds = F.array(*[F.lit(k[0]) for k in KINDS])
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), F.element_at(kinds, s["rank"] + 1).alias("kind"), s["end"].alias("end")))
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return ids.join(by_row, "row_id", "left").select("row_id", "id", F.coalesce(spans.cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"), empty).alias("spans"))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Base parts, and weak parts with a complementary part within the scope."""
    part = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("rank") + 1)
    alone = F.element_at(F.array(*[F.lit(k[4]) for k in KINDS]), F.col("rank") + 1)
    parts = parts.withColumn("part", part).withColumn("cell", F.floor(F.col("start") / scope))
    weak = parts.where(~alone)
    near = weak.select("row_id", "rank", "start", "end", "part", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    other = parts.select("row_id", "cell", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("part").alias("o_part"))
    apart = (F.col("o_end") <= F.col("start")) | (F.col("end") <= F.col("o_start"))
    close = F.abs(F.col("o_start") - F.col("start")) <= scope
    kept = near.join(other, ["row_id", "cell"]).where((F.col("part") != F.col("o_part")) & apart & close).select("row_id", "rank", "start", "end").distinct()
    return parts.where(alone).select("row_id", "rank", "start", "end").unionByName(kept)


def secret_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of ``secret_spans``: counts and joined base spans, and all spans."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda r: F.size(F.filter("spans", lambda s: s["rank"] == r)).cast("bigint")
    joined = lambda a: F.array_join(F.transform(a, said), ",")
    return secret_spans(docs).select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op10_credential_links(spark, sf_dir):
    from .common import table

    return secret_digest(table(spark, sf_dir, "documents"))
