"""Benchmark decontamination by a distributed positional inverted index.

The index is a stored table of shards, each of some whole documents (a bounded number of words, or one long document). A
shard holds its documents' places and, for each term of the test set, the term's postings: ascending positions in the
shard, where a gap between documents keeps phrases from crossing them. Terms that no test item has cannot be part of a match
and are not stored. A shard lies in one row, so neither the building nor the search shuffles text or postings.

A phrase (window) is searched from its rarest terms, by counts over the whole corpus: the list of the rarest, shifted by its
offset in the phrase, gives candidates; the shifted list of the next rarest keeps those it also has; and so on for all terms,
until none is left. Each phrase start that stays is an exact match. Proximity: the rarest ``NEAR_TERMS`` terms of an item
within ``NEAR_WORDS`` words of a document.

The test set is taken in blocks of at most ``BLOCK_CHARS`` characters, so what is sent to each task has a fixed bound; each
block has its own shards, and hits of several blocks are united by document.

Defined cases: null text has no words; documents without words give a row of zeros; items without words match nothing; items
with equal texts match alike; a document row is matched on its own even if its id repeats; null ids are kept; an empty test
set gives zeros; a word is never cut, a document never split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table, utf8

WINDOW, SHARD_WORDS, BLOCK_CHARS = 10, 1 << 19, 16 << 20
NEAR_TERMS, NEAR_WORDS = 3, 20
#: Places left free between documents of a shard; nothing is looked for over a longer distance.
GAP = 64
#: Bytes that part words become spaces, capitals become small letters. Other bytes (digits, a-z, all over 127) are words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
INDEX_SCHEMA = "place bigint, docs binary, starts binary, sizes binary, keys binary, terms binary, offsets binary, positions binary"


def words_of(data: bytes) -> list[bytes]:
    return data.translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[list[bytes]]:
    """Every run of ``size`` words; of a shorter item itself, of an empty one none."""
    return [words[k : k + size] for k in range(max(1, len(words) - size + 1))] if words else []


def build_index(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Shards (``INDEX_SCHEMA``) of the postings of the terms; numbers are those of ``terms``."""

    def shard(docs_, keys, lists, sizes):
        starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + GAP)[:-1]])
        flat = np.concatenate(lists)
        at = np.flatnonzero(flat >= 0)
        ids = flat[at]
        order = np.argsort(ids, kind="stable")
        found, first = np.unique(ids[order], return_index=True)
        return (
            np.array([d or 0 for d in docs_], "<i8").tobytes(),
            starts.astype("<i4").tobytes(),
            np.array(sizes, "<i4").tobytes(),
            np.array(keys, "<i1").tobytes(),
            found.astype("<i4").tobytes(),
            np.append(first, len(at)).astype("<i4").tobytes(),
            at[order].astype("<i4").tobytes(),
        )

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
        get, gap, place = terms.get, np.full(GAP, -1, np.int32), TaskContext.get().partitionId() << 40
        docs_, keys, lists, sizes, total = [], [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int64())] + [pa.array([c], pa.binary()) for c in shard(docs_, keys, lists, sizes)], names=names)

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(data.as_py())
                lists += [np.array([get(w, -1) for w in words], np.int32), gap]
                docs_.append(doc)
                keys.append(doc is not None)
                sizes.append(len(words))
                total += len(words) + GAP
                if total >= shard_words:
                    yield out()
                    place += len(docs_)
                    docs_, keys, lists, sizes, total = [], [], [], [], 0
        if docs_:
            yield out()

    return stored(docs.select(F.col(id_col).cast("bigint"), utf8(text_col)).mapInArrow(run, INDEX_SCHEMA), "postings")


def term_counts(index: DataFrame) -> dict[int, int]:
    """How often each stored term occurs in the corpus; as many as the block of the test set has terms."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for t, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, "<i4")), pa.array(np.diff(np.frombuffer(o, "<i4")).astype(np.int64))], names=["term", "n"])

    return {r.term: r.n for r in index.select("terms", "offsets").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}


class Shard:
    """Postings of one shard."""

    def __init__(self, terms: bytes, offsets: bytes, positions: bytes):
        self.terms, self.offsets, self.positions = (np.frombuffer(x, "<i4") for x in (terms, offsets, positions))

    def postings(self, term: int) -> np.ndarray:
        k = int(np.searchsorted(self.terms, term))
        if k == len(self.terms) or self.terms[k] != term:
            return self.positions[:0]
        return self.positions[self.offsets[k] : self.offsets[k + 1]]

    def phrase(self, plan: list[tuple[int, int]]) -> np.ndarray:
        """Starts of the phrase; plan: (term, offset) from the rarest term on."""
        starts = None
        for term, offset in plan:
            mine = self.postings(term)
            if starts is None:
                starts = mine - offset
            else:
                at = np.searchsorted(mine, starts + offset)
                starts = starts[mine[np.minimum(at, len(mine) - 1)] == starts + offset] if len(mine) else starts[:0]
            if not len(starts):
                return starts
        return starts

    def near(self, rare: list[int], within: int) -> np.ndarray:
        """Positions of the rarest term that have all the others within so many words."""
        at = self.postings(rare[0])
        for term in rare[1:]:
            other = self.postings(term)
            if not len(at) or not len(other):
                return at[:0]
            k = np.searchsorted(other, at)
            gap = np.minimum(np.abs(other[np.minimum(k, len(other) - 1)] - at), np.abs(at - other[np.maximum(k - 1, 0)]))
            at = at[gap <= within]
        return at


def search_index(index: DataFrame, phrases: list[tuple[list[int], int]], rare: list[tuple[list[int], int]], size_of: dict[int, int], within: int = NEAR_WORDS) -> DataFrame:
    """Per document: ``place, doc_id, n_words, hits, items, near``; the place tells rows of one id apart.

    phrases: (terms, item number), rare: (an item's rarest terms, item number), size_of: corpus counts of terms. ``hits`` has
    the hit words' positions in the document, ``items`` the numbers of items with a phrase, ``near`` of those in proximity.
    """
    plans: dict[tuple, list[int]] = {}
    for terms, item in phrases:
        plans.setdefault(tuple(terms), []).append(item)
    # a phrase with a term that the corpus lacks has no match
    ready = [([(t, o) for _, o, t in sorted((size_of[t], o, t) for o, t in enumerate(terms))], len(terms), items) for terms, items in plans.items() if all(t in size_of for t in terms)]
    rare = [(terms, item) for terms, item in rare if all(t in size_of for t in terms)]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row["terms"], row["offsets"], row["positions"])
                ids, known = np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["keys"], "<i1")
                starts, sizes = np.frombuffer(row["starts"], "<i4"), np.frombuffer(row["sizes"], "<i4")
                end = int(starts[-1]) + int(sizes[-1])
                edge = np.zeros(end + 1, np.int32)
                items: list[set] = [set() for _ in ids]
                near: list[set] = [set() for _ in ids]
                for plan, n, numbers in ready:
                    found = shard.phrase(plan)
                    if len(found):
                        np.add.at(edge, found, 1)
                        np.add.at(edge, found + n, -1)
                        for k in np.unique(np.searchsorted(starts, found, side="right") - 1):
                            items[k].update(numbers)
                for terms, number in rare:
                    found = shard.near(terms, within)
                    for k in np.unique(np.searchsorted(starts, found, side="right") - 1) if len(found) else ():
                        near[k].add(number)
                hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                cut = np.searchsorted(hit, starts)
                per_doc = [(hit[a:z] - s).tolist() for a, z, s in zip(cut, np.append(cut[1:], len(hit)), starts)]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["place"] + np.arange(len(ids))),
                        pa.array(ids, mask=known == 0),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(per_doc, ints),
                        pa.array([sorted(x) for x in items], ints),
                        pa.array([sorted(x) for x in near], ints),
                    ],
                    names=["place", "doc_id", "n_words", "hits", "items", "near"],
                )

    return index.mapInArrow(run, "place bigint, doc_id bigint, n_words bigint, hits array<int>, items array<int>, near array<int>")


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int):
    """The test set in blocks of bounded size, one on the driver at a time."""
    rows, size = [], 0
    for r in items.select(F.col(item_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).orderBy(1, 2).toLocalIterator():
        if rows and size + len(r[1]) > block_chars:
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1].encode()))
        size += len(r[1])
    if rows:
        yield rows


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, proximity: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids`` for every document row, and ``near_ids`` if proximity is asked for.

    The ids are arrays of strings in order. ``n_hit`` counts the words inside a phrase.
    """
    parts = []
    for rows in item_blocks(items, item_col, item_text, block_chars):
        said = [words_of(t) for _, t in rows]
        terms = {w: k for k, w in enumerate(sorted({w for ws in said for w in ws}))}
        index = build_index(docs, terms, id_col, text_col)
        counts = term_counts(index)
        phrases = [([terms[w] for w in win], k) for k, ws in enumerate(said) for win in windows_of(ws, window)]
        rare = [(sorted({terms[w] for w in ws}, key=lambda t: (counts.get(t, 0), t))[:NEAR_TERMS], k) for k, ws in enumerate(said) if ws and proximity]
        names = F.split(F.lit("\x1f".join(i or "" for i, _ in rows)), "\x1f")
        named = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda k: F.element_at(names, k + 1))))  # noqa: B023, E731
        found = search_index(index, phrases, rare, counts)
        parts.append(found.select("place", "doc_id", "n_words", "hits", named("items").alias("item_ids"), named("near").alias("near_ids")))
    if not parts:
        found = search_index(build_index(docs, {}, id_col, text_col), [], [], {})
        parts = [found.select("place", "doc_id", "n_words", "hits", *[F.array().cast("array<string>").alias(c) for c in ("item_ids", "near_ids")])]
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("place", "doc_id", "n_words").agg(union("hits"), union("item_ids"), union("near_ids"))
    return found.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), "item_ids", *["near_ids"] * proximity)


def op9_phrase_index(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[k : k + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT rid, n, k, array_to_string(w[k : k + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)),
hit AS (SELECT rid, item_id, k, dwin.n AS n FROM dwin JOIN win ON dwin.n = win.n AND dwin.s = win.s),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) AS t(p) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.rid = cov.rid LEFT JOIN its ON d.rid = its.rid
"""
