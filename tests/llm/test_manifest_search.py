"""Merkle manifest, exact top-k and ranked search against brute force, with their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import exact_topk, lexical_rank, merkle

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(leaves):
    """Root and, for each leaf, the siblings on its way."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            proofs[k] += [level[j] for j in range(i - i % 2, min(i - i % 2 + 2, len(level))) if j != i]
        level, at = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)], [i // 2 for i in at]
    return level[0], proofs


def brute_manifest(rows):
    frame = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha(*[frame(x) for x in (r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4])])
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r, leaf(r)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subs[lang] = tree_of([x[1] for x in by_lang[lang]])
    root, above = tree_of([subs[x][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for (r, digest), proof in zip(by_lang[lang], subs[lang][1]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            out.append((r[0], digest, subs[lang][0], root, sha(*proof, *above[k]), not hit))
    return out


def manifest_rows(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in merkle.manifest(df).collect()), key=str)


def make_rows(n):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(["a", "é", None]), rng.choice(["en", "de", "fr", None, ""]), rng.choice([None, 1, 40]), rng.choice([None, "", "wörd " * rng.randrange(9)])) for i in range(n)]
    rows += rows[:2] + [(None, "a", "en", 1, "x"), (None, "a", "en", 2, "x"), (7, "b", "alone", 3, "y" * 300_000)]
    return rows


@pytest.mark.parametrize("n", [0, 1, 13, 150])
def test_manifest_is_brute_force(spark, n):
    rows = make_rows(n)
    assert manifest_rows(spark.createDataFrame(rows, DOCS).repartition(5)) == sorted(brute_manifest(rows), key=str)


def test_manifest_in_rounds(spark, monkeypatch):
    """Blocks of four leaves: many rounds, one key with most rows, the same for any partitioning."""
    monkeypatch.setattr(merkle, "SPAN", 2)
    rows = [(i, "s", "en", 5, "copy") for i in range(300)] + [(i, "s", "de", None, f"t{i}") for i in range(37)]
    want = sorted(brute_manifest(rows), key=str)
    for parts in (1, 7):
        assert manifest_rows(spark.createDataFrame(rows, DOCS).repartition(parts)) == want


def test_fragments_are_a_monoid():
    leaves = [sha(str(i)) for i in range(77)]
    root = tree_of(leaves)[0]
    for seed in range(20):
        rng = random.Random(seed)
        parts = [{} for _ in range(rng.randrange(1, 9))]
        for i, leaf in enumerate(leaves):
            rng.choice(parts)[0, i] = leaf
        while len(parts) > 1:
            rng.shuffle(parts)
            parts = [merkle.merge(parts[0], parts[1], 77), *parts[2:]]
        nodes = merkle.settle(parts[0], 77)
        assert nodes == {(7, 0): root}
    assert merkle.merge({}, {(0, 3): "x"}, 77) == {(0, 3): "x"}


def test_manifest_of_nothing_and_other_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty).count() == 0
    odd = spark.createDataFrame([(1, "s", "en", 5, "t", "x", 1, 2)], DOCS + ", leaf string, at int, tree int")
    assert manifest_rows(odd) == sorted(brute_manifest([(1, "s", "en", 5, "t")]), key=str)


VECS = "vec_id bigint, embedding array<double>"


def brute_top(rows, k=10):
    good = [(i, v, [min(max(math.floor(1024 * x), -(1 << 63)), (1 << 63) - 1) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, a in good:
        if v is None or v % 100:
            continue
        scored = [(min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1), w, j) for j, w, b in good if j != i]
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))
        out += [(v, n + 1, w, s) for n, (s, w, _) in enumerate(scored[:k])]
    return sorted(out, key=str)


def top_rows(df, **more):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_products(df, F.col("vec_id") % 100 == 0, **more).collect()), key=str)


def make_vectors(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]
    hot = [0.25] * dims
    return [(i, hot if i % 3 == 0 else [-x for x in rows[i - 1][1]] if i % 7 == 0 else e) for i, e in rows]


@pytest.mark.parametrize(("lists", "block"), [(2, 1 << 20), (3, 200), (1, 1 << 20)])
def test_top_products_are_brute_force(spark, lists, block):
    """A third of the vectors are equal; several blocks of queries; lists that do not divide the components."""
    rows = make_vectors(700, 8, lists)
    assert top_rows(spark.createDataFrame(rows, VECS).repartition(6), lists=lists, block_bytes=block) == brute_top(rows)


def test_top_products_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5]), (0, [0.5, -0.5]), (100, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, []), (6, [0.5]), (None, [0.5, -0.5]), (200, []), (300, None), (7, [-0.0001, 0.9])]
    df = spark.createDataFrame(rows, VECS)
    assert top_rows(df) == brute_top(rows)
    assert top_rows(df, k=2) == brute_top(rows, 2)
    assert top_rows(df.where("false")) == []
    assert top_rows(df.where("vec_id = 7")) == []
    more = df.withColumns({"row": F.lit(1), "v": F.lit("x"), "score": F.lit(2), "asks": F.lit(False)})
    assert top_rows(more) == brute_top(rows)


def test_top_products_of_large_components(spark):
    """Beyond what doubles hold exactly, and beyond the range of long."""
    rows = [(0, [3e6, 1.0, -2e6]), (100, [1e15, -1e15, 1e15])] + [(i, [1e6 * i, (-1.0) ** i * 1e6 / (i + 1), 7e5 + i]) for i in range(1, 40)] + [(50 + i, [2.0**60, 2.0**60, 1.0 * i]) for i in range(3)]
    assert top_rows(spark.createDataFrame(rows, VECS)) == brute_top(rows)


TERM = re.compile(lexical_rank.PATTERN)


def brute_ranked(docs, items, k=10):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    terms = [Counter(TERM.findall(low(t))) for _, t in docs]
    df, n, total = Counter(t for c in terms for t in c), sum(bool(c) for c in terms), sum(sum(c.values()) for c in terms)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(low(t)))
    out = []
    for i, want in asked.items():
        scored = []
        for r, ((d, _), c) in enumerate(zip(docs, terms)):
            m = 100 - 90 + 90 * sum(c.values()) * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in want if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, r, d))
        out += [(i, k + 1, x[4], -x[0]) for k, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked_rows(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_rank.ranked(lexical_rank.build_postings(d, **more), i).collect()), key=str)


def test_ranked_is_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "The", "ÉTÉ", "été", "naïve", "日本", "x1", "o'neil", "a_b", "\x80y", "K", "K"] + [f"w{i}" for i in range(60)]
    docs = [(i % 190, rng.choice(["", " ", "--"]).join([" ".join(["the", *rng.choices(vocabulary, k=rng.randrange(40))]), rng.choice(["", "!", "ß"])])) for i in range(200)]
    docs += [(900, None), (901, ""), (902, "-- \t"), (None, "w1 w2 w3"), (903, "w5 " * 200_000), (904, "w7"), (905, "w7")]
    items = [(i, " ".join(rng.choices(vocabulary, k=9))) for i in range(25)] + [(25, None), (26, ""), (27, "nowhere"), (3, "w50 w51"), (None, "w7 w7 W7")]
    for more in ({}, {"buckets": 3}):
        assert ranked_rows(spark, docs, items, **more) == brute_ranked(docs, items)


def test_ranked_of_nothing(spark):
    assert ranked_rows(spark, [], [(1, "a")]) == []
    assert ranked_rows(spark, [(1, "a")], []) == []
    assert ranked_rows(spark, [(1, None)], [(1, "a")]) == []


def test_search_reads_the_buckets_of_its_terms(spark):
    docs = spark.createDataFrame([(i, f"w{i} common") for i in range(50)], "doc_id bigint, text string")
    index = lexical_rank.build_postings(docs, buckets=16)
    held = {r.bucket for r in index.read(spark).select("bucket").distinct().collect()}
    assert -1 in held and len(held) > 8
    assert (index.documents, index.terms) == (50, 100)
    assert [(r.rank, r.doc_id) for r in lexical_rank.ranked(index, spark.createDataFrame([(0, "w7")], "item_id bigint, text string")).collect()] == [(1, 7)]
