"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints: a 64-bit SimHash of word shingles (``xxh64``, seed 42). Two different fingerprints link at ``RADIUS`` or fewer
differing bits, equal ones always; components of links are classes.

Pigeonhole: of m partitions of the bits with thresholds t (each -1 or more, with sum ``RADIUS - m + 1``), a linked pair differs
in at most t bits in one partition at least. Correlated bits (by the bits' correlation over all distinct fingerprints) go into
one partition. Thresholds are allocated by dynamic programming on estimated candidate counts: exact counts of equal values a
partition, widened for a threshold of 1 by the chance that other bits differ; -1 leaves a useless partition out. The number
of partitions is the one of least cost. A partition with threshold 1 is probed by its value with each bit masked in turn.

Hot buckets: only distinct fingerprints are probed, so copies cost nothing. A bucket of over ``BUCKET`` fingerprints is dealt
anew by the same principle on its remaining bits (three parts, threshold 0 each) until every bucket is small; the remaining bits
shrink by a third each time, so a bucket never has to hold more than a bounded number. A bucket of over ``SMALL`` is linked as
a spanning forest, not as all pairs.

Components: alternating large-star and small-star steps over the links, cut by checkpoints, until nothing changes.

Similar documents: a whole text's SimHash differs in ten bits and more at a similarity of 0.8, for which no partition of 64 bits
is selective. ``similar_documents`` is therefore exact by prefixes: of the hashes of a text's shingles, in an order that puts
hot ones (of many texts) last, so many of the first are tokens that a set as similar has a number of them among its own. Texts
that share so many cold tokens are compared, unless their sizes or the parity bits of their sets exclude the similarity. Texts
whose first tokens reach the hot ones, which is to say that nearly all of them are hot, are compared by hot tokens too, until
those that have one are of one class. No pair of the similarity or more is left out. Classes of ``near_duplicates`` may go before it:
their texts are compared with the class's first one, those as similar are linked, and the search leaves out what is of one class then.

Defined cases: null and empty texts have fingerprint zero and link like others; fewer words than a shingle are one shingle;
rows with equal text or equal ids are rows of their own with one class; the class's name is its smallest non-null id (null if it
has none); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, fresh, per_process, sliced, small_side, stored, table, utf8, word_grams

RADIUS, SHINGLE, BUCKET, SMALL = 2, 3, 4096, 32


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of lower-cased words as an unsigned 64-bit number."""
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    hash_, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    ends = (ends[len(words) - n :] - 1).tolist()
    hashes = np.fromiter((hash_(text[a:z], 42) for a, z in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row; fp is the fingerprint as a signed number."""

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches):
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _text_hash(text_col), utf8(text_col))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("\0"))).alias("text_hash")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bits i and j (64 x 64)."""

    def run(batches):
        import pyarrow as pa

        both, n = np.zeros((64, 64), np.int64), 0
        for b in batches:
            fps = b.column(0).to_numpy().copy()
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        cell = np.append(np.arange(4096), 4096).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(both.ravel(), n))], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(4097, np.int64)
    for r in rows:
        cells[r.cell] = r.n
    return int(cells[4096]), cells[:4096].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each starts at the most correlated free bit and takes what correlates with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        first = max(sorted(free), key=lambda i: corr[i, sorted(free)].sum())
        group = [first]
        free.discard(first)
        while len(group) < width:
            nxt = max(sorted(free), key=lambda i: corr[i, group].sum())
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    """The bits as a mask, a signed 64-bit number."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def allocate(costs: list[dict[int, float]], radius: int = RADIUS) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum ``radius - m + 1``; costs: by partition, the cost of each threshold."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, c in cost.items():
                if total + t not in nxt or spent + c < nxt[total + t][0]:
                    nxt[total + t] = spent + c, [*chosen, t]
        best = nxt
    return best[radius - len(costs) + 1]


def plan(distinct: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions of bits and their thresholds."""
    n, both = bit_statistics(distinct)
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    options = {m: group_bits(n, both, m) for m in (2, 3, 4)}
    masks = [(m, k, mask_of(g)) for m, groups in options.items() for k, g in enumerate(groups)]
    probes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for i, (_, _, mask) in enumerate(masks)])).alias("q")
    sizes = distinct.select(probes).groupBy("q").count()
    pairs = {r.i: r.pairs for r in sizes.groupBy(F.col("q.i").alias("i")).agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    best = None
    for m, groups in options.items():
        costs = []
        for k, g in enumerate(groups):
            equal = pairs.get(next(i for i, x in enumerate(masks) if x[:2] == (m, k)), 0.0)
            wider = equal * (1 + sum((1 - agree[b]) / max(agree[b], 1e-6) for b in g))
            costs.append({-1: 0.0, 0: 4.0 * n + equal, 1: 4.0 * n * len(g) + wider})
        spent, chosen = allocate(costs, radius)
        if best is None or spent < best[0]:
            best = spent, list(zip(groups, chosen))
    return best[1]


def first_keys(distinct: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """``key, rest, fp``: a row per probe; rest is the mask of the bits that the key leaves open."""
    probes = []
    for k, (bits, t) in enumerate(partitions):
        if t < 0:
            continue
        for gone in [None] if t == 0 else bits:
            held = mask_of([b for b in bits if b != gone])
            key = F.xxhash64(F.lit(k), F.lit(-1 if gone is None else gone), F.col("fp").bitwiseAND(F.lit(held)))
            probes.append(F.struct(key.alias("key"), F.lit(~held).alias("rest")))
    return distinct.select(F.explode(F.array(*probes)).alias("q"), "fp").select("q.key", "q.rest", "fp")


def _thirds(level: int) -> list[int]:
    """The 64 bits in three parts, across those of the levels before."""
    place = lambda b: (b * 37 % 64 if level >= 4 else b) // 3 ** (level % 4) % 3
    return [mask_of([b for b in range(64) if place(b) == k]) for k in range(3)]


def candidate_buckets(distinct: DataFrame, partitions: list[tuple[list[int], int]], bucket: int = BUCKET) -> DataFrame:
    """``key, fp`` so that every linked pair shares a key and no key has over ``bucket`` fingerprints (4 at least)."""
    probes, done = first_keys(distinct, partitions), None
    for level in range(8):
        probes = stored(probes, "probes")
        sizes = probes.groupBy("key").count()
        small = probes.join(sizes.where(F.col("count").between(2, bucket)).select("key"), "key", "left_semi").select("key", "fp")
        done = small if done is None else done.unionByName(small)
        hot = stored(sizes.where(F.col("count") > bucket).select("key"), "hot")
        if hot.isEmpty():
            return done
        held = [F.col("rest").bitwiseAND(F.lit(part)) for part in _thirds(level)]
        dealt = [F.struct(F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(h)).alias("key"), F.col("rest").bitwiseAND(F.bitwise_not(h)).alias("rest")) for k, h in enumerate(held)]
        probes = probes.join(hot, "key", "left_semi").select(F.explode(F.array(*dealt)).alias("q"), "fp").select("q.key", "q.rest", "fp")
    return done.unionByName(probes.select("key", "fp"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest over a bucket's fingerprints."""
    free, links = fps, []
    while len(free):
        front, free = [free[0]], free[1:]
        while front and len(free):
            x = front.pop()
            near = _popcount(free ^ x) <= radius
            if near.any():
                links += [(int(x), int(y)) for y in free[near]]
                front += list(free[near])
                free = free[~near]
    return links


def bucket_links(buckets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between fingerprints that share a bucket, verified; linear in the buckets' rows."""

    def linked(keys, fps):
        out_a, out_b = [], []
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(cuts)
        big = sizes > SMALL
        for k in np.flatnonzero(big):
            for a, b in forest(np.unique(fps[cuts[k] : cuts[k + 1]]), radius):
                out_a.append(np.array([a]))
                out_b.append(np.array([b]))
        low = ~np.repeat(big, sizes)
        keys, fps = keys[low], fps[low]
        at, shift = np.arange(len(keys)), 1
        while len(at):
            at = at[at + shift < len(keys)]
            at = at[keys[at] == keys[at + shift]]
            near = at[(_popcount(fps[at] ^ fps[at + shift]) <= radius) & (fps[at] != fps[at + shift])]
            out_a.append(fps[near])
            out_b.append(fps[near + shift])
            shift += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches):
        import pyarrow as pa

        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in _with_end(batches):
            if b is not None:
                held_k = np.concatenate([held_k, b.column(0).to_numpy()])
                held_f = np.concatenate([held_f, b.column(1).to_numpy()])
            if not len(held_k):
                continue
            cut = len(held_k) if b is None else int(np.searchsorted(held_k, held_k[-1]))
            if not cut:
                continue
            x, y = linked(held_k[:cut], held_f[:cut])
            held_k, held_f = held_k[cut:], held_f[cut:]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    dealt = buckets.repartition("key").sortWithinPartitions("key")
    return dealt.select("key", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def _with_end(batches):
    yield from batches
    yield None


def components(links: DataFrame) -> DataFrame:
    """``node, root``: each node of the links with the smallest node of its component, by alternating stars.

    Large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours; small star: the
    same for the smaller neighbours and the node itself. Both keep components; at the end all links point to roots.
    """
    edges = checkpointed(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = edges.join(low, "u").select(F.col("v"), "m").where("m < v").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("m"))
        small = large.withColumnRenamed("m", "x").join(low, "v").select(F.explode(F.array(F.col("v"), F.col("x"))).alias("v"), "m").where("m < v").distinct()
        edges = checkpointed(small.select(F.col("m").alias("u"), "v"))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, text_hash, fp, class_fp, component_id`` for every row; class_fp is one fingerprint for all of a class."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    links = bucket_links(candidate_buckets(distinct.select("fp"), plan(distinct, radius), bucket), radius)
    member = stored(components(stored(links, "links")), "members")
    named = distinct.join(member, distinct.fp == member.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = named.join(roots, "root").select(F.col("fp").alias("fp_"), F.col("root").alias("class_fp"), "component_id")
    return rows.join(classes, rows.fp == classes.fp_).select("doc_id", "text_hash", "fp", "class_fp", "component_id")


def shingle_hashes(data: bytes, shingle: int = 5) -> np.ndarray:
    """The different hashes of a text's word shingles, in order; fewer words are one shingle, no word is the shingle 0."""
    words = per_process("shingle_words", lambda: WordHashes(bytes.lower)).of(data)
    return np.unique(word_grams(words, min(shingle, len(words)))) if len(words) else np.zeros(1, np.uint64)


def needed(n: int, similarity: float) -> int:
    """The least number of a set's n elements that a set as similar has too."""
    return int(np.ceil(similarity * n - 1e-9))


def in_common(n):
    """How many tokens a set of n elements must have in common with one as similar and as large or larger."""
    return 1 + n // 32


def overlap(n, m, similarity: float):
    """How many elements sets of n and m elements have in common at the similarity."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9).astype(np.int64)


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bits: whether the number of hashes dealt to the bit is odd. Two sets' bits differ at most as often as the sets.

    As many bits as hashes (a power of two of words, ``PARITY`` at least); fewer are had by ``fold``.
    """
    n = 64 * PARITY
    while n < len(hashes):
        n *= 2
    bits = np.bincount(hashes.astype(np.int64) & (n - 1), minlength=n) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def fold(odd: np.ndarray, words: int) -> np.ndarray:
    """Parity bits in so many words."""
    return np.bitwise_xor.reduce(odd.reshape(-1, words), axis=0)


PARITY, FEW = 8, 128
#: Tokens (of 8 bytes) up to which a list of them is broadcast.
TOKENS = 1_000_000
_HASH = "text_hash bigint"


def set_table(texts: DataFrame, shingle: int) -> DataFrame:
    """``text_hash, hashes``: all shingle hashes of ``text_hash, t``."""

    def run(batches):
        import pyarrow as pa

        for b in sliced(batches, 100):
            sets = [shingle_hashes(x.as_py(), shingle).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["text_hash", "hashes"])

    return texts.select("text_hash", "t").mapInArrow(run, f"{_HASH}, hashes array<bigint>")


def demoted(texts: DataFrame, read, shingle: int, small: int) -> tuple[DataFrame, DataFrame]:
    """``token``: the hot tokens, of over ``small`` texts; and ``text_hash, hashes, p`` of the texts with too few cold ones in ``prefix``.

    What follows the prefix of the latter is counted too, until no text is added.
    """
    firsts = texts.select("text_hash", "p", F.size("prefix").alias("e"), F.explode("prefix").alias("token"))
    hot = new = stored(firsts.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > small).select("token"), "hot")
    sets, held = None, None
    while not new.isEmpty():
        n = firsts.join(small_side(new, TOKENS), "token", "left_semi").groupBy("text_hash", "p", "e").agg(F.count("*").alias("n"))
        held = n if held is None else held.unionByName(n).groupBy("text_hash", "p", "e").agg(F.sum("n").alias("n"))
        held = stored(held, "held")
        short = held.where("e - n < p").drop("n")
        short = stored(short if sets is None else short.join(sets, "text_hash", "left_anti"), "short")
        if short.isEmpty():
            break
        more = stored(set_table(read(short), shingle).join(short, "text_hash"), "sets")
        sets = more if sets is None else sets.unionByName(more)
        rest = more.select(F.explode(F.expr("slice(hashes, e + 1, size(hashes))")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        new = stored(rest.where(F.col("n") > small).select("token").join(hot, "token", "left_anti"), "hot")
        hot = hot.unionByName(new)
    sets = texts.select("text_hash", F.col("prefix").alias("hashes"), "p").where("false") if sets is None else sets.drop("e")
    return hot, sets


def first_tokens(texts: DataFrame, read, shingle: int, small: int) -> tuple[DataFrame, DataFrame]:
    """``text_hash, size, token, hot`` of the cold tokens among a text's first, and the same of the hot ones.

    The order of tokens puts hot ones last. ``hot`` is the number of a text's hot tokens if its first tokens reach them (so all
    its cold ones are among the first), else 0.
    """
    hot, sets = demoted(texts, read, shingle, small)
    common = sets.select("text_hash", F.explode("hashes").alias("token")).join(small_side(hot, TOKENS), "token", "left_semi")
    common = common.groupBy("text_hash").agg(F.sort_array(F.collect_list("token")).alias("common"))
    own = F.array_except("hashes", "common")
    reach = F.greatest(F.col("p") - F.size("own"), F.lit(0))
    warm = sets.join(common, "text_hash").select("text_hash", F.size("hashes").alias("size"), "p", own.alias("own"), "common")
    warm = stored(warm.select("text_hash", "size", F.when(reach > 0, F.size("common")).otherwise(0).alias("hot"), F.expr("slice(own, 1, p)").alias("own"), F.slice("common", F.lit(1), reach).alias("common")), "warm")
    cold = texts.join(small_side(stored(warm.select("text_hash"), "warm_ids")), "text_hash", "left_anti")
    cold = cold.select("text_hash", "size", F.explode("prefix").alias("token"), F.lit(0).alias("hot")).join(small_side(hot, TOKENS), "token", "left_anti")
    cold = cold.unionByName(warm.select("text_hash", "size", F.explode("own").alias("token"), "hot"))
    return cold, warm.where("hot > 0").select("text_hash", "size", F.explode("common").alias("token"), "hot")


def small_pairs(parts: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all pairs of texts that share cold tokens enough and whose sizes allow the similarity.

    Enough are as many as two texts' first tokens must have in common; where both reach hot tokens, so many as reach the
    similarity if all hot tokens of one are in common.
    """

    def paired(tokens, texts, sizes, hots):
        out_a, out_b, out_n = [], [], []
        at, shift = np.arange(len(tokens)), 1
        while len(at):
            at = at[at + shift < len(tokens)]
            at = at[tokens[at] == tokens[at + shift]]
            x, y = sizes[at], sizes[at + shift]
            near = at[np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9]
            x, y, hot = sizes[near], sizes[near + shift], np.minimum(hots[near], hots[near + shift])
            out_a.append(texts[near])
            out_b.append(texts[near + shift])
            out_n.append(np.where(hot > 0, overlap(x, y, similarity) - hot, in_common(np.minimum(x, y))))
            shift += 1
        a, b, least = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b, out_n))
        order = np.lexsort((np.maximum(a, b), np.minimum(a, b)))
        a, b, least = np.minimum(a, b)[order], np.maximum(a, b)[order], least[order]
        at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
        return a[at], b[at], least[at], np.diff(np.append(at, len(a)))

    def run(batches):
        import pyarrow as pa

        held = [np.zeros(0, np.int64)] * 4
        for b in _with_end(batches):
            if b is not None:
                held = [np.concatenate([h, b.column(k).to_numpy()]) for k, h in enumerate(held)]
            if not len(held[0]):
                continue
            cut = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1]))
            found = paired(*[h[:cut] for h in held])
            held = [h[cut:] for h in held]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b", "least", "n"])

    dealt = parts.select("token", "text_hash", F.col("size").cast("bigint"), F.col("hot").cast("bigint")).repartition("token").sortWithinPartitions("token")
    found = dealt.mapInArrow(run, "a bigint, b bigint, least bigint, n bigint").groupBy("a", "b").agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    return found.where("n >= least").select("a", "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, small: int = SMALL, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_hash, class_fp, component_id`` for every row: classes of texts linked by similarities of 0.8 or more.

    ``known``: rows of ``near_duplicates`` for the same documents, whose links are checked and taken first.
    """

    def sketch(batches):
        import pyarrow as pa

        for b in sliced(batches, 200):
            sizes, firsts, prefixes, odd, low = [], [], [], [], []
            for x in b.column(2):
                h = shingle_hashes(x.as_py(), shingle)
                sizes.append(len(h))
                firsts.append(min(len(h), len(h) - needed(len(h), similarity) + in_common(len(h))))
                prefixes.append(h[: firsts[-1] + firsts[-1] // 8 + 4].view(np.int64))
                odd.append(parity(h))
                low.append(fold(odd[-1], PARITY))
            longs = pa.list_(pa.int64())
            columns = [b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(firsts, pa.int32()), pa.array(prefixes, longs), pa.array(odd, longs), pa.array(low, longs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "size", "p", "prefix", "odd", "low"])

    def verify(batches):
        import pyarrow as pa

        last: dict[int, np.ndarray] = {}
        for b in sliced(batches, 100):
            a, z, ok = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for p, t, u in zip(z, b.column(2), b.column(3)):
                if p not in last:
                    last = {p: shingle_hashes(u.as_py(), shingle)}
                x, y = shingle_hashes(t.as_py(), shingle), last[p]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, y in zip(a, ok) if y], pa.int64()), pa.array([k for k, y in zip(z, ok) if y], pa.int64())], names=["a", "b"])

    def sieve(batches):
        import pyarrow as pa

        for b in sliced(batches):
            ok = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                words = min(len(x), len(y))
                ok.append(_popcount(fold(x, words) ^ fold(y, words)).sum() <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    def read(wanted: DataFrame) -> DataFrame:
        held = docs.select(_text_hash(text_col), utf8(text_col).alias("t")).join(small_side(wanted.select(F.col("text_hash").alias("w"))), F.col("text_hash") == F.col("w"), "left_semi")
        return held.dropDuplicates(["text_hash"]).select("text_hash", "t")

    def verified(pairs: DataFrame) -> DataFrame:
        x, y = (texts.select(F.col("text_hash").alias(c), F.col("size").alias(f"n{c}"), F.col("odd").alias(f"x{c}")) for c in "ab")
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb")
        pairs = stored(pairs.mapInArrow(sieve, "a bigint, b bigint"), "sieved")
        wanted = stored(pairs.select(F.col("a").alias("text_hash")).unionByName(pairs.select(F.col("b").alias("text_hash"))).distinct(), "wanted")
        held = stored(read(wanted), "held")
        both = pairs.join(held.select(F.col("text_hash").alias("a"), "t"), "a").join(held.select(F.col("text_hash").alias("b"), F.col("t").alias("u")), "b")
        return stored(both.select("a", "b", "t", "u").mapInArrow(verify, "a bigint, b bigint"), "similar")

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _text_hash(text_col), utf8(text_col))
    kind = "doc_id bigint, text_hash bigint, size int, p int, prefix array<bigint>, odd array<bigint>, low array<bigint>"
    texts = source.mapInArrow(sketch, kind).groupBy("text_hash")
    texts = stored(texts.agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("size", "p", "prefix", "odd", "low")]), "texts")
    sure = None if known is None else verified(stored(stars(known), "stars"))
    cold, hot = first_tokens(texts, read, shingle, small)
    odd = [F.col("low")[k].alias(f"o{k}") for k in range(PARITY)]
    pairs = stored(small_pairs(cold, similarity), "pairs")
    x = texts.select(F.col("text_hash").alias("a"), "size", *odd)
    y = texts.select(F.col("text_hash").alias("b"), F.col("size").alias("size_"), *[o.alias(f"p{k}") for k, o in enumerate(odd)])
    pairs = stored(pairs.join(x, "a").join(y, "b").where(_may_be(similarity)).select("a", "b"), "pairs")
    links = verified(pairs) if sure is None else sure.unionByName(verified(stored(apart(pairs, sure), "pairs")))
    member = stored(components(links), "members")
    if not hot.isEmpty():
        left = hot.join(texts.select("text_hash", *odd), "text_hash")
        member = hot_members(stored(left, "hot_parts"), links, member, verified, similarity)
    named = texts.join(member, texts.text_hash == member.node, "left").select("text_hash", "least_id", F.coalesce("root", "text_hash").alias("class_fp"))
    classes = named.groupBy("class_fp").agg(F.min("least_id").alias("component_id"))
    found = named.join(classes, "class_fp").select(F.col("text_hash").alias("hash_"), "class_fp", "component_id")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), _text_hash(text_col))
    return rows.join(found, F.col("text_hash") == F.col("hash_")).select("doc_id", "text_hash", "class_fp", "component_id")


def stars(known: DataFrame) -> DataFrame:
    """``a, b``: the first text of each class of ``near_duplicates`` with each of its other texts."""
    texts = known.select("class_fp", "text_hash").distinct()
    first = texts.groupBy("class_fp").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("last")).where("a < last")
    return texts.join(first, "class_fp").where("a < text_hash").select("a", F.col("text_hash").alias("b"))


def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of texts that no link of ``links`` (stars, ``a`` the centre) has made one class."""
    member = stored(links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), "known")
    x, y = (small_side(member).select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    return pairs.join(x, "a", "left").join(y, "b", "left").where("root_a is null or root_b is null or root_a <> root_b").select("a", "b")


def _may_be(similarity: float):
    """Whether sizes and parity bits allow the similarity; sets as similar differ in (1 - s) / (1 + s) of the sum of their sizes at most."""
    differ = sum((F.bit_count(F.col(f"o{k}").bitwiseXOR(F.col(f"p{k}"))) for k in range(PARITY)), F.lit(0))
    far = (1 - similarity) / (1 + similarity) * (F.col("size") + F.col("size_")) + 1e-9
    return (F.least("size", "size_") >= similarity * F.greatest("size", "size_") - 1e-9) & (differ <= far)


def hot_members(left: DataFrame, links: DataFrame, member: DataFrame, verified, similarity: float) -> DataFrame:
    """``node, root``: the components of member joined further by the texts that share hot tokens and no cold first token.

    Such texts have hot tokens only in common, so as many of either as the similarity takes must be hot. In each round some texts
    of each token (all if it has ``FEW``, else that with the largest part of hot tokens, from the second on others by a hash, 64 times as many each
    round) are compared with all others of the token that are not of their class yet, and leave it. A token is done when its
    texts are of one class or none can have a partner, at the latest when all have been compared.
    """
    columns, many, share = left.columns, 1, similarity / (1 + similarity)
    while True:
        now = left.join(small_side(member), F.col("text_hash") == F.col("node"), "left").withColumn("root", F.coalesce("root", "text_hash")).drop("node")
        now = now.withColumn("rank", F.struct(F.round(F.col("hot") / F.col("size"), 3), F.xxhash64("text_hash")))
        sizes = now.groupBy("token").agg(F.min("size").alias("least"))
        now = now.join(small_side(stored(sizes, "hot_sizes")), "token")
        now = stored(now.where(F.col("hot") >= share * (F.col("size") + F.greatest("least", similarity * F.col("size"))) - 1e-9).drop("least"), "hot_now")
        stats = now.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("rank").alias("top"))
        stats = stored(stats.where("lo <> hi").select("token", "n", "top"), "hot_tokens")
        if stats.isEmpty():
            return member
        first = (F.col("n") <= FEW) | (F.col("rank") == F.col("top")) | (F.pmod(F.xxhash64("text_hash", F.lit(many)), "n") < many - 1)
        now = stored(now.join(small_side(stats), "token").withColumn("first", first).select(*columns, "root", "first"), "hot_now")
        x = now.where("first").select("token", F.col("text_hash").alias("b"), F.col("size").alias("size_"), F.col("hot").alias("hot_"), F.col("root").alias("root_"), *[F.col(f"o{k}").alias(f"p{k}") for k in range(PARITY)])
        enough = F.least("hot", "hot_") >= share * (F.col("size") + F.col("size_")) - 1e-9
        both = now.join(small_side(x), (now.token == x.token) & (F.col("root") != F.col("root_")) & enough & _may_be(similarity))
        pairs = stored(both.select(F.least("text_hash", "b").alias("a"), F.greatest("text_hash", "b").alias("b")).distinct(), "pairs")
        left, many = now.where("not first").select(*columns), many * 64
        if not pairs.isEmpty():
            links = links.unionByName(verified(pairs))
            member = stored(components(links), "members")


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every class (of ``near_duplicates`` or ``similar_documents``): that with the smallest id, of several texts
    under that id the one of the smallest hash. A row that is repeated as a whole under that id stays once.
    """
    found = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    each = found.groupBy("class_fp", "doc_id", "text_hash").agg(F.count("*").alias("n")).groupBy("class_fp").agg(F.min(F.struct("text_hash", "doc_id", "n")).alias("r"))
    at, hash_, many = fresh(docs, "kept_id", "kept_hash", "kept_n")
    kept = stored(each.select(F.col("r.doc_id").alias(at), F.col("r.text_hash").alias(hash_), F.col("r.n").alias(many)), "kept")
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(at)) & (_text_hash(text_col) == F.col(hash_))
    once = docs.join(kept.where(F.col(many) == 1), same, "left_semi")
    repeated = kept.where(F.col(many) > 1)
    if repeated.isEmpty():
        return once
    return once.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))


def op4_simhash_pigeonhole(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
