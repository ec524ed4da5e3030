"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling, in numpy.

A word (letters and digits, lower-cased) is hashed to one of ``BUCKETS`` rows of an embedding table, its first ``PREFIX``
letters to one of as many others, and its embedding is the sum of both, so inflected forms share what they have learnt. Filters of ``WIDTHS`` words
slide over the text, each gives its largest value over the whole text, and a logistic layer adds them up. Scoring multiplies
the embeddings with each filter's rows once per worker, so a text costs a few table rows a word, whatever its length.

Training: Adam over all labelled rows whose checksum of the id is no multiple of ``FOLDS``, in shards of some ``SHARD`` rows that
Spark tasks pass over at once; after each round their models are averaged. A fifth of the rows is set aside; by the counts of
all of them, the score is shifted so that 0.5 is the cut of best F1, and one cut a language is found the same way (languages with
few rows take the common one). A score sees the text only: labels, language, source and id are no inputs.

Defined cases: null and empty texts are scored by the bias alone; without labels of both classes every score is 0; repeated rows
and null ids are kept (a null id is held out of nothing); equal texts have equal scores; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored, table, utf8

BUCKETS, PREFIX, DIM, WIDTHS, FILTERS, FOLDS = 1 << 15, 4, 12, (1, 2, 3), 8, 5
#: Rows of a shard, rows that a shard passes over in all rounds (3 rounds at least, 12 at most), embeddings in a block, cells of the grid of scores in one.
SHARD, STEPS, BLOCK, GRID = 20_000, 60_000, 4096, 256
#: Bytes that part words become spaces, capitals become small letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def word_ids(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Rows ``(word's bucket, prefix's bucket)`` of the text's words; ``known`` keeps those seen."""
    import zlib

    words = data.translate(FOLD).split()
    new = {w for w in words if w not in known}
    if new:
        if len(known) > 500_000:
            known.clear()
            new = set(words)
        for w in new:
            prefix = w.decode("utf-8", "replace")[:PREFIX].encode()
            known[w] = zlib.crc32(w) % (BUCKETS - 1) + 1 | BUCKETS + zlib.crc32(prefix) % BUCKETS << 32
    both = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return np.stack([both & 0xFFFFFFFF, both >> 32], axis=1).astype(np.int32)


def _rows(table_: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sums of the two rows of each word."""
    return table_[ids[:, 0]] + table_[ids[:, 1]]


def pooled(ids: np.ndarray, tables: list[list[np.ndarray]], at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For texts laid one after another (row 0 between them), each filter's largest value; and the summed windows."""
    tops, sums = [], []
    for width, rows in zip(WIDTHS, tables):
        n = len(ids) - width + 1
        total = _rows(rows[0], ids[:n])
        for k in range(1, width):
            total += _rows(rows[k], ids[k : n + k])
        sums.append(total)
        tops.append(np.maximum.reduceat(total, at, axis=0))
    return np.concatenate(tops, axis=1), sums


def lay(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts after each other, each behind blanks that no window can bridge, and blanks at the end; where each begins with its blanks."""
    gap = np.zeros((max(WIDTHS) - 1, 2), np.int32)
    parts = [p for t in texts for p in (gap, t)]
    at = np.concatenate([[0], np.cumsum([len(t) + len(gap) for t in texts])[:-1]])
    return np.concatenate([*parts, gap]), at.astype(np.int64)


def tables_of(model: dict) -> list[list[np.ndarray]]:
    return [[(model["E"] @ w[k]).astype(np.float32) for k in range(width)] for width, w in zip(WIDTHS, model["W"])]


def logits(model: dict, tables, texts: list[np.ndarray]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    ids, at = lay(texts)
    top, _ = pooled(ids, tables, at)
    return np.maximum(top + model["b"], 0) @ model["v"] + model["c"]


def start(seed: int = 7) -> dict:
    """A model of random weights; ``S`` holds the embeddings' summed squares of gradients, ``moments`` those of the dense weights."""
    rng = np.random.default_rng(seed)
    model = {
        "E": rng.normal(0, 0.3, (2 * BUCKETS, DIM)).astype(np.float32),
        "S": np.zeros((2 * BUCKETS, DIM), np.float32),
        "W": [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        "b": np.zeros(FILTERS * len(WIDTHS), np.float32),
        "v": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        "c": np.zeros(1, np.float32),
    }
    model["E"][0] = 0
    model["moments"] = [np.zeros_like(x) for x in [*model["W"], model["b"], model["v"]] for _ in (0, 1)]
    return model


def dense(model: dict) -> np.ndarray:
    """All weights but the embeddings, and their moments, as one vector."""
    return np.concatenate([x.ravel() for x in (*model["W"], model["b"], model["v"], model["c"], *model["moments"])]).astype(np.float64)


def with_dense(model: dict, flat: np.ndarray) -> dict:
    """The model with a vector of ``dense`` put back, in arrays of its own."""
    def taken(like):
        nonlocal flat
        x, flat = flat[: like.size].reshape(like.shape).astype(np.float32), flat[like.size :]
        return x

    out = {"E": model["E"].copy(), "S": model["S"].copy(), "W": [taken(w) for w in model["W"]]}
    return out | {k: taken(model[k]) for k in ("b", "v", "c")} | {"moments": [taken(m) for m in model["moments"]]}


def learn(model: dict, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, t: int, touched: np.ndarray, rate: float = 0.01) -> None:
    """A step of Adam (t-th, from 1) on the mean logistic loss of a batch; gradients flow through the window that gave each filter its
    largest value. ``touched`` marks the embeddings that were changed.
    """

    def step(k, value, grad):
        m, s = model["moments"][2 * k : 2 * k + 2]
        m[...] = 0.9 * m + 0.1 * grad
        s[...] = 0.999 * s + 0.001 * grad * grad
        value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)

    ids, at = lay(texts)
    x = _rows(model["E"], ids)
    sums = []
    for width, w in zip(WIDTHS, model["W"]):
        total = x[: len(x) - width + 1] @ w[0]
        for k in range(1, width):
            total += x[k : len(x) - width + 1 + k] @ w[k]
        sums.append(total)
    top = np.concatenate([np.maximum.reduceat(s, at, axis=0) for s in sums], axis=1)
    act = np.maximum(top + model["b"], 0)
    p = 1 / (1 + np.exp(-np.clip(act @ model["v"] + model["c"], -30, 30)))
    g = ((p - labels) * weight / len(texts)).astype(np.float32)
    d_act = np.where(act > 0, np.outer(g, model["v"]), 0).astype(np.float32)
    ends = np.append(at[1:], len(ids))
    dE: dict[int, np.ndarray] = {}
    dW = [np.zeros_like(w) for w in model["W"]]
    for q, (width, w, s) in enumerate(zip(WIDTHS, model["W"], sums)):
        part = d_act[:, q * FILTERS : (q + 1) * FILTERS]
        for i in np.flatnonzero(np.abs(part).sum(1) > 1e-9):
            best = at[i] + np.argmax(s[at[i] : min(ends[i], len(s))], axis=0)
            for k in range(width):
                dW[q][k] += (x[best + k] * part[i][:, None]).T
                back = part[i][:, None] * w[k].T
                for pair, gr in zip(ids[best + k].tolist(), back):
                    for r in pair:
                        if r:
                            dE[r] = dE[r] + gr if r in dE else gr
    for q, grad in enumerate(dW):
        step(q, model["W"][q], grad)
    step(len(WIDTHS), model["b"], d_act.sum(0))
    step(len(WIDTHS) + 1, model["v"], (act * g[:, None]).sum(0))
    model["c"] -= rate * g.sum()
    if dE:
        rows = np.array(sorted(dE))
        grad = np.stack([dE[r] for r in rows.tolist()])
        model["S"][rows] += grad * grad
        model["E"][rows] -= rate * 5 * grad / (np.sqrt(model["S"][rows]) + 1e-8)
        touched[rows] = True


def fit(rows: DataFrame, n: int, weight: tuple[float, float]) -> dict:
    """The model after some rounds over ``shard, y, ids`` (n rows). In a round each shard starts from the common model and passes over
    its rows once; then dense weights are averaged over shards, and each embedding over the shards that changed it.
    """
    model, taken = start(), 0
    for _ in range(min(12, max(3, -(-STEPS // min(n, SHARD))))):
        shipped = rows.sparkSession.sparkContext.broadcast(model)

        def run(batches, shipped=shipped, taken=taken):
            import pyarrow as pa

            base, shard, mine, texts, labels = shipped.value, None, None, [], []

            def pass_on():
                nonlocal texts, labels, t
                if texts:
                    t += 1
                    y = np.array(labels, np.float32)
                    learn(mine, texts, y, np.where(y == 1, weight[1], weight[0]), t, touched)
                    texts, labels = [], []

            def ended():
                pass_on()
                at = np.flatnonzero(touched)
                change = np.concatenate([mine["E"][at] - base["E"][at], mine["S"][at] - base["S"][at]], axis=1)
                blocks = at // BLOCK
                cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(at) else []
                got = [(int(blocks[a]), shard, at[a:z].astype(np.int32).tobytes(), change[a:z].astype(np.float32).tobytes()) for a, z in zip(cuts[:-1], cuts[1:])]
                got.append((-1, shard, np.array([t - taken], np.int32).tobytes(), dense(mine).tobytes()))
                return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*got), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "shard", "at", "change"])

            for b in sliced(batches, 500):
                for s, y, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    if s != shard:
                        if shard is not None:
                            yield ended()
                        shard, t, touched = s, taken, np.zeros(2 * BUCKETS, bool)
                        mine = with_dense(base, dense(base))
                    texts.append(np.frombuffer(ids.as_buffer(), np.int32).reshape(-1, 2))
                    labels.append(y)
                    if len(texts) == 64:
                        pass_on()
            if shard is not None:
                yield ended()

        def merged(batches):
            import pyarrow as pa

            sums: dict[int, list] = {}
            for b in batches:
                for block, at, change in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                    at = np.frombuffer(at.as_buffer(), np.int32)
                    if block < 0:
                        x = np.frombuffer(change.as_buffer(), np.float64)
                        had = sums.setdefault(block, [np.zeros(len(x)), 0, 0])
                        sums[block] = [had[0] + x, had[1] + 1, max(had[2], int(at[0]))]
                    else:
                        total, count, _ = sums.setdefault(block, [np.zeros((BLOCK, 2 * DIM)), np.zeros((BLOCK, 1)), 0])
                        total[at - block * BLOCK] += np.frombuffer(change.as_buffer(), np.float32).reshape(-1, 2 * DIM)
                        count[at - block * BLOCK] += 1
            mean = [(k, steps, (x / np.maximum(n, 1)).astype(np.float64).tobytes()) for k, (x, n, steps) in sums.items()]
            if mean:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*mean), (pa.int32(), pa.int32(), pa.binary()))], names=["block", "steps", "mean"])

        changes = rows.select("shard", "y", "ids").mapInArrow(run, "block int, shard int, at binary, change binary")
        dealt = changes.repartition("block").sortWithinPartitions("block", "shard").select("block", "at", "change")
        got = dealt.mapInArrow(merged, "block int, steps int, mean binary").collect()
        model = with_dense(model, np.frombuffer(next(bytes(r.mean) for r in got if r.block < 0), np.float64))
        for r in got:
            if r.block >= 0:
                x, at = np.frombuffer(bytes(r.mean), np.float64).reshape(BLOCK, 2 * DIM), slice(r.block * BLOCK, (r.block + 1) * BLOCK)
                model["E"][at] += x[:, :DIM].astype(np.float32)
                model["S"][at] += x[:, DIM:].astype(np.float32)
        taken += max(r.steps for r in got)
        shipped.unpersist()
    return model


def best_cut(scores: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The cut between two scores with the best F1."""
    order = np.argsort(-scores, kind="stable")
    hit, all_ = np.cumsum((labels * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (labels * weight).sum())
    last = np.append(np.diff(scores[order]) != 0, True)
    k = int(np.argmax(np.where(last, f1, -1)))
    low = scores[order][k + 1] if k + 1 < len(order) else scores[order][k] - 1
    return float((scores[order][k] + low) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang") -> dict | None:
    """The model with its cuts, from all rows outside the held-out fold, one text (the least) an id; None without both classes."""
    label = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("y"))
    label = label.where(F.crc32(F.col("k").cast("string").cast("binary")) % FOLDS != 0)
    rows = docs.select(F.col(id_col).alias("k"), utf8(text_col).alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")).join(label, "k")
    once = rows.groupBy("k", "y").agg(F.min(F.struct("t", "lang")).alias("r")).select("k", "y", "r.t", "r.lang")

    def numbered(batches):
        import pyarrow as pa

        known: dict[bytes, int] = {}
        for b in sliced(batches):
            ids = [word_ids(x.as_py(), known).tobytes() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1)), pa.array(ids, pa.binary()), b.column(3)], names=["k", "y", "ids", "lang"])

    once = once.select(F.xxhash64("k").alias("k"), F.col("y").cast("int"), "t", "lang").mapInArrow(numbered, "k bigint, y int, ids binary, lang string")
    once = stored(once, "labelled")
    kept = F.pmod("k", F.lit(5)) != 0
    count = {(r.fit, r.y): r.n for r in once.groupBy(kept.alias("fit"), "y").agg(F.count("*").alias("n")).collect()}
    if {y for _, y in count} != {0, 1}:
        return None
    apart = len(count) == 4
    fitted = once.where(kept) if apart else once
    n = [sum(c for (fit_, y), c in count.items() if y == k and (fit_ or not apart)) for k in (0, 1)]
    shards = -(-sum(n) // SHARD)
    dealt = fitted.withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int"))
    dealt = stored(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "k", "y", "ids").select("shard", "y", "ids"), "shards")
    model = fit(dealt, sum(n), (0.5 * sum(n) / n[0], 0.5 * sum(n) / n[1]))
    model = {k: model[k] for k in ("E", "W", "b", "v", "c")}
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        import pyarrow as pa

        tables = tables_of(shipped.value)
        for b in sliced(batches, 128):
            z = logits(shipped.value, tables, [np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2) for x in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(np.clip(z, -30, 30) * GRID).astype(np.int32)), b.column(2)], names=["y", "z", "lang"])

    held = (once.where(~kept) if apart else once).select("y", "ids", "lang").mapInArrow(scored, "y int, z int, lang string")
    # all held rows are counted, on a grid of scores
    cells = held.groupBy("lang", "z", "y").agg(F.count("*").alias("n")).collect()
    score, y, lang, weight = (np.array([r[k] for r in cells]) for k in ("z", "y", "lang", "n"))
    score = score / GRID
    common = best_cut(score, y, weight)
    model["c"] = model["c"] - np.float32(common)
    model["cuts"] = {}
    for code in sorted(set(lang.tolist())):
        k = lang == code
        if min(weight[k][y[k] == 1].sum(), weight[k][y[k] == 0].sum()) >= 30:
            model["cuts"][str(code)] = round(float(1 / (1 + np.exp(-(best_cut(score[k], y[k], weight[k]) - common)))), 9)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, score, predicted, lang_cut, flagged`` for every row; flagged goes by the language's own cut."""
    model = train(docs, labels, id_col, text_col, lang_col=lang_col)
    cuts = model.pop("cuts") if model else {}
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model, known = shipped.value, {}
        tables = tables_of(model) if model else None
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                if model is None:
                    score = np.zeros(part.num_rows)
                else:
                    z = logits(model, tables, [word_ids(x.as_py(), known) for x in part.column(1)])
                    score = np.round(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), 9)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score, pa.float64())], names=["doc_id", "lang", "score"])

    rows = docs.select(F.col(id_col).cast("bigint"), utf8(text_col), F.col(lang_col).cast("string"))
    scored = rows.mapInArrow(run, "doc_id bigint, lang string, score double")
    cut = F.lit(0.5)
    for code, at in sorted(cuts.items()):
        cut = F.when(F.col("lang") == code, F.lit(at)).otherwise(cut)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), cut.alias("lang_cut"), (F.col("score") >= cut).alias("flagged"))


def op8_text_cnn(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
