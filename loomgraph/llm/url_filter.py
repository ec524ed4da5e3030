"""URL filter: host and path rules, and for the rest a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, give each URL a log-likelihood a
character; the difference decides by a calibrated threshold. A model interpolates orders 0 to ``ORDER`` after Witten
and Bell: the more different characters followed a context, the more weight goes to the shorter context. Characters are the
lower-cased URL's bytes. Contexts, and contexts with the byte that follows, are hashed into tables of fixed size, so a model's
size has a proven bound (``(ORDER + 1) * (CELLS + 2 * SLOTS)`` numbers) whatever the input.

Training rows are all distinct URLs that a rule decides: counts are added up by Spark, and only the tables come to the driver. A
quarter, by a hash of the URL, calibrates: the threshold is the cut with the best balanced accuracy over all of them, in steps of
``STEP``. What a rule looks at (host suffix, first path part) is masked from half of the training
URLs, so that the models learn the rest of the address too.

Defined cases: null, empty and scheme-less URLs have empty host and path, no rule, and are scored as they are (an empty
URL has ratio 0); equal URLs get equal verdicts; if either class has no training rows the ratio is 0 for all; a ratio at
the threshold allows. Repeated rows and null ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: (verdict, host, path): fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER, SLOTS, CELLS, STEP = 4, 1 << 16, 1 << 18, 1e-4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none fits. Rules of one length go in the given order."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    return rule, verdict


def _context(codes: np.ndarray, order: int) -> np.ndarray:
    """Slot of the ``order`` characters before each position."""
    h = np.full(len(codes), 17 * order, np.uint32)
    for back in range(1, order + 1):
        prev = np.zeros(len(codes), np.uint32)
        prev[back:] = codes[:-back]
        h = h * np.uint32(0x01000193) + prev * np.uint32(0x9E3779B1) + np.uint32(back)
    return (h ^ (h >> np.uint32(15))) & np.uint32(SLOTS - 1)


def _codes(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, each URL after ``ORDER`` blanks and ended by a mark; and each URL's end."""
    parts = [b"\0" * ORDER + u.encode("utf-8", "replace").lower() + b"\x01" for u in urls]
    return np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32), np.cumsum([len(p) for p in parts])


def _cell(slot: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where the count of a byte after a context is."""
    return (((slot.astype(np.uint64) << np.uint64(8)) | codes.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def count_pairs(urls: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: pairs ``slot << 8 | byte`` and how often each occurs."""
    codes, ends = _codes(urls)
    own = np.ones(len(codes), bool)
    for back in range(ORDER):
        own[np.concatenate([[0], ends[:-1]]).astype(int) + back] = False
    return [np.unique(_context(codes, order)[own].astype(np.int64) << 8 | codes[own], return_counts=True) for order in range(ORDER + 1)]


def model_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: counts by context and byte, and each context's total and number of different bytes."""
    model = []
    for pair, n in pairs:
        slot = pair >> 8
        joint = np.bincount(_cell(slot, pair & 255).astype(np.int64), weights=n, minlength=CELLS)
        model.append(tuple(x.astype(np.float32) for x in (joint, np.bincount(slot, weights=n, minlength=SLOTS), np.bincount(slot, minlength=SLOTS))))
    return model


def fit_model(urls: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The model of a list of URLs."""
    return model_of(count_pairs(urls))


def _log_likelihood(model, codes: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
    """Interpolated Witten-Bell log-probability of each code after its context."""
    p = np.full(len(codes), 1 / 256, np.float64)
    for (joint, totals, kinds), slot in zip(model, contexts):
        total, kind = totals[slot], kinds[slot]
        p = np.where(total > 0, (joint[_cell(slot, codes)] + kind * p) / np.maximum(total + kind, 1), p)
    return np.log(p)


def ratios(models, urls: list[str]) -> np.ndarray:
    """Length-normalised log-likelihood difference, accepted less rejected."""
    if not urls or models is None:
        return np.zeros(len(urls))
    codes, ends = _codes(urls)
    contexts = [_context(codes, order) for order in range(ORDER + 1)]
    diff = _log_likelihood(models[0], codes, contexts) - _log_likelihood(models[1], codes, contexts)
    starts = np.concatenate([[0], ends[:-1]]).astype(int)
    for back in range(ORDER):
        diff[starts + back] = 0
    n = ends - starts - ORDER
    out = np.add.reduceat(diff, starts) / n
    return np.where(n > 1, np.round(out, 9), 0.0)


def masked(url: str) -> str:
    """The URL without host suffix and first path part."""
    head, sep, rest = url.partition("://")
    host, slash, path = rest.partition("/")
    return head + sep + host.split(".")[0] + slash + path.partition("/")[2]


def train(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str, str]] = RULES):
    """``(models, threshold)`` from all distinct URLs that a rule decides; ``(None, 0)`` if either verdict has none."""
    host, path = split_url(F.col(url_col))
    said = pages.select(F.col(url_col).alias("u"), match_rule(host, path, rules)[1].alias("v")).where("v IS NOT NULL").distinct()
    rows = stored(said.select("u", (F.col("v") == "block").cast("int").alias("side"), F.pmod(F.xxhash64("u"), F.lit(4)).cast("int").alias("k")), "said")
    has = {(r.side, r.held) for r in rows.select("side", (F.col("k") == 0).alias("held")).distinct().collect()}
    if {side for side, _ in has} != {0, 1}:
        return None, 0.0
    # a side of calibrating URLs only is fitted on those
    fit = rows.where(F.col("k") != 0)
    for side in (0, 1):
        if (side, False) not in has:
            fit = fit.unionByName(rows.where(F.col("side") == side))

    def count(batches):
        import pyarrow as pa

        for b in batches:
            sides, urls = b.column(1).to_numpy(), [masked(u) if k % 2 else u for u, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            for side in (0, 1):
                mine = [u for u, s in zip(urls, sides) if s == side]
                for order, (pair, n) in enumerate(count_pairs(mine) if mine else []):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), 8 * side + order, np.int32)), pa.array(pair.astype(np.int32)), pa.array(n.astype(np.int64))], names=["part", "pair", "n"])

    # at most 256 * SLOTS rows a side and order, whatever the input
    summed = fit.mapInArrow(count, "part int, pair int, n bigint").groupBy("part", "pair").agg(F.sum("n").alias("n")).toArrow()
    part, pair, n = (summed.column(c).to_numpy() for c in ("part", "pair", "n"))
    models = tuple(model_of([(pair[part == 8 * side + order].astype(np.int64), n[part == 8 * side + order]) for order in range(ORDER + 1)]) for side in (0, 1))
    shipped = pages.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.floor(ratios(shipped.value, [masked(u) for u in b.column(0).to_pylist()]) / STEP).astype(np.int64))], names=["side", "step"])

    held = rows.where("k = 0")
    for side in (0, 1):
        if (side, True) not in has:
            held = held.unionByName(rows.where(F.col("side") == side))
    # scores are log-ratios a character: their steps are bounded too
    steps = sorted((r.step, r.a, r.b) for r in held.mapInArrow(score, "side int, step bigint").groupBy("step").agg(F.sum((F.col("side") == 0).cast("bigint")).alias("a"), F.sum((F.col("side") == 1).cast("bigint")).alias("b")).collect())
    at, a, b = (np.array(c, np.float64) for c in zip(*steps))
    below = lambda x: np.concatenate([[0], np.cumsum(x)[:-1]]) / x.sum()
    return models, float(at[int(np.argmax(below(b) - below(a)))] * STEP)


def judge_urls(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``id, host, path, rule, verdict, ratio``: the verdict is the rule's, else the models'."""
    models, threshold = train(pages, url_col, rules)
    shipped = pages.sparkSession.sparkContext.broadcast(models)
    host, path = split_url(F.col(url_col))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), host.alias("host"), path.alias("path"), F.col(url_col).cast("string").alias("url"))

    def score(batches):
        import pyarrow as pa

        for b in batches:
            urls = [u or "" for u in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ratios(shipped.value, urls), pa.float64())], names=["id", "host", "path", "ratio"])

    scored = rows.mapInArrow(score, "id bigint, host string, path string, ratio double")
    said = F.coalesce(verdict, F.when(F.col("ratio") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return scored.select("id", "host", "path", rule.alias("rule"), said.alias("verdict"), "ratio")


def op6_url_lm_ratio(spark, sf_dir):
    from .common import table

    return judge_urls(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
