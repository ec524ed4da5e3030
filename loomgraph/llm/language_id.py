"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a row's language are multiplied: the text's likelihood (hashed byte trigrams, naive Bayes), the
language declared in its markup or metadata, the address suffix (a two-letter top-level domain or first path part), and a
prior of its host. How far a declaration or a suffix is to be trusted is learnt: its likelihood given each language comes from
grouped sums of the rows' text posteriors. Host priors come from the same sums by host, by domain and over all, each level
smoothed by the one above; a row's own posterior is left out of its host's sum. All sums cover all rows; what comes to the
driver is a few numbers a language, a declared language and a two-letter suffix.

The text model is fitted on at most ``SAMPLE`` labelled rows a language (documented bound, in the order of a hash of the id). Of more
than ``LANGUAGES`` labels the most frequent have a model each and all others share one, ``OTHER``; a row that is best explained by
that one has the language that it declares, if that is one of the others, else ``OTHER``. As trigrams of a text depend on each other, the likelihood's weight levels
off after ``FULL`` trigrams.

A row is rejected if its text has no trigram with a letter, if no language has a posterior of ``SURE``, or if the text is much
less likely, under its best language, than any text of the sample.

Defined cases: null and empty texts are rejected, their language is that of the other evidence; a null or unknown declaration
or suffix says nothing; a null host counts as one host; without labels every row is rejected with a null language; repeated
rows and null ids are kept; ties go to the first language by name; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored, table, utf8

SLOTS, SAMPLE, LANGUAGES, FULL, SURE, SLACK = 1 << 15, 500, 128, 100, 0.5, 1.0
OTHER = "other"
HOST_WEIGHT, DOMAIN_WEIGHT, SAID_WEIGHT = 20.0, 50.0, 10.0
#: Bytes that part words become spaces, capitals become small letters. Digits part words too.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def trigrams(data: bytes) -> np.ndarray:
    """Slots of the byte trigrams of a text's words, with a blank at either side of each word."""
    folded = b" ".join(data.translate(FOLD).split())
    if not folded:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(b" " + folded + b" ", np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(15))) & np.uint32(SLOTS - 1)


def train_text(rows: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> dict | None:
    """Log-probabilities ``(SLOTS, languages)`` and, by language, the least mean likelihood seen; rows: ``id, payload, label``."""
    counts = rows.where(F.col("label").isNotNull()).groupBy("label").count().orderBy(F.desc("count"), "label").limit(languages + 1).collect()
    names = sorted({r.label for r in counts} if len(counts) <= languages else {r.label for r in counts[: languages - 1]} | {OTHER})
    if not names:
        return None
    if len(counts) > languages:
        rows = rows.withColumn("label", F.when(F.col("label").isin(names) | F.col("label").isNull(), F.col("label")).otherwise(OTHER))
    picked = None
    for name in names:
        part = rows.where(F.col("label") == name).select("label", "id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    # ids only are sorted; the texts of at most ``sample`` ids a language are fetched by a join
    texts = rows.join(F.broadcast(picked), ["label", "id"], "left_semi")
    seen = sorted((r.label, bytes(r.payload)) for r in texts.select("label", "payload").collect())
    seen = [(name, trigrams(payload)) for name, payload in seen]
    tally = np.full((SLOTS, len(names)), 0.1)
    for name, grams in seen:
        tally[:, names.index(name)] += np.bincount(grams, minlength=SLOTS)
    logp = np.log(tally / tally.sum(0))
    least = np.full(len(names), 0.0)
    for name, grams in seen:
        if len(grams) >= 20:
            k = names.index(name)
            least[k] = min(least[k], logp[grams, k].mean())
    return {"names": names, "merged": len(counts) > languages, "logp": logp.astype(np.float32), "least": least - SLACK}


def _domain(host: Column) -> Column:
    return F.when(host.contains("."), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(F.lit(""))


def address_suffix(url: Column) -> Column:
    """Two letters: the top-level domain, else the first path part, else null."""
    top = F.regexp_extract(url, r"^[^:]*://[^/?#]*\.([A-Za-z]{2})(?::\d+)?(?:[/?#]|$)", 1)
    first = F.regexp_extract(url, r"^[^:]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    return F.lower(F.coalesce(F.nullif(top, F.lit("")), F.nullif(first, F.lit(""))))


def _score(rows: DataFrame, model: dict) -> DataFrame:
    """Adds the discounted text log-likelihoods, the text posteriors, the number of trigrams and whether the text is strange."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        logp, least = shipped.value["logp"], shipped.value["least"]
        for b in sliced(batches):
            like, n, odd = [], [], []
            for x in b.column(4):
                grams = trigrams(x.as_py())
                total = np.zeros(logp.shape[1])
                for lo in range(0, len(grams), 1 << 16):
                    total += logp[grams[lo : lo + (1 << 16)]].sum(0, dtype=np.float64)
                like.append(total / (1 + len(grams) / FULL))
                n.append(len(grams))
                k = int(np.argmax(total))
                odd.append(len(grams) >= 20 and total[k] / len(grams) < least[k])
            like = np.array(like).reshape(len(n), -1)
            post = np.exp(like - like.max(1, keepdims=True)) if len(n) else like
            post = np.round(post / post.sum(1, keepdims=True), 9) if len(n) else post
            cells = pa.list_(pa.float64())
            cols = [*b.columns[:4], pa.array(list(like), cells), pa.array(list(post), cells), pa.array(n, pa.int64()), pa.array(odd, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "declared", "suffix", "host", "like", "post", "n_grams", "odd"])

    kind = "id bigint, declared string, suffix string, host string, like array<double>, post array<double>, n_grams bigint, odd boolean"
    return rows.select("id", "declared", "suffix", "host", "payload").mapInArrow(run, kind)


def _likelihoods(rows: DataFrame, said: str, known: Column, names: list[str]) -> DataFrame:
    """P(said | language) as ``said, given``, from sums of text posteriors of rows with evidence in the text."""
    sums = [F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(len(names))]
    got = rows.where(F.col(said).isNotNull() & known & (F.col("n_grams") > 0)).groupBy(said).agg(*sums).orderBy(said).collect()
    spark = rows.sparkSession
    if not got:
        return spark.createDataFrame([], f"{said} string, given array<double>")
    mass = np.array([[r[f"s{k}"] for k in range(len(names))] for r in got])
    share = mass.sum(1) / mass.sum()
    given = (mass + SAID_WEIGHT * share[:, None]) / (mass.sum(0) + SAID_WEIGHT)
    return spark.createDataFrame([(r[said], [float(x) for x in g]) for r, g in zip(got, given)], f"{said} string, given array<double>")


def identify(df: DataFrame, id_col: str, text_col: str, declared: Column, url: Column | None = None, host: Column | None = None, label: Column | None = None, languages: int = LANGUAGES) -> DataFrame:
    """``id, language, posterior, text_language, n_grams, rejected`` for every row.

    declared: the declared language; url: the address, of which suffix and (unless given) host are taken; label: what the text
    model is fitted on (the declared language unless given).
    """
    url = F.lit(None).cast("string") if url is None else url
    host = F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)) if host is None else host
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.lower(declared.cast("string")).alias("declared"),
        address_suffix(url).alias("suffix"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        utf8(text_col).alias("payload"),
        F.lower((declared if label is None else label).cast("string")).alias("label"),
    )
    model = train_text(rows.select("id", "payload", "label"), languages=languages)
    if model is None:
        none = F.lit(None).cast("string")
        return rows.select("id", none.alias("language"), F.lit(None).cast("double").alias("posterior"), none.alias("text_language"), F.lit(0).cast("bigint").alias("n_grams"), F.lit(True).alias("rejected"))
    names = model["names"]
    scored = stored(_score(rows, model), "evidence").withColumn("domain", _domain(F.col("host")))
    if model["merged"]:
        scored = scored.withColumn("own", F.col("declared")).withColumn("declared", F.when(F.col("own").isin(names) | F.col("own").isNull(), F.col("own")).otherwise(OTHER))
    ks = range(len(names))
    declared_ = _likelihoods(scored, "declared", F.col("declared").isin(names), names).withColumnRenamed("given", "by_declared")
    suffix_ = _likelihoods(scored, "suffix", F.lit(True), names).withColumnRenamed("given", "by_suffix")
    sums = [F.sum(F.when(F.col("n_grams") > 0, F.col("post")[k]).otherwise(0.0)).alias(f"h{k}") for k in ks]
    n = F.sum((F.col("n_grams") > 0).cast("int")).alias("n_host")
    by_host = scored.groupBy("domain", "host").agg(*sums, n)
    by_domain = by_host.groupBy("domain").agg(*[F.sum(f"h{k}").alias(f"d{k}") for k in ks], F.sum("n_host").alias("n_domain"))
    over_all = by_domain.agg(*[F.sum(f"d{k}").alias(f"a{k}") for k in ks], F.sum("n_domain").alias("n_all")).first()
    share = [((over_all[f"a{k}"] or 0.0) + 1) / ((over_all["n_all"] or 0) + len(names)) for k in ks]
    priors = by_host.join(by_domain, "domain")
    priors = priors.select("host", "n_host", *[f"h{k}" for k in ks], *[((F.col(f"d{k}") + DOMAIN_WEIGHT * share[k]) / (F.col("n_domain") + DOMAIN_WEIGHT)).alias(f"p{k}") for k in ks])
    # at most one row a declared language and one a two-letter suffix
    fused = scored.join(priors, "host", "left").join(F.broadcast(declared_), "declared", "left").join(F.broadcast(suffix_), "suffix", "left")
    own = F.when(F.col("n_grams") > 0, 1.0).otherwise(0.0)
    total = []
    for k in ks:
        prior = (F.greatest(F.col(f"h{k}") - own * F.col("post")[k], F.lit(0.0)) + HOST_WEIGHT * F.col(f"p{k}")) / (F.col("n_host") - own + HOST_WEIGHT)
        said = [F.coalesce(F.log(F.col(c)[k]), F.lit(0.0)) for c in ("by_declared", "by_suffix")]
        total.append((F.col("like")[k] + F.log(prior) + said[0] + said[1]).alias(f"t{k}"))
    fused = fused.select("id", "n_grams", "odd", "post", *(["own"] if model["merged"] else []), *total)
    top = F.greatest(*[F.col(f"t{k}") for k in ks]) if len(names) > 1 else F.col("t0")
    fused = fused.withColumn("top", top)
    mass = sum((F.exp(F.col(f"t{k}") - F.col("top")) for k in ks), F.lit(0.0))
    best, text_best = F.lit(names[-1]), F.lit(names[-1])
    for k in reversed(ks):
        best = F.when(F.col(f"t{k}") == F.col("top"), F.lit(names[k])).otherwise(best)
        text_best = F.when(F.col("post")[k] == F.array_max("post"), F.lit(names[k])).otherwise(text_best)
    if model["merged"]:
        best = F.when((best == OTHER) & ~F.coalesce(F.col("own").isin(names), F.lit(True)), F.col("own")).otherwise(best)
    out = fused.select("id", best.alias("language"), F.round(1 / mass, 6).alias("posterior"), F.when(F.col("n_grams") > 0, text_best).alias("text_language"), "n_grams", "odd")
    return out.withColumn("rejected", (F.col("n_grams") == 0) | (F.col("posterior") < SURE) | F.col("odd")).drop("odd")


def identify_pages(pages: DataFrame) -> DataFrame:
    """Web pages: the language declared by the root element, the address, the host, and the text without markup."""
    declared = F.nullif(F.regexp_extract("html", r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return identify(pages.select("page_id", "url", declared.alias("said"), bare.alias("bare")), "page_id", "bare", F.col("said"), F.col("url"))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents: the declared language is ``lang``, the host ``source``."""
    return identify(docs, "doc_id", "text", F.col("lang"), host=F.col("source"))


def op5_language_fusion(spark, sf_dir):
    return identify_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def pages_language(spark, sf_dir):
    return identify_pages(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
