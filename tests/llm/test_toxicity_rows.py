"""The toxicity model learns from all labelled rows, in one shard or several."""

import random

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("shard", [20_000, 2000])
def test_every_labelled_row_is_learnt(spark, monkeypatch, shard):
    from loomgraph.llm import toxicity

    monkeypatch.setattr(toxicity, "SHARD", shard)
    rnd = random.Random(2)
    ids = spark.range(9600).withColumn("h", F.xxhash64("id")).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    order = [r.id for r in ids.orderBy("h").collect()]
    toxic, clean = [i for i in order if i % 2], [i for i in order if i % 2 == 0]
    late = set(toxic[3000:])  # beyond the 3 000 rows a class that a sample would take
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)]
    text = lambda *more: " ".join(rnd.sample([*rnd.choices(vocab, k=8), *more], 8 + len(more)))
    rows = [(i, text("wretch" if i in late else "grobian"), "en") for i in toxic] + [(i, text(), "en") for i in clean]
    new = [(20_000 + k, text(*["wretch", "grobian"][: k % 3][-1:]), "en") for k in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in order], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.createDataFrame(rows + new, "doc_id bigint, text string, lang string"), labels).collect()}
    assert len(late) > 500
    for kind in range(3):
        mine = [got[20_000 + k] == int(kind > 0) for k in range(kind, 300, 3)]
        assert sum(mine) > 0.9 * len(mine), kind
