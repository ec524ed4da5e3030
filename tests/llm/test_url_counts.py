"""The URL models count all URLs, not a sample of them."""

import numpy as np

from loomgraph.llm import url_filter


def test_models_count_every_url(spark):
    urls = [f"https://h{k}.{s}/p/{k * 7919 % 1000}" for s in ("org/fr", "net") for k in range(5000)]
    models, cut = url_filter.train(spark.createDataFrame([(u,) for u in urls * 2], "url string").repartition(5))
    # every fitted URL of either verdict ends in one mark; about three quarters of the 5 000 are fitted
    ends = [float(m[0][0][int(url_filter._cell(url_filter._context(np.ones(1, np.uint32), 0), np.ones(1, np.uint32))[0])]) for m in models]
    assert all(3600 < n < 3900 for n in ends) and np.isfinite(cut)
