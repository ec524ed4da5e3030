"""What workers keep beside the data: words, and buffers of column chunks."""

import tracemalloc


def test_hashed_words_are_not_kept():
    import xxhash

    from loomgraph.llm.common import WordHashes

    hashes = WordHashes(bytes.lower)
    assert hashes.of(b"One two  one").tolist() == [xxhash.xxh64_intdigest(w) for w in (b"one", b"two", b"one")] and not len(hashes.of(b" "))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for k in range(20):
        hashes.of(b" ".join(b"word%d" % (5000 * k + i) for i in range(5000)))
    kept = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert kept < 1 << 20


def test_column_chunks_are_not_read_into_buffers_outside_the_heap(spark):
    from loomgraph.llm.common import lean

    lean(spark)
    assert spark._jsparkSession.sessionState().newHadoopConf().get("parquet.hadoop.vectored.io.enabled") == "false"
