"""How many words a worker keeps changes no piece."""


def test_packing_is_the_same_for_any_number_of_words_kept(spark):
    from loomgraph.llm.packing import pack_documents, word_bpe_path

    rows = [(k, " ".join(f"word{(k * 31 + j * j) % 900}x" for j in range(200))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    few, many = (sorted(pack_documents(docs, word_bpe_path(), words_kept=n).collect()) for n in (50, 1_000_000))
    assert few == many and len(few) >= len(rows)
