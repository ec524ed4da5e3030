"""Names in texts against brute force; what unclear names may mean is counted once for all sessions."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import target, turns


def test_mentions_agree_with_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abİ中é#:. ") for _ in range(n))
    names = sorted({word(n).lower() for n in [1, 2, 3, 7, 8, 9, 10, 15] for _ in range(30)} | {"customer:12", "customer:1", "x" * 300, ""})
    texts = [(k, word(rng.randrange(0, 200)) + rng.choice(["", " Customer:123 ", "x" * 301, rng.choice(names)])) for k in range(60)] + [(98, ""), (99, None)]
    df = spark.createDataFrame(texts, "k int, text string").repartition(3)
    known = spark.createDataFrame([(n,) for n in names] * 2, "alias string")
    got = [(r.k, r.alias) for r in target.mentions(df, known).collect()]
    assert sorted(got) == sorted((k, n) for k, t in texts for n in names if n and n in (t or "").lower())
    assert target.mentions(df, known.where("false")).count() == target.mentions(df.where("false"), known).count() == 0
    # the driver gets a filter of fixed size, and few pieces that are no names go to the join
    assert target._likely(df, known).count() <= len(got) + 5


def test_options_are_counted_once_a_list_of_names(spark):
    nodes = spark.createDataFrame([(k, f"s:{k}", "implementation_symbol", f"S{k}", f"Desk {k % 2}", None) for k in range(40)], "ord int, id string, type string, title string, label string, path string")
    messages = spark.createDataFrame([(s, 1, "user", "user", "Exclude desk 1 and desk 0" if s % 3 == 0 else "Exclude desk 1" if s % 3 == 1 else "look at s:7") for s in range(30)], "session int, pos int, role string, kind string, text string")
    found = turns.turn_verdicts(messages, nodes).select("session", "n_options", F.size("options").alias("n"), "target").collect()
    assert {(r.session % 3, r.n_options, r.n, r.target) for r in found} == {(0, 40, 40, None), (1, 20, 20, None), (2, 0, 0, "s:7")} and len(found) == 30
