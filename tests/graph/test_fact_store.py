"""Versioned fact tables: two updates give what one build gives; replays and broken updates change nothing; look-ups read few buckets."""

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import code_facts
from loomgraph.sources.fact_store import FactStore, watch_files

FACT = "files array<string>, ids array<string>, text string"


def facts(spark, rows):
    return spark.createDataFrame(rows, FACT)


def states(spark, **files):
    return spark.createDataFrame(list(files.items()), "file string, hash string")


def rows_of(df):
    return sorted((tuple(r.files), tuple(r.ids), r.text) for r in df.collect())


FIRST = [(["a"], ["A"], "1"), (["a", "b"], ["A", "B"], "2"), (["b"], ["B"], "3"), (["c"], ["C"], "4"), (["c"], ["C"], "4"), (["d", "a"], ["D"], "5")]
SECOND = [(["a"], ["A2"], "6"), (["e", "c"], ["E"], "7")]


@pytest.fixture
def store(spark, tmp_path):
    s = FactStore(spark, str(tmp_path / "store"), 4)
    s.update(1, {"rel": facts(spark, FIRST), "err": facts(spark, [(["b"], [], "bad")])}, states(spark, a="1", b="1", c="1", d="1"), full=True)
    return s


def test_two_updates_are_one_build(spark, store, tmp_path):
    assert rows_of(store.read("rel")) == sorted((tuple(f), tuple(i), t) for f, i, t in FIRST)
    gone = spark.createDataFrame([("b",)], "file string")
    diff = store.update(2, {"rel": facts(spark, SECOND), "err": facts(spark, [])}, states(spark, a="2", e="1", c="1"), gone)
    # the row of d and a belongs to a, which was analysed anew; those of c went with c
    want = sorted((tuple(f), tuple(i), t) for f, i, t in SECOND)
    assert rows_of(store.read("rel")) == want and store.read("err").count() == 0
    assert {(r.file, r.change, tuple(r.ids)) for r in diff.collect()} == {("a", "changed", ("A", "A2", "B", "D")), ("b", "deleted", ("A", "B")), ("e", "changed", ("E",))}
    other = FactStore(spark, str(tmp_path / "other"), 7)
    other.update(5, {"rel": facts(spark, SECOND)}, states(spark, a="2", e="1", c="1", d="1"), full=True)
    assert rows_of(other.read("rel")) == want
    # readers of the version before still see it
    assert rows_of(store.read("rel", version=1)) == sorted((tuple(f), tuple(i), t) for f, i, t in FIRST)


def test_replay_and_broken_update(spark, store):
    change = ({"rel": facts(spark, SECOND)}, states(spark, a="2", e="1", c="1"))
    # an update that stopped before its commit leaves rows that nobody reads
    facts(spark, [(["a"], [], "half")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{store.root}/data/v2/rel")
    assert ("half",) not in {(t,) for _, _, t in rows_of(store.read("rel"))} and store.versions() == [1]
    first = sorted(map(tuple, store.update(2, *change).collect()), key=str)
    got = rows_of(store.read("rel"))
    again = sorted(map(tuple, store.update(2, *change).collect()), key=str)
    assert first == again and rows_of(store.read("rel")) == got and store.versions() == [1, 2] and "half" not in {t for _, _, t in got}


def test_facts_of_a_file_read_its_buckets(spark, tmp_path):
    many = [([f"f{i}", f"f{(i * 7) % 200}"], [f"s{i}"], str(i)) for i in range(200)]
    store = FactStore(spark, str(tmp_path / "many"), 16)
    store.update(1, {"rel": facts(spark, many)}, states(spark, **{f"f{i}": "1" for i in range(200)}), full=True)
    one = store.facts_of("rel", ["f21"])
    assert rows_of(one) == sorted((tuple(f), tuple(i), t) for f, i, t in many if "f21" in f)
    assert 0 < len(one.inputFiles()) <= 4 < len(store.read("rel").inputFiles())
    # an update of one file writes the buckets of its rows only
    store.update(2, {"rel": facts(spark, [(["f21"], ["new"], "x")])}, states(spark, f21="2"))
    assert len({b for (t, b), (w, _) in store.manifest().items() if t == "rel" and w == 2}) <= 4
    assert rows_of(store.facts_of("rel", ["f21"])) == [(("f21",), ("new",), "x")] and store.read("rel").count() == 200 - len([1 for f, _, _ in many if "f21" in f]) + 1


def test_stream_of_changed_files(spark, tmp_path):
    """Source files as they change, parsed and merged; the end is what one build of the last state gives."""
    shape, folder = "file string, hash string, content string", str(tmp_path / "in")

    def analyse(rows):
        found = code_facts.code_facts(rows.select(F.col("file").alias("path"), "content"))["symbols"]
        return {"symbols": found.select(F.array("path").alias("files"), F.array("id").alias("ids"), "signature")}

    def put(mode, *rows):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode(mode).parquet(folder)

    store = FactStore(spark, str(tmp_path / "store"), 4)
    run = lambda: watch_files(spark, folder, shape, store, analyse, str(tmp_path / "ck")).awaitTermination(120)
    put("overwrite", ("a.py", "1", "def one(): pass\n"), ("b.py", "1", "def two(): pass\n"), ("c.py", "1", "def three(): pass\n"))
    run()
    put("append", ("a.py", "2", "def four(x): pass\n"), ("b.py", None, None), ("d.py", "1", "class Five: pass\n"))
    run()
    assert store.versions() == [1, 2]
    assert sorted(r.ids[0] for r in store.read("symbols").collect()) == ["a:four", "c:three", "d:Five"]
    assert sorted((r.files[0], r.hash, tuple(r.ids)) for r in store.read("state").collect()) == [("a.py", "2", ("a:four",)), ("c.py", "1", ("c:three",)), ("d.py", "1", ("d:Five",))]
