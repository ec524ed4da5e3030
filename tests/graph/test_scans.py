"""Audit, digests, document scans, fields and estimates, degraded parsing, layers with cycles."""

import hashlib
import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text
from loomgraph.operators import audit, digest, documents, views
from loomgraph.sources import code_facts

MESSAGE = "session string, pos bigint, role string, kind string, plugin string, form string, call_id string, content array<struct<type:string,text:string>>"


def canon(x):
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_canonical_json(spark):
    shape = "b struct<z:string,a:array<string>,n:bigint,d:double,t:boolean>, a string"
    rows = [(("x\ny\"\\\t", ["\x01", None, "é 日"], 5, 2.0, True), "q"), ((None, [], None, 0.25, None), None), (("\x1f\x0b/", None, -1, None, False), "")]
    df = spark.createDataFrame(rows, shape)
    got = [r[0] for r in df.select(audit.canonical_json(F.struct("b", "a"), T.StructType(df.schema.fields))).collect()]
    drop = lambda v: {k: (int(x) if isinstance(x, float) and x == int(x) else x) for k, x in v.items() if x is not None}
    want = [canon(drop({"b": drop(dict(zip(("z", "a", "n", "d", "t"), b))), "a": a})) for b, a in rows]
    assert got == want


def message(s, pos, said, kind="user", plugin=None, form=None):
    return (s, pos, "user", kind, plugin, form, None, [("text", said)])


def test_final_audit(spark):
    shown = lambda s, said="<loom-context x>": message(s, 0, said, "plugin", "loom-context")
    expected = [shown(s) for s in "abcdefg"] + [message(s, p, f"{s}{p}") for s in "abcdefg" for p in (1, 2, 3)]
    actual = [m for m in expected if m[0] != "g"]
    swap = {("b", 1): 2, ("b", 2): 1}
    actual = [(m[0], swap.get((m[0], m[1]), m[1]), *m[2:]) for m in actual]
    actual += [message("c", 4, "extra", "plugin", "other"), message("d", 9, "kept", "plugin", "p", "instructions")]
    actual = [shown("e", "<loom-context y>") if m[0] == "e" and m[1] == 0 else m for m in actual]
    requests = spark.createDataFrame([(s, "sys", '[{"n":1}]', 100) for s in "abcdefg"], "session string, system string, tools string, max_tokens int")
    df = lambda rows: spark.createDataFrame(rows, MESSAGE)
    prints = {r.session: r.snapshot_fingerprint for r in audit.fingerprints(df(expected)).where("snapshot").collect()}
    compiled = spark.createDataFrame([(s, prints[s], 10 if s == "f" else 10_000, 50) for s in "abcdef"], "session string, snapshot_fingerprint string, budget int, reserve int")
    headers = requests.where("session <> 'a' and session <> 'g'").withColumn("tools", F.when(F.col("session") == "d", "[]").otherwise(F.col("tools")))
    report, errors = audit.final_audit(df(expected), df(actual), requests, compiled, headers)
    got = sorted((r.session, r.code, r.n, r["at"]) for r in errors.collect())
    assert got == [
        ("a", "HEADER_UNKNOWN", 0, None), ("b", "MESSAGE_MISMATCH", 2, 1), ("c", "FOREIGN_PLUGIN", 1, None), ("c", "MESSAGE_MISMATCH", 1, 4), ("d", "MESSAGE_MISMATCH", 1, 9), ("d", "TOOLS_MISMATCH", 0, None),
        ("e", "MESSAGE_MISMATCH", 1, 0), ("e", "SNAPSHOT_MISMATCH", 0, None), ("f", "BUDGET", 100 + 4 * 6 + 4 + 3 + 1 + 3, None), ("g", "HEADER_UNKNOWN", 0, None), ("g", "MESSAGE_MISMATCH", 4, 0), ("g", "SNAPSHOT_COUNT", 0, None),
    ]
    rows = {r.session: r for r in report.collect()}
    one = [canon({"content": [{"text": f"b{p}", "type": "text"}], "role": "user", "source": {"kind": "user"}}) for p in (2, 1, 3)]
    prints = [hashlib.sha256(canon({"content": [{"text": "<loom-context x>", "type": "text"}], "role": "user", "source": {"kind": "plugin", "plugin": "loom-context"}}).encode()).hexdigest(), *(hashlib.sha256(x.encode()).hexdigest() for x in one)]
    assert rows["b"].messages_fingerprint == hashlib.sha256(canon(prints).encode()).hexdigest()
    payload = {"maxTokens": 100, "messageFingerprints": prints, "systemFingerprint": hashlib.sha256(b"sys").hexdigest(), "toolsFingerprint": hashlib.sha256(b'[{"n":1}]').hexdigest()}
    assert rows["b"].payload_fingerprint == hashlib.sha256(canon(payload).encode()).hexdigest() and not rows["b"].valid


def test_digest(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", None, "é"]), rng.random()) for i in range(400)] + [(7, "copy", 0.5)] * 300
    df = spark.createDataFrame(rows, "id int, a string, b double")
    tree = lambda d: sorted(map(tuple, digest.tree_digests(digest.range_digests(d, ["id"], d.columns, 3), 3).collect()))
    one = tree(df)
    assert one == tree(df.repartition(13, "a")) and one[0][0] == "" and one[0][1] == 700
    ranges = digest.range_digests(df, ["id"], df.columns, 3).cache()
    now = df.where("id <> 5").unionByName(spark.createDataFrame([(1000, "n", 1.0)], df.schema)).withColumn("b", F.when(F.col("id") == 9, 2.0).otherwise(F.col("b")))
    changed = spark.createDataFrame([(5,), (9,), (1000,)], "id int")
    after = sorted(map(tuple, digest.tree_digests(digest.updated_ranges(ranges, now, changed, ["id"], df.columns, 3), 3).collect()))
    assert after == tree(now) and after[0][2] != one[0][2]
    assert len({tuple(x) for x in after} - {tuple(x) for x in one}) <= 3 * 4
    e = spark.createDataFrame([("a", "b", "calls")], "source string, target string, type string")
    m = spark.createDataFrame([("a", "p"), ("b", "q")], "id string, path string")
    first = digest.revision(m, e, m.where("id = 'b'")).first()
    assert first.invalidated == ["b"] and first.revision == digest.revision(m.repartition(3), e, m.where("false")).first().revision != digest.revision(m, e.where("false"), m).first().revision


def test_document_scan(spark):
    node = "id string, title string, label string, content string, description string, source string, created_by string, mode string, file string, hash string, page_start int, page_end int, x double, y double"
    base = "pdf." + hashlib.sha256(b"a.pdf").hexdigest()[:16]
    old = [(f"{base}.section.{k}", f"T{k}", "", f"text {k}", "", "", "ai", mode, "a.pdf", h, a, b, 5.0, None) for k, mode, h, a, b in ((1, "AUTO", "h", 1, 2), (2, "AUTO", "h", 2, 4), (3, "MANUAL", "g", 9, 9), (8, "AUTO", "h", 1, 1), (9, "MANUAL", "h", 1, 1))] + [("n", "N", "", "n", "", "", "user", "AUTO", None, None, None, None, None, None)]
    nodes = spark.createDataFrame(old, node)
    edges = spark.createDataFrame([(base, f"{base}.section.8", "contains", "a.pdf"), ("n", "m", "uses", None)], "source string, target string, type string, file string")
    docs = spark.createDataFrame([("a.pdf", "Doc", 10, "h"), ("b.pdf", "Bare", None, "k")], "file string, title string, pages int, hash string")
    outline = spark.createDataFrame([("a.pdf", 0, 1, "One", 1, 2), ("a.pdf", 1, 2, " ", 3, 4), ("a.pdf", 2, 2, "Three", 5, 99), ("a.pdf", 3, 1, "Four", 50, None)], "file string, idx int, level int, title string, page_start int, page_end int")
    n, e = documents.scan_documents(nodes, edges, docs, outline, "now")
    got = {r.id: r for r in n.collect()}
    section = lambda k: got[f"{base}.section.{k}"]
    assert set(got) == {base, "n", "pdf." + hashlib.sha256(b"b.pdf").hexdigest()[:16], *(f"{base}.section.{k}" for k in (1, 2, 3, 4, 9))}
    assert section(1).content == "text 1" and section(1).x == 5.0 and section(1).y == 210.0 and section(2).content == "" and section(2).title == "Section 2"
    assert section(3).content == "text 3" and section(3).mode == "MANUAL" and section(3).created_by == "ai" and (section(3).page_start, section(3).page_end) == (5, 10)
    assert (section(4).page_start, section(4).page_end) == (10, 10) and section(9).title == "T9" and got[base].content.endswith("Outline sections: 4")
    links = {(r.source, r.target) for r in e.collect()}
    assert links == {("n", "m"), (base, f"{base}.section.1"), (f"{base}.section.1", f"{base}.section.2"), (f"{base}.section.1", f"{base}.section.3"), (base, f"{base}.section.4")}


def test_fields_and_sizes(spark, tmp_path):
    rows = [("s", None, "", '{"slot":"m","value":7}', "Disk must use raid"), (None, None, None, None, None), ("", "", "", "[1]", "H264 it is")]
    df = spark.createDataFrame(rows, "subject string, slot string, value string, metadata string, content string")
    got = [tuple(r) for r in df.select(*text.node_semantic_fields(*map(F.col, df.columns))).collect()]
    assert got == [("s", "m", "7"), ("", "", ""), ("video", "codec", "h.264")]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x" * 10)
    sizes = code_facts.file_sizes(spark, str(tmp_path))
    assert [tuple(r) for r in sizes.collect()] == [("src/a.py", 10)]
    assert "content" not in sizes._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_degraded_files(spark):
    files = [("ok.py", "import bad\ndef fine(): pass\n"), ("bad.py", "import ok\nclass Broken:\n  def half(self:\n")]
    facts = code_facts.code_facts(spark.createDataFrame(files, "path string, content string"))
    assert [r.file for r in facts["errors"].collect()] == ["bad.py"]
    assert {"ok:fine", "bad:half", "bad:Broken"} <= {r.id for r in facts["symbols"].collect()}
    assert {("ok", "bad"), ("bad", "ok")} <= {(r["from"], r["to"]) for r in facts["relationships"].where("type = 'IMPORT'").collect()}


def queue_levels(n, edges):
    into, out = {b for _, b in edges}, {i: [] for i in range(n)}
    for a, b in edges:
        out[a].append(b)
    levels, queue = {}, []
    seeds = [i for i in range(n) if i not in into]
    while True:
        for i in seeds:
            levels[i] = 0
            queue.append(i)
        while queue:
            i = queue.pop(0)
            for t in out[i]:
                if t not in levels:
                    levels[t] = levels[i] + 1
                    queue.append(t)
        seeds = [i for i in range(n) if i not in levels][:1]
        if not seeds:
            return levels


def test_layers_with_cycles(spark):
    rng = random.Random(4)
    cycles = list(range(9000))
    rng.shuffle(cycles)
    for n, edges in ((40, [(rng.randrange(40), rng.randrange(40)) for _ in range(46)]), (9000, [(cycles[i], cycles[i // 3 * 3 + (i + 1) % 3]) for i in range(9000)])):
        nodes = spark.createDataFrame([(i, str(i)) for i in range(n)], "ord int, id string")
        got = views.layer_levels(nodes, spark.createDataFrame([(str(a), str(b)) for a, b in edges], "source string, target string")).collect()
        assert {int(r.id): r.level for r in got} == queue_levels(n, edges)


def queue_layout(rows):
    placed, out = [], []
    over = lambda x, y: any(abs(x - u) < 220 and abs(y - v) < 140 for u, v in placed)
    for i, x, y in rows:
        moved = x is None or y is None or x != x or over(x, y)
        if moved:
            x, y = next(((80.0 + k % 4 * 260, 80.0 + k // 4 * 180) for k in range(10_000) if not over(80 + k % 4 * 260, 80 + k // 4 * 180)), (80.0, 80.0 + len(placed) * 180))
        placed.append((x, y))
        out.append((i, x, y, moved))
    return out


def test_layout_repair(spark):
    from loomgraph.operators.layout import repair_layout

    rng = random.Random(6)
    cells = [(80.0 + k % 4 * 260, 80.0 + k // 4 * 180) for k in range(200)]
    graphs = {
        "overlaps": [(rng.uniform(-500, 3000), rng.uniform(-900, 30_000)) for _ in range(600)],
        "grid": [cells[k] if k != 3 else (None, None) for k in range(120)],
        "none": [(None, 5.0), (float("nan"), 1.0), (-0.5, -0.5), (-219.0, 0.0), (1e9, -1e9)],
        "same": [(80.0, 80.0)] * 40,
    }
    rows = [(g, k, f"{g}{k}", *at) for g, places in graphs.items() for k, at in enumerate(places)]
    df = spark.createDataFrame(rows, "project string, ord int, id string, x double, y double").repartition(7)
    got = {(r.project, r.id): (r.x, r.y, r.moved) for r in repair_layout(df).collect()}
    for g, places in graphs.items():
        assert {f"{g}{k}": got[g, f"{g}{k}"] for k in range(len(places))} == {i: (x, y, m) for i, x, y, m in queue_layout([(f"{g}{k}", *at) for k, at in enumerate(places)])}
