"""Expectations on small literal graphs and texts."""

import json

import pytest
from pyspark.sql import functions as F

N = "ord bigint, id string, type string, title string, label string, content string, description string, path string, source string, mode string, status string, priority string, raw boolean, code string"


def nodes(spark, *rows):
    """rows: (id, type) and what else."""
    full = []
    for k, (i, t, *more) in enumerate(rows):
        m = dict(more[0]) if more else {}
        full.append((k, i, t, m.get("title", i), m.get("label", i), m.get("content", f"text of {i}"), "", m.get("path"), m.get("source", "user"), m.get("mode", "AUTO"), m.get("status", "active"), m.get("priority", "normal"), m.get("raw", False), m.get("code", "")))
    return spark.createDataFrame(full, N)


def edges(spark, *rows):
    return spark.createDataFrame([(k, a, b, t, m[0] if m else "AUTO", "") for k, (a, b, t, *m) in enumerate(rows)], "ord bigint, source string, target string, type string, mode string, scope string")


def items(spark, *rows):
    return spark.createDataFrame([(k, f, i, None, m[0] if m else "AUTO") for k, (f, i, *m) in enumerate(rows)], "ord bigint, functional string, impl_id string, path string, mode string")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_tokens_and_terms(spark):
    from loomgraph.functions import text as T

    df = spark.createDataFrame([("abcde", 1), ("显存 ab", 2), ("", 3), (None, 4), ("😀", 5)], "t string, k int")
    assert [r[0] for r in df.orderBy("k").select(T.token_estimate(F.col("t"))).collect()] == [2, 3, 0, 0, 1]
    one = spark.createDataFrame([("Fix a_b.c the 显存管理 api",)], "t string").select(*[T.task_terms(F.col("t"), k).alias(k) for k in ("core", "functional", "document")]).first()
    assert one.core == ["fix", "a_b.c", "the", "显存管理", "api"] and one.functional == ["fix", "a_b", "the", "显存管理", "api"]
    assert one.document[-4:] == ["显存", "存管", "管理", "api"]


def test_clauses(spark):
    from loomgraph.operators.knowledge import detect_conflicts, extract_clauses, find_superseded

    rows = [("m1", 1, "user", "播放器必须使用 h264。不能上传日志；修复崩溃"), ("m2", 2, "assistant", "I recommend a queue"), ("m3", 3, "user", "播放器改成 h265"), ("m4", 4, "user", "hello")]
    got = extract_clauses(spark.createDataFrame(rows, "message_id string, ord bigint, role string, text string")).orderBy("message_ord", "idx").collect()
    assert [r.type for r in got] == ["requirement", "constraint", "task", "decision", "requirement", None]
    assert (got[0].subject, got[0].slot, got[0].value, got[0].priority) == ("video", "codec", "h.264", "high")
    assert (got[1].slot, got[1].priority) == ("", "high") or got[1].slot == "prohibition"
    df = spark.createDataFrame([(r.id, r.type, r.subject, r.slot, r.value, r.clause, r.message_ord) for r in got if r.type], "id string, type string, subject string, slot string, value string, clause string, ord bigint")
    known = df.where("ord = 1").select("id", "type", "subject", "slot", F.col("clause").alias("content"), F.lit("active").alias("status"))
    assert find_superseded(df.where("ord = 3"), known).first().supersedes == got[0].id
    both = detect_conflicts(df.withColumns({"content": F.col("clause"), "status": F.lit("active")}), edges(spark)).collect()
    assert [(r.a, r.b, r.reason) for r in both] == [(got[0].id, got[4].id, "codec")]
    said = edges(spark, (got[4].id, got[0].id, "supersedes"))
    assert detect_conflicts(df.withColumns({"content": F.col("clause"), "status": F.lit("active")}), said).isEmpty()


def test_domain_keys(spark):
    from loomgraph.functions.text import domain_key, slug, title_case

    rows = [("a", "src/asr/engine.py", "asr"), ("speaker.speaker.diar", "src/speaker/diar.py", "speaker"), ("x.x.y", "src/x/y.py", "x"), ("pkg.mod", "mod.py", "pkg"), ("solo", "solo.py", "solo"), ("u", "src/net/utils.py", "net"), ("q", None, "q"), ("d", "lib/a/a/b/c.py", "b")]
    df = spark.createDataFrame(rows, "id string, path string, want string").withColumn("got", domain_key(F.col("path"), F.col("id")))
    assert [(r.id, r.got) for r in df.collect() if r.got != r.want] == []
    one = spark.createDataFrame([("user-auth_moduleX",)], "t string").select(title_case(F.col("t")).alias("a"), slug(F.col("t")).alias("b")).first()
    assert (one.a, one.b) == ("USER AUTH ModuleX", "user-auth-modulex")


def test_graph_rules(spark, tmp_path):
    from loomgraph.operators import store
    from loomgraph.sources import graph_store

    n, e = nodes(spark, ("a", "functional"), ("b", "code_module"), ("b", "odd")), edges(spark, ("a", "b", "contains"), ("a", "zz", "likes", "never")).withColumn("scope", F.array())
    codes = {r.code for r in store.validate_graph(n, e, items(spark, ("b", "a"), ("a", "zz"))).collect()}
    assert codes == {"DUPLICATE_ID", "UNSUPPORTED_TYPE", "UNKNOWN_ENDPOINT", "UNSUPPORTED_RELATION", "UNSUPPORTED_MODE", "UNKNOWN_MAPPING_SOURCE", "UNKNOWN_MAPPING_TARGET"}
    doc = {"nodes": [{"id": "f", "type": "functional"}, {"id": "m", "type": "code_module", "mode": "manual"}], "edges": [{"source": "f", "target": "m", "type": "contains", "scope": ["code"]}], "mappings": [{"functional": "f", "implementation": [{"id": "m"}]}], "overrides": {"include": [], "exclude": ["m"], "deleted": []}}
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc))
    graph = graph_store.load_graph_json(spark, str(path))
    assert [r.id for r in graph["nodes"].orderBy("ord").collect()] == ["f", "m"] and graph["overrides"].first().kind == "exclude"
    full = {**graph, "nodes": store.normalize_nodes(graph["nodes"]), "edges": store.normalize_edges(graph["edges"])}
    graph_store.save_graph(full, str(tmp_path / "out"))
    back = graph_store.load_tables(spark, str(tmp_path / "out"))
    assert back["nodes"].where("id = 'm'").first().mode == "MANUAL" and back["mappings"].first().implementation[0].id == "m"
    with pytest.raises(ValueError, match="UNKNOWN_ENDPOINT"):
        graph_store.save_graph({**full, "nodes": full["nodes"].where("id = 'f'"), "mappings": full["mappings"].where("false")}, str(tmp_path / "bad"))
    assert graph_store.load_graph_json(spark, str(tmp_path / "none.json"))["nodes"].isEmpty()
    assert store.free_slots(spark.createDataFrame([(80.0, 80.0), (330.0, 80.0), (860.0, 90.0)], "x double, y double"), 3) == [(600, 80), (80, 260), (340, 260)]
    assert [graph_store.contained(p) for p in ("a/b", "../x", "a/../../x", "/x", "a/../b")] == [True, False, False, False, True]


def test_facts(spark):
    from loomgraph.operators import facts

    shape = "ord bigint, `from` string, from_symbol string, `to` string, type string, symbol string, confidence double, file string"
    f = spark.createDataFrame([(1, "a", "f", "b", "CALL", "b.api", 0.9, "a.py"), (2, "a", "g", "b", "IMPORT", "b", 0.9, "a.py"), (3, "c", "h", "?", "OPTIONAL_DEPENDENCY", "x", 0.42, "c.py"), (4, "c", "h", "a", "CALL", "run", 0.95, "c.py"), (5, "a", "f", "a", "CALL", "self", 1.0, "a.py")], shape)
    assert [r.ord for r in facts.find_callers(f, "api").collect()] == [1]
    assert [r.module for r in facts.related_modules(f, "a").collect()] == ["a", "b", "c"]
    got = {(r["from"], r["to"]): (r.proposed_type, r.confidence, r.reason) for r in facts.propose_edges(f).collect()}
    assert got == {("a", "b"): ("interface", 0.9, "a calls b.api"), ("c", "a"): ("interface", 0.95, "c calls run")}
    e = edges(spark, ("a", "b", "reference"), ("b", "c", "reference"), ("c", "a", "force_exclude"), ("b", "a", "depends_on", "MANUAL"))
    report = facts.check_consistency(f, e)
    assert sorted((r.category, r.source, r.target) for r in report.collect()) == [("conflicts", "c", "a"), ("protected", "b", "a"), ("protected", "c", "a"), ("stale", "b", "c")]
    got = {r.category: (r.n, r.returned) for r in facts.bounded_consistency(report, [], 2).collect()}
    assert got == {"missing": (0, 0), "stale": (1, 1), "protected": (2, 1), "conflicts": (1, 0)}
    after = f.where("ord <> 1")
    assert [(r.change, r.symbol) for r in facts.diff_relationships(f, after, ["a.py"]).collect()] == [("removed", "b.api")]


def test_imports(spark):
    from loomgraph.operators.index import resolve_imports

    known = ids(spark, "pkg.a", "pkg.a.b", "x.util", "y.util", "z.deep.tool")
    rows = [("m", "pkg.a.b.c", "pkg.a.b"), ("m", "pkg.ab", None), ("m", "util", None), ("m", "tool.run", "z.deep.tool"), ("m", "..deep/tool.h", "z.deep.tool"), ("m", "none", None)]
    got = {r.raw: r.target for r in resolve_imports(spark.createDataFrame(rows, "module string, raw string, want string"), known).collect()}
    assert got == {raw: want for _, raw, want in rows}


def test_reconcile(spark):
    from loomgraph.operators import reconcile

    e = edges(spark, ("a", "b", "contains"), ("b", "c", "contains"), ("c", "a", "contains"), ("x", "y", "calls"))
    assert {r.id for r in reconcile.tombstone_closure(e, ids(spark, "b")).collect()} == {"a", "b", "c"}
    n = nodes(spark, ("live", "code_module", {"source": "code"}), ("gone", "code_module", {"source": "code"}), ("hand", "functional"))
    got = {r.id: r.status for r in reconcile.mark_stale(n, ids(spark, "live")).collect()}
    assert got == {"live": "active", "gone": "stale", "hand": "active"}
    n = nodes(spark, ("f", "functional"), ("g", "functional", {"mode": "MANUAL"}), ("i", "interface")).withColumns({"module": F.when(F.col("id") == "i", "m1"), "qualified_id": F.lit(None).cast("string")})
    changed = spark.createDataFrame([("module", "m1"), ("symbol", "s1")], "kind string, id string")
    maps, touched = reconcile.invalidate(n, items(spark, ("f", "m1"), ("g", "s1", "MANUAL"), ("h", "other")), changed)
    assert {(r.functional, r.status) for r in maps.collect()} == {("f", "stale"), ("g", "review_required")}
    assert {(r.id, r.status, r.invalidation) for r in touched.collect()} == {("f", "stale", "stale"), ("g", "active", "review_required"), ("i", "stale", "stale")}


CAND = "request string, ord bigint, label string, content string, node string, node_type string, scope string, status string, priority int, priority_name string, depth int, reason string, required boolean, force_include boolean, raw boolean, raw_kind string"


def cand(k, content, kind="code_module", **m):
    return ("r", k, m.get("label", f"n{k}"), content, m.get("node", f"n{k}"), kind, m.get("scope", "content"), m.get("status", "active"), m.get("priority", 500), "normal", m.get("depth", 1), m.get("reason", "x"), m.get("required", False), m.get("force", False), m.get("raw", False), None)


def test_budget(spark):
    from loomgraph.operators import policy

    rows = [cand(0, "do it", "task", scope="task", required=True), cand(1, "must hold", "requirement"), cand(2, "x" * 400), cand(3, "a note", "note"), cand(4, "must hold", "requirement"), cand(5, "talk", "conversation"), cand(6, "old", "constraint", status="stale"), cand(7, " ")]
    got = {r.ord: r.reason_out for r in policy.select_by_budget(spark.createDataFrame(rows, CAND), 80).collect()}
    assert got == {0: None, 1: None, 2: "single item exceeds policy size limit", 3: None, 4: "duplicate of n1", 5: "raw context disabled by policy", 6: "stale context disabled by policy"}
    big = policy.select_by_budget(spark.createDataFrame([cand(0, "y" * 800, "requirement")], CAND), 20)
    assert big.first().included and {r.code for r in policy.validate_selection(big, 20).collect()} == {"BUDGET_EXCEEDED"}
    allowed = policy.select_by_budget(spark.createDataFrame(rows, CAND), 800, {"conversation": {"enabled": True}})
    assert allowed.where("ord = 5").first().reason_out is None
    leak = policy.validate_selection(allowed, 800, ids(spark, "n1"))
    assert {"FORCE_EXCLUDE_LEAK", "RAW_CONTEXT_LEAK"} <= {r.code for r in leak.collect()}


def brute_fold(rows, budget):
    """The rules of selection, item by item: rows (class, score, priority, ord, tokens, category)."""
    share = {"implementation": 0.55, "tests": 0.15, "documentation": 0.1, "history": 0.05}
    used, use, out = 0, {}, {}
    for c, _, _, o, t, cat in sorted(rows, key=lambda r: (["hard", "soft", "optional"].index(r[0]), -r[1], -r[2], r[3])):
        if c == "hard":
            used += t
            out[o] = True
        else:
            ok = t <= budget * 0.7 and not (cat and use.get(cat, 0) + t > int(budget * share[cat])) and used + t <= budget
            out[o] = ok
            if ok:
                used += t
                use[cat] = use.get(cat, 0) + t
    return out


def test_budget_against_brute_force(spark):
    import random

    from loomgraph.operators import policy

    rnd = random.Random(9)
    kinds = ["code_module", "test", "documentation", "requirement", "decision", "note", "implementation_class"]
    rows = [cand(k, "".join(rnd.choices("abcdefgh ", k=rnd.randrange(1, 900))) + str(k), rnd.choice(kinds), priority=rnd.randrange(1000), depth=rnd.randrange(4)) for k in range(150)]
    got = policy.select_by_budget(spark.createDataFrame(rows, CAND), 3000).collect()
    want = brute_fold([(r.policy_class, r.score, r.priority, r.ord, r.tokens, r.category) for r in got], 3000)
    assert {r.ord: r.included for r in got} == want and sum(want.values()) > 10


def queue_walk(ns, es, maps, entry, limits, out, into):
    """The walk as a queue, from its rules."""
    kind, forward = dict(ns), {"targets", "depends_on", "requires", "uses", "consumes", "produces", "feeds", "transforms", "triggers"}
    impl = lambda x: kind[x] == "code_module" or kind[x].startswith("implementation_")
    out, into, depth, queue = set(out), set(into), {entry: 0}, [entry]
    while queue:
        here = queue.pop(0)
        if here in out or depth.get(here, 9) >= limits["semantic"]:
            continue
        at = depth[here] + 1
        for s, t, k, m in es:
            if k == "derived_from" or here not in (s, t):
                continue
            fw = s == here
            if (k in forward and not fw) or (k in ("dependency", "reference", "calls") and kind[here] == "functional"):
                continue
            nxt = t if fw else s
            if nxt not in kind or nxt in out:
                continue
            if ("interface" in (kind[nxt], k) and at > limits["interface"]) or ((kind[nxt] == "test" or k == "tests") and at > limits["test"]):
                continue
            if kind[nxt] == "task" and nxt != entry:
                continue
            if fw and (m == "FORCE_EXCLUDE" or k == "force_exclude"):
                out.add(nxt)
                into.discard(nxt)
                depth.pop(nxt, None)
                continue
            if fw and (m == "FORCE_INCLUDE" or k == "force_include"):
                into.add(nxt)
                continue
            if kind[here] not in ("task", "functional") and not impl(here):
                continue
            if k == "targets" and kind[here] == "task" and impl(nxt):
                owners = [f for f, i in maps if i == nxt and kind.get(f) == "functional" and f not in out]
                if owners:
                    for f in owners:
                        if f not in depth:
                            depth[f] = at
                            queue.append(f)
                    continue
            if kind[here] == "functional" and impl(nxt):
                continue
            if nxt not in depth:
                depth[nxt] = at
                if kind[nxt] in ("functional", "task") or (k == "targets" and impl(nxt)):
                    queue.append(nxt)
    return depth, out, into


def test_traversal_against_a_queue(spark):
    import random

    from loomgraph.operators.policy import resolve_policy
    from loomgraph.operators.traverse import depth_limits, traverse

    rnd = random.Random(12)
    for _ in range(6):
        ns = [("e", rnd.choice(["task", "functional"]))] + [(f"n{k}", rnd.choice(["functional", "functional", "code_module", "requirement", "interface", "test", "task"])) for k in range(9)]
        names = [n for n, _ in ns]
        es = [(rnd.choice(names), rnd.choice(names), rnd.choice(["depends_on", "contains", "targets", "calls", "interface", "constrains", "force_exclude", "uses", "tests"]), rnd.choice(["AUTO"] * 8 + ["FORCE_EXCLUDE", "FORCE_INCLUDE"])) for _ in range(22)]
        es = [x for x in es if x[0] != x[1]]
        maps = [(rnd.choice(names), rnd.choice(names)) for _ in range(4)]
        limits = depth_limits(ns[0][1] == "task", resolve_policy())
        got, out, into = traverse(nodes(spark, *ns), edges(spark, *es), items(spark, *maps), "e", limits, ids(spark, "n8"), ids(spark))
        depth, gone, kept = queue_walk(ns, es, maps, "e", limits, {"n8"}, set())
        assert {r.id: r.depth for r in got.collect()} == depth, (ns, es, maps)
        assert {r.id for r in out.collect()} == gone and {r.id for r in into.collect()} - gone == kept


def test_compile(spark):
    from loomgraph.operators.traverse import compile_context

    n = nodes(spark, ("t", "task"), ("rec", "functional"), ("enc", "functional"), ("req", "requirement"), ("mod", "code_module", {"code": "def run(): pass", "content": ""}), ("bad", "code_module", {"code": "x"}), ("talk", "conversation", {"raw": True}), ("far", "note"))
    e = edges(spark, ("t", "rec", "targets"), ("rec", "enc", "depends_on"), ("req", "rec", "constrains"), ("rec", "talk", "related_to"))
    got, left = compile_context(n, e, items(spark, ("rec", "mod"), ("rec", "bad", "FORCE_EXCLUDE")), "t", "make the rec run", 2000, ids(spark), ids(spark))
    taken = {r.node: r.reason for r in got.where("included").collect()}
    assert {"t", "rec", "enc", "req", "mod"} == set(taken) and taken["mod"] == "implemented_by rec"
    assert {r.id: r.reason for r in left.collect()} == {"bad": "FORCE_EXCLUDE", "talk": "raw context disabled by policy", "far": "not selected by semantic traversal"}


def test_targets(spark):
    from loomgraph.operators import target

    n = nodes(spark, ("function.asr", "functional", {"title": "ASR"}), ("function.speaker", "functional", {"title": "Speaker"}), ("db", "code_module", {"title": "Database", "path": "src/store/database.py"}), ("db2", "code_module", {"title": "Other", "path": "lib/database.py"}), ("vram", "note", {"title": "显存"}))
    t = spark.createDataFrame([(1, "Improve ASR latency"), (2, "look at database.py please"), (3, "nothing here"), (4, "check src/store/database.py")], "task_id bigint, text string")
    got = {r.task_id: r.target for r in target.infer_target(t, n).collect()}
    assert got == {1: "function.asr", 2: "db", 3: None, 4: "db"} or got[1] == "function.asr" and got[3] is None
    asks = [(1, "do not use ASR and Speaker, but keep Database"), (2, "不要加载显存 和Database"), (3, "don't omit ASR"), (4, "exclude ASRX"), (5, "exclude the db module")]
    found = target.named_exclusions(spark.createDataFrame(asks, "task_id bigint, text string"), target.alias_table(n)).collect()
    assert {(r.task_id, r.id) for r in found} == {(1, "function.asr"), (1, "function.speaker"), (2, "vram"), (2, "db"), (5, "db")}


def test_firewall(spark):
    from loomgraph.operators import firewall

    rows = [(1, 0, "user", "user", None, None, "first"), (1, 1, "assistant", "model", None, None, "hi"), (1, 2, "user", "plugin", "evil", None, "x"), (1, 3, "user", "plugin", "good", "instructions", "i"), (1, 4, "user", "tool", None, None, "r"), (1, 5, "user", "user", None, None, "last"), (1, 6, "user", "plugin", "loom-context", None, "<loom-context>x")]
    m = spark.createDataFrame(rows, "session bigint, pos bigint, role string, kind string, plugin string, form string, text string")
    assert [r.pos for r in firewall.filter_messages(m, ["good"]).orderBy("pos").collect()] == [3, 4, 5]
    codes = {r.code: r.n for r in firewall.audit_request(m, m.where("pos <> 1"), 10**6).collect()}
    assert codes == {"FOREIGN_PLUGIN": 1, "MESSAGE_MISMATCH": 1}
    df = spark.createDataFrame([("## Rules\n\na\n\n## User task\n\ndo\n\n## Code\n\nb", "do"), ("## User task\n\nzz\n\n## Code\n\nb", "")], "c string, t string")
    assert [r[0] for r in df.select(firewall.without_task(F.col("c"), F.col("t"))).collect()] == ["## Rules\n\na\n\n## Code\n\nb", "## Code\n\nb"]


def test_documents(spark):
    from loomgraph.functions.text import table_markdown
    from loomgraph.operators import documents

    rows = [("d", 0, 1, "Intro", 1), ("d", 1, 2, "Setup", 4), ("d", 2, 2, "Use", 9), ("d", 3, 1, "API", 20)]
    o = spark.createDataFrame(rows, "doc_id string, idx int, level int, title string, page_start int")
    got = documents.section_ranges(o, spark.createDataFrame([("d", 80)], "doc_id string, pages int")).orderBy("idx").collect()
    assert [(r.page_end, r.parent_idx) for r in got] == [(19, None), (8, 0), (19, 0), (80, None)]
    assert [r.idx for r in documents.rank_sections(o, "how to setup the api", 2).orderBy("rank").collect()] == [1, 3]
    parts = spark.createDataFrame([("q", k, f"s{k}", "x" * 300) for k in range(3)], "request string, ord bigint, id string, text string")
    assert [(r.taken, r.truncated) for r in documents.bounded_extract(parts, 100).orderBy("ord").collect()] == [(300, False), (100, True)]
    lines = spark.createDataFrame([("d", k, s) for k, s in enumerate(["plain", "def f():", "    x = 1;", "text", "import os"])], "doc_id string, line_no int, line string")
    assert [(r.first_line, r.n_lines) for r in documents.code_islands(lines).collect()] == [(1, 2)]
    t = spark.createDataFrame([([["a", "b|c"], ["1"], [None, " "]],), ([[""]],)], "r array<array<string>>").select(table_markdown(F.col("r")).alias("m")).collect()
    assert t[0].m == "| a | b\\|c |\n| --- | --- |\n| 1 |  |" and t[1].m is None


def test_views(spark):
    from loomgraph.operators import views

    n = nodes(spark, ("pkg", "code_module", {"path": "a.py"}), ("pkg:C", "implementation_class", {"path": "a.py"}), ("pkg:C.f", "implementation_function", {"path": "a.py"}), ("odd", "implementation_symbol", {"path": "b.py"}), ("b", "code_module", {"path": "b.py"}))
    assert {(r.id, r.parent) for r in views.hierarchy_parents(n, edges(spark, ("b", "pkg:C.f", "contains"))).collect()} == {("pkg:C", "pkg"), ("pkg:C.f", "b"), ("odd", "b")}
    n = nodes(spark, ("a", "note"), ("b", "note"), ("c", "note"), ("x", "note"), ("y", "note"))
    got = {r.id: r.level for r in views.layer_levels(n, edges(spark, ("a", "b", "uses"), ("b", "c", "uses"), ("a", "c", "uses"), ("x", "y", "uses"), ("y", "x", "uses"))).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "x": 0, "y": 1}


def test_session():
    from loomgraph.operators import session

    assert session.resolve_settings()["tokenBudget"] == 6000 and session.resolve_settings({"autoInject": False})["autoInject"] is False
    assert session.update_settings({"fingerprint": "x"}, {"tokenBudget": 9000}) == {"tokenBudget": 9000}
    for bad in ({"tokenBudget": 10}, {"semanticDepth": 9}, {"include": [""]}, {"other": 1}):
        with pytest.raises(ValueError):
            session.update_settings({}, bad)


def test_provider(spark):
    from loomgraph.operators import provider

    c = spark.createDataFrame([("r", "a", "symbol", 1000, "A", "x" * 900, True), ("r", "b", "interface", 900, "B", "y" * 40, False), ("r", "c", "symbol", 800, "C", "z" * 900, False), ("r", "d", "file", 500, "D", "w" * 400, False)], "request string, id string, kind string, priority int, label string, content string, exact boolean")
    got = {r.id: (r.taken, r.truncated, r.tokens) for r in provider.fill_budget(c, 100).collect()}
    assert got["a"][:2] == (True, True) and got["b"][:2] == (True, False) and got["c"][0] is False and got["d"][:2] == (True, True) and sum(t for *_, t in got.values()) <= 100
    n = nodes(spark, ("m", "code_module"), ("m:f", "implementation_function"), ("k", "code_module")).withColumns({"module": F.when(F.col("id") == "m:f", "m"), "qualified_id": F.col("id")})
    assert {r.id for r in provider.exclusion_closure(n, edges(spark), ids(spark, "m")).collect()} == {"m", "m:f"}
    assert provider.resolve_target(n, "f").first().id == "m:f" and provider.resolve_target(n, "zz").first().id is None


def test_provider_branches(spark):
    from loomgraph.operators import provider

    symbols = spark.createDataFrame([("m:f", "f", "m", "m", "src/m.py", 1, 5, "def f()"), ("m:g", "g", "m", "m", "src/m.py", 7, 9, "def g()"), ("t:test_f", "test_f", "t", "t", "tests/test_m.py", 1, 3, "def test_f()")], "id string, name string, module string, container string, path string, start_line int, end_line int, signature string")
    modules = spark.createDataFrame([("m", "src/m.py"), ("t", "tests/test_m.py")], "id string, path string")
    rel = spark.createDataFrame([(0, "t", "test_f", "t:test_f", "m", "m:f", "CALL", "m.f"), (1, "m", "f", "m:f", "m", "m:g", "CALL", "g")], "ord bigint, `from` string, from_symbol string, from_symbol_id string, `to` string, to_symbol_id string, type string, symbol string")
    none, terms = ids(spark), F.array(F.lit("zz"))
    got = {r.id: (r.kind, r.priority) for r in provider.symbol_candidates(symbols, rel, modules, "m:f", none).collect()}
    assert got == {"m:f": ("symbol", 1000), "m:g": ("callee", 750)}
    assert [r.id for r in provider.candidate_tests(modules, symbols, rel, "m", ["m:f"], terms, none).collect()] == ["t:test_f"]
    n = nodes(spark, ("fn", "functional"), ("m", "code_module", {"path": "src/m.py"}), ("k", "code_module", {"path": "k.py"}), ("i", "interface"), ("d", "documentation"))
    mapped = {r.id: r.priority for r in provider.mapped_candidates(n, symbols, items(spark, ("fn", "m"), ("fn", "k"), ("fn", "t:test_f")), "fn", F.array(F.lit("g")), none).collect()}
    assert mapped == {"m:f": 900, "m:g": 910, "k": 600, "t:test_f": 1000}
    near = provider.neighbor_candidates(n, edges(spark, ("i", "fn", "interface"), ("fn", "d", "documents")), "fn", {"interface"})
    assert [(r.id, r.priority) for r in near.collect()] == [("i", 970)]
    assert [r.id for r in provider.file_fallback(n, symbols, "k").collect()] == ["k"]
    both = provider.first_branch([near, near.withColumn("priority", F.lit(1))]).collect()
    assert [(r.id, r.priority) for r in both] == [("i", 970)]


def test_module_compile(spark):
    from loomgraph.operators.legacy import compile_module

    n = nodes(spark, ("a", "code_module", {"code": "A code"}), ("b", "code_module"), ("c", "code_module"), ("d", "code_module"))
    memory = spark.createDataFrame([("a", "context", "about a"), ("b", "interface", "b face"), ("b", "state", "b state"), ("c", "interface", "c face"), ("d", "decisions", "d choice")], "module string, scope string, text string")
    got = compile_module(n, edges(spark, ("a", "b", "interface"), ("a", "c", "force_exclude")), memory, "a", "do it", 500, ["d"], [], rules="be good").where("included").orderBy("ord").collect()
    assert [(r.label, r.priority) for r in got] == [("User task", 1000), ("Project rules", 950), ("a source", 920), ("a context", 900), ("b interface", 650), ("d decisions", 780)]
