"""Turn compile: many sessions in one plan give what each would get alone; codes instead of exceptions."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import traverse, turns

NODES = "id string, type string, title string, label string, path string, content string, description string, priority string, status string, mode string, raw boolean, code string, signature string"
EDGES = "ord bigint, source string, target string, type string, mode string, scope string"
ITEMS = "functional string, impl_id string, path string, mode string, ord int"
MESSAGES = "session string, pos bigint, role string, kind string, text string"
SETTINGS = "session string, target string, tokenBudget int, semanticDepth int, include array<string>, exclude array<string>"


def node(i, kind, status="active", mode="AUTO", **more):
    return (i, kind, more.get("title", f"Title {i}"), more.get("label", i), more.get("path"), more.get("content", f"about {i}"), more.get("description"), more.get("priority", "normal"), status, mode, False, more.get("code"), "")


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [
        node("f.login", "functional"), node("f.store", "functional"), node("f.mail", "functional"), node("f.old", "functional", "stale"),
        node("t.fix", "task", content="Repair the login"), node("t.other", "task"),
        node("m.auth", "code_module", path="src/auth.py", code="def auth(): ..."), node("m.disk", "code_module", path="src/disk.py", code="def disk(): ..."), node("m.cache", "code_module", path="src/cache.py", code="cache"),
        node("s.token", "implementation_function", code="def token(): ..."), node("s.session", "implementation_function", code="def session(): ..."),
        node("r.rule", "requirement", priority="critical"), node("i.api", "interface"), node("x.test", "test"), node("n.hidden", "note", mode="FORCE_EXCLUDE"), node("n.shown", "note", mode="FORCE_INCLUDE"),
        node("a.one", "artifact", label="Twin"), node("a.two", "artifact", label="Twin"),
    ]
    edges = [
        ("t.fix", "f.login", "targets"), ("f.login", "f.store", "depends_on"), ("f.mail", "f.login", "depends_on"), ("f.store", "f.mail", "uses"), ("f.login", "f.old", "uses"), ("f.login", "r.rule", "constrained_by"),
        ("f.store", "i.api", "interface"), ("x.test", "f.login", "tests"), ("f.login", "n.hidden", "related_to"), ("f.store", "m.disk", "force_exclude"), ("m.auth", "s.token", "contains"), ("m.auth", "s.session", "contains"),
        ("f.mail", "m.cache", "force_include"), ("t.other", "m.disk", "targets"), ("r.rule", "f.store", "affects"),
    ]
    items = [("f.login", "m.auth", "src/auth.py", "AUTO", 0), ("f.login", "m.disk", "src/disk.py", "AUTO", 1), ("f.store", "m.disk", "src/disk.py", "AUTO", 2), ("f.mail", "m.cache", "src/cache.py", "FORCE_EXCLUDE", 3)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(k, *e, "AUTO", "") for k, e in enumerate(edges)], EDGES), spark.createDataFrame(items, ITEMS)


SESSIONS = {
    "a": ("look at f.login and the token please", None, []),
    "b": ("work on f.store", None, []),
    "c": ("Repair the login\nnow", "t.fix", []),
    "d": ("f.mail must be quick", None, ["f.store"]),
    "e": ("go on with t.other and disk", "t.other", []),
}


def columns(rows):
    return sorted((r.node, r.label, r.depth, r.reason, r.included, r.reason_out or "", r.policy_class) for r in rows)


def compiled(spark, graph, names=SESSIONS, **more):
    messages = spark.createDataFrame([(s, 1, "user", "user", "first words") for s in names] + [(s, 2, "user", "user", SESSIONS[s][0]) for s in names] + [(s, 3, "user", "tool", "f.login") for s in names], MESSAGES)
    settings = spark.createDataFrame([(s, SESSIONS[s][1], 6000, 3, [], SESSIONS[s][2]) for s in names], SETTINGS)
    return turns.compile_turns(messages, *graph, settings, **more)


def test_sessions_together_are_as_each_alone(spark, graph):
    verdicts, selection, left = compiled(spark, graph)
    assert {r.session: (r.code, r.target) for r in verdicts.collect()} == {"a": (None, "f.login"), "b": (None, "f.store"), "c": (None, "t.fix"), "d": (None, "f.mail"), "e": (None, "t.other")}
    together = selection.collect()
    gone = left.collect()
    for name in "ad":
        _, one, one_left = compiled(spark, graph, [name])
        assert columns(r for r in together if r.request == name) == columns(one.collect()), name
        assert sorted((r.id, r.reason) for r in gone if r.request == name) == sorted((r.id, r.reason) for r in one_left.collect()), name
    by = {name: {r.label: r for r in together if r.request == name} for name in SESSIONS}
    # a: the file gives way to the symbol that the words hit; its sibling symbol stays out
    assert "Title s.token code" in by["a"] and by["a"]["Title s.token code"].reason == "task-relevant symbol in m.auth" and "Title m.auth code" not in by["a"] and "Title s.session code" not in by["a"]
    # b: an edge of the entry excludes its own module
    assert "Title m.disk code" not in by["b"] and ("m.disk", "FORCE_EXCLUDE") in {(r.id, r.reason) for r in gone if r.request == "b"}
    # c: the task's text is in the request already
    assert "Title t.fix (task)" not in by["c"] and by["c"]["Title f.login (functional)"].required
    # d: what the session excludes is neither walked nor selected; the mapping's exclusion beats the edge's inclusion
    assert not {"Title f.store (functional)", "Title i.api (interface)", "Title m.cache code"} & set(by["d"])
    # e: a task that targets code goes to the functions that own it
    assert by["e"]["Title f.login (functional)"].reason == "functional mapping for task target m.disk"
    for name in SESSIONS:
        assert "Title n.shown (note)" in by[name] and "Title n.hidden (note)" not in by[name] and "User task" in by[name]
        assert ("f.old", "stale") in {(r.id, r.reason) for r in gone if r.request == name} or name in "be" or name == "d"


def test_walks_agree_with_single_compile(spark, graph):
    nodes, edges, items = graph
    none = spark.createDataFrame([], "id string")
    _, selection, _ = compiled(spark, graph, ["e"])
    for name, entry in (("e", "t.other"),):
        one, _ = traverse.compile_context(nodes, edges, items, entry, SESSIONS[name][0], 6000, none, none)
        assert {(r.label, r.depth, r.included) for r in selection.where(F.col("request") == name).collect()} - {("User task", 1, True)} == {(r.label, r.depth, r.included) for r in one.collect()} - {("User task", 0, True)}


def test_what_a_session_cannot_get_is_a_row(spark, graph):
    rows = [("x", 1, "user", "user", "hello"), ("y", 1, "user", "user", "Exclude twin and look at f.login"), ("z", 1, "assistant", "user", "f.login"), ("v", 1, "user", "user", "Do not use f.login. Look at f.login")]
    messages = spark.createDataFrame(rows, MESSAGES)
    verdicts, selection, _ = turns.compile_turns(messages, *graph)
    got = {r.session: (r.code, r.fallback, r.aliases, r.options) for r in verdicts.collect()}
    assert got == {"x": (turns.NO_TARGET, True, [], []), "y": (turns.AMBIGUOUS, False, ["twin"], ["a.one", "a.two"]), "v": (turns.NO_TARGET, True, [], [])}
    assert selection.count() == 0
    assert {(r.session, r.code) for r in turns.turn_verdicts(messages, graph[0]).collect()} == {(k, v[0]) for k, v in got.items()}


def test_empty_graph_and_scan(spark, graph):
    messages = spark.createDataFrame([("x", 1, "user", "user", "look at f.store")], MESSAGES)
    empty = [df.where("false") for df in graph]
    verdicts, selection, left = turns.compile_turns(messages, *empty)
    assert [(r.session, r.code, r.fallback) for r in verdicts.collect()] == [("x", turns.EMPTY, True)] and selection.count() == left.count() == 0
    verdicts, selection, _ = turns.compile_turns(messages, *empty, scan=lambda: graph)
    assert [(r.code, r.target) for r in verdicts.collect()] == [(None, "f.store")] and selection.where("node = 'f.store'").count() == 2
    assert turns.compile_turns(messages.where("false"), *graph)[1].count() == 0


def test_budget_and_memory_of_a_session(spark, graph):
    messages = spark.createDataFrame([(s, 1, "user", "user", "look at m.auth " + "words " * 1200) for s in "pq"], MESSAGES)
    settings = spark.createDataFrame([("p", None, 1000, 1, [], []), ("q", None, 9000, 1, ["f.mail"], [])], SETTINGS)
    memory = spark.createDataFrame([("m.auth", "interface", "says auth()"), ("m.auth", "state", "open"), ("m.disk", "state", "no")], "module string, scope string, text string")
    _, selection, _ = turns.compile_turns(messages, *graph, settings, memory=memory, rules="be kind")
    rows = {(r.request, r.label): r for r in selection.collect()}
    assert rows["p", "User task"].included and rows["p", "Title m.auth code"].reason_out == "token budget" and rows["q", "Title m.auth code"].included
    assert rows["q", "Title m.auth interface"].content == "says auth()" and ("q", "Title m.auth state") not in rows and rows["p", "Project rules"].included
    assert rows["q", "Title f.mail (functional)"].reason == "FORCE_INCLUDE" and ("p", "Title f.mail (functional)") not in rows


def test_budget_of_a_provider(spark):
    """The streamed fold against one that renders the text and counts its tokens anew at each step."""
    import math
    import random

    from loomgraph.operators.provider import CUT, fill_budget

    tokens = lambda t: math.ceil(sum(1.0 if ord(c) > 255 else 0.25 for c in t))
    rng = random.Random(3)
    rows = [(f"r{k % 6}", f"c{k:03}", rng.choice(["symbol", "file", "test"]), rng.choice([500, 700, 900]), rng.choice(["A", "B b", "中"]), rng.choice(["x ", "日本", "word  "]) * rng.randrange(1, 300), rng.random() < 0.2) for k in range(90)] + [("alone", "c", "symbol", 1, "L", "y" * 9000, True)]
    got = {(r.request, r.id): (r.taken, r.truncated) for r in fill_budget(spark.createDataFrame(rows, "request string, id string, kind string, priority int, label string, content string, exact boolean"), 400).collect()}
    for request in {r[0] for r in rows}:
        mine, text = sorted((r for r in rows if r[0] == request), key=lambda r: (-r[3], r[1])), ""
        for _, i, kind, _, label, content, exact in mine:
            most = 280 if exact and len(mine) > 1 else 400
            limit, base = min(400, tokens(text) + most), text + ("\n\n" if text else "") + f"## {label}\n\n"
            picked = content if tokens(base + content) <= limit else None
            if picked is None and tokens(base + CUT) <= limit:
                n = max((n for n in range(len(content) + 1) if tokens(base + content[:n] + CUT) <= limit), default=0)
                picked = content[: max(0, min(n, len(content) - 1 - len(CUT)))].rstrip() + CUT
            ok = bool(picked) and (picked == content or exact or kind == "file")
            assert got[request, i] == (ok, ok and picked != content), (request, i)
            text = base + picked if ok else text


def test_sessions_with_the_same_text_are_compiled_once(spark, graph, monkeypatch):
    counted, whole = [], turns.turn_targets
    monkeypatch.setattr(turns, "turn_targets", lambda t, nodes: (counted.append(t.count()), whole(t, nodes))[1])
    said = ["look at m.auth token", "look at f.store", "hello"]
    messages = spark.createDataFrame([(f"s{k}", 1, "user", "user", said[k % 3]) for k in range(9)], MESSAGES)
    verdicts, selection, left = turns.compile_turns(messages, *graph)
    assert counted == [3]
    assert {(r.session, r.target) for r in verdicts.collect()} == {(f"s{k}", ["m.auth", "f.store", None][k % 3]) for k in range(9)}
    of = lambda rows: {k: sorted(str(r[1:]) for r in ([x.request, *[x[c] for c in x.__fields__ if c != "request"]] for x in rows) if r[0] == f"s{k}") for k in range(9)}
    chosen, gone = of(selection.collect()), of(left.collect())
    assert all(chosen[k] == chosen[k % 3] and gone[k] == gone[k % 3] for k in range(9)) and chosen[0] and chosen[1] and chosen[0] != chosen[1] and not chosen[2]
