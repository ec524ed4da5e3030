"""Facts of small source trees, and streaming snapshots."""

import pytest

from loomgraph.sources import code_facts


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    files = {
        "pkg/__init__.py": "",
        "pkg/base.py": "class Base:\n    def run(self, x: int) -> str:\n        return self.help(x)\n\n    def help(self, x):\n        return str(x)\n",
        "pkg/sub/use.py": "from ..base import Base as B\nimport pkg.base\n\nclass Child(B):\n    @property\n    def go(self):\n        b = B()\n        return b.run(1)\n\nasync def load(name):\n    return getattr(name, 'x')\n",
        "bad.py": "def broken(:\n",
        "c/foo.c": '#include "foo.h"\n// int hidden(void) { }\nstatic int twice(int a, int b) { return a; }\nint foo(void) { return twice(1, 2); }\n',
        "c/foo.h": "int foo(void);\n",
        "c/foo.cpp": "namespace n { class Api : public Base { public: int call(int x) { return x; } }; }\n",
        "node_modules/x.py": "x = 1\n",
        "readme.txt": "no",
    }
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_python_and_c(spark, tree):
    files = code_facts.scan_tree(spark, tree).cache()
    assert {r.path for r in files.collect()} == {"pkg/__init__.py", "pkg/base.py", "pkg/sub/use.py", "bad.py", "c/foo.c", "c/foo.h", "c/foo.cpp"}
    facts = {k: df.cache() for k, df in code_facts.code_facts(files).items()}
    modules = {r.path: r.id for r in facts["modules"].collect()}
    assert modules["pkg/__init__.py"] == "pkg" and modules["pkg/sub/use.py"] == "pkg.sub.use"
    assert len({modules[p] for p in ("c/foo.c", "c/foo.h", "c/foo.cpp")}) == 3
    symbols = {r.id: r for r in facts["symbols"].collect()}
    assert symbols["pkg.base:Base.run"].signature == "def run(self, x: int) -> str" and symbols["pkg.base:Base.run"].kind == "method"
    assert symbols["pkg.sub.use:Child.go"].start_line == 5 and symbols["pkg.sub.use:load"].signature == "async def load(name)"
    assert symbols["pkg.base:Base.run"].container == "pkg.base:Base" and symbols["pkg.base:Base"].container == "pkg.base"
    rel = {(r["from"], r.from_symbol, r["to"], r.type, r.symbol) for r in facts["relationships"].collect()}
    assert ("pkg.sub.use", "Child.go", "pkg.base", "CALL", "Base.run") in rel
    assert ("pkg.sub.use", "load", "?", "OPTIONAL_DEPENDENCY", "getattr") in rel
    assert ("pkg.base", "Base.run", "pkg.base", "CALL", "Base.help") in rel
    assert any(r[3] == "INHERIT" and r[2] == "pkg.base" for r in rel) and any(r[3] == "IMPORT" and r[0] == "pkg.sub.use" and r[2] == "pkg.base" for r in rel)
    assert [r.path for r in facts["errors"].collect()] == ["bad.py"]
    c = modules["c/foo.c"]
    assert f"{c}:twice" in symbols and f"{c}:hidden" not in symbols and symbols[f"{c}:twice"].signature == "static int twice(int a, int b)"
    assert (c, "foo", c, "CALL", "twice") in rel and any(r[0] == c and r[2] == modules["c/foo.h"] and r[3] == "IMPORT" for r in rel)
    assert symbols[f"{modules['c/foo.cpp']}:n.Api.call"].kind == "method"
    one = {r.qualified_id: (r.input, r.output) for r in facts["interfaces"].collect()}
    assert one["pkg.base:Base.run"] == ("self: unknown, x: int", "str") and one[f"{c}:twice"][0] == "a: int, b: int"
    assert code_facts.language_of(facts["modules"]).first().language == "mixed"
    some = code_facts.code_facts(files, files.where("path = 'pkg/base.py'"))
    assert {r.path for r in some["symbols"].collect()} == {"pkg/base.py"}
    light = {r.path: r for r in code_facts.light_scan(files).collect()}
    assert light["pkg/base.py"].functions == ["help", "run"] and light["c/foo.c"].imports == ["foo.h"]


def test_params_and_mask():
    assert code_facts.split_params("const std::map<int, int>& m, int a = f(1, 2), void, ...") == [("m", "const std::map<int, int>&"), ("a", "int")]
    text = 'int a; // x {\n/* { */ char* s = "{";\n#define Z {\n'
    masked = code_facts.mask_c(text)
    assert len(masked) == len(text) and "{" not in masked and masked.count("\n") == text.count("\n")


def test_snapshot_stream(spark, tmp_path):
    from loomgraph.streaming.snapshots import watch_snapshots

    seen = []
    folder, ckpt = str(tmp_path / "in"), str(tmp_path / "ck")
    note = lambda diff, number: seen.append(sorted((r.file, r.change) for r in diff.collect()))
    spark.createDataFrame([("a", "1"), ("b", "1")], "file string, hash string").coalesce(1).write.parquet(folder)
    watch_snapshots(spark, folder, ckpt, note).awaitTermination(60)
    spark.createDataFrame([("a", "2"), ("c", "1")], "file string, hash string").coalesce(1).write.mode("append").parquet(folder)
    watch_snapshots(spark, folder, ckpt, note).awaitTermination(60)
    assert seen == [[("a", "changed"), ("b", "changed")], [("a", "changed"), ("b", "deleted"), ("c", "changed")]]
