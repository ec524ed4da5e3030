"""Language fusion, line templates, passages, toxicity and the pipeline."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_base import AWKWARD, SCHEMA, SF


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(9000 + (r[0] or 0), *r[1:]) for r in AWKWARD], SCHEMA)).withColumn("score", __import__("pyspark").sql.functions.lit("clash")).cache()


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_language(spark, docs):
    from loomgraph.llm.language_id import identify, identify_documents

    got = {r.id: r for r in identify_documents(docs).collect()}
    truth = {r.doc_id: (r.lang, len(words_of(r.text))) for r in docs.collect()}
    long = [d for d, (lang, n) in truth.items() if n > 30 and d < 9000]
    assert sum(got[d].text_language == truth[d][0] for d in long) > 0.97 * len(long)
    assert not any(got[d].rejected for d in long)
    assert all(got[d].rejected for d, (_, n) in truth.items() if n == 0)
    assert len(got) == len(truth)
    assert identify_documents(docs.where("false")).count() == 0
    none = identify(docs, "doc_id", "text", F.lit(None)).collect()
    assert len(none) == docs.count() and all(r.rejected and r.language is None for r in none)


def test_language_evidence(spark):
    """Where the text says nothing, the host's other pages, the declaration and the suffix decide."""
    from loomgraph.llm.language_id import address_suffix, identify

    rnd = random.Random(1)
    say = {"aa": "alpha beta gamma delta epsilon zeta".split(), "bb": "uno dos tres cuatro cinco seis siete".split()}
    rows = []
    for k in range(200):
        lang = "aa" if k % 2 else "bb"
        rows.append((k, f"http://h{k % 4}.site{lang}.com/{lang}/x", " ".join(rnd.choices(say[lang], k=40)), lang))
    rows += [(900, "http://h1.siteaa.com/q", "", None), (901, "http://h0.sitebb.com/q", "12 34", None), (902, "http://new.org/bb/1", "", None), (903, "http://new2.org/", "", "aa"), (904, None, None, "zz")]
    df = spark.createDataFrame(rows, "k bigint, url string, t string, said string")
    got = {r.id: r for r in identify(df, "k", "t", F.col("said"), F.col("url")).collect()}
    assert [got[k].language for k in (900, 901, 902, 903)] == ["aa", "bb", "bb", "aa"] and all(got[k].rejected for k in range(900, 905))
    assert all(got[r[0]].language == r[3] and not got[r[0]].rejected for r in rows[:200])
    urls = spark.createDataFrame([("http://a.fr/x",), ("https://a.com/de/1",), ("http://a.com:80/deu",), (None,), ("x",)], "u string")
    assert [r[0] for r in urls.select(address_suffix(F.col("u"))).collect()] == ["fr", "de", None, None, None]


def brute_drops(rows, min_docs, outstanding, coarse=0.1):
    """rows: texts; the numbers of lines to drop of each."""
    from collections import Counter

    parse = lambda line: tuple("<*>" if re.search("[0-9]", x) else x for x in line.split())
    texts = {t: [(i, parse(x)) for i, x in enumerate(t.split("\n")) if x.split()] for t in set(rows)}
    leaf = lambda w: (len(w), w[:2])
    leaves = Counter(k for lines in texts.values() for k in {leaf(w) for _, w in lines})
    different = {t: [tuple(x) for x in {tuple(t.split("\n")[i].split()) for i, _ in lines}] for t, lines in texts.items()}
    places = Counter((leaf(w), k, x) for xs in different.values() for w in map(parse, map(" ".join, xs)) for k, x in enumerate(w))

    def known(w, k, level):
        n = places[leaf(w), k, w[k]]
        return leaves[leaf(w)] >= min_docs and n >= max(min_docs, level * leaves[leaf(w)])

    def templates(w):
        out = set()
        for level in (0, coarse):
            t = tuple(x if known(w, k, level) else "<*>" for k, x in enumerate(w))
            fields = sum(x == "<*>" and y != "<*>" for x, y in zip(t, w))
            if leaves[leaf(w)] >= min_docs and 3 * fields <= len(w) and 3 * sum(x != "<*>" for x in t) >= len(w):
                out.add((w[:2], t))
        return out

    count = Counter(k for lines in texts.values() for k in {k for _, w in lines for k in templates(w)})
    out = []
    for t in rows:
        lines = []
        for i, w in texts[t]:
            n = sorted(places[leaf(w), k, w[k]] if known(w, k, 0) else 0 for k in range(len(w)))
            lines.append((n[(len(w) - 1) // 2], len(w), i, max((count[k] for k in templates(w)), default=0)))
        total, below, by_words = sum(x[1] for x in lines), 0, None
        for x in sorted(lines):
            below += x[1]
            by_words = x[0] if by_words is None and 2 * below >= total else by_words
        base = max(1, min(by_words, sorted(lines)[(len(lines) - 1) // 2][0])) if lines else 1
        out.append([i for _, _, i, n in sorted(lines, key=lambda x: x[2]) if n >= min_docs and n >= base * outstanding])
    return out


@pytest.mark.parametrize("listed", [1_000_000, 0])
def test_line_templates(spark, monkeypatch, listed):
    from loomgraph.llm import line_templates
    from loomgraph.llm.line_templates import drop_templates

    monkeypatch.setattr(line_templates, "LISTED", listed)
    rnd = random.Random(2)
    vocab = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klm"]
    rows, planted = [], []
    long_line = " ".join(rnd.choices(vocab, k=40))
    for k in range(240):
        lines = [" ".join(rnd.choices(vocab, k=rnd.randrange(5, 30))) for _ in range(rnd.randrange(5, 9))]
        name = lambda: "".join(rnd.choices("abcdefgh", k=9))
        for every, line in (
            (3, f"posted on day {k} by user at the site"),
            (4, f"shared by our friend {name()} from the other side of {name()}"),
            (5, f"posted by {name()}"),
            (6, f"{long_line} {name()} and so on"),
            (7, "all rights"),
        ):
            if k % every == 0:
                lines.insert(rnd.randrange(len(lines) + 1), line)
                planted.append((k, line))
        rows.append("\n".join(lines))
    base = [" ".join(rnd.choices(vocab, k=12)) for _ in range(9)]
    copies = ["\n".join(x if rnd.random() < 0.7 else " ".join([*x.split()[:5], "".join(rnd.choices("xyz", k=8)), *x.split()[6:]]) for x in base) for _ in range(60)]
    rows += copies + [rows[1]] * 30 + ["all rights"] * 10 + ["", "\n\n", "wort " * 30000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(rows)] + [(None, None, "x"), (7777, None, "y")], "doc_id bigint, text string, drop string")
    df = df.selectExpr("*", "1 AS text_key", "2 AS __id", "3 AS `lines_gone`", "4 AS h")
    got = {r.doc_id: r for r in drop_templates(df).collect()}
    assert drop_templates(df).count() == len(rows) + 2 and got[7777].text is None
    want = brute_drops(rows, 20, 3)
    for k, t in enumerate(rows):
        assert (got[k]["__dropped"] or []) == want[k], (k, t)
        assert got[k].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[k])
    # nearly all planted lines go, the copies keep what they share
    assert sum(line not in got[k].text.split("\n") for k, line in planted) >= 0.9 * len(planted)
    assert all(got[240 + k].text == t for k, t in enumerate(copies))
    assert drop_templates(df.where("false")).count() == 0


def test_passages(spark):
    from loomgraph.llm.passage_chains import shared_passages

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=7))
    text = lambda n: [word() for _ in range(n)]
    passage, other = text(60), text(51)
    fuzzy = list(passage)
    fuzzy[28:30] = ["edit"]
    rows = {k: text(rnd.randrange(20, 400)) for k in range(40)}
    shared = {0: (passage, 5), 3: (fuzzy, 0), 7: (passage, 20), 8: (other, 1), 9: (other, 17), 12: (passage, 3)}
    for k, (p, at) in shared.items():
        at = min(at, len(rows[k]))
        rows[k][at:at] = p
        shared[k] = p, at
    rows[20][5:5] = rows[21][5:40]  # 35 shared words are too few
    rows[30] = text(30000)
    rows[31] = rows[30][:]
    rows[31][15000] = "x"
    rows[33] = rows[34] = ["same"] * 500
    say = [(k, " ".join(w).replace(" ", ", ", 3).upper() if k % 2 else " ".join(w), "s") for k, w in rows.items()]
    say += [(41, None, "s"), (42, "", "s"), (33, " ".join(rows[33]).replace(" ", ", ", 3).upper(), "s")]
    got = {r.doc_id: r for r in shared_passages(spark.createDataFrame(say, "doc_id bigint, text string, d string")).collect()}
    assert set(got) == {0, 3, 7, 8, 9, 12, 30, 31, 33, 34}
    for k, (p, at) in shared.items():
        a, z = map(int, got[k].passages.split(":"))
        assert abs(a - at) <= 1 and abs(z - at - len(p)) <= 1, (k, got[k], at)
    assert got[30].passages == "0:30000" and got[33].passages == "0:500"
    assert {got[k].class_id for k in (0, 3, 7, 12)} == {0} and {got[k].class_id for k in (8, 9)} == {8}
    assert shared_passages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_chains_against_all_pairs():
    import numpy as np

    from loomgraph.llm.passage_chains import GAP_COST, chains_of, common_words

    rnd = random.Random(6)
    for _ in range(60):
        rows = sorted({(rnd.randrange(200), rnd.randrange(200), rnd.randrange(5, 20), 1) for _ in range(rnd.randrange(1, 25))})
        best = []
        for x, y, n, _ in rows:
            prior = [b - GAP_COST * (x - p[0] - p[2] + y - p[1] - p[2]) for b, p in zip(best, rows) if p[0] + p[2] <= x and p[1] + p[2] <= y]
            best.append(n + max([0, *prior]))
        chains = chains_of(np.array(rows))
        top = [rows[i] for i in chains[0]]
        score = top[0][2]
        for p, q in zip(top, top[1:]):
            score += q[2] - GAP_COST * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2])
        assert abs(score - max(best)) < 1e-6
        assert sorted(i for c in chains for i in c) == list(range(len(rows)))
        a, b = (np.array([rnd.randrange(6) for _ in range(rnd.randrange(30))]) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert common_words(a, b) == t[-1][-1]


def test_toxicity(spark):
    from loomgraph.llm.toxicity import toxicity

    rnd = random.Random(8)
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, labels = [], []
    for k in range(1500):
        words = rnd.choices(vocab, k=rnd.randrange(3, 200))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grobian", "scoundrel", "wretch"]))
        rows.append((k, " ".join(words), "en" if k % 3 else "fr"))
        labels.append((k, int(toxic)))
    rows += [(9001, None, None), (9002, "", "en"), (None, "x", "en"), (5, rows[5][1], "en")]
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) > 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id in (9001, 9002)}) == 1
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert all(r.score == 0 for r in toxicity(docs, marks.where("false")).collect())
    assert toxicity(docs.where("false"), marks).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_labels_beyond_the_models(spark):
    """No label is dropped: those beyond the models share one."""
    from loomgraph.llm.language_id import identify

    rows = [(100 * k + i, " ".join(f"{chr(97 + k)}{chr(97 + (i + j) % 26)}{chr(97 + k)}{chr(98 + k)}q" for j in range(40)), f"l{k:02}") for k in range(12) for i in range(12 - k // 2)]
    df = spark.createDataFrame(rows, "id bigint, text string, said string")
    for languages in (128, 5):
        got = {r.id: r for r in identify(df, "id", "text", F.col("said"), languages=languages).collect()}
        assert not [r for r in got.values() if r.rejected]
        assert all(got[i].language == said for i, _, said in rows)
    assert {r.text_language for r in got.values()} == {"l00", "l01", "l02", "l03", "other"}


def test_stages_take_any_column_names(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumns({c: F.lit("x") for c in ("gone_id", "__id", "dropped", "__dropped", "kept_id", "id", "lines_gone", "text_key", "row")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where("gone_id = 'x' and __dropped = 'x'").count() > 0, name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from test_search import brute_classes, brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(9000 + (r[0] or 0), *r[1:]) for r in AWKWARD], SCHEMA))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        before = {r.doc_id: r for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()} if name != "packing" else {}
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        if name == "language_id":
            assert {d for d in before if len(words_of(before[d].text)) > 20} <= set(after)
        if name == "line_dedup":
            assert set(after) == set(before)
        if name == "near_dedup":
            sets = {d: shingles(before[d].text) for d in before}
            kept = sorted(after)
            assert not [(a, b) for k, a in enumerate(kept) for b in kept[k + 1 :] if alike(sets[a], sets[b]) >= 0.8]
            assert all(any(alike(sets[d], sets[e]) >= 0.8 for e in before if e != d) for d in set(before) - set(after))
        if name == "decontamination":
            assert set(after) == {d for d, r in before.items() if not brute_hits(r.text, bench)[1]}
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
        docs = out
    assert corpus_pipeline.run(spark, SF).count() > 100
    assert brute_classes([(1, 0), (2, 1)]) == [("1", 0, "1"), ("2", 1, "1")]
