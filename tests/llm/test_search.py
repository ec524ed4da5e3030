"""Near-duplicates, phrase index and audio against brute force."""

import hashlib
import re
import zlib

import pytest
from test_base import AWKWARD, SCHEMA, SF

NEAR = [(5000 + k, " ".join(f"w{j}" if j != 7 * (k % 40) else f"x{k}" for j in range(300)), "en", "s", 1) for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(AWKWARD + NEAR, SCHEMA)).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def brute_fp(t):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(rows):
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    best = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            best[find(k)] = min(best.get(find(k), d), d)
    return sorted((str(d), f, str(best.get(find(k)))) for k, (d, f) in enumerate(rows))


@pytest.mark.parametrize("bucket", [4096, 4])
def test_simhash(docs, texts, bucket):
    from loomgraph.llm.simhash import near_duplicates

    want = brute_classes([(d, brute_fp(t)) for d, t in texts])
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in near_duplicates(docs, bucket=bucket).collect())
    assert got == want


def test_simhash_links_of_random_fingerprints(spark):
    import random

    from loomgraph.llm.simhash import allocate, bucket_links, candidate_buckets, components, plan

    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(30)}
    while len(fps) < 400:
        x = rnd.choice(sorted(fps))
        fps.add(x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    got = {(r.a, r.b) for r in bucket_links(candidate_buckets(df, plan(df)), 2).collect()}
    assert got == want
    for t in ([(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(k, 64, 4)), t) for k, t in enumerate((0, 0, -1, 0))]):
        assert {(r.a, r.b) for r in bucket_links(candidate_buckets(df, t, bucket=4)).collect()} == want
    pairs = spark.createDataFrame(sorted(want), "a bigint, b bigint")
    got = {r.node: r.root for r in components(pairs).collect()}
    for a, b in want:
        assert got.get(a, a) == got.get(b, b)
    assert allocate([{-1: 0, 0: 5, 1: 100}, {-1: 0, 0: 9, 1: 12}, {-1: 0, 0: 1, 1: 2}]) == (7, [0, -1, 1])
    assert allocate([{-1: 0, 0: 5}, {0: 9, 1: 12}])[1] == [0, 1]


def test_one_of_each(docs):
    from loomgraph.llm.simhash import near_duplicates, one_of_each

    rows = near_duplicates(docs).collect()
    least = {}
    for r in rows:
        if r.doc_id == r.component_id:
            least[r.class_fp] = min(least.get(r.class_fp, (r.text_hash, r.doc_id)), (r.text_hash, r.doc_id))
    kept = one_of_each(docs, near_duplicates(docs)).collect()
    assert len(kept) == len({r.class_fp for r in rows}) and sorted(str(r.doc_id) for r in kept) == sorted(str(d) for _, d in least.values())
    assert one_of_each(docs.where("false"), near_duplicates(docs.where("false"))).count() == 0


def test_similar_documents(spark):
    """Copies with edits up to a similarity of 0.8 fall together; others do not, however long the text."""
    import random

    from loomgraph.llm.simhash import one_of_each, similar_documents

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    rows, group = [], {}
    for g in range(60):
        base = [word() for _ in range(rnd.choice([12, 40, 90, 300, 900]))]
        for c in range(rnd.choice([1, 2, 4])):
            w = list(base)
            for _ in range(0 if c == 0 else rnd.randrange(1, max(2, len(base) // 60))):
                w[rnd.randrange(len(w))] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    rows += [(500, None), (501, ""), (502, rows[3][1]), (502, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in similar_documents(df).collect()}
    assert sum(got[i] == got[j] for i, j in near) >= 0.95 * len(near) and len(near) > 30
    assert all(group[d] == group[c] for d, c in got.items() if d < 500 and c is not None)
    assert got[502] == got[3] and got[501] in (500, 501)
    kept = [r.doc_id for r in one_of_each(df, similar_documents(df)).collect()]
    assert sorted(kept) == sorted({c for c in got.values()})
    assert similar_documents(df.where("false")).count() == 0


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        for k in range(max(1, len(x) - 9)) if x else ():
            win = x[k : k + 10]
            for s in range(len(w) - len(win) + 1):
                if w[s] == win[0] and w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(str(i))
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("block", [1 << 20, 900])
def test_phrases(spark, docs, texts, block):
    from loomgraph.llm.phrase_index import contamination

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "One"), (903, "wort wort wort"), (904, " ".join(f"w{k}" for k in range(8, 30))), (905, "absent words only")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r.item_ids)) for r in contamination(docs, bench, block_chars=block).collect())
    assert got == sorted((str(d), *brute_hits(t, items)) for d, t in texts)
    if block > 1000:
        none = contamination(docs, bench.where("false"))
        assert none.count() == len(texts) and none.where("n_hit > 0").count() == 0
        assert contamination(docs.where("false"), bench).count() == 0


def test_proximity(spark):
    from loomgraph.llm.phrase_index import contamination

    docs = spark.createDataFrame([(1, "zeta far " + "pad " * 10 + "omega kappa"), (2, "zeta " + "pad " * 50 + "omega kappa"), (3, "zeta"), (4, "omega kappa")], "doc_id bigint, text string")
    items = spark.createDataFrame([("q", "omega pad kappa zeta")], "item_id string, text string")
    got = {r.doc_id: r.near_ids for r in contamination(docs, items, proximity=True).collect()}
    assert got == {1: ["q"], 2: [], 3: [], 4: []}


def test_audio_rows(docs, texts):
    from loomgraph.llm.telephony import decode_audio, encode_audio, unwav

    stored = encode_audio(docs).collect()
    assert sorted(str(r.id) for r in stored) == sorted(str(d) for d, _ in texts)
    got = sorted((str(r.id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in decode_audio(encode_audio(docs)).collect())
    want = []
    for d, t in texts:
        b = t.encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        want.append((str(d), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want)
    by_text = {}
    for r in stored:
        assert by_text.setdefault(unwav(bytes(r.media))[1], bytes(r.media)) == bytes(r.media)
    assert encode_audio(docs.where("false")).count() == 0


def test_audio_codecs(spark, tmp_path):
    import io
    import wave

    import numpy as np

    from loomgraph.llm.telephony import alaw_table, decode_adpcm, encode_audio, mulaw_table, resample, store_pcm, wav

    mu, al = mulaw_table(), alaw_table()
    # Fixed points of G.711
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (al[0x55], al[0xD5], al[0xAA], al[0x2A]) == (-8, 8, 32256, -32256)
    assert sorted(-mu[:128]) == sorted(mu[128:]) and (al[:128] == -al[128:]).all()

    def plain(block):
        steps = __import__("loomgraph.llm.telephony", fromlist=["STEPS"]).STEPS
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [value]
        for byte in block[4:]:
            for nib in (byte & 15, byte >> 4):
                step = int(steps[index])
                diff = ((2 * (nib & 7) + 1) * step) >> 3
                value = max(-32768, min(32767, value - diff if nib & 8 else value + diff))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nib & 7]))
                out.append(value)
        return out

    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (50, 64), dtype=np.uint8)
    assert decode_adpcm(blocks).tolist() == [plain(b.tobytes()) for b in blocks]
    assert resample(np.array([0, 10, -10], np.int16)).tolist() == [0, 5, 10, 0, -10, -10]
    assert wav(b"\0" * 64, "mulaw")[:4] == b"RIFF"
    docs = spark.createDataFrame([(1, "hello"), (2, "hello"), (3, None)], "doc_id bigint, text string")
    for codec in ("mulaw", "alaw", "adpcm"):
        path = f"{tmp_path}/{codec}"
        store_pcm(encode_audio(docs, codec), path)
        rows = {r.id: r for r in spark.read.parquet(path).collect()}
        assert rows[1].pcm == rows[2].pcm and len(rows[1].pcm) == 4 * (121 if codec == "adpcm" else 64)


@pytest.mark.parametrize("small", [4, 32])
def test_similar_documents_of_one_original(spark, small):
    """Independently edited copies of one text, all similar to it only, are one class wherever its id lies."""
    import random

    from loomgraph.llm.simhash import similar_documents

    rnd = random.Random(23)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    rows, want = [], []
    for n_words, copies in ((120, 24), (400, 60)):
        base, group = [word() for _ in range(n_words)], []
        for c in range(copies):
            w = list(base)
            for k in rnd.sample(range(n_words // 8), n_words // 60) if c else []:
                w[8 * k + rnd.randrange(8)] = word()
            group.append(" ".join(w))
        ids = rnd.sample(range(1000 * len(want), 1000 * len(want) + 999), copies)
        ids[0] = sorted(ids)[copies // 2] if ids[0] in (min(ids), max(ids)) else ids[0]
        ids = [ids[0], *[i for i in ids[1:] if i != ids[0]]]
        rows += list(zip(ids, group))
        want.append(min(ids))
    passage = [word() for _ in range(40)]  # a passage that many texts have does not make them similar
    rows += [(5000 + k, " ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)])) for k in range(50)]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), **({} if small == 32 else {"small": small})).collect()}
    assert len(got) == len(rows)
    assert all(got[d] == (want[d // 1000] if d < 5000 else d) for d, _ in rows)
