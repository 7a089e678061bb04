"""The training-text operators against brute force on small tables with nulls, empty texts, copies and ties."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tenderline.llm import decontaminate, language, lines, neardup, neighbours, pieces, quality, sharding, suffixes, toxicity
from tenderline.llm.sharding import communication_matrix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, shard string, score string"


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", "y", "z") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = line(60)
    out = ["\n".join(line(rng.randint(1, 14)) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    out += [out[3], out[3], out[4] + " tail", passage, line(8) + "\n" + passage + "\n" + line(9), "", None, " \n\t ", "x", "é ü\n\né ü", "Same Line Of Five\nother\nSame Line Of Five\nother", line(4000)]
    out += [out[5].replace(out[5].split()[0], "zz", 1)]
    return list(enumerate(out))


def test_decontamination(spark, texts):
    docs = table(spark, [*texts, (None, texts[0][1])])
    items = [(1, texts[0][1][:200]), (2, "x"), (3, ""), (4, None), (11, texts[-2][1][500:900])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = []
    for i, t in [*texts, (None, texts[0][1])]:
        w, hit, ids = split(t), set(), set()
        for item, x in items:
            y = split(x)
            for k in range(max(1, len(y) - 9) if y else 0):
                g = y[k : k + 10]
                for a in range(len(w) - len(g) + 1):
                    if w[a : a + len(g)] == g:
                        hit.update(range(a, a + len(g)))
                        ids.add(str(item))
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r[:6]) for r in decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_proximity(spark):
    docs = table(spark, [(1, "alpha and then beta"), (2, "alpha beta"), (3, "beta alpha")])
    index = decontaminate.build_index(docs, ["alpha", "beta"])
    found = lambda slop: {r["doc_id"] for r in decontaminate.find_phrases(index, ["alpha", "beta"], [["alpha", "beta"]], slop).collect() if r["matches"]}
    assert found(0) == {2}
    assert found(2) == {1, 2, 3}


def test_line_dedup(spark, texts):
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    seen, dead, own = set(), defaultdict(set), {}
    for i, t in texts:
        own[i] = (t or "").split("\n")
        x = [(p, v) for p, y in enumerate(own[i]) if (v := y.strip(" \t\r\f\x0b"))]
        for a in range(len(x)):
            n = w = 0
            while w < 4 and a + n < len(x):
                w += x[a + n][1].count(" ") + 1
                n += 1
            if w >= 4:
                run = tuple(v for _, v in x[a : a + n])
                if run in seen:
                    dead[i].update(p for p, _ in x[a : a + n])
                seen.add(run)
    for i, t in texts:
        assert got[i]["text"] == (None if t is None else "\n".join(v for p, v in enumerate(own[i]) if p not in dead[i])), i
        assert got[i]["n_removed"] == len(dead[i])
    assert dead[texts[61][0]] and lines.dedup_lines(table(spark, [])).count() == 0


def test_maximal_line_runs(spark, texts):
    """Whole repeated runs go: short last lines too, and lines without spaces."""
    licence = "Permission is hereby granted\nfree of charge to any\nPERSON\nSOFTWARE."
    rows = [*texts, *((100 + i, f"own {i}\n{x}\nrest {i} of it") for i, x in enumerate([licence, licence, "这是一个很长的重复的句子没有空格", "这是一个很长的重复的句子没有空格", "a\tb\tc\td", "a\tb\tc\td", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0MTIzNDU2Nzg5MA==", "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo0MTIzNDU2Nzg5MA==", "短い", "短い"]))]
    size = lambda v: max(sum(v.count(c) for c in " \t") + 1, len(v) // 8, len(re.findall("[\u3040-\u30ff\u4e00-\u9fff]", v)) // 2)
    seen, dead, own = set(), defaultdict(set), {}
    for i, t in rows:
        own[i] = (t or "").split("\n")
        x = [(p, v) for p, y in enumerate(own[i]) if (v := y.strip(" \t\r\f\x0b"))]
        for a in range(len(x)):
            for b in range(a + 1, len(x) + 1):
                if sum(size(v) for _, v in x[a:b]) >= 4:
                    run = tuple(v for _, v in x[a:b])
                    if run in seen:
                        dead[i].update(p for p, _ in x[a:b])
                    seen.add(run)
    got = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, rows), maximal=True).collect()}
    for i, t in rows:
        assert got[i]["text"] == (None if t is None else "\n".join(v for p, v in enumerate(own[i]) if p not in dead[i])), i
    assert got[101]["n_removed"] == 4 and [got[i]["n_removed"] for i in (103, 105, 107, 109)] == [1, 1, 1, 0]


def brute_components(texts):
    def sets(t):
        w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = {i: sets(t) for i, t in texts}
    comp = {i: i for i in s}
    for _ in s:
        for a in s:
            for b in s:
                both = len(s[a] & s[b])
                if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[comp[i]] == comp[i] for i in comp):
            break
    return {i: (len(s[i]), comp[i]) for i in s}


def test_near_duplicates(spark, texts):
    want = brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, texts)).collect()}
    assert got == want
    assert neardup.near_duplicates(table(spark, [(None, "a b"), (1, "a b")])).where("kept").count() == 2


def test_near_duplicates_round_the_threshold(spark, monkeypatch):
    """Copies with 0 to 7 changed words of 100: links, chains of them and many pairs just below; the bound by rare shingles is used."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    copies = []
    for i in range(260):
        words = list(base)
        for k in rng.sample(range(100), i % 8):
            words[k] = f"v{rng.randrange(40)}"
        copies.append((i + 1, " ".join(words)))
    used, plain = [], neardup.linkable
    monkeypatch.setattr(neardup, "linkable", lambda *a: used.append(1) or plain(*a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, copies)).collect()}
    assert got == brute_components(copies)
    assert used and len({c for _, c in got.values()}) > 10


def test_substrings(spark, texts):
    first, want = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for o in range(len(b) - 99):
            if b[o : o + 100] in first:
                gone[o : o + 100] = True
            first.add(b[o : o + 100])
        want[i] = np.frombuffer(b, np.uint8)[~gone].tobytes()
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.dedup_substrings(table(spark, texts)).collect()}
    assert got == want


def test_substrings_of_hot_keys(spark, texts, monkeypatch):
    whole = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.dedup_substrings(table(spark, texts)).collect()}
    monkeypatch.setattr(suffixes, "MAX_GROUP", 1)
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffixes.dedup_substrings(table(spark, texts)).collect()} == whole


def test_substrings_of_short_texts(spark, monkeypatch):
    """Texts of 100 to 180 bytes, which are one context at many places, share parts; several shards."""
    rng = random.Random(11)
    chars = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    bases = [chars(180) for _ in range(40)]
    texts = []
    for i in range(400):
        base, n = rng.choice(bases), rng.randint(100, 180)
        a = rng.randint(0, 180 - n)
        own = rng.randint(0, n - 100)  # bytes of its own, before or after the shared ones
        texts.append((i, chars(own) + base[a : a + n - own] if i % 2 else base[a : a + n - own] + chars(own)))
    monkeypatch.setattr(suffixes, "SHARD", 1 << 14)
    first, want = set(), {}
    for i, t in texts:
        b, gone = t.encode(), np.zeros(len(t), bool)
        for o in range(len(b) - 99):
            if b[o : o + 100] in first:
                gone[o : o + 100] = True
            first.add(b[o : o + 100])
        want[i] = np.frombuffer(b, np.uint8)[~gone].tobytes()
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.dedup_substrings(table(spark, texts)).collect()}
    assert got == want


def test_minimisers_share_out_strings():
    """Each string of 100 bytes within a text belongs to one minimiser, its piece of least hash, and equal strings to equal places."""
    rng = np.random.default_rng(3)
    shared = bytes(rng.integers(97, 105, 400, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 105, n, dtype=np.uint8)) + shared[k : k + 260] for n, k in ((90, 0), (31, 140), (0, 70))] + [b"", b"short", b"ab" * 120]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    pos, first, last = suffixes.minimisers(data, offsets, 100, suffixes.prefix_hash(data))
    starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert starts == [s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - 99)]
    places: dict[bytes, set[int]] = {}
    for p, a, b in zip(pos, first, last):
        for s in range(a, b + 1):
            assert s <= p <= s + 80
            places.setdefault(data[s : s + 100].tobytes(), set()).add(int(p - s))
    assert all(len(x) == 1 for x in places.values()) and len(places) < len(starts)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_suffix_array(k):
    rng = np.random.default_rng(k)
    for n in range(1, 60):
        s = rng.integers(0, k, n)
        want = sorted(range(n), key=lambda i: s[i:].tolist())
        assert suffixes.suffix_array(s, k).tolist() == want
        assert suffixes.suffix_array(s, 1000).tolist() == want  # by levels


def test_sharding(spark, texts):
    rows = [*texts, *texts]
    got = sharding.shard_documents(table(spark, rows), 7).toPandas()
    sizes = got["shard"].value_counts()
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    m = communication_matrix([5, 0, 9, 100], 24, 1)
    assert m.sum(1).tolist() == [5, 0, 9, 100] and m.sum(0).max() - m.sum(0).min() <= 1
    assert sharding.shard_documents(table(spark, [])).count() == 0
    for r in got.to_dict("records"):
        b = (dict(texts)[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 8, zlib.crc32(b), "rows")


def test_hypergeometric_law():
    """Small draws against the exact law (chi square); large ones by mean and variance, and at the edges."""
    from math import comb

    rng = np.random.default_rng(3)
    found = np.bincount([communication_matrix([6, 9, 5], 4, s)[1, 0] for s in range(4000)], minlength=6)
    want = np.array([comb(5, x) * comb(15, 9 - x) / comb(20, 9) for x in range(6)]) * 4000
    assert ((found - want) ** 2 / want).sum() < 25
    big = 3 * 10**10
    x = np.array([sharding.hypergeometric(rng, big, 2 * big, 10**6) for _ in range(2000)])
    assert abs(x.mean() - 10**6 / 3) < 50 and 0.85 < x.var() / (10**6 * 2 / 9) < 1.15
    assert sharding.hypergeometric(rng, big, 0, 77) == 77 and sharding.hypergeometric(rng, 0, big, 77) == 0
    assert 0 <= sharding.hypergeometric(rng, 5, big, 2 * 10**10) <= 5
    m = communication_matrix([4 * 10**9, 3 * 10**9 + 5], 24, 1)
    assert m.sum(1).tolist() == [4 * 10**9, 3 * 10**9 + 5] and m.sum(0).max() - m.sum(0).min() <= 1


def test_language(spark):
    rng = random.Random(1)
    make = lambda v: " ".join("".join(rng.choice(v) for _ in range(5)) for _ in range(30))
    rows = [(i, make(v), lang) for i in range(60) for v, lang in (("abcde", "xx"), ("vwxyz", "yy"))]
    docs = spark.createDataFrame([(k, t, g) for k, (_, t, g) in enumerate(rows)] + [(900, None, "xx"), (901, " 12 !", "yy"), (902, "abc", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(got[k]["lang_pred"] == g for k, (_, _, g) in enumerate(rows))
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "xx"


def test_cross_parsing_counts_greedy_phrases():
    sample = [3, 4, 5, 3, 3, 4]
    model = {"langs": ["a"], "alphabet": np.array([97, 98, 99], np.uint32), "steps": language.Transitions([language.suffix_automaton(sample)], 6), "roots": np.array([0], np.int32)}
    for text in ("abc", "abca", "ccc", "aabab", "bcaab"):
        codes, offsets = language.letters([text])
        s, n, i = "abcaab", 0, 0
        while i < len(text):
            k = 1
            while i + k <= len(text) and text[i : i + k] in s:
                k += 1
            i += max(1, k - 1)
            n += 1
        assert language.phrases(model, codes, offsets)[0, 0] == n, text


def test_neighbours_through_the_index(spark):
    """20,000 vectors, a hundred queries: the index finds nine of ten true neighbours or more; odd vectors do no harm."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 24))
    v = (centres[rng.integers(0, 200, 20_000)] + rng.normal(scale=0.5, size=(20_000, 24))).astype(np.float64)
    rows = list(zip(range(20_000), v.tolist()))
    odd = [(30_050, [1e-200] * 24), (30_100, [1e-200, *[0.0] * 23]), (30_150, [1.0, 2.0]), (30_200, [float("inf")] * 24), (30_250, None)]
    vectors = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").repartition(4)
    asked = vectors.where("vec_id % 200 = 0 or vec_id >= 30000")
    got = neighbours.search(vectors, asked).toPandas()
    u = v / np.linalg.norm(v, axis=1)[:, None]
    hits = 0
    for q in range(0, 20_000, 200):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(-s)[:5].tolist()))
        assert np.allclose(got[got.query_id == q].sort_values("rank").score, sorted(got[got.query_id == q].score, reverse=True))
    assert hits >= 0.9 * 5 * 100
    assert set(got.query_id[got.query_id >= 30_000]) == {30_050, 30_100, 30_200} - {30_200} and got.score.notna().all()
    assert neighbours.search(vectors.limit(0), vectors.limit(0)).count() == 0
    assert neighbours.search(vectors.where("vec_id < 50"), vectors.where("vec_id = 30150")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).tolist()
    v[7] = v[3]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(vectors, vectors.where("vec_id % 50 = 0"))
    m = np.array(v)
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for q, g in got.toPandas().groupby("query_id"):
        s = u @ u[q]
        order = [i for i in np.lexsort((np.arange(300), -np.round(s, 12))) if i != q][:5]
        assert g.sort_values("rank")["vec_id"].tolist() == order
    assert got.count() == 30


def test_pieces(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = [*texts, (500, "  two  spaces \t日本 ☃ naïve\u0000"), (501, "▁mark")]
    got = pieces.decode(pieces.encode(table(spark, rows))).collect()
    for r in got:
        assert r["ids"] == sp.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").replace("▁", " ") or r["doc_id"] == 501
        assert r["round_trip"] == (r["doc_id"] != 501)


def test_pieces_of_the_largest_sum():
    """The Viterbi pass against all segmentations of short words, walked in any order."""
    own = pieces.Pieces(pieces.MODEL, "unigram")
    rng = random.Random(3)
    words = ["".join(rng.choice("theandi☃") for _ in range(rng.randint(1, 9))) for _ in range(150)]

    def cuts(w):
        yield from ([w[:n], *rest] for n in range(1, len(w)) for rest in cuts(w[n:]))
        yield [w]

    value = lambda w: max(sum(own.score.get(p, own.unknown if len(p) == 1 else -1e18) for p in c) for c in cuts(w))
    ids, ends = own.encode(pa.array(words))
    raw = {i: p for p, i in own.ids.items()}
    for w, a, b in zip(words, ends, ends[1:]):
        parts = [raw.get(int(i)) for i in ids[a:b]]
        spelled = sum(p is None for p in parts) // 3  # bytes of a character without a piece
        assert abs(sum(own.score[p] for p in parts if p) + spelled * own.unknown - value("▁" + w)) < 1e-6, w


def test_pieces_of_long_words(spark):
    """Words without a space of more characters than calls can nest."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(8)
    chars = lambda v, n: "".join(rng.choice(v) for _ in range(n))
    rows = [(1, chars("ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/", 100_000)), (2, chars("0123456789abcdef", 5000)), (3, "the" * 2000), (4, "plain text " + chars("etaoinshr", 1500) + " and more")]
    for r in pieces.encode(table(spark, rows)).collect():
        assert r["ids"] == sp.encode(r["text"]) and r["round_trip"]


def graded(spark, column, good, bad):
    rng = random.Random(5)
    rows = [(i, (bad if i % 4 == 0 else good)(rng)) for i in range(400)]
    docs = table(spark, [*rows, (1000, None), (1001, "")])
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if column == "toxic" else int(i % 4 != 0)) for i, _ in rows], f"doc_id long, {column} int")
    return docs, labels


def test_quality(spark):
    plain = lambda r: " ".join(r.choice(["the", "sun", "rose", "over", "a", "green", "hill"]) for _ in range(60)) + "."
    junk = lambda r: " ".join(r.choice(["BUY!!", "$$$", "NOW***"]) for _ in range(60))
    docs, labels = graded(spark, "quality", plain, junk)
    got = quality.score_quality(docs, labels).toPandas().set_index("doc_id")
    held = [i for i in range(400) if got.held_out[i]]
    assert len(held) > 50 and all(got.predicted[i] == int(i % 4 != 0) for i in held)
    assert got.score.between(0, 1).all() and len(got) == 402


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(y) > 0).all() and np.isclose(y[1], 0.5)


def test_toxicity(spark):
    word = lambda r: "".join(r.choice("abcdefghijk") for _ in range(4))
    clean = lambda r: " ".join(word(r) for _ in range(40))
    bad = lambda r: clean(r) + " zzvile" + word(r) + " qqfoul " + clean(r)
    docs, labels = graded(spark, "toxic", clean, bad)
    got = toxicity.score_toxicity(docs, labels).toPandas().set_index("doc_id")
    held = [i for i in range(400) if got.held_out[i]]
    assert all(got.predicted[i] == int(i % 4 == 0) for i in held)
    assert got.predicted[1000] == got.predicted[1001] == 0


def test_flat_takes_slices():
    from tenderline.llm.text import flat

    data, offsets = flat(pa.array(["ab", None, "é", ""]).slice(1))
    assert bytes(data) == "é".encode() and offsets.tolist() == [0, 0, 2, 2]


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    """The stages against brute force: only near copies of documents with an id go, and all that hold a benchmark window."""
    import corpus_pipeline
    import sentencepiece

    rng = random.Random(6)
    prose = lambda n=60: " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 7))) for _ in range(n))
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    a, c, test = prose(), prose(), prose(20)
    rows = [(1, a), (1, prose()), (2, c), (2, c), (3, near(a)), (None, prose()), (None, prose()), (None, near(a) + " too"), (None, prose() + " " + test), (4, prose()), (4, prose(30) + " " + test), (5, prose()), (6, near(c))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    distinct = list(dict.fromkeys(r for r in rows if r[0] is not None))
    linked = brute_components([(k, t) for k, (_, t) in enumerate(sorted(distinct, key=lambda r: r[0]))])
    kept = [r for k, r in enumerate(sorted(distinct, key=lambda r: r[0])) if linked[k][1] == k] + [r for r in rows if r[0] is None]
    windows = {tuple(test.split()[i : i + 10]) for i in range(11)}
    want = [(i, t) for i, t in kept if not windows & {tuple(t.split()[k : k + 10]) for k in range(len(t.split()) - 9)}]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = [(r["doc_id"], sp.decode(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 8


def test_toxicity_without_evidence(spark):
    """Empty tables, no labels, labels of one class, and partitions without rows: scores are defined."""
    rows = table(spark, [(1, "some text"), (2, None), (None, "x")]).repartition(7)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, toxic int")
    for labels in (none, one):
        assert [r["score"] for r in toxicity.score_toxicity(rows, labels).collect()] == [0.5] * 3
        assert toxicity.score_toxicity(rows.limit(0), labels).count() == 0
    few = table(spark, [(i, "zzvile words here" if i % 4 == 0 else "plain words here") for i in range(60)]).repartition(40)
    got = toxicity.score_toxicity(few, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int"))
    assert {r["doc_id"]: r["predicted"] for r in got.collect()} == {i: int(i % 4 == 0) for i in range(60)}


def test_empty_tables(spark):
    docs, labels = table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, labels).count() == 0
    assert language.identify(docs).count() == 0
    assert neardup.near_duplicates(docs).count() == 0
    assert suffixes.dedup_substrings(docs).count() == 0
    assert pieces.encode(docs).count() == 0


def test_lines_of_repeated_rows(spark):
    """Rows of one doc_id and text are one document: their runs are no copies of each other, and they lose what is a copy of another's."""
    run = "one two three four five\nsix seven eight nine ten\nlast"
    rows = [(1, run), (2, "own words of two here\n" + run), (2, "own words of two here\n" + run), (3, "words that stand here twice"), (3, "words that stand here twice"), (None, run), (None, run)]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(table(spark, rows), maximal=True).collect()), key=str)
    assert got == sorted([(1, run, 0), *[(2, "own words of two here", 3)] * 2, *[(3, "words that stand here twice", 0)] * 2, *[(None, "", 3)] * 2], key=str)


def test_lexicon_weighs_all_terms(spark):
    """A toxic word rarer than more than 20,000 neutral terms of the toxic texts."""
    rng = random.Random(4)
    common = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxy") for _ in range(8)) for _ in range(12_000))
    rows = [(common + " zzvile" * (i < 4), int(i < 10)) for i in range(20)]
    assert toxicity.mine_lexicon(spark.createDataFrame(rows, "text string, label int"))[:1] == ["zzvi"]


def test_language_samples_of_unequal_size(spark):
    """Short labelled texts, or many without letters, fill a sample as long ones do; phrases of smaller samples count less."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(1500)]
    own = {"short": vocabulary[:1000], "long": vocabulary[500:]}
    say = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    rows = [(say("short", 4), "short") for _ in range(3000)] + [(f"{i} 123 .", "short") for i in range(3000)] + [(say("long", 800), "long") for _ in range(20)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model["sizes"].tolist() == [40_000, 40_000]
    tests = [(i, say(g, 60), g) for i, g in enumerate(["short", "long"] * 40)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.createDataFrame(tests, "doc_id long, text string, lang string"), model, "doc_id").collect()}
    assert all(got[i] == g for i, _, g in tests)
    few = language.train(spark.createDataFrame([("ab abc cab", "a"), ("ab abc cab " + say("long", 2000), "b")], "text string, lang string"))
    assert few["sizes"][0] == 8
    assert language.predict(spark.createDataFrame([(1, "ab abc cab")], "doc_id long, text string"), few, "doc_id").first()["lang_pred"] == "a"


@pytest.mark.parametrize("dense", [1000, 0])
def test_phrases_go_across_pieces(dense):
    rng = random.Random(9)
    model = {"langs": ["a"], "alphabet": np.array([97, 98, 99], np.uint32), "steps": language.Transitions([language.suffix_automaton([3, 4, 5, 3, 3, 4, 4, 5, 5, 3])], 6, dense), "roots": np.array([0], np.int32)}
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 7, 8, 9, 50, 300)] + ["a" * 200, ""]
    codes, offsets = language.letters(texts)
    whole = language.phrases(model, codes, offsets, 1000)
    assert (language.phrases(model, codes, offsets, 8) == whole).all() and (language.phrases(model, codes, offsets, 1) == whole).all()
