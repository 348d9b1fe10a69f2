"""Lexical search, the quality network and phrase mining against brute force on small hostile tables."""

import collections
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from altigrid.llm import convnet, phrases, queries, search

BASE = "/root/testdata"
DOCS = "doc_id bigint, text string, lang string, item_id bigint, score double, rank int, n bigint, item bigint, phrase string"
LINES = [
    None, "", " .;- ", "One two THREE two", "ünï-cödé İ ﬁ x1y2 X1Y2 naïve", "two two two two", "three.one_two", "a b a b a b, a b. a b", "of the of the of the\tof  the",
    "Of The of the! of the x of the y of the z", "\x00bell\x1f the\x85of\xa0the  of the", "no\nof\x0bthe\x0cof\rthe", "of the one two of the one two of the one two", "of the one two of the one two",
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, 0.5, 2, 3, 4, "x") for i, t, g in rows], DOCS).repartition(4)


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", None, "fr", "und"][i % 4]) for i, t in enumerate(LINES)]
    out += [(3, LINES[3], "en"), (3, LINES[3], "en"), (None, "two", "en"), (None, None, None), (40, "of the one two " * 900, "en"), (41, "x y. " * 700, "fr"), (-5, "one two", "en")]
    return out


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def ranked(rows, items, k):
    """Per item, the list of (doc_id, score)."""
    have = [(i, collections.Counter(words(t))) for i, t, _ in rows if words(t)]
    n_docs, length = len(have), sum(sum(c.values()) for _, c in have)
    df = collections.Counter(t for _, c in have for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in have:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i, s))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, f[2], f[3]) for r, f in enumerate(found[:k])]
    return sorted(out, key=repr)


def test_search_against_brute_force(spark, rows):
    items = [(1, "two three, two; two"), (1, "two three, two; two"), (2, None), (3, "..."), (4, "the OF X1y2 unseen"), (None, "naïve one"), (5, "unseen only")]
    frame = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id bigint, text string, doc_id bigint")
    docs = docs_of(spark, rows)
    for k, size in ((20, search.GROUP_BYTES), (3, 100), (1, 1)):  # the small sizes make several groups
        got = search.search(docs, frame, k, size)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked(rows, items, k)
    assert search.search(docs.where("false"), frame).count() == 0 and search.search(docs, frame.where("false")).count() == 0


def test_search_tiles_are_tie_safe_and_many(spark):
    """More documents than a tile, most of them tied, ids against the order of the rows."""
    rows = [(i * 7919 % 3001, f"tie {'win' if i % 500 == 0 else ''}", "en") for i in range(3001)] + [(i, "other", "en") for i in range(400)]
    items = spark.createDataFrame([(i, f"tie {'win' if i % 2 else ''}") for i in range(300)], "item_id bigint, text string")
    got = search.search(docs_of(spark, rows), items, 8)
    want = {i: x for i, x in ((i, ranked(rows, [(i, f"tie {'win' if i % 2 else ''}")], 8)) for i in (0, 1, 298, 299))}
    for i, w in want.items():
        assert sorted((tuple(r) for r in got.where(F.col("item_id") == i).collect()), key=repr) == w
    assert got.count() == 300 * 8


def test_blocks_bound_their_sums():
    rng = np.random.default_rng(1)
    item, term, value = rng.integers(0, 6, 400), rng.integers(0, 90, 400), rng.integers(1, 500, 400)
    pairs = np.unique(item * 1000 + term, return_index=True)[1]
    item, term, value = item[pairs], term[pairs], value[pairs]
    value[3] = 5_000  # over the bound: dealt over layers
    total = np.zeros((90, 6))
    for names, dense in search.blocks(item, term, value, 6, most=900, width=7):
        assert len(names) <= 7 and dense.max(axis=1).sum() <= 900
        total[names] += dense
    want = np.zeros((90, 6))
    want[term, item] = value
    assert (total == want).all()


def folded(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def mined(rows, least, top):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(t)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in cand.items())
            if not inside:
                kept.append((-s, -a, " ".join(p).encode(), k, c[p[:k]], c[p[k:]]))
        for r, (s, a, p, _, l, rest) in enumerate(sorted(kept)[:top]):
            out.append((lang, r + 1, p.decode(), -a, l, rest, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("share", [1.0, 0.3, 0.0])
def test_phrases_against_brute_force(spark, rows, share):
    """With a small or an empty sample everything that is frequent fails the border and is found by the further passes."""
    got = phrases.collocations(docs_of(spark, rows), least=3, top=9, share=share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = mined(rows, 3, 9)
    assert sorted(tuple(r) for r in got.collect()) == want and {x[0] for x in want} >= {"en", "und", "fr"}


def test_phrases_of_nothing(spark, rows):
    docs = docs_of(spark, rows)
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.where("text is null")).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0


def test_long_texts_are_cut_at_piece_ends():
    text = (b"Of the one; two three\t" * 50 + b"x" * 90 + b"! ") * 3 + b"tail words"
    parts = list(phrases.stretches(text, 64))
    assert len(parts) > 50 and b"\n".join(parts) == text.translate(phrases.FOLD)

    def tally(texts):
        c = collections.Counter()
        for _, names, n in phrases.counted(texts, phrases.Plan()):
            c.update(dict(zip(names.to_pylist(), n.tolist(), strict=True)))
        return c

    assert tally(parts) == tally(list(phrases.stretches(text)))


def test_bitmap_saturates_without_loss(spark, rows):
    """A bitmap far too small admits false members, which only means more counting."""
    docs = docs_of(spark, rows)
    small = {tuple(r) for r in phrases.frequent_phrases(docs, 3, 0.5, bits=64).collect()}
    assert small == {tuple(r) for r in phrases.frequent_phrases(docs, 3, 1.0).collect()}


def test_network_sees_every_window():
    """The strongest answer of a text is that of a plain convolution over all its bytes and the zeros after them."""
    net = convnet.Net()
    rng = np.random.default_rng(2)
    texts = [b"", b"a", bytes(rng.integers(1, 256, 511).tolist()), bytes(rng.integers(1, 256, 1900).tolist()), b"z" * 512]
    raw, start, end, first = convnet.cut_up(texts)
    top = net.strongest(convnet.chunk_bytes(raw, start, end))
    for i, t in enumerate(texts):
        own = np.frombuffer(t, np.uint8)
        n = max(1, -(-len(t) // convnet.CHUNK)) * convnet.CHUNK
        padded = np.concatenate([own, np.zeros(n + convnet.WIDTH - len(t), np.uint8)])
        win = np.stack([net.p["embed"][padded[j : j + convnet.WIDTH]].reshape(-1) @ net.p["conv"] for j in range(n)])
        assert np.allclose(top[first[i] : first[i + 1]].max(axis=0), win.max(axis=0), atol=1e-4)
    assert np.allclose(net.score(texts), [net.score([t])[0] for t in texts], atol=1e-5)


def test_network_gradients_are_right():
    net = convnet.Net()
    texts, y = [b"one two", b"ab" * 400, b"###"], np.array([1, 0, 1], np.float32)
    raw, start, end, first = convnet.cut_up(texts)
    b = convnet.chunk_bytes(raw, start, end)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.pooled(net.strongest(b), first) @ net.p["out"] + net.p["shift"][0]
        return float(np.mean(np.log1p(np.exp(-z * (2 * y - 1)))))

    g = net.gradients(b, first, y)
    for name, at in (("out", (3,)), ("out", (30,)), ("shift", (0,)), ("bias", (5,)), ("conv", (10, 4)), ("embed", (ord("a"), 2)), ("embed", (ord("#"), 1))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert np.isclose((up - down) / 2e-5, g[name][at], rtol=0.02, atol=1e-5), (name, at)


def test_classifier_on_hostile_tables(spark):
    rows = [(i, "clean words stand here, one by one. " * (1 + i % 7) if i % 3 else "$$$ bad%%% &&&junk " * (1 + i % 5)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "clean words " * 40_000), (0, "a copy of an id"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, 9.0, 1, 1, True) for i, t in rows], "doc_id bigint, text string, score double, y int, quality int, held_out boolean").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(900, 1), (5, None), (None, 1), (7, 3)], "doc_id bigint, quality int")
    got = convnet.classify(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        if r.doc_id and r.doc_id < 60:
            assert r.predicted == int(r.doc_id % 3 > 0)
    one = convnet.classify(docs, labels.where("quality = 1")).select("score").distinct().collect()
    assert len(one) == 1 and 0.9 < one[0].score < 1
    assert convnet.classify(docs.where("false"), labels).count() == 0
    assert convnet.classify(docs, labels.where("false")).select("score").distinct().collect() == [(0.5,)]


@pytest.mark.skipif(not os.path.isdir(f"{BASE}/sf0.01"), reason="test tables are not here")
def test_classifier_query_on_held_out_rows(spark):
    out = queries.QUERIES["op12_quality_classifier"](spark, f"{BASE}/sf0.01")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 1000
    seen = out.join(spark.read.parquet(f"{BASE}/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    clean = [r.predicted for r in seen if r.quality == 1]
    bad = [r.predicted for r in seen if r.quality == 0]
    assert len(seen) > 50 and np.mean(clean) >= 0.98 and np.mean(bad) <= 0.3
