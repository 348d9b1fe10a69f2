"""Operators against brute force on small hostile tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
vocab = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, _k bigint"
WORDS = ["alpha", "Beta", "gamma,", "délta", "ÉPSILON", "zeta.", "the", "x1y2", "###", "don't", "中文字", "a|b", "straße", "IV", "½"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


def hostile():
    """(doc_id, text): nulls, blanks, ties, copies, near copies, shared lines and passages, one long text."""
    rng = random.Random(5)
    line = "This very line is shared by many documents of the table, word by word."
    passage = prose(rng, 45)
    base = prose(rng, 300)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b "), (3, "one"), (4, "two words"), (5, "İ ﬁ <|endoftext|>  nbsp ́x"), (6, "\n\n\n")]
    rows += [(10 + i, base if i < 3 else " ".join(w if rng.random() > 0.01 else "changed" for w in base.split(" "))) for i in range(8)]
    rows += [(30 + i, f"{prose(rng, 20)}\n  {line.upper() if i % 2 else line}\t\n{prose(rng, 25)} {passage if i % 3 == 0 else ''}") for i in range(12)]
    rows += [(50 + i, prose(rng, rng.randrange(1, 120))) for i in range(20)]
    rows += [(80, prose(rng, 6000)), (81, "same word " * 90), (82, "ALL CAPS!! " * 60), (83, " ".join("".join(rng.choice("aeinrst") for _ in range(7)) for i in range(90))), (10, base)]  # the last repeats a row
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), 7, 9) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return hostile()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def split(t):
    return (t or "").encode().split()


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def repeat_words(w):
    g = collections.defaultdict(list)
    for i in range(len(w) - 2):
        g[tuple(w[i : i + 3])].append(i)
    return len({i + j for p in g.values() if len(p) > 1 for i in p for j in range(3)})


def test_quality_counts(docs, rows, empty):
    from altigrid.llm import quality

    order = quality.cascade_order(docs)
    assert sorted(order) == sorted(quality.rules(F.lit(""), F.array()))
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.profile(docs, order).collect())
    want = []
    for i, t in rows:
        w = split(t)
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        rep = repeat_words(w)
        want.append((i, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert got == sorted(want)
    kept = {r.doc_id: r.kept for r in quality.profile(docs, order).collect()}
    assert not kept[81] and not kept[82] and kept[83]
    # the order of the rules never changes which documents pass
    other = {r.doc_id: r.kept for r in quality.profile(docs, order[::-1]).collect()}
    assert kept == other
    assert quality.profile(empty).count() == 0 and quality.judge(docs, order).columns == [*docs.columns, "rejected_by"]


def test_order_is_rejection_per_cost():
    from altigrid.llm.quality import order_of

    assert order_of({"slow": (4.0, 0.5), "fast": (0.1, 0.1), "idle": (0.1, 0.0)}) == ["fast", "slow", "idle"]


def drop_lines(rows):
    key = lambda x: x.encode().strip().lower()
    holders = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k.decode()) >= 40:
                holders[k].append(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def test_line_dedup(docs, rows, empty):
    from altigrid.llm import lines

    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = drop_lines(rows)
    assert sum(n for _, _, n, _ in want) > 5
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == sorted(want)
    assert lines.dedup_lines(empty).count() == 0


def test_line_dedup_over_many_shards_and_copies(spark, docs, rows, monkeypatch):
    from altigrid.llm import lines

    monkeypatch.setattr(lines, "SHARD_LOAD", 8)
    out = lines.dedup_lines(docs)
    assert sorted((r.doc_id, r.n_dropped) for r in out.collect()) == sorted((i, n) for i, _, n, _ in drop_lines(rows))


def test_line_dedup_null_ids(spark):
    from altigrid.llm import lines

    line = "a line of more than forty characters, which all of them hold"
    out = lines.dedup_lines(frame(spark, [(None, line), (1, line), (2, line), (3, line), (4, line)]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_dropped) for r in out.collect()) == [(-1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


@pytest.mark.parametrize("window", [5, 35])
def test_substring_dedup(docs, rows, empty, window):
    from altigrid.llm import substring

    seen = collections.Counter(tuple(w[i : i + window]) for _, t in rows for w in [split(t)] for i in range(len(w) - window + 1))
    want = []
    for i, t in rows:
        w = split(t)
        gone = {a + j for a in range(len(w) - window + 1) if seen[tuple(w[a : a + window])] > 1 for j in range(window)}
        want.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    out = substring.dedup_substrings(docs, window)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()) == sorted(want)
    assert substring.dedup_substrings(empty).count() == 0


def test_equal_hashes_are_told_apart():
    from altigrid.llm import substring

    ids = np.array([1, 2, 3, 1, 2, 3, 4, 5, 6], np.int32)
    hit = substring.repeated(ids, np.array([0, 3, 6]), np.ones(3, int), 3)
    assert hit.tolist() == [True, True, False]


def test_minimisers_of_very_long_texts():
    """More words than a position has bits for: equal windows early and late have equal minimiser hashes."""
    from altigrid.llm import substring

    g = np.random.default_rng(2).integers(0, 1 << 63, (1 << 24) + 5_000, dtype=np.uint64)
    g[-200:] = g[:200]
    low = substring.minimisers(g, 32) >> np.uint64(substring.POSITION)
    assert len(low) == len(g) - 31 and (low[-169:] == low[:169]).all()
    for a in (0, (1 << 24) - 300, len(low) - 300):
        want = np.lib.stride_tricks.sliding_window_view(g[a : a + 331], 32).min(axis=1) >> np.uint64(substring.POSITION)
        assert (low[a : a + 300] == want).all()


def jaccard(a, b):
    return len(a & b), len(a | b)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, empty, words, percent):
    from altigrid.llm import minhash

    node = {}
    for i, t in rows:
        node[i] = minhash.shingles(t, words)
    up = {i: i for i in node}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in node:
        for b in node:
            if a < b and node[a] and 100 * len(node[a] & node[b]) >= percent * len(node[a] | node[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, words, percent).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in node.items()}
    assert len({root(i) for i in range(10, 18)}) < 8
    assert minhash.near_duplicates(empty).count() == 0


def test_pigeonhole_finds_every_pair_in_reach():
    from altigrid.llm import minhash

    d = minhash.reach(0.85)
    bounds = minhash.chunk_bounds(d)
    assert bounds[0][0] == 0 and bounds[-1][1] == minhash.SYMBOLS and d // len(bounds) <= 1
    rng = np.random.default_rng(1)
    for _ in range(200):
        wrong = rng.choice(minhash.SYMBOLS, d, replace=False)
        assert any(((wrong >= a) & (wrong < b)).sum() <= 1 for a, b in bounds)


def test_components_of_a_long_chain(spark):
    from altigrid.llm import minhash

    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100), (100, 200)], "a bigint, b bigint")
    got = {r.id: r.comp for r in minhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}


def test_near_copies_that_only_meet_through_others(spark):
    """A drifting chain: neighbours are similar, ends are not; all are one component."""
    from altigrid.llm import minhash

    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 4 * i] and [f"v{j}" for j in range(4 * i)]) + " " + " ".join(base[4 * i :])) for i in range(12)]
    random.Random(2).shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert set(got.values()) == {0}


def ids_of(rows):
    tok = tokenizers.Tokenizer.from_file(vocab.path("word_bpe_49k.json"))
    return [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in rows]


def test_token_files(spark, docs, rows, empty):
    from altigrid.llm import tokens
    from altigrid.model import scratch_path

    path = vocab.path("word_bpe_49k.json")
    folder = scratch_path(spark, "t")
    tokens.write_blocks(docs, folder, path)
    got = sorted(tokens.read_blocks(spark, folder).collect(), key=lambda r: r.start)
    want = ids_of(sorted(rows, key=lambda r: r[0]))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert sorted(zlib.crc32(bytes(r.ids)) for r in got) == sorted(zlib.crc32(a.tobytes()) for _, a in want)
    assert tokens.fetch(spark, folder, 80).first().ids == dict((i, a.tolist()) for i, a in want)[80]
    assert tokens.round_trip(empty, path).count() == 0


def test_word_encoder_folds_like_the_library():
    from altigrid.llm import tokens

    e = tokens.WordEncoder(vocab.path("word_bpe_49k.json"))
    rng = np.random.default_rng(7)
    pool = [*map(chr, range(0x21, 0x530)), "\u0301", "\u1e9e", "\u2028", "\u4e00", "\uac00", "\U0001f600", "'s", "'LL", "<|", "|>", "the", *"   "]
    texts = ["T\u0308 H\u0331 x", "<|ENDOFTEXT|> a<|endoftext|>b CAN'T", "CAN'T can't''s d'd", "", " \t", " a\x85b\u00a0c\x1cd ", "\u0130\u0130 \u03a3\u03b1\u03a3"]
    texts += ["".join(rng.choice(pool, 60)) for _ in range(500)]
    for x, ids in zip(texts, e.encode([t.encode() for t in texts]), strict=True):
        assert ids.dtype == np.uint32 and ids.tolist() == e.tok.encode(x, add_special_tokens=False).ids, ascii(x)


def test_packing(docs, rows, empty):
    from altigrid.llm import packing

    path = vocab.path("word_bpe_49k.json")
    got = packing.pack(docs.where("doc_id <> 10"), path, length=128).collect()
    want = dict((i, a) for i, a in ids_of(rows) if i != 10)
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, a in want.items():
        parts = sorted(by[i], key=lambda r: r.start)
        assert [x for p in parts for x in p.ids] == a.tolist() and all(p.doc_tokens == len(a) for p in parts)
        assert all(zlib.crc32(a[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in parts)
    fills = []
    for parts in (seq[k] for k in sorted(seq)):
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        fills.append(sum(p.length for p in parts))
    assert set(fills[:-1]) == {128} and sorted(seq) == list(range(len(seq)))
    assert packing.pack(empty, path).count() == 0


def test_hilbert_curve_visits_neighbours():
    from altigrid.llm.packing import hilbert_key

    side = 8
    for dims in (2, 3):
        pts = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T
        key = hilbert_key(pts, 3)
        assert sorted(key.tolist()) == list(range(side**dims))
        steps = np.abs(np.diff(pts[np.argsort(key)], axis=0)).sum(axis=1)
        assert set(steps.tolist()) == {1}


def test_byte_bpe(docs, rows, empty):
    tiktoken = pytest.importorskip("tiktoken")
    from altigrid.llm import bpe

    path = vocab.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs, path, vocab.PATTERN), path, vocab.PATTERN)
    got = sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in out.collect())
    assert got == sorted((i, enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert bpe.encode(empty, path, vocab.PATTERN).count() == 0
    c = bpe.codec(path, vocab.PATTERN)
    for x in ("aaaaaaaaaaaaaaaaaaaaaaaaa", "abababababababab" * 40, "🙂🙂", "\x00\xff"):
        assert np.frombuffer(c.encode([x])[0], np.int32).tolist() == enc.encode_ordinary(x)


def test_perfect_hash():
    from altigrid.llm.arrays import PerfectHash

    keys = np.random.default_rng(0).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    h = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert PerfectHash.build(keys[:0]).slots(keys).max() == -1


def test_neighbours(spark):
    from altigrid.llm import ann

    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 12)).astype("float32")
    x[100:160] = x[99]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, x[0].tolist()), (1000, None), (1100, [0.0] * 12), (1200, [float("nan")] * 12), (1300, [1.0] * 5), (1400, [None] + [1.0] * 11), (1500, [])]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(e, e.where("vec_id % 100 = 0"), 10, per_block=256).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 100))
    x, hit = x.astype("float64"), 0
    for q in got:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        hit += len({i for i, _ in got[q]} & set(want.tolist()))
        assert len(got[q]) == 10 and all(abs(s - d[i]) < 1e-12 for i, s in got[q])
    assert hit >= 0.95 * 10 * len(got)
    assert [i for i, _ in got[100]] == [i for i in range(99, 111) if i != 100][:10]
    assert ann.nearest(e.limit(0), e.limit(0)).count() == 0


def test_personal_data(spark, empty):
    from altigrid.llm import pii

    texts = ["mail a.b+c@d-e.org, x@y and @z.com", "ip 10.0.0.255 not 10.0.0.256, 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111 1111 1111 1112",
             "call +1 (255) 555-8013 or +12", 'é token = "1eb9c654e721b4f81208aa11" end', "password=hunter22x9", "+1 (3) a@b.c@d.e", "call 255-555-8013 now", "", None, "9" * 5000, "a" * 3000 + "@b.co"]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    docs = frame(spark, rows)
    model = pii.train(docs)
    got = {r.doc_id: r for r in pii.digest(pii.find(docs, model)).collect()}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    fits = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    for i, t in rows:
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t or "") if fits[k](m[0])]
        assert got[i].base_sha256 == sha(",".join(base)) and set(base) <= set(got[i].spans.split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in patterns] == [sum(b.startswith(k) for b in base) for k in patterns]
    assert "secret" in got[4].spans and "secret" in got[5].spans
    out = {r.doc_id: r.text for r in pii.mask(docs, model).collect()}
    assert out[3] == "call [PHONE] or +12" and out[9] is None and "1eb9" not in out[4]
    assert pii.find(empty).count() == 0 and pii.mask(docs, model).columns == docs.columns


def test_long_secrets_are_whole(spark):
    """Tokens of any length are one span, and nothing of them is left in the text, base spans inside or not."""
    from altigrid.llm import pii

    rng = random.Random(3)
    token = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ_") + rng.choice("0123456789") for _ in range(500))
    card = f"{token[:600]}x4111111111111111x{token[600:]}"
    plain = [(i, f"the token = {token[i:i + 24]} is set") for i in range(20)]
    docs = frame(spark, [(100, f"use token={token} here"), (101, f"use token={card} here"), *plain])
    model = pii.train(docs)
    got = {r.doc_id: r.spans for r in pii.find(docs, model).where("doc_id >= 100").collect()}
    assert [(x.kind, x.start, x.end) for x in got[100]] == [("secret", 10, 1010)]
    assert [(x.kind, x.start, x.end) for x in got[101]] == [("card", 611, 627), ("secret", 10, 611), ("secret", 627, 1028)]
    out = {r.doc_id: r.text for r in pii.mask(docs, model).collect()}
    assert out[100] == "use token=[SECRET] here" and out[101] == "use token=[SECRET][CARD][SECRET] here"
    # the features are those of the whole span
    c = next(x for x in pii.candidates("token=" + "a" * 64 + token) if x.kind == "secret")
    assert pii.features("token=" + "a" * 64 + token, c)[2:5:2] == (3, 1)


def test_spelled_emails_are_candidates():
    """The same as the plain pattern on every text, whatever else the text holds."""
    from altigrid.llm import pii

    pattern = re.compile(r"\b[A-Za-z0-9._%+-]+(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]+(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]+)+")
    spelled = ["jane.doe at example.com", "jane at example (dot) com", "jane at example[dot]com", "jane (at) example.com", "jane[at]example dot com", "jane (at] a (dot] b.c"]
    for t in spelled:
        for before in ("", "write to ", "(cat) and "):
            found = [(c.kind, c.start, c.end) for c in pii.candidates(before + t)]
            assert found == [("email", len(before), len(before + t))]
    rng = random.Random(6)
    parts = ["a", "b-c", "é", ".", "-", " ", "  ", " at ", "(at)", "[at]", " (at) ", "(at ", " at)", " dot ", "(dot)", " [dot] ", "x.y", "_", "@", "at", "\n", "%"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert list(pii.loose_emails(t)) == [m.span() for m in pattern.finditer(t)], t


def test_pipeline_rejects_short_repetitive_texts(spark):
    import corpus_pipeline

    rng = random.Random(4)
    texts = ["buy now " * 24, "take this offer " * 13 + "now", "one two three one two three", "one two", "fine", " ".join(f"{rng.choice('abcdefg') * 4}{i}" for i in range(40)), "a short clean text of nine words stays here"]
    out = corpus_pipeline.quality_rules(spark, frame(spark, list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 6]


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Rows read in twice, null ids beside and without a copy that has an id, near copies of either."""
    import corpus_pipeline

    rng = random.Random(9)
    text = [" ".join(f"{rng.choice('abcdefg')}{rng.randrange(10_000)}" for _ in range(120)) for _ in range(6)]
    near = lambda t: t.rsplit(" ", 1)[0] + " changed"
    rows = [(1, text[0]), (1, text[0]), (2, text[1]), (None, text[1]), (None, text[2]), (None, text[2]), (3, near(text[2])), (None, text[3]), (None, near(text[3])),
            (4, text[4]), (4, text[5]), (5, near(text[5])), (4, text[4]), (6, ""), (None, None)]
    docs = frame(spark, rows).repartition(4)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    got = [(r.doc_id, r.text) for r in out.collect()]
    last = [g for g in got if g[0] is None and g[1]]
    assert len(last) == 1 and last[0][1] in (text[3], near(text[3])) and out.columns == docs.columns
    want = [(1, text[0]), (2, text[1]), (3, near(text[2])), last[0], (4, text[4]), (4, text[5]), (6, ""), (None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_chat_round_trip(spark):
    from altigrid.llm import chat

    rng = random.Random(8)
    nasty = ["\\### Assistant: </turn> ok", "\\h\\b\\\\", "### user: </turn>\n", "", None, "a:b # < \\", "é中" * 30]
    rows = [(1, i, ["system", "user", "assistant"][0 if i == 0 else 1 + (i + 1) % 2], rng.choice(nasty) if i % 3 else prose(rng, rng.randrange(1, 200))) for i in range(60)]
    rows += [(2, 0, "assistant", "x " * 9000), (2, 0, "assistant", "x " * 9000), (3, None, None, None), (None, 1, "user:<#\\", "q"), (None, 2, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    w = chat.windows(turns, budget=200, history=60)
    got = {r.conv_id: r for r in chat.digest(w).collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for c, own in by.items():
        own = sorted(((-1 if t is None else t, r or "", x or "") for _, t, r, x in own))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    many = w.where("conv_id = 1").orderBy("first_turn").collect()
    assert len(many) > 3 and all(r.formatted.startswith("### system" + ": ") for r in many)
    assert all(r.n_repeated >= 1 for r in many[1:])
    lone = [r for r in many if len(r.formatted.split(chat.CLOSE)) - 1 - r.n_repeated > 1]
    assert all(r.n_tokens <= 200 + 60 for r in lone)
    assert chat.windows(turns.limit(0)).count() == 0


CLASHES = ["_k1", "_k2", "_row", "_gone", "_fixed", "_spans", "_kept", "_words_", "_key", "h1", "rep", "line"]


@pytest.fixture(scope="module")
def clashing(spark, rows):
    """The hostile rows, some with a null id, under columns named like those the operators make on their way."""
    extra = [(None, rows[7][1]), (None, None), (None, rows[20][1])]
    df = spark.createDataFrame([(i, t, *range(len(CLASHES))) for i, t in rows + extra], "doc_id bigint, text string, " + ", ".join(f"`{c}` int" for c in CLASHES))
    return df.repartition(3)


def test_input_columns_may_have_any_name(spark, clashing):
    from altigrid.llm import lines, quality, substring

    plain = clashing.select("doc_id", "text")

    def rows_of(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    for run in (lines.dedup_lines, substring.dedup_substrings, lambda d: quality.judge(d, list(quality.rules(F.col("text"), F.array())))):
        wide, slim = run(clashing), run(plain)
        assert [c for c in wide.columns if c in CLASHES] == CLASHES
        assert rows_of(wide.select(slim.columns)) == rows_of(slim)
        assert wide.select(CLASHES).distinct().collect() == [tuple(range(len(CLASHES)))]


def test_near_duplicates_do_not_depend_on_row_order(spark):
    """One id with two texts: a third text is linked with the one it is near to, in any order; null ids name nothing."""
    from altigrid.llm import minhash

    rng = random.Random(3)
    a, b, c = prose(rng, 200), prose(rng, 200), prose(rng, 150)
    near = b.split(" ")
    near[100] = "changed"
    table = [(1, a), (1, b), (2, " ".join(near)), (None, b), (None, c), (None, c), (3, a), (None, None)]
    seen = []
    for rows in (table, table[::-1], table[3:] + table[:3]):
        out = minhash.near_duplicates(frame(spark, rows).coalesce(1), words=3, percent=85).collect()
        seen.append(sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out), key=repr))
    assert seen[0] == seen[1] == seen[2]
    assert {(d, k) for d, n, k, _ in seen[0] if n} == {(1, 1), (2, 1), (3, 1), (None, 1), (None, None)}


def test_substrings_of_many_equal_rows(spark):
    from altigrid.llm import substring

    text = prose(random.Random(8), 80)
    out = substring.dedup_substrings(frame(spark, [(1, text)] * 3000 + [(2, "short")]))
    assert {(r.doc_id, r.n_removed) for r in out.select("doc_id", "n_removed").distinct().collect()} == {(1, 80), (2, 0)} and out.count() == 3001


def test_curve_keys_follow_words_not_length():
    from altigrid.llm import packing

    rng = random.Random(4)
    text = prose(rng, 60).encode()
    assert len(set(packing.curve_keys([text, text + b" " + text, b" ".join([text] * 40)]).tolist())) == 1
    assert packing.curve_keys([b"", b" \n"]).tolist() == [0, 0]
