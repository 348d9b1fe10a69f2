"""Registered queries of this folder, and the pipeline, over the smallest tables."""

import base64
import collections
import glob
import hashlib
import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from altigrid.llm import queries

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, BASE)
    cur = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, cur.fetchall()))


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input; the decisions of the first three are recomputed in plain Python."""
    from altigrid.llm import minhash
    from altigrid.model import cut

    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    seen = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, BASE))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == seen["start"].columns
    clean = {r.doc_id for r in spark.read.parquet(f"{BASE}/labels.parquet").where("quality = 1").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{BASE}/labels.parquet").where("quality = 0").collect()}
    passed = {r.doc_id for r in seen["quality rules"].collect()}
    assert clean <= passed and len(bad & passed) <= 0.1 * len(bad)
    sets = {r.doc_id: minhash.shingles(r.text, 5) for r in seen["line dedup"].collect()}
    kept = {r.doc_id for r in seen["near duplicates"].collect()}
    groups = {}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and minhash.similar(sets[a], sets[b], 80):
                x, y = sorted((groups.get(a, a), groups.get(b, b)))
                groups.update({k: x for k in [*[k for k, v in groups.items() if v == y], y]})
    assert kept == {d for d in sets if groups.get(d, d) == d}
    assert {r.doc_id for r in seen["packing"].collect()} == kept
    total = corpus_pipeline.run(spark, BASE)
    assert total.selectExpr("sum(length)").first()[0] == seen["packing"].selectExpr("sum(length)").first()[0]


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def word_ids(texts):
    """Ids of every whole text by the library itself, with the end id."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for i, t in texts}


def test_token_files_query(spark, word_ids):
    at, want = 0, []
    for i, a in word_ids.items():
        want.append((i, at, len(a), zlib.crc32(a.tobytes())))
        at += len(a)
    out = queries.QUERIES["op4_token_files"](spark, BASE).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in out.collect()) == want


def test_packing_query(spark, word_ids):
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.QUERIES["op10_packing"](spark, BASE).collect():
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert by.keys() == word_ids.keys()
    for i, a in word_ids.items():
        at = 0
        for p in sorted(by[i], key=lambda r: r.start):
            assert p.start == at and p.doc_tokens == len(a) and p.ids_crc32 == zlib.crc32(a[at : at + p.length].tobytes())
            at += p.length
        assert at == len(a)
    fills = []
    for k in sorted(seq):
        at = 0
        for p in sorted(seq[k], key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        fills.append(at)
    assert set(fills[:-1]) <= {2048} and fills[-1] <= 2048


def test_byte_bpe_query(spark, texts):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in texts:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(tuple(r) for r in queries.QUERIES["op7_byte_bpe"](spark, BASE).collect()) == want


def test_nearest_query(spark, duck):
    import numpy as np

    rows = [(i, np.array(e, np.float64)) for i, e in duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()]
    ids, all_vectors = np.array([i for i, _ in rows]), np.stack([e for _, e in rows])
    found, right, total = collections.defaultdict(list), 0, 0
    for r in queries.QUERIES["op8_nearest_neighbours"](spark, BASE).collect():
        found[r.query_id].append(r)
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    for q, own in found.items():
        d = np.sqrt(((all_vectors - all_vectors[ids == q]) ** 2).sum(axis=1))
        near = [i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - d[ids == r.vec_id][0]) < 1e-9 for r in own)
        right += len(set(near) & {r.vec_id for r in own})
        total += 10
    assert right >= 0.9 * total
