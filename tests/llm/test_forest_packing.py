"""Random-projection forest against brute force, and packing against its rules."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tickloom.llm import packing, queries, rp_forest


def brute(vectors):
    """{row: (links, component)} over (id, vector) rows."""
    ok = {}
    for k, (_, v) in enumerate(vectors):
        if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[k] = x / np.linalg.norm(x)
    root = list(range(len(vectors)))
    links = [0] * len(vectors)
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ok:
        for b in ok:
            if a < b and ok[a] @ ok[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    low = defaultdict(lambda: math.inf)
    for k, (i, _) in enumerate(vectors):
        low[find(k)] = min(low[find(k)], i)
    return [(i, links[k], low[find(k)]) for k, (i, _) in enumerate(vectors)]


def test_forest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 8))
    rows = [v for v in base] + [b + rng.normal(scale=0.05, size=8) for b in base[:40] for _ in range(2)] + [base[0] + rng.normal(scale=0.02, size=8) for _ in range(120)] + [base[1]] * 60
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    vectors += [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (906, []), (5, vectors[5][1]), (907, [x * 4 for x in vectors[7][1]])]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in vectors], "vec_id long, embedding array<float>, links long, key string")
    exp = sorted(brute(vectors))
    assert sorted(map(tuple, rp_forest.near_groups(df).collect())) == exp
    # real splits, and leaves that a small sample leaves too large
    for kw in ({"leaf": 60}, {"leaf": 60, "large": 80, "sample_rows": 30}):
        got = sorted(map(tuple, rp_forest.near_groups(df, trees=10, spill=0.1, **kw).collect()))
        assert sum(g[1] for g in got) >= 0.95 * sum(e[1] for e in exp) and all(g[1] <= e[1] for g, e in zip(got, exp)), kw
    assert rp_forest.near_groups(df.limit(0)).count() == 0
    assert rp_forest.near_groups(df.filter("vec_id >= 900 and vec_id < 907")).count() == 7


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    exp = {r.vec_id: int(n) for r, n in zip(rows, np.concatenate([(x[i:i + 500] @ x.T >= 0.95).sum(1) - 1 for i in range(0, len(x), 500)]))}
    got = {r.vec_id: r.n_links for r in rp_forest.near_groups(df).collect()}
    assert all(got[i] <= n for i, n in exp.items()) and sum(got.values()) >= 0.9 * sum(exp.values())


def test_best_fit_is_the_tightest():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randrange(1, 60) for _ in range(120)]
        out = packing.best_fit(lengths, 64)
        room, exp = [], []
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fit = [r for r in room if r >= lengths[k]]
            if fit:
                room[room.index(min(fit))] -= lengths[k]
            else:
                room.append(64 - lengths[k])
        assert sorted(64 - sum(lengths[k] for k in w) for w in out) == sorted(room)
        assert sorted(k for w in out for k in w) == list(range(120))


def test_pieces(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta's", "über", "12", "\n"]) for _ in range(rng.randrange(0, 3000))) for _ in range(60)] + [None, "", "<|endoftext|>", "word " * 2047, "a" * 9000]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    for hold in (4096, 8):
        pieces = packing.pack(df, path, 1, hold=hold).collect()
        by, seqs = defaultdict(list), defaultdict(list)
        for p in pieces:
            by[p.doc_id].append(p)
            seqs[p.sequence_id].append(p)
        for i, t in enumerate(texts):
            ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
            copies = 2 if i == 0 else 1
            got = sorted((p.start, p.length, p.ids, p.doc_tokens) for p in by[i])
            assert sum(p[1] for p in got) == copies * len(ids) and all(p[3] == len(ids) for p in got)
            for start, n, raw, _ in got:
                assert np.frombuffer(raw, "<u4").tolist() == ids[start:start + n]
        for s in seqs.values():
            at = 0
            for p in sorted(s, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048
        total = sum(p.length for p in pieces)
        assert len(seqs) <= total / 2048 * 1.1 + 3 * 2
    d = packing.digest(packing.pack(df, path, 1)).filter("doc_id = 61").collect()
    assert [(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in d] == [(0, 1, zlib.crc32((1).to_bytes(4, "little")), 1)]
    assert packing.pack(df.limit(0), path, 1).count() == 0
