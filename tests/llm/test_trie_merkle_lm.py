"""Prefix trie, Merkle manifest and language-model scores against brute force on small rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import common as C, lm, merkle, trie

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- trie ---------------------------------------------------------------------------------

def brute_trie(rows, every=100, modulus=6):
    """rows (conv, turn, role, text) with no two of a conversation at one turn."""
    own = collections.defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % modulus
        full[c] = tuple(own.get(c - c % every, [])[:h] + own[c][h:])
    nodes = collections.defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = lambda k: ",".join(str(c) for c in sorted(nodes[k]) if len(full[c]) == len(k))
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in nodes.items())


def listed(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


CONV = "conv_id long, turn long, role string, text string, key string, parent long, comp string, pos int"


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(60), *range(200, 230), 299, 301, 402]:
        long = c in (7, 205)
        same = c % 3 == 0  # a hot group of equal conversations
        n = 70 if long else 4 if same else rng.randrange(1, 8)
        for t in range(n):
            text = f"turn {t}" if same or rng.random() < 0.5 else rng.choice(["a", "Überlänge", "", None, "b b"])
            rows.append((c, None if t == 0 and c % 5 == 0 else t, rng.choice(["user", None]) if not same else "user", text))
    rows += [(None, 0, "user", "of no conversation"), (500, 0, "", ""), (503, 0, None, None)]
    return rows


@pytest.mark.parametrize("most,chunk", [(20_000, 1024), (5, 4)])
def test_prefix_trie(spark, conversations, monkeypatch, most, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    df = spark.createDataFrame([(*r, "x", 1, "y", 0) for r in conversations], CONV)
    assert listed(trie.prefix_trie(df, most=most)) == brute_trie(conversations)


def test_trie_of_nothing_and_of_repeated_rows(spark):
    empty = spark.createDataFrame([], CONV)
    assert trie.prefix_trie(empty).count() == 0
    one = spark.createDataFrame([(0, 1, "u", "x")] * 3, "conv_id long, turn long, role string, text string")
    assert [(r.depth, r.n_convs, r.n_leaves) for r in trie.prefix_trie(one).orderBy("depth").collect()] == [(d, 1, 1) for d in range(4)]


def test_centroids_give_subtree_sums():
    rng = random.Random(1)
    for n, shape in ((1, 1), (300, 1), (300, 5), (300, 300)):  # from a chain to a star
        parent = [-1] + [max(0, i - rng.randint(1, shape)) for i in range(1, n)]
        parent[n // 2] = -1
        own = [rng.randrange(9) for _ in range(n)]
        want = own[:]
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
        got = [own[:]]
        trie._finish(parent, got)
        assert got[0] == want


# --- manifest -----------------------------------------------------------------------------

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def brute_manifest(rows, fan):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(show(r[c]) for c in FIELDS))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i:i + fan])) for i in range(0, len(out[-1]), fan)])
        return out

    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for k in keys}
    trees = {k: levels([leaf(r) for r in own[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for at, k in enumerate(keys):
        for i, r in enumerate(own[k]):
            now, sib = r, ""
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                now = {**r, "text": r["text"].translate(LOW)}
            cur = leaf(now)
            for tree, j in ((trees[k], i), (top, at)):
                for nodes in tree[:-1]:
                    a = j // fan * fan
                    left, right = "".join(nodes[a:j]), "".join(nodes[j + 1:a + fan])
                    sib, cur, j = sib + left + right, H(left + cur + right), j // fan
            out.append((str(r["doc_id"]), trees[k][0][i], trees[k][-1][0], top[-1][0], H(sib), cur))
    return sorted(out)


def manifest(df, fan, depth):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.leaves(df, FIELDS, changed={"text": F.translate("text", merkle.UPPER, merkle.UPPER.lower())}, where=hit)
    return sorted((str(r[0]), *r[1:]) for r in merkle.manifest(rows, fan, depth).collect())


@pytest.mark.parametrize("fan,depth,langs", [(8, 4, 3), (2, 1, 11), (3, 0, 30)])
def test_manifest(spark, fan, depth, langs):
    rows = [{"doc_id": i, "source": None if i % 7 == 0 else f"s{i % 3}", "lang": "hot" if i % 3 == 0 else None if i % 11 == 0 else f"l{i % langs}é", "n_chars": i, "text": None if i % 13 == 0 else f"Text {i} Ä"} for i in range(150)]
    rows += [{"doc_id": None, "source": "s", "lang": "hot", "n_chars": None, "text": "no id"}, dict(rows[20]), dict(rows[20]), {**rows[20], "text": ""}]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"g": F.lit(1), "id": F.lit("x"), "leaf": F.lit(0), "block": F.lit(2)})
    assert manifest(df, fan, depth) == brute_manifest(rows, fan)


def test_manifest_of_nothing_and_of_one_row(spark):
    one = spark.createDataFrame([(1, "s", "en", 4, "Text")], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(one.limit(0), 8, 4) == []
    got = manifest(one, 8, 4)
    assert got == brute_manifest([r.asDict() for r in one.collect()], 8) and got[0][1] == got[0][2] == got[0][3]


# --- language model -----------------------------------------------------------------------

def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


def brute_lm(rows, train, mu=500.0):
    one, two = collections.Counter(), collections.Counter()
    for i, t in rows:
        if train(i):
            ts = tokens(t)
            one.update(ts)
            two.update(zip([0, *ts[:-1]], ts))
    n, v = one.total(), len(one)
    out = []
    for i, t in rows:
        ts = tokens(t)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ts)
        score = sum(math.log10((two[u, w] + mu * (one[w] + 1) / (n + v + 1)) / ((one[None] if u == 0 else one[u]) + mu)) for u, w in zip([0, *ts[:-1]], ts))
        out.append((str(i), len(ts), sum(one[w] > 0 for w in ts), n, base, score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["Über", "THE", "the", "x" * 90, "naïve joined"]
    rows = [(i, rng.choice(["  ", ""]) + "\t\n ".join(rng.choice(words[:12] if i % 2 else words) for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (None, "no id the"), (202, "only here only here"), *[(300 + i, "a copied passage of some words") for i in range(50)], (7, "again"), (7, "again")]


def scored(spark, rows, train, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key", "segment", "_row")})
    model = lm.fit(df, train)
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df, model, **kw).collect())


def test_scores(spark, texts, monkeypatch):
    want = brute_lm(texts, lambda i: i is not None and i % 5 != 0)
    train = F.col("doc_id") % 5 != 0  # null for a null id: not learnt from
    got = scored(spark, texts, train)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-9 for g, w in zip(got, want))
    off = [abs(g[5] - w[5]) / w[1] for g, w in zip(got, want)]
    assert max(off) < math.log10(1.25) and all(g[5] <= 0 for g in got)  # a level stands for counts within a quarter of it
    assert all(abs(a[5] - b[5]) < 1e-9 for a, b in zip(got, scored(spark, texts, train, most_bytes=0)))  # segments in place of a broadcast
    monkeypatch.setattr(lm, "HOT", 5)  # most words go the way of rare ones
    cold = scored(spark, texts, train)
    assert [c[:4] for c in cold] == [g[:4] for g in got] and all(abs(a[4] - b[4]) < 1e-9 for a, b in zip(cold, got))


def test_nothing_to_learn_from(spark, texts):
    got = scored(spark, texts[:5], F.lit(False))
    assert all(g[2:5] == (0, 0, 0.0) for g in got)
    assert scored(spark, [], F.lit(True)) == []


def test_filter_never_forgets():
    import numpy as np

    rng = np.random.default_rng(0)
    key, n = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.geometric(0.2, 20_000)
    bits = np.zeros(lm.SEGMENT // 8, np.uint8)
    lm.insert(bits, key, lm.level(n))
    none = np.zeros(len(key), np.int64)
    assert (lm.probe(bits, key, none) >= lm.level(n)).all() and (lm.probe(bits, key, none) == lm.level(n)).mean() > 0.99
    assert (lm.probe(bits, key + np.uint64(1), none) == 0).mean() > 0.99
    value = lm.counts_of_levels()
    assert [float(value[lm.level(np.array([c]))[0]]) for c in (1, 2, 3)] == [1, 2, 3] and all(abs(value[lm.level(np.array([c]))[0]] / c - 1) < 0.25 for c in range(1, 5000))


def test_groups_of_segments_give_the_scores_of_the_whole_filter(spark):
    word = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.pmod(F.xxhash64(i, "id"), F.lit(40_000)) + 1).cast("string")))
    df = lm.C.stored(spark.range(0, 3_200, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text")).unionByName(spark.sql("select -1L as doc_id, cast(null as string) as text")), "texts")
    model = lm.fit(df, F.col("doc_id") % 7 != 2)
    assert model.count >= 3
    whole, groups = ({r.doc_id: r for r in lm.score(df, model, keep={"kept": F.col("doc_id") + 1}, most_bytes=most).collect()} for most in (1 << 30, lm.SEGMENT // 8 * 2))
    assert len(whole) == 3_201 and whole.keys() == groups.keys()
    for k, r in whole.items():
        assert r[:-1] == groups[k][:-1] and abs(r.score - groups[k].score) < 1e-9 * max(1, abs(r.score))


def test_pairs_are_packed_close(spark):
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2))
    key[1::2] = key[::2]
    text, one, before = rng.integers(0, 2_000, len(key)), rng.integers(0, 8, len(key)).astype(np.uint8), rng.integers(0, 8, len(key)).astype(np.uint8)
    data = lm.packed(key, text, one, before)
    k, times, *rest = lm.unpacked(data)
    assert np.repeat(k, times).tolist() == key.tolist() and [x.tolist() for x in rest] == [x.tolist() for x in (text, one, before)]
    assert len(data) < 7 * len(key)  # three hashes of 8 bytes a token before
