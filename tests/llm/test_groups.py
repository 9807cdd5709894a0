"""Exact dedup, SimHash, sharding and archives against brute force on small rows with nulls, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tickloom.llm import common as C, exact_dedup, sharding, simhash, warc

SCHEMA = "doc_id long, text string, n long, key string, fp string, root string, digest string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "Delta", "über", "x"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    near = [t + " " + rng.choice(words) for t in base[:15]]
    texts = base + near + [t.replace(" ", "\n \t") for t in base[:10]] + [None, "", " ", " ", "hot text"] + ["hot  text"] * 50 + ["w " * 20000]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(3, out[3][1]), (None, "hot text")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "f", "r", "d") for i, t in rows], SCHEMA).repartition(5)


def components(ids, pairs):
    root = {i: i for i in ids}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_exact_dedup(docs, rows, spark):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    exp = sorted(((i, min(x for x in g if x is not None), len(g), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows for g in [groups[norm(t)]]), key=str)
    got = exact_dedup.report(docs)
    assert sorted(map(tuple, got.drop("kept").collect()), key=str) == exp
    stays = sorted((r.doc_id, r.text_sha256) for r in got.filter("kept").collect())
    assert stays == sorted({(k, h) for _, k, _, h in exp})  # one row of each text, the smallest id
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, norm(r.text)) for r in kept.collect()) == sorted((min(x for x in g if x is not None), t) for t, g in groups.items())
    assert exact_dedup.report(docs.limit(0)).count() == 0


def test_digest_index_keeps_earlier_batches(docs, spark):
    path = C.shared_path(spark, "t-index")
    texts = lambda d: d.select(exact_dedup.normalised(F.col("text"))).distinct().count()
    first = docs.filter("doc_id < 30 or doc_id is null")
    exact_dedup.report(first, exact_dedup.DigestIndex(spark, path, 4)).count()
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert again.read().count() == texts(first)
    r = {x.doc_id: x for x in exact_dedup.report(docs.filter("doc_id >= 30"), again).collect()}
    assert r[55].keep_id == 0 and not r[55].kept  # row 55 is row 0 in other white space
    assert again.read().count() == texts(docs)
    plan = again.unseen(again.read())._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan


def test_index_keeps_its_number_of_buckets(spark):
    path = C.shared_path(spark, "t-index")
    batch = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert exact_dedup.report(batch, exact_dedup.DigestIndex(spark, path, 4)).filter("kept").count() == 200
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 7)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # the session's own number does not matter to an index that is there
    try:
        index = exact_dedup.DigestIndex(spark, path)
        assert index.buckets == 4
        assert exact_dedup.report(batch, index).filter("kept").count() == 0 and index.read().count() == 200
        more = batch.unionByName(spark.createDataFrame([(7, "new")], batch.schema))
        assert [(r.doc_id, r.text) for r in exact_dedup.keep_first(more, index).collect()] == [(7, "new")]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


REPEATS = [(3, "A A A"), (5, "A A A"), (5, "unique text of five words"), (9, "same"), (9, "same"), (None, "no id"), (None, "no id"), (None, None), (4, "")]


def test_rows_that_share_an_id_are_judged_by_their_text(spark, tmp_path):
    docs = spark.createDataFrame(REPEATS, "doc_id long, text string").withColumn("_gone", F.lit(1)).withColumn("row", F.lit("x"))
    want = [(3, "A A A"), (4, ""), (5, "unique text of five words"), (9, "same"), (None, "no id")]
    for d, table in ((docs, False), (C.stored(docs.repartition(3), "t-rows"), True)):
        for keep in (exact_dedup.keep_first, simhash.keep_one):
            got = keep(d, table=table)
            assert got.columns == docs.columns
            assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def brute_fp(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(docs, rows):
    fps = [brute_fp(t) for _, t in rows]
    ids = [i if i is not None else 10**9 for i, _ in rows]
    same = components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    small = {}
    for k, r in same.items():
        small[r] = min(small.get(r, 10**9), ids[k])
    exp = sorted((str(rows[k][0]), f"{fps[k]:016x}", small[same[k]]) for k in range(len(rows)))
    for most in (1024, 2):  # 2: nearly every key is cut again
        g = simhash.near_groups(simhash.fingerprints(docs), most=most)
        assert sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in g.collect()) == exp
    assert simhash.near_groups(simhash.fingerprints(docs.limit(0))).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_covering_masks_meet_every_pair():
    rng = random.Random(1)
    ms = simhash.masks(3)
    assert len(ms) == 15
    for _ in range(3000):
        diff = 0
        for i in rng.sample(range(64), 3):
            diff |= 1 << i
        assert any(not diff & m for m in ms)


def test_dense_ball(spark):
    rng = random.Random(2)
    c = rng.getrandbits(64)
    fps = {c} | {c ^ 1 << i for i in range(64)} | {c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    same = components(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    d = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in simhash.near_groups(d, most=16).collect()} == same


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)], "a long, b long")
    assert {r.node: r.root for r in C.components(e).collect()} == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_sharding(docs, rows, spark):
    out = sharding.place(docs, sharding.regular(8), sharding.regular(9), block_rows=3).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    size = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert all((r["size"], r.text_crc32) == size[r.doc_id] for r in out)
    many = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    n = {r.shard: r["count"] for r in sharding.place(many, sharding.regular(8), sharding.regular(9)).groupBy("shard").count().collect()}
    assert set(n) == set(range(8)) and all(4600 < x < 5400 for x in n.values())


def test_weights_move_only_what_they_must(spark):
    keys = spark.range(20000)
    a = sharding.regular(8)
    b = [(n, [(k, [(i, 3.0 if i == 5 else w) for i, w in s]) for k, s in r]) for n, r in a]
    d = keys.select(sharding.shard_of(F.col("id"), a).alias("x"), sharding.shard_of(F.col("id"), b).alias("y"))
    moved = {(r.x, r.y): r["count"] for r in d.filter("x <> y").groupBy("x", "y").count().collect()}
    assert moved and all(y in (4, 5, 6, 7) for _, y in moved) and all(y == 5 for (x, y) in moved if x in (4, 5))
    n = {r.y: r["count"] for r in d.groupBy("y").count().collect()}
    assert 5400 < n[5] < 6600


def test_warc(spark):
    html = [None, "", "<p>a</p>", "<p>a</p>", "é" * 50000, "<p>b</p>\r\n\r\nx", "<p>b</p>\r\n\r\nx"] + ["same"] * 60
    rows = [(i, f"http://h/{i}" if i % 3 else None, h, "z") for i, h in enumerate(html)] + [(2, "http://again", "<p>a</p>", "z"), (None, None, "same", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)
    folder = C.shared_path(spark, "t-warc")
    for least in (0, 5):
        index = warc.write(pages, folder, least)
        got = sorted(map(tuple, warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
        first = {}
        for i, _, h, _ in rows:
            if i is not None:
                first[h or ""] = min(first.get(h or "", i), i)
        exp = []
        for i, _, h, _ in rows:
            b = (h or "").encode()
            again = len(b) >= least and first[h or ""] != i
            exp.append((i, len(b), warc.sha1_base32(b), "revisit" if again else "response", first[h or ""] if again else None))
        assert got == sorted(exp, key=str)
    some = warc.read(index.filter("page_id in (2, 4)"), folder, range_bytes=64)
    assert {r.page_id: r.payload.decode() for r in some.collect()} == {2: "<p>a</p>", 4: "é" * 50000}
    assert warc.read(warc.write(pages.limit(0), C.shared_path(spark, "t-warc")), folder).count() == 0
