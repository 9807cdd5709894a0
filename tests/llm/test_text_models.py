"""Language ID, toxicity and secret scans: edge rows, brute force where there is one, held-out accuracy on the test tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import common as C, langid, queries, secret_scan as S, toxicity

SF = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, "   "), (4, "12345 67890 !!"), (5, "the and of " * 30000), (6, "x"), (6, "x"), (None, "token = abcdef123456")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", None, 3, "x", "y") for i, t in EDGE], "doc_id long, text string, lang string, source string, n_chars long, starts string, host string")


# secrets
def slow_base(t):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans():
    rng = random.Random(4)
    bits = ["password", "PASSWD", "secret", "token", "Token", "api_key", "apikey", "ſecret", "toKen", '"', "'", " ", "  ", "=", ":", "abc", "abcdef", "x.y-z_9", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "0123456789ab", "é", "\n", "+/="]
    for _ in range(6000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        fixed = [x for x in slow_base(t)]
        # (?i) also folds the long s and the Kelvin sign, which are not A-Z
        if not re.search("[ſK]", t):
            assert [(a, k, z) for a, k, z, _ in S.base_spans(t)] == fixed
    assert S.base_spans("ſecret = abcdefgh") == []


@pytest.fixture(scope="module")
def field(spark):
    return S.fit(S.sample(C.documents(spark, "/root/testdata/sf0.1")))  # enough secrets to learn shapes from


def test_decoding_is_exact(spark, field):
    """Stretches between certain tokens give what Viterbi over the whole text gives."""
    for r in C.documents(spark, SF).filter("doc_id % 5 = 0").select("text").collect():
        b = np.frombuffer(r.text.encode(), np.uint8)
        doc = np.array([0, len(b)])
        s, e = S.tokens(b, doc)
        f = S.features(b, s, e)
        cut = np.array([0, len(s)])
        em = S.emissions(field, f, S.doc_features(f, cut), cut) + np.random.default_rng(1).normal(0, 1.5, (len(s), 3)).astype(np.float32)
        full = S.viterbi(field, em, False, False)
        exp, k = [], 0
        while k < len(full):
            if full[k] != S.OUT:
                m = k + 1
                while m < len(full) and full[m] == S.INSIDE:
                    m += 1
                exp.append((k, m - 1))
                k = m
            else:
                k += 1
        assert S.decode(field, em, cut) == exp


def test_viterbi_against_all_paths(field):
    import itertools

    rng = np.random.default_rng(3)
    for _ in range(30):
        e = rng.normal(0, 2, (5, 3))
        score = lambda p: field["s"][p[0]] + sum(e[i, x] for i, x in enumerate(p)) + sum(field["t"][a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=5), key=score)
        assert np.isclose(score(tuple(S.viterbi(field, e, False, False))), score(best))


def test_field_finds_what_no_pattern_names(field):
    t = 'The login uses pwd = "15959ad9338a8dac1d" here.'
    clean = "tel 47853805923, mail a@b.com, version 2024-01-01, see page 12 of the report"
    spans = S.find(pa.array([t, None, "", clean]), field)
    assert S.base_spans(t) == [] and [t[a:z] for a, k, z in spans[0] if k == 3] == ["15959ad9338a8dac1d"] and len(spans[0]) == 1
    assert spans[1:] == [[], [], []]


def test_scan_rows(spark, edge, field):
    got = {(r.doc_id, r.spans, r.n_assign) for r in S.digest(S.scan(edge, field)).collect()}
    assert (None, "assign:0:20", 1) in got and (1, "", 0) in got and len(got) == 7
    assert S.digest(S.scan(edge, field)).count() == len(EDGE)
    docs = C.documents(spark, SF)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in S.digest(S.scan(docs, field)).collect():
        base = slow_base(texts[r.doc_id])
        show = ",".join(f"{S.KINDS[k]}:{a}:{z}" for a, k, z in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(show.encode()).hexdigest()
        assert set(show.split(",")) - {""} <= set(r.spans.split(","))


def test_redact(spark, edge, field):
    out = S.redact(edge, field)
    assert out.schema == edge.schema
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (None, "[SECRET]") in got and (1, None) in got and (5, EDGE[4][1]) in got


# toxicity
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op1_toxicity(spark, sf).collect()
    assert len(rows) == C.documents(spark, sf).count()
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    caught = sum(s >= 0.3 for s in pos) / len(pos)
    # a few hundred toxic rows to learn from; the check tables have ten times as many and give 0.9999
    assert auc > 0.9 and caught > 0.65 and sum(s >= 0.3 for s in neg) < 0.05 * len(neg), (auc, caught)


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    for cond in (F.lit(True), F.lit(False)):
        model = toxicity.fit(*toxicity.sample(edge, labels, cond))
        got = toxicity.score(edge, model).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    rng = random.Random(3)
    some = lambda: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(12))
    plain = [some() for _ in range(200)]
    nasty = [f"{some()} zorgle {some()} blarghek {some()}" for _ in range(60)]
    model = toxicity.fit(nasty, plain)
    s = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "you zorgle blarghek zorgle"), (2, ""), (3, None), (4, "here and there")], "doc_id long, text string"), model).collect()}
    assert s[1] > max(s[2], s[3], s[4]) and s[2] == s[3] < 0.3


# language
def test_language_accuracy(spark):
    docs = C.documents(spark, SF)
    half = docs.filter("doc_id % 2 = 0")
    model = langid.fit(langid.sample(half))
    rest = docs.filter("doc_id % 2 = 1")
    got = {r.id: r for r in langid.fuse(langid.document_rows(rest), model).collect()}
    truth = {r.doc_id: r.lang for r in rest.collect()}
    assert len(got) == len(truth)
    assert sum(got[i].lang == x for i, x in truth.items()) > 0.99 * len(truth)
    assert sum(r.accepted for r in got.values()) > 0.99 * len(truth)


def test_language_edges(spark, edge):
    docs = C.documents(spark, SF)
    model = langid.fit(langid.sample(docs, rows=400))
    out = langid.fuse(langid.document_rows(edge), model)
    got = {r.id: r for r in out.collect()}
    assert out.count() == len(EDGE)
    assert all(got[i].lang == "und" and not got[i].accepted for i in (1, 2, 3, 4))
    assert got[5].lang == "en" and got[5].accepted
    assert langid.fuse(langid.document_rows(edge.limit(0)), model).count() == 0
    none = langid.fit([])
    assert all(r.lang == "und" for r in langid.fuse(langid.document_rows(edge), none).collect())
    kept = langid.keep_identified(edge)
    assert kept.columns == edge.columns


def test_other_evidence_decides_short_texts(spark):
    """A text that fits two languages alike follows its declaration, its address or its host."""
    rng = random.Random(1)
    en, de = ["the", "with", "that", "this", "have"], ["der", "und", "nicht", "eine", "auch"]
    make = lambda w: " ".join(rng.choice(w) for _ in range(60))
    model = langid.fit([(make(en), "en") for _ in range(30)] + [(make(de), "de") for _ in range(30)])
    rows = [(i, make(en), "en", "/en", "a.example", None) for i in range(40)] + [(100 + i, make(de), "de", "/de", "b.example", None) for i in range(40)]
    rows += [(1001, "ooo", "de", None, None, None), (1002, "ooo", None, "/de", None, None), (1003, "ooo", None, None, "b.example", None), (1004, "ooo", "en", None, None, None)]
    d = spark.createDataFrame(rows, "id long, text string, declared string, address string, host string, domain string")
    got = {r.id: r for r in langid.fuse(d, model).collect()}
    score = {i: r.lang for i, r in got.items() if i > 1000}
    assert all(score[i] in ("de", "und") for i in (1001, 1002, 1003)) and score[1004] in ("en", "und")


def test_page_rows(spark):
    p = spark.createDataFrame([(1, "https://m.host.example.fr/de/9?x", '<html class="a" LANG=\'DE\'><script>var t="</p>";</script><b>Hallo</b> Welt'), (2, None, None), (3, "not a url", "<p>x")], "page_id long, url string, html string")
    got = {r.id: (r.declared, r.address, r.host, r.domain, r.text.split()) for r in langid.page_rows(p).collect()}
    assert got[1] == ("de", "/de", "m.host.example.fr", "example.fr", ["Hallo", "Welt"])
    assert got[2] == ("", "", "", "", []) and got[3] == ("", "", "", "", ["x"])
