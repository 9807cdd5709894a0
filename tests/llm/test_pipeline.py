"""The pipeline stage by stage against brute force over the rows it was given."""

import re
from collections import defaultdict

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tickloom.llm import common as C
from test_groups import brute_fp, components
from test_text_models import slow_base

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = C.documents(spark, SF)
    columns = docs.columns
    names = [n for n, _ in cp.STAGES]
    out = {}
    for name, stage in cp.STAGES:
        given = {r.doc_id: r for r in docs.collect()}
        docs = C.stored(stage(spark, docs, SF), "t-stage")
        out[name] = (given, docs.collect())
        if name != names[-1]:
            assert docs.columns == columns
    ids = lambda rows: {r.doc_id for r in rows}

    given, got = out["language ID"]
    assert ids(got) == {i for i, r in given.items() if re.search("[a-z]{3}", r.text.lower())}  # every clean text stays

    given, got = out["exact dedup"]
    first = {}
    for i in sorted(given):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", given[i].text), i)
    assert ids(got) == set(first.values())

    given, got = out["SimHash near-dedup"]
    order = sorted(given)
    fp = [brute_fp(given[i].text) for i in order]
    same = components(range(len(order)), [(a, b) for a in range(len(order)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 3])
    assert ids(got) == {order[r] for r in same.values()}

    given, got = out["secret scans"]
    assert ids(got) == set(given)
    for r in got:
        old = given[r.doc_id].text
        assert not slow_base(r.text.replace("[SECRET]", " ")) and r.n_chars == len(r.text)
        assert "[SECRET]" in r.text if slow_base(old) else len(r.text) <= len(old) + 4 * r.text.count("[SECRET]")

    given, got = out["packing"]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    total = defaultdict(int)
    for p in got:
        total[p.doc_id] += p.length
    assert dict(total) == {i: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in given.items()}


def test_run_is_the_stages(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
