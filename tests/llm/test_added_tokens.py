"""Packing with added tokens against the plain call of the library."""

import random

import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tickloom.llm import queries


def ids_by_doc(pieces):
    out = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        out.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    return out


def test_ids_are_those_of_the_plain_call(spark, tmp_path):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    e = "<|endoftext|>"
    rng = random.Random(4)
    bits = [e, "<|endof", "text|>", " ", "  ", "x", "it's", "\n", "\u00fc", "12", "<|", "|>", "word " * 50]
    texts = [f"x {e} y", e, e + e, f" {e}", f"{e} ", f"a  {e}  b", "ends <|endof", "text|> begins", None, ""]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    exp = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert exp[0] == [87, 220, 50256, 331, 1]
    assert ids_by_doc(cp.pack(spark, docs, "").collect()) == exp
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in queries.op10_packing(spark, str(tmp_path)).collect():
        got[r.doc_id] = r.doc_tokens
    assert got == {i: len(x) for i, x in exp.items()}
