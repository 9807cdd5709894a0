"""BPE and packing against the public libraries."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import tiktoken

from tickloom.llm import bpe, queries, text as T

ODD = ["", None, "'s", "it's 'sam ''s we'll 'Really", " \n x", "\x1c \x85　 a", "a" * 5000, "ab" * 3000, "é" * 999, "\U0001d4b3 x́", "   ", "x   ", "\n\n\ty", "1234 ١٢٣", "<|endoftext|>"]


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_match_the_library(enc):
    rng = random.Random(1)
    al = list("abcsTtrel '’\n\t    é中9٣!?-_dmv𝒳") + ["'s", "'re", "ll", "tion", " the"]
    texts = ODD + ["".join(rng.choice(al) for _ in range(rng.randrange(60))) for _ in range(4000)]
    model = bpe.load(P.path("byte_bpe_50k.tiktoken"))
    cache = T.WordCache(np.int32)
    for _ in range(2):  # cold and warm
        data, off = T.utf8(pa.array(texts))
        ids, at = bpe.merged_ids(data, off, cache, model.encode_many)
        for i, t in enumerate(texts):
            own = ids[at[i]:at[i + 1]]
            assert own.tolist() == enc.encode_ordinary(t or "")
            assert model.decode(own) == (t or "").encode()


def test_queue_forms_agree(enc):
    rng = random.Random(2)
    model = bpe.load(P.path("byte_bpe_50k.tiktoken"))
    words = [bytes(rng.choice(b"aetion shr\xc3\xa9") for _ in range(rng.randrange(1, 60))) for _ in range(3000)] + [b"a" * 70]
    many = model.encode_many(words)
    assert many == [model.encode(w) for w in words] == [enc._core_bpe.encode_single_piece(w) for w in words]


def test_query_rows(spark, enc):
    import hashlib

    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, "again", "x")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digest(docs, queries.tokenizer_file("byte_bpe_50k.tiktoken")).collect()))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    exp = [(i, len(ids := enc.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in [*enumerate(ODD), (0, "again")]]
    assert got == sorted(exp)
    assert bpe.digest(docs.limit(0), queries.tokenizer_file("byte_bpe_50k.tiktoken")).count() == 0
