"""Toxicity by compression distance.

Two zstandard dictionaries of one size are trained separately, on toxic and on ordinary text.  A window is one word between
blanks, followed by a fixed tail that both dictionaries hold, so that even a short word goes through match search.  A
word's gain is how many bytes fewer it takes with the toxic dictionary.  A word counts when its gain reaches one calibrated
threshold and its length with the toxic dictionary stays under another; a logistic curve, fitted on rows the dictionaries
have not seen, turns a text's counts into a score.

The toxic training text is what toxic rows use in clearly more different contexts than ordinary rows do, so passages that
are merely copied between rows weigh once.  Labels, language, source and ids are never inputs of a score.

Null text counts as empty; every text has a score between 0 and 1, also an empty one.  Conflicting labels of a row count as
toxic if any is.  Without labels of both kinds every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, functions as F

from . import text as T

TAIL = bytes(range(1, 32))
DICT_BYTES = 4096
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def _contexts(texts: list[str]) -> Counter:
    """In how many different (word before, word after) pairs each word stands."""
    seen = set()
    for t in texts:
        w = words(t)
        seen.update(zip([b"", *w[:-1]], w, [*w[1:], b""]))
    return Counter(w for _, w, _ in sorted(seen))  # a fixed order, so ties fall alike in every run


def _sharper(toxic: Counter, plain: Counter, least: float = 20.0) -> dict[bytes, int]:
    """Words of toxic text whose log-likelihood ratio against ordinary text is at least ``least``."""
    nt, np_ = max(1, toxic.total()), max(1, plain.total())
    out = {}
    for w, a in toxic.items():
        b = plain[w]
        if len(w) < 3 or a < 4 or a / nt <= 4 * (b + 0.5) / np_:
            continue
        e = (a + b) / (nt + np_)
        if 2 * (a * math.log(a / nt / e) + (b * math.log(b / np_ / e) if b else 0)) >= least:
            out[w] = a
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    p = zs.ZstdCompressionParameters.from_level(19, strategy=zs.STRATEGY_BTOPT, min_match=3, window_log=14, hash_log=12, chain_log=13, write_content_size=0, write_dict_id=0, write_checksum=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
    d = zs.ZstdCompressionDict(content + TAIL, dict_type=zs.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zs.ZstdCompressor(dict_data=d, compression_params=p)


class Scorer:
    """Gains and toxic lengths of words, kept for the words met before."""

    def __init__(self, model: dict):
        self.plain, self.toxic = _compressor(model["plain"]), _compressor(model["toxic"])
        self.cache = T.WordCache(np.int16, 2_000_000)

    def measure(self, w: bytes) -> tuple[int, int]:
        window = b" " + w + b" " + TAIL
        n = len(self.toxic.compress(window))
        return len(self.plain.compress(window)) - n, n

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gain and toxic length of every word, offsets of the texts in them, words per text)."""
        b = data.copy()
        up = (b >= 65) & (b <= 90)
        b[up] += 32
        letter = _LETTER[b]
        first, last = letter.copy(), letter.copy()
        begin = off[:-1][off[:-1] < off[1:]]
        first[1:] &= ~letter[:-1]
        first[begin] = letter[begin]
        last[:-1] &= ~letter[1:]
        last[begin[begin > 0] - 1] = letter[begin[begin > 0] - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        cut = np.searchsorted(s, off)
        if not len(s):
            return np.zeros((0, 2), np.int16), cut, cut[1:] - cut[:-1]
        codes, at, h = T.distinct(b, s, e)
        cache = self.cache
        row = cache.rows(h)
        miss = np.flatnonzero(row < 0)
        if len(miss) and len(cache.off) + len(miss) > cache.most and len(cache.off) > 1:
            cache.clear()
            miss = np.arange(len(h))
        if len(miss):
            raw = b.tobytes()
            row[miss] = len(cache.off) - 1 + np.arange(len(miss))
            cache.note(h[miss], row[miss])
            cache.fill([self.measure(raw[x:y]) for x, y in zip(s[at[miss]].tolist(), e[at[miss]].tolist())])
        return cache.data.reshape(-1, 2)[row[codes]], cut, cut[1:] - cut[:-1]


def _counts(m: np.ndarray, cut: np.ndarray, n: np.ndarray, gain: int, most: int) -> np.ndarray:
    """Features of each text: words that count, their share, the same for a stricter gain, and the text's length."""
    hit = np.concatenate([[0], np.cumsum((m[:, 0] >= gain) & (m[:, 1] <= most))])
    more = np.concatenate([[0], np.cumsum(m[:, 0] >= gain + 1)])
    a, b = hit[cut[1:]] - hit[cut[:-1]], more[cut[1:]] - more[cut[:-1]]
    size = np.maximum(n, 1)
    # short texts count as 50 words: they are too few in any sample for a curve of their own
    return np.stack([np.log1p(a), np.sqrt(a / size), np.log1p(b), np.sqrt(b / size), np.log1p(np.maximum(n, 50)), np.ones(len(n))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
    return w


def fit(toxic: list[str], plain: list[str], seed: int = 5) -> dict:
    """Dictionaries from the first part of each list; thresholds and curve from the rest."""
    base = len(toxic) / max(1, len(toxic) + len(plain))
    if len(toxic) < 4 or len(plain) < 4:
        return {"share": base}
    ht, hp = len(toxic) * 3 // 5, len(plain) * 3 // 5
    ct, cp = _contexts(toxic[:ht]), _contexts(plain[:hp])
    sharp = _sharper(ct, cp)
    if not sharp:
        return {"share": base}
    rng = np.random.default_rng(seed)

    def bundle(counts: dict[bytes, int]) -> list[bytes]:
        w = [b" " + x + b" " for x in sorted(counts) for _ in range(min(counts[x], 200))]
        order = rng.permutation(len(w))
        return [b"".join(w[i] for i in order[k:k + 8]) for k in range(0, len(w), 8)]

    model = {"toxic": _dictionary(bundle(sharp), DICT_BYTES), "plain": _dictionary(bundle({w: n for w, n in cp.most_common(20_000) if w not in sharp}), DICT_BYTES)}
    scorer = Scorer(model)
    rest = [*toxic[ht:], *plain[hp:]]
    y = np.array([1.0] * (len(toxic) - ht) + [0.0] * (len(plain) - hp))
    m, cut, n = scorer.texts(*T.utf8(pa.array(rest)))
    floor = min(scorer.measure(w)[1] for w in sharp)
    best = None
    for gain in (1, 2, 3, 4, 5):
        for most in range(floor, floor + 6):
            x = _counts(m, cut, n, gain, most)
            w = _logistic(x, y)
            p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
            loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
            if best is None or loss < best[0] - 1e-9:
                best = (loss, gain, most, w)
    return model | {"gain": best[1], "most": best[2], "w": best[3], "loss": float(best[0])}


def sample(docs: DataFrame, labels: DataFrame, train, toxic_rows: int = 1200, plain_rows: int = 3600, most_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[str]]:
    """(toxic, ordinary) texts of at most most_chars characters: at most so many labelled ids of each kind, by hash order.
    train: a condition on the id column that marks the rows whose labels may be learnt."""
    ids = labels.filter(train & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("_i")).agg(F.max("toxic").alias("_y"))
    h = F.xxhash64(F.lit("tox"), "_i")
    few = ids.filter("_y = 1").orderBy(h, "_i").limit(toxic_rows).unionByName(ids.filter("_y = 0").orderBy(h, "_i").limit(plain_rows))
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull() & (F.length("t") <= most_chars))
    got = rows.join(F.broadcast(few), F.col("_d") == F.col("_i")).select("_i", "_y", "t").collect()  # at most toxic_rows + plain_rows ids
    order = sorted({(r._i, r._y, r.t) for r in got}, key=lambda r: (hash_order(r[0]), r[2]))
    return [t for _, y, t in order if y == 1], [t for _, y, t in order if y == 0]


def hash_order(i: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(i), 11)


_scorers: dict[bytes, Scorer] = {}


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) per row."""
    def run(batches):
        key = model.get("toxic", b"") + model.get("plain", b"")
        for batch in batches:
            if not key:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, model["share"]))], ["id", "score"])
                continue
            if key not in _scorers:
                _scorers.clear()
                _scorers[key] = Scorer(model)
            data, off = T.utf8(batch.column(1))
            out = [np.zeros(0)]
            for i, j in T.chunks(off):
                lo = off[i]
                m, cut, n = _scorers[key].texts(data[lo:off[j]], off[i:j + 1] - lo)
                out.append(1 / (1 + np.exp(-np.clip(_counts(m, cut, n, model["gain"], model["most"]) @ model["w"], -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["id", "score"])

    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "id bigint, score double").withColumnRenamed("id", id_col)
