"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

A text is cut into runs of letters and digits (with any non-ASCII character), and single other characters.  States are
outside, begin and inside.  Features are a token's shape, words and marks up to three tokens before and one after it, and
measures of the whole text.  The field is fitted by maximum likelihood on a bounded sample whose tokens the fixed patterns
label; shape features let it find secrets that no pattern names.

Decoding is Viterbi, exact: a token whose outside score leads by more than any transitions can make good is outside on
every best path, so such tokens split a text, and only the stretches between them are walked.

Null text counts as empty; empty texts have no spans.  Offsets are in code points, ends exclusive.  A field span that
touches a pattern span is not added.  Rows repeated with one id are scanned each on its own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C, text as T

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
OUT, BEGIN, INSIDE = 0, 1, 2
STATES = 3
KEYWORDS = ("password", "passwd", "secret", "token", "api", "key", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "private", "pwd")
SHAPES = ("len1_3", "len4_7", "len8_15", "len16_23", "len24_39", "len40", "digit", "upper", "lower", "wide", "letters_digits", "all_digits", "hex_only", "caps_digits",
          "switch2", "switch5", "switch9", "keyword", "equals", "colon", "quote", "dash_dot", "other_mark", "rare_vowels")
DOC = ("doc_keyword", "doc_short", "doc_marks", "doc_digits")
SPREAD = (-3, -2, -1, 1)


def base_spans(t: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret itself) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(t)]
    return sorted(out)


_BYTE = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 wide, 4 mark, 5 white
_BYTE[97:123], _BYTE[65:91], _BYTE[48:58], _BYTE[128:], _BYTE[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 3, 5
_HEXB = np.zeros(256, bool)
_HEXB[[*range(48, 58), *range(97, 103), *range(65, 71)]] = True
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _word_hash(words) -> np.ndarray:
    data = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(w) for w in data])])
    return T.span_hashes(np.frombuffer(b"".join(data), np.uint8), off[:-1], off[1:])


def tokens(b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) in bytes; white space belongs to no token."""
    kind = _BYTE[b]
    word = kind <= 3
    first = np.ones(len(b), bool)
    first[1:] = ~(word[1:] & word[:-1])
    begin = doc[:-1][doc[:-1] < doc[1:]]
    first[begin] = True
    s = np.flatnonzero(first)
    e = np.append(s[1:], len(b))
    solid = kind[s] != 5
    return s[solid], e[solid]


def features(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One row of SHAPES per token."""
    f = np.zeros((len(s), len(SHAPES)), np.float32)
    if not len(s):
        return f
    kind, n = _BYTE[b], e - s
    size = np.cumsum(np.concatenate([[0], n]))
    idx = np.arange(size[-1]) + np.repeat(s - size[:-1], n)
    k, raw = kind[idx], b[idx]
    total = lambda m: np.add.reduceat(m, size[:-1], dtype=np.int32)
    low, up, dig, wide = total(k == 0), total(k == 1), total(k == 2), total(k == 3)
    turn = np.zeros(len(k), bool)
    turn[1:] = (k[1:] == 2) != (k[:-1] == 2)
    turn[size[:-1]] = False
    turns, hexes, vowels = total(turn), total(_HEXB[raw]), total(_VOWEL[raw])
    word = (low + up + dig + wide) > 0
    for c, (x, y) in enumerate(((1, 3), (4, 7), (8, 15), (16, 23), (24, 39), (40, 1 << 60))):
        f[:, c] = word & (n >= x) & (n <= y)
    mark = b[s]
    lower = _LOWER[b]
    cols = (dig > 0, up > 0, low > 0, wide > 0, (dig > 0) & (low + up > 0), word & (dig == n), (n >= 8) & (hexes == n), (n >= 8) & (up > 0) & (up + dig == n),
            turns >= 2, turns >= 5, turns >= 9, np.isin(T.span_hashes(lower, s, e), _KEYS) & word, mark == 61, mark == 58, (mark == 34) | (mark == 39),
            (mark == 45) | (mark == 46) | (mark == 95), ~word & ~np.isin(mark, [61, 58, 34, 39, 45, 46, 95]), word & (n >= 10) & (vowels * 6 < n))
    for c, x in enumerate(cols):
        f[:, 6 + c] = x
    return f


_KEYS = _word_hash(KEYWORDS)


def doc_features(f: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One row of DOC per text; cut: first token of each text."""
    n = np.maximum(1, cut[1:] - cut[:-1])
    at = SHAPES.index

    def share(names):
        acc = np.concatenate([[0.0], np.cumsum(f[:, [at(x) for x in names]].sum(1), dtype=np.float64)])
        return (acc[cut[1:]] - acc[cut[:-1]]) / n

    marks = share(["equals", "colon", "quote", "dash_dot", "other_mark"])
    return np.stack([share(["keyword"]) > 0, n < 100, marks > 0.4, share(["digit"]) > 0.2], 1).astype(np.float32)


WIDTH = len(SHAPES)


def emissions(model: dict, f: np.ndarray, d: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """State scores of every token: own shape, the spread of neighbours in the same text, the text, and a bias."""
    w = model["w"]
    own = f @ w["own"] + w["bias"]
    size = cut[1:] - cut[:-1]
    own += np.repeat(d @ w["doc"], size, axis=0)
    first, last = np.repeat(cut[:-1], size), np.repeat(cut[1:], size)
    at = np.arange(len(f))
    for k in SPREAD:
        part = f @ w[k]
        j = at + k
        ok = (j >= first) & (j < last)
        own[ok] += part[j[ok]]
    return own


def _slack(model: dict) -> float:
    """The most that transitions can favour a path through another state over outside, at one token."""
    t, s = model["t"], model["s"]
    best = 0.0
    for x in (BEGIN, INSIDE):
        into = [t[a, x] - t[a, OUT] for a in range(STATES)] + [s[x] - s[OUT]]
        away = [t[x, b] - t[OUT, b] for b in range(STATES)] + [0.0]
        best = max(best, max(into) + max(away))
    return float(best)


def viterbi(model: dict, e: np.ndarray, left: bool, right: bool) -> np.ndarray:
    """Best states of a stretch; left, right: an outside token stands before, after it."""
    t = model["t"]
    score = e[0] + (t[OUT] if left else model["s"])
    back = []
    for row in e[1:]:
        all_ = score[:, None] + t
        back.append(all_.argmax(0))
        score = all_.max(0) + row
    if right:
        score = score + t[:, OUT]
    path = [int(score.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return np.array(path[::-1])


def decode(model: dict, e: np.ndarray, cut: np.ndarray) -> list[tuple[int, int]]:
    """(first token, last token) of every tagged secret."""
    open_ = np.flatnonzero(e[:, OUT] - np.maximum(e[:, BEGIN], e[:, INSIDE]) <= _slack(model) + 1e-4)
    out: list[tuple[int, int]] = []
    if not len(open_):
        return out
    text = np.searchsorted(cut, open_, "right")
    new = np.flatnonzero(np.concatenate([[True], (open_[1:] != open_[:-1] + 1) | (text[1:] != text[:-1])]))
    starts = set(cut.tolist())
    for x, y in zip(new, np.append(new[1:], len(open_))):
        a, b = int(open_[x]), int(open_[y - 1]) + 1
        path = viterbi(model, e[a:b], a not in starts, b not in starts)
        k = 0
        while k < len(path):
            if path[k] == OUT:
                k += 1
                continue
            m = k + 1
            while m < len(path) and path[m] == INSIDE:
                m += 1
            out.append((a + k, a + m - 1))
            k = m
    return out


def fit(texts: list[str], window: int = 24, steps: int = 80, ridge: float = 2e-4, seed: int = 7) -> dict:
    """The field from texts labelled by the fixed patterns: windows around each secret and as many others, by Adam."""
    rng = np.random.default_rng(seed)
    fs, ds, ys = [], [], []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        doc = np.array([0, len(raw)])
        s, e = tokens(raw, doc)
        if not len(s):
            continue
        f = features(raw, s, e)
        y = np.zeros(len(s), np.int64)
        point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        for _, _, end, at in base_spans(t):
            i, j = np.searchsorted(point[s], at), np.searchsorted(point[s], end)
            y[i:j] = INSIDE
            y[i:i + 1] = BEGIN
        d = doc_features(f, np.array([0, len(s)]))[0]
        hits = np.flatnonzero(y == BEGIN)
        picks = [max(0, int(h) - window // 2) for h in hits[:2]] + [int(x) for x in rng.integers(0, len(s), 2)]
        if len(hits) == 0:
            odd = np.flatnonzero(f[:, SHAPES.index("digit")] > 0)
            picks += [max(0, int(x) - window // 2) for x in (rng.choice(odd, min(2, len(odd)), replace=False) if len(odd) else [])]
        for a in picks:
            fs.append((f, a))
            ds.append(d)
            ys.append(y[a:a + window])
    n, k = len(fs), len(SPREAD)
    dim = WIDTH * (1 + k) + len(DOC) + 1
    x = np.zeros((n, window, dim), np.float32)
    y = np.full((n, window), -1)
    for i, (f, a) in enumerate(fs):
        m = len(ys[i])
        y[i, :m] = ys[i]
        x[i, :m, :WIDTH] = f[a:a + m]
        for c, shift in enumerate(SPREAD):
            j = np.arange(a, a + m) + shift
            ok = (j >= 0) & (j < len(f))
            x[i, :m, WIDTH * (c + 1):WIDTH * (c + 2)][ok] = f[j[ok]]
        x[i, :m, -1 - len(DOC):-1] = ds[i]
        x[i, :m, -1] = 1
    w, t, s = np.zeros((dim, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, t, s)]
    for step in range(1, steps + 1 if n else 1):
        grads = _gradient(x, y, w, t, s)
        for p, g, (m1, m2) in zip((w, t, s), grads, moment):
            g = g / n + ridge * p
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= 0.12 * 0.97 ** step * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    if not n:
        w[-1, OUT] = 1.0
    out = {"own": w[:WIDTH], "doc": w[-1 - len(DOC):-1], "bias": w[-1]}
    for c, shift in enumerate(SPREAD):
        out[shift] = w[WIDTH * (c + 1):WIDTH * (c + 2)]
    return {"w": {q: v.astype(np.float32) for q, v in out.items()}, "t": t.astype(np.float32), "s": s.astype(np.float32)}


def _gradient(x, y, w, t, s):
    """Gradient of the negative log-likelihood over windows of labels y (-1: past the end), by forward and backward sums."""
    n, length, _ = x.shape
    e = x @ w.astype(np.float32)
    live = y >= 0
    lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
    a, b = np.zeros((length, n, STATES)), np.zeros((length, n, STATES))
    a[0] = s + e[:, 0]
    for k in range(1, length):
        a[k] = np.where(live[:, k, None], lse(a[k - 1][:, :, None] + t, 1) + e[:, k], a[k - 1])
    for k in range(length - 2, -1, -1):
        b[k] = np.where(live[:, k + 1, None], lse(t + (e[:, k + 1] + b[k + 1])[:, None, :], 2), 0)
    z = lse(a[-1], 1)
    p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2) * live[:, :, None]
    truth = np.zeros_like(p)
    i, k = np.nonzero(live)
    truth[i, k, y[i, k]] = 1
    gw = np.einsum("nkd,nks->ds", x, (p - truth).astype(np.float32), optimize=True)
    gt = np.zeros((STATES, STATES))
    for k in range(1, length):
        m = live[:, k]
        q = a[k - 1][m][:, :, None] + t + (e[m, k] + b[k][m])[:, None, :] - z[m][:, None, None]
        gt += np.exp(q).sum(0)
        np.subtract.at(gt, (y[m, k - 1], y[m, k]), 1)
    return gw, gt, (p[:, 0] - truth[:, 0]).sum(0)


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = 1500, most_chars: int = 20_000) -> list[str]:
    """At most ``docs`` texts of at most most_chars characters for the fit, by hash order; texts with a keyword come about 20 times as often."""
    t = F.col(text_col)
    hint = F.lit(False)
    for k in ("password", "passwd", "secret", "token", "api_key", "apikey", "AKIA"):
        hint = hint | t.contains(k)
    h = F.shiftrightunsigned(F.xxhash64(F.lit("crf"), F.col(id_col).cast("string")), 8)
    rows = df.filter(t.isNotNull() & (F.length(t) <= most_chars)).select(F.when(hint, h / 20).otherwise(h).alias("h"), t.alias("text"))
    return [r.text for r in C.smallest(rows, "h", docs)]


def find(texts, model: dict) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind number, end) of every text of an Arrow string column."""
    data, off = T.utf8(texts)
    found: list[list[tuple[int, int, int]]] = []
    for i, j in T.chunks(off, 1 << 19):
        lo = off[i]
        b, doc = data[lo:off[j]], off[i:j + 1] - lo
        s, e = tokens(b, doc)
        cut = np.searchsorted(s, doc)
        f = features(b, s, e)
        spans = decode(model, emissions(model, f, doc_features(f, cut), cut), cut) if len(s) else []
        extra: dict[int, list] = {}
        for x, y in spans:
            extra.setdefault(int(np.searchsorted(doc, s[x], "right")) - 1, []).append((s[x], e[y]))
        raw = b.tobytes()
        for k in range(j - i):
            part = raw[doc[k]:doc[k + 1]]
            base = [(a, kind, z) for a, kind, z, _ in base_spans(part.decode())]
            more = []
            for x, y in extra.get(k, ()):
                a, z = (len(part[:p - doc[k]].decode()) for p in (x, y))
                if z - a >= 6 and not any(p < z and a < q for p, _, q in base):
                    more.append((a, 3, z))
            found.append(sorted(base + more))
    return found


def scan(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, starts, ends, kinds): spans of every row in order of start and kind number."""
    def run(batches):
        for batch in batches:
            found = find(batch.column(1), model)
            cols = [pa.array([[x[c] for x in r] for r in found], pa.list_(pa.int64())) for c in (0, 2, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", "starts", "ends", "kinds"])

    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(T.tidy(run), "id bigint, starts array<bigint>, ends array<bigint>, kinds array<bigint>").withColumnRenamed("id", id_col)


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per fixed kind, the SHA-256 of the fixed spans as kind:start:end, and all spans in that form."""
    z = F.arrays_zip("starts", "ends", "kinds")
    name = F.array(*[F.lit(k) for k in KINDS])
    show = lambda x: F.concat_ws(":", F.get(name, x["kinds"].cast("int")), x["starts"], x["ends"])
    n = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    return spans.select(id_col, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(F.array_join(F.transform(F.filter(z, lambda x: x["kinds"] < 3), show), ","), 256).alias("base_sha256"), F.array_join(F.transform(z, show), ",").alias("spans"))


def redact(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """df with every span of the text replaced by the mask; all columns stay as they are, in order."""
    names = df.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(find(batch.column(at), model)):
                out, last = [], 0
                for a, _, z in spans:  # spans of two kinds may overlap: one mask for both
                    if z > last:
                        out += [texts[k][last:a], mask] if a >= last else []
                        last = z
                if spans:
                    texts[k] = "".join(out) + texts[k][last:]
            cols = [pa.array(texts, batch.schema.field(at).type) if c == at else batch.column(c) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return df.mapInArrow(T.tidy(run), df.schema)
