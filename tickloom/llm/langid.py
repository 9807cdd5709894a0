"""Language identification by Bayesian evidence fusion.

log posterior(l) = log prior(host, l) + s * text log-likelihood(l) + log P(declared | l) + log P(address | l).

Text: hashed byte-trigram models, fitted on a bounded sample of the rows of each language label, and a background model with all
trigrams alike ("und").  All tables together take 64 MB at most: beyond 256 labels they have fewer buckets each.  s makes a text count as at most ``most_evidence`` trigrams, since neighbours are not independent.
Declared markup language and address suffix: their frequencies given the language that the text alone suggests, counted by
grouped aggregation over all rows.  Host prior: counts of text posteriors per host, smoothed towards those of the domain,
which are smoothed towards those of all rows.

A row is accepted if its best language is a real one with a posterior of at least ``least``, and its text has a letter.
Null text counts as empty; a text without letters has no evidence and is rejected, whatever its host.  Missing declarations,
addresses and hosts (null or empty) say nothing.  Ties go to the language first in order.  Repeated rows count each.
Null labels are not used to fit; with no label at all every row is "und".
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C, text as T

BUCKETS = 1 << 16
TABLE_CELLS = 1 << 24
UND = "und"
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[:65] = 32
_MAP[48:58] = 48
_MAP[91:97] = _MAP[123:128] = 32


def trigrams(b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram at each byte, whether it counts): three bytes of one text, not all blank, not all digits."""
    m = _MAP[b].astype(np.int64)
    n = len(m)
    pad = np.concatenate([m, [32, 32]])
    key = (pad[:n] << 16) | (pad[1:n + 1] << 8) | pad[2:]
    letter = (m > 48).astype(np.int8)
    two = np.concatenate([letter, [0, 0]])
    ok = (two[:n] + two[1:n + 1] + two[2:]) > 0
    end = doc[1:][doc[1:] > doc[:-1]]
    for k in (1, 2):
        ok[np.maximum(end - k, 0)] = False
    return (key * 0x9E3779B1 >> 7) & (BUCKETS - 1), ok


def fit(rows: list[tuple[str, str]], least_rows: int = 5) -> dict:
    """Trigram log-probabilities of each label with enough rows, from (text, label) pairs."""
    seen: dict[str, int] = {}
    for _, label in rows:
        seen[label] = seen.get(label, 0) + 1
    buckets = BUCKETS
    while buckets * len(seen) > TABLE_CELLS:
        buckets //= 2
    counts: dict[str, np.ndarray] = {}
    for text, label in rows:
        b = np.frombuffer(text.encode(), np.uint8)
        key, ok = trigrams(b, np.array([0, len(b)]))
        counts.setdefault(label, np.zeros(buckets))
        counts[label] += np.bincount(key[ok] & (buckets - 1), minlength=buckets)
    langs = sorted(x for x in counts if seen[x] >= least_rows)
    table = [np.log((counts[x] + 0.01) / (counts[x].sum() + 0.01 * buckets)) for x in langs] + [np.full(buckets, -np.log(buckets))]
    return {"langs": [*langs, UND], "table": np.array(table, np.float32)}


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = 3000, most_chars: int = 20_000, each: int = 200,
           most_rows: int = 40_000, least: int = 5) -> list[tuple[str, str]]:
    """Beginnings of texts of every label, by hash order: an equal share of ``rows`` for each label, or ``each`` if that is more.

    Never more than most_rows texts: with many labels each has fewer, with more than most_rows / least the most frequent
    labels share them.  A text gives most_chars characters, fewer where the texts together would pass rows x most_chars.
    Equal rows count once.
    """
    t = F.col(text_col)
    span = 1 << 40
    h = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col).cast("string"), t), F.lit(span))
    d = df.filter(t.isNotNull() & F.col(label_col).isNotNull()).select(F.col(label_col).alias("_l"), h.alias("h"), t.alias("t"))
    sizes = d.groupBy("_l").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "_l").limit(most_rows // least).collect()
    if not sizes:
        return []
    most = min(max(each, rows // len(sizes)), most_rows // len(sizes))
    chars = min(most_chars, max(1, rows * most_chars // (most * len(sizes))))
    # rows whose hash lies under a bound by their label's size, an estimate: enough more than wanted that hardly any draw falls short
    want = 1.15 * (most + 6 * most ** 0.5 + 10)
    bounds = df.sparkSession.createDataFrame([(r["_l"], min(span, int(span * want / max(1, r.n)))) for r in sizes], "_b string, bound long")
    drawn = d.join(F.broadcast(bounds), F.col("_l") == F.col("_b")).filter("h < bound").select("_l", "h", F.substring("t", 1, chars).alias("t")).distinct()
    got: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.collect():
        got.setdefault(r["_l"], []).append((r.h, r.t))
    return [(text, label) for label in sorted(got) for _, text in sorted(got[label])[:most]]


def text_evidence(df: DataFrame, model: dict, most_evidence: int = 60) -> DataFrame:
    """df(id, text, declared, address, host, domain, ...) with the text in place of ``ll``: scaled log-likelihoods, null without a letter."""
    names = [c for c in df.columns if c != "text"]
    at = df.columns.index("text")
    keep = [i for i, c in enumerate(df.columns) if c != "text"]

    def run(batches):
        table = model["table"]
        for batch in batches:
            data, off = T.utf8(batch.column(at))
            ll, size = np.zeros((batch.num_rows, len(table))), np.zeros(batch.num_rows, np.int64)
            for i, j in T.chunks(off, 1 << 19):
                lo = off[i]
                b, doc = data[lo:off[j]], off[i:j + 1] - lo
                if not len(b):
                    continue
                key, ok = trigrams(b, doc)
                key &= table.shape[1] - 1
                full = np.flatnonzero(doc[1:] > doc[:-1])
                first = doc[:-1][full]
                size[i + full] = np.add.reduceat(ok, first, dtype=np.int64)
                for k, row in enumerate(table):
                    ll[i + full, k] = np.add.reduceat(np.where(ok, row[key], 0).astype(np.float64), first)
            scale = np.minimum(1, most_evidence / np.maximum(size, 1))
            ll *= scale[:, None]
            flat = pa.array(ll.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ll.size + 1, ll.shape[1]), pa.int32()), flat, mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], lists], [*names, "ll"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "text") + ", ll array<double>"
    return df.mapInArrow(T.tidy(run), schema)


def _softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _sums(n: int) -> list[Column]:
    return [F.array(*[F.sum(F.get("p", F.lit(k))) for k in range(n)]).alias("c"), F.count(F.lit(1)).alias("n")]


def fuse(df: DataFrame, model: dict, smooth: float = 20.0, least: float = 0.5) -> DataFrame:
    """df(id, text, declared, address, host, domain) -> the same without text, with text_lang, lang, confidence, accepted."""
    k = len(model["langs"])
    keep = [c for c in df.columns if c != "text"]
    e = C.stored(text_evidence(df, model).withColumn("p", F.when(F.col("ll").isNotNull(), _softmax(F.col("ll"))).otherwise(F.array(*[F.lit(0.0)] * k))), "evidence")
    total = e.agg(*_sums(k)).first()
    base = [(x or 0.0) + 1.0 for x in (total.c or [0.0] * k)]
    share = F.array(*[F.lit(x / sum(base)) for x in base])
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, y: a + y)
    blend = lambda c, up: F.zip_with(c, up, lambda x, y: (x + smooth * y) / (size(c) + smooth))
    named = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    out = e
    # prior: domain towards all rows, host towards its domain
    domain = e.filter(named("domain")).groupBy("domain").agg(*_sums(k)).select("domain", blend(F.col("c"), share).alias("domain_prior"))
    host = e.filter(named("host")).groupBy("host").agg(*_sums(k), F.max("domain").alias("domain")).join(domain, "domain", "left")
    host = host.select(F.col("host"), blend(F.col("c"), F.coalesce("domain_prior", share)).alias("host_prior"), "n")
    tables = [("host", host, "host_prior")]
    # likelihood of a declaration or address given the language of the text, against its overall frequency
    for col in ("declared", "address"):
        seen = e.filter(named(col)).groupBy(col).agg(*_sums(k))
        sums = seen.agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(k)]).alias("c")).first().c or [0.0] * k
        every = F.array(*[F.lit((x or 0.0) + 1.0) for x in sums])
        whole = F.lit(sum((x or 0.0) + 1.0 for x in sums))
        overall = (size(F.col("c")) + 1.0) / whole
        tables.append((col, seen.select(col, F.zip_with("c", every, lambda x, y: F.log((x + smooth * overall) / (y + smooth))).alias(f"{col}_ll"), "n"), f"{col}_ll"))
    rows = total.n
    for col, table, value in tables:
        key = f"_{col}"
        keyed = table.select(F.col(col).cast("binary").alias(key), value, "n")
        # rows without a value are dealt out by id: they meet nothing
        out = C.join_groups(out.withColumn(key, F.when(named(col), F.col(col).cast("binary")).otherwise(F.concat(F.lit("\0"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))), keyed, key, "id", rows).drop(key, "n")
    zero = F.array(*[F.lit(0.0)] * k)
    score = F.transform(F.coalesce("host_prior", share), lambda x: F.log(x))
    for part in (F.col("ll"), F.col("declared_ll"), F.col("address_ll")):
        score = F.zip_with(score, F.coalesce(part, zero), lambda x, y: x + y)
    out = out.withColumn("post", _softmax(score))
    top = F.array_max("post")
    langs = F.array(*[F.lit(x) for x in model["langs"]])
    best = F.get(langs, (F.array_position("post", top) - 1).cast("int"))
    text_best = F.when(F.col("ll").isNotNull(), F.get(langs, (F.array_position("ll", F.array_max("ll")) - 1).cast("int")))
    out = out.withColumn("lang", F.when(F.col("ll").isNull(), F.lit(UND)).otherwise(best)).withColumn("confidence", top).withColumn("text_lang", text_best)
    return out.withColumn("accepted", (F.col("lang") != UND) & (F.col("confidence") >= least)).select(*keep, "text_lang", "lang", "confidence", "accepted")


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Evidence columns of web pages: visible text, declared markup language, address suffix (a language segment of the path, else the top-level domain), host and domain."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    top = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    return pages.select(F.col(id_col).alias("id"), F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ").alias("text"),
                        F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)).alias("declared"),
                        F.when(path != "", F.concat(F.lit("/"), path)).otherwise(top).alias("address"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Evidence columns of documents: the source stands for the host, and markup in the text may declare a language."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    none = F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), t.alias("text"), F.when(t.contains("<html"), F.lower(F.regexp_extract(t, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))).alias("declared"),
                       none.alias("address"), F.col(source_col).alias("host"), none.alias("domain"), *[c for c in (C.ROW,) if c in docs.columns])


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", source_col: str = "source", table: bool = False) -> DataFrame:
    """The rows of df that are accepted, with all their columns; labels only serve to fit.  ``table``: df is a plain read of stored files."""
    model = fit(sample(df, id_col, text_col, label_col))
    rows = C.rowed(df, table)
    return C.without(rows, fuse(document_rows(rows, id_col, text_col, source_col), model).filter("not accepted").select(C.ROW))
