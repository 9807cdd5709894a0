"""WARC archives with an index first: offset, length, URL and digest per record, then coalesced byte-range reads.

Each task writes archives of one gzip member per record into the shared folder and returns its index rows; only rows of
tasks that succeeded reach the index, so what a lost or repeated task wrote is never read.  Reading takes any selection of
index rows, joins neighbouring byte ranges of an archive, and parses the records out of each range.

Null payloads count as empty.  Of equal payloads of at least min_bytes the smallest page_id is the response and the others
are revisits of it; every row that carries that id and payload is a response.  A null id among copies is a revisit unless
no copy has an id.  Null URLs are written as an empty target.  An empty table writes an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

INDEX = "page_id bigint, url string, archive string, offset bigint, length bigint, digest string, payload_bytes bigint, record_type string, refers_to bigint"
DATE = "2024-01-01T00:00:00Z"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page, url: str | None, payload: bytes, digest: str, refers) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % (b"" if page is None else b"%d" % page),
            b"WARC-Date: " + DATE.encode(), b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode(), b"WARC-Payload-Digest: sha1:" + digest.encode(),
            b"X-Payload-Length: %d" % len(payload)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http
    if refers is None:
        block += payload
    else:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record and its payload (None for a revisit)."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    field = dict(x.split(b": ", 1) if b": " in x else (x.rstrip(b":"), b"") for x in head.split(b"\r\n")[1:])
    block = rest[:int(field[b"Content-Length"])]
    number = lambda name: int(x[10:-1]) if len(x := field.get(name, b"<urn:page:>")) > 11 else None
    kind = field[b"WARC-Type"].decode()
    return {"page_id": number(b"WARC-Record-ID"), "url": field[b"WARC-Target-URI"].decode(), "record_type": kind, "refers_to": number(b"WARC-Refers-To"),
            "digest": field[b"WARC-Payload-Digest"].decode()[5:], "payload_bytes": int(field[b"X-Payload-Length"]), "payload": block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _int(x):
    return None if x is None or x != x else int(x)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = 256 << 20, level: int = 1) -> DataFrame:
    """Writes the archives and returns their stored index."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    sums = rows.select("page_id", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").alias("size"))
    copies = sums.filter(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    copies = C.stored(copies, "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    again = C.join_groups(sums, copies, "sha", "page_id", total)
    again = again.filter("first is not null and not first <=> page_id").select(F.col("page_id").alias("_p"), F.col("sha").alias("_s"), F.col("first").alias("refers_to")).distinct()
    rows = rows.join(C.stored(again, "revisits"), F.col("page_id").eqNullSafe(F.col("_p")) & (F.unhex(F.sha1("payload")) == F.col("_s")), "left").select("page_id", "url", "payload", "refers_to")

    def run(batches):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for page, url, text, refers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    if out is None or at >= roll_bytes:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload = text.encode()
                    digest = sha1_base32(payload)
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = z.compress(record(page, url, payload, digest, refers)) + z.flush()
                    out.write(member)
                    found.append((page, url, name, at, len(member), digest, len(payload), "response" if refers is None else "revisit", refers))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), TYPES)] if found else [pa.array([], t) for t in TYPES], NAMES)
        finally:
            if out:
                out.close()

    import pyarrow as pa

    NAMES = [x.split()[0] for x in INDEX.split(", ")]
    TYPES = [{"bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]
    return C.stored(rows.mapInArrow(run, INDEX), "warc-index")


def ranges(index: DataFrame, max_gap: int = 64 << 10, range_bytes: int = 8 << 20) -> DataFrame:
    """(archive, start, stop, records): neighbouring records of an archive, at most about range_bytes together."""
    w = Window.partitionBy("archive").orderBy("offset")
    end = F.col("offset") + F.col("length")
    cut = (F.col("offset") - F.lag(end).over(w) > max_gap) | (F.floor(F.col("offset") / range_bytes) != F.floor(F.lag("offset").over(w) / range_bytes))
    r = index.select("archive", "offset", "length").withColumn("cut", F.coalesce(cut.cast("int"), F.lit(1))).withColumn("r", F.sum("cut").over(w))
    return r.groupBy("archive", "r").agg(F.min("offset").alias("start"), F.max(end).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")).drop("r")


def tasks(n: int) -> int:
    """How many tasks read n ranges: one each up to 1,024, then up to 16 each."""
    return max(1, min(n, max(1024, -(-n // 16))))


def read(index: DataFrame, folder: str, **kw) -> DataFrame:
    """The records that the index rows name, read back and checked against their digests.

    The ranges are stored and counted first: their rows are few bytes, so nothing but their number tells how much they stand for.
    """
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"

    def run(frames):
        fs, root = _filesystem(folder)
        for frame in frames:
            for archive, start, stop, records in frame.itertuples(index=False, name=None):
                with fs.open_input_file(f"{root}/{archive}") as f:
                    f.seek(start)
                    raw = f.read(stop - start)
                rows = []
                for r in records:
                    x = parse(zlib.decompress(raw[r["offset"] - start:r["offset"] - start + r["length"]], 31))
                    if x["payload"] is not None and (sha1_base32(x["payload"]) != x["digest"] or len(x["payload"]) != x["payload_bytes"]):
                        raise ValueError(f"{archive} at {r['offset']}: the payload does not match its digest")
                    rows.append((x["page_id"], x["url"], x["record_type"], x["refers_to"], x["digest"], x["payload_bytes"], x["payload"]))
                out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])
                for c in ("page_id", "refers_to"):
                    out[c] = pd.array([r[out.columns.get_loc(c)] for r in rows], "Int64")
                yield out

    r = C.stored(ranges(index, **kw), "warc-ranges")
    return r.repartition(tasks(r.count()), F.col("archive"), F.col("start")).select("archive", "start", "stop", "records").mapInPandas(run, schema)
