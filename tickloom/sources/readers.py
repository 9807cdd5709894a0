"""Readers with the checks each source needs.  Reads are lazy; a violated rule fails the job."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .. import schemas
from ..functions.scalars import MINUTE, floor_to
from ..operators import scan
from ..operators.quality import bad_bar, fail_if, require_columns
from ..operators.resample import flow_buckets


def reject_duplicates(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return fail_if(df.withColumn("_n", n), F.col("_n") > 1, message).drop("_n")


def epoch_micros(c) -> Column:
    """Epoch seconds, milliseconds or microseconds (told apart by magnitude) as microseconds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < 10 ** 11, c * 1_000_000).when(c < 10 ** 14, c * 1000).otherwise(c).cast("long")


def validate_bars(df: DataFrame, start: int, end: int, step: int, strict_step: bool = True, zero: bool = False, traded: DataFrame | None = None) -> DataFrame:
    """Bars in [start, end); a bad bar fails the job.  ``zero`` is for sources whose prices go down to 0.

    A step other than ``step`` fails too.  ``traded(symbol, ts)`` is for sources that have no bar where nothing was traded: each of
    its times must have one bar and no other time any, so a step is longer only over times without trades.
    """
    if end <= start:
        raise ValueError("the interval is empty")
    inside = (F.col("ts") >= start) & (F.col("ts") < end)
    d = require_columns(df, "symbol", "ts", "open", "high", "low", "close", "volume").filter(inside)
    d = fail_if(d, bad_bar(zero), "invalid bar")
    if traded is not None:
        d = reject_duplicates(d, ["symbol", "ts"], "bar step differs")
        t = traded.filter(inside).select(F.col("symbol").alias("_s"), F.col("ts").alias("_t")).distinct()
        d = d.withColumn("_b", F.lit(True)).join(t.withColumn("_e", F.lit(True)), F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("ts") == F.col("_t")), "full_outer")
        off = F.col("_b").isNull() | F.col("_e").isNull() | (F.pmod("ts", F.lit(step)) != 0)
        d = fail_if(d, off, "bar step differs").drop("_b", "_s", "_t", "_e")
    elif strict_step:
        d = scan.framed(d, ["symbol"], ["ts"], lambda w: {"_dt": F.col("ts") - F.lag("ts", 1).over(w)}, back=1)
        d = fail_if(d, F.col("_dt").isNotNull() & (F.col("_dt") != step), "bar step differs").drop("_dt")
    return d


def load_bars_csv(spark: SparkSession, path: str, start: int, end: int, step: int, strict_step: bool = True, zero: bool = False, traded: DataFrame | None = None) -> DataFrame:
    """Columns go by the names in the header, which all files share; a file with another one fails, and so does a missing column."""
    kinds = {f.name: f.dataType for f in schemas.BAR}
    names = spark.read.csv(path, header=True).columns
    raw = spark.read.schema(T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    return validate_bars(require_columns(raw, *kinds).select(*kinds), start, end, step, strict_step, zero, traded)


def explode_archives(files: DataFrame, columns: tuple[str, ...] = schemas.KLINE_COLUMNS) -> DataFrame:
    """CSV members of zip files as string columns; ``files(path, content)`` as from the binaryFile source.

    One archive is one task's unit, and its lines stream out in batches.
    """
    import pandas as pd

    width = len(columns)

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        with z.open(member) as fh:
                            for part in pd.read_csv(fh, header=None, dtype=str, chunksize=100_000, names=range(width)):
                                part.columns = list(columns)
                                part.insert(0, "member", member)
                                part.insert(0, "path", path)
                                yield part

    schema = ", ".join(["path string", "member string", *[f"`{c}` string" for c in columns]])
    return files.select("path", "content").mapInPandas(unzip, schema).filter(~F.lower(F.trim(F.col(columns[0]))).eqNullSafe(F.lit(columns[0])))


def kline_rows(raw: DataFrame, zero: bool = False) -> DataFrame:
    """Typed bars from exploded kline archives; the symbol is the member's leading name part."""
    num = lambda c, t="double": F.col(c).cast(t)
    d = raw.select(
        F.split("member", "-")[0].alias("symbol"), epoch_micros(num("open_time", "long")).alias("ts"),
        *[num(c).alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume")],
        num("trade_count", "long").alias("trade_count"), num("taker_buy_quote").alias("taker_buy_quote"))
    d = fail_if(d, bad_bar(zero), "invalid bar")
    return reject_duplicates(d, ["symbol", "ts"], "duplicate bar")


def load_kline_archive(spark: SparkSession, glob: str) -> DataFrame:
    return kline_rows(explode_archives(spark.read.format("binaryFile").load(glob)))


def trade_archive_flow(trades: DataFrame, width: int = MINUTE) -> DataFrame:
    """Aggregate trades to flow buckets; a buyer who is not the maker bought aggressively."""
    t = trades.select("symbol", epoch_micros("transact_time").alias("ts"), "price", F.col("quantity").alias("qty"),
                      F.when(F.lower(F.trim("is_buyer_maker")) == "false", 1).otherwise(-1).alias("sgn"))
    return flow_buckets(t, width)


def clean_funding(df: DataFrame, strict: bool = False) -> DataFrame:
    """One record per (symbol, funding_time); strict mode fails on any repeated natural key with another rate."""
    d = df.select("symbol", F.col("funding_time").cast("long").alias("funding_time"), F.col("rate").cast("decimal(38,18)").alias("rate"))
    g = d.groupBy("symbol", "funding_time").agg(F.min("rate").alias("rate"), F.count_distinct("rate").alias("_k"))
    if strict:
        g = fail_if(g, F.col("_k") > 1, "conflicting funding rates")
    return g.drop("_k")


def load_funding(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return clean_funding(spark.read.schema(schemas.FUNDING).csv(path, header=True), strict)


def load_mark(spark: SparkSession, path: str) -> DataFrame:
    """Mark price lines ``time,close``; the header line ``open_time,...`` is left out, any other bad line or a duplicate minute fails."""
    p = F.split("value", ",")
    d = spark.read.text(path).filter(~F.col("value").startswith("open_time,")).select(
        epoch_micros(p[0].cast("long")).alias("ts"), p[1].cast("double").alias("mark_close"))
    d = d.withColumn("ts", floor_to("ts", MINUTE))
    return reject_duplicates(d, ["ts"], "duplicate mark minute")


def load_quotes(spark: SparkSession, path: str) -> DataFrame:
    q = spark.read.schema(schemas.QUOTE).csv(path, header=True)
    q = fail_if(q, F.col("bid_price") > F.col("ask_price"), "crossed quote")
    return q.withColumn("mid", (F.col("bid_price") + F.col("ask_price")) / 2)


def load_trades(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.schema(schemas.TRADE).csv(path, header=True)
    return t.withColumn("signed_notional", F.when(F.col("side") == "buy", 1).otherwise(-1) * F.col("price") * F.col("amount"))


def load_l2(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.L2).csv(path, header=True)


def assert_monotone(df: DataFrame, local: str, position: str, slice_width: int = 65536) -> DataFrame:
    d = scan.framed(df, ["symbol"], [position], lambda w: {"_dl": F.col(local) - F.lag(local, 1).over(w)}, back=1, slice_width=slice_width)
    return fail_if(d, F.coalesce(F.col("_dl") < 0, F.lit(False)), "local time goes back").drop("_dl")


def observed_manifest(bars: DataFrame, step: int) -> DataFrame:
    """rows, first, last, gaps and duplicates per symbol, the fields a manifest states."""
    from ..operators.quality import bar_quality

    return bar_quality(bars, step).select("symbol", "rows", "first_ts", "last_ts", "gaps", "duplicates")


def load_verified(bars: DataFrame, manifest: DataFrame, step: int) -> DataFrame:
    """Bars of the symbols in ``manifest``; any difference to the observed counts fails."""
    obs = observed_manifest(bars, step)
    names = ("rows", "first_ts", "last_ts", "gaps", "duplicates")
    j = manifest.select("symbol", *[F.col(n).alias(f"_m_{n}") for n in names]).join(obs, "symbol", "left")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_m_{n}"))
    return bars.join(fail_if(j, ~same, "manifest mismatch").select("symbol"), "symbol", "left_semi")


def load_candle_table(table: DataFrame, start: int, end: int, row_id: str, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts <= end, the smallest row id per (symbol, ts) wins (filter pushes into the scan)."""
    w = Window.partitionBy("symbol", ts).orderBy(row_id)
    return table.filter(F.col(ts).between(start, end)).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def parse_journal(lines: DataFrame, id_col: str, schema: str) -> DataFrame:
    """JSON lines to typed rows with ``status``: ok, duplicate (same payload again), conflict, invalid, blank.

    ``lines`` needs ``value`` and a ``seq`` that orders repeats; the first good row of an identity is ok.
    """
    st = T.StructType.fromDDL(schema + ", _corrupt string") if isinstance(schema, str) else schema
    d = lines.withColumn("_j", F.from_json("value", st, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    blank = F.trim("value") == ""
    bad = F.col("_j._corrupt").isNotNull() | F.col(f"_j.{id_col}").isNull()
    ident = F.coalesce(F.col(f"_j.{id_col}").cast("string"), F.concat(F.lit("#"), F.col("seq").cast("string")))
    d = d.select("seq", "_j", blank.alias("_blank"), bad.alias("_bad"), ident.alias("_id"), F.sha2("value", 256).alias("_h"))
    per = d.filter("not _blank and not _bad").groupBy("_id").agg(F.count_distinct("_h").alias("_k"), F.min("seq").alias("_first"))
    d = d.join(per, "_id", "left")
    status = F.when(F.col("_blank"), "blank").when(F.col("_bad"), "invalid").when(F.col("_k") > 1, "conflict").when(
        F.col("seq") > F.col("_first"), "duplicate").otherwise("ok")
    return d.select("seq", status.alias("status"), "_j.*").drop("_corrupt")


def read_journal(spark: SparkSession, path: str, id_col: str, schema: str) -> DataFrame:
    """Identity-checked rows of a JSON-lines journal; conflicting payloads of one identity fail."""
    # file, place of the split in it, and order within the split: the order of the lines however files are split
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line")).alias("seq"))
    d = parse_journal(lines, id_col, schema)
    # one predicate: Catalyst may reorder two filters and drop a conflict before it is seen
    keep = F.when(F.col("status") == "conflict", F.raise_error(F.lit("conflicting payloads")).cast("boolean")).otherwise(F.col("status") == "ok")
    return d.filter(keep).drop("status", "seq")


def pair_trades(journal: DataFrame) -> DataFrame:
    """One row per trade id from OPEN and CLOSED rows (latest of each), with a pairing status."""
    pick = lambda s: F.max_by(F.struct(*[c for c in journal.columns if c not in ("trade_id", "status")]),
                              F.when(F.col("status") == s, F.struct("seq")))
    g = journal.groupBy("trade_id").agg(pick("OPEN").alias("opened"), pick("CLOSED").alias("closed"))
    st = F.when(F.col("opened").isNull(), "close_only").when(F.col("closed").isNull(), "open_only").otherwise("paired")
    return g.withColumn("pairing", st)


def first_number(*paths) -> Column:
    """First nested path that holds a number."""
    return F.coalesce(*[F.col(p).try_cast("double") for p in paths])
