"""Column contracts of the input datasets."""

from pyspark.sql import types as T

BAR = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])

# Fixed value: column order of the exchange kline archives.
KLINE_COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count",
                 "taker_buy_volume", "taker_buy_quote", "ignore")

AGG_TRADE = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("quantity", T.DoubleType()),
    T.StructField("transact_time", T.LongType()), T.StructField("is_buyer_maker", T.StringType())])

FUNDING = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("funding_time", T.LongType()),
    T.StructField("rate", T.DecimalType(38, 18))])

QUOTE = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("local_timestamp", T.LongType()),
    T.StructField("bid_price", T.DoubleType()), T.StructField("bid_amount", T.DoubleType()),
    T.StructField("ask_price", T.DoubleType()), T.StructField("ask_amount", T.DoubleType())])

TRADE = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("local_timestamp", T.LongType()),
    T.StructField("id", T.StringType()), T.StructField("side", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("amount", T.DoubleType())])

L2 = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("local_timestamp", T.LongType()),
    T.StructField("is_snapshot", T.BooleanType()), T.StructField("side", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("amount", T.DoubleType())])
