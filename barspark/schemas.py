"""Column names and schemas of the inputs."""

from pyspark.sql import types as T

BAR_COLUMNS = ["open", "high", "low", "close", "vwap"]
REQUIRED_BACKTEST = ["timestamp", "open", "high", "low", "close", "vwap"]
REQUIRED_CATALOG = ["timestamp", "open", "high", "low", "close", "volume"]

BLACKOUT = T.StructType([T.StructField("event_date", T.DateType())])
