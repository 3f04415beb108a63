"""Fixed schemas of the engine's tables (never inferred)."""

from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("mtime_ns", T.LongType(), True),
    T.StructField("size", T.LongType(), True),
    T.StructField("hash", T.StringType(), True),
    T.StructField("indexed", T.BooleanType(), True),
])

DIMENSION = T.StructType([
    T.StructField("name", T.StringType(), True),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("target", T.DoubleType(), True),
    T.StructField("weight", T.DoubleType(), True),
])

TUNING_DOC = T.StructType([
    T.StructField("baseline_score", T.DoubleType(), True),
    T.StructField("dimensions", T.ArrayType(DIMENSION), True),
])
