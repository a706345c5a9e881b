"""Folders of test tables that are empty, or hold only rows of nulls, or hold every row twice with extra columns."""

import glob
import os

from pyspark.sql import functions as F

#: Columns that clash with names used inside operators.
EXTRA = ("idx", "source", "unit", "field", "number", "state", "common", "value", "name", "kind", "score", "bin", "size", "piece", "container")


def write(spark, sf, folder, how):
    for f in glob.glob(f"{sf}/*.parquet"):
        df = spark.read.parquet(f)
        if how == "empty":
            df = df.limit(0)
        elif how == "nulls":
            null = spark.createDataFrame([tuple(None for _ in df.columns)] * 3, df.schema)
            df = null
        else:
            df = df.union(df)
            for c in EXTRA:
                if c not in df.columns:
                    df = df.withColumn(c, F.lit("clash"))
        df.coalesce(1).write.parquet(f"{folder}/{os.path.basename(f)}")
    return str(folder)
