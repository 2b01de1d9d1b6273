"""Posterior-draw tables: one row per draw, one column (or array) per parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Bookkeeping columns of a draws file and their names here (no dots).
DRAW_KEYS = {".chain": "chain", ".iteration": "iteration", ".draw": "draw"}


def read_draws(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Wide draws from Parquet or CSV: integer keys, every parameter a double (arrays untouched)."""
    raw = spark.read.csv(path, header=True) if fmt == "csv" else spark.read.format(fmt).load(path)
    out = []
    for name, dtype in raw.dtypes:
        col = F.col(f"`{name}`")
        if name in DRAW_KEYS or name in DRAW_KEYS.values():
            out.append(col.cast("int").alias(DRAW_KEYS.get(name, name)))
        elif dtype.startswith("array"):
            out.append(col.cast("array<double>").alias(name))
        else:
            out.append(col.cast("double").alias(name))
    return raw.select(*out)
