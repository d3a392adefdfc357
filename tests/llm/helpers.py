"""Small tables for the operator tests."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows, extra: str = "") -> DataFrame:
    """Documents from (doc_id, text) pairs, in several partitions; ``extra`` adds a constant column of that name."""
    data = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(data, DOCS)
    df = df.repartition(3) if data else df
    return df.selectExpr("*", f"'kept' as `{extra}`") if extra else df


def read(table: str, folder: str = SF001) -> pd.DataFrame:
    return duckdb.sql(f"select * from '{folder}/{table}.parquet'").df()


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, list) else (False, "list", str(x)) for x in r))
