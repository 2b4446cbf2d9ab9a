"""Reading the given tables."""

from __future__ import annotations

import re
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession

from redactlake.sources.tables import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def derive(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run a fixture query over the tables it names."""
    mark = f"{crc32(folder.encode()):08x}"  # views of different folders stay apart
    made = set()

    def view(m: re.Match) -> str:
        name = f"{m[2]}_{mark}"
        if name not in made:
            made.add(name)
            table(spark, folder, m[2]).createOrReplaceTempView(name)
        return f"{m[1]}{name}"

    return spark.sql(re.sub(rf"(?i)(\b(?:FROM|JOIN)\s+)({'|'.join(TABLES)})\b", view, sql))
