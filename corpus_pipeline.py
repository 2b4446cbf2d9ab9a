"""A training corpus from ``documents``: five stages, each written and reread as the next one's input."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactlake.llm import bpe, exact, mixing, near, toxicity
from redactlake.llm.tables import documents, replace_columns, staged

#: Target weights of the mixture; every other source weighs OTHER_WEIGHT.
WEIGHTS, OTHER_WEIGHT = {"src0": 4.0}, 1.0

#: The grammar is learned from labels, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below one half."""
    grammar = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, grammar)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact content."""
    return exact.keep_one_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    return near.keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that keeps the sources at their target weights."""
    key = F.struct("doc_id", F.xxhash64("text"))
    return mixing.in_mixed_order(docs, WEIGHTS, key, other=OTHER_WEIGHT, stage_input=False)


def file_order(path: str) -> tuple:
    """Sorts the files of a written table as their rows were when they were written: by task, then by file of the task."""
    name = path.rpartition("/")[2]
    part, count = re.match(r"part-(\d+)", name), re.search(r"-c(\d+)", name)
    return int(part[1]) if part else -1, int(count[1]) if count else -1, name, path


def with_position(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``, the place from 0 of a row in the order in which the table was written.

    A read packs files by size, so the order of its rows is not that of the files.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # not a table of files
        docs = staged(docs, "ordered")
    docs = docs.select(*replace_columns(docs, ["position"]), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = {r["_file"]: r["n"] for r in docs.groupBy("_file").agg((F.max("_row") + 1).alias("n")).collect()}
    before, starts = 0, []
    for file in sorted(sizes, key=file_order):
        starts.append((file, before))
        before += sizes[file]
    starts = F.broadcast(spark.createDataFrame(starts, "_file string, _start long"))  # one row a file
    return docs.join(starts, "_file").withColumn("position", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, the text that they decode to and the document's place in the mixture."""
    want = ["n_tokens", "ids", "decoded"]
    placed = with_position(spark, docs.select("doc_id", "source", "text"))
    return bpe.bpe_columns(placed, public_tokenizers.path("byte_bpe_50k.json"), want=want).select("doc_id", "source", "position", *want)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
