"""A corpus pipeline of four operators: language, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read back as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismalake.llm.common import written
from prismalake.llm.langid import keep_identified
from prismalake.llm.minhash import keep_one_of_each
from prismalake.llm.packing import pack_stage
from prismalake.llm.suffix import drop_repeats

STAGES = [
    ("language", keep_identified),
    ("near_duplicates", keep_one_of_each),
    ("repeated_passages", drop_repeats),
    ("packing", pack_stage),
]

# No stage can be expressed in SQL as a whole (hashed model, sketches, suffix order, packing plan).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
