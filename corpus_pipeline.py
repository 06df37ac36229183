"""A corpus pipeline over `documents`: rules, lines, near copies, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. `run` writes every stage's rows as Parquet into the shared checkpoint folder and
reads them again, which cuts the lineage: a lost executor costs tasks of the running stage only.
No stage but the first and the last is expressible in SQL, so ORACLE_SQL is None and the tests compare
every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritab.llm.op1_mixing import mix
from veritab.llm.op2_decontamination import drop_contaminated
from veritab.llm.op5_line_dedup import drop_common_lines
from veritab.llm.op7_simhash import drop_near_copies
from veritab.llm.op9_quality import keep_good
from veritab.session import scratch_path

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that ten documents share."""
    return drop_common_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of them, repeats counted."""
    return mix(docs).filter("taken > 0")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("benchmark leaks", benchmark_leaks),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
