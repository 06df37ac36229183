"""Readers and writers: parquet tables, JSON files and the append-only version store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ingest import version_append
from ..session import pin

REPRESENTATION = (
    "STRUCT<id: STRING, environment: STRING, network: STRING, contract: STRING, relationship: STRING, "
    "parent: STRING, shareClass: STRING>"
)
SEMANTIC_CASE = (
    f"caseId STRING, fixtureStatus STRING, description STRING, representations ARRAY<{REPRESENTATION}>, "
    "relationshipExpectation STRING, equivalenceExpectation STRING, reason STRING, "
    "claim STRUCT<id: STRING, property: STRING, state: STRING, evidenceRefs: ARRAY<STRING>>, "
    "evidence STRUCT<id: STRING, freshness: STRING, authority: STRING>, "
    "exception STRUCT<type: STRING, severity: STRING>, expectedObjectState STRING, expectedMandateDecision STRING"
)
SNAPSHOT = (
    "id STRING, sourceId STRING, uri STRING, contentType STRING, contentHash STRING, fetchedAt BIGINT, "
    "httpStatus INT, etag STRING, lastModified STRING, bodyStorageRef STRING, extractionVersion STRING"
)


def read_json(spark: SparkSession, path: str, schema: str | StructType, multi_line: bool = True) -> DataFrame:
    """JSON documents with a declared schema, never an inferred one."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_versions(spark: SparkSession, path: str, batch: DataFrame, payload: DataFrame) -> DataFrame:
    """Append the new versions of `batch` to the store at `path` and return all outcomes.

    The store holds one parquet row per (object, version), bucketed by a hash folder of the
    object so a lookup reads one folder.
    """
    try:
        store = spark.read.parquet(path).select("object_id", "version", "root")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        store = batch.select("object_id", "version", "root").limit(0)
    outcomes = pin(version_append(store, batch))  # fixed before the store grows
    fresh = outcomes.filter(F.col("outcome") == "APPENDED").drop("outcome")
    (
        fresh.join(payload, ["object_id", "version", "seq"], "left")
        .withColumn("folder", F.pmod(F.xxhash64("object_id"), F.lit(64)))
        .write.mode("append").partitionBy("folder").parquet(path)
    )
    return outcomes
