"""Helpers of the Arrow-batched operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most, so that long texts and whole files don't pile up in a worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts, unless the session already keeps them smaller."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of columns in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def set_aside(docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """``docs`` with all columns but the ``used`` ones under names that no operator adds; ``put_back`` undoes it."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in used else f"_phyllo_{i}") for i, c in enumerate(docs.columns)])


def put_back(df: DataFrame, docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` out of what an operator made of ``set_aside(docs, used)``, under their own names."""
    return df.select(*[F.col(f"`{c}`" if c in used else f"_phyllo_{i}").alias(c) for i, c in enumerate(docs.columns)])
