"""Results to and from Parquet: written in parallel by whatever partitions the result has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Schemas of what the engine writes, so that reading never infers.
SCHEMAS = {
    "states": "s long",
    "vector": "s long, re double, im double",
    "matrix": "r long, c long, re double, im double",
    "terms": "x long, z long, re double, im double",
    "components": "mat_id long, k int, re double, im double",
    "energies": "key double, level int, energy double, iterations int, residual double",
}


def write(df: DataFrame, path: str, kind: str | None = None, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write a result; with ``kind`` its columns are checked against the known schema first."""
    if kind is not None:
        want = [c.strip().split(" ")[0] for c in SCHEMAS[kind].split(",")]
        if sorted(want) != sorted(df.columns):
            raise ValueError(f"a {kind} has the columns {want}, not {df.columns}")
        df = df.select(want)
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).parquet(path)
