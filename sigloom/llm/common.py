"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..staging import cut, discard, folder, release

__all__ = ["WHITE", "cut", "discard", "folder", "release", "table", "unused"]

#: Characters that count as white space in every contract here.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
