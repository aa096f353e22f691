"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh_path
from ..shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The six white-space characters that end a word.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def space_words(text: Column) -> Column:
    """Maximal runs of non-space characters; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\x09-\\x0D]+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII rows take the faster lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage through a table in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """As ``written``, dealt by key for good: joins on it read the table as it lies."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    d = df.repartition(n, key).dropDuplicates([key])
    d.write.bucketBy(n, key).sortBy(key).option("path", fresh_path(spark, label)).saveAsTable(name)
    return spark.table(name)


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others with clashing names never meet ours."""
    ship(docs.sparkSession)
    return docs.select(*[F.col(f"`{n}`") for n in names])


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the others in one struct ``rest``, where no name of theirs can
    clash with one of ours. ``unpacked`` gives the rows back."""
    d = own_columns(docs, *docs.columns)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    rest = F.struct(*others) if others else F.lit(None).cast("int")
    return d.select(*[F.col(f"`{n}`").alias(n) for n in names], rest.alias("rest"))


def unpacked(d: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """The given columns of packed rows; names: those that aren't in ``rest``."""
    return d.select(*[F.col(c) if c in names else F.col("rest").getField(c).alias(c) for c in columns])
