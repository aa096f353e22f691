"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

Global row numbers come from a count per hash bucket of a row (doc_id, size and CRC of the
text) and a row number inside the bucket, so no task ever sorts more than its buckets. Rows
equal in all three are counted first, before anything is sorted, and number off from there, so
that a value that many rows share makes no hot bucket. A Feistel network over the smallest
power of two that holds all rows, applied again while the value falls outside, permutes the
row numbers. Permuted number r goes to shard r mod k, slot r div k: counts are at most one
apart (law ``rows``), slots are gapless, and both can be computed for any row number alone.

Defined cases: a null text has size 1 and the CRC of no bytes, 0; a null doc_id is a value
of its own, and its rows are spread by their texts; repeated rows get different numbers; very
long texts are only measured; an empty table gives no rows; columns other than doc_id and text
are not read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import own_columns, table

SHARDS = 8
SEED = 20240229
ROUNDS = 8
#: Buckets of the row numbering; one small count per bucket is all that is broadcast.
BUCKETS = 4096
#: Walks before the job fails loudly; each ends with a probability of at least a half.
WALKS = 128


def _round(half: Column, k: int, seed: int) -> Column:
    return F.xxhash64(half, F.lit(seed + k).cast("long"))


def feistel(x: Column, bits: int, seed: int = SEED) -> Column:
    """A bijection of [0, 2^bits); the two halves change in turn."""
    low = bits // 2
    high = bits - low
    left, right = F.shiftright(x, low), x.bitwiseAND(F.lit((1 << low) - 1).cast("long"))
    for k in range(ROUNDS):
        if k % 2 == 0:
            left = left.bitwiseXOR(_round(right, k, seed).bitwiseAND(F.lit((1 << high) - 1).cast("long")))
        else:
            right = right.bitwiseXOR(_round(left, k, seed).bitwiseAND(F.lit((1 << low) - 1).cast("long")))
    return F.shiftleft(left, low).bitwiseOR(right)


def permute(row: Column, n: int, seed: int = SEED) -> Column:
    """The image of row numbers [0, n) under the permutation of [0, n)."""
    bits = max(2, (n - 1).bit_length())
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        feistel(row.cast("long"), bits, seed),
        lambda at, _: F.when(at >= n, feistel(at, bits, seed)).otherwise(at),
    )
    return walked


def row_numbers(docs: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32 and ``row`` from 0 without gaps; and the number of rows."""
    text = F.coalesce("text", F.lit(""))
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int")
    d = own_columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    d = d.groupBy(bucket.alias("bucket"), "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    base, total = [], 0
    for r in sorted(d.groupBy("bucket").agg(F.sum("copies").alias("n")).collect(), key=lambda r: r["bucket"]):
        base.append((r["bucket"], total))
        total += r["n"]
    starts = docs.sparkSession.createDataFrame(base, "at int, base long")
    w = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    d = d.withColumn("before", F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    d = d.join(F.broadcast(starts), F.col("bucket") == F.col("at"))
    d = d.select("doc_id", "size", "text_crc32", (F.col("base") + F.col("before")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    return d.select("doc_id", "size", "text_crc32", (F.col("first") + F.col("copy")).alias("row")), total


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    d, n = row_numbers(docs)
    to = permute(F.col("row"), max(n, 1), seed)
    d = d.withColumn("to", to)
    checked = F.when(F.col("to") < max(n, 1), F.col("to")).otherwise(
        F.raise_error(F.lit("cycle walk too long; take another seed")).cast("long")
    )
    d = d.withColumn("to", checked)
    return d.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("to") % shards).cast("int").alias("shard"),
        F.floor(F.col("to") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_feistel_shards(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
