"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt by hash into groups of about ``GROUP`` pieces, and every group is packed on
its own by best-fit decreasing: a piece goes to the open bin with the least room that still
holds it. Where none does, the sizes compete for the new bin: each is filled, as far as it
goes, with the pieces still to come, downsized to what it then holds, and the least cost a
token wins. When all is placed each bin is downsized to the smallest permitted length that
holds its contents. A document longer than the largest size is cut into full pieces and a
rest; nothing is dropped. The length of a document is its tokens (as counted by ``bpe_count``)
and one separator, or the column given for it.

Defined cases: a null or empty text has length 1, its separator; a null length counts as 1 too;
repeated rows are packed each for itself; rows are dealt by doc_id, text and, where both are the same,
a number of the copy, and equal lengths go in that order, so that the bins are the same however the
rows were split; an empty table gives no rows; only doc_id, text and the length are read, and other columns may have any names. The texts
themselves are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_count import n_tokens
from .common import own_columns, table

SIZES = (512, 1024, 2048, 4096)
GROUP = 4000
#: Copies of a row that are numbered at once.
COPIES = 1 << 16


def cost(size: int) -> float:
    """Of one sequence: its tokens, its attention, and a fixed part for the step."""
    return size + size * size / 16384 + 64


def filled(start: int, size: int, later: list[int], at: int) -> int:
    """Tokens in a bin of ``size`` that begins with ``start`` and takes, of the pieces from
    ``at`` on (negative lengths, rising), each time the longest that still fits."""
    used = start
    while at < len(later):
        at = bisect_left(later, used - size, at)
        if at == len(later):
            break
        used -= later[at]
        at += 1
    return used


def open_size(length: int, later: list[int], at: int, sizes=SIZES) -> int:
    """The size for a new bin: least cost a token after such filling and downsizing."""

    def price(size: int) -> tuple[float, int]:
        used = filled(length, size, later, at)
        return cost(next(s for s in sizes if s >= used)) / used, size

    return min((s for s in sizes if s >= length), key=price)


def pack(lengths: list[int], sizes=SIZES) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing over pieces sorted by falling length.

    Returns each piece's bin and offset, and the final size of each bin.
    """
    room: list[tuple[int, int]] = []  # (room, bin) of the open bins, sorted
    used: list[int] = []
    later = [-n for n in lengths]
    bins, offsets = [], []
    for at, n in enumerate(lengths, 1):
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            b, free = len(used), open_size(n, later, at, sizes)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return bins, offsets, [next(s for s in sizes if s >= u) for u in used]


def place(docs: DataFrame, sizes=SIZES, group: int = GROUP, length: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start and length of it in the document, the
    bin's group and number, the offset in the bin, the bin's size and its fill.

    length: a column with the documents' lengths, separator included; else tokens are counted.
    """
    largest = max(sizes)
    d = own_columns(docs, "doc_id", "text", *([length] if length else []))
    n = F.greatest(F.coalesce(F.col(f"`{length}`"), F.lit(1)), F.lit(1)) if length else n_tokens(d) + 1
    # Equal rows are counted and numbered, so that nothing depends on how the scan was split.
    d = d.select("doc_id", F.xxhash64("text").alias("row"), n.cast("long").alias("n_tokens"))
    d = d.groupBy("doc_id", "row", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    zero = F.lit(0).cast("long")
    d = d.withColumn("block", F.explode(F.sequence(zero, F.expr(f"(copies - 1) div {COPIES}"))))
    within = F.sequence(zero, F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("block") * COPIES) - 1)
    d = d.withColumn("within", F.explode(within)).withColumn("copy", F.col("block") * COPIES + F.col("within"))
    n_pieces = F.ceil(F.col("n_tokens") / F.lit(largest)).cast("long")
    d = d.select("doc_id", "row", "copy", "n_tokens", F.explode(F.sequence(zero, n_pieces - 1)).alias("piece"))
    start = F.col("piece") * largest
    d = d.select("doc_id", "row", "copy", "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(largest).cast("long")).alias("length"))
    # No more pieces than this, as a token has a byte at least; they are dealt, so no group is hot.
    size = F.ceil((F.octet_length(F.coalesce("`text`", F.lit(""))) + 1) / F.lit(largest))
    size = F.ceil(F.col(f"`{length}`") / F.lit(largest)) if length else size
    pieces = docs.agg(F.sum(F.greatest(F.coalesce(size, F.lit(1)), F.lit(1))).alias("n")).first()["n"]
    groups = max(1, -(-(pieces or 0) // group))
    deal = F.pmod(F.xxhash64("doc_id", "row", "copy", "piece"), F.lit(groups)).cast("int")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "row", "copy", "piece"))])
        lengths = rows["length"].to_pylist()
        bins, offsets, final = pack(lengths, sizes)
        fill = [0] * len(final)
        for b, n in zip(bins, lengths, strict=True):
            fill[b] += n
        for name, values in (("bin", bins), ("offset", offsets), ("bin_size", [final[b] for b in bins]), ("bin_fill", [fill[b] for b in bins])):
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows.drop_columns(["row", "copy"])

    out = "doc_id long, piece long, start long, length long, bin_group int, bin long, offset long, bin_size long, bin_fill long"
    return d.withColumn("bin_group", deal).groupBy("bin_group").applyInArrow(run, out)


def op10_best_fit(spark, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"))
