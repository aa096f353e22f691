"""Benchmark decontamination by a broadcast hash set of normalised benchmark n-grams.

Documents are scanned window by window. A window whose fingerprint may be in the set (a
bitmap sized by the counted n-grams up to a bound, part of the scan, made from wholly lower-cased words with one sigma, and
so without misses: equal words are equal there too) becomes a candidate and carries its words; the candidates are then verified word for
word against the benchmark's n-grams. Only verified hits count. The n-gram table is broadcast while its measured size is under
``BROADCAST_BYTES``; beyond that the same join is shuffled.

Words: A-Z lower-cased, then runs outside \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F. An item of
fewer than ``n`` words, but not none, is one window of its own length.

Defined cases: null texts have no words and no hits; an empty benchmark or an empty table
gives zero hits or no rows; repeated items count once each by item_id, a null item_id counts
as the id ``null``; repeated document rows are kept apart by a row key made before the scan,
and texts under one doc_id are judged apart; very long texts are worked on whole, in one row;
columns other than doc_id and text (item_id and text) are not read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, own_columns, packed, table, unpacked

N = 10
#: Bits of the scan's bitmap: at least 32 for each n-gram of the benchmark, in powers of two between
#: these bounds (128 KB and 8 MB). Above 2 million n-grams the share of windows that pass it without
#: being any grows, to 12 % with 8 million; all are verified, so results don't change.
BITMAP_BITS, MOST_BITS, BITS_A_GRAM = 1 << 20, 1 << 26, 32
#: The n-gram table is broadcast only when its measured text is smaller.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Words in their own case. Lower-casing a text, by any rule, never moves their bounds."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), "")


def folded(text: Column) -> Column:
    """Lower case whatever stands beside a letter: of all letters a capital sigma alone becomes
    one of two by its place in the word."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def _fingerprint(words: Column, start: Column, length: Column | int) -> Column:
    return F.xxhash64(F.slice(words, start, length))


def bitmap_bits(n_grams: int) -> int:
    """The bitmap's size for so many different n-grams."""
    return min(MOST_BITS, max(BITMAP_BITS, 1 << max(0, BITS_A_GRAM * n_grams - 1).bit_length()))


def _bit(fingerprint: Column, bits: int) -> Column:
    return F.pmod(fingerprint, F.lit(bits)).cast("int")


def benchmark_ngrams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item, len, gram, print), one row for each different window of an item."""
    items = own_columns(benchmark, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
        words_of(F.col("text")).alias("own"),
        words_of(folded(F.col("text"))).alias("w"),
    )
    items = items.filter(F.size("w") > 0).select("item", "w", "own", F.least(F.size("w"), F.lit(n)).alias("len"))
    starts = items.select("item", "w", "own", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i"))
    return starts.select(
        "item",
        "len",
        ascii_lower(F.array_join(F.slice("own", F.col("i"), F.col("len")), " ")).alias("gram"),
        _fingerprint(F.col("w"), F.col("i"), F.col("len")).alias("print"),
    ).distinct()


def _window_bits(length: int, n: int) -> Column:
    """The bitmap position of every window of ``length`` words of ``w``."""
    starts = F.sequence(F.lit(1), F.size("w") - (length - 1))
    bits = F.transform(starts, lambda i: _bit(_fingerprint(F.col("w"), i, length), n))
    return F.when(F.size("w") >= length, bits)


def _starts(set_bits: Column, length: int) -> Column:
    """Places of the windows whose bit is set."""

    def start_or_null(b: Column, i: Column) -> Column:
        word = F.get(set_bits, F.shiftright(b, 6))
        return F.when(F.bit_get(word, b.bitwiseAND(F.lit(63))) == 1, i + 1)

    return F.array_compact(F.transform(f"b{length}", start_or_null))


def _windows(length: int) -> Column:
    """(p, len, gram) of those places, with the words as they are compared."""

    def window(p: Column) -> Column:
        gram = ascii_lower(F.array_join(F.slice("own", p, length), " "))
        return F.struct(p.alias("p"), F.lit(length).alias("len"), gram.alias("gram"))

    return F.transform(f"s{length}", window)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per document: doc_id, the hash of its text, n_words, and ``found``, an array of
    (p, len, item) of verified windows (start positions from 1)."""
    grams = benchmark_ngrams(benchmark, n)
    size = grams.agg(F.sum(F.octet_length("gram") + 64), F.collect_set("len"), F.count(F.lit(1))).first()
    n_bits = bitmap_bits(size[2])
    # Bounded by construction: 64-bit words of a bitmap of at most MOST_BITS, and at most n lengths.
    words = grams.withColumn("bit", _bit(F.col("print"), n_bits)).groupBy((F.col("bit") / 64).cast("int").alias("k")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)).alias("bits")
    )
    bitmap = [0] * (n_bits // 64)
    for r in words.collect():
        bitmap[r["k"]] = r["bits"]
    lengths = sorted(size[1])
    by_gram = grams.groupBy("gram", "len").agg(F.collect_set("item").alias("items"))
    by_gram = by_gram.select(F.col("gram").alias("g"), F.col("len").alias("g_len"), "items")
    if (size[0] or 0) <= BROADCAST_BYTES:
        by_gram = F.broadcast(by_gram)
    keys = ["doc_id", "text_key", "n_words"]
    d = own_columns(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("text_key"), words_of(folded(F.col("text"))).alias("w"))
    # One literal, folded once: an array of literals would be a million of them.
    set_bits = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")
    d = d.select("doc_id", "text_key", "text", "w", *[_window_bits(ln, n_bits).alias(f"b{ln}") for ln in lengths])
    d = d.select("doc_id", "text_key", "text", F.size("w").cast("long").alias("n_words"), *[_starts(set_bits, ln).alias(f"s{ln}") for ln in lengths])
    found = [_windows(ln) for ln in lengths]
    some = F.array_max(F.array(F.lit(0), *[F.coalesce(F.size(f"s{ln}"), F.lit(0)) for ln in lengths])) > 0
    d = d.withColumn("own", F.when(some, words_of(F.col("text"))))
    if not found:
        none = F.array().cast("array<struct<p:int,len:int,item:string>>")
        return d.select(*keys, none.alias("found"))
    empty = F.array().cast("array<struct<p:int,len:int,gram:string>>")
    d = d.select(*keys, F.concat(*[F.coalesce(x, empty) for x in found]).alias("c"))
    d = d.withColumn("row", F.monotonically_increasing_id())
    c = d.select("row", *keys, F.explode_outer("c").alias("c")).select("row", *keys, "c.*")
    verified = c.join(by_gram, (F.col("gram") == F.col("g")) & (F.col("len") == F.col("g_len")), "left")
    hit = F.struct("p", "len", "items")
    per_doc = verified.groupBy("row", *keys).agg(
        F.collect_list(F.when(F.col("items").isNotNull(), hit)).alias("h")
    )
    flat = F.flatten(
        F.transform("h", lambda x: F.transform(x["items"], lambda t: F.struct(x["p"].alias("p"), x["len"].alias("len"), t.alias("item"))))
    )
    return per_doc.select(*keys, flat.alias("found"))


def hit_words(found: Column) -> Column:
    """Number of words in the union of the found windows."""
    spans = F.array_sort(F.transform(found, lambda x: F.struct(x["p"].alias("a"), (x["p"] + x["len"]).alias("b"))))
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"])).cast("long")).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    items = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item"])))
    r = hits(docs, benchmark, n).select("doc_id", "n_words", hit_words(F.col("found")).alias("n_hit"), items.alias("items"))
    return r.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents without a verified benchmark window, all columns kept."""
    bad = hits(docs, benchmark, n).filter(F.size("found") > 0).select(F.col("doc_id").alias("id"), F.col("text_key").alias("of")).distinct()
    rows = packed(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("of"))
    return unpacked(rows.join(bad, same, "left_anti"), docs.columns, "doc_id", "text")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS l FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, l, w[i:i+l-1] AS gram FROM (SELECT item_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, i, l, w[i:i+l-1] AS gram
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bl) WHERE len(w) >= l)),
h AS (SELECT dw.doc_id, dw.i, dw.l, g.item_id FROM dw JOIN g ON dw.l = g.l AND dw.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, i, l FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
