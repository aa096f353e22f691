"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one
failure bit per rule; policies are masks over those bits, so a new policy version, or an
ablation of one rule, is a bitwise operation over the ledger and never reads texts again.

Defined cases: a null or empty text has no words, fails ``few_words`` and measures 0
everywhere; equal rows give equal ledger rows; an empty table gives an empty ledger;
columns other than doc_id and text are not read and may have any names. Very long texts are
handled inside one row with arrays of their words (n log n). Windows of a text count as equal
when their 64-bit hashes are: some 10^-12 of texts of a few thousand words could be told wrong.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, own_columns, space_words

WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Rule name -> failure condition over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "exclamations": "100 * n_exclaim > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the rules whose failure drops a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICY = Policy("v1", tuple(RULES))


def _occurrences(char: str) -> Column:
    return F.length("text") - F.length(F.replace("text", F.lit(char), F.lit("")))


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the measured columns, in stages so that no array is computed twice."""
    d = own_columns(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.select(
        "doc_id",
        space_words(F.col("text")).alias("words"),
        lines.alias("lines"),
        sum(_occurrences(c) for c in SYMBOLS).cast("long").alias("n_symbols"),
        _occurrences("!").cast("long").alias("n_exclaim"),
    )
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    hashes = F.when(
        F.size("words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    )
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_exclaim",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("hashes"),
    )
    measured = ["n_words", "word_chars", "n_symbols", "n_exclaim", "n_lines", "n_dup_lines"]
    # Only texts with two equal windows sort them to find their places.
    windows = F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
    )
    d = d.select("doc_id", *measured, windows.alias("windows"))
    equal_neighbours = F.array_compact(
        F.zip_with(
            F.slice("windows", F.lit(1), F.size("windows") - 1),
            F.slice("windows", F.lit(2), F.size("windows") - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])),
        )
    )
    starts = F.when(F.col("windows").isNotNull(), F.array_sort(F.array_distinct(F.flatten(equal_neighbours))))
    d = d.select("doc_id", *measured, starts.alias("starts"))
    # The windows' union: each start adds the distance to the next one, five at most.
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(
            p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"]).cast("long")).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return d.select("doc_id", *measured, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements plus ``fail_bits``: bit k is set where rule k fails."""
    bits: Column = F.lit(0).cast("long")
    for k, condition in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return measurements(docs).withColumn("fail_bits", bits)


def failed(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(rows: DataFrame, policy: Policy = POLICY, base: Policy = BASE) -> DataFrame:
    """base_failed and kept for one policy version; no text is read."""
    return rows.withColumn("base_failed", failed(base)).withColumn("kept", ~failed(base) & ~failed(policy))


def ablations(rows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept without it.

    The ledger is first folded to one row per bit pattern (map-side), at most 2^rules rows.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    out = []
    for name in policy.rules:
        bit = 1 << list(RULES).index(name)
        rest = policy.mask & ~bit
        has = F.col("fail_bits").bitwiseAND(F.lit(bit)) != 0
        clean = F.col("fail_bits").bitwiseAND(F.lit(rest)) == 0
        out.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(has & clean, F.col("n"))), F.lit(0)).alias("n_only"),
                F.coalesce(F.sum(F.when(clean, F.col("n"))), F.lit(0)).alias("n_kept_without"),
            )
        )
    return patterns.agg(F.array(*out).alias("r")).select(F.inline("r"))


def op1_quality_ledger(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return apply_policy(ledger(table(spark, sf_dir, "documents")))


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of the policy drops, from the ledger of all documents."""
    from .common import table

    return ablations(ledger(table(spark, sf_dir, "documents")))


_LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY 1),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
        len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS u_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
b AS (SELECT *, n_lines - u_lines AS n_dup_lines FROM m),
f AS (SELECT *, ((n_words < 10)::INT + (100 * n_repeat_words > 20 * n_words)::INT * 2
        + (100 * n_symbols > 10 * n_words)::INT * 4 + (100 * n_dup_lines > 30 * n_lines)::INT * 8
        + (100 * n_exclaim > 20 * n_words)::INT * 16 + (word_chars < 2 * n_words)::INT * 32
        + (word_chars > 20 * n_words)::INT * 64)::BIGINT AS fail_bits FROM b)
"""
OP1_SQL = _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_exclaim, n_lines, n_dup_lines, n_repeat_words, fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept
FROM f
"""

ABLATIONS_SQL = _LEDGER_SQL + f"""
SELECT rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (fail_bits = bit)::BIGINT AS n_only,
       count(*) FILTER (fail_bits & (127 - bit) = 0)::BIGINT AS n_kept_without
FROM f, (SELECT unnest({list(RULES)}) AS rule, unnest([1, 2, 4, 8, 16, 32, 64]) AS bit) GROUP BY rule
"""
