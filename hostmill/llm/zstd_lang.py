"""Language identification by compression.

Every language has a zstandard raw-content dictionary. A text, lower-cased and whole, is
compressed in pieces of ``PIECE`` bytes with each dictionary, and the language of the smallest
output wins. All texts are measured alike: each piece follows ``HEAD`` bytes of the dictionary,
so that even a few words are coded, and what the head alone takes is subtracted. Where the
runner-up's output is larger by less than ``MARGIN``, the answer is marked ``rejected``.

Parameters with a bound: ``DOCS_PER_LANG`` training documents of a language are sampled, those
with the lowest hashes of doc_id. Their whole texts are read; the words that most of them
hold, then by name, are the dictionary, up to ``DICT_BYTES``, the most frequent last. More
than ``MOST_LANGUAGES`` languages are refused. ``MARGIN`` was set on training documents of
sf0.1 that are in no dictionary: of 1,860, 9 score below it and 3 of these are judged wrong.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text judged
with no language learned is ``und`` too; with one language learned every text is of it, score
1; ties go to the language with more training documents, then by name; equal texts get equal
answers; an empty table gives no rows; very long texts are worked on whole, in one task; only
doc_id, text and, for training, lang are read, and other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import own_columns, space_words, table
from .shingles import give_back, make_room

DOCS_PER_LANG = 150
DICT_BYTES = 32 << 10
MOST_LANGUAGES = 500
FOLDS = 5
#: An answer is rejected when the runner-up is larger by less than this share.
MARGIN = 0.02
#: Bytes of text and of dictionary that are compressed at once.
PIECE, HEAD = 2048, 512
NONE = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def training_words(docs: DataFrame) -> list[tuple[str, list[str]]]:
    """Per language, those with most training documents first: its words, most frequent first,
    as far as they go into a dictionary."""
    d = own_columns(docs, "doc_id", "text", "lang")
    d = d.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # First which documents, without their texts; then the texts of those alone, each once.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    chosen = d.select("doc_id", "lang", F.xxhash64("text").alias("key")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= DOCS_PER_LANG)
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), "key").distinct()
    same = (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l")) & (F.xxhash64("text") == F.col("key"))
    picked = d.join(F.broadcast(chosen), same).dropDuplicates(["l", "id", "key"])
    words = picked.select("l", F.explode(F.array_distinct(space_words(F.lower("text")))).alias("word"))
    counts = words.groupBy("l", "word").agg(F.count(F.lit(1)).alias("n"))
    # A dictionary has at most so many words of one byte and a space.
    by_count = Window.partitionBy("l").orderBy(F.desc("n"), "word")
    top = counts.withColumn("k", F.row_number().over(by_count)).filter(F.col("k") <= DICT_BYTES // 2)
    found: dict[str, list] = {}
    for r in top.filter(F.octet_length("word") <= DICT_BYTES).select("l", "k", "word").collect():
        found.setdefault(r["l"], []).append((r["k"], r["word"]))
    return [(lang, [w for _, w in sorted(found[lang])]) for lang in sorted(found, key=lambda x: (-sizes[x], x))]


def dictionaries(trained: list[tuple[str, list[str]]]) -> list[tuple[str, bytes]]:
    made = []
    for lang, words in trained:
        taken, room = [], DICT_BYTES
        for w in words:
            raw = w.encode() + b" "
            room -= len(raw)
            if room < 0:
                break
            taken.append(raw)
        made.append((lang, b"".join(reversed(taken))))
    return made


class Compressors:
    """A compressor for each language."""

    def __init__(self, dicts: list[tuple[str, bytes]]):
        import zstandard as z

        self.langs = [lang for lang, _ in dicts]
        self.each = []
        parameters = z.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=16, search_log=4, min_match=4, target_length=8, strategy=z.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        for _, raw in dicts:
            # Fewer than 8 bytes are no dictionary.
            data = z.ZstdCompressionDict(raw.rjust(8), dict_type=z.DICT_TYPE_RAWCONTENT)
            one = z.ZstdCompressor(dict_data=data, compression_params=parameters)
            head = raw[-HEAD:]
            self.each.append((one.compress, head, len(one.compress(head))))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return NONE, 0.0, True
        raw = text.lower().encode("utf-8", "replace")
        pieces = [raw[a : a + PIECE] for a in range(0, len(raw), PIECE)]
        sizes = [max(1, sum(len(compress(head + p)) - bare for p in pieces)) for compress, head, bare in self.each]
        k = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != k)
        score = (second - sizes[k]) / second
        return self.langs[k], score, score < MARGIN


def predict(docs: DataFrame, dicts: list[tuple[str, bytes]]) -> Column:
    """A column struct(lang, score, rejected) over docs.text."""
    cast = docs.sparkSession.sparkContext.broadcast(dicts)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        make_room()
        judge = Compressors(cast.value)
        for batch in batches:
            yield pd.DataFrame([judge(x) for x in batch], columns=["lang", "score", "rejected"])
        give_back()

    return run(F.col("`text`"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    dicts = dictionaries(training_words(docs))
    d = own_columns(docs, "doc_id", "text")
    d = d.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), predict(docs, dicts).alias("p"))
    return d.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The documents with an accepted language, all columns kept."""
    dicts = dictionaries(training_words(docs))
    return docs.filter(~predict(docs, dicts)["rejected"])


def op8_zstd_lang(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
