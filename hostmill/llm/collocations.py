"""Phrases that hold together, counted by broadcast tries.

Texts in lower case (A-Z alone) are cut into pieces at ``[.,;:!?]`` and line ends, pieces into words
at spaces and tabs. Per language, phrases of 2 or 3 words with f >= ``LEAST`` occurrences are
candidates; cutting one in two gives the score floor(10^6 a^2 / (l r)) of the worst cut.

1. Texts are read once into slices of one language: distinct words and the text as their codes.
2. Candidates are found level by level, as Apriori allows: a phrase can only be frequent if the
   phrases inside it are. Words are counted; pairs of frequent words, then triples of frequent
   pairs, are counted by 64-bit fingerprints in each slice and summed by Spark. Which
   are frequent is told to the tasks by a bitmap, of a size that follows their number up to
   ``MOST_BITS``; a bit that is set by chance only lets more pass to the sums, and a fingerprint that
   two phrases share only makes another candidate.
3. Candidates are dealt by their first two words into shards of about ``SHARD`` phrases. A task makes
   a shard's double-array trie, over words as digits of their numbers. The tries are broadcast one
   after another, so that no broadcast grows with the data (their number, and so the number of scans
   over the codes, does). In each slice the states of all positions advance together, digit by digit
   and word by word, over ``base`` and ``check``; the states after 2 and 3 words are counted by
   bincount, and the vectors of all tasks summed by block. These counts compare words, so they are exact.
4. Scores are joins of the counts, in decimals of 38 digits.

Defined cases: a null text has no words, a null language is ``und``; occurrences overlap; rows are
documents, so a repeated row counts again; ties in the score are settled as the contract says; an empty table gives
no rows; only text and lang are read. Counts over 10^12 would outgrow the decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shingles as S
from .common import own_columns, table, written

LEAST = 10
TOP = 2000
#: Of a longer candidate's share that makes a phrase part of it.
INSIDE_PERCENT = 50
SLICE_BYTES = 6 << 20
LEAST_BITS, MOST_BITS = 16, 27
SHARD = 1 << 20
DIGIT = 10
#: States of a block of counts, and rows that a task gives at once.
BLOCK = ROWS = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of a byte: 0 in words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_ODD = np.uint64(0xD1342543DE82EF95)


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def opened(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and the texts as their codes from 1 on, 0 between pieces."""
    data = b"\n".join(t or b"" for t in texts.cast(pa.large_binary()).to_pylist())
    x = _LOWER[np.frombuffer(data, np.uint8)]
    kind = _KIND[x]
    word = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    if not len(edges):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    offsets = pa.array(np.append(edges, len(x)), pa.int64())
    runs = pa.LargeStringArray.from_buffers(len(edges), offsets.buffers()[1], pa.py_buffer(x))
    words = runs.take(pa.array(np.arange(0, len(edges), 2))).dictionary_encode()
    piece = np.cumsum(kind == 2)[edges[::2]]
    at = np.arange(len(piece)) + np.cumsum(np.append(False, piece[1:] != piece[:-1]))
    codes = np.zeros(int(at[-1]) + 1, np.int32)
    codes[at] = words.indices.to_numpy() + 1
    return words.dictionary.cast(pa.string()), codes


def sliced(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, words, codes and n: the number of words."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("codes", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                ends = np.cumsum(pc.fill_null(pc.binary_length(own.column("text")), 0).to_numpy(zero_copy_only=False))
                start = 0
                while start < own.num_rows:
                    base = ends[start - 1] if start else 0
                    end = max(start + 1, int(np.searchsorted(ends, base + slice_bytes, side="right")))
                    words, codes = coded(own.column("text").slice(start, end - start))
                    start = end
                    if len(words):
                        row = [[lang], [words.to_pylist()], [packed(codes)], [int((codes > 0).sum())]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types, strict=True)], schema=schema)

    d = own_columns(docs, "text", "lang").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return d.mapInArrow(run, "lang string, words array<string>, codes binary, n long")


def slice_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("lang")[k].as_py(), batch.column("words")[k].values, opened(batch.column("codes")[k].as_py(), np.int32).astype(np.int64)
            pa.default_memory_pool().release_unused()  # workers live on, and so would the memory


def prints(lang: str, words: pa.Array) -> np.ndarray:
    """Fingerprints of words in a language, by code; none for 0."""
    start = lang.encode() + b"\0"
    known = [0, *(xxhash.xxh3_64_intdigest(start + w) for w in words.cast(pa.binary()).to_pylist())]
    return np.array(known, np.uint64)


def pair_print(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return S.mix(a * _ODD + b)


def unigrams(slices: DataFrame) -> DataFrame:
    """lang, word, its fingerprint and n, of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in slice_rows(batches):
            n = np.bincount(codes, minlength=len(words) + 1)[1:]
            cols = [pa.array([lang] * len(words)), words, pa.array(prints(lang, words)[1:].view(np.int64)), pa.array(n)]
            batch = pa.RecordBatch.from_arrays(cols, names=["lang", "word", "p", "n"])
            for k in range(0, batch.num_rows, ROWS):
                yield batch.slice(k, ROWS)

    found = slices.mapInArrow(run, "lang string, word string, p long, n long")
    return found.groupBy("lang", "word", "p").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


class Bits:
    """Which fingerprints may be frequent."""

    def __init__(self, words: np.ndarray, width: int):
        self.words, self.width = words, width

    def of(self, p: np.ndarray) -> np.ndarray:
        at = p & np.uint64((1 << self.width) - 1)
        return (self.words[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def bitmap(prints: DataFrame, n: int, most: int = MOST_BITS) -> Bits:
    """The set of the fingerprints ``p``, 16 bits each and more, up to 2^most bits in all."""
    width = min(most, max(LEAST_BITS, (16 * n - 1).bit_length()))
    at = f"(p & {(1 << width) - 1}L)"
    bit = F.expr(f"shiftleft(1L, cast({at} % 32 as int))")
    rows = prints.groupBy(F.expr(f"shiftright({at}, 5)").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(1 << width >> 5, np.uint32)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return Bits(words, width)


def arrow_rows(cols: list[np.ndarray], names: str) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=names.split())
    for k in range(0, batch.num_rows, ROWS):
        yield batch.slice(k, ROWS)


def pairs(slices: DataFrame, frequent: Bits) -> DataFrame:
    """Fingerprints p1, p2 of frequent pairs of frequent words, and p of the pair."""
    cast = slices.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in slice_rows(batches):
            p = prints(lang, words)
            may = cast.value.of(p)
            may[0] = False
            a, b = codes[:-1], codes[1:]
            both = may[a] & may[b]
            key, n = np.unique(a[both] * len(p) + b[both], return_counts=True)
            yield from arrow_rows([p[key // len(p)], p[key % len(p)], n], "p1 p2 n")

    d = slices.mapInArrow(run, "p1 long, p2 long, n long").groupBy("p1", "p2").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)

    @F.pandas_udf("long")
    def joint(a, b):
        import pandas as pd

        return pd.Series(pair_print(a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)).view(np.int64))

    return d.select("p1", "p2", joint("p1", "p2").alias("p"))


def triples(slices: DataFrame, frequent: Bits) -> DataFrame:
    """Fingerprints p1, p2, p3 of frequent triples of frequent pairs."""
    cast = slices.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, codes in slice_rows(batches):
            p = prints(lang, words)
            a, b = codes[:-1], codes[1:]
            key, pair = np.unique(a * len(p) + b, return_inverse=True)
            pair = pair.astype(np.int32)
            may = cast.value.of(pair_print(p[key // len(p)], p[key % len(p)])) & (key // len(p) > 0) & (key % len(p) > 0)
            both = may[pair[:-1]] & may[pair[1:]]
            found, n = np.unique(pair[:-1][both].astype(np.int64) * len(p) + codes[2:][both], return_counts=True)
            first, third = key[found // len(p)], found % len(p)
            yield from arrow_rows([p[first // len(p)], p[first % len(p)], p[third], n], "p1 p2 p3 n")

    d = slices.mapInArrow(run, "p1 long, p2 long, p3 long, n long")
    return d.groupBy("p1", "p2", "p3").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).drop("n")


def candidates(slices: DataFrame, words: DataFrame) -> DataFrame:
    """lang, w1, w2, w3 (null in pairs): all phrases that may be frequent."""
    two = written(pairs(slices, bitmap(words.select("p"), words.count())), "pairs")
    three = triples(slices, bitmap(two.select("p"), two.count()))
    said = words.select("lang", "word", "p")

    def spelt(d: DataFrame, k: int) -> DataFrame:
        s = said.select(F.col("lang").alias("of"), F.col("word").alias(f"w{k}"), F.col("p").alias("q"))
        d = d.join(s, F.col(f"p{k}") == F.col("q")).drop("q", f"p{k}")
        return d.withColumnRenamed("of", "lang") if k == 1 else d.filter(F.col("lang") == F.col("of")).drop("of")

    d = spelt(spelt(two.drop("p"), 1), 2).withColumn("w3", F.lit(None).cast("string"))
    e = spelt(spelt(spelt(three, 1), 2), 3)
    return d.select("lang", "w1", "w2", "w3").unionByName(e.select("lang", "w1", "w2", "w3"))


class Trie:
    """Double-array trie of phrases as digits of word numbers. From state s the digit c leads to
    base[s] + c where check says that it came from s."""

    def __init__(self, langs: list[str], words: list[str]):
        """Numbers words; both lists belong together and are sorted."""
        self.first: dict[str, int] = {}
        for k, lang in enumerate(langs):
            self.first.setdefault(lang, k)
        bounds = [*self.first.values(), len(words)]
        self.words = {lang: words[a:b] for lang, a, b in zip(self.first, bounds[:-1], bounds[1:], strict=True)}
        self.digits = max(1, -(-(len(words) - 1).bit_length() // DIGIT))

    def split(self, numbers: np.ndarray) -> list[np.ndarray]:
        return [numbers >> DIGIT * k & (1 << DIGIT) - 1 for k in reversed(range(self.digits))]

    def build(self, numbers: np.ndarray) -> np.ndarray:
        """Of phrases (3 rows of word numbers, -1 for none): the states where they end."""
        node, parent, digit, total = np.zeros(numbers.shape[1], np.int64), [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
        for word in numbers:
            on = np.flatnonzero(word >= 0)
            for c in self.split(word[on]):
                key, inverse = np.unique(node[on] << DIGIT | c, return_inverse=True)
                parent.append(key >> DIGIT)
                digit.append(key & (1 << DIGIT) - 1)
                node[on] = total + inverse
                total += len(key)
        parent, digit = np.concatenate(parent)[1:], np.concatenate(digit)[1:]
        order = np.lexsort((digit, parent))
        base = placed(parent[order], digit[order], total)
        slot = np.append(0, base[parent] + digit)
        size = int(slot.max()) + 1
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        return slot[node]

    def step(self, state: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and which there are."""
        to = self.base[state].astype(np.int64) + digit
        to[(to < 0) | (to >= len(self.check))] = 0
        return to, self.check[to] == state

    def count(self, lang: str, words: pa.Array, codes: np.ndarray) -> np.ndarray:
        """How often phrases end in each state, over all positions of a slice."""
        total = np.zeros(len(self.base), np.int64)
        if lang not in self.words:
            return total
        found = pc.index_in(words, value_set=pa.array(self.words[lang], pa.string()))
        number = np.append(-1, pc.fill_null(found, -1).to_numpy().astype(np.int64))
        number[number >= 0] += self.first[lang]
        text = np.append(number[codes], [-1, -1])
        at = np.flatnonzero(text[:-2] >= 0)
        state = np.zeros(len(at), np.int64)
        for k in range(3):
            on = text[at + k] >= 0
            at, state = at[on], state[on]
            for shift in reversed(range(0, DIGIT * self.digits, DIGIT)):
                to, on = self.step(state, text[at + k] >> shift & (1 << DIGIT) - 1)
                at, state = at[on], to[on]
            if k:
                total += np.bincount(state, minlength=len(total))
        return total


def placed(parent: np.ndarray, digit: np.ndarray, total: int) -> np.ndarray:
    """A base for each node, so that all children (sorted by parent) lie in slots of their own."""
    base = np.zeros(total, np.int64)
    at = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])[: len(parent)])
    width = np.diff(np.append(at, len(parent)))
    used = np.zeros(2 * total + (4 << DIGIT), bool)
    used[0] = True
    end, rnd = 1 << DIGIT, np.random.default_rng(0)
    for k in np.argsort(-width, kind="stable").tolist():
        n = int(width[k])
        if n <= 8:
            break
        c = digit[at[k] : at[k] + n]
        for b in (rnd.integers(1, end, 16) - c[0]).tolist():
            if b + c[-1] < end and not used[b + c].any():
                break
        else:
            b = end - int(c[0])
            end = b + int(c[-1]) + 1
            if end >= len(used):
                used = np.append(used, np.zeros(len(used), bool))
        used[b + c] = True
        base[parent[at[k]]] = b
    for n in range(8, 1, -1):
        left = at[width == n]
        while len(left):
            need = int(used.sum()) + n * len(left)
            end = max(end, int(1.6 * need) + (2 << DIGIT))
            if end >= len(used):
                used = np.append(used, np.zeros(end, bool))
            c = digit[left[:, None] + np.arange(n)]
            b = rnd.integers(1, end - (1 << DIGIT), len(left)) - c[:, 0]
            slots = b[:, None] + c
            _, inverse = np.unique(slots, return_inverse=True)
            owner = np.full(int(inverse.max()) + 1, len(left))
            row = np.repeat(np.arange(len(left)), n)
            np.minimum.at(owner, inverse.ravel(), row)
            good = ~used[slots].any(axis=1) & (owner[inverse.reshape(slots.shape)] == np.arange(len(left))[:, None]).all(axis=1)
            used[slots[good].ravel()] = True
            base[parent[left[good]]] = b[good]
            left = left[~good]
    single = at[width == 1]
    free = np.flatnonzero(~used[:end])
    if len(free) < len(single):
        free = np.append(free, np.arange(end, end + len(single) - len(free)))
    base[parent[single]] = free[: len(single)] - digit[single]
    return base


def tries(phrases: DataFrame, shards: int) -> DataFrame:
    """A row with the trie of each shard, and each phrase with its shard and state."""
    schema = pa.schema([("shard", pa.int32()), ("trie", pa.binary()), *[(c, pa.string()) for c in ("lang", "w1", "w2", "w3")], ("state", pa.int64())])

    def built(shard: int, d: pa.Table) -> Iterator[pa.RecordBatch]:
        import pickle

        spelt = pa.concat_tables([pa.table({"lang": d["lang"], "w": d[c]}) for c in ("w1", "w2", "w3")]).filter(pc.field("w").is_valid())
        spelt = spelt.group_by(["lang", "w"]).aggregate([]).sort_by([("lang", "ascending"), ("w", "ascending")])
        trie = Trie(spelt["lang"].to_pylist(), spelt["w"].to_pylist())
        numbers = np.full((3, d.num_rows), -1, np.int64)
        for lang, first in trie.first.items():
            own = np.flatnonzero(pc.equal(d["lang"], lang).to_numpy())
            for k, c in enumerate(("w1", "w2", "w3")):
                found = pc.index_in(d[c].take(pa.array(own)), value_set=pa.array(trie.words[lang], pa.string()))
                found = pc.fill_null(found, -1).to_numpy().astype(np.int64)
                numbers[k, own] = np.where(found < 0, -1, found + first)
        state = trie.build(numbers)
        blob = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(trie))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "trie": blob}], schema)
        out = d.select(["lang", "w1", "w2", "w3"]).append_column("state", pa.array(state))
        out = out.add_column(0, "shard", pa.array(np.full(d.num_rows, shard), pa.int32())).add_column(1, "trie", pa.nulls(d.num_rows, pa.binary()))
        yield from out.cast(schema).combine_chunks().to_batches(max_chunksize=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for batch in batches:
            of = batch.column("shard").to_numpy()
            start = 0
            while start < len(of):
                if held and of[start] != shard:
                    yield from built(shard, pa.Table.from_batches(held))
                    held = []
                shard = int(of[start])
                end = int(np.searchsorted(of, shard, side="right"))
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from built(shard, pa.Table.from_batches(held))

    d = phrases.withColumn("shard", F.pmod(F.xxhash64("lang", "w1", "w2"), F.lit(shards)).cast("int"))
    d = d.repartition(shards, "shard").sortWithinPartitions("shard")
    return d.mapInArrow(run, "shard int, trie binary, lang string, w1 string, w2 string, w3 string, state long")


def totals(slices: DataFrame, trie: bytes) -> DataFrame:
    """state and n: how often phrases of a shard end there, over all slices."""
    cast = slices.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        own = pickle.loads(zstandard.ZstdDecompressor().decompress(cast.value))
        total = np.zeros(len(own.base), np.int64)
        for lang, words, codes in slice_rows(batches):
            total += own.count(lang, words, codes)
        for k in range(0, len(total), BLOCK):
            if total[k : k + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([packed(total[k : k + BLOCK])], pa.binary())], names=["block", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def rows() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(at + block), pa.array(total[at])], names=["state", "n"])

        for batch in batches:
            for k, blob in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), strict=True):
                n = opened(blob, np.int64)
                if k == block:
                    total += n
                    continue
                if block is not None:
                    yield rows()
                block, total = k, n.copy()
        if block is not None:
            yield rows()

    parts = slices.mapInArrow(run, "block long, n binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(summed, "state long, n long")


def frequencies(slices: DataFrame, phrases: DataFrame, shard: int = SHARD) -> DataFrame:
    """lang, w1, w2, w3 and their exact a, for phrases with a >= LEAST."""
    shards = max(1, -(-phrases.count() // shard))
    made = written(tries(phrases, shards), "tries")
    out = None
    for k in range(shards):
        own = made.filter(F.col("shard") == k)
        row = own.filter("trie IS NOT NULL").select("trie").first()
        if row is None:
            continue
        n = totals(slices, row["trie"]).select(F.col("state").alias("of"), F.col("n").alias("a"))
        d = own.filter("trie IS NULL").join(n, F.col("state") == F.col("of")).select("lang", "w1", "w2", "w3", "a")
        d = written(d.filter(F.col("a") >= LEAST), "frequencies")
        out = d if out is None else out.unionByName(d)
    return out if out is not None else phrases.withColumn("a", F.lit(0).cast("long")).filter("false")


def ranked(counts: DataFrame, words: DataFrame, sizes: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first phrases of each language."""
    alone = words.select(F.col("lang").alias("of"), F.col("word").alias("w"), F.col("n").alias("m"))
    two = counts.filter("w3 IS NULL").select("lang", "w1", "w2", "a")
    three = counts.filter("w3 IS NOT NULL")
    duo = two.select(F.col("lang").alias("of"), F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("a").alias("m"))

    def one(d: DataFrame, c: str, name: str) -> DataFrame:
        return d.join(alone, (F.col("lang") == F.col("of")) & (F.col(c) == F.col("w"))).drop("of", "w").withColumnRenamed("m", name)

    def both(d: DataFrame, c: str, e: str, name: str) -> DataFrame:
        return d.join(duo, (F.col("lang") == F.col("of")) & (F.col(c) == F.col("x")) & (F.col(e) == F.col("y"))).drop("of", "x", "y").withColumnRenamed("m", name)

    def floor(left: str, right: str) -> Column:
        return F.expr(
            "cast(1000000 * cast(a as decimal(12,0)) * cast(a as decimal(12,0)) as decimal(38,0))"
            f" div cast(cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)) as decimal(38,0))"
        )

    three = both(one(three, "w1", "l1"), "w2", "w3", "r1")
    three = one(both(three, "w1", "w2", "l2"), "w3", "r2")
    three = three.withColumns({"s1": floor("l1", "r1"), "s2": floor("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    cut = {"l": F.when(first, F.col("l1")).otherwise(F.col("l2")), "r": F.when(first, F.col("r1")).otherwise(F.col("r2")), "score": F.least("s1", "s2")}
    three = three.withColumns(cut).withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    inside = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    inside = inside.groupBy(F.col("lang").alias("of"), F.col("w1").alias("x"), F.col("w2").alias("y")).agg(F.max("a").alias("most"))
    two = two.join(inside, (F.col("lang") == F.col("of")) & (F.col("w1") == F.col("x")) & (F.col("w2") == F.col("y")), "left").drop("of", "x", "y")
    two = two.filter(F.col("most").isNull() | (100 * F.col("most") < INSIDE_PERCENT * F.col("a")))
    two = one(one(two, "w1", "l"), "w2", "r").withColumn("score", floor("l", "r")).withColumn("phrase", F.concat_ws(" ", "w1", "w2"))
    names = ["lang", "phrase", "a", "l", "r", "score"]
    d = two.select(*names).unionByName(three.select(*names))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    d = d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    d = d.join(sizes.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"))
    return d.select("lang", *[F.col(c).cast("long").alias(c) if c != "phrase" else F.col(c) for c in ("rank", "phrase", "a", "l", "r", "n", "score")])


def collocations(docs: DataFrame, top: int = TOP, shard: int = SHARD, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    slices = written(sliced(docs, slice_bytes), "slices")
    words = written(unigrams(slices), "words")
    phrases = written(candidates(slices, words), "phrases")
    sizes = slices.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked(frequencies(slices, phrases, shard), words, sizes, top)


def op13_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id,
             unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS x FROM documents),
w AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i FROM w),
t AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1 AS g, NULL AS g1, NULL AS h1, NULL AS g2, NULL AS h2 FROM t
      UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, NULL, NULL FROM t WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1, w2 || ' ' || w3, w1 || ' ' || w2, w3 FROM t WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, g, any_value(g1) AS g1, any_value(h1) AS h1, any_value(g2) AS g2, any_value(h2) AS h2, count(*) AS f FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
q AS (SELECT lang || chr(1) || g AS q, f FROM f WHERE k < 3),
c AS (SELECT lang, k AS size, g, f, 1 AS k, lang || chr(1) || g1 AS x, lang || chr(1) || h1 AS y FROM f WHERE k > 1
      UNION ALL SELECT lang, k, g, f, 2, lang || chr(1) || g2, lang || chr(1) || h2 FROM f WHERE k = 3),
s AS (SELECT c.lang, c.size, c.g, c.f AS a, c.k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
      FROM c JOIN q l ON l.q = c.x JOIN q r ON r.q = c.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
m AS (SELECT lang, g, max(f) AS m FROM (SELECT lang, g2 AS g, f FROM f WHERE k = 3 UNION ALL SELECT lang, h1, f FROM f WHERE k = 3) GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN m ON b.lang = m.lang AND b.g = m.g WHERE m.m IS NULL OR 100 * m.m < 50 * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM k)
SELECT o.lang, rank::BIGINT AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score
FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
"""
