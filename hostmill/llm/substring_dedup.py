"""Removal of long passages that occur earlier in the corpus.

A window is ``W`` consecutive words of one document. A word goes when a window that covers
it has the same words as one that starts earlier (smaller doc_id, or the same document at an
earlier place). Windows are judged on the input, so removed windows still count as earlier.

The method asked for, broadcast suffix automata of reference shards, needs a reference of
bounded size. Here every document is the reference of the later ones, so the automata grow
with the corpus and no proven bound exists for what would be broadcast. ``Automaton`` with
``against_reference`` keeps that method for references that do have a bound; the corpus
against itself is done by shuffled fingerprints, exactly:

1. Each window belongs to the least 8-word fingerprint inside it (its minimizer); the windows
   of one minimizer in a row make a chunk. Equal chunks have equal windows.
2. Chunks are dealt by minimizer, after each task has settled its own copies, and settled as a
   stream. Later copies of a chunk go whole; where a minimizer has different chunks, their first
   copies are opened. A minimizer with more than ``KINDS`` chunks in one slice of documents is
   known to have its chunks opened: those are dealt by their content instead, so that a phrase
   in every document makes no hot task.
3. The windows of opened chunks are compared one by one, by 128-bit fingerprints.
4. The spans found are joined back to the texts.

A document is told by its doc_id and the 64-bit hash of its text, in this order.

Defined cases: a null or short text loses nothing; rows with the same doc_id and text are one
document and are judged alike; a null doc_id counts as the smallest, and its rows are documents
of their own: of equal ones the first row is the earlier; an empty table gives no rows;
only doc_id and text are used to decide, and other columns may have any names. Long texts are
worked on whole, in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shingles as S
from .common import own_columns, packed, table, unpacked, written

W = 20
MINIMIZER = 8
#: Different chunks of a minimizer in a slice before they are dealt apart.
KINDS = 64
#: Bytes of reference text for which automata are broadcast, at most.
REFERENCE_BYTES = 8 << 20
NULL_ID = -(1 << 63)
#: The span of a text that is an exact later copy.
WHOLE = -1

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def rolling(words: np.ndarray, step: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the 8-word and of the 20-word windows that start at each place."""

    def join(a: np.ndarray, b: np.ndarray, shift: int, power: int) -> np.ndarray:
        n = max(0, len(b) - shift)
        return a[:n] * np.uint64(pow(int(step), power, 1 << 64)) + b[shift : shift + n]

    h2 = join(words, words, 1, 1)
    h4 = join(h2, h2, 2, 2)
    h8 = join(h4, h4, 4, 4)
    h16 = join(h8, h8, 8, 8)
    return h8, join(h16, h4, 16, 4)


#: What a row of chunks says: a chunk, a later copy, a chunk to be opened, a minimizer whose
#: chunks are opened.
CHUNK, GONE, OPEN, MARK = range(4)
_CHUNK = "m long, c long, doc_id long, row long, span long, what int"
_CHUNK_ARROW = pa.schema([("m", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("span", pa.int64()), ("what", pa.int32())])


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, row and text: doc_id and row tell a document."""
    d = own_columns(docs, "doc_id", "text")
    return d.select(F.coalesce("doc_id", F.lit(NULL_ID).cast("long")).alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def chunk_starts(h8: np.ndarray, h20: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, minimizer and content fingerprint of a text's chunks."""
    reach = W - MINIMIZER + 1
    n = len(h20)
    mixed = S.mix(h8)
    least = np.lib.stride_tricks.sliding_window_view(mixed[: n + reach - 1], reach).argmin(axis=1) + np.arange(n)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(start[1:], n) - 1
    size = end - start + 1
    content = S.mix(S.mix(h20[start]) * _ONE + S.mix(h20[end] ^ _TWO) + size.astype(np.uint64))
    return start, size, mixed[least[start]], content


def chunks(docs: DataFrame) -> DataFrame:
    """The chunks of every document, to be dealt by ``m``; copies in one slice are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch):
                ids, hashes = (part.column(x).to_numpy(zero_copy_only=False) for x in ("doc_id", "row"))
                words, bounds = S.fingerprints(S.word_lists(part.column("text"), lower=False))
                h8, h20 = rolling(words, _ONE)
                m, c, doc, row, span = [], [], [], [], []
                for i in range(part.num_rows):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    if b - a < W:
                        continue
                    start, size, least, content = chunk_starts(h8[a : b - MINIMIZER + 1], h20[a : b - W + 1])
                    m.append(least)
                    c.append(content)
                    doc.append(np.full(len(start), ids[i], np.int64))
                    row.append(np.full(len(start), hashes[i], np.int64))
                    span.append(start.astype(np.int64) * 256 + size)
                if not m:
                    continue
                m, c = np.concatenate(m).view(np.int64), np.concatenate(c).view(np.int64)
                doc, row, span = np.concatenate(doc), np.concatenate(row), np.concatenate(span)
                order = np.lexsort((span, row, doc, c, m))
                m, c, doc, row, span = (x[order] for x in (m, c, doc, row, span))
                first, later = copies(m, c, doc, row, span)
                keep = first | later
                m, c, doc, row, span, first, later = (x[keep] for x in (m, c, doc, row, span, first, later))
                at = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                many = np.add.reduceat(first.astype(np.int64), at) > KINDS
                marked = m[at][many]
                apart = np.repeat(many, np.diff(np.append(at, len(m))))
                what = np.where(later, GONE, np.where(apart, OPEN, CHUNK)).astype(np.int32)
                deal = S.mix((c ^ m).view(np.uint64)).view(np.int64)
                by_document = S.mix((doc ^ row).view(np.uint64)).view(np.int64)  # copies share their row
                m = np.where(later, by_document, np.where(apart, deal, m))
                least, none = np.full(len(marked), NULL_ID), np.zeros(len(marked), np.int64)
                cols = [np.append(x, y) for x, y in ((m, marked), (c, least), (doc, none), (row, none), (span, none), (what, none + MARK))]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(cols, _CHUNK_ARROW.types, strict=True)], schema=_CHUNK_ARROW)

    return documents(docs).mapInArrow(S.tidy(run), _CHUNK)


def copies(m, c, doc, row, span) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted chunks: the first of each (m, c), and those that come later at another place."""
    first = np.ones(len(m), bool)
    first[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(m)), 0))
    return first, ~first & ((doc != doc[head]) | (row != row[head]) | (span != span[head]))


def settled(rows: DataFrame) -> DataFrame:
    """doc_id, row, span and ``gone``: later copies, and (gone false) chunks to be opened.

    rows: sorted by m, c, doc_id, row, span within partitions that hold whole minimizers. What
    is kept from batch to batch is the first copy of the last chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_opened = None, False
        for batch in batches:
            cols = [batch.column(x).to_numpy() for x in ("m", "c", "doc_id", "row", "span", "what")]
            done = cols[5] == GONE
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in cols[2:5]] + [pa.array(done[done])], names=["doc_id", "row", "span", "gone"])
                cols = [x[~done] for x in cols]
            if not len(cols[0]):
                continue
            if kept is not None:
                cols = [np.append(x, y) for x, y in zip(kept, cols, strict=True)]
            m, c, doc, row, span, what = cols
            first, later = copies(m, c, doc, row, span)
            new = np.concatenate([[True], m[1:] != m[:-1]])
            at = np.flatnonzero(new)
            open_ = np.add.reduceat(first.astype(np.int64), at) > 1
            open_ |= np.logical_or.reduceat(what != CHUNK, at)
            if kept is not None:
                open_[0] |= kept_opened
            opened = first & np.repeat(open_, np.diff(np.append(at, len(m)))) & (what != MARK)
            out = later | opened
            if kept is not None:  # it was put out by the batch before, if it had to be
                out[0] &= not kept_opened
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (doc, row, span, later)], names=["doc_id", "row", "span", "gone"])
            head = int(np.flatnonzero(first)[-1])
            kept, kept_opened = [x[head : head + 1] for x in cols], bool(open_[-1])

    return rows.select("m", "c", "doc_id", "row", "span", "what").mapInArrow(S.tidy(run), "doc_id long, row long, span long, gone boolean")


def window_rows(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, row, at): every window of the opened chunks."""
    lists = opened.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("of")).agg(F.collect_list("span").alias("spans"))
    d = documents(docs).join(lists, (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("of"))).select("doc_id", "row", "text", "spans")
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch):
                ids, hashes, spans = part.column("doc_id").to_numpy(), part.column("row").to_numpy(), part.column("spans")
                words, bounds = S.fingerprints(S.word_lists(part.column("text"), lower=False))
                one, two = rolling(words, _ONE)[1], rolling(S.mix(words), _TWO)[1]
                h1, h2, doc, row, at = [], [], [], [], []
                for i in range(part.num_rows):
                    s = np.unique(spans[i].values.to_numpy())
                    places = np.concatenate([np.arange(x >> 8, (x >> 8) + (x & 255)) for x in s.tolist()])
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    places = places[places + W <= b - a]  # texts that share a hash may differ
                    h1.append(one[a + places])
                    h2.append(two[a + places])
                    doc.append(np.full(len(places), ids[i], np.int64))
                    row.append(np.full(len(places), hashes[i], np.int64))
                    at.append(places)
                cols = [np.concatenate(h1).view(np.int64), np.concatenate(h2).view(np.int64), *map(np.concatenate, (doc, row, at))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=schema)

    return d.mapInArrow(S.tidy(run), "h1 long, h2 long, doc_id long, row long, at long")


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, spans): per document with removals, window spans as start * 256 + windows."""
    dealt = chunks(docs).repartition("m").sortWithinPartitions("m", "c", "doc_id", "row", "span")
    found = written(settled(dealt), "spans")
    windows = written(window_rows(docs, found.filter("NOT gone")), "windows")
    earliest = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "at")).alias("f"), F.count(F.lit(1)).alias("n"))
    earliest = earliest.filter("n > 1").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "f")
    single = windows.join(earliest, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    single = single.filter(F.struct("doc_id", "row", "at") > F.col("f"))
    single = single.select("doc_id", "row", (F.col("at") * 256 + 1).alias("span"))
    spans = found.filter("gone").select("doc_id", "row", "span").unionByName(single)
    return spans.groupBy("doc_id", "row").agg(F.collect_list("span").alias("spans"))


def covered(n: int, spans: np.ndarray | None) -> np.ndarray:
    """Which of a text's n words lie in a removed window."""
    if spans is not None and len(spans) and spans[0] == WHOLE:
        return np.full(n, n >= W)
    edge = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        start, size = spans >> 8, spans & 255
        np.add.at(edge, np.minimum(start, n), 1)
        np.add.at(edge, np.minimum(start + size - 1 + W, n), -1)
    return np.cumsum(edge[:n]) > 0


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (doc_id, text and ``rest``) with ``spans``. Equal texts without a doc_id share their
    spans; here the first row of them keeps those and the rest, if long enough for a window, go
    whole."""
    own = rows.columns
    rows = rows.withColumn("row", F.xxhash64("text"))
    bare = F.col("doc_id").isNull() & F.coalesce(F.length("text") >= 2 * W - 1, F.lit(False))
    order = Window.partitionBy("row").orderBy(F.monotonically_increasing_id())
    alike = rows.filter(bare).withColumn("copy", F.row_number().over(order) > 1)
    rows = rows.filter(~bare).withColumn("copy", F.lit(False)).unionByName(alike)
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID).cast("long")))
    s = spans.select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "spans")
    d = rows.join(s, (F.col("key") == F.col("id")) & (F.col("row") == F.col("of")), "left")
    whole = F.array(F.lit(WHOLE).cast("long"))
    return d.select(*own, F.when(F.col("copy"), whole).otherwise(F.col("spans")).alias("spans"))


def digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words, for every document."""
    d = with_spans(own_columns(docs, "doc_id", "text"), spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha = [], [], []
            for part in S.slices(batch):
                lists = part.column("spans")
                for i, words in enumerate(S.word_lists(part.column("text"), lower=False)):
                    n, gone = len(words), 0
                    if lists[i].is_valid:
                        hit = covered(n, lists[i].values.to_numpy())
                        gone = int(hit.sum())
                        words = [w for w, h in zip(words, hit.tolist(), strict=True) if not h]
                    n_words.append(n)
                    n_removed.append(gone)
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            cols = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return d.mapInArrow(S.tidy(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """The documents without the removed words, line ends and spaces kept; a document that
    loses all its words goes. n_chars, where there is one, follows the text."""
    names = docs.columns

    @F.pandas_udf("string")
    def cut(texts, lists):
        import pandas as pd

        out = []
        for text, spans in zip(texts, lists, strict=True):
            if text is None or spans is None:
                out.append(text)
                continue
            raw = text.encode()
            words = _WORD.findall(raw)
            hit = covered(len(words), np.asarray(spans))
            if not hit.any():
                out.append(text)
                continue
            kept = b"".join(w for w, h in zip(words, hit.tolist(), strict=True) if not h)
            out.append(kept.decode().rstrip(" \t\n\x0b\x0c\r") if kept else None)
        return pd.Series(out, dtype=object)

    # Spark repeats what it takes for deterministic in the filter below: two workers a task, for twice the work.
    cut = cut.asNondeterministic()
    d = with_spans(packed(docs, "doc_id", "text"), removed_spans(docs))
    # Only texts that lose something go to the workers, whose batches hold many texts at once.
    sent = F.when(F.col("spans").isNotNull(), F.col("text"))
    d = d.withColumn("cut", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut(sent, "spans")))
    d = d.filter("cut IS NOT NULL OR text IS NULL").withColumn("text", F.col("cut"))
    if "n_chars" not in names:
        return unpacked(d, names, "doc_id", "text")
    d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return unpacked(d, names, "doc_id", "text", "n_chars")


class Automaton:
    """Suffix automaton over the words of reference texts, for matching statistics."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """For each word, the length of the longest match that ends at it."""
        state, n = 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                n = 0
            yield n


def against_reference(docs: DataFrame, reference: DataFrame, least: int = W, shards: int = 4) -> DataFrame:
    """(doc_id, spans) of the words inside matches of ``least`` words with a bounded reference.

    The reference's size is measured first; over REFERENCE_BYTES this refuses.
    """
    if least < W:
        raise ValueError(f"matches of fewer than {W} words can't be told as windows")
    size = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > REFERENCE_BYTES:
        raise ValueError(f"the reference has {size} bytes; automata are broadcast up to {REFERENCE_BYTES}")
    texts = sorted(r["text"] for r in reference.select("text").where("text IS NOT NULL").collect())
    cast = docs.sparkSession.sparkContext.broadcast([[t.encode().split() for t in texts[k::shards]] for k in range(shards)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(t) for t in cast.value]
        for batch in batches:
            spans = []
            for words in S.word_lists(batch.column("text"), lower=False):
                ends = [max(n) for n in zip(*(a.statistics(words) for a in automata), strict=True)]
                spans.append([(i - least + 1) * 256 + least - W + 1 for i, n in enumerate(ends) if n >= least])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "spans"])

    return own_columns(docs, "doc_id", "text").mapInArrow(S.tidy(run), "doc_id long, spans array<long>").filter(F.size("spans") > 0)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(docs, removed_spans(docs))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+19], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
pos AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY pos.p) AS t FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
