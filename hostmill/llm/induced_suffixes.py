"""Removal of byte strings that occur twice, from suffixes sorted by external induction.

A string is ``W`` consecutive bytes of one document. Every byte goes that lies in a string which
also starts at another place, in the same document or in another. Texts are bytes in UTF-8.

Two suffixes that share W bytes share every place chosen by content inside them. Each string
belongs to the least ``K``-byte fingerprint in it, its anchor, and the strings of one anchor in a
row make a chunk. Suffixes are sorted where that can decide anything, around anchors that occur in
different contexts:

1. Texts are read once into chunks: anchor, fingerprint of the content, and one more of the bytes
   that all strings of either half of the chunk share (the nearer to the anchor and the farther).
2. Chunks are dealt by anchor. A chunk that occurs twice goes whole, wherever it is. Where an anchor
   has several different chunks, one of each kind is opened; where the shared bytes of a half occur
   in one opened chunk only, that half is left out, as no string of it can occur twice.
3. Opened halves are dealt into shards by those shared bytes, so that all that can be equal meets.
   In a shard the suffixes at the anchors lie sorted, by Spark's external sort, with the lengths of
   their common prefixes. All other suffixes are induced from them, byte by byte to the left: a
   suffix's place follows from its first byte and the place of the suffix after it, and its common
   prefix from the least between the two there, plus one. Tuples (class and byte, place, common
   prefix, item) pass from level to level through queues in that order, which keep sorted runs on disk
   when they outgrow ``MEMORY_TUPLES``. A suffix is no longer carried when what it shares can't
   reach W any more. Its string occurs twice if it shares W bytes with a neighbour.
4. The strings found are joined back to the texts.

An anchor with more than ``KINDS`` different chunks in one slice has them dealt by content, and shared
bytes in more than ``HOT`` opened chunks have their strings counted by fingerprint through Spark's
partial sums, so that a passage in every document makes no hot task. All ways find the same strings.

Equality of chunks and of hot strings is that of 128-bit fingerprints; in shards bytes are compared.

Defined cases: a null or short text loses nothing and has a digest (of its bytes); each row is a
document, so a repeated row is an occurrence of its own; doc_id may be null or repeat; overlapping
occurrences count; an empty table gives no rows; only doc_id and text are read. Bytes may be cut inside a
character: the digest is of bytes. A text is worked on whole in one task.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import shared_dir
from . import shingles as S
from .common import own_columns, table, written

W = 400
K = 32
#: Fingerprints in a string; strings of a chunk start up to REACH - 1 bytes before its anchor.
REACH = W - K + 1
#: Strings of a chunk's farther half start at least so many bytes before the anchor.
FAR = REACH // 2 + 1
KINDS = 64
HOT = 100_000
#: Tuples of a level that are held in memory, and tuples read at once from a run.
MEMORY_TUPLES, READ_TUPLES = 4_000_000, 1 << 16
NULL_ID = -(1 << 63)

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = S.mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
#: What a row says: a chunk to be dealt by its anchor, one dealt by its content, strings that are
#: known to occur twice, an anchor whose chunks are opened.
CHUNK, OPEN, GONE, MARK = range(4)
_CHUNK_TYPES = ("deal", "m", "c1", "c2", "near", "far", "n", "doc_id", "row", "span", "what")
_CHUNK = ", ".join(f"{c} long" for c in _CHUNK_TYPES)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id, row and text: doc_id and row tell a document, but for its copies."""
    d = own_columns(docs, "doc_id", "text")
    return d.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("row"), "text")


def grams(x: np.ndarray) -> np.ndarray:
    """Fingerprints of the K bytes that start at each place."""
    h, n = _BYTES[x], 1
    while n < K:
        h = h[:-n] * np.uint64(pow(int(_STEP), n, 1 << 64)) + h[n:]
        n *= 2
    return S.mix(h)


def least(v: np.ndarray, k: int) -> np.ndarray:
    """The least of each k values in a row: prefix and suffix minima of blocks of k."""
    n = len(v) - k + 1
    blocks = np.concatenate([v, np.full(-len(v) % k, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, k)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[k - 1 : k - 1 + n])


def chunk_places(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First string, number of strings, anchor and its fingerprint of the chunks of texts that
    lie one after another in data."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < W:
        return (np.zeros(0, np.int64),) * 4
    h = grams(x)
    place = least((h & _HIGH) | np.arange(len(h), dtype=np.uint64), REACH) & _LOW
    place = place.astype(np.int64)
    n = len(place)
    edge = np.zeros(n + 1, np.int64)  # of strings that would reach over the end of a text
    np.add.at(edge, np.clip(ends - W + 1, np.append(0, ends[:-1]), n).clip(0, n), 1)
    np.add.at(edge, np.minimum(ends, n), -1)
    inside = np.cumsum(edge[:n]) == 0
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    new[np.minimum(ends[:-1], n - 1)] |= ends[:-1] < n
    cuts = np.append(np.flatnonzero(new | ~inside), n)
    start = np.flatnonzero(new & inside)
    size = cuts[np.searchsorted(cuts, start, side="right")] - start
    return start, size, place[start], h[place[start]].view(np.int64)


def packed_span(start: np.ndarray, before: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Start in the text, bytes from there to the anchor, number of strings."""
    return start << 20 | before << 10 | size


def chunks(docs: DataFrame) -> DataFrame:
    """The chunks of every document; those that occur twice in a slice are settled there."""
    schema = pa.schema([(c, pa.int64()) for c in _CHUNK_TYPES])

    def slice_rows(texts: list[bytes], ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        ends = np.cumsum([len(t) for t in texts])
        data = b"".join(texts)
        start, size, anchor, m = chunk_places(data, ends)
        text = np.searchsorted(ends, start, side="right")
        view, seen = memoryview(data), []
        for s, e, p in zip(start.tolist(), (start + size - 1 + W).tolist(), anchor.tolist(), strict=True):
            near = xxhash.xxh3_64_intdigest(view[p : p + W - FAR + 1]) if e - W > p - FAR else 0
            far = xxhash.xxh3_64_intdigest(view[p - FAR : p + K], seed=1) if s <= p - FAR else 0
            seen.append((*divmod(xxhash.xxh3_128_intdigest(view[s:e]), 1 << 64), near, far))
        c1, c2, near, far = np.array(seen, np.uint64).reshape(-1, 4).view(np.int64).T
        own = start - np.append(0, ends)[text]
        rows = np.stack([m, m, c1, c2, near, far, np.ones_like(m), ids[text], hashes[text], packed_span(own, anchor - start, size), np.full_like(m, CHUNK)])
        rows = rows[:, np.lexsort((rows[9], rows[8], rows[7], c2, c1, m))]
        head = np.ones(rows.shape[1], bool)
        head[1:] = (rows[1:4, 1:] != rows[1:4, :-1]).any(axis=0)
        at = np.flatnonzero(head)
        n = np.diff(np.append(at, len(head)))
        gone = rows[:, np.repeat(n > 1, n)]
        gone[10] = GONE
        gone[0] = S.mix((gone[7] ^ gone[8]).view(np.uint64)).view(np.int64)
        gone[1:7] = 0
        rows = rows[:, at]
        rows[6] = n
        first = np.flatnonzero(np.append(True, rows[1, 1:] != rows[1, :-1])[: len(n)])
        kinds = np.diff(np.append(first, len(n)))
        apart = np.repeat(kinds > KINDS, kinds)
        rows[10, apart] = OPEN
        rows[0, apart] = S.mix((rows[1] ^ rows[2])[apart].view(np.uint64)).view(np.int64)
        marks = np.zeros((len(rows), int((kinds > KINDS).sum())), np.int64)
        marks[0] = marks[1] = rows[1, first[kinds > KINDS]]
        marks[10] = MARK
        return np.concatenate([rows, gone, marks], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch):
                texts = [t or b"" for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                rows = slice_rows(texts, *(part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row")))
                if rows.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=schema)

    return documents(docs).mapInArrow(run, _CHUNK)


def settled(rows: DataFrame) -> DataFrame:
    """doc_id, row, span, near, far and: ``gone``, a later or earlier copy of a chunk; ``opened``,
    one of the different chunks of an anchor, ``single`` if it occurs once. One shuffle."""
    alike = Window.partitionBy("deal", "m", "c1", "c2")
    d = rows.repartition("deal")
    d = d.withColumn("first", (F.row_number().over(alike.orderBy("doc_id", "row", "span")) == 1) & F.col("what").isin(CHUNK, OPEN))
    d = d.withColumn("total", F.sum("n").over(alike))
    whole = Window.partitionBy("deal")
    d = d.withColumn("kinds", F.sum(F.when(F.col("first") & (F.col("what") == CHUNK), 1).otherwise(0)).over(whole))
    d = d.withColumn("marked", F.max((F.col("what") == MARK) & (F.col("deal") == F.col("m"))).over(whole))
    gone = (F.col("what") == GONE) | ((F.col("n") == 1) & (F.col("total") > 1))  # n > 1: its copies are rows of their own
    opened = F.col("first") & ((F.col("what") == OPEN) | F.col("marked") | (F.col("kinds") > 1))
    d = d.select("doc_id", "row", "span", "near", "far", gone.alias("gone"), opened.alias("opened"), (F.col("total") == 1).alias("single"))
    return d.filter("gone OR opened")


class Store:
    """Files of one task that nobody else reads; they have no name and go when closed."""

    def __init__(self, folder: str | None):
        self.folder = folder

    def file(self):
        if self.folder is None:
            raise ValueError("a shard outgrows memory, and spark.checkpoint.dir is no mounted folder for its runs")
        return tempfile.TemporaryFile(dir=self.folder)


class Queue:
    """A priority queue of tuples (code, place, lcp, item) by code and place, in blocks. Beyond
    ``limit`` tuples it keeps sorted runs on disk, which are merged when it is drained."""

    def __init__(self, store: Store, limit: int):
        self.store, self.limit = store, limit
        self.blocks: list[np.ndarray] = []
        self.held, self.runs = 0, []

    def push(self, block: np.ndarray) -> None:
        if block.shape[1]:
            self.blocks.append(block)
            self.held += block.shape[1]
        if self.held > self.limit:
            run = self.store.file()
            self._sorted().T.tofile(run)
            self.runs.append(run)

    def _sorted(self) -> np.ndarray:
        block = self.blocks[0] if len(self.blocks) == 1 else np.concatenate(self.blocks, axis=1)
        self.blocks, self.held = [], 0
        if (block[0, 1:] >= block[0, :-1]).all() and ((block[0, 1:] > block[0, :-1]) | (block[1, 1:] > block[1, :-1])).all():
            return block
        return block[:, np.lexsort((block[1], block[0]))]

    def drain(self) -> Iterator[np.ndarray]:
        if not self.runs:
            if self.held:
                yield self._sorted()
            return
        if self.held:
            run = self.store.file()
            self._sorted().T.tofile(run)
            self.runs.append(run)
        for run in self.runs:
            run.seek(0)
        read = lambda run: np.fromfile(run, np.int64, 4 * READ_TUPLES).reshape(-1, 4).T
        heads = [read(run) for run in self.runs]
        while any(h.shape[1] for h in heads):
            # all tuples up to the least last one of what has been read are the next in order
            bound = min((h[0, -1], h[1, -1]) for h in heads if h.shape[1])
            taken = []
            for k, h in enumerate(heads):
                n = int(((h[0] < bound[0]) | ((h[0] == bound[0]) & (h[1] <= bound[1]))).sum())
                taken.append(h[:, :n])
                heads[k] = h[:, n:] if n < h.shape[1] else read(self.runs[k])
            block = np.concatenate(taken, axis=1)
            yield block[:, np.lexsort((block[1], block[0]))]
        for run in self.runs:
            run.close()
        self.runs = []


class Shard:
    """Items whose suffixes at the anchor come sorted; ``strings`` induces the others."""

    def __init__(self, store: Store, limit: int = MEMORY_TUPLES):
        self.store, self.limit = store, limit
        self.queue = Queue(store, limit)
        self.lefts: list[np.ndarray] = []
        self.file, self.n, self.code, self.last = None, 0, 0, (None, b"")

    def add(self, keys: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> None:
        """The next items in order of key and right; left: the bytes before the anchor."""
        n = len(keys)
        left = np.zeros((n, FAR), np.uint8)  # the last column: how many
        for k, b in enumerate(lefts):
            left[k, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
            left[k, -1] = len(b)
        self._keep(left)
        width = np.array([len(self.last[1]), *map(len, rights)])
        key = np.append(keys[0] if self.last[0] is None else self.last[0], keys)
        joined = np.zeros((n + 1, W + 1), np.uint8)
        for k, b in enumerate((self.last[1], *rights)):
            joined[k, : len(b)] = np.frombuffer(b, np.uint8)
        differ = joined[1:] != joined[:-1]
        differ[:, W] = True
        lcp = np.minimum(differ.argmax(axis=1), np.minimum(width[1:], width[:-1]))
        new = key[1:] != key[:-1]
        new[0] |= self.last[0] is None
        lcp[new] = 0
        code = self.code + np.cumsum(new)
        self.code = int(code[-1])
        self.queue.push(np.stack([code, np.arange(self.n, self.n + n), lcp, np.arange(self.n, self.n + n)]))
        self.last = int(keys[-1]), rights[-1]
        self.n += n

    def _keep(self, left: np.ndarray) -> None:
        if self.file is None and self.n + len(left) > self.limit:
            self.file = self.store.file()
            for x in self.lefts:
                x.tofile(self.file)
            self.lefts = []
        if self.file is None:
            self.lefts.append(left)
        else:
            left.tofile(self.file)

    def strings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, bytes before the anchor) of the starts of strings that occur twice."""
        if self.file is not None:
            self.file.flush()
            left = np.memmap(self.file, np.uint8, "r").reshape(-1, FAR)
        else:
            left = np.concatenate(self.lefts) if self.lefts else np.zeros((0, FAR), np.uint8)
        queue = self.queue
        for level in range(FAR):
            after = Queue(self.store, self.limit)
            induced = Level(level, left, after)
            for block in queue.drain():
                yield from induced.take(block)
            yield from induced.end()
            queue = after


class Level:
    """One level of the induction, over its tuples in order."""

    def __init__(self, level: int, left: np.ndarray, after: Queue):
        self.level, self.left, self.after = level, left, after
        self.held: np.ndarray | None = None
        #: of the class that is open: the least common prefix since each byte was last seen
        self.open: dict[int, int] = {}
        self.cls = self.place = 0
        self.code = -1  # of the tuple before

    def take(self, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held is not None:
            block = np.concatenate([self.held, block], axis=1)
        self.held = block[:, -1:].copy()
        if block.shape[1] > 1:
            yield self._done(block[:, :-1], int(block[2, -1]) if block[0, -1] == block[0, -2] else 0)

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held is not None:
            yield self._done(self.held, 0)

    def _done(self, block: np.ndarray, after: int) -> tuple[np.ndarray, np.ndarray]:
        code, _, lcp, item = block
        n = len(code)
        new = np.ones(n, bool)
        new[1:] = code[1:] != code[:-1]
        new[0] = self.code != code[0]
        self.code = int(code[-1])
        lcp = np.where(new, 0, lcp)
        most = np.maximum(lcp, np.append(lcp[1:], after))
        cls = self.cls + np.cumsum(new)
        place = self.place + np.arange(n)
        self._push(cls, place, lcp, item, most, bool(new[0]))
        self.cls, self.place = int(cls[-1]), self.place + n
        twice = most >= W
        return item[twice], np.full(int(twice.sum()), self.level)

    def _push(self, cls: np.ndarray, place: np.ndarray, lcp: np.ndarray, item: np.ndarray, most: np.ndarray, fresh: bool) -> None:
        """The suffixes one byte to the left, with what they share with the one before in their
        class to be: the least in between here, and that byte."""
        room = self.left[item, FAR - 1].astype(np.int64) - self.level
        goes = (room > 0) & (most + room >= W)
        byte = self.left[item, min(self.level, FAR - 2)].astype(np.int64)
        at = np.flatnonzero(goes)
        code = cls[at] * 256 + byte[at]
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        shared = np.full(len(at), -1, np.int64)
        follows = np.flatnonzero(code[1:] == code[:-1]) + 1
        i, j = at[follows - 1] + 1, at[follows]
        near = i == j
        shared[follows[near]] = lcp[j[near]]
        i, j = i[~near], j[~near]
        if len(i):
            ends = np.stack([i, j + 1], axis=1).ravel()
            shared[follows[~near]] = np.minimum.reduceat(np.append(lcp, 0), ends)[::2]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        running = np.minimum.accumulate(lcp)
        if not fresh:  # the class that was open goes on: what its bytes shared so far
            for k in first[cls[at[first]] == cls[0]].tolist():
                if int(code[k] & 255) in self.open:
                    shared[k] = min(self.open[int(code[k] & 255)], int(running[at[k]]))
        last_cls = cls[-1]
        old = {b: min(x, int(running[-1])) for b, x in self.open.items()} if not fresh and last_cls == cls[0] else {}
        ends = np.flatnonzero(np.append(code[1:] != code[:-1], True)[: len(code)])
        for k in ends[cls[at[ends]] == last_cls].tolist():
            old[int(code[k] & 255)] = int(lcp[at[k] + 1 :].min()) if at[k] + 1 < len(lcp) else W + FAR
        self.open = old
        self.after.push(np.stack([code, place[at], shared + 1, item[at]]))


def found_in_shards(pieces: DataFrame, folder: str | None, rows_at_once: int = 50_000, limit: int = MEMORY_TUPLES) -> DataFrame:
    """(doc_id, row, start, n) of strings that occur twice; pieces lie by key and right."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])

    def results(shard: Shard, who: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, row, anchor, single = (np.concatenate(x) for x in zip(*who, strict=True))
        got = [(i[single[i]], d[single[i]]) for i, d in shard.strings()]
        item, level = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((level, item))
        item, level = item[order], level[order]
        at = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (level[1:] != level[:-1] + 1))[: len(item)])
        n = np.diff(np.append(at, len(item)))
        item, level = item[at], level[at]
        cols = [doc[item], row[item], anchor[item] - level - n + 1, n]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        shard, who, key = Shard(store, limit), [], None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            start = 0
            while start < len(keys):
                if shard.n < rows_at_once:
                    end = min(len(keys), start + rows_at_once - shard.n)
                else:  # a full shard ends with its key
                    end = int(np.searchsorted(keys, key, side="right"))
                    if end <= start:
                        yield from results(shard, who)
                        shard, who = Shard(store, limit), []
                        continue
                part = batch.slice(start, end - start)
                cols = {c: part.column(c) for c in part.schema.names}
                shard.add(keys[start:end], cols["left"].to_pylist(), cols["right"].to_pylist())
                who.append(tuple(cols[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "row", "anchor", "single")))
                key, start = keys[end - 1], end
        if shard.n:
            yield from results(shard, who)

    return pieces.mapInArrow(run, "doc_id long, row long, start long, n long")


_PIECE = "key long, doc_id long, row long, anchor long, single boolean, left binary, right binary"


def pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of opened halves (doc_id, row, span, half, key, single): before and from the
    anchor, or the place FAR bytes before it."""
    asked = F.struct("span", "half", "key", "single")
    lists = wanted.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("of")).agg(F.collect_list(asked).alias("asked"))
    d = documents(docs).join(lists, (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("of"))).select("doc_id", "row", "text", "asked")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch):
                out: list[tuple] = []
                for r in part.to_pylist():
                    text = r["text"].encode()
                    for x in r["asked"]:
                        start, before, size = x["span"] >> 20, x["span"] >> 10 & 1023, x["span"] & 1023
                        end = start + size - 1 + W
                        anchor = start + before - (FAR if x["half"] else 0)
                        left = max(start, start + before - FAR + 1) if not x["half"] else start
                        out.append((x["key"], r["doc_id"], r["row"], anchor, x["single"], text[left:anchor], text[anchor : min(end, anchor + W)]))
                cols = zip(*out, strict=True) if out else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return d.mapInArrow(run, _PIECE)


def found_by_count(hot: DataFrame) -> DataFrame:
    """(doc_id, row, start, n): strings of hot pieces that occur twice, by sums of fingerprints."""
    schema = "h1 long, h2 long, doc_id long, row long, start long, single boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], [], []]
            for r in batch.to_pylist():
                data, first = memoryview(r["left"] + r["right"]), r["anchor"] - len(r["left"])
                for k in range(min(len(r["left"]) + 1, len(data) - W + 1)):
                    h = xxhash.xxh3_128_intdigest(data[k : k + W])
                    for col, v in zip(out, (h >> 64, h & (1 << 64) - 1, r["doc_id"], r["row"], first + k, r["single"]), strict=True):
                        col.append(v)
            cols = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in out[:2]] + [pa.array(c, pa.int64()) for c in out[2:5]] + [pa.array(out[5], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    d = hot.mapInArrow(run, schema)
    counted = d.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    d = d.filter("single").join(counted, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    return d.select("doc_id", "row", "start", F.lit(1).cast("long").alias("n"))


def mounted(spark: SparkSession) -> str | None:
    """The shared folder as tasks can open it."""
    root = urlparse(shared_dir(spark))
    return root.path if root.scheme in ("", "file") else None


def repeated(docs: DataFrame, hot: int = HOT, rows_at_once: int = 50_000, limit: int = MEMORY_TUPLES) -> DataFrame:
    """(doc_id, row, spans): the starts of strings that occur twice, as (start, n) in a row."""
    found = written(settled(chunks(docs)), "chunks")
    size, before, start = F.col("span").bitwiseAND(1023), F.shiftright("span", 10).bitwiseAND(1023), F.shiftright("span", 20)
    whole = found.filter("gone").select("doc_id", "row", start.alias("start"), size.cast("long").alias("n"))
    opened = found.filter("opened")
    near, far = before - size + 1 < FAR, before >= FAR  # whose last or first string is in that half
    halves = opened.filter(near).select("doc_id", "row", "span", F.lit(0).alias("half"), F.col("near").alias("key"), "single")
    halves = halves.unionByName(opened.filter(far).select("doc_id", "row", "span", F.lit(1).alias("half"), F.col("far").alias("key"), "single"))
    shared = halves.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("key").alias("of_key"), (F.col("k") > hot).alias("hot"))
    wanted = written(halves.join(shared, F.col("key") == F.col("of_key")).drop("of_key"), "halves")
    dealt = pieces(docs, wanted.filter("NOT hot")).repartition("key").sortWithinPartitions("key", "right")
    inside = found_in_shards(dealt, mounted(docs.sparkSession), rows_at_once, limit)
    spans = whole.unionByName(inside)
    if not wanted.filter("hot").isEmpty():
        spans = spans.unionByName(found_by_count(pieces(docs, wanted.filter("hot"))))
    return spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def removed(n: int, spans: list | None) -> np.ndarray:
    """Bounds of the maximal removed runs of a text of n bytes: starts and ends in turn."""
    if not spans:
        return np.zeros(0, np.int64)
    start, k = (np.array([x[c] for x in spans], np.int64) for c in ("start", "n"))
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate((start + k - 1 + W)[order])
    new = np.append(True, start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return np.stack([start[at], end[np.append(at[1:], len(start)) - 1]], axis=1).ravel().clip(0, n)


def digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, bytes, removed bytes and runs, and the hash of what is left, for every row."""
    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.withColumn("key", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("row", F.xxhash64("text"))
    s = spans.select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "spans")
    d = d.join(s, (F.col("key") == F.col("id")) & (F.col("row") == F.col("of")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in S.slices(batch):
                out = []
                for text, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    cuts = removed(len(raw), s).tolist()
                    kept = hashlib.sha256()
                    at = 0
                    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
                        kept.update(raw[at:a])
                        at = b
                    kept.update(raw[at:])
                    out.append((len(raw), sum(cuts[1::2]) - sum(cuts[::2]), len(cuts) // 2, kept.hexdigest()))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return d.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op11_induced_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(docs, repeated(docs))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT doc_id, p, substr(x, 2 * p + 1, 1822) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399, 512)) AS p FROM d)),
win AS (SELECT doc_id, p + i AS i, md5_number(substr(y, 2 * i + 1, 800)) AS g
        FROM (SELECT doc_id, p, y, unnest(range(0, least(512, len(y) // 2 - 399))) AS i FROM part)),
dup AS (SELECT doc_id, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k
        FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -401) + 400)::INT AS new FROM dup)),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY ALL),
keep AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS t
         FROM (SELECT d.doc_id, x, coalesce(lag(b) OVER w, 0) AS a, span.a AS b FROM d JOIN span USING (doc_id) WINDOW w AS (PARTITION BY d.doc_id ORDER BY span.a)
               UNION ALL SELECT d.doc_id, x, e, len(x) // 2 FROM d JOIN (SELECT doc_id, max(b) AS e FROM span GROUP BY 1) USING (doc_id)) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY 1)
SELECT d.doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(t, x))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN keep USING (doc_id)
"""
