"""Alignment of two tokenizers by external spill counting.

A text is encoded by a byte-level tokenizer (side A) and by a piece tokenizer (side B). Byte
offsets where tokens of both sides end cut the text into groups; the tokens of a group are
linked, each of A with each of B. How many documents hold a pair of linked identifiers is
counted over the corpus, and each document gets what its own pairs weigh there.

1. Documents are encoded once, in slices of about ``SLICE_BYTES``. A slice becomes one row of a
   table in the shared folder: its documents' figures, its pair-document records (document by
   document, zstd), and for each radix of A's identifiers a run: the slice's pairs of that radix
   in order, with how many of its documents hold each (zstd). The records themselves never move:
   a pair that every document holds is one entry of a run.
2. The runs are dealt by radix. A heap merges the k runs of a radix; a pair's count is the sum of
   its entries. Order is by A first, so when A's identifier changes its highest count is known,
   and counts and marks of the highest go back to the runs they came from.
3. What comes back to a slice is laid over its records and summed document by document.

Texts are cut before a space between two characters that aren't white space: neither tokenizer's
tokens cross such a place (tested against the libraries on whole texts). Units that a Python worker
doesn't remember are encoded together, joined by spaces. A text with a unit that one of the sides
doesn't give back byte by byte is encoded whole, and has no tokens if its bytes differ.

Defined cases: null and empty texts, and texts whose bytes don't come back, have no tokens:
zeros and '' as digest; rows are documents, so a repeated row counts again; doc_id may be null or
repeat; special strings inside texts are ordinary text; ties for the highest count all count; an
empty table gives no rows; only doc_id and text are read. A document is worked on whole in one task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_count import model_path
from .common import own_columns, table, written

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a slice, but for a longer document.
SLICE_BYTES = 8 << 20
#: Units that a worker remembers between slices, and the bytes of their digests, at most.
REMEMBERED, REMEMBERED_BYTES = 500_000, 64 << 20
#: Units that are encoded at once.
UNITS_AT_ONCE = 4096
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
#: Bits of a pair's code that hold the identifier of side B.
B_BITS = 20

_CUT = re.compile("(?<=[^\\s▁]) (?=\\S)")
_ENDS = re.compile("(?s)\\S(.*[^\\s▁])?\\Z")
_SLICES = (
    "slice string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>,"
    " records binary, runs array<struct<radix:int,pairs:binary,held:binary>>"
)
_RETURNED = "slice string, radix int, counts binary, best binary"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def opened(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves and the others, in
    order, as the characters from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Sides:
    """Both tokenizers, with the bytes of each identifier."""

    def __init__(self, side_a: str, side_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(side_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=side_b)
        of = byte_of_char()
        entries = {i: bytes(of[c] for c in entry) for entry, i in self.a.get_vocab().items() if all(c in of for c in entry)}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        ids = range(self.b.get_piece_size())
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        # identifiers in decimal with what follows them: inside a side, after it, after the group, at the end
        self.said_a = [np.array([str(i).encode() + x for i in range(len(self.bytes_a))], object) for x in (b",", b"|")]
        self.said_b = [np.array([str(i).encode() + x for i in ids], object) for x in (b",", b";", b"")]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Identifiers of a space and the text on side A, of the text on side B; None if a side
        doesn't give the bytes back."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


class Units:
    """What units give to their documents, numbered; ``number`` is -1 where a side doesn't give
    the bytes back. Figures lie in arrays, links of all units one after another."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.digests: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []

    def figures(self) -> tuple[np.ndarray, ...]:
        """n_a, n_b, n_groups, links of each unit, and A's and B's identifiers of all links."""
        if len(self.parts) != 1:
            none = np.zeros(0, np.int64)
            self.parts = [tuple(map(np.concatenate, zip(*self.parts, strict=True)))] if self.parts else [(none,) * 6]
        return self.parts[0]

    def learn(self, texts: set[str]) -> None:
        joined, single = [], []  # units with white space or a mark at their ends aren't joined
        for t in texts:
            if t not in self.number:
                (joined if _ENDS.match(t) else single).append(t)
        for k in range(0, len(joined), UNITS_AT_ONCE):
            self._learn(joined[k : k + UNITS_AT_ONCE])
        for t in single:
            self._learn([t])

    def _learn(self, new: list[str]) -> None:
        ids = self.sides.encode(" ".join(new))
        if ids is not None:
            self.add(new, *ids)
        elif len(new) == 1:
            self.number[new[0]] = -1
        else:
            half = len(new) // 2
            self._learn(new[:half])
            self._learn(new[half:])

    def add(self, texts: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Number units whose texts, joined by spaces, have the identifiers a and b."""
        end_a, end_b = np.cumsum(self.sides.size_a[a]), np.cumsum(self.sides.size_b[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        edge = np.cumsum([1 + len(t.encode()) for t in texts])
        of_a, of_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)  # groups
        in_a, in_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        unit = np.searchsorted(edge, ends)
        first = np.searchsorted(unit, np.arange(len(texts) + 1))
        # in order: the group's tokens of A, then those of B
        after_a, after_b = np.cumsum(in_a), np.cumsum(in_b)
        said = np.empty(len(a) + len(b), object)
        last_a, last_b = end_a == ends[of_a], (end_b == ends[of_b]).astype(np.int64)
        last_b[after_b[first[1:] - 1] - 1] = 2
        said[np.arange(len(a)) + (after_b - in_b)[of_a]] = np.where(last_a, self.sides.said_a[1][a], self.sides.said_a[0][a])
        said[np.arange(len(b)) + after_a[of_b]] = np.choose(last_b, [x[b] for x in self.sides.said_b])
        cut = np.append(0, (after_a + after_b)[first[1:] - 1]).tolist()
        said = said.tolist()
        # every token of A meets the tokens of B in its group
        width = in_b[of_a]
        meets = np.repeat((after_b - in_b)[of_a], width) + ranges(width)
        self.parts.append((sums(in_a, first), sums(in_b, first), np.diff(first), sums(in_a * in_b, first), np.repeat(a, width), b[meets]))
        for k, t in enumerate(texts):
            self.number[t] = len(self.digests)
            self.digests.append(b"".join(said[cut[k] : cut[k + 1]]))

    def settle(self) -> None:
        """Forget all units where there are too many, or long ones."""
        if len(self.digests) > REMEMBERED or sum(map(len, self.digests)) > REMEMBERED_BYTES:
            self.clear()


_units: dict[tuple[str, str], Units] = {}


def units_of(side_a: str, side_b: str) -> Units:
    key = side_a, side_b
    if key not in _units:
        _units[key] = Units(Sides(model_path(side_a), model_path(side_b)))
    return _units[key]


def text_units(known: Units, texts: list[str | None]) -> list[list[int]]:
    """The units of each text, by number."""
    cut = [_CUT.split(t) if t else [] for t in texts]
    known.learn({x for parts in cut for x in parts})
    out = []
    for t, parts in zip(texts, cut, strict=True):
        units = list(map(known.number.__getitem__, parts))
        if -1 in units:
            ids = known.sides.encode(t)
            units = []
            if ids is not None:
                known.add([t], *ids)
                units = [len(known.digests) - 1]
        out.append(units)
    return out


def sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between bounds, empty ones too."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def records(links: tuple[np.ndarray, ...], doc: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair-document records of the units in documents, by document: document, pair, times."""
    width, a, b = links
    kinds, unit = np.unique(unit, return_inverse=True)
    used, n = np.unique(doc * len(kinds) + unit, return_counts=True)
    doc, unit = used // max(1, len(kinds)), kinds[used % max(1, len(kinds))]
    start = np.cumsum(width) - width
    take = np.repeat(start[unit], width[unit]) + ranges(width[unit])
    doc, times = np.repeat(doc, width[unit]), np.repeat(n, width[unit])
    pairs, code = np.unique(a[take] << B_BITS | b[take], return_inverse=True)
    key = doc * max(1, len(pairs)) + code
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    times = np.add.reduceat(times, at) if len(at) else times
    return key[at] // max(1, len(pairs)), pairs[key[at] % max(1, len(pairs))], times


def ranges(width: np.ndarray) -> np.ndarray:
    """0, 1, ... below each width, one after another."""
    return np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)


def radix_of(pairs: np.ndarray, radixes: int) -> np.ndarray:
    return (pairs >> B_BITS) % radixes


def slice_row(name: str, ids: list[int | None], found: list[list[int]], known: Units, radixes: int) -> dict:
    *figures, a, b = known.figures()
    bounds = np.cumsum([0, *map(len, found)])
    unit = np.fromiter(chain.from_iterable(found), np.int64, int(bounds[-1]))
    doc, pair, times = records((figures[3], a, b), np.repeat(np.arange(len(found)), np.diff(bounds)), unit)
    row = {"slice": name, "doc_id": ids} | {n: sums(x[unit], bounds) for n, x in zip(FIGURES, figures, strict=True)}
    row["digest"] = [hashlib.sha256(b";".join(map(known.digests.__getitem__, units))).hexdigest() if units else "" for units in found]
    pairs, code, held = np.unique(pair, return_inverse=True, return_counts=True)
    radix = radix_of(pairs, radixes)
    order = np.argsort(radix, kind="stable")  # runs one after another, by pair inside
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
    body = [np.array([len(bounds)], np.int64), bounds.astype(np.int64), place[code], times]
    row["records"] = packed(np.concatenate(body))
    cuts = np.flatnonzero(np.diff(radix[order], prepend=-1))
    row["runs"] = [
        {"radix": int(radix[order[i]]), "pairs": packed(np.diff(pairs[order[i:j]], prepend=0)), "held": packed(held[order[i:j]].astype(np.int64))}
        for i, j in zip(cuts, np.append(cuts[1:], len(order)), strict=True)
    ]
    return row


def spilled(docs: DataFrame, side_a: str, side_b: str, radixes: int, slice_bytes: int) -> DataFrame:
    """One row a slice: figures, records and runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        known = units_of(side_a, side_b)
        schema = pa.schema([
            ("slice", pa.string()), ("doc_id", pa.list_(pa.int64())), *[(n, pa.list_(pa.int64())) for n in FIGURES],
            ("digest", pa.list_(pa.string())), ("records", pa.binary()),
            ("runs", pa.list_(pa.struct([("radix", pa.int32()), ("pairs", pa.binary()), ("held", pa.binary())]))),
        ])
        ids, found, size = [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([slice_row(uuid.uuid4().hex, ids, found, known, radixes)], schema)

        for batch in batches:
            width = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(width), 0
            while start < batch.num_rows:
                base = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, base + slice_bytes - size, side="right")))
                part = batch.slice(start, end - start)
                found += text_units(known, part.column("text").to_pylist())
                ids += part.column("doc_id").to_pylist()
                size += int(ends[end - 1] - base)
                start = end
                if size >= slice_bytes or start < batch.num_rows:
                    yield row()
                    ids, found, size = [], [], 0
                    known.settle()
        if ids:
            yield row()
            known.settle()

    d = own_columns(docs, "doc_id", "text")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SLICES)


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each run's counts over all runs, and marks of those that are the highest of their A."""
    counts = [np.zeros(len(pairs), np.int64) for pairs, _ in runs]
    best = [np.zeros(len(pairs), bool) for pairs, _ in runs]

    def settle(of_a: list[tuple[int, list[tuple[int, int]]]]) -> None:
        top = max(n for n, _ in of_a)
        for n, places in of_a:
            for run, at in places:
                counts[run][at] = n
                best[run][at] = n == top

    streams = [zip(pairs.tolist(), repeat(k), range(len(pairs)), held.tolist()) for k, (pairs, held) in enumerate(runs)]
    last, n, places, of_a = -1, 0, [], []
    for pair, k, at, held in heapq.merge(*streams):
        if pair != last:
            if places:
                of_a.append((n, places))
                if pair >> B_BITS != last >> B_BITS:
                    settle(of_a)
                    of_a = []
            last, n, places = pair, 0, []
        n += held
        places.append((k, at))
    if places:
        settle([*of_a, (n, places)])
    return list(zip(counts, best, strict=True))


def merged(runs: DataFrame) -> DataFrame:
    """Counts and marks for every run; ``runs`` lie by radix, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, blobs, radix = [], [], None

        def back() -> pa.RecordBatch:
            done = merge([(np.cumsum(opened(p, np.int64)), opened(h, np.int64)) for p, h in blobs])
            cols = [names, [radix] * len(names), [packed(n) for n, _ in done], [packed(b) for _, b in done]]
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["slice", "radix", "counts", "best"])

        for batch in batches:
            for r in batch.to_pylist():
                if radix is not None and r["radix"] != radix:
                    yield back()
                    names, blobs = [], []
                radix = r["radix"]
                names.append(r["slice"])
                blobs.append((r["pairs"], r["held"]))
        if names:
            yield back()

    return runs.mapInArrow(run, _RETURNED)


def summed(slices: DataFrame) -> DataFrame:
    """Documents with what their pairs weigh: ``slices`` with what came back, by radix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                body = opened(r["records"], np.int64)
                bounds = body[1 : 1 + body[0]]
                place, times = np.split(body[1 + body[0] :], 2)
                back = sorted(r["back"] or [], key=lambda x: x["radix"])
                counts = np.concatenate([np.zeros(0, np.int64), *[opened(x["counts"], np.int64) for x in back]])
                best = np.concatenate([np.zeros(0, bool), *[opened(x["best"], bool) for x in back]])
                n_best, total = sums(times * best[place], bounds), sums(times * counts[place], bounds)
                cols = [r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], n_best, total]
                arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array(r["digest"], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return slices.mapInArrow(run, _OUT)


def align(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, radixes: int | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document the figures of its alignment. radixes: parts of A's identifiers, by default
    as many as shuffle partitions; a part's runs are merged in one task."""
    spark = docs.sparkSession
    radixes = radixes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = written(spilled(docs, side_a, side_b, radixes, slice_bytes), "slices")
    runs = slices.select("slice", F.explode("runs").alias("r")).select("slice", "r.*")
    runs = runs.repartition(radixes, "radix").sortWithinPartitions("radix", "slice")
    back = merged(runs).groupBy("slice").agg(F.collect_list(F.struct("radix", "counts", "best")).alias("back"))
    return summed(slices.drop("runs").join(back.withColumnRenamed("slice", "of"), F.col("slice") == F.col("of"), "left"))


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
