"""Token counts by heap-and-linked-list byte-pair merging.

The characters of a unit form a linked list; a heap holds the adjacent pairs that are
pieces, by rank and then by place. The lowest is popped and merged until none is left. A
count is the initial symbols minus the merges; no identifiers are made. A character that is
no piece counts as its UTF-8 bytes and never merges.

Texts are cut before runs of spaces: no piece holds a space mark after another character
(checked on load), so no merge crosses such a place. Counts of units are remembered in each
Python worker, up to ``REMEMBERED`` units of ``UNIT_CHARS`` characters at most, until other
work begins there.

Defined cases: a null text counts as empty, an empty text has no token; special strings
inside texts are ordinary text; equal rows give equal counts; an empty table gives no rows;
only doc_id and text are read. A text without spaces is one unit (n log n).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import own_columns, table
from .shingles import forgetting, give_back

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
REMEMBERED = 1_500_000
UNIT_CHARS = 64

_UNITS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def ranks_of(path: str) -> dict[str, int]:
    """Piece -> rank, lowest first, from the model file's own scores; bytes and controls left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i)):
            pieces[sp.id_to_piece(i)] = -sp.get_score(i)
    if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in pieces):
        raise ValueError("a piece crosses a space or a line: units can't be counted apart")
    order = {score: k for k, score in enumerate(sorted(set(pieces.values())))}
    return {p: order[score] for p, score in pieces.items()}


def merge_count(unit: str, ranks: dict[str, int]) -> int:
    """Tokens of one unit by repeatedly merging the lowest-rank adjacent pair."""
    symbols: list[str | None] = list(unit)
    n = total = len(symbols)
    for c in symbols:
        if c not in ranks:
            total += len(c.encode()) - 1
    rank_of = ranks.get
    heap = []  # rank * n + place: in order of rank, then of place
    for i in range(n - 1):
        rank = rank_of(symbols[i] + symbols[i + 1])
        if rank is not None:
            heap.append(rank * n + i)
    if not heap:
        return total
    heapq.heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while heap:
        rank, i = divmod(heapq.heappop(heap), n)
        left, j = symbols[i], after[i]
        if left is None or j >= n:
            continue
        pair = left + symbols[j]
        if rank_of(pair) != rank:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = pair, None
        total -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = rank_of(pair + symbols[k])
            if rank is not None:
                heapq.heappush(heap, rank * n + i)
        h = before[i]
        if h >= 0:
            rank = rank_of(symbols[h] + pair)
            if rank is not None:
                heapq.heappush(heap, rank * n + h)
    return total


class Counts(dict):
    """Unit -> tokens, filled on demand and emptied when full."""

    def __init__(self, ranks: dict[str, int], mark: str):
        super().__init__()
        self.ranks, self.mark = ranks, mark

    def __missing__(self, unit: str) -> int:
        n = merge_count(self.mark + unit, self.ranks)
        if len(unit) <= UNIT_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = n
        return n


class Counter:
    """Token counts of whole texts, with a leading space mark as the library adds one."""

    def __init__(self, path: str):
        ranks = ranks_of(path)
        self.plain, self.words = Counts(ranks, ""), Counts(ranks, SPACE)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            if "\n" not in text:
                return sum(map(self.words.__getitem__, text.split(" ")))
            return sum(map(self.lines, text.split(" ")))
        marked = SPACE + text.replace(" ", SPACE)
        return sum(map(self.plain.__getitem__, _UNITS.findall(marked)))

    def lines(self, unit: str) -> int:
        """A line end is no part of any piece: it counts one and cuts the unit."""
        if "\n" not in unit:
            return self.words[unit]
        first, *rest = unit.split("\n")
        return self.words[first] + len(rest) + sum(self.plain[x] for x in rest if x)


_counters: dict[str, Counter] = {}
forgetting.append(_counters.clear)


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def n_tokens(docs: DataFrame, model: str = MODEL) -> Column:
    """The token count of docs.text, as a column."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(model_path(model))
        for batch in batches:
            yield pd.Series([count(x) for x in batch], dtype="int64")
        give_back()

    return run(F.col("`text`"))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    d = own_columns(docs, "doc_id", "text")
    d = d.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), n_tokens(d, model).alias("n_tokens"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_bpe_count(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
