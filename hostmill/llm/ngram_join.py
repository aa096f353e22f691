"""Similarity self-join on word shingles by adaptive multi-match prefixes.

A document is its set of 5-word shingles, in the order of their fingerprints. Two sets with a
Jaccard similarity of at least 0.75 share shingles in their prefixes; how many follows from
the sizes and the prefix lengths. Prefixes are lengthened where the rows dealt by shingle
show that candidates would be costly, and a pair must then share correspondingly more.

1. One pass makes a row per document: set size and fingerprints. Equal sets become one class,
   so copies never meet.
2. Every class deals its base prefix by shingle. A shingle of up to ``COMMON`` classes makes
   pairs, which are counted; beyond that it is common, makes none, and is only counted for
   each class. A prefix holds more shingles than ``spare`` common ones can account for, so a
   pair is found unless both of its sets have more common ones than that.
3. Sets with more common shingles are dealt whole, among themselves, in the same way. What
   is left are pairs that share common shingles alone, and both sets must consist of them by
   three quarters. Their prefixes are taken in the order of exact counts among these sets, rare
   shingles first. They are linked to a few leaders of each such shingle, those with the fewest
   shingles of their own first, and pairs in different components are looked at one by one.
4. Candidates that share enough are compared exactly; components follow from the links.

The counts of step 2 are exact and made by whoever holds the shingle's rows, as a stream that
keeps at most ``COMMON`` of them. A shingle that is common within one batch of documents leaves
only a marker and a count for each class, so that none makes a hot task.

None of these tables has a proven bound, so their joins are merge joins by hint and behave alike
at every size; only the names of wanted classes may be broadcast, by their measured size.

Pairs inside a component are not compared again: they can't change it. Node identifiers are
64-bit set fingerprints; a second fingerprint is checked and the job fails loudly if two
different sets share the first.

Defined cases: a null or word-less text has an empty set, links with nothing and is its own
component; fewer than five words are one shingle; copies share a component; repeated rows
with one doc_id count once each, with the sets of their own texts; an empty table gives no rows; a null doc_id is kept, and
its component is the smallest doc_id of its copies or links, or null; only doc_id and text
are read, and other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shingles as S
from .common import bucketed, own_columns, packed, table, unpacked, written

K = 5
#: A shingle that more classes deal is common.
COMMON = 32
#: Rows that a task deals at once.
DEALT = 400_000
#: Parts that the rows of a shingle are spread over before its leaders are taken.
SALTS = 32
#: Rows of a shingle in one task, about, where they meet each other.
PART = 1000
#: Bits of a set's sketch.
BITS = 512
#: Nodes that stand for a common shingle.
LEADERS = 4
#: Links that one task folds to a forest, about.
FOLDED = 200_000


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row in the batch, sorted different shingles) of each row."""
    row = 0
    for part in S.slices(batch):
        words, bounds = S.fingerprints(S.word_lists(part.column("text"), lower=True))
        grams = S.windows(words, K)
        for i in range(part.num_rows):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= K:
                yield row, np.unique(grams[a : b - K + 1])
            elif b > a:
                yield row, S.windows(words[a:b], int(b - a))
            else:
                yield row, words[:0]
            row += 1


def set_fingerprints(t: np.ndarray) -> tuple[int, int]:
    n = np.uint64(len(t))
    one = S.mix(np.array([S.mix(t + np.uint64(1)).sum(dtype=np.uint64) + n], np.uint64))
    two = S.mix(np.array([np.bitwise_xor.reduce(S.mix(t ^ np.uint64(0x5DEECE66D)), initial=n)], np.uint64))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


_PROFILE = "doc_id long, row long, node long, check long, n long"


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, both set fingerprints and set size of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*set_fingerprints(t), len(t)) for _, t in shingle_sets(batch)]
            cols = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("row"), *cols], names=["doc_id", "row", "node", "check", "n"])

    return own_columns(docs, "doc_id", "text").withColumn("row", F.xxhash64("text")).mapInArrow(S.tidy(run), _PROFILE)


def least_overlap(n):
    """The overlap that any partner of similarity 0.75 has with a set of n: ceil(3n / 4)."""
    return (3 * n + 3) // 4


def base_length(n: int) -> int:
    """Shingles of a base prefix: any pair shares at least 1 + n // 24 of the smaller n in it."""
    return n - least_overlap(n) + 1 + n // 24


def spare(n):
    """Common shingles in a base prefix that can't hide a pair: fewer than 1 + m // 24 for any m from 3n / 4."""
    return n // 32


_DEALT = "shingle long, node long, n int"


def dealt(sets: Iterator[tuple[int, np.ndarray]], length: Callable[[int], int]) -> Iterator[pa.RecordBatch]:
    """(shingle, node, n) of the first ``length(n)`` shingles of each (node, set).

    A shingle with more than COMMON nodes here is known as common: it gives one row with n = 0,
    and each of its nodes counts it in a row (node, node, -count).
    """
    tok: list[np.ndarray] = []
    node: list[int] = []
    size: list[int] = []
    waiting = 0

    def rows() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in tok])
        shingle = np.concatenate(tok)
        of = np.repeat(np.array(node, np.int64), lengths)
        n = np.repeat(np.array(size, np.int32), lengths)
        keys, at, counts = np.unique(shingle, return_inverse=True, return_counts=True)
        common = counts[at] > COMMON
        marked = keys[counts > COMMON].view(np.int64)
        counted, times = np.unique(of[common], return_counts=True)
        cols = [
            np.concatenate([shingle[~common].view(np.int64), marked, counted]),
            np.concatenate([of[~common], np.zeros(len(marked), np.int64), counted]),
            np.concatenate([n[~common], np.zeros(len(marked), np.int32), -times.astype(np.int32)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shingle", "node", "n"])

    for name, t in sets:
        tok.append(t[: length(len(t))])
        node.append(name)
        size.append(len(t))
        waiting += len(tok[-1])
        if waiting > DEALT:
            yield rows()
            tok, node, size, waiting = [], [], [], 0
    if tok:
        yield rows()


def base_rows(docs: DataFrame) -> DataFrame:
    """The base prefixes of all documents, those of copies in one batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(batch):
            seen = set()
            for _, t in shingle_sets(batch):
                name = set_fingerprints(t)[0] if len(t) else None
                if name is not None and name not in seen:
                    seen.add(name)
                    yield name, t

        for batch in batches:
            yield from dealt(sets(batch), base_length)

    return own_columns(docs, "doc_id", "text").select("text").mapInArrow(S.tidy(run), _DEALT)


def rows_of_sets(sets: DataFrame, length: Callable[[int], int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (x.values.to_numpy().view(np.uint64) for x in batch.column("set"))
            yield from dealt(zip(batch.column("node").to_pylist(), lists, strict=True), length)

    return sets.select("node", "set").mapInArrow(S.tidy(run), _DEALT)


_MET = "kind int, a long, b long, na int, nb int, c long"


def meetings(rows: DataFrame) -> DataFrame:
    """kind 0: a pair (a, b), its sizes and the shingles it shares that aren't common.
    kind 1: a node a and the common shingles among those it dealt."""
    d = rows.repartition("shingle").sortWithinPartitions("shingle", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("c", pa.int64())])

        def made(kind, a, b, na, nb, c) -> pa.RecordBatch:
            cols = [np.full(len(a), kind, np.int32), a, b, na.astype(np.int32), nb.astype(np.int32), c.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], schema=schema)

        def counts(node, c) -> pa.RecordBatch:
            zero = np.zeros(len(node), np.int64)
            return made(1, node, zero, zero, zero, c)

        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        going = last = None  # the common shingle whose rows go on, and the last row of it
        for batch in _with_end(batches):
            if batch is not None:
                cols = [batch.column(c).to_numpy() for c in ("shingle", "node", "n")]
                told = cols[2] < 0
                if told.any():
                    yield counts(cols[1][told], -cols[2][told])
                    cols = [c[~told] for c in cols]
                held = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            tok, node, n = held
            if not len(tok):
                continue
            new = np.ones(len(tok), bool)  # copies in several batches gave equal rows
            new[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
            new[0] = last is None or (tok[0], node[0]) != last
            tok, node, n = tok[new], node[new], n[new]
            if not len(tok):
                held = [tok, node, n]
                continue
            at = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            size = np.diff(np.append(at, len(tok)))
            common = (size > COMMON) | (n[at] == 0)
            if going is not None:
                common |= tok[at] == going
            end, going, last = len(tok), None, None
            if batch is not None:
                if common[-1]:
                    going, last = tok[-1], (tok[-1], node[-1])
                else:  # the rest of its rows may follow
                    end, at, size, common = int(at[-1]), at[:-1], size[:-1], common[:-1]
            held = [x[end:] for x in (tok, node, n)]
            tok, node, n = tok[:end], node[:end], n[:end]
            often = np.repeat(common, size)
            if often.any():
                name, c = np.unique(node[often & (n > 0)], return_counts=True)
                yield counts(name, c)
                tok, node, n = tok[~often], node[~often], n[~often]
            # Within a shingle rows are in order of set size: partners of a row follow it
            # while their size stays within 4/3 of its own.
            first = np.arange(len(tok))
            step = 1
            while len(first):
                second = first + step
                first, second = first[second < len(tok)], second[second < len(tok)]
                same = (tok[first] == tok[second]) & (3 * n[second].astype(np.int64) <= 4 * n[first].astype(np.int64))
                x, y = first, second = first[same], second[same]
                if len(x):
                    flip = node[x] > node[y]
                    x, y = np.where(flip, y, x), np.where(flip, x, y)
                    yield made(0, node[x], node[y], n[x], n[y], np.ones(len(x)))
                step += 1

    met = d.mapInArrow(S.tidy(run), _MET)
    met = met.groupBy("kind", "a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
    return written(met, "met")


def _with_end(batches):
    yield from batches
    yield None


#: Shingles that a pair must share.
NEED = "ceil((na + nb) * 3 / 7D)"


def base_pairs(met: DataFrame) -> DataFrame:
    """Candidates of the base prefixes. Beyond the prefix that ends first lie at most its set's
    other shingles, and one set at least has no more common ones than are spare."""
    rest = F.greatest(*[F.expr(f"({x} * 3 + 3) div 4 - 1 - {x} div 24") for x in ("na", "nb")])
    enough = F.col("c") + rest + F.expr("greatest(na, nb) div 32") >= F.expr(NEED)
    return met.filter((F.col("kind") == 0) & enough).select("a", "b")


def with_group(rows: DataFrame, *aggs, again) -> DataFrame:
    """rows (with shingle and part) and aggregates of all rows of their shingle.

    Aggregated by part, then by shingle over its parts (``again``); the result goes back by
    shingle and part, so that the rows of one shingle are never in one task.
    """
    parts = written(rows.groupBy("shingle", "part").agg(*aggs), "parts")
    whole = parts.groupBy(F.col("shingle").alias("of")).agg(*again)
    back = parts.select("shingle", "part").join(whole.hint("merge"), F.col("shingle") == F.col("of")).drop("of")
    return rows.join(back.hint("merge"), ["shingle", "part"])


def prefix_rows(sets: DataFrame, alike: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shingle, part, node, n, common, k) of the prefixes of the sets of ``alike``, in the order of
    the shingles' counts among them, k being the place; shingles of one set alone are left out. And per node a
    sketch: the number of its shingles that others of these sets have, and BITS bits of them."""
    d = sets.join(alike.hint("merge"), "node").select(F.explode("set").alias("shingle"), F.pmod("node", F.lit(SALTS)).alias("part"), "node", "n", "common")
    d = written(with_group(written(d, "tokens"), F.count(F.lit(1)).alias("m"), again=[F.sum("m").alias("m")]), "tokens")
    order = Window.partitionBy("node").orderBy("m", "shingle")
    rows = d.withColumn("k", F.row_number().over(order)).filter(F.expr("k <= n - (n * 3 + 3) div 4 + 1 AND m > 1"))
    bit = F.pmod("shingle", F.lit(BITS))
    words = [F.bit_or(F.when(F.floor(bit / 64) == j, F.expr("shiftleft(1L, cast(pmod(shingle, 64) as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{j}") for j in range(BITS // 64)]
    sketch = d.filter("m > 1").groupBy("node").agg(F.count(F.lit(1)).alias("met"), *words)
    return written(rows.select("shingle", "part", "node", "n", "common", "k"), "rows"), sketch


def star_pairs(rows: DataFrame) -> DataFrame:
    """Each node of a shingle's rows with that shingle's leaders.

    Leaders are taken in each part of a shingle first, then among the leaders of its parts: half
    of them by the fewest shingles that aren't common, as such sets are like most others.
    """
    least = []
    for j in range(LEADERS):
        own = [] if j % 2 else [F.col("n") - F.col("common")]
        least.append(F.min(F.struct(*own, F.xxhash64("node", F.lit(j)).alias("h"), "node", "n", "common")))
    some = F.array(*[F.struct(x["node"].alias("node"), x["n"].alias("n"), x["common"].alias("common")) for x in least])

    def leaders(d: DataFrame, *by: str) -> DataFrame:
        return d.groupBy(*by).agg(F.array_distinct(some).alias("leaders"))

    parts = written(leaders(rows, "shingle", "part"), "leaders")
    heads = parts.select("shingle", F.explode("leaders").alias("x")).select("shingle", "x.*")
    led = rows.join(parts.hint("merge"), ["shingle", "part"]).select("node", F.explode("leaders.node").alias("leader"))
    led = led.unionByName(heads.join(leaders(heads, "shingle").hint("merge"), "shingle").select("node", F.explode("leaders.node").alias("leader")))
    return led.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def pairs_across(rows: DataFrame, labels: DataFrame, sketch: DataFrame) -> DataFrame:
    """Pairs of prefix rows in different components that may still be similar: their sizes allow
    it, both have enough common shingles, and enough are left without those whose bit the other
    set lacks. What a pair shares lies behind the first shingle that it shares, in both sets: rows
    with fewer shingles from their place on than the pair needs don't meet.

    rows: shingle, part, node, n, k and common, the number of common shingles in the node's set. A
    node with so few of them, or so few from its place on, that it needs a smaller partner than its
    shingle has is left out.
    """
    d = rows.join(labels.select(F.col("node").alias("of"), "label").hint("merge"), F.col("node") == F.col("of"), "left")
    d = d.select("shingle", "part", "node", "n", "common", "k", F.coalesce("label", "node").alias("label"))
    d = with_group(written(d, "labelled"), F.min("n").alias("least"), again=[F.min("least").alias("least")]).filter("7 * least(common, n - k + 1) - 3 * n >= 3 * least").drop("least")
    ends = [F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")]
    d = with_group(written(d, "able"), *ends, again=[F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("m").alias("m")]).filter("lo <> hi").drop("lo", "hi")
    # Rows of one side meet those of the other in tasks of about PART rows of a shingle.
    d = written(d.withColumn("salts", F.ceil(F.col("m") / PART).cast("int")).join(sketch.hint("merge"), "node"), "open")
    words = [f"w{j}" for j in range(BITS // 64)]

    def side(x: str) -> list:
        return ["shingle", F.col("node").alias(x)] + [F.col(c).alias(f"{c}_{x}") for c in ("label", "common", "met", "k", *words)] + [F.col("n").alias(f"n{x}")]

    def left(x: str, y: str):
        """The shingles of x that y may share."""
        lacked = [F.bit_count(F.col(f"{w}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{w}_{y}")))) for w in words]
        return F.col(f"met_{x}") - sum(lacked[1:], lacked[0])

    a = d.select(*side("a"), F.expr("cast(pmod(xxhash64(node), salts) as int)").alias("salt"))
    b = d.select(*side("b"), F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"))
    behind = [F.col(f"n{x}") - F.col(f"k_{x}") + 1 for x in ("a", "b")]
    most = F.least("common_a", "common_b", left("a", "b"), left("b", "a"), *behind)
    may = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & (most >= F.expr(NEED))
    return a.join(b.hint("merge"), ["shingle", "salt"]).filter(may).select("a", "b").distinct()


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least 0.75."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * shared >= 75 * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.hint("merge").join(right, "b").hint("merge").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(S.tidy(run), "a long, b long")


def forest(links: DataFrame) -> DataFrame:
    """Links with the same components, no more than a tree a task: connectivity is
    pre-aggregated before anything is dealt by node. links: a written table."""
    tasks = max(1, -(-links.count() // FOLDED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = parent.setdefault(x, x)
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(a), root(b)
                keep.append(x != y)
                parent[max(x, y)] = min(x, y)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return links.select("a", "b").repartition(tasks).mapInArrow(S.tidy(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the label is shared by all nodes of a component of the links.

    Every round each node takes the least label around it and then that label's own label;
    rounds are written to the shared folder, and end when no label changes.
    """
    tree = written(forest(links), "forest")
    both = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    both = written(both, "links")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(around, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("near"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("above"))
        jumped = nearer.join(up, F.col("near") == F.col("at"), "left").select("node", "label", F.least("near", "above").alias("next"))
        jumped = written(jumped, "labels")
        changed = jumped.filter("next <> label").limit(1).count()
        labels = jumped.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def needed_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set in order of fingerprints) of the given nodes, from the texts of their classes.

    Rows of one doc_id may have different texts, so a text counts for a node only if it has
    its fingerprint. Classes without any doc_id are found by the fingerprints of such rows.
    """
    wanted = classes.join(nodes, "node").select("node", F.col("rep").alias("id"))
    d = own_columns(docs, "doc_id", "text")
    texts = d.join(wanted, F.col("doc_id") == F.col("id")).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [t for _, t in shingle_sets(batch)]
            nodes = pa.array([set_fingerprints(t)[0] for t in sets], pa.int64())
            made = pa.RecordBatch.from_arrays([nodes, pa.array([t.view(np.int64) for t in sets], pa.list_(pa.int64()))], names=["node", "set"])
            yield made.filter(pc.equal(nodes, batch.column("node"))) if "node" in batch.schema.names else made

    made = "node long, set array<long>"
    bare = d.filter("doc_id IS NULL").select("text").mapInArrow(S.tidy(run), made)
    bare = bare.join(wanted.filter("id IS NULL").select("node"), "node", "left_semi")
    return bucketed(texts.mapInArrow(S.tidy(run), made).unionByName(bare), "sets", "node")


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def crowded(met: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, n, common) of the nodes that dealt common shingles."""
    counts = met.filter("kind = 1").select(F.col("a").alias("node"), F.col("c").alias("common"))
    return counts.join(classes.select("node", "n").hint("merge"), "node")


def pairs_of_crowded(sets: DataFrame, few: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates among the sets of the nodes ``few``, and (node, n, common) of those of them
    that may be similar by common shingles alone."""
    met = meetings(rows_of_sets(sets.join(few.select("node").hint("merge"), "node", "left_semi"), lambda n: n))
    counts = written(crowded(met, classes), "crowded")
    common = counts.select("node", "common")
    pairs = met.filter("kind = 0").join(common.select(F.col("node").alias("a"), F.col("common").alias("ca")).hint("merge"), "a", "left")
    pairs = pairs.join(common.select(F.col("node").alias("b"), F.col("common").alias("cb")).hint("merge"), "b", "left")
    both = F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0)))
    pairs = pairs.filter(F.col("c") + both >= F.expr(NEED)).select("a", "b")
    return pairs, counts.filter("common >= (n * 3 + 3) div 4")


def classes_and_components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per document (doc_id, row, n_shingles, node); per class (node, rep, n); per linked class
    (node, label, component)."""
    per_doc = written(profiles(docs), "profiles")
    classes = per_doc.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    safe = F.when(F.col("lo") == F.col("hi"), F.col("rep")).otherwise(F.raise_error(F.lit("two sets share a fingerprint")).cast("long"))
    classes = written(classes.select("node", safe.alias("rep"), "n"), "classes")
    met = meetings(base_rows(docs))
    pairs = written(base_pairs(met), "pairs")
    few = written(crowded(met, classes).filter("common > n div 32"), "few")
    sets = needed_sets(docs, classes, nodes_of(pairs).unionByName(few.select("node")).distinct())
    more, alike = pairs_of_crowded(sets, few, classes)
    rows, sketch = prefix_rows(sets, alike)
    pairs = written(pairs.unionByName(more).unionByName(star_pairs(rows)).distinct(), "pairs")
    links = written(compared(pairs, sets), "links")
    labels = components(links)
    across = pairs_across(rows, labels, sketch).join(pairs, ["a", "b"], "left_anti")
    more = written(compared(across, sets), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    least = labels.join(classes, "node").groupBy("label").agg(F.min("rep").alias("component"))
    labels = written(labels.join(least, "label").select("node", "label", "component"), "components")
    return per_doc.select("doc_id", "row", F.col("n").alias("n_shingles"), "node"), classes, labels


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    per_doc, classes, labels = classes_and_components(docs)
    groups = classes.join(labels, "node", "left").select("node", F.coalesce("component", "rep").alias("component"))
    out = per_doc.join(groups, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each component the document of the smallest doc_id, and one of its rows without a
    doc_id; all columns kept.

    A document is told by doc_id and text, so that texts under one doc_id are judged apart;
    of several in a component one stays. Repeated rows of one doc_id and text share their
    fate. Rows without a doc_id are judged among themselves, and rows without words stay.
    """
    per_doc, classes, labels = classes_and_components(docs)
    groups = labels.select(F.col("node").alias("of"), "label")
    d = per_doc.filter("n_shingles > 0").join(groups, F.col("node") == F.col("of"), "left")
    d = d.select("doc_id", "row", F.coalesce("label", "node").alias("label"))
    bare = F.col("doc_id").isNull()
    least = d.groupBy(F.col("label").alias("of")).agg(
        F.min(F.when(~bare, F.struct("doc_id", "row"))).alias("first"), F.min(F.when(bare, F.col("row"))).alias("bare")
    )
    d = d.join(least, F.col("label") == F.col("of"))
    later = d.filter(F.when(bare, F.col("row") != F.col("bare")).otherwise(F.struct("doc_id", "row") != F.col("first")))
    later = written(later.select(F.col("doc_id").alias("id"), F.col("row").alias("of")).distinct(), "later")
    rows = packed(docs, "doc_id", "text").withColumn("row", F.xxhash64("text"))
    same = F.col("row") == F.col("of")
    with_id = rows.filter("doc_id IS NOT NULL").join(later, (F.col("doc_id") == F.col("id")) & same, "left_anti")
    without = rows.filter("doc_id IS NULL").join(later.filter("id IS NULL"), same, "left_anti")
    # Of equal texts without a doc_id the first row stays.
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    order = Window.partitionBy("row").orderBy(F.monotonically_increasing_id())
    once = without.filter(has_words).withColumn("copy", F.row_number().over(order)).filter("copy = 1")
    own = ["doc_id", "text", "rest"]
    kept = with_id.select(*own).unionByName(once.select(*own)).unionByName(without.filter(~has_words).select(*own))
    return unpacked(kept, docs.columns, "doc_id", "text")


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
