import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hostmill.llm import token_alignment as T
from hostmill.llm.bpe_count import model_path


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(model_path(T.SIDE_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=model_path(T.SIDE_B))


def groups_of(libraries, text):
    """Groups of a whole text by the libraries alone, one byte after another."""
    if not text:
        return []
    a, b = libraries
    of = T.byte_of_char()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
    parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    whole = (" " + text).encode()
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return []
    ends = []
    for ids, parts in ((ids_a, parts_a), (ids_b, parts_b)):
        at, n = {}, 0
        for i, p in zip(ids, parts, strict=True):
            n += len(p)
            at[n] = i
        ends.append(at)
    out, left = [], 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([at[n] for n in sorted(at) if left < n <= cut] for at in ends))
        left = cut
    return out


def model(libraries, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    short = [groups_of(libraries, t) for t in texts]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in short]
    count = Counter(p for of_text in links for p in set(of_text))
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    for g, of_text in zip(short, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(of_text), sum(count[p] == top[p[0]] for p in of_text),
            sum(count[p] for p in of_text), hashlib.sha256(said.encode()).hexdigest() if g else "",
        )


def figures(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


ODD = [
    "hello  world\n foo", " lead", "trail ", "a▁b and more", "<s> <0x41> <|endoftext|> </s>", "\x00a b", "é ﬁ ½ 日本語 русский", "\xa0x 　y z", "foo\n \nbar baz",
    "don't we'll  it's\t tabs \t end", "🙂🙂 emoji 🙂", "a" * 300, " ", "  ", "\n", "x \x1c y", "é é", "é x",
]


def test_alignment_against_the_libraries(spark, docs, libraries):
    texts = [r.text for r in docs.select("text").collect() if r.text is None or len(r.text) < 20_000] + ODD + ODD[:3]
    rows = [(k if k % 7 else None, t, str(k)) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, slice string").repartition(3)
    for settings in ({}, {"radixes": 3, "slice_bytes": 2000}):
        got = sorted(((r.doc_id if r.doc_id is not None else -1, *figures(r)) for r in T.align(table, **settings).collect()), key=str)
        want = sorted(((i if i is not None else -1, *m) for (i, _, _), m in zip(rows, model(libraries, texts), strict=True)), key=str)
        assert got == want


def test_alignment_query_against_the_libraries(spark, data, libraries):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: m for r, m in zip(rows, model(libraries, [r.text for r in rows]), strict=True) if len(r.text or "") < 1e9}
    got = {r.doc_id: figures(r) for r in T.op12_token_alignment(spark, data).collect()}
    assert got == want


def test_alignment_of_nothing_and_of_extra_columns(no_docs, docs):
    assert T.align(no_docs).count() == 0
    assert T.align(docs).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_units_are_cut_where_no_token_crosses(libraries):
    """Whole random texts have the tokens of their units."""
    rnd = random.Random(3)
    known = T.Units(T.Sides(model_path(T.SIDE_A), model_path(T.SIDE_B)))
    for _ in range(300):
        text = "".join(rnd.choice(["a", "the", "Tion", " ", " ", "  ", "\n", "\t", ",", ".", "'s", "12", "é", "\xa0", "-", "日", "▁"]) for _ in range(40))
        (units,) = T.text_units(known, [text])
        said = b";".join(known.digests[u] for u in units).decode()
        assert said == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups_of(libraries, text)), repr(text)


def test_merge_counts_pairs_and_marks_the_highest():
    pair = lambda a, b: a << T.B_BITS | b
    runs = [([pair(1, 2), pair(1, 3), pair(4, 1)], [5, 2, 1]), ([pair(1, 3)], [3]), ([pair(4, 0), pair(4, 1)], [2, 1])]
    got = T.merge([(np.array(p), np.array(n)) for p, n in runs])
    assert [(n.tolist(), b.tolist()) for n, b in got] == [([5, 5, 2], [True, True, True]), ([5], [True]), ([2, 2], [True, True])]
