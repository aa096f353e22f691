import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hostmill.llm import induced_suffixes as I


def model(texts):
    """(n_bytes, n_removed, n_spans, digest) of each text, from all its strings."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + I.W] for b in raw for i in range(len(b) - I.W + 1))
    for b in raw:
        hit = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - I.W + 1):
            if seen[b[i : i + I.W]] > 1:
                hit[i : i + I.W] = True
        spans = int((hit[1:] < hit[:-1]).sum())
        yield len(b), int(hit.sum()), spans, hashlib.sha256(bytes(c for c, h in zip(b, hit, strict=False) if not h)).hexdigest()


@pytest.fixture(scope="module")
def passages():
    """Texts with shared passages around the length that counts, periods, copies, near copies."""
    rnd = random.Random(5)
    say = lambda n: "".join(rnd.choice("abcdefgé \n") for _ in range(n))
    out = [None, "", "short", "x" * 399, "x" * 400, "y" * 401, "ab" * 700, "ab" * 201, "z" * 3000]
    for n in (350, 380, 390, 399, 400, 401, 420, 700):
        p = say(n).encode()[:n].decode(errors="ignore").ljust(n, "q")
        p = p.encode()[:n].decode(errors="replace")
        out += [say(rnd.randrange(300)) + p + say(rnd.randrange(300)) for _ in range(3)]
    base = say(3000)
    out += [base, base]
    for k in range(12):
        near = list(base)
        for _ in range(1 + k):
            near[rnd.randrange(len(near))] = "#"
        out.append("".join(near))
    twice = say(500)
    out += [twice + say(50) + twice, say(2000), "long " + say(60_000)]
    line = say(450)
    out += [say(rnd.randrange(800)) + line[rnd.randrange(40) :] + say(rnd.randrange(800)) for _ in range(60)]
    return out


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("settings", [{}, {"rows_at_once": 7}, {"rows_at_once": 40, "limit": 16}, {"hot": 1}, {"hot": 10}], ids=str)
def test_removal_against_all_strings(spark, passages, settings, monkeypatch):
    if "limit" in settings:
        monkeypatch.setattr(I, "READ_TUPLES", 5)
    rows = [(None if k % 11 == 3 else k % 50, t) for k, t in enumerate(passages)]
    rows += rows[20:22]  # rows repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((-1 if i is None else i, *m) for (i, _), m in zip(rows, model([t for _, t in rows]), strict=True))
    assert found(I.digests(docs, I.repeated(docs, **settings))) == want


def test_many_kinds_of_an_anchor_are_dealt_by_content(spark, passages, monkeypatch):
    monkeypatch.setattr(I, "KINDS", 2)
    rows = list(enumerate(passages))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted((i, *m) for (i, _), m in zip(rows, model(passages), strict=True))
    assert found(I.digests(docs, I.repeated(docs))) == want


def test_queue_merges_runs_in_order(tmp_path):
    rnd = np.random.default_rng(1)
    q = I.Queue(I.Store(str(tmp_path)), 50)
    blocks = []
    for _ in range(9):
        b = rnd.integers(0, 30, (4, 20))
        b[1] = np.arange(20) + len(blocks) * 20
        blocks.append(b[:, np.lexsort((b[1], b[0]))])
        q.push(blocks[-1])
    assert q.runs
    got = np.concatenate(list(q.drain()), axis=1)
    want = np.concatenate(blocks, axis=1)
    assert (got == want[:, np.lexsort((want[1], want[0]))]).all()
    with pytest.raises(ValueError):
        I.Store(None).file()


def test_chunks_cover_every_string_once(passages):
    texts = [(t or "").encode() for t in passages]
    ends = np.cumsum([len(t) for t in texts])
    start, size, anchor, _ = I.chunk_places(b"".join(texts), ends)
    have = sorted(s + k for s, n in zip(start.tolist(), size.tolist(), strict=True) for k in range(n))
    want = sorted(int(e) - len(t) + k for e, t in zip(ends, texts, strict=True) for k in range(len(t) - I.W + 1))
    assert have == want
    assert ((anchor >= start + size - 1) | (anchor >= start)).all() and (anchor - start < I.REACH).all()


def test_removal_of_nothing_and_beside_clashing_columns(no_docs, docs):
    assert I.digests(no_docs, I.repeated(no_docs)).count() == 0
    got = {r.doc_id: r for r in I.digests(docs, I.repeated(docs)).collect()}
    rows = docs.select("doc_id", "text").collect()
    for r, m in zip(rows, model([r.text for r in rows]), strict=True):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == m
