import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hostmill.llm import collocations as C

UPPER = {k: k + 32 for k in range(65, 91)}


def model(rows, top=C.TOP):
    """(lang, rank, phrase, a, l, r, n, score) from all phrases of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= C.LEAST}
    most = Counter()
    for p, a in often.items():
        if len(p) == 4:
            for q in (p[:3], (p[0], *p[2:])):
                most[q] = max(most[q], a)
    out = []
    for lang in n:
        mine = []
        for p, a in often.items():
            if p[0] != lang or 100 * most[p] >= 50 * a:
                continue
            cuts = [(1000000 * a * a // (f[(lang, *p[1 : 1 + k])] * f[(lang, *p[1 + k :])]), k) for k in range(1, len(p) - 1)]
            s, k = min(cuts)
            mine.append((-s, -a, " ".join(p[1:]).encode(), f[(lang, *p[1 : 1 + k])], f[(lang, *p[1 + k :])]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.fixture(scope="module")
def said(docs):
    odd = [("NEW york City. new York city, É é É", None), ("\x00 a\x1cb \x00 a\x1cb", "fr"), ("a a a a a a a a a a a a a", "en"), ("İstanbul K K", "und"), ("x y", None)]
    return [(r.text, r.lang) for r in docs.select("text", "lang").collect() if len(r.text or "") < 100_000] + odd * 11


@pytest.mark.parametrize("settings", [{}, {"shard": 40, "slice_bytes": 3000}, {"top": 3}], ids=str)
def test_phrases_against_all_counts(spark, said, settings, monkeypatch):
    if "shard" in settings:  # words of several digits, and bitmaps that let all pass
        monkeypatch.setattr(C, "DIGIT", 3)
        monkeypatch.setattr(C, "MOST_BITS", 5)
    docs = spark.createDataFrame([(t, x, "q") for t, x in said], "text string, lang string, w1 string").repartition(3)
    assert found(C.collocations(docs, **settings)) == model(said, settings.get("top", C.TOP))


def test_phrases_of_nothing(no_docs):
    assert C.collocations(no_docs).count() == 0


def test_trie_finds_its_phrases_and_no_others():
    rnd = np.random.default_rng(2)
    words = sorted({"".join(rnd.choice(list("abcdefgh"), 4)) for _ in range(1500)})
    trie = C.Trie(["en"] * len(words), words)
    assert trie.digits == 2
    phrases = np.unique(np.stack([rnd.integers(0, 40, 6000), rnd.integers(0, len(words), 6000), rnd.integers(-1, 3, 6000)]), axis=1)
    state = trie.build(phrases)
    assert len(set(state.tolist())) == phrases.shape[1]
    text = rnd.integers(-1, 60, 50_000)
    codes = np.where(text < 0, 0, text + 1)
    n = trie.count("en", pa.array(words), codes)
    want = Counter((int(a), int(b), -1) for a, b in zip(text, text[1:], strict=False))
    want += Counter(p for p in zip(*(text[k:].tolist() for k in range(3)), strict=False) if p[2] >= 0)
    for p, s in zip(phrases.T.tolist(), state.tolist(), strict=True):
        assert n[s] == want[tuple(p)], p
    assert trie.count("fr", pa.array(words), codes).sum() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 10**11 + 7, 3 * 10**11 + 1, 2 * 10**11 + 3
    counts = spark.createDataFrame([("en", "x", "y", None, a)], "lang string, w1 string, w2 string, w3 string, a long")
    words = spark.createDataFrame([("en", "x", l), ("en", "y", r)], "lang string, word string, n long")
    sizes = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    (got,) = C.ranked(counts, words, sizes).collect()
    assert got.score == 10**6 * a * a // (l * r)
